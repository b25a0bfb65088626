"""Claim-once matching of samples to generated files.

Samples take files in sample order; each takes its best file that is still free. That is the
one stable matching in which every file prefers the smallest sample index, so it can be
reached in rounds: every open sample proposes to its best file not held by an earlier sample,
each file keeps the earliest proposer, and refused samples go on.

File names are sorted once. The names that begin with a stem are then an interval of places in that
order, found by sorting the stems among the names, and an exact name is an interval of one place. Places
are dealt into blocks. The samples whose next interval lies in a block meet that block's places
in one task, which serves them in order with a pointer into each interval to its next free place; so
samples that share a stem, or stems that begin alike, need no rounds of their own. An interval that
crosses blocks is offered its first free places only, a block's number of them at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from timbre.functions.expr import path_order, parent_name, stem
from timbre.functions.text import sanitize
from timbre.operators.ordering import positions_by_integer, positions_by_sort, running_total
from timbre.session import cut_lineage

_NOBODY = 1 << 62
#: Places of a block, and so places and samples that an interval across blocks takes on in a round.
BLOCK = 131_072
_GROUP = ("wide", "first", "last")


def first_by_name(inventory: DataFrame, keep: str = "first") -> DataFrame:
    """``(name, path, copies)``: one path per file name (the first or last in path order)."""
    pick = F.min_by if keep == "first" else F.max_by
    return inventory.groupBy("name").agg(
        pick("path", path_order("path")).alias("path"), F.count(F.lit(1)).alias("copies")
    )


def candidate_stems(speaker: Column, target_path: Column, index: Column) -> Column:
    """The six accepted file stems of a sample, best first."""
    token = sanitize(F.coalesce(speaker, F.lit("None")), "legacy")
    base = sanitize(stem(target_path), "legacy")
    folder = sanitize(parent_name(target_path), "legacy")
    number = index.cast("string")
    return F.array(
        F.concat_ws("_", base, F.lit("cloned")),
        F.concat_ws("_", token, folder, number),
        F.concat_ws("_", token, base, number),
        F.concat_ws("_", base, token, number),
        F.concat_ws("_", base, number),
        F.concat_ws("_", token, number),
    )


def _after(text: Column) -> Column:
    """The least bytes above all texts that begin with ``text``."""
    held = text.cast("binary")
    last = F.conv(F.hex(F.substr(held, F.octet_length(held), F.lit(1))), 16, 10).cast("int") + 1
    above = F.concat(F.substr(held, F.lit(1), F.octet_length(held) - 1), F.unhex(F.lpad(F.hex(last), 2, "0")))
    return F.when(F.octet_length(held) > 0, above).otherwise(F.unhex(F.lit("FF")))


def _placed(files: DataFrame, stems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files`` (``name``, ``place``) with their place ``at`` by name, and the interval ``[low, high)`` of each stem."""
    nothing = F.lit(None).cast("string")
    names = files.select(F.col("name").cast("binary").alias("key"), F.lit(1).alias("file"), "place", "name", nothing.alias("stem"))
    edge = [F.lit(0).alias("file"), F.lit(None).cast("bigint").alias("place"), nothing.alias("name"), "stem"]
    lows, highs = (stems.select(key.alias("key"), *edge) for key in (F.col("stem").cast("binary"), _after(F.col("stem"))))
    counted = running_total(names.unionByName(lows).unionByName(highs), ["key", "file"], "file", out="at")
    ends = counted.filter("stem is not null").groupBy("stem").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    return counted.filter("file = 1").select("name", "place", "at"), ends.filter("low < high")


def _options(samples: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(index, options)`` of the samples that some file fits, best option first, and ``(at, place)`` of all files."""
    wishes = cut_lineage(
        samples.select(
            F.col("index").cast("bigint").alias("index"),
            F.posexplode(candidate_stems(F.col("speaker_id"), F.col("target_path"), F.col("index"))).alias("level", "stem"),
        )
    )
    placed, ends = _placed(files, wishes.select("stem").distinct())
    exact = wishes.join(placed.select(F.regexp_replace("name", r"\.wav$", "").alias("stem"), "at"), "stem")
    found = exact.select("index", (F.col("level") + 1).alias("level"), F.col("at").alias("low"), (F.col("at") + 1).alias("high"))
    found = found.unionByName(wishes.join(ends, "stem").select("index", (F.col("level") + 7).alias("level"), "low", "high"))
    wide = F.expr(f"low div {BLOCK} != (high - 1) div {BLOCK}")
    group = [wide.alias("wide"), F.when(wide, F.col("low")).otherwise(F.expr(f"low div {BLOCK}")).alias("first"), F.when(wide, F.col("high")).otherwise(0).alias("last")]
    options = found.select("index", F.struct("level", "low", "high", *group).alias("option"))
    return options.groupBy("index").agg(F.array_sort(F.collect_list("option")).alias("options")), placed.select("at", "place")


_RUN = "array<struct<level:int,low:bigint,high:bigint,wide:boolean,first:bigint,last:bigint>>"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The group that each sample turns to, and its next options as far as they lie there.

    Of the samples of a batch that turn to one interval, no more than it has places can be served, the
    earliest ones; the others go on to their next option here, before anything is shuffled.
    """
    for batch in batches:
        index = batch.column(0).to_pylist()
        turned: Counter[tuple[int, int]] = Counter()
        rows: list[list] = [[] for _ in range(5)]
        for k in sorted(range(len(index)), key=index.__getitem__):
            options = batch.column(1)[k].as_py()
            at = 0
            while at < len(options) and turned[options[at]["low"], options[at]["high"]] >= options[at]["high"] - options[at]["low"]:
                at += 1
            rest = options[at:]
            if rest:
                group = tuple(rest[0][g] for g in _GROUP)
                run = list(takewhile(lambda o: tuple(o[g] for g in _GROUP) == group, rest))
                turned[rest[0]["low"], rest[0]["high"]] += 1
            else:  # nobody's place: its last option is reported as gone
                group, run = (False, -1, 0), options[-1:]
            for column, value in zip(rows, (*group, index[k], run), strict=True):
                column.append(value)
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), batch.schema.field(1).type)
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], [*_GROUP, "index", "run"])


def _serve(samples: pa.Table, places: pa.Table) -> pa.Table:
    """Proposals (``place``, ``index``, ``level``) of one group's samples in order; without a place: nothing is left up to ``level``."""
    order = np.argsort(places.column("at").to_numpy(), kind="stable")
    at, place, open_for = (places.column(c).to_numpy()[order] for c in ("at", "place", "open"))
    cut = len(places) > 0 and not places.column("whole")[0].as_py()
    used = np.zeros(len(at), bool)
    queues: dict[tuple[int, int], list] = {}
    out: tuple[list, list, list] = ([], [], [])
    index = samples.column("index").to_numpy()
    for k in np.argsort(index, kind="stable").tolist():
        me, found, level = int(index[k]), None, 0
        for option in samples.column("run")[k].as_py():
            level, ends = option["level"], (option["low"], option["high"])
            if ends not in queues:
                low, high = np.searchsorted(at, ends)
                queues[ends] = [0, (low + np.argsort(place[low:high], kind="stable")).tolist()]
            queue = queues[ends]
            # what is taken, or closed to this sample, is so to all later ones
            while queue[0] < len(queue[1]) and (used[queue[1][queue[0]]] or open_for[queue[1][queue[0]]] <= me):
                queue[0] += 1
            if queue[0] < len(queue[1]):
                found = queue[1][queue[0]]
                used[found] = True
                break
        if found is None and cut:
            continue
        for column, value in zip(out, (None if found is None else int(place[found]), me, level), strict=True):
            column.append(value)
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], ["place", "index", "level"])


def _offers(asking: DataFrame, places: DataFrame, wide: bool) -> tuple[DataFrame, DataFrame]:
    """The samples and places that meet in each group this round."""
    block = F.expr(f"at div {BLOCK}")
    inside = places.select(F.lit(False).alias("wide"), block.alias("first"), F.lit(0).cast("bigint").alias("last"), "at", "place", "open", F.lit(True).alias("whole"))
    inside = inside.join(asking.filter("not wide").select("first").distinct(), "first", "left_semi").select(*_GROUP, "at", "place", "open", "whole")
    if not wide:
        return asking, inside
    keys = ["first", "last"]
    crossing = asking.filter("wide")
    spans = crossing.groupBy(*keys).agg(F.min("index").alias("_earliest"))
    pieces = spans.withColumn("_block", F.explode(F.expr(f"sequence(first div {BLOCK}, (last - 1) div {BLOCK})")))
    free = places.withColumn("_block", block).join(pieces, "_block").filter("at >= first and at < last and open > _earliest")
    ranked = positions_by_integer(free.select(*keys, "at", "place", "open"), "place", keys, out="_k")
    sizes = free.groupBy(*keys).agg((F.count(F.lit(1)) <= BLOCK).alias("whole"))
    offered = ranked.filter(F.col("_k") < BLOCK).join(sizes, keys).select(F.lit(True).alias("wide"), *keys, "at", "place", "open", "whole")
    turn = positions_by_integer(crossing.select("index", *keys, "run"), "index", keys, out="_k").filter(F.col("_k") < BLOCK)
    return asking.filter("not wide").unionByName(turn.select(F.lit(True).alias("wide"), *keys, "index", "run")), inside.unionByName(offered)


def resolve_generated(
    samples: DataFrame, inventory: DataFrame, held: DataFrame | None = None, keep: str = "first"
) -> DataFrame:
    """``(index, path, rank)`` of the samples that get a file.

    ``samples``: ``index``, ``speaker_id``, ``target_path``. ``held`` (``index``, ``path``) are
    files taken beforehand: they are closed to later samples only. ``rank`` is 1–6 for an exact
    name and 7–12 for the same names as prefixes.
    """
    files = cut_lineage(
        positions_by_sort(first_by_name(inventory, keep).select("name", "path"), [path_order("path")], out="place")
    )
    options, places = _options(samples, files)
    options = cut_lineage(options)
    wide = not options.filter(F.exists("options", lambda o: o["wide"])).isEmpty()
    if held is not None:
        closed = held.join(files, "path").groupBy("place").agg(F.min(F.col("index").cast("bigint")).alias("closed"))
        places = places.join(closed, "place", "left")
    else:
        places = places.withColumn("closed", F.lit(None).cast("bigint"))
    places = cut_lineage(places.select("at", "place", F.coalesce("closed", F.lit(_NOBODY)).alias("open")))

    seen: DataFrame | None = None
    while True:
        waiting, free = options, places
        if seen is not None:
            # a sample that proposed at a level had nothing left at those before
            gone = F.max(F.when(F.col("place").isNull(), F.col("level")).otherwise(F.col("level") - 1))
            known = seen.groupBy("index").agg(gone.alias("_gone"))
            taken = _holders(seen).select("place", F.col("index").alias("_holder"))
            rest = F.filter("options", lambda o: o["level"] > F.coalesce("_gone", F.lit(0)))
            waiting = waiting.join(taken.select(F.col("_holder").alias("index")), "index", "left_anti")
            waiting = waiting.join(known, "index", "left").select("index", rest.alias("options")).filter(F.size("options") > 0)
            free = places.join(taken, "place", "left").select("at", "place", F.least("open", "_holder").alias("open"))
        asking = waiting.mapInArrow(_propose, f"wide boolean, first long, last long, index long, run {_RUN}")
        asking, offered = _offers(asking, free, wide)
        found = asking.groupBy(*_GROUP).cogroup(offered.groupBy(*_GROUP)).applyInArrow(_serve, "place long, index long, level int")
        found = cut_lineage(found)
        if found.isEmpty():
            break
        seen = found if seen is None else cut_lineage(seen.unionByName(found))
    if seen is None:
        return files.select(F.lit(None).cast("bigint").alias("index"), "path", F.lit(None).cast("int").alias("rank")).limit(0)
    return _holders(seen).join(files, "place").select("index", "path", F.col("level").alias("rank"))


def _holders(seen: DataFrame) -> DataFrame:
    """Of all that ever proposed to a place the earliest sample holds it."""
    best = seen.filter("place is not null").groupBy("place").agg(F.min(F.struct("index", "level")).alias("_b"))
    return best.select("place", "_b.index", "_b.level")
