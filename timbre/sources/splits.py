"""Large JSON arrays and CSV files with quoted line breaks, read by as many tasks as they have ranges.

Where a record begins depends on all that stands before it: on the quotes, and in JSON on the open
brackets. So a first pass reports for each byte range what it does to every state it may start in. These
summaries, one row a range, are chained file by file, and tell each range the state that it really
starts in. A second pass then cuts the records that begin in the range, reading on where the last one
does not end there. No task holds more of a file than a block of it and the record it is at.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from timbre.session import cut_lineage
from timbre.sources.listing import opened

SPLIT_BYTES = 64 << 20
_BLOCK_BYTES = 4 << 20
_QUOTE, _BACKSLASH, _BRACE = ord('"'), ord("\\"), ord("{")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), _BRACE]], _STEP[[ord("]"), ord("}")]] = 1, -1


def byte_ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, bytes, part, start, stop)``: the ranges of each file (``path``, ``bytes``), small ones sharing a task."""
    parts = F.greatest(F.ceil(F.col("bytes") / split_bytes).cast("bigint"), F.lit(1).cast("bigint"))
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    ranges = ranges.select("path", "bytes", "part", (F.col("part") * split_bytes).alias("start"), F.least((F.col("part") + 1) * split_bytes, "bytes").alias("stop"))
    return ranges.repartition(_tasks(ranges, split_bytes), "path", "part")


def _tasks(ranges: DataFrame, split_bytes: int) -> int:
    """One for each full range's worth of bytes, and enough to keep the cluster busy."""
    facts = ranges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bytes")).first()
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return max(1, min(facts["n"], cores), -(-(facts["bytes"] or 0) // split_bytes))


def blocks(path: str, start: int, stop: int | None = None) -> Iterator[bytes]:
    """The bytes from ``start`` on, up to ``stop`` or the end of the file."""
    system, inner, _ = opened(path)
    with system.open_input_file(inner) as file:
        file.seek(start)
        while stop is None or start < stop:
            block = file.read(_BLOCK_BYTES if stop is None else min(_BLOCK_BYTES, stop - start))
            if not block:
                return
            start += len(block)
            yield block


def _chained(summaries: DataFrame, fold: Callable[[list[dict]], list[dict]], fields: str, split_bytes: int) -> DataFrame:
    """Each range with the state that ``fold`` finds for it, from the summaries of one file in order."""
    names = [f.split()[0] for f in fields.split(", ")]

    def link(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        found = fold([{**r, **json.loads(r["summary"])} for r in rows])
        return pa.Table.from_pylist([{n: r[n] for n in names} for r in found])

    held = cut_lineage(summaries)
    chained = held.groupBy("path").applyInArrow(link, fields)
    return chained.repartition(_tasks(held, split_bytes), "path", "part")


def _summaries(ranges: DataFrame, summarise: Callable[[dict], dict]) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = [pa.array([row[n]], t) for n, t in zip(batch.schema.names, batch.schema.types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([json.dumps(summarise(row))])], [*batch.schema.names, "summary"])

    return ranges.mapInArrow(compute, "path string, bytes long, part long, start long, stop long, summary string")


# --- JSON --------------------------------------------------------------------


def _brackets(block: bytes, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Places and steps of the brackets outside strings, and whether the next byte is in a string, and escaped."""
    held = np.frombuffer(block, np.uint8)
    slashes = np.flatnonzero(held == _BACKSLASH)
    if escaped and len(slashes) and slashes[0] == 0:
        slashes = slashes[1:]
    spoiled = np.zeros(0, np.int64)
    ends_escaped = escaped and len(block) == 0
    if len(slashes):
        first = np.flatnonzero(np.append(True, np.diff(slashes) > 1))
        sizes = np.diff(np.append(first, len(slashes)))
        after = (slashes[first] + sizes)[sizes % 2 == 1]
        ends_escaped = bool(len(after)) and int(after[-1]) == len(held)
        spoiled = after[after < len(held)]
    if escaped and len(block):
        spoiled = np.append(spoiled, 0)
    quotes = np.setdiff1d(np.flatnonzero(held == _QUOTE), spoiled, assume_unique=True)
    places = np.flatnonzero(_STEP[held])
    outside = (np.searchsorted(quotes, places) + inside) % 2 == 0
    places = places[outside]
    return places, _STEP[held[places]].astype(np.int64), bool((len(quotes) + inside) % 2), ends_escaped


_JSON_STARTS = ((False, False), (True, False), (True, True))


def _json_summary(row: dict) -> dict:
    """For each state to start in: the state at the end, the change of depth, and at which depth how many objects open."""
    states = [[inside, escaped, 0, Counter()] for inside, escaped in _JSON_STARTS]
    head = ""
    for block in blocks(row["path"], row["start"], row["stop"]):
        head = head or block.lstrip()[:1].decode("latin-1")
        for state in states:
            places, steps, state[0], state[1] = _brackets(block, state[0], state[1])
            depth = state[2] + np.cumsum(steps)
            opens = np.frombuffer(block, np.uint8)[places] == _BRACE
            levels, counts = np.unique(depth[opens] - 1, return_counts=True)
            state[3].update(dict(zip(levels.tolist(), counts.tolist(), strict=True)))
            state[2] = int(depth[-1]) if len(depth) else state[2]
    return {"head": head, "states": [[s[0], s[1], s[2], {str(k): n for k, n in s[3].items()}] for s in states]}


def _json_states(rows: list[dict]) -> list[dict]:
    inside, escaped, depth, first = False, False, 0, 0
    listed = next((r["head"] for r in rows if r["head"]), "") == "["
    for row in rows:
        row |= {"inside": inside, "escaped": escaped, "depth": depth, "first": first, "listed": listed}
        end_inside, end_escaped, change, opened_at = row["states"][_JSON_STARTS.index((inside, inside and escaped))]
        first += opened_at.get(str(1 - depth), 0)
        inside, escaped, depth = end_inside, end_escaped, depth + change
    return rows


def _check(text: str, path: str) -> None:
    try:
        json.loads(text)
    except ValueError as exc:
        raise ValueError(f"{path} is no JSON array: {exc}") from exc


def _json_items(row: dict) -> Iterator[dict]:
    """The objects of the outer array that begin in the range; what lies between them is checked, too."""
    path, stop = row["path"], row["stop"]
    if not row["listed"]:
        if row["part"] == 0:
            _check(b"".join(blocks(path, 0)).decode(), path)
        return
    inside, escaped, depth = row["inside"], row["escaped"], row["depth"]
    buffer, base, at = b"", row["start"], row["start"]
    record: int | None = None
    gap = 0 if row["part"] == 0 else None  # where the text since the last object begins
    lead = ""
    for block in blocks(path, row["start"]):
        places, steps, inside, escaped = _brackets(block, inside, escaped)
        depths = depth + np.cumsum(steps)
        braces = np.frombuffer(block, np.uint8)[places] == _BRACE
        begins = (steps > 0) & braces & (depths == 2)
        ends = (steps < 0) & (depths == 1) & (np.frombuffer(block, np.uint8)[places] == ord("}"))
        depth = int(depths[-1]) if len(depths) else depth
        buffer += block
        for place, opens in zip((places[begins | ends] + at).tolist(), begins[begins | ends].tolist(), strict=True):
            if opens:
                if gap is not None:
                    _check(lead + buffer[gap - base : place - base].decode() + "0]", path)
                    gap = None
                if place >= stop:
                    return
                record = place
            elif record is not None:
                try:
                    yield json.loads(buffer[record - base : place + 1 - base])
                except ValueError as exc:
                    raise ValueError(f"{path} is no JSON array: {exc}") from exc
                record, gap, lead = None, place + 1, "[0"
        at += len(block)
        keep = record if record is not None else gap if gap is not None else at
        buffer, base = buffer[keep - base :], keep
        if at >= stop and record is None and gap is None:
            return
    if record is not None:
        raise ValueError(f"{path} is no JSON array: it ends within an object")
    if gap is not None:
        _check(lead + buffer[gap - base :].decode(), path)


def json_objects(files: DataFrame, make: Callable[[list[dict]], list[pa.Array]], fields: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, source_row, *fields)`` of every object in the JSON array of each file (``path``, ``bytes``).

    ``make`` turns objects into the columns of ``fields``; ``source_row`` counts the objects of a file. A file
    that holds another JSON value has no rows; text that isn't JSON ends the job.
    """
    names = ["path", "source_row", *[f.split()[0].strip("`") for f in fields.split(", ")]]
    states = "path string, part long, start long, stop long, inside boolean, escaped boolean, depth long, first long, listed boolean"
    chained = _chained(_summaries(byte_ranges(files, split_bytes), _json_summary), _json_states, states, split_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number = row["first"]
                for items in batched(_json_items(row)):
                    columns = [pa.array([row["path"]] * len(items)), pa.array(range(number, number + len(items)), pa.int64())]
                    number += len(items)
                    yield pa.RecordBatch.from_arrays([*columns, *make(items)], names)

    return chained.mapInArrow(read, f"path string, source_row long, {fields}")


def batched(items: Iterator, size: int = 2_048) -> Iterator[list]:
    held = []
    for item in items:
        held.append(item)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


# --- CSV ---------------------------------------------------------------------

_EDGES = np.zeros(256, bool)
_EDGES[[_QUOTE, ord(","), ord("\n"), ord("\r")]] = True


def _csv_summary(row: dict) -> dict:
    """How many quotes the range holds, and whether they stand where fields begin and end, for either start."""
    many, regular = 0, [True, True]
    carried = b"\n" if row["start"] == 0 else b"".join(blocks(row["path"], row["start"] - 1, row["start"]))
    # every quote is looked at with its neighbours, the last one with the byte behind the range
    ahead = blocks(row["path"], row["start"], row["stop"] + 1)
    for block in chain(ahead, [b"\n"] if row["stop"] >= row["bytes"] else []):
        text = np.frombuffer(carried + block, np.uint8)
        quotes = np.flatnonzero(text[1:-1] == _QUOTE) + 1
        for start in (0, 1):  # an opening quote follows an edge, a closing one goes before an edge
            opens = (np.arange(len(quotes)) + many + start) % 2 == 0
            regular[start] &= bool(_EDGES[text[quotes[opens] - 1]].all() and _EDGES[text[quotes[~opens] + 1]].all())
        many, carried = many + len(quotes), text[-2:].tobytes()
    return {"many": many, "regular": regular}


def _csv_states(rows: list[dict]) -> list[dict]:
    inside, regular = False, True
    for row in rows:
        row["inside"] = inside
        regular &= row["regular"][int(inside)]
        inside = bool((row["many"] + inside) % 2)
    regular &= not inside
    for row in rows:
        row["regular"] = regular
    return rows


def _csv_records(row: dict) -> Iterator[bytes]:
    """The records that begin in the range, without their line ends."""
    if not row["regular"]:
        if row["part"] == 0:
            yield from _odd_records(row["path"])
        return
    start, stop = row["start"], row["stop"]
    inside, buffer, base, at = row["inside"], b"", start, start
    record: int | None = 0 if start == 0 else None
    if start > 0 and not inside and b"".join(blocks(row["path"], start - 1, start)) == b"\n":
        record = start
    for block in blocks(row["path"], start):
        held = np.frombuffer(block, np.uint8)
        quotes, lines = np.flatnonzero(held == _QUOTE), np.flatnonzero(held == ord("\n"))
        lines = lines[(np.searchsorted(quotes, lines) + inside) % 2 == 0]
        inside = bool((len(quotes) + inside) % 2)
        buffer += block
        for line in (lines + at).tolist():
            if record is not None:
                yield buffer[record - base : line - base].removesuffix(b"\r")
            record = line + 1
            if record >= stop:
                return
        at += len(block)
        keep = at if record is None else record
        buffer, base = buffer[keep - base :], keep
        if at >= stop and record is None:
            return
    if record is not None and len(buffer) > record - base:
        yield buffer[record - base :].removesuffix(b"\r")


def _odd_records(path: str) -> Iterator[bytes]:
    """Records of a file with quotes inside unquoted fields, where quotes can't be paired: read field by field."""
    held, inside, tail = b"", False, b""
    for block in blocks(path, 0):
        *lines, tail = (tail + block).split(b"\n")
        for line in lines:
            held, inside = held + line, _still_inside(line, inside)
            if inside:
                held += b"\n"
            else:
                yield held.removesuffix(b"\r")
                held = b""
    if held + tail:
        yield (held + tail).removesuffix(b"\r")


def _still_inside(line: bytes, inside: bool) -> bool:
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == b'"':
                at += 2
                continue
            inside, at = False, at + 1
        elif line[at : at + 1] == b'"':
            inside, at = True, at + 1
            continue
        at = line.find(b",", at) + 1
        if at == 0:
            return False


def csv_records(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, record)``: the text of every record but the header of each file (``path``, ``bytes``); empty lines are skipped."""
    states = "path string, part long, start long, stop long, inside boolean, regular boolean"
    chained = _chained(_summaries(byte_ranges(files, split_bytes), _csv_summary), _csv_states, states, split_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                records = _csv_records(row)
                if row["part"] == 0:
                    next((r for r in records if r), None)
                for held in batched(r.decode() for r in records if r):
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(held)), pa.array(held)], ["path", "record"])

    return chained.mapInArrow(read, "path string, record string")


def splittable(path: Column) -> Column:
    """False for files that can only be read from their beginning."""
    return ~F.lower(path).rlike(r"\.(gz|bz2|zst|xz|lz4|snappy|deflate)$")
