"""Near copies: SimHash fingerprints in vantage-point trees over shards of shared shingles, checked exactly.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of ``SHARED / OUT_OF`` or more.
Fingerprints alone can't find such pairs at scale: at 0.8 they differ in 10 bits on average and in up to 20,
and at that reach no tree over all fingerprints prunes anything. So fingerprints are dealt into shards by
the shingles that their texts share. If all sets list their shingles in one order, two similar sets have
one in common among the first ``n - ceil(0.8 n) + 1`` of each; each of these names a shard that the text visits.
The order puts rare shingles first, so most texts visit no shard that another one visits.

To know which are rare, half of all shingles (those with an even hash) are counted, in packed
buckets. What a bounded sample of texts holds repeatedly is not counted but comes last in the order. Both change
the cost, never a shard's sharing. A shingle is its XXH64.

In a shard, every text first meets the shard's hub, the one with the least hash, for links are transitive and pairs
inside a component need no check; another hub follows in the next round. When the open pairs are few, or
hubs link hardly anything more, a vantage-point tree over the shard's fingerprints finds its pairs within ``REACH``
bits, a large shard being cut into blocks that meet in pairs. Pairs are checked by their texts if the
counts of both sets' shingles in ``_CELLS`` cells of hashes allow the similarity; a tree's task looks at these counts
itself. Unless few pairs are open, each text first offers no more than its ``_MOST_OFFERED`` likeliest pairs in a task, where a
block meets itself and its neighbours only: these unite a dense group at a cost in proportion to its size. What is still
of different components then meets in full.

Defined results: texts with equal sets (null and wordless ones have the empty set) are one node; texts
with fewer words than a shingle are one shingle; repeated rows are one node; a null ``doc_id`` takes part but never
names a component; an empty table gives no rows; other columns are ignored. Of pairs that only the trees look at, those
at a similarity of 0.8 lie within ``REACH`` bits but for about one in 100,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from timbre.llm.components import connected_components
from timbre.llm.hamming import close_pairs
from timbre.llm.memory import release
from timbre.session import cut_lineage

SHINGLE_WORDS = 5
#: The least Jaccard similarity, as a fraction.
SHARED, OUT_OF = 4, 5
#: Differing bits up to which a tree offers a pair.
REACH = 22
_SEED = 42
#: Rows whose shingles are counted for the end of the order, and frequent shingles that it lists last.
_SAMPLE, _FREQUENT = 2_048, 20_000
#: Cells of the counts.
_CELLS = 256
#: Bytes of text whose shingles share a bucket, and shingles that a task packs at once.
_BUCKET_BYTES, _PACKED = 16 << 20, 1 << 19
#: Bits of a shingle that are kept in its bucket.
_KEPT_BITS = 40
#: Members of a shard that meet in one task; small shards share tasks, those of one hub up to so many places.
_BLOCK, _TASK_PLACES = 2_048, 65_536
#: Pairs for each visit to a shard that are left to the trees; links for each visit below which hubs end.
_PAIRS_A_PLACE, _LEAST_LINKED = 4, 0.001
#: Offered pairs that a task holds before it drops those that repeat, and whose cells it compares at once.
_OFFERED, _COMPARED = 1 << 20, 1 << 14
#: Pairs that a text offers in a task at first.
_MOST_OFFERED = 8


def shingle_set(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct XXH64 of the shingles, ascending as signed numbers; A-Z lower-cased, words split at ASCII white space."""
    return np.unique(_shingles(text, shingle_words))


def _shingles(text: bytes | None, shingle_words: int) -> np.ndarray:
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle_words, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], _SEED) for a, b in spans), np.uint64, len(words) - width + 1).view(np.int64)


def _fingerprint(shingles: np.ndarray) -> int:
    """Majority bits of the shingles, repeats included, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _PACKED >> 5):
        part = shingles[at : at + (_PACKED >> 5)]
        ones += np.unpackbits(part.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), _SEED)).astype(np.int64))


def _frequent(docs: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, ascending, and in how many."""
    rows = docs.count()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle_words))], ["shingle"])

    texts = docs.select(F.col("text").cast("binary")).sample(min(1.0, _SAMPLE / max(rows, 1)), _SEED).distinct()
    counted = texts.mapInArrow(compute, "shingle long").groupBy("shingle").count().filter("count > 1")
    found = sorted((r[0], r[1]) for r in counted.orderBy(F.desc("count"), "shingle").limit(_FREQUENT).collect())
    return np.array([s for s, _ in found], np.int64), np.array([n for _, n in found], np.int64)


class _Order:
    """Counted shingles, then the odd ones, then those that are frequent in the sample."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray, buckets: int) -> None:
        self.shingles, self.counts, self.buckets = shingles, counts, buckets

    def split(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counted shingles of a set, and the others in their order."""
        seen = np.zeros(len(own), np.int64)
        if len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
            seen = np.where(self.shingles[at] == own, self.counts[at], 0)
        counted = (seen == 0) & (own & 1 == 0)
        other = own[~counted]
        return own[counted], other[np.lexsort((other, seen[~counted]))]

    def names(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each counted shingle, and what is kept of it there."""
        whole = counted.view(np.uint64) >> np.uint64(1)
        kept = whole & np.uint64((1 << _KEPT_BITS) - 1)
        return (whole >> np.uint64(_KEPT_BITS)).astype(np.int64) % self.buckets, kept.astype(np.int64)


def prefix_size(size: int) -> int:
    return size + 1 - -(-SHARED * size // OUT_OF) if size else 0


def _packed(docs: DataFrame, shingle_words: int, order: _Order) -> DataFrame:
    """(bucket, nodes, kept): the counted shingles of many texts, packed; five bytes a shingle and eight for its text."""

    def pack(nodes: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        node, (bucket, kept) = np.concatenate(nodes), order.names(np.concatenate(parts))
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(order.buckets + 1))
        rows = [(b, by[cuts[b] : cuts[b + 1]]) for b in range(order.buckets) if cuts[b] < cuts[b + 1]]
        small = kept.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : _KEPT_BITS // 8]
        columns = [pa.array([b for b, _ in rows], pa.int32()), pa.array([node[r].tobytes() for _, r in rows], pa.binary()), pa.array([small[r].tobytes() for _, r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "nodes", "kept"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        nodes, parts, held = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                own = shingle_set(text.as_py(), shingle_words)
                counted, _ = order.split(own)
                nodes.append(np.full(len(counted), _node(own), np.int64))
                parts.append(counted)
                held += len(counted)
                if held >= _PACKED:
                    yield pack(nodes, parts)
                    nodes, parts, held = [], [], 0
        if held:
            yield pack(nodes, parts)

    return docs.select(F.col("text").cast("binary")).mapInArrow(compute, "bucket int, nodes binary, kept binary")


def _repeated(table: pa.Table) -> pa.Table:
    """(node, shingle, many): the shingles of a bucket that more than one node holds."""
    release()
    node = np.concatenate([np.frombuffer(n, np.int64) for n in table.column("nodes").to_pylist()])
    width = _KEPT_BITS // 8
    small = np.concatenate([np.frombuffer(k, np.uint8).reshape(-1, width) for k in table.column("kept").to_pylist()])
    whole = np.zeros((len(small), 8), np.uint8)
    whole[:, :width] = small
    kept = whole.view("<i8").ravel()
    by = np.lexsort((node, kept))
    node, kept = node[by], kept[by]
    first = np.append(True, (np.diff(kept) != 0) | (node[1:] != node[:-1]))
    node, kept = node[first], kept[first]
    starts = np.flatnonzero(np.append(True, np.diff(kept) != 0))
    many = np.repeat(np.diff(np.append(starts, len(kept))), np.diff(np.append(starts, len(kept))))
    again = many > 1
    shingle = (int(table.column("bucket")[0].as_py()) << _KEPT_BITS) + kept[again]
    return pa.table([pa.array(node[again]), pa.array(shingle), pa.array(many[again], pa.int64())], ["node", "shingle", "many"])


def _nodes(docs: DataFrame, shingle_words: int, order: _Order) -> DataFrame:
    """(doc_id, digest, node, size, counted, print, rest, cells) of each row; ``rest`` are the last shingles of its beginning."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for text in batch.column(2):
                every = _shingles(text.as_py(), shingle_words)
                own = np.unique(every)
                counted, other = order.split(own)
                cells = np.minimum(np.bincount(own & (_CELLS - 1), minlength=_CELLS), 255).astype(np.uint8)
                rest = other[: max(0, prefix_size(len(own)) - len(counted))]
                for column, value in zip(rows, (_node(own), len(own), len(counted), _fingerprint(every), rest, cells.tobytes()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            columns = [pa.array(r, t) for r, t in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *columns], ["doc_id", "digest", "node", "size", "counted", "print", "rest", "cells"])

    fields = "doc_id long, digest binary, node long, size long, counted long, print long, rest array<long>, cells binary"
    return docs.select("doc_id", _digest().alias("digest"), F.col("text").cast("binary")).mapInArrow(compute, fields)


def _places(nodes: DataFrame, repeated: DataFrame) -> DataFrame:
    """(shingle, node, size, print): the shards that each node visits, if another one does."""
    listed = repeated.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("many", "shingle"))).alias("listed"))
    beginning = F.col("size") + 1 - F.ceil(F.col("size") * SHARED / OUT_OF)
    alone = F.col("counted") - F.size("listed")
    taken = F.greatest(F.least(beginning, F.col("counted")) - alone, F.lit(0)).cast("int")
    known = ("node", "size", "print")
    first = nodes.join(listed, "node").select(*known, F.explode(F.slice("listed", 1, taken)).alias("_s")).select(*known, F.col("_s.shingle").alias("shingle"))
    places = first.unionByName(nodes.select(*known, F.explode("rest").alias("shingle")))
    places = cut_lineage(places)
    met = places.groupBy("shingle").count().filter("count > 1").select("shingle")
    return cut_lineage(places.join(met, "shingle", "left_semi"))


def _shared_at_most(one: np.ndarray, other: np.ndarray, both: np.ndarray) -> np.ndarray:
    """How many shingles sets of ``both`` shingles together can share: no more than the smaller count of each cell."""
    least = np.minimum(one, other)
    full = (least == 255).any(axis=1)  # a count that doesn't fit a byte says nothing
    return np.where(full, both // 2, least.sum(axis=1, dtype=np.int64))


def _allowed(shared: np.ndarray, both: np.ndarray) -> np.ndarray:
    return (SHARED + OUT_OF) * shared >= SHARED * both


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose counts in cells allow the similarity."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, _CELLS) for k in (2, 3))
            both = batch.column(4).to_numpy()
            yield batch.select([0, 1]).filter(pa.array(_allowed(_shared_at_most(one, other, both), both)))

    left = nodes.select(F.col("node").alias("a"), F.col("cells").alias("left"), F.col("size").alias("_left"))
    right = nodes.select(F.col("node").alias("b"), F.col("cells").alias("right"), F.col("size").alias("_right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right", (F.col("_left") + F.col("_right")).alias("both"))
    return joined.mapInArrow(compute, "a long, b long")


def _similar(pairs: DataFrame, texts: DataFrame, shingle_words: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            keep, sets = [], {}
            for row in range(batch.num_rows):
                one, other = (_held(sets, batch.column(k)[row].as_py(), batch.column(k + 2)[row], shingle_words) for k in (0, 1))
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(OUT_OF * both >= SHARED * (len(one) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(compute, "a long, b long")


def _held(sets: dict[int, np.ndarray], node: int, text: pa.Scalar, shingle_words: int) -> np.ndarray:
    """The set of a node, remembered for the next pairs."""
    if node not in sets:
        if len(sets) >= 256:
            sets.clear()
        sets[node] = shingle_set(text.as_py(), shingle_words)
    return sets[node]


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text): a text of each wanted node, found by its digest."""
    named = nodes.join(wanted, "node", "left_semi").select("node", "digest")
    texts = docs.select(F.col("text").cast("binary").alias("text")).withColumn("digest", _digest())
    return texts.join(named, "digest").dropDuplicates(["node"]).select("node", "text")


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))


def _from_hubs(places: DataFrame, round_no: int) -> DataFrame:
    """Pairs of every text and its shard's hub, the one with the least hash in this round."""
    hub = F.min_by(F.struct("node", "size", "component"), F.xxhash64("node", F.lit(round_no))).alias("hub")
    hubs = places.groupBy("shingle").agg(hub).select("shingle", *[F.col(f"hub.{c}").alias(f"_{c}") for c in ("node", "size", "component")])
    fits = (F.col("component") != F.col("_component")) & (OUT_OF * F.least("size", "_size") >= SHARED * F.greatest("size", "_size"))
    pairs = places.join(hubs, "shingle").filter(fits)
    return pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


class _Offered:
    """Pairs of positions, each kept once in eight bytes: shards of one hub offer most of theirs again and again.

    With the positions' ``cells`` and ``size``, pairs that can't be similar are dropped.
    """

    def __init__(self, size: np.ndarray, cells: np.ndarray | None) -> None:
        self._size, self._cells = size, cells
        self._held: list[np.ndarray] = []
        self._count, self._limit = 0, _OFFERED

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self._held.append(np.minimum(a, b) << 32 | np.maximum(a, b))
        self._count += len(a)
        if self._count >= self._limit:
            self._limit = max(_OFFERED, 2 * len(self.settle()))

    def settle(self) -> np.ndarray:
        """The distinct pairs, ascending; the smaller position in the upper half."""
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *self._held]))
        if self._cells is not None:
            keep = [_allowed(*self._shared(pairs[at : at + _COMPARED])) for at in range(0, len(pairs), _COMPARED)]
            pairs = pairs[np.concatenate([np.zeros(0, bool), *keep])]
        self._held, self._count = [pairs], len(pairs)
        return pairs

    def likeliest(self, most: int) -> np.ndarray:
        """Of the distinct pairs, the ``most`` of each position whose cells allow the highest similarity."""
        pairs = self.settle()
        share = [shared / np.maximum(both, 1) for shared, both in (self._shared(pairs[at : at + _COMPARED]) for at in range(0, len(pairs), _COMPARED))]
        # ties by a mixed order, or all would choose the same few partners
        mixed = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        place, share, mixed = np.concatenate([pairs >> 32, pairs & 0xFFFFFFFF]), np.tile(np.concatenate([np.zeros(0), *share]), 2), np.tile(mixed, 2)
        by = np.lexsort((mixed, -share, place))
        starts = np.flatnonzero(np.append(True, np.diff(place[by]) != 0)) if len(by) else by
        rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
        return pairs[np.unique(by[rank < most] % max(1, len(pairs)))]

    def _shared(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        both = self._size[a] + self._size[b]
        return _shared_at_most(self._cells[a], self._cells[b], both), both


def _search(table: pa.Table, most: int | None = None) -> pa.Table:
    """(a, b): the pairs of a task's shards within ``REACH`` bits, of different components and fitting sizes, each once.

    If the table has ``cells``, only pairs that these allow; with ``most``, so many of each text, the likeliest ones.
    """
    release()
    columns = {c: table.column(c).to_numpy() for c in ("shingle", "node", "size", "print", "component", "own", "i", "j")}
    by = np.lexsort((columns["node"], columns["shingle"]))
    columns = {c: v[by] for c, v in columns.items()}
    prints = columns["print"].view(np.uint64)
    names, one_row, rank = np.unique(columns["node"], return_index=True, return_inverse=True)
    cells = None
    if "cells" in table.column_names:
        cells = np.frombuffer(b"".join(table.column("cells").take(pa.array(by[one_row])).to_pylist()), np.uint8).reshape(-1, _CELLS)
    cuts = np.flatnonzero(np.append(True, np.diff(columns["shingle"]) != 0)).tolist()
    offered = _Offered(columns["size"][one_row], cells)
    for low, high in zip(cuts, [*cuts[1:], len(by)], strict=True):
        members = np.arange(low, high)
        here, there = (members[columns["own"][low:high] == columns[side][low]] for side in ("i", "j"))
        for a, b in close_pairs(prints, here, there, REACH):
            if columns["i"][low] == columns["j"][low]:  # a block that meets itself gives each pair twice
                once = a < b
                a, b = a[once], b[once]
            one, other = columns["size"][a], columns["size"][b]
            fits = (columns["component"][a] != columns["component"][b]) & (OUT_OF * np.minimum(one, other) >= SHARED * np.maximum(one, other))
            offered.add(rank[a[fits]], rank[b[fits]])
    pairs = offered.settle() if most is None else offered.likeliest(most)
    return pa.table([pa.array(names[pairs >> 32]), pa.array(names[pairs & 0xFFFFFFFF])], ["a", "b"])


def _from_trees(places: DataFrame, groups: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs of each shard within ``REACH`` bits, of different components and fitting sizes, whose cells allow the similarity.

    With ``most``, a text offers so many in a task, and a block meets only itself and its two neighbours.
    """
    blocks = F.ceil(F.col("n") / _BLOCK).cast("int")
    sized = places.join(groups.select("shingle", blocks.alias("blocks")), "shingle")
    # shards with one hub share most of their pairs: they go to one task, as far as it holds them, and offer each pair once
    hubs = sized.groupBy("shingle").agg(F.min_by("node", F.xxhash64("node")).alias("hub"), F.count(F.lit(1)).alias("_n"))
    parts = hubs.groupBy("hub").agg(F.ceil(F.sum("_n") / _TASK_PLACES).cast("int").alias("_parts"))
    hubs = hubs.join(parts, "hub").select("shingle", F.pmod(F.xxhash64("hub", F.pmod(F.xxhash64("shingle"), "_parts")), F.lit(max(1, -(-places.count() // _BLOCK)))).alias("some"))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    if most is not None:
        others = F.array_distinct(F.array(own, F.pmod(own + 1, "blocks"), F.pmod(own + F.col("blocks") - 1, "blocks")))
    meetings = F.explode(F.transform(others, lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"))))
    dealt = sized.join(hubs, "shingle").join(nodes.select("node", "cells"), "node").withColumn("own", own).withColumn("_m", meetings).select(
        "shingle", "node", "size", "print", "component", "cells", "own", F.col("_m.i").alias("i"), F.col("_m.j").alias("j"), F.when(F.col("blocks") > 1, F.col("shingle")).otherwise(F.col("some")).alias("deal")
    )

    def search(table: pa.Table) -> pa.Table:
        return _search(table, most)

    return dealt.groupBy("deal", "i", "j").applyInArrow(search, "a long, b long").distinct()


def near_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(component, component_id) of each component of similar texts: its smallest ``doc_id``."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    order = _Order(*_frequent(docs, shingle_words), int(size // _BUCKET_BYTES) + 1)
    firsts = [F.first(c).alias(c) for c in ("digest", "size", "counted", "print", "rest", "cells")]
    nodes = cut_lineage(_nodes(docs, shingle_words, order).groupBy("node").agg(F.min("doc_id").alias("least"), *firsts))
    repeated = _packed(docs, shingle_words, order).groupBy("bucket").applyInArrow(_repeated, "node long, shingle long, many long")
    places = _places(nodes, repeated)
    count, linked, round_no, seen = places.count(), 0, 0, None
    wanted = places.select("node").distinct()
    texts = cut_lineage(_texts(docs, nodes, wanted)) if count else None
    components = nodes.select("node", F.col("node").alias("component"))
    while count:
        named = places.join(components, "node")
        sizes = named.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("_n"))
        groups = sizes.groupBy("shingle").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_n")).alias("_same"), F.count(F.lit(1)).alias("_parts"))
        open_groups = cut_lineage(groups.filter("_parts > 1").select("shingle", "n", "_same"))
        left = open_groups.agg(F.sum(F.expr("(n * n - _same) / 2"))).first()[0]
        if not left:
            break
        # shards that are of one component stay so
        open_places = cut_lineage(named.join(open_groups.select("shingle"), "shingle", "left_semi"))
        places = open_places.drop("component")
        few = left <= _PAIRS_A_PLACE * count
        last = round_no > 0 and (few or seen is not None)
        if last:
            pairs = cut_lineage(_from_trees(open_places, open_groups, nodes))
            pairs = pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")
        elif round_no > 0 and linked <= _LEAST_LINKED * count:
            pairs = seen = cut_lineage(_from_trees(open_places, open_groups, nodes, _MOST_OFFERED))
        else:
            pairs = cut_lineage(_possible(cut_lineage(_from_hubs(open_places, round_no)), nodes))
        new = cut_lineage(_similar(pairs, texts, shingle_words))
        linked, round_no = new.count(), round_no + 1
        if linked:
            # links between components, so that only these are merged
            one, other = (components.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("a", "b"))
            links = new.join(one, "a").join(other, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
            merged = connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("_new"))
            components = cut_lineage(components.join(merged, "component", "left").select("node", F.coalesce("_new", "component").alias("component")))
        if last:
            break
    return components.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
