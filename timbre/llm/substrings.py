"""Exact removal of passages that documents share, through super-k-mers.

Windows of consecutive words that share a minimiser (the least hash of a few neighbouring words in
the window) travel as one packed string to the bucket of that minimiser, where their windows are
sorted and counted. Equal windows have equal minimisers, so they always meet. Phrases that a bounded sample
of the documents holds often are taken as minimisers only where a window has no other, so no phrase
gathers the many different passages that it stands in.

Documents are dealt into batches of bounded bytes by a hash. A batch sends each distinct string
once, with the smallest and largest ``doc_id`` it has there, so a passage that a third of all
documents hold is one entry per batch. A bucket tells each batch the smallest ``doc_id`` of the
windows that occur in a smaller document; the batch, cut the same way again, covers the words.

Defined results: null texts have no words and become empty; a null ``doc_id`` counts as larger
than any other; rows with one ``doc_id`` do not remove each other's words; repeated rows give a row
each; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from timbre.llm.memory import release

WINDOW_WORDS = 13
#: Words that a minimiser hashes together.
MINIMISER_WORDS = 3
#: Text bytes of a batch, from MIN up to MAX, which is reached beyond BATCHES batches; packed bytes of a bucket.
MIN_BATCH_BYTES, MAX_BATCH_BYTES, BATCHES = 4 << 20, 32 << 20, 2048
BUCKET_BYTES = 6 << 20
#: Documents sampled for frequent phrases, how often they stand there, and how many are told to the tasks.
SAMPLE, OFTEN, PHRASES = 4_096, 6, 100_000
_CHUNK_BYTES = 1 << 19
_LAST = np.iinfo(np.int64).max
_FACTOR, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * _FACTOR
    return x ^ (x >> np.uint64(32))


def _word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of a text in which one space follows each word."""
    text = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(text == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts + 1
    powers = np.cumprod(np.full(int(sizes.max()), _FACTOR))
    inside = np.arange(len(text)) - np.repeat(starts, sizes)
    return starts, ends, _mixed(np.add.reduceat(text * powers[inside], starts))


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbours."""
    size, total, power = len(hashes) - width + 1, 0, 1
    for k in range(width):
        total = total + hashes[k : k + size] * np.uint64(power)
        power = power * int(_STEP) % (1 << 64)
    return _mixed(total)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Cuts:
    """Super-k-mers of a batch: distinct strings by number, and where each occurs."""

    strings: dict[bytes, int]
    minimiser: list[int]
    number: np.ndarray  # of the string, for each occurrence
    doc: np.ndarray  # row of the document
    first: np.ndarray  # first word, counted over the batch
    joined: list[bytes]  # each document's words, joined by one space
    n_words: np.ndarray


def _ranked(phrases: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The order by which minimisers are chosen: by hash, the frequent phrases after all others."""
    late = np.zeros(len(phrases), np.uint64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, phrases), len(frequent) - 1)
        late = (frequent[at] == phrases).astype(np.uint64) << np.uint64(63)
    return phrases >> np.uint64(1) | late


_NONE = np.zeros(0, np.uint64)


def cut(texts: list[bytes | None], window: int, frequent: np.ndarray = _NONE) -> Cuts:
    """Cut whole texts into super-k-mers; the numbers depend on the texts and their order alone."""
    joined = [b" ".join((t or b"").split()) for t in texts]
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in joined], np.int64)
    before = np.concatenate([[0], np.cumsum(counts)])
    strings: dict[bytes, int] = {}
    minimiser: list[int] = []
    numbers, rows, firsts = [], [], []
    width = min(MINIMISER_WORDS, window)
    at = 0
    while at < len(joined):
        size, end = 0, at
        while end < len(joined) and (end == at or size + len(joined[end]) <= _CHUNK_BYTES):
            size, end = size + len(joined[end]) + 1, end + 1
        own = np.arange(at, end)[counts[at:end] >= window]
        at = end
        if not len(own):
            continue
        text = b" ".join([joined[k] for k in own]) + b" "
        starts, ends, hashes = _word_hashes(text)
        least = _sliding_least(_ranked(_rolled(hashes, width), frequent), window - width + 1)
        stop = np.repeat(np.cumsum(counts[own]), counts[own])
        windows = np.flatnonzero(stop[: len(least)] - np.arange(len(least)) >= window)
        value = least[windows]
        new = np.concatenate([[True], (np.diff(windows) != 1) | (value[1:] != value[:-1])])
        head = np.flatnonzero(new)
        first, last = windows[head], windows[np.concatenate([head[1:], [len(windows)]]) - 1]
        for a, b, v in zip(starts[first].tolist(), ends[last + window - 1].tolist(), value[head].tolist(), strict=True):
            number = strings.setdefault(text[a:b], len(strings))
            if number == len(minimiser):
                minimiser.append(v)
            numbers.append(number)
        row = np.repeat(own, counts[own])[first]
        rows.append(row)
        firsts.append(first - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])[first] + before[row])
    empty = [np.zeros(0, np.int64)]
    return Cuts(strings, minimiser, np.array(numbers, np.int64), np.concatenate(rows or empty), np.concatenate(firsts or empty), joined, counts)


def _pack(arrays: list[np.ndarray], text: bytes = b"") -> bytes:
    head = struct.pack("<i", len(arrays[0]))
    return zstandard.compress(head + b"".join(a.astype("<i8").tobytes() for a in arrays) + text, 3)


def _unpack(blob: bytes, columns: int) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(blob)
    size = struct.unpack_from("<i", raw)[0]
    arrays = [np.frombuffer(raw, "<i8", size, 4 + 8 * size * k) for k in range(columns)]
    return arrays, raw[4 + 8 * size * columns :]


def _in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows of a batch in an order that depends on the rows alone, and their ids."""
    ids = table.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(np.diff(ids[order]) == 0)
    if len(same):  # rows with one doc_id are put in the order of their texts
        texts = table.column("text").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k], texts[k] or b"")))
    return table.take(pa.array(order)), ids[order]


def _send(table: pa.Table, window: int, buckets: int, batch: int, frequent: np.ndarray = _NONE) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, batch, packed super-k-mers with their smallest and largest document)."""
    table, ids = _in_order(table)
    cuts = cut(table.column("text").to_pylist(), window, frequent)
    if not cuts.strings:
        return
    least, most = np.full(len(cuts.strings), _LAST), np.full(len(cuts.strings), -_LAST - 1)
    np.minimum.at(least, cuts.number, ids[cuts.doc])
    np.maximum.at(most, cuts.number, ids[cuts.doc])
    bucket = (np.array(cuts.minimiser, np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    texts = list(cuts.strings)
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        yield int(bucket[part[0]]), batch, _pack([part, least[part], most[part]], b"\n".join([texts[k] for k in part.tolist()]))


def _least_documents(texts: list[bytes], least: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest document of every window of distinct strings, one string after the other; windows of each."""
    text = b" ".join(texts) + b" "
    starts, ends, hashes = _word_hashes(text)
    counts = np.array([t.count(b" ") + 1 for t in texts])
    stop = np.repeat(np.cumsum(counts), counts)
    rolled = _rolled(hashes, window)
    windows = np.flatnonzero(stop[: len(rolled)] - np.arange(len(rolled)) >= window)
    owner = np.repeat(np.arange(len(texts)), counts)[windows]
    order = np.argsort(rolled[windows], kind="stable")
    key, begin, end = rolled[windows][order], starts[windows][order], ends[windows + window - 1][order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    odd = [k for k in np.flatnonzero(same).tolist() if text[begin[k] : end[k]] != text[begin[k - 1] : end[k - 1]]]
    group = np.cumsum(~same) - 1
    if odd:  # different windows with one hash: told apart by their words
        fresh = int(group[-1]) + 1
        for g in np.unique(group[odd]):
            names: dict[bytes, int] = {}
            for k in np.flatnonzero(group == g).tolist():
                group[k] = names.setdefault(text[begin[k] : end[k]], fresh + len(names))
            fresh += len(names)
    smallest = np.full(int(group.max()) + 1, _LAST)
    np.minimum.at(smallest, group, least[owner[order]])
    found = np.empty(len(windows), np.int64)
    found[order] = smallest[group]
    return found, counts - window + 1


def _answer(frame: pd.DataFrame, window: int) -> Iterator[tuple[int, bytes]]:
    """(batch, runs of windows that a smaller document holds) for one bucket."""
    strings: dict[bytes, int] = {}
    number, batch, local, least, most = [], [], [], [], []
    for k, blob in zip(frame["batch"].tolist(), frame["blob"], strict=True):
        (ids, low, high), text = _unpack(blob, 3)
        number += [strings.setdefault(t, len(strings)) for t in text.split(b"\n")]
        batch.append(np.full(len(ids), k))
        local.append(ids)
        least.append(low)
        most.append(high)
    holder = np.array(number, np.int64)
    batch, local, low, high = (np.concatenate(x) for x in (batch, local, least, most))
    smallest = np.full(len(strings), _LAST)
    np.minimum.at(smallest, holder, low)
    found, counts = _least_documents(list(strings), smallest, window)
    begin = np.cumsum(counts) - counts
    string = np.repeat(np.arange(len(counts)), counts)
    new = np.concatenate([[True], (string[1:] != string[:-1]) | (found[1:] != found[:-1])])
    head = np.flatnonzero(new)
    length = np.diff(np.concatenate([head, [len(found)]]))
    run_of, run_least, run_at = string[head], found[head], head - begin[string[head]]
    runs = np.bincount(run_of, minlength=len(counts))
    first = np.cumsum(runs) - runs
    mine = np.repeat(np.arange(len(holder)), runs[holder])
    run = np.arange(len(mine)) - np.repeat(np.cumsum(runs[holder]) - runs[holder], runs[holder]) + first[holder][mine]
    told = run_least[run] < high[mine]
    mine, run = mine[told], run[told]
    order = np.argsort(batch[mine], kind="stable")
    mine, run = mine[order], run[order]
    if len(mine):
        cuts = np.flatnonzero(np.diff(batch[mine])) + 1
        for m, r in zip(np.split(mine, cuts), np.split(run, cuts), strict=True):
            yield int(batch[m[0]]), _pack([local[m], run_at[r], length[r], run_least[r]])


def _cover(table: pa.Table, blobs: list[bytes], window: int, frequent: np.ndarray = _NONE) -> tuple[pa.Table, list[int], list[int], list[bytes]]:
    """The batch's rows in order, words and removed words of each, and the texts that are left."""
    table, ids = _in_order(table)
    texts = table.column("text").to_pylist()
    cuts = cut(texts, window, frequent)
    total = int(cuts.n_words.sum())
    change = np.zeros(total + 1, np.int64)
    for blob in blobs:
        (local, at, length, least), _ = _unpack(blob, 4)
        order = np.argsort(local, kind="stable")
        local, at, length, least = local[order], at[order], length[order], least[order]
        begin, end = np.searchsorted(local, cuts.number), np.searchsorted(local, cuts.number, "right")
        runs = end - begin
        place = np.repeat(np.arange(len(runs)), runs)
        run = np.arange(len(place)) - np.repeat(np.cumsum(runs) - runs, runs) + begin[place]
        hit = least[run] < ids[cuts.doc[place]]
        start = cuts.first[place[hit]] + at[run[hit]]
        np.add.at(change, start, 1)
        np.add.at(change, start + length[run[hit]] + window - 1, -1)
    covered = np.cumsum(change)[:total] > 0
    stops = np.cumsum(cuts.n_words)
    removed, left = [], []
    for stop, count, text in zip(stops.tolist(), cuts.n_words.tolist(), cuts.joined, strict=True):
        gone = covered[stop - count : stop]
        removed.append(int(gone.sum()))
        if removed[-1]:
            words = text.split(b" ")
            text = b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()])
        left.append(text)
    return table, cuts.n_words.tolist(), removed, left


def frequent_phrases(docs: DataFrame, rows: int, window: int = WINDOW_WORDS) -> np.ndarray:
    """Hashes of the phrases that stand often in a sample of the documents, ascending; they change costs only."""
    width = min(MINIMISER_WORDS, window)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                joined = b" ".join((text.as_py() or b"").split())
                if joined.count(b" ") + 1 >= width and joined:
                    found, many = np.unique(_rolled(_word_hashes(joined + b" ")[2], width), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(many)], ["phrase", "n"])

    texts = docs.select(F.col("text").cast("binary")).sample(min(1.0, SAMPLE / max(rows, 1)), 7)
    counted = texts.mapInArrow(count, "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    found = [r[0] for r in counted.orderBy(F.desc("n"), "phrase").limit(PHRASES).select("phrase").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, the ``keep`` columns, ``text`` (words left, joined by one space), ``n_words``, ``n_removed``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller ``doc_id``. Kept columns named like the results are replaced by them.
    """
    carried = [c for c in keep or [] if c not in ("doc_id", "text", "n_words", "n_removed")]
    facts = docs.agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("rows")).first()
    size = facts["size"] or 0
    frequent = frequent_phrases(docs, facts["rows"], window)
    batch_bytes = min(MAX_BATCH_BYTES, max(MIN_BATCH_BYTES, size // BATCHES))
    batches = -(-size // batch_bytes) or 1
    buckets = -(-3 * size // BUCKET_BYTES) or 1
    key = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(batches))
    dealt = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *carried, key.alias("__batch"))

    def send(batch: tuple, table: pa.Table) -> pa.Table:
        release()
        rows = list(_send(table, window, buckets, batch[0].as_py(), frequent))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "batch": pa.array([r[1] for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        return pd.DataFrame(list(_answer(frame, window)), columns=["batch", "blob"]).astype({"batch": "int64"})

    def cover(rows: pa.Table, marks: pa.Table) -> pa.Table:
        release()
        rows, words, removed, texts = _cover(rows, marks.column("blob").to_pylist(), window, frequent)
        columns = {c: rows.column(c) for c in ["doc_id", *carried]}
        columns |= {"text": pa.array(texts, pa.binary()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        return pa.table(columns)

    sent = dealt.groupBy("__batch").applyInArrow(send, "bucket long, batch long, blob binary")
    marks = sent.groupBy("bucket").applyInPandas(answer, "batch long, blob binary")
    fields = [T.StructField(c, docs.schema[c].dataType) for c in ["doc_id", *carried]]
    schema = T.StructType([*fields, T.StructField("text", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = dealt.groupBy("__batch").cogroup(marks.groupBy("batch")).applyInArrow(cover, schema)
    return done.withColumn("text", F.col("text").cast("string"))
