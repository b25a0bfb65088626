"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search.

Documents are tokenised in Arrow batches, cut into pieces of at most one sequence, and only the
lengths of the pieces travel. Pieces are dealt into groups of bounded size by a hash; each group is
packed best-fit by decreasing length and then improved: pieces of the emptiest bin move into fuller
bins, or are exchanged one for one, two for one or one for two, whenever the fuller bin gets fuller. All
open bins of the group are partners, through an index of their pieces and pairs.
Every exchange increases the sum of squared fills, so the search ends. Bins that are still open are
dealt into new groups with those of other groups, until a round frees hardly a bin.

Defined results: null texts count as empty, an empty document is its closing id alone; rows
repeating a ``doc_id`` are packed row by row; a null ``doc_id`` is carried along; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timbre.llm.memory import held
from timbre.session import cut_lineage

SEQUENCE_TOKENS = 2048
CLOSING_ID = 0
#: Pieces that one task packs together.
GROUP_PIECES = 6_000
#: Open bins meet those of other groups until a round frees no more than this share of them.
LEAST_FREED = 0.001
_MOST_ROUNDS = 127
#: Words whose ids a Python worker remembers.
_REMEMBERED = 450_000

PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_DDL = PIECES_DDL + ", sequence_id long, offset long, fill long"

# Letters whose lower case and composed form are one letter each, then at most a few stops: such a
# word skips the tokenizer's normaliser and splitter, which would leave it as it is.
_PLAIN = r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)"


class WordIds(dict):
    """Ids of whitespace-separated words as little-endian 32-bit bytes, made at first use.

    White space never lies inside a token of this tokenizer, so a text's ids are its words' ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._pieces: dict[str, bytes] = {}
        self._plain = re.compile(_PLAIN).fullmatch
        # the byte-to-character table of byte-level vocabularies
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self._letters = str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(hidden)})

    def _piece(self, text: str) -> bytes:
        """Ids of a run of letters or of stops, which is one word to the model."""
        found = self._pieces.get(text)
        if found is None:
            spelled = text if text.isascii() else text.encode().decode("latin-1").translate(self._letters)
            found = self._pieces[text] = array("I", [t.id for t in self._model.tokenize(spelled)]).tobytes()
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = self._plain(text)
        if plain:
            found = self._piece(plain[1].lower())
            if plain[2]:
                found += self._piece(plain[2])
        else:
            found = array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= _REMEMBERED:
            self.clear()
            self._pieces.clear()
        self[word] = found
        return found

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One memory of words for each Python worker, kept from task to task."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = held(WordIds(path))
    return _WORD_IDS[path]


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: ids, then the closing id; only what exceeds ``capacity`` is cut."""
    closing, width = np.array([CLOSING_ID], "<u4").tobytes(), 4 * capacity

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.text(text.as_py()) + closing
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * (6 if with_ids else 5)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return docs.select("doc_id", "text").mapInArrow(tokenise, PIECES_DDL + (", ids binary" if with_ids else ""))


class _Bins:
    """Bins of piece numbers with their fills."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def add(self, items: list[int]) -> None:
        self.items.append(items)
        self.fill.append(sum(self.sizes[i] for i in items))

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that has room."""
        by_gap: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        gaps = 0  # bit g: some bin has a gap of g
        for i in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[i]
            fitting = gaps >> size
            if fitting:
                gap = size + (fitting & -fitting).bit_length() - 1
                k = by_gap[gap].pop()
                if not by_gap[gap]:
                    gaps ^= 1 << gap
                self.items[k].append(i)
                self.fill[k] += size
            else:
                k, gap = len(self.items), self.capacity
                self.items.append([i])
                self.fill.append(size)
            gap = self.capacity - self.fill[k]
            if not by_gap[gap]:
                gaps |= 1 << gap
            by_gap[gap].append(k)

    def _sums(self, k: int) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
        """Pieces of a bin by their size, and pairs of them by their joint size."""
        alike: dict[int, list[int]] = {}
        for i in self.items[k]:
            alike.setdefault(self.sizes[i], []).append(i)
        single = {size: found[:1] for size, found in alike.items()}
        pairs = {a + b: [alike[a][0], alike[b][0]] for a, b in combinations(alike, 2)}
        pairs.update({2 * size: found[:2] for size, found in alike.items() if len(found) > 1})
        return single, pairs

    def _exchange(self, giver: int, taker: int) -> tuple[list[int], list[int]] | None:
        """What to give and what to take back so that the taker's fill grows most; None if nothing helps."""
        gap = self.capacity - self.fill[taker]
        one, two = self._sums(giver)
        back_one, back_two = self._sums(taker)
        any_given = {**two, **one}
        best, found = 0, None
        # moves, then one for one and two for one, then one for two
        for gives, takes in ((any_given, {0: []}), (any_given, back_one), (one, back_two)):
            sizes = sorted(gives)
            for back, taken in takes.items():
                at = bisect_right(sizes, back + gap) - 1
                if at >= 0 and sizes[at] - back > best:
                    best, found = sizes[at] - back, (gives[sizes[at]], taken)
            if best == gap:
                break
        return found

    def _apply(self, giver: int, taker: int, given: list[int], taken: list[int]) -> None:
        for a, b, items in ((giver, taker, given), (taker, giver, taken)):
            self.items[a] = [i for i in self.items[a] if i not in items]
            self.items[b] = self.items[b] + items
            size = sum(self.sizes[i] for i in items)
            self.fill[a] -= size
            self.fill[b] += size

    def _partner(self, giver: int, live: np.ndarray) -> int | None:
        """The open bin, as full as the giver at least, that can take most from it; None if nothing helps.

        Taking b out of a bin with a gap of g makes room for anything up to b + g, so a piece (or two) of the
        size a is of use where b < a <= b + g. All open bins are looked at, through their pieces and pairs.
        """
        one, two = self._sums(giver)
        fill = self._fills
        takers = live[(fill[live] >= fill[giver]) & (live != giver)]
        if not len(takers):
            return None
        gaps = np.full(len(fill) + 1, -1)
        gaps[takers] = self.capacity - fill[takers]
        widest = int(gaps.max())
        moved = max((a for a in (*one, *two) if a <= widest), default=0)
        best, partner = 0, None
        if moved:
            best, partner = moved, int(np.flatnonzero(gaps >= moved)[np.argmin(gaps[gaps >= moved])])
        pieces = np.flatnonzero(gaps[self._bin_of] >= 0)
        singles = (self._sizes[pieces], self._bin_of[pieces])
        open_pairs = gaps[self._pair_bin[: self._pairs]] >= 0
        pairs = (self._pair_sum[: self._pairs][open_pairs], self._pair_bin[: self._pairs][open_pairs])
        for given, (taken, bins) in (((*one, *two), singles), (one, pairs)):
            reach = taken + gaps[bins]
            for a in sorted(set(given), reverse=True):
                fits = (taken < a - best) & (reach >= a)
                if fits.any():
                    at = np.flatnonzero(fits)
                    least = at[np.argmin(taken[at])]
                    best, partner = a - int(taken[least]), int(bins[least])
        return partner

    def _index(self) -> None:
        self._sizes, self._fills = np.array(self.sizes, np.int64), np.array(self.fill, np.int64)
        self._bin_of = np.zeros(len(self.sizes), np.int64)
        for k, items in enumerate(self.items):
            self._bin_of[items] = k
        self._pairs, self._pair_sum, self._pair_bin = 0, np.zeros(64, np.int64), np.zeros(64, np.int64)
        for k in range(len(self.items)):
            if self.fill[k] < self.capacity:
                self._add_pairs(k)

    def _add_pairs(self, k: int) -> None:
        sums = list(self._sums(k)[1])
        if self._pairs + len(sums) > len(self._pair_sum):  # make room, without the pairs that are no more
            there = self._pair_bin[: self._pairs] < len(self.fill)
            held = [x[: self._pairs][there] for x in (self._pair_sum, self._pair_bin)]
            room = 2 * (len(held[0]) + len(sums))
            self._pair_sum, self._pair_bin = (np.concatenate([x, np.zeros(room - len(x), np.int64)]) for x in held)
            self._pairs = len(held[0])
        self._pair_sum[self._pairs : self._pairs + len(sums)] = sums
        self._pair_bin[self._pairs : self._pairs + len(sums)] = k
        self._pairs += len(sums)

    def _changed(self, k: int) -> None:
        """The index after a bin's pieces have changed; its former pairs go to a bin that never opens."""
        self._fills[k] = self.fill[k]
        self._bin_of[self.items[k]] = k
        former = self._pair_bin[: self._pairs] == k
        self._pair_bin[: self._pairs][former] = len(self.fill)
        if self.items[k] and self.fill[k] < self.capacity:
            self._add_pairs(k)

    def _helped(self, k: int) -> list[int]:
        """Bins that may find a use for bin ``k`` as a taker."""
        gap = self.capacity - self.fill[k]
        if not gap or not self.items[k]:
            return []
        one, two = self._sums(k)
        pairs, bins = self._pair_sum[: self._pairs], self._pair_bin[: self._pairs]
        found = []
        for taken in (0, *one):
            found.append(self._bin_of[(self._sizes > taken) & (self._sizes <= taken + gap)])
            found.append(bins[(pairs > taken) & (pairs <= taken + gap)])
        for taken in two:
            found.append(self._bin_of[(self._sizes > taken) & (self._sizes <= taken + gap)])
        return np.unique(np.concatenate(found)).tolist()

    def improve(self) -> None:
        """Empty the emptiest bins into fuller ones until no exchange makes a fuller bin fuller."""
        self._index()
        live = [k for k in range(len(self.items)) if self.items[k] and self.fill[k] < self.capacity]
        stuck: set[int] = set()
        while True:
            giver = min((k for k in live if k not in stuck), key=lambda k: (self.fill[k], k), default=None)
            if giver is None:
                return
            taker = self._partner(giver, np.array(live))
            if taker is None:
                stuck.add(giver)
                continue
            self._apply(giver, taker, *self._exchange(giver, taker))
            self._changed(giver)
            self._changed(taker)
            live = [k for k in live if k not in (giver, taker) or (self.items[k] and self.fill[k] < self.capacity)]
            stuck.difference_update((giver, taker), self._helped(giver), self._helped(taker))


def _pack_group(pdf: pd.DataFrame, round_no: int, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
    bins = _Bins(pdf["length"].tolist(), capacity)
    bins.best_fit()
    bins.improve()
    first = (round_no << 56) + (int(pdf["_group"].iloc[0]) << 20)
    sequence, offset, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
    for k, items in enumerate(bins.items):
        at = 0
        for i in sorted(items):
            sequence[i], offset[i], fill[i] = first + k, at, bins.fill[k]
            at += bins.sizes[i]
    return pdf.drop(columns="_group").assign(sequence_id=sequence, offset=offset, fill=fill)


def _pack_round(pieces: DataFrame, round_no: int, capacity: int) -> tuple[DataFrame, int]:
    """``pieces`` must be a checkpoint, so that a row's place is the same at every read."""
    groups = -(-pieces.count() // GROUP_PIECES)
    if not groups:
        return pieces.sparkSession.createDataFrame([], PACKED_DDL), 0
    place = F.xxhash64(F.monotonically_increasing_id(), F.lit(round_no))
    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(place, F.lit(groups)).alias("_group"))
    packed = dealt.groupBy("_group").applyInPandas(lambda pdf: _pack_group(pdf, round_no, capacity), PACKED_DDL)
    return cut_lineage(packed), groups


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Place every piece: ``sequence_id``, ``offset`` in it, and the sequence's ``fill``."""
    packed, groups = _pack_round(cut_lineage(pieces), 0, capacity)
    done = []
    for round_no in range(1, _MOST_ROUNDS + 1):
        if groups <= 1:
            break
        is_open = F.col("fill") < capacity
        done.append(packed.filter(~is_open))
        packed = cut_lineage(packed.filter(is_open))
        again, groups = _pack_round(packed, round_no, capacity)
        before, after = (rows.filter("offset = 0").count() for rows in (packed, again))
        if after < before:
            packed = again
        if before - after <= LEAST_FREED * before:
            break
    for frame in done:
        packed = packed.unionByName(frame)
    return packed


def assemble(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Token ids of every sequence; ``pieces`` made ``with_ids``, with unique (doc_id, piece)."""
    joined = packed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = joined.groupBy("sequence_id").agg(parts.alias("_parts"))
    whole = F.aggregate("_parts", F.lit(b""), lambda all_ids, part: F.concat(all_ids, part["ids"]))
    return joined.select("sequence_id", whole.alias("ids"))
