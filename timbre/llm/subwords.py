"""Sampled subword segmentations without replacement: Gumbel top-k by an A* search over the lattice.

The lattice of a text has an edge for every vocabulary piece at every place; a character without a
piece is spelled in byte pieces. A piece's log probability is ``-log(2 + rank)``, its rank being the
vocabulary's score, so the vocabulary is used as it is. A region of the search is a fixed beginning
plus edges that are ruled out at the next place; its largest perturbed log probability is a Gumbel
variable around the log mass of its completions, truncated at that of the region it was cut from.
The best region gives the next segmentation and falls apart into regions, one for each place behind
its beginning. So segmentations come out in the order of their perturbed log probabilities: a
sample without replacement, with the chance of inclusion given the first one that was left out.

Text is cut into words (a word begins at its space marks), whose lattices are remembered; masses
multiply over words. No piece crosses from one word into the next, and a long word is cut again
only at places that none of its pieces crosses, so no edge is lost. The searches of many texts go on side by side: in each round every text takes
its best region, and the new paths of all texts are drawn and cut together in arrays. A random
number is a hash of the row's key, the round and the place in the text, so neither batches nor
retries change a row's samples.

Defined results: null and empty texts have one segmentation, the empty one; texts with fewer
segmentations than asked for give them all, with inclusion 1; rows repeating a key and text give
equal samples; an empty table gives no rows; other columns are ignored. Decoding gives the text
back, except that U+2581 reads as a space, as in the vocabulary's own library.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, count, groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

SAMPLES = 4
MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
#: Characters from which on a word is cut at the next place that no piece crosses.
_LONGEST_WORD = 64
#: Words whose lattices a Python worker remembers, and characters that are searched side by side.
_REMEMBERED, _CHARACTERS = 150_000, 200_000
#: Characters of a remembered word, on average at most, and ids of a batch that is returned, about.
_WORD_SIZE, _IDS = 8, 1_000_000
#: Words up to this size, in characters and bytes, have masses that floats hold; longer ones are summed in logarithms.
_PLAIN_SIZE, _PLAIN_BYTES = 24, 64
#: Steps of a path that are always looked at for its best regions, and steps that share a bound on their masses.
_REACH, _BLOCK = 32, 16
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bits of a character in a key of the pieces' table.
_CHAR_BITS = 21
#: The bits of 1.0, whose lowest 52 bits are steps of 2 ** -52 up to 2.0.
_ONE = np.uint64(0x3FF0000000000000)
_DRAW, _PERTURB = np.uint64(0), np.uint64(1)


def _uniform(seeds: np.ndarray, round_no: int, use: np.uint64, places: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on the arguments alone (the finaliser of SplitMix64 over a counter)."""
    return _mixed(_counters(seeds, round_no, use) + _MIX[0] * places.astype(np.uint64))


def _counters(seeds: np.ndarray, round_no: int, use: np.uint64) -> np.ndarray:
    """What is mixed for place 0; each further place adds ``_MIX[0]``."""
    return seeds + np.uint64(int(_MIX[0]) * ((2 * round_no + int(use) << 40) + 1) & 0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The numbers of counters, which are overwritten."""
    shifted = np.empty_like(x)
    for _ in range(2):
        for shift, factor in ((30, _MIX[1]), (27, _MIX[2]), (31, None)):
            np.right_shift(x, np.uint64(shift), out=shifted)
            x ^= shifted
            if factor is not None:
                x *= factor
    x >>= np.uint64(12)
    x |= _ONE
    return x.view(float) - (1.0 - 2.0**-53)


def _ranges(begin: np.ndarray, stop: np.ndarray, by: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each ``begin`` to its ``stop``, and before them which of the pairs each belongs to."""
    sizes = (stop - begin + by - 1) // by
    which = np.repeat(np.arange(len(begin)), sizes)
    return which, begin[which] + by * (np.arange(len(which)) - (np.cumsum(sizes) - sizes)[which])


class _Lattices(dict):
    """Arrays of lattices by name; what the searches need of few edges only is worked out when asked for."""

    def __init__(self, vocabulary: Vocabulary, stored: dict[str, np.ndarray]) -> None:
        super().__init__(stored)
        self._vocabulary = vocabulary

    def __missing__(self, name: str) -> np.ndarray:
        edges = np.arange(self["first"][-1])
        if name == "log":
            return self._vocabulary.logs(self["code"])
        node = np.searchsorted(self["first"], edges, "right") - 1
        if name == "rest":
            return self.rest(node, edges)
        if name == "upto":
            return self["lower"] + self.shares(node, edges)
        raise KeyError(name)

    def shares(self, nodes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The edges' parts of the mass of their nodes."""
        end, mass = self["end"][edges], self["mass"]
        return np.exp(self._vocabulary.logs(self["code"][edges]) + np.where(end >= 0, mass[end], 0.0) - mass[nodes])

    def rest(self, nodes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The parts of all other edges of the nodes."""
        if not len(nodes):
            return np.zeros(0)
        first = self["first"][nodes]
        degree = self["first"][nodes + 1] - first
        begin = np.cumsum(degree) - degree
        every = np.arange(int(degree.sum())) + np.repeat(first - begin, degree)
        shares = self.shares(np.repeat(nodes, degree), every)
        shares[begin + edges - first] = 0.0
        return np.add.reduceat(shares, begin)


class Vocabulary:
    """Pieces of a sentencepiece model file and the lattices of words."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        #: beginnings of pieces; a whole piece has (ids, log probability), else None
        self.begun: dict[str, tuple[tuple[int], float] | None] = {}
        self.bytes: dict[int, int] = {}
        self.names: list[str | int] = []  # a byte as its number
        size = model.get_piece_size()
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.names.append(int(piece[3:5], 16))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.names.append("")
            else:
                self.names.append(piece)
                self.begun[piece] = ((i,), -math.log(2.0 + min(size, -model.get_score(i))))
                for n in range(1, len(piece)):
                    self.begun.setdefault(piece[:n])
        self._byte_log = -math.log(2.0 + size)
        #: log probability and mass of one to four byte pieces
        self._byte_logs = np.array([self._byte_log * n for n in range(5)])
        self._byte_exps = np.exp(self._byte_logs)
        self._index(size)
        #: of a node: its first edge, the log of its mass; of an edge: its node (-1 behind the word), its piece (or -1 less the
        #: character that is spelled in bytes), the share of the edges before it
        kinds = {"first": np.int64, "mass": float, "end": np.int32, "code": np.int32, "lower": float}
        self._held = {name: np.zeros(1, kind) for name, kind in kinds.items()}  # with room for more than there is
        self.forget()

    def _index(self, size: int) -> None:
        """The beginnings of pieces in a hash table from (beginning, next character) to the longer beginning; a beginning is its slot."""
        bits = max(4, (3 * len(self.begun)).bit_length())
        #: the empty beginning is the number behind all slots
        self._shift, self._empty = np.uint64(64 - bits), 1 << bits
        self._key, piece = np.full(1 << bits, -1, np.int64), np.full((1 << bits) + 1, -1, np.int32)
        slots, by_length = {"": self._empty}, sorted(self.begun, key=len)
        for _, group in groupby(by_length, len):
            parts = list(group)
            keys = np.array([slots[b[:-1]] << _CHAR_BITS | ord(b[-1]) for b in parts], np.int64)
            own, left = self._slots(keys), np.arange(len(keys))
            while len(left):
                free = left[self._key[own[left]] < 0]
                self._key[own[free]] = keys[free]
                left = left[self._key[own[left]] != keys[left]]
                own[left] = (own[left] + 1) & (len(self._key) - 1)
            slots.update(zip(parts, own.tolist(), strict=True))
        for begun, whole in self.begun.items():
            if whole:
                piece[slots[begun]] = whole[0][0]
        self._piece = piece  # of a beginning that is whole, else -1; also of no beginning (-1), as the empty one is no piece
        self._piece_log, self._piece_exp = np.zeros(size), np.zeros(size)
        for whole in filter(None, self.begun.values()):
            self._piece_log[whole[0][0]], self._piece_exp[whole[0][0]] = whole[1], math.exp(whole[1])
        self._piece_log[list(self.bytes.values())] = self._byte_log
        self._byte_ids = np.array([self.bytes.get(b, -1) for b in range(256)], np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _MIX[0] >> self._shift).view(np.int64)

    def _next(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The beginning with each character added; -1 if no piece begins like this."""
        keys = states << _CHAR_BITS
        keys |= chars
        found = self._slots(keys)
        got = self._key.take(found)
        other = np.flatnonzero(got != keys)
        got, keys, slots = got[other], keys[other], found[other]
        found[other] = -1
        while len(other):
            on = np.flatnonzero(got >= 0)
            other, keys, slots = other[on], keys[on], (slots[on] + 1) & (len(self._key) - 1)
            got = self._key.take(slots)
            hit = got == keys
            found[other[hit]] = slots[hit]
            other, keys, slots, got = other[~hit], keys[~hit], slots[~hit], got[~hit]
        return found

    def forget(self) -> None:
        """Begin anew with an empty memory of words."""
        self.words: dict[str, int] = {}  # first node; node k belongs to the word's k-th character
        self._nodes = self._edges = 0

    def _append(self, degree: np.ndarray, **values: np.ndarray) -> None:
        """Add nodes with so many edges each."""
        begin, nodes, edges = self._nodes, self._nodes + len(degree), self._edges + len(values["end"])
        values["first"] = self._edges + np.cumsum(degree)
        for name, more in values.items():
            at, to = {"first": (begin + 1, nodes + 1), "mass": (begin, nodes)}.get(name, (self._edges, edges))
            if to > len(self._held[name]):
                grown = np.zeros(to + to // 2, self._held[name].dtype)
                grown[:at] = self._held[name][:at]
                self._held[name] = grown
            self._held[name][at:to] = more
        self._nodes, self._edges = nodes, edges

    def edges(self, text: str, at: int) -> list[tuple[int, tuple[int, ...], float]]:
        """(end, ids, log probability) of the pieces at a place; one character always has an edge."""
        found, begun = [], self.begun
        for end in range(at + 1, len(text) + 1):
            part = text[at:end]
            if part not in begun:  # no piece begins like this
                break
            piece = begun[part]
            if piece:
                found.append((end, *piece))
        if not found or found[0][0] != at + 1:
            spelled = tuple(self.bytes[b] for b in text[at].encode())
            found.insert(0, (at + 1, spelled, self._byte_log * len(spelled)))
        return found

    def size(self) -> int:
        """Characters of the words in memory."""
        return self._nodes

    def blocks(self, word: str) -> list[str]:
        """A long word cut at places that no piece crosses, others as they are."""
        if len(word) <= _LONGEST_WORD:
            return [word]
        found, begin, reach = [], 0, 0
        for at in range(len(word)):
            if reach <= at and at - begin >= _LONGEST_WORD:
                found.append(word[begin:at])
                begin = at
            reach = max(reach, self.edges(word, at)[-1][0])
        return [*found, word[begin:]]

    def nodes(self, words: list[str]) -> np.ndarray:
        """First node of each word; the lattices of those that aren't there are added."""
        found = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            lacking = [words[k] for k in missing]
            new = dict.fromkeys(lacking)
            plain = [w for w in new if 4 * len(w) <= _PLAIN_BYTES or (len(w) <= _PLAIN_SIZE and len(w.encode()) <= _PLAIN_BYTES)]
            if plain:
                self._add_plain(plain)
            for word in new:
                if word not in self.words:
                    self._add(word)
                new[word] = self.words[word]
            found[missing] = np.fromiter(map(new.__getitem__, lacking), np.int64, len(lacking))
        return found

    def _add(self, word: str) -> None:
        size = len(word)
        edges = [self.edges(word, at) for at in range(size)]
        mass, shares = self._log_masses(edges)
        end, code, lower = [], [], []
        for at in range(size):
            total = 0.0
            for (stop, ids, _), share in zip(edges[at], shares[at], strict=True):
                code.append(ids[0] if len(ids) == 1 else -1 - ord(word[at]))
                end.append(self._nodes + stop if stop < size else -1)
                lower.append(total)
                total += share
        self.words[word] = self._nodes
        self._append(np.array([len(e) for e in edges]), mass=np.array(mass), end=np.array(end), code=np.array(code), lower=np.array(lower))

    def _add_plain(self, words: list[str]) -> None:
        """The lattices of many short words at once: in arrays over all places, one length of piece after the other."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        stop, degree = np.repeat(starts + sizes, sizes), np.zeros(len(chars), np.int64)
        left = stop - np.arange(len(chars))
        at = np.argsort(left.astype(np.uint8), kind="stable")  # places near the ends of their words first
        ahead = left.take(at).astype(np.uint8)
        found, states, length, rows = [], np.full(len(chars), self._empty), 1, np.arange(1, int(left.max()) + 2, dtype=np.uint8)
        while len(at):
            states = self._next(states, chars.take(at + (length - 1)))
            piece = self._piece[states]
            if length == 1:  # a character without a piece is spelled in bytes
                here, rest, code, exp = at, ahead, piece, self._piece_exp.take(piece, mode="clip")
                lacking = np.flatnonzero(piece < 0)
                if len(lacking):
                    own = chars[at[lacking]]
                    code = piece.copy()
                    code[lacking], exp[lacking] = -1 - own, self._byte_exps[self._spelled(own)]
            else:
                whole = np.flatnonzero(piece >= 0)
                here, rest, code = at.take(whole), ahead.take(whole), piece.take(whole)
                exp = self._piece_exp.take(code)
            rank = degree.take(here)
            degree[here] = rank + 1
            found.append((here, rank, code, exp, rest > length, np.searchsorted(rest, rows).tolist()))
            on = np.flatnonzero((states >= 0) & (ahead > length))
            at, states, ahead, length = at.take(on), states.take(on), ahead.take(on), length + 1
        first = np.cumsum(degree) - degree
        total = int(degree.sum())
        ends, codes, lower = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        mass = np.zeros(len(chars) + 1)
        mass[-1] = 1.0  # behind a word
        steps = []
        for length, (here, rank, code, exp, inside, cuts) in enumerate(found, start=1):
            edge = first.take(here) + rank
            end = np.where(inside, here + length, -1)  # the last mass stands for what is behind
            codes[edge], ends[edge] = code, end
            steps.append((here, edge, exp, end, cuts))
        for row in range(len(rows) - 1):
            for here, edge, exp, end, cuts in steps:
                own = slice(cuts[row], cuts[row + 1])
                if own.start < own.stop:
                    places = here[own]
                    before = mass.take(places)
                    lower[edge[own]] = before
                    mass[places] = before + exp[own] * mass.take(end[own])
        lower /= np.repeat(mass[:-1], degree)
        self.words.update(zip(words, (self._nodes + starts).tolist(), strict=True))
        self._append(degree, mass=np.log(mass[:-1]), end=np.where(ends >= 0, ends + self._nodes, -1), code=codes, lower=lower)

    @staticmethod
    def _spelled(chars: np.ndarray) -> np.ndarray:
        """Bytes of characters."""
        return 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of edges."""
        found = self._piece_log.take(codes, mode="clip")
        spelled = np.flatnonzero(codes < 0)
        if len(spelled):
            found[spelled] = self._byte_logs[self._spelled(-1 - codes[spelled])]
        return found

    @staticmethod
    def _log_masses(edges: list) -> tuple[list[float], list[list[float]]]:
        mass, shares = [0.0] * (len(edges) + 1), [[]] * len(edges)
        for at in range(len(edges) - 1, -1, -1):
            whole = [log + mass[end] for end, _, log in edges[at]]
            top = max(whole)
            parts = [math.exp(w - top) for w in whole]
            total = sum(parts)
            mass[at] = top + math.log(total)
            shares[at] = [p / total for p in parts]
        return mass[:-1], shares

    def tables(self) -> _Lattices:
        """The lattices so far, until the words are forgotten."""
        counts = {"first": self._nodes + 1, "mass": self._nodes}
        return _Lattices(self, {n: a[: counts.get(n, self._edges)] for n, a in self._held.items()})

    def spell(self, codes: np.ndarray) -> np.ndarray:
        """The ids of edges."""
        return self.spell_each(codes)[0]

    def spell_each(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The ids of edges, and how many of them each edge has; None if each has one."""
        spelled = np.flatnonzero(codes < 0)
        if not len(spelled):
            return codes.astype(np.int32), None
        chars = -1 - codes[spelled]
        sizes, ids, many = self._spelled(chars), codes, None
        if int(sizes.max()) > 1:
            many = np.ones(len(codes), np.int64)
            many[spelled] = sizes
            ids = np.repeat(codes, many)
            spelled = np.flatnonzero(ids < 0)
        ids = ids.astype(np.int32)
        ids[spelled] = self._byte_ids[np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        return ids, many

    def decode(self, ids: list[int]) -> str:
        out, spelled = [], bytearray()
        for i in ids:
            name = self.names[i]
            if isinstance(name, int):
                spelled.append(name)
            else:
                out.append(spelled.decode("utf-8", "replace") + name)
                spelled.clear()
        text = "".join(out) + spelled.decode("utf-8", "replace")
        return text.replace(MARK, " ").removeprefix(" ")


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each Python worker, kept from task to task."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def split_words(text: str) -> list[str]:
    """Words, each with all of its space marks, and runs of line ends; no piece crosses from one to the next."""
    if "  " in text or "\n\n" in text or MARK in text or text[:1] == " ":
        return _WORD.findall(MARK + text.replace(" ", MARK))
    words = (MARK + text.replace(" ", f" {MARK}").replace("\n", " \n ")).split(" ")  # the same, as marks and line ends stand alone
    return [*filter(None, words)] if "\n" in text else words


class _Searches:
    """The searches over several texts, whose places are counted through all of them. A path is its places and the edges taken there."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str], keys: list[bytes], wanted: int) -> None:
        if len(vocabulary.words) > _REMEMBERED or vocabulary.size() > _REMEMBERED * _WORD_SIZE:
            vocabulary.forget()
        words = [split_words(text) if text else [] for text in texts]
        flat = [*chain.from_iterable(words)]
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        if len(flat) and lengths.max() > _LONGEST_WORD:
            words = [[b for w in ws for b in ((w,) if len(w) <= _LONGEST_WORD else vocabulary.blocks(w))] for ws in words]
            flat = [*chain.from_iterable(words)]
            lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        sizes = np.array([len(ws) for ws in words], np.int64)
        self.nodes = vocabulary.nodes(flat)
        self.tables, self.logs, self.spell_each = vocabulary.tables(), vocabulary.logs, vocabulary.spell_each
        self.wanted, self.texts = wanted, len(texts)
        self.seeds = np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64)
        self.stop = np.cumsum(sizes)  # word after the last one of each text
        self.start = self.stop - sizes
        mass = self.tables["mass"][self.nodes] if flat else np.zeros(0)
        ends = np.cumsum(lengths)
        self.place, self.total = ends - lengths, np.zeros(len(texts))
        self.origin = np.append(0, ends)[np.append(self.start, len(flat))]  # first place of each text, and that behind all
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.shift = self.nodes - self.place  # from a place to its node
        filled = np.flatnonzero(sizes)
        backwards, behind = mass[::-1].copy(), np.empty(len(flat) + 1)
        for a, b in zip((len(flat) - self.stop[filled]).tolist(), (len(flat) - self.start[filled]).tolist(), strict=True):
            np.add.accumulate(backwards[a:b], out=behind[a:b])  # within a text only, so that its neighbours don't change a bit of it
        behind = behind[-2::-1]
        self.total[filled] = behind[self.start[filled]]
        self.after = np.append(behind[1:], 0.0)[: len(flat)]
        self.after[self.stop[filled] - 1] = 0.0
        self.order = count()
        self.found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]
        self.regions: list[list[tuple]] = [[] for _ in texts]

    def _walk(self, words: np.ndarray, places: np.ndarray, round_no: int, drawn: np.ndarray) -> None:
        """Draw the edges from each place to the end of its word into ``drawn``."""
        behind, end, lower = self.tables["first"][1:], self.tables["end"], self.tables["lower"]
        counters = (_counters(self.seeds, round_no, _DRAW) - _MIX[0] * self.origin[:-1].astype(np.uint64)).take(self.text.take(words))
        shift = self.shift.take(words)
        while len(places):
            nodes = places + shift
            edges = behind.take(nodes)
            edges -= 1  # the longest piece is often the likeliest
            u = places.view(np.uint64) * _MIX[0]
            u += counters
            u = _mixed(u)
            moving = (u < lower.take(edges)).nonzero()[0]
            if len(moving):
                own, at = u.take(moving), edges.take(moving)
                while len(moving):
                    at -= 1
                    edges[moving] = at
                    on = (own < lower.take(at)).nonzero()[0]
                    moving, own, at = moving.take(on), own.take(on), at.take(on)
            drawn[places] = edges
            nodes = end.take(edges)
            on = (nodes >= 0).nonzero()[0]
            shift, counters = shift.take(on), counters.take(on)
            places = nodes.take(on) - shift

    def _first_edges(self, nodes: np.ndarray, gone: list[frozenset[int]], numbers: list[float]) -> tuple[list[int], list[float]]:
        """An edge of each node that isn't ruled out, and the share of the others."""
        first = self.tables["first"]
        owner, edges = _ranges(first[nodes], first[nodes + 1])
        shares, edges, cuts = self.tables.shares(nodes[owner], edges).tolist(), edges.tolist(), np.searchsorted(owner, np.arange(len(nodes) + 1)).tolist()
        chosen, rests = [], []
        for a, b, ruled_out, u in zip(cuts[:-1], cuts[1:], gone, numbers, strict=True):
            left = [k for k in range(a, b) if edges[k] not in ruled_out]
            own = [shares[k] for k in left]
            target, k, upto = u * sum(own), 0, own[0]
            while upto <= target and k < len(own) - 1:
                k += 1
                upto += own[k]
            chosen.append(edges[left[k]])
            rests.append(sum(own[:k]) + sum(own[k + 1 :]))
        return chosen, rests

    def _round(self, round_no: int) -> bool:
        """Each open text takes its best region; False if there is none."""
        drawn = np.full(int(self.origin[-1]), -1, np.int32)  # the edge that the new path takes at a place
        if round_no == 0:
            bounds = self.total - np.log(-np.log(_uniform(self.seeds, 0, _PERTURB, np.full(self.texts, (1 << 40) - 2))))
            for t in np.flatnonzero(self.start == self.stop).tolist():
                self.found[t].append((np.zeros(0, np.int32), 0.0, float(bounds[t])))
            texts = np.flatnonzero(self.start < self.stop)
            if not len(texts):
                return False
            self._walk(np.arange(len(self.nodes)), self.place, 0, drawn)
            self._cut(texts, bounds[texts], [frozenset()] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64), drawn, 0)
            return True
        texts = np.array([t for t, regions in enumerate(self.regions) if regions], np.int64)
        if not len(texts):
            return False
        bounds, _, fixed, taken, gone, places, words = zip(*(heappop(self.regions[t]) for t in texts.tolist()), strict=True)
        places, words = np.array(places), np.array(words)
        u = _uniform(self.seeds[texts], round_no, _DRAW, places - self.origin[texts]).tolist()
        edges, rests = self._first_edges(places + self.shift[words], gone, u)
        drawn[np.concatenate(fixed)] = np.concatenate(taken)
        drawn[places] = edges
        behind = self.tables["end"][edges]
        on = np.flatnonzero(behind >= 0)
        _, whole = _ranges(words + 1, self.stop[texts])
        self._walk(np.append(whole, words[on]), np.append(self.place[whole], behind[on] - self.shift[words[on]]), round_no, drawn)
        gone = [g | {e} for g, e in zip(gone, edges, strict=True)]
        self._cut(texts, -np.array(bounds), gone, np.array(rests), np.array([len(x) for x in fixed]), drawn, round_no)
        return True

    def _cut(self, texts: np.ndarray, bounds: np.ndarray, gone: list[frozenset[int]], rests: np.ndarray, kept: np.ndarray, drawn: np.ndarray, round_no: int) -> None:
        """Note the new paths, whose first ``kept`` steps are fixed, and push the best of what is left of their regions: one for each other step."""
        places = (drawn >= 0).nonzero()[0]
        edges = drawn.take(places).astype(np.int64)
        codes = self.tables["code"].take(edges)
        logs, run = self.logs(codes), np.empty(len(places))
        begin, stop = np.searchsorted(places, self.origin[texts]), np.searchsorted(places, self.origin[texts + 1])
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            np.add.accumulate(logs[a:b], out=run[a:b])
        before = np.append(0.0, run[:-1])
        before[begin] = 0.0
        ids, many = self.spell_each(codes)
        ends = (begin, stop) if many is None else (x[y] for x, y in zip([np.append(0, np.cumsum(many))] * 2, (begin, stop), strict=True))
        for t, a, b, log, bound in zip(texts.tolist(), *(x.tolist() for x in (*ends, run[stop - 1], bounds)), strict=True):
            self.found[t].append((ids[a:b], log, bound))
        free = begin + kept

        def masses(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Nodes of steps, and log masses of all that goes on from there."""
            words = np.searchsorted(self.place, places[steps], "right") - 1
            nodes = places[steps] + self.shift[words]
            return nodes, before[steps] + self.tables["mass"][nodes] + self.after[words]

        counters = _counters(self.seeds[texts], round_no, _PERTURB) - _MIX[0] * self.origin[texts].astype(np.uint64)

        def numbers(rows: np.ndarray, steps: np.ndarray) -> np.ndarray:
            return _mixed(places[steps].view(np.uint64) * _MIX[0] + counters[rows])

        def perturbed(rows: np.ndarray, steps: np.ndarray) -> np.ndarray:
            nodes, middle = masses(steps)
            rest = self.tables.rest(nodes, edges[steps])
            if round_no:
                first = steps == free[rows]
                rest[first] = rests[rows[first]]
            with np.errstate(divide="ignore"):
                middle += np.log(rest)
                return np.where(rest > 0, middle - np.logaddexp(middle - bounds[rows], np.log(-np.log(numbers(rows, steps)))), -np.inf)

        # no region behind the best ones can give a segmentation that is still wanted, or the threshold
        wanted = self.wanted - round_no
        others = [sorted([-x[0] for x in self.regions[t]], reverse=True) for t in texts.tolist()]
        least = np.array([x[wanted - 1] if len(x) >= wanted else -math.inf for x in others])
        few = np.flatnonzero(least == -np.inf)  # texts whose first steps tell what is among the best
        near = free.copy()
        near[few] = np.minimum(stop, free + _REACH)[few]
        rows, steps = _ranges(free, near)
        values = perturbed(rows, steps)
        if wanted <= _REACH and len(few):
            lowered = np.full((len(texts), _REACH), np.inf)
            lowered[rows, steps - free[rows]] = -values
            least[few] = -np.partition(lowered[few], wanted - 1, axis=1)[:, wanted - 1]
        # masses fall from step to step, so that one number tells which steps of a block may come before these
        late, blocks = _ranges(near, stop, _BLOCK)
        most = masses(blocks)[1] - least[late] + 1e-6
        on = np.flatnonzero(most > -53 * math.log(2.0))
        late, blocks, most = late[on], blocks[on], most[on]
        which, more = _ranges(blocks, np.minimum(blocks + _BLOCK, stop[late]))
        on = np.flatnonzero(1.0 - numbers(late[which], more) <= np.exp(np.minimum(most, 0.0))[which])
        rows, steps, values = np.append(rows, late[which[on]]), np.append(steps, more[on]), np.append(values, perturbed(late[which[on]], more[on]))
        on = np.flatnonzero((values >= least[rows]) & (values > -np.inf))
        on = on[np.lexsort((-values[on], rows[on]))]
        on = on[np.arange(len(on)) - np.searchsorted(rows[on], rows[on]) < wanted]
        rows, steps = rows[on], steps[on]
        at, words = places[steps], np.searchsorted(self.place, places[steps], "right") - 1
        found = (rows, begin[rows], steps, values[on], edges[steps], at, words)
        for row, a, step, value, edge, place, word in zip(*(x.tolist() for x in found), strict=True):
            ruled_out = gone[row] | {edge} if a + kept[row] == step else frozenset((edge,))
            heappush(self.regions[texts[row]], (-value, next(self.order), places[a:step], edges[a:step], ruled_out, place, word))

    def run(self) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text (ids, log probability, perturbed one, inclusion), best first."""
        for round_no in range(self.wanted):
            if not self._round(round_no):
                break
        out = []
        for found, regions in zip(self.found, self.regions, strict=True):
            threshold = -regions[0][0] if regions else -math.inf
            rows = []
            for ids, log, bound in found:
                rows.append((ids, log, bound, -math.expm1(-math.exp(min(700.0, log - threshold))) if regions else 1.0))
            out.append(rows)
        return out


def sample_segmentations(vocab: Vocabulary, text: str | None, key: bytes, wanted: int = SAMPLES) -> list[tuple[list[int], float, float, float]]:
    """(ids, log probability, perturbed one, inclusion) of up to ``wanted`` segmentations of one text, best first."""
    return next(sample_texts(vocab, [text or ""], [key], wanted))


def sample_texts(vocab: Vocabulary, texts: list[str], keys: list[bytes], wanted: int) -> Iterator[list[tuple[list[int], float, float, float]]]:
    """``sample_segmentations`` of many texts."""
    for found in _sample_arrays(vocab, texts, keys, wanted):
        yield [(ids.tolist(), *numbers) for ids, *numbers in found]


def _sample_arrays(vocab: Vocabulary, texts: list[str], keys: list[bytes], wanted: int) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """The same with ids in arrays, a bounded number of characters side by side."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= _CHARACTERS):
            size, end = size + len(texts[end]), end + 1
        yield from _Searches(vocab, texts[at:end], keys[at:end], wanted).run()
        at = end


def sampled(rows: DataFrame, keys: list[str], model: str, wanted: int = SAMPLES) -> DataFrame:
    """``keys``, ``sample`` (from 1), ``ids``, ``logprob``, ``perturbed`` and ``inclusion`` of each row's ``text``."""
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key")
    plain = rows.select(*[F.col(k).cast("bigint") for k in keys], F.col("text"), key)

    def part(batch: pa.RecordBatch, own: list[int], out: list[tuple]) -> pa.RecordBatch:
        numbers, ids, *measures = list(zip(*out, strict=True)) or [[]] * 5
        taken = [batch.column(c).take(pa.array(own, pa.int64())) for c in keys]
        offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        arrays = [*taken, pa.array(numbers, pa.int32()), listed, *(pa.array(m, pa.float64()) for m in measures)]
        return pa.RecordBatch.from_arrays(arrays, [*keys, "sample", "ids", "logprob", "perturbed", "inclusion"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            own, out, ids = [], [], 0
            texts = [t or "" for t in batch.column("text").to_pylist()]
            row_keys = [k.encode() for k in batch.column("_key").to_pylist()]
            for k, samples in enumerate(_sample_arrays(vocab, texts, row_keys, wanted)):
                own += [k] * len(samples)
                out += [(n, *found) for n, found in enumerate(samples, start=1)]
                ids += sum(len(found[0]) for found in samples)
                if ids > _IDS:
                    yield part(batch, own, out)
                    own, out, ids = [], [], 0
            yield part(batch, own, out)

    ddl = ", ".join(f"`{k}` long" for k in keys)
    return plain.mapInArrow(read, f"{ddl}, sample int, ids array<int>, logprob double, perturbed double, inclusion double")


def decoded(samples: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the ``text`` that the ids spell."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = pa.array([vocab.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], [*keep, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*keep).schema)
    return samples.select(*keep, "ids").mapInArrow(read, f"{fields}, text string")
