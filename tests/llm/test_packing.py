import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from timbre.llm import packing
from timbre.llm import packing
from timbre.llm.packing import _Bins, assemble, pack, tokenize_pieces, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
DDL = "doc_id long, text string, sequence_id string, length int"
DOCS = [
    (1, "A small text, isn't it? ÀÉ naïve", "x", 0),
    (2, None, "x", 0),
    (3, "", "x", 0),
    (4, "word salad " * 5_000, "x", 0),
    (5, "twice", "x", 0),
    (5, "twice", "x", 0),
    (None, "no id \x1c\x1d 12ab <|endoftext|> 日本語", "x", 0),
] + [(n, f"text number {n} " * (n % 70), "x", 0) for n in range(10, 150)]


def ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("text", ["", "Plain Words, here.", "don't 's we'll", "İstanbul ſ ΣΑΣ ß", "é a b c", "…!?! ab1c2 \x1c x", "naïve,café;"])
def test_word_ids_are_the_tokenizers(text):
    assert np.frombuffer(word_ids(PATH).text(text), "<u4").tolist() == ids(text)[:-1]


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    docs = spark.createDataFrame(DOCS, DDL)
    rows = pack(tokenize_pieces(docs, PATH)).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and all(r.fill == at for r in members)
    want = []
    for doc_id, text, *_ in DOCS:
        own = ids(text)
        for n, k in enumerate(range(0, len(own), 2048)):
            part = own[k : k + 2048]
            want.append((doc_id, n, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    assert len(by_sequence) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_assembled_ids(spark):
    docs = spark.createDataFrame([d for d in DOCS if d[0] and d[0] != 5], DDL)
    pieces = tokenize_pieces(docs, PATH, with_ids=True).cache()
    packed = pack(pieces.drop("ids"))
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in assemble(packed, pieces).collect()}
    for r in packed.collect():
        assert zlib.crc32(whole[r.sequence_id][r.offset : r.offset + r.length].tobytes()) == r.ids_crc32


def test_empty_table(spark):
    assert pack(tokenize_pieces(spark.createDataFrame([], DDL), PATH)).collect() == []


@pytest.mark.parametrize("low,high,n", [(1, 12, 800), (1, 2048, 500), (600, 1100, 400), (1025, 2047, 200), (2048, 2049, 5)])
def test_search_keeps_all_pieces_and_raises_squared_fill(low, high, n):
    sizes = np.random.default_rng(low).integers(low, high, n).tolist()
    bins = _Bins(sizes, 2048)
    bins.best_fit()
    before, count = sum(f * f for f in bins.fill), sum(f > 0 for f in bins.fill)
    bins.improve()
    assert sorted(i for b in bins.items for i in b) == list(range(n))
    assert [sum(sizes[i] for i in b) for b in bins.items] == bins.fill and max(bins.fill) <= 2048
    assert sum(f * f for f in bins.fill) >= before and sum(f > 0 for f in bins.fill) <= count


def test_partners_among_all_open_bins():
    # best fit needs 1270 bins, partners among the fullest 64 leave them as they are
    sizes = np.random.default_rng(1).integers(500, 1100, 3000).tolist()
    bins = _Bins(sizes, 2048)
    bins.best_fit()
    assert len(bins.items) == 1270
    bins.improve()
    assert sum(f > 0 for f in bins.fill) <= 1239


def test_open_bins_of_all_groups_meet(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    sizes = np.random.default_rng(2).integers(500, 1100, 400).tolist()
    rows = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECES_DDL)
    found = pack(rows).collect()
    assert sorted((r.doc_id, r.length) for r in found) == list(enumerate(sizes))
    fills = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 2048 and len(fills) <= 1.05 * -(-sum(sizes) // 2048) + 3


def test_exchanges():
    bins = _Bins([6, 5, 4, 7], 10)
    for items in ([0], [1], [2], [3]):
        bins.add(items)
    assert bins._exchange(2, 0) == ([2], [])  # a move fills the bin
    bins = _Bins([4, 4, 7, 2], 10)
    bins.add([0, 1])
    bins.add([2, 3])
    assert bins._exchange(0, 1) == ([0, 1], [2])  # two for one
    bins = _Bins([8, 4, 3, 2], 10)
    bins.add([0])
    bins.add([1, 2, 3])
    assert bins._exchange(0, 1) == ([0], [1, 2])  # one for two
    bins = _Bins([5, 4, 5], 10)
    bins.add([0])
    bins.add([1, 2])
    assert bins._exchange(0, 1) == ([0], [1])  # one for one


def test_search_beats_best_fit():
    # best fit needs three bins, an exchange empties one
    sizes = [5, 4, 4, 3, 2, 2]
    bins = _Bins(sizes, 10)
    for items in ([0, 1], [2, 3, 4], [5]):
        bins.add(items)
    bins.improve()
    assert sum(f > 0 for f in bins.fill) == 2 and sorted(f for f in bins.fill if f) == [10, 10]
