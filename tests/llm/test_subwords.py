import math
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from timbre.llm import subwords
from timbre.llm.subwords import Vocabulary, decoded, sample_segmentations, sampled, split_words

PATH = public_tokenizers.path("piece_bpe_32k.model")
DDL = "conv_id long, turn long, text string, ids string, sample int"
ODD = ["", " ", "  a  b\n\n c", "日本語 ▂ \t", "x" * 300, "😀 é \x00", "a", "tail space  "]


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(PATH)


def segmentations(vocab, text):
    """All of them with their probabilities, by enumeration."""
    found = [((), 0.0)]
    for word in split_words(text):
        whole = []

        def walk(at, ids, log, word=word, whole=whole):
            if at == len(word):
                whole.append((ids, log))
            else:
                for end, i, own in vocab.edges(word, at):
                    walk(end, ids + i, log + own)

        walk(0, (), 0.0)
        found = [(a + b, x + y) for a, x in found for b, y in whole]
    total = math.log(math.fsum(math.exp(log) for _, log in found))
    return {ids: (log, math.exp(log - total)) for ids, log in found}


@pytest.mark.parametrize("text", ODD)
def test_round_trip(vocab, text):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = sample_segmentations(vocab, text, b"1")
    assert len({tuple(ids) for ids, *_ in found}) == len(found) >= 1
    for ids, *_ in found:
        assert vocab.decode(ids) == text == model.decode(ids)


def test_all_segmentations_come_once_in_order(vocab):
    every = segmentations(vocab, "the")
    found = sample_segmentations(vocab, "the", b"2", 10_000)
    assert {tuple(ids) for ids, *_ in found} == set(every) and len(found) == len(every)
    assert [p for _, _, p, _ in found] == sorted((p for _, _, p, _ in found), reverse=True)
    for ids, log, _, inclusion in found:
        assert abs(log - every[tuple(ids)][0]) < 1e-9 and inclusion == 1.0


def test_pairs_are_a_sample_without_replacement(vocab):
    every, draws = segmentations(vocab, "ton"), 20_000
    seen = Counter()
    for n in range(draws):
        first, second = sample_segmentations(vocab, "ton", b"k%d" % n, 2)
        seen[tuple(first[0]), tuple(second[0])] += 1
    for a, (_, p) in every.items():
        for b, (_, q) in every.items():
            if a != b:
                want = p * q / (1 - p)
                assert abs(seen[a, b] / draws - want) < 5 * math.sqrt(want / draws) + 1e-4


def test_inclusion_weights_are_unbiased(vocab):
    """Weighting by probability over inclusion estimates a sum over all segmentations."""
    every, draws, total = segmentations(vocab, "tones"), 3_000, 0.0
    mass = math.log(math.fsum(math.exp(log) for log, _ in every.values()))
    truth = sum(p * len(ids) for ids, (_, p) in every.items())
    for n in range(draws):
        found = sample_segmentations(vocab, "tones", b"w%d" % n, 3)
        total += sum(math.exp(log - mass) / inclusion * len(ids) for ids, log, _, inclusion in found)
    assert abs(total / draws - truth) < 0.1 * truth


def test_neighbours_and_memory_change_nothing(vocab, monkeypatch):
    texts = [*ODD, "some more words here", "and the end of it"] * 3
    keys = [b"%d" % n for n in range(len(texts))]
    alone = [sample_segmentations(vocab, t, k) for t, k in zip(texts, keys, strict=True)]
    assert list(subwords.sample_texts(vocab, texts, keys, 4)) == alone
    monkeypatch.setattr(subwords, "_CHARACTERS", 30)
    monkeypatch.setattr(subwords, "_REMEMBERED", 2)
    assert list(subwords.sample_texts(Vocabulary(PATH), texts[::-1], keys[::-1], 4))[::-1] == alone


def test_table(spark, vocab):
    rows = [(n, 0, t, "x", 1) for n, t in enumerate(ODD)] + [(50, 0, None, "x", 1), (0, 1, "same row", "x", 1), (0, 1, "same row", "x", 1), (None, None, "no key", "x", 1)]
    frame = spark.createDataFrame(rows, DDL)
    got = sampled(frame, ["conv_id", "turn"], PATH)
    again = sampled(frame.repartition(3, "text"), ["conv_id", "turn"], PATH)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    texts = {(r[0], r[1]): r[2] or "" for r in rows}
    for r in decoded(got, PATH, ["conv_id", "turn", "sample"]).collect():
        assert r.text == texts[r.conv_id, r.turn]
    counted = Counter((r.conv_id, r.turn) for r in got.collect())
    assert counted[0, 1] == 8 and counted[50, 0] == counted[0, 0] == 1


def test_empty_table(spark):
    assert sampled(spark.createDataFrame([], DDL), ["conv_id", "turn"], PATH).collect() == []
