"""Segmentations of texts against enumerations and masses over the text in one piece."""

import math

import public_tokenizers
import pytest

from timbre.llm import subwords
from timbre.llm.subwords import MARK, Vocabulary, _Searches, sample_segmentations

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(PATH)


def unsplit(text):
    return MARK + text.replace(" ", MARK)


def segmentations(vocab, text):
    whole, found = unsplit(text), {}

    def walk(at, ids, log):
        if at == len(whole):
            found[ids] = log
        else:
            for end, i, own in vocab.edges(whole, at):
                walk(end, ids + i, log + own)

    walk(0, (), 0.0)
    return found


def log_mass(vocab, text):
    whole = unsplit(text)
    mass = [0.0] * (len(whole) + 1)
    for at in range(len(whole) - 1, -1, -1):
        parts = [log + mass[end] for end, _, log in vocab.edges(whole, at)]
        mass[at] = max(parts) + math.log(math.fsum(math.exp(p - max(parts)) for p in parts))
    return mass[0]


@pytest.mark.parametrize("text", ["  ", "   a", "a    b", "if x:\n     y", "tones"])
@pytest.mark.parametrize("longest", [64, 2])
def test_every_segmentation_is_found(vocab, monkeypatch, text, longest):
    monkeypatch.setattr(subwords, "_LONGEST_WORD", longest)
    vocab.forget()
    want = segmentations(vocab, text)
    found = sample_segmentations(vocab, text, b"1", 100_000)
    assert {tuple(ids): log for ids, log, *_ in found} == pytest.approx(want)


def test_a_double_space_has_four_segmentations(vocab):
    assert len(segmentations(vocab, "  ")) == 4
    found = sample_segmentations(vocab, "  ", b"1", 3)
    assert len({tuple(ids) for ids, *_ in found}) == 3


@pytest.mark.parametrize("text", ["a" * 61 + "nation" * 30, "http://example.org/" + "information" * 40, "日本語テキスト" * 40, " " * 200 + "x", "\n" * 150, "word " * 50, "x" * 300])
def test_mass_of_long_words(vocab, text):
    searches = _Searches(vocab, [text], [b"1"], 4)
    assert searches.total[0] == pytest.approx(log_mass(vocab, text), rel=1e-12)


WORDS = ["▁tones", "▁", "a", "日本", "😀é", "▁information", "x" * 16, "▁▁▁b", "☃ﷺ𝔘", "~~~", "▁Straße,"]


def lattice(vocab, word):
    """(code, end, log, upto, rest) of every edge and the log mass of every place."""
    begin, tables = int(vocab.nodes([word])[0]), vocab.tables()
    edges = range(tables["first"][begin], tables["first"][begin + len(word)])
    ends = [int(tables["end"][e]) - begin if tables["end"][e] >= 0 else None for e in edges]
    spelled = [tuple(vocab.spell(tables["code"][[e]]).tolist()) for e in edges]
    numbers = [float(tables[n][e]) for n in ("log", "upto", "rest") for e in edges]
    return spelled, ends, numbers, tables["mass"][begin : begin + len(word)].tolist()


def test_words_added_together_have_their_lattices():
    together, alone = Vocabulary(PATH), Vocabulary(PATH)
    together.nodes(WORDS)
    for word in WORDS:
        alone._add(word)
    for word in WORDS:
        one, other = lattice(together, word), lattice(alone, word)
        assert one[:2] == other[:2]
        assert one[2] == pytest.approx(other[2], abs=1e-12) and one[3] == pytest.approx(other[3], rel=1e-12)
        assert one[0] == [ids for at in range(len(word)) for _, ids, _ in together.edges(word, at)]


def test_short_words_are_not_walked_place_by_place(monkeypatch):
    """That cost most of the time of texts full of new words."""
    vocab = Vocabulary(PATH)
    monkeypatch.setattr(Vocabulary, "edges", lambda *_: pytest.fail("walked"))
    found = sample_segmentations(vocab, "many new words, 日本 ☃ and some more of them", b"1")
    assert {vocab.decode(ids) for ids, *_ in found} == {"many new words, 日本 ☃ and some more of them"}
