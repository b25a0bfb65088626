"""Regions that can't be among the best are left out; what is left gives the same samples."""

import public_tokenizers
import pytest

from timbre.llm import subwords
from timbre.llm.subwords import Vocabulary, sample_texts, split_words

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["the nations and other words of this long text, über alles\n" * 60, "a", "", "an informational tone " * 9, "x" * 90]
KEYS = [b"%d" % n for n in range(len(TEXTS))]


@pytest.mark.parametrize("reach, block", [(1, 1), (3, 5), (32, 1_000), (100_000, 16)])
def test_samples_do_not_depend_on_what_is_looked_at_first(monkeypatch, reach, block):
    vocab = Vocabulary(PATH)
    want = list(sample_texts(vocab, TEXTS, KEYS, 5))
    monkeypatch.setattr(subwords, "_REACH", reach)
    monkeypatch.setattr(subwords, "_BLOCK", block)
    assert list(sample_texts(vocab, TEXTS, KEYS, 5)) == want


def test_few_steps_of_a_path_are_worked_out(monkeypatch):
    """All of them took a third of the time."""
    steps, rest = [], subwords._Lattices.rest
    monkeypatch.setattr(subwords._Lattices, "rest", lambda self, nodes, edges: (steps.append(len(nodes)), rest(self, nodes, edges))[1])
    found = next(sample_texts(Vocabulary(PATH), TEXTS[:1], KEYS[:1], 4))
    assert len(found) == 4 and sum(steps) < sum(len(ids) for ids, *_ in found) / 10


@pytest.mark.parametrize("text", ["a b", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "\n", "a▁b", "▁", " ", "a\n", "é\x00 b"])
def test_words_are_those_of_the_pattern(text):
    assert split_words(text) == subwords._WORD.findall(subwords.MARK + text.replace(" ", subwords.MARK))
