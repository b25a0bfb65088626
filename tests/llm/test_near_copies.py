import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from timbre.llm import near_copies as module
from timbre.llm.near_copies import near_copies

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus(seed):
    """Texts with planted copies of some edited words, chains of them, a hot group, a common passage and odd texts."""
    generator = np.random.default_rng(seed)
    words = lambda n: [f"w{k}" for k in generator.integers(0, 5000, n)]
    passage, texts = words(40), []
    for n in range(60):
        own = words(int(generator.integers(20, 200))) + (passage if n % 3 == 0 else [])
        texts.append(" ".join(own))
        for _ in range(n % 4):
            for at in generator.integers(0, len(own), generator.integers(1, 4)):
                own[at] = f"edit{generator.integers(0, 10**9)}"
            texts.append(" ".join(own))
    hot = words(150)
    for n in range(80):
        own = list(hot)
        own[n % 150] = f"hot{n}"
        texts.append(" ".join(own))
    texts += [texts[0]] * 5 + [texts[0].upper(), None, "", " \t", "one", "One", "two words", "repeat " * 90, "repeat " * 50]
    ids = generator.permutation(len(texts)).tolist()
    return [(i, t, "en", "src", 0) for i, t in zip(ids, texts, strict=True)]


def brute(docs):
    sets, group = [plain_set(d[1]) for d in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(d[0] for d, g in zip(docs, group, strict=True) if g == k) for k in set(group))


@pytest.mark.parametrize(("seed", "at_once", "sample"), [(1, 4, 8192), (2, 0, 8192), (3, 0, 1)])
def test_edited_copies_go(spark, monkeypatch, seed, at_once, sample):
    monkeypatch.setattr(module, "_PAIRS_A_PLACE", at_once)
    monkeypatch.setattr(module, "_SAMPLE", sample)
    monkeypatch.setattr(module, "_BLOCK", 2_048 if seed == 1 else 16)
    monkeypatch.setattr(module, "_BUCKET_BYTES", 16 << 20 if seed == 1 else 5_000)
    monkeypatch.setattr(module, "_PACKED", 1 << 21 if seed == 1 else 500)
    docs = corpus(seed)
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, DDL), "")
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in left.collect()) == brute(docs)


def test_rows_without_an_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = [(None, text, "en", "s", 0), (7, text + " x", "en", "s", 0), (8, text + " y", "en", "s", 0), (9, "other", "en", "s", 0), (9, "other", "en", "s", 0)]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, DDL), "")
    assert sorted((r.doc_id for r in left.collect()), key=str) == [7, 9, None]
    assert near_copies(spark.createDataFrame([], DDL)).collect() == []


def test_shards_of_one_hub_hold_each_pair_once():
    """Forty shards of the same 600 alike texts: 7 million offers (230 MB, if all were kept) of 180,000 pairs."""
    many, shards = 600, 40
    node = np.tile(np.arange(many) * 7 - 2_000, shards)
    same = lambda value: np.full(many * shards, value)
    columns = {"shingle": np.repeat(np.arange(shards), many), "node": node, "size": same(100), "print": same(5), "component": node, "own": same(0), "i": same(0), "j": same(0)}
    table = pa.table(columns)
    tracemalloc.start()
    try:
        found = module._search(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    left, right = np.triu_indices(many, 1)
    assert found.column("a").to_pylist() == node[left].tolist() and found.column("b").to_pylist() == node[right].tolist()
    assert peak < 120e6


def alike(many, cells):
    """A shard of ``many`` texts of one fingerprint, each its own component."""
    node = np.arange(many) * 11 - 500
    same = lambda value: np.full(many, value)
    columns = {"shingle": same(3), "node": node, "size": same(100), "print": same(5), "component": node, "own": same(0), "i": same(0), "j": same(0)}
    return pa.table(columns | {"cells": pa.array([c.tobytes() for c in cells], pa.binary())})


def test_a_shards_task_drops_pairs_that_cells_rule_out():
    """Texts whose fingerprints are alike but whose counts aren't gave the square of their number; a few pairs are similar."""
    many, cells = 400, np.zeros((400, module._CELLS), np.uint8)
    for k in range(many):
        cells[k, np.random.default_rng(k // 2).permutation(module._CELLS)[:100]] = 1
    table = alike(many, cells)
    found = module._search(table)
    node = table.column("node").to_numpy()
    assert found.column("a").to_pylist() == node[0::2].tolist() and found.column("b").to_pylist() == node[1::2].tolist()
    cells[:, 7] = 255  # such a count may be larger: nothing is ruled out
    assert module._search(alike(many, cells)).num_rows == many * (many - 1) // 2


def test_a_dense_group_offers_pairs_in_proportion_to_its_size():
    for many in (300, 600):
        found = module._search(alike(many, np.ones((many, module._CELLS), np.uint8)), 8)
        assert many <= found.num_rows <= 8 * many
        left, right = found.column("a").to_numpy(), found.column("b").to_numpy()
        assert len(np.unique(np.concatenate([left, right]))) == many and (left < right).all()
    assert module._search(alike(1, np.ones((1, module._CELLS), np.uint8)), 8).num_rows == 0


@pytest.mark.parametrize("block", [2_048, 16])
def test_a_group_about_the_threshold_is_linked_as_by_brute_force(spark, monkeypatch, block):
    """Of texts of one model with random edits, few are similar to a hub; the first offers don't hold all pairs."""
    generator, docs = np.random.default_rng(5), []
    model = [f"w{k}" for k in range(150)]
    for n in range(150):
        own = list(model)
        for at in generator.choice(150, int(generator.integers(1, 5)), replace=False):
            own[at] = f"edit{generator.integers(0, 10**9)}"
        docs.append((n, " ".join(own), "en", "src", 0))
    monkeypatch.setattr(module, "_BLOCK", block)
    monkeypatch.setattr(module, "_PAIRS_A_PLACE", 0)
    monkeypatch.setattr(module, "_LEAST_LINKED", 1.0)
    monkeypatch.setattr(module, "_MOST_OFFERED", 1)
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, DDL), "")
    assert sorted(r.doc_id for r in left.collect()) == brute(docs)
