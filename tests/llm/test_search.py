import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbre.llm import multi_index, topk
from timbre.llm.multi_index import nearest
from timbre.llm.topk import top_k
from timbre.llm.vectors import best

DDL = "vec_id long, embedding array<float>, rank int, score string"


def vectors(seed, n=300, width=6):
    generator = np.random.default_rng(seed)
    rows = [(int(k), [float(np.float32(x)) for x in generator.normal(size=width)], 1, "x") for k in range(n)]
    rows[10] = (10, rows[20][1], 1, "x")
    rows += [(n, None, 1, "x"), (n + 1, [], 1, "x"), (n + 2, [None, 1.0], 1, "x"), (n + 3, [math.nan] * width, 1, "x"), (n + 4, [math.inf] + [0.0] * (width - 1), 1, "x")]
    rows += [(n + 100, [0.0] * width, 1, "x"), (n + 101, [1.0, 2.0], 1, "x"), (None, [1.0] * width, 1, "x"), (20, rows[20][1], 1, "x"), (n + 102, [3.0] * (width + 2), 1, "x")]
    return rows + [(n + 200 + k, rows[7][1], 1, "x") for k in range(40)]


def usable(rows, zero):
    found = {}
    for vec_id, v, *_ in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            found[vec_id] = min(found.get(vec_id, v), v)
    return found


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute(found, every, k):
    out = {}
    for q in (i for i in found if i % every == 0):
        ranked = sorted((-product(found[q], v), i) for i, v in found.items() if i != q)[:k]
        out[q] = [(r, i, -s) for r, (s, i) in enumerate(ranked, start=1)]
    return out


def grouped(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "CANDIDATES", 70)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rows = vectors(seed)
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in usable(rows, True).items()}
    got = grouped(top_k(spark.createDataFrame(rows, DDL), F.col("vec_id") % 10 == 0))
    assert got == brute(whole, 10, 10)


@pytest.mark.parametrize("scale", [3e4, 1e6, 1e30])
def test_large_components(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    draw = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x * scale)) for x in draw.normal(size=5)], 1, "x") for k in range(90)]
    whole = {i: [math.floor(1024 * x) if abs(x) < 2**53 else 1024 * int(x) for x in v] for i, v, *_ in rows}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = {q: [(r, i, clip(s)) for r, i, s in found] for q, found in brute(whole, 10, 10).items()}
    assert grouped(top_k(spark.createDataFrame(rows, DDL), F.col("vec_id") % 10 == 0)) == want


def test_sparse_and_few_rows(spark):
    rows = [(0, [0.0, 0.0, 1.0], 1, "x"), (1, [0.0, 5.0, 0.0], 1, "x"), (2, [0.0, 0.0, 0.0], 1, "x"), (3, [0.0, 0.0, -1.0], 1, "x")]
    got = grouped(top_k(spark.createDataFrame(rows, DDL), F.col("vec_id") % 100 == 0))
    assert got == {0: [(1, 1, 0), (2, 2, 0), (3, 3, -1024 * 1024)]}
    one = spark.createDataFrame(rows[:1], DDL)
    assert top_k(one, F.col("vec_id") == 0).collect() == [] and nearest(one, F.col("vec_id") == 0).collect() == []


def test_best_takes_ties_by_id():
    assert best(np.array([5, 7, 5, 5, 1]), np.array([2, 4, 6, 8, 9]), 3).tolist() == [1, 0, 2]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DDL)
    assert top_k(empty, F.col("vec_id") % 2 == 0).collect() == [] and nearest(empty, F.col("vec_id") % 2 == 0).collect() == []
    unusable = spark.createDataFrame([(0, None, 1, "x"), (2, [0.0], 1, "x")], DDL)
    assert nearest(unusable, F.col("vec_id") % 2 == 0).collect() == []


@pytest.mark.parametrize("shard", [30, 8_192])
def test_nearest_with_all_cells_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(multi_index, "SHARD_ENTRIES", shard)
    rows = vectors(3)
    found = {i: [float(x) for x in v] for i, v in usable(rows, False).items()}
    got = grouped(nearest(spark.createDataFrame(rows, DDL), F.col("vec_id") % 20 == 0, wanted=1.0))
    want = brute(found, 20, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, found_rows in got.items():
        assert [r for r, _, _ in found_rows] == list(range(1, len(found_rows) + 1))
        assert sorted((-s, i) for _, i, s in found_rows) == [(-s, i) for _, i, s in found_rows]
        assert all(abs(s - product(found[q], found[i])) < 1e-9 and i != q for _, i, s in found_rows)


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = {r.vec_id: r.embedding for r in rows.collect()}
    got, want = grouped(nearest(rows, F.col("vec_id") % 20 == 0)), brute(found, 20, 20)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_cells_come_by_summed_distance():
    generator = np.random.default_rng(0)
    index = multi_index.fit(generator.normal(size=(400, 8)), 400, 5)
    query = generator.normal(size=8)
    many = len(index.books[1])
    away = lambda c: -(index.books[0][c // many] @ query[:4] + index.books[1][c % many] @ query[4:])
    visited = index.visit(query, 10_000)
    assert len(visited) == (index.counts > 0).sum() and np.all(np.diff([away(c) for c in visited]) >= -1e-12)
