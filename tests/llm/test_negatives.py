"""Hard negatives against a scan of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbre.llm import negatives
from timbre.llm.negatives import TopHeap, hard_negatives, strassen

DDL = "vec_id long, embedding array<double>, label int, rank int, score string"


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 9, 11), (16, 64, 33), (65, 31, 17), (0, 4, 4), (40, 40, 40)])
def test_strassen(shape):
    draw = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, b = draw.integers(-(2**28), 2**28, (m, k)), draw.integers(-(2**28), 2**28, (k, n))
    assert np.array_equal(strassen(a, b), a @ b)
    big = strassen(a.astype(object) * 10**30, b.astype(object))
    assert big.tolist() == [[v * 10**30 for v in row] for row in (a @ b).tolist()]


def test_heap_merges():
    draw = np.random.default_rng(5)
    scores, ids = draw.integers(0, 9, 200), np.arange(200)
    heap = TopHeap(7)
    for part in np.array_split(draw.permutation(200), 9):
        part = np.sort(part)
        heap.merge(scores[part], ids[part])
    want = sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:7]
    assert sorted((-s, i) for i, s in heap.entries()) == want


def brute(rows, every):
    held = {}
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held[vec_id] = min(held.get(vec_id, (v, label)), (v, label))
    held = {i: ([math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, (v, label) in held.items()}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = set()
    for a in (i for i in held if i % every == 0):
        score = {i: sum(x * y for x, y in zip(held[a][0], w, strict=False)) for i, (w, _) in held.items() if i != a}
        same = sorted((-s, i) for i, s in score.items() if held[i][1] == held[a][1])[:5]
        for minus, p in same:
            fits = sorted((-s, i) for i, s in score.items() if held[i][1] != held[a][1] and -50 * minus <= 100 * s <= -95 * minus)[:3]
            out |= {(a, p, r, i, clip(-minus), clip(-s)) for r, (s, i) in enumerate(fits, start=1)}
    return out


def vectors(seed, scale=1.0, n=240, width=9):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(4, width))
    rows = [(k, (scale * (centres[k % 4] + draw.normal(size=width))).tolist(), int(draw.choice([0, 1, 1, 2])), 1, "x") for k in range(n)]
    rows += [(n, None, 1, 1, "x"), (n + 1, [None] * width, 1, 1, "x"), (n + 2, [math.nan] * width, 1, 1, "x"), (n + 3, [math.inf] * width, 1, 1, "x")]
    rows += [(n + 4, rows[0][1], None, 1, "x"), (None, rows[0][1], 1, 1, "x"), (n + 5, [], 1, 1, "x"), (n + 6, rows[0][1] + [7.0], 2, 1, "x"), (n + 7, rows[0][1][:3], 2, 1, None)]
    rows += [(0, rows[1][1], 3, 1, "x"), (3, rows[3][1], 0, 1, "x")]
    return rows + [(n + 100 + k, rows[2][1], 2, None, "x") for k in range(30)]


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e30])
def test_against_all_pairs(spark, monkeypatch, scale):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 50)
    monkeypatch.setattr(negatives, "TILE_CANDIDATES", 16)
    rows = vectors(3, scale)
    frame = spark.createDataFrame(rows, DDL)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives(frame, F.col("vec_id") % 5 == 0, label)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in got.collect()]
    want = brute(rows, 5)
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_nothing_to_find(spark):
    rows = spark.createDataFrame([(0, [1.0], 0, 1, "x"), (1, [1.0], 1, 1, "x")], DDL)
    assert hard_negatives(rows, F.col("vec_id") == 0).collect() == []
    assert hard_negatives(rows.filter("false"), F.col("vec_id") == 0).collect() == []
