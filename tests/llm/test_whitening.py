"""Rank-one updates and whitening against dense eigendecompositions."""

import math

import numpy as np
import pytest

from timbre.llm import whitening
from timbre.llm.query_whitening import op11_whitening
from timbre.llm.spectra import Spectrum, rank_one
from timbre.llm.whitening import whiten

DDL = "vec_id long, embedding array<double>, component string, `odd.name` string"


def scatter(rows):
    apart = rows - rows.mean(axis=0)
    return apart.T @ apart


def samples(kind, seed=1):
    draw = np.random.default_rng(seed)
    if kind == "plain":
        return np.floor(256 * draw.normal(size=(400, 12)) * np.linspace(0.01, 3, 12))
    if kind == "few":
        return np.floor(256 * draw.normal(size=(5, 12)))
    if kind == "repeated":
        return np.repeat(np.floor(256 * draw.normal(size=(3, 9))), 30, axis=0)
    if kind == "axes":
        return np.eye(10)[np.arange(90) % 10] * 100
    if kind == "close":
        return np.floor(draw.normal(size=(300, 8)) * 1e3) + np.array([1e9] + [0] * 7)
    return draw.integers(-1, 2, (200, 30)).astype(float)


@pytest.mark.parametrize("kind", ["plain", "few", "repeated", "axes", "close", "signs"])
def test_updates_and_merges(kind):
    rows = samples(kind)
    whole, left, right = (Spectrum.empty(rows.shape[1]) for _ in range(3))
    for k, row in enumerate(rows):
        whole.add(row)
        (left if k % 3 else right).add(row)
    left.merge(Spectrum.unpack(right.pack()))
    want = scatter(rows)
    most = max(np.abs(want).max(), 1.0)
    for found in (whole, left):
        assert found.count == len(rows) and np.allclose(found.mean, rows.mean(axis=0), rtol=1e-12)
        assert np.abs(found.vectors.T @ found.vectors - np.eye(rows.shape[1])).max() < 1e-10
        assert np.abs(found.vectors * found.values @ found.vectors.T - want).max() < 1e-10 * most
        assert (np.diff(found.values) >= 0).all()


def test_deflation():
    values, vectors = np.array([1.0, 1.0, 1.0, 2.0]), np.eye(4)
    found, turned = rank_one(values, vectors, np.array([1.0, 2.0, 2.0, 0.0]), 1.0)
    assert np.allclose(found, [1, 1, 2, 10]) and np.allclose(turned * found @ turned.T, np.diag(values) + np.outer([1, 2, 2, 0], [1, 2, 2, 0]))
    same, kept = rank_one(values, vectors, np.zeros(4), 3.0)
    assert same is values and kept is vectors


def check(found, rows, components=4, scale=256):
    """``found`` of (vec_id, list) rows against a dense decomposition."""
    width = max(len(v) for _, v in rows)
    whole = {k: [math.floor(scale * c) for c in v] + [0] * (width - len(v)) for k, (_, v) in enumerate(rows)}
    fit = np.array(sorted({tuple(w) for w in whole.values()}), object)
    n, sums = len(fit), fit.sum(axis=0)
    apart = (fit * n - sums).astype(float) / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = {}
    for k, (vec_id, _) in enumerate(rows):
        deviation = sum((n * x - s) ** 2 for x, s in zip(whole[k], sums, strict=True))
        centred = np.array([(n * x - s) / n for x, s in zip(whole[k], sums, strict=True)], float)
        want.setdefault(vec_id, []).append((deviation, centred @ vectors[:, :components] / np.sqrt(values[:components])))
    got = {}
    for r in found.collect():
        assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-6 and 0 <= r.identity_error < 1e-6
        got.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened))
    assert set(got) == {(vec_id, c + 1) for vec_id in want for c in range(components)}
    for c in range(components):
        pairs = [(g, w) for vec_id, expected in want.items() for g, w in zip(sorted(got[vec_id, c + 1], key=repr), sorted(((d if d < 2**63 else None, v[c]) for d, v in expected), key=repr), strict=True)]
        assert [g[0] for g, _ in pairs] == [w[0] for _, w in pairs]
        ours, theirs = np.array([g[1] for g, _ in pairs]), np.array([w[1] for _, w in pairs])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-7


def test_table(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TASK_VECTORS", 30)
    monkeypatch.setattr(whitening, "COMBINED", 2)
    draw = np.random.default_rng(8)
    spread = draw.normal(size=(150, 7)) * np.linspace(0.2, 2, 7)
    rows = [(k, v.tolist()) for k, v in enumerate(spread)] + [(900, spread[4].tolist()), (900 + 1, [0.5]), (902, []), (5, spread[5].tolist())] + [(1000 + k, spread[7].tolist()) for k in range(80)]
    odd = [(2000, None), (2001, [None, 1.0]), (2002, [math.nan] * 7), (2003, [-math.inf] * 7)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + odd], DDL).repartition(9)
    found = whiten(frame)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found, rows)
    assert whiten(frame, keep=("odd.name", "component")).columns == ["odd.name", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_long_deviations(spark):
    draw = np.random.default_rng(9)
    rows = [(k, (v * 1e7).tolist()) for k, v in enumerate(draw.normal(size=(40, 5)))] + [(None, [1.0] * 5)]
    check(whiten(spark.createDataFrame([(i, v, "x", "y") for i, v in rows], DDL)), rows)


def test_without_directions(spark):
    one = spark.createDataFrame([(k, [1.0, 2.0], "x", "y") for k in range(4)], DDL)
    assert whiten(one).collect() == [] and whiten(one.filter("false")).collect() == []
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], "x", "y") for k in range(6)], DDL)
    found = whiten(line).collect()
    assert {r.component for r in found} == {1} and len(found) == 6 and all(abs(r.explained - 1) < 1e-9 for r in found)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(op11_whitening(spark, sf_dir), rows)
