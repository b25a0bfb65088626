import re

import numpy as np
import pytest
import xxhash

from timbre.llm import components as components_module, hamming
from timbre.llm.components import connected_components
from timbre.llm.simhash import fingerprint, near_duplicates

DDL = "doc_id long, text string, fp string, component int"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def prints(seed, n=500, copies=3):
    generator = np.random.default_rng(seed)
    found = [int(x) for x in generator.integers(0, 2**64, n, dtype=np.uint64)]
    for x in found[: n // 3]:
        for _ in range(copies):
            for bit in generator.integers(0, 64, generator.integers(1, 4)):
                x ^= 1 << int(bit)
            found.append(x)
    found = np.array(sorted(set(found)), np.uint64)
    generator.shuffle(found)
    return found


def brute(found, reach=2):
    i, j = np.nonzero(np.bitwise_count(found[:, None] ^ found[None, :]) <= reach)
    signed = found.view(np.int64)
    return components(signed.tolist(), zip(signed[i].tolist(), signed[j].tolist(), strict=True))


@pytest.mark.parametrize(
    "text",
    [None, "", " \t\n", "One", "two WORDS", "a b c", "Ünï A\x1fb c  d\x0be \x0cf", "repeat " * 90, "x" * 200_000, "w1 w2 " * 60_000],
)
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_local_stars_span_the_same_components(monkeypatch):
    monkeypatch.setattr(hamming, "_LEAF", 8)
    found = prints(0)
    a, b = hamming.local_stars(found, np.ones(len(found), bool), 2)
    got = components(found.view(np.int64).tolist(), zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True))
    assert got == brute(found) and len(a) < len(found)


def test_dense_cluster_gives_no_pairs(monkeypatch):
    monkeypatch.setattr(hamming, "_LEAF", 8)
    ball = np.array([0] + [1 << k for k in range(64)] + [(1 << k) | 1 for k in range(1, 64)], np.uint64)
    a, _ = hamming.local_stars(ball, np.ones(len(ball), bool), 2)
    assert len(a) == len(ball) - 1


@pytest.mark.parametrize("seed", [1, 2])
def test_close_links_over_shards(spark, monkeypatch, seed):
    monkeypatch.setattr(hamming, "SHARD_SIZE", 60)
    found = prints(seed)
    frame = spark.createDataFrame([(int(x),) for x in found.view(np.int64)], "fp long").cache()
    links = hamming.close_links(frame, 2)
    labels = {r.node: r.component for r in connected_components(links).collect()}
    want = brute(found)
    assert {n: labels.get(n, n) for n in want} == want


@pytest.mark.parametrize("rows", [65_536, 8])
def test_components_of_long_chains_and_hubs(spark, monkeypatch, rows):
    monkeypatch.setattr(components_module, "FILE_ROWS", rows)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for link in links for x in link}, links)
    assert all(got.get(n, n) == c for n, c in want.items()) and set(got) <= set(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(spark):
    base = " ".join(f"w{k}" for k in range(400))
    docs = [(9, base, "x", 0), (4, base, "x", 0), (7, base + " tail", "x", 0), (7, base + " tail", "x", 0)]
    docs += [(n, f"other text {n} " * n, "x", 0) for n in range(20, 40)]
    docs += [(1, None, "x", 0), (2, "", "x", 0), (3, "  ", "x", 0), (None, "", "x", 0), (None, "alone without an id", "x", 0)]
    got = near_duplicates(spark.createDataFrame(docs, DDL)).collect()
    assert len(got) == len(docs)
    values = [plain_fingerprint(d[1]) for d in docs]
    group = components(range(len(docs)), [(i, j) for i in range(len(docs)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2])
    want = []
    for i, d in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if group[j] == group[i] and docs[j][0] is not None]
        want.append((d[0], f"{values[i]:016x}", min(ids, default=None)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DDL)).collect() == []
