"""Claim-once matching against a plain sequential matcher."""

import random
import re

import pytest

from timbre.operators.claims import resolve_generated


def sequential(samples, paths, held=()):
    """Samples in order; each pops its best free file: exact names first, then prefixes."""
    files = {}
    for path in sorted(paths, key=lambda p: p.split("/")):
        files.setdefault(path.rsplit("/", 1)[-1], path)
    closed = {}
    for index, path in held:
        if files.get(path.rsplit("/", 1)[-1]) == path:
            closed[path] = min(index, closed.get(path, index))
    clean = lambda s: re.sub(r"[^a-zA-Z0-9_-]", "_", s)
    out = {}
    for index, speaker, target in sorted(samples):
        for path, owner in closed.items():
            if owner < index:
                files.pop(path.rsplit("/", 1)[-1], None)
        folder, name = target.rsplit("/", 2)[-2:]
        base, token, parent = clean(name.rsplit(".", 1)[0]), clean(speaker), clean(folder)
        stems = [f"{base}_cloned", f"{token}_{parent}_{index}", f"{token}_{base}_{index}", f"{base}_{token}_{index}", f"{base}_{index}", f"{token}_{index}"]
        hit = next((f"{s}.wav" for s in stems if f"{s}.wav" in files), None)
        if hit is None:
            hit = next((n for s in stems for n in files if n.startswith(s)), None)
        if hit is not None:
            out[index] = files.pop(hit)
    return out


def make_case(seed, samples=30, files=40):
    rng = random.Random(seed)
    bases = [f"u{i}" for i in range(rng.choice([2, 4, 8]))]
    speakers = ["a", "b c", "0"]
    rows = [(i, rng.choice(speakers), f"data/{rng.choice(speakers)}/{rng.choice(bases)}.wav") for i in range(samples)]
    names = set()
    while len(names) < files:
        base, token, n = rng.choice(bases), rng.choice(["a", "b_c", "0"]), rng.randrange(samples)
        form = rng.choice(["{b}_cloned", "{b}_cloned_{t}", "{b}_{n}", "{b}_{n}{n}", "{t}_{n}", "{t}_{b}_{n}", "{b}_{t}_{n}_x", "{t}_{t}_{n}"])
        names.add(f"gen/{rng.choice('xyz')}/" + form.format(b=base, t=token, n=n) + ".wav")
    return rows, sorted(names)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_matches_sequential_order(spark, seed):
    rows, paths = make_case(seed)
    held = [(5, paths[0]), (12, paths[3])] if seed % 2 else []
    inventory = spark.createDataFrame([(p, p.rsplit("/", 1)[-1]) for p in paths], "path string, name string")
    samples = spark.createDataFrame(rows, "index bigint, speaker_id string, target_path string")
    taken = spark.createDataFrame(held, "index bigint, path string") if held else None
    got = {r["index"]: r["path"] for r in resolve_generated(samples, inventory, held=taken).collect()}
    assert got == sequential(rows, paths, held)


def test_many_samples_share_one_target(spark):
    rows = [(i, "s", "data/s/hot.wav") for i in range(60)]
    paths = ["gen/hot_cloned.wav"] + [f"gen/hot_cloned_{i:03d}.wav" for i in range(45)]
    inventory = spark.createDataFrame([(p, p.rsplit("/", 1)[-1]) for p in paths], "path string, name string")
    samples = spark.createDataFrame(rows, "index bigint, speaker_id string, target_path string")
    got = {r["index"]: r["path"] for r in resolve_generated(samples, inventory).collect()}
    assert got == sequential(rows, paths)
    assert len(got) == 46
