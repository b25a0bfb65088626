import random
import re

import pytest

from timbre.llm import substrings
from timbre.llm.substrings import remove_repeats

DDL = "doc_id long, text string, n_words string, lang string, bucket int"
BIG = 1 << 62


def brute(docs, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", d[1] or "") for d in docs]
    least = {}
    for d, w in zip(docs, words, strict=True):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, BIG), BIG if d[0] is None else d[0])
    out = []
    for d, w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (BIG if d[0] is None else d[0]):
                gone[i : i + window] = [True] * window
        out.append((d[0], " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)))
    return sorted(out, key=str)


def rows(frame):
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in frame.collect()), key=str)


def corpus(seed):
    generator = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["ü", "日本", "a"]
    passage = [generator.choice(vocabulary) for _ in range(60)]
    docs = []
    for n in range(60):
        words = [generator.choice(vocabulary) for _ in range(generator.randrange(0, 80))]
        if n % 3 == 0:
            k = generator.randrange(0, 30)
            words[5:5] = passage[k : k + 25]
        docs.append((n, generator.choice([" ", "\n", " \t "]).join(words), "x", "en", 1))
    docs += [(70, docs[9][1], "x", "en", 1), (71, docs[9][1], "x", "en", 1), (71, docs[9][1], "x", "en", 1)]
    docs += [(80, None, "x", "en", 1), (81, "", "x", "en", 1), (82, "a " * 3_000, "x", "en", 1), (83, "a " * 50, "x", "en", 1)]
    return docs + [(None, docs[9][1], "x", "en", 1), (None, "only here " * 9, "x", "en", 1)]


@pytest.mark.parametrize("seed,window", [(1, 13), (2, 13), (3, 4), (4, 2)])
def test_against_brute_force(spark, monkeypatch, seed, window):
    monkeypatch.setattr(substrings, "MIN_BATCH_BYTES", 3_000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 6_000)
    monkeypatch.setattr(substrings, "_CHUNK_BYTES", 900)
    docs = corpus(seed)
    assert rows(remove_repeats(spark.createDataFrame(docs, DDL), window)) == brute(docs, window)


def test_kept_columns(spark):
    docs = corpus(1)
    left = remove_repeats(spark.createDataFrame(docs, DDL), keep=["doc_id", "n_words", "lang", "bucket"])
    assert left.columns == ["doc_id", "lang", "bucket", "text", "n_words", "n_removed"]
    assert rows(left) == brute(docs, 13)


def test_windows_with_one_hash_are_told_apart(spark, monkeypatch):
    import numpy as np

    plain = substrings._rolled
    monkeypatch.setattr(substrings, "_rolled", lambda hashes, width: plain(hashes, width) if width < 13 else plain(hashes, width) % np.uint64(3))
    docs = corpus(5)
    texts = [" ".join(d[1].split()).encode() for d in docs if d[1] and len(d[1].split()) >= 13]
    least, counts = substrings._least_documents(texts, np.arange(len(texts)), 13)
    first, at = {}, 0
    for n, t in enumerate(texts):
        w = t.split(b" ")
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), n)
    for t, count in zip(texts, counts.tolist(), strict=True):
        w = t.split(b" ")
        assert count == len(w) - 12
        assert least[at : at + count].tolist() == [first[tuple(w[i : i + 13])] for i in range(count)]
        at += count


def test_packed_strings_share_a_minimiser():
    text = " ".join(random.Random(3).choice("abcdefgh") + str(k % 7) for k in range(500)).encode()
    cuts = substrings.cut([text, None, b"too short"], 13)
    windows = sum(s.count(b" ") + 1 - 12 for s in (list(cuts.strings)[n] for n in cuts.number))
    assert windows == 500 - 12 and len(cuts.number) < windows / 2


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], DDL)).collect() == []
