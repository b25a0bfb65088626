import re

import pytest

from timbre.llm.licenses import PHRASES, TEMPLATES, compile_template, matches, parse, scan, words

DDL = "doc_id long, text string, labels string, score int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expression(parts):
    out = ""
    for p in parts:
        if isinstance(p, bytes):
            out += re.escape(p.decode()) + " "
        elif p[0] == "optional":
            out += f"(?:{expression(p[1])})?"
        else:
            out += f"(?:(?:{p[3]}) ){{{p[1]},{p[2]}}}".replace(".+", "[^ ]+")
    return out


TEXTS = [
    "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "the gnu general public license; Apache-License apache license mit license",
    "Licensed under CC BY-NC 4.0. Licensed under cc by 4.0",
    "Licensed under the Apache License, Version 2.0.",
    "licensed under the apache licence version 2.0",
    "MIT\x00License mit license MIT LICENSE\n",
    "this very fine little work is licensed under the gnu general public license version 2",
    "this is licensed under the gnu general public license version 2",
    "this a b c d e is licensed under the gnu general public license version 2",
    None,
    "",
    " .,;",
    "nothing " * 100_000 + "mit license",
    "mit mit license license " * 50,
]


def test_scan(spark):
    docs = [(n, t, "x", 1) for n, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x", 1), (None, TEXTS[0], "x", 1)]
    rows = scan(spark.createDataFrame(docs, DDL)).collect()
    assert len(rows) == len(docs)
    for (doc_id, text, *_), r in zip(sorted(docs, key=str), sorted(rows, key=lambda r: str((r.doc_id, TEXTS[r.doc_id or 0]))), strict=True):
        own = plain_words(text)
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
        base = sorted({label for _, label in places})
        joined = "".join(f"{w} " for w in own)
        found = {label for label, t in TEMPLATES.items() if re.search(r"(?:^|(?<= ))" + expression(parse(t)), joined)}
        assert (r.doc_id, r.n_words, r.n_base) == (doc_id, len(own), len(places))
        assert (r.first_word, r.last_word) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.base_labels == ",".join(base) and r.labels == ",".join(sorted({*base, *found}))
        assert r.score == (1.0 if found else 0.5 if base else 0.0)


def test_words():
    assert [w.decode() for w in words("Éa-b\x7fC_1 ß Ünï".encode())] == plain_words("Éa-b\x7fC_1 ß Ünï")


def accepted(template, text):
    tokens = words(text.encode())
    return [(a, b) for _, a, b in matches([compile_template("t", template)], tokens, b" " + b" ".join(tokens) + b" ")]


def test_regions():
    template = "use of <<beginOptional>>this <<beginOptional>>fine <<endOptional>>software <<endOptional>>by <<var;words=1-3>> is free"
    assert accepted(template, "The use of by ann is free") == [(1, 7)]
    assert accepted(template, "use of this software by a b c is free now") == [(0, 10)]
    assert accepted(template, "use of this fine software by is is free") == [(0, 9)]
    assert accepted(template, "use of fine software by ann is free") == []
    assert accepted(template, "use of by a b c d is free") == []
    assert accepted(template, "use of by ann is not free") == []


def test_expressions_in_replaceable_regions():
    template = "version <<var;words=0-2;match=[0-9]+>> of it"
    assert accepted(template, "version of it, version 2 of it, version 2.0 of it") == [(0, 3), (3, 7), (7, 12)]
    assert accepted(template, "version two of it") == []


def test_longest_stretch():
    assert accepted("a b<<beginOptional>> c d<<endOptional>>", "a b c a b c d") == [(0, 2), (3, 7)]


@pytest.mark.parametrize("bad", ["a <<endOptional>> b", "<<beginOptional>> a", "<<beginOptional>> a <<endOptional>>", "<<var;words=1-2>>"])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        compile_template("t", bad)


def test_every_template_accepts_its_own_wording():
    for label, text in TEMPLATES.items():
        automaton = compile_template(label, text)
        spelled = []

        def spell(parts, full):
            for p in parts:
                if isinstance(p, bytes):
                    spelled.append(p)
                elif p[0] == "var":
                    spelled.extend([b"7"] * (p[2] if full else p[1]))
                elif full:
                    spell(p[1], full)

        for full in (True, False):
            spelled.clear()
            spell(parse(text), full)
            assert automaton.longest(spelled, 0) == len(spelled), label
            broken = [w + b"x" if k == len(spelled) - 2 else w for k, w in enumerate(spelled)]
            assert automaton.longest(broken, 0) != len(broken), label


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], DDL)).collect() == []
