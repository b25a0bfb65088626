"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is wording with two marks: ``<<beginOptional>> ... <<endOptional>>`` holds words that
may be missing, ``<<var;words=1-12;match=...>>`` stands for that many words, each matching the
expression. An automaton reads words and accepts a stretch of the text if all mandatory wording is
there exactly. Stretches may begin anywhere in the text; the longest one from a place counts.

Defined results: A-Z are lower-cased and everything in ASCII but letters and digits separates
words; null and wordless texts have no words, no labels and score 0; repeated rows give a row each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Phrases with their labels, and wordings of public licences and of their notices.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_WORK = "<<beginOptional>>this <<var;words=1-4>> is <<endOptional>>"
_UNDER = "<<beginOptional>>licensed <<endOptional>><<beginOptional>>released <<endOptional>>under the "
_COPYRIGHT = "<<beginOptional>>copyright <<var;words=1-20>> <<endOptional>>"
_AS_IS = "the software is provided as is "
TEMPLATES = {
    "gpl-3.0": _WORK + "licensed under the gnu general public license version 3",
    "gpl-2.0": _WORK + "licensed under the gnu general public license version 2",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation either version <<var;words=1-1;match=[0-9]+>> of the license or at your option any later version",
    "apache-2.0": _WORK + "licensed under the apache license version 2 0",
    "mit-notice": _WORK + _UNDER + "mit license",
    "cc-by-nc-4.0": _WORK + "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>cc by nc <<beginOptional>>4 0<<endOptional>>",
    "cc-by-4.0": _WORK + "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>cc by 4 0",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "<<beginOptional>>the software <<endOptional>>to deal in the software without restriction including without limitation the rights to use copy "
    "modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph "
    "<<endOptional>>shall be included in all copies or substantial portions of the software " + _AS_IS + "without warranty of any kind",
    "isc-text": _COPYRIGHT + "permission to use copy modify and <<beginOptional>>or <<endOptional>>distribute this software for any purpose with or "
    "without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<beginOptional>>1 <<endOptional>>redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<beginOptional>>2 <<endOptional>>redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution",
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var(?:;[^>]*)?)>>")
_ANY = r".+"
_TABLE = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


@dataclass
class Automaton:
    """States are numbers; ``moves`` hold (word or expression, next state), ``free`` moves without a word."""

    label: str
    moves: list[list[tuple[bytes | re.Pattern, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    accept: int = 0
    anchor: bytes = b""
    closures: dict[int, frozenset[int]] = field(default_factory=dict)
    steps: dict[tuple[frozenset[int], bytes], frozenset[int]] = field(default_factory=dict)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def closure(self, state: int) -> frozenset[int]:
        if state not in self.closures:
            seen, todo = {state}, [state]
            while todo:
                todo += (new := set(self.free[todo.pop()]) - seen)
                seen |= new
            self.closures[state] = frozenset(seen)
        return self.closures[state]

    def step(self, at: frozenset[int], word: bytes) -> frozenset[int]:
        """The states after ``word``; remembered, so that texts run on a deterministic automaton."""
        found = self.steps.get((at, word))
        if found is None:
            found = frozenset(
                s for state in at for sign, target in self.moves[state]
                if (sign == word if isinstance(sign, bytes) else sign.fullmatch(word)) for s in self.closure(target)
            )
            if len(self.steps) < 100_000:
                self.steps[at, word] = found
        return found

    def longest(self, tokens: list[bytes], begin: int) -> int | None:
        """End of the longest accepted stretch that begins at ``begin``."""
        at, end, place = self.closure(0), None, begin
        while at and place < len(tokens):
            at = self.step(at, tokens[place])
            place += 1
            if self.accept in at:
                end = place
        return end


def parse(template: str) -> list:
    """Words, ('var', least, most, expression) and ('optional', parts), nested."""
    stack: list[list] = [[]]
    for n, part in enumerate(_MARK.split(template)):
        if n % 2 == 0:
            stack[-1] += [w for w in words(part.encode())]
        elif part == "beginOptional":
            stack.append([])
        elif part == "endOptional":
            inner = stack.pop()
            if not stack:
                raise ValueError("endOptional without beginOptional")
            stack[-1].append(("optional", inner))
        else:
            options = dict(o.split("=", 1) for o in part.split(";")[1:])
            least, _, most = options.get("words", "1-1").partition("-")
            stack[-1].append(("var", int(least), int(most or least), options.get("match", _ANY)))
    if len(stack) != 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


def compile_template(label: str, template: str) -> Automaton:
    automaton = Automaton(label)
    runs: list[list[bytes]] = [[]]

    def chain(parts: list, at: int, mandatory: bool) -> int:
        for part in parts:
            if isinstance(part, bytes):
                after = automaton.state()
                automaton.moves[at].append((part, after))
                if mandatory:
                    runs[-1].append(part)
            elif part[0] == "optional":
                runs.append([])
                after = chain(part[1], at, False)
                automaton.free[at].append(after)
            else:
                runs.append([])
                sign = re.compile(part[3].encode())
                ends, after = [at] if part[1] == 0 else [], at
                for n in range(1, part[2] + 1):
                    before, after = after, automaton.state()
                    automaton.moves[before].append((sign, after))
                    if n >= part[1]:
                        ends.append(after)
                for end in ends:
                    if end != after:
                        automaton.free[end].append(after)
            at = after
        return at

    automaton.accept = chain(parse(template), automaton.state(), True)
    longest = max(runs, key=lambda r: sum(map(len, r)))
    if not longest:
        raise ValueError("a template needs mandatory wording")
    automaton.anchor = b" " + b" ".join(longest) + b" "
    return automaton


def matches(automata: list[Automaton], tokens: list[bytes], joined: bytes) -> list[tuple[str, int, int]]:
    """(label, first word, word after the last) of accepted stretches; only one from each place and automaton."""
    found = []
    for automaton in automata:
        if automaton.anchor not in joined:  # mandatory wording is missing
            continue
        start = automaton.closure(0)
        opening: dict[bytes, bool] = {}
        for begin, word in enumerate(tokens):
            if word not in opening:
                opening[word] = bool(automaton.step(start, word))
            if opening[word]:
                end = automaton.longest(tokens, begin)
                if end is not None:
                    found.append((automaton.label, begin, end))
    return found


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Words before each place of ``phrase``; ``joined`` has one space before and after each word."""
    found, at, counted, before = [], joined.find(phrase), 0, 0
    while at >= 0:
        before += joined.count(b" ", counted, at + 1)
        counted = at + 1
        found.append(before - 1)
        at = joined.find(phrase, at + 1)
    return found


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, places of the phrases (``n_base``, ``first_word``, ``last_word``),
    ``base_labels``, ``labels`` (templates' too), ``score`` (1 a template, 0.5 only a phrase, else 0) and ``spans``
    (label, first, after) of the accepted stretches."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [compile_template(label, text) for label, text in templates.items()]
        wanted = [(b" " + phrase.encode() + b" ", label) for phrase, label in phrases.items()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = words(text.as_py())
                joined = b" " + b" ".join(tokens) + b" "
                places, base = [], set()
                for phrase, label in wanted:
                    here = _places(joined, phrase)
                    if here:
                        base.add(label)
                        places += here
                spans = matches(automata, tokens, joined)
                labels = base | {s[0] for s in spans}
                rows.append(
                    (doc_id, len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)))
                    + (1.0 if spans else 0.5 if base else 0.0, [{"label": a, "first": b, "after": c} for a, b, c in spans])
                )
            span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64())])
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(span)]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ddl = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first:long,after:long>>"
    )
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(read, ddl)
