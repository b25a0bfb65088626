"""URL filters: host rules and patterns, indexed by their rarest literal token.

A host rule (`example.org/en/`) fits its host and all subdomains if the path starts with the rule's; of
the rules that fit, the longest decides. A pattern is matched against the whole URL, A-Z alike: `*` stands
for any run of characters, `^` for one character that can't be part of a token, or for an end of the URL.
Patterns judge what no host rule decides, block before allow; what neither decides is allowed.

Every rule becomes one regular expression, and is filed under one token (a run of `[a-z0-9]`) that each URL it
fits must hold: of its tokens that stand between other literal characters the one that the fewest URLs
hold. Those counts come from a pass over all URLs and change the cost, never the verdicts. The tokens of
a URL fetch the rules filed under them, and only these run their expression; rules without a sure token
are tried on every URL. Rules are given by the caller and travel with the tasks; nothing is shuffled.

Defined results: a null URL, or one without `://`, has an empty host and path and is judged by patterns
alone (null: as an empty text); repeated rows give a row each; an empty table gives no rows; other columns
are kept, unless they have the name of a result. Of equally long rules the first in text order decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ALLOW, BLOCK = "allow", "block"
_TOKEN = re.compile(r"[a-z0-9]+")
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path), both empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = _HOST.match(rest).group()
    return host.translate(_LOWER), _PATH.match(rest, len(host)).group()


@dataclass(frozen=True)
class Rule:
    """``text`` is a host rule, or with ``pattern`` a pattern over the whole URL."""

    verdict: str
    text: str
    pattern: bool = False

    def regex(self) -> re.Pattern[str]:
        """Host rules match the host with the path, patterns the whole lower-cased URL."""
        if self.pattern:
            parts = {"*": ".*", "^": r"(?:[^a-z0-9]|\A|\Z)"}
            return re.compile("".join(parts.get(c) or re.escape(c) for c in self.text.translate(_LOWER)), re.DOTALL)
        host, slash, path = self.text.partition("/")
        # a host holds no slash, so the first one ends it
        return re.compile(r"\A(?:[^/]*\.)?" + re.escape(host.translate(_LOWER)) + (re.escape(slash + path) if slash else r"(?:/|\Z)"), re.DOTALL)

    def tokens(self) -> set[str]:
        """Tokens that every URL which the rule fits holds whole."""
        text = self.text.translate(_LOWER)
        found = set()
        for token in _TOKEN.finditer(text):
            before, after = text[: token.start()][-1:], text[token.end() :][:1]
            if self.pattern:
                sure = before not in ("", "*") and after not in ("", "*")
            else:  # in front of a host there is a dot or nothing; a path may go on
                sure = after != "" or "/" not in text
            if sure:
                found.add(token.group())
        return found


class RuleIndex:
    """Rules by their rarest token, for the tasks."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int] | None = None) -> None:
        counts = counts or {}
        self.filed: dict[str, list[tuple[Rule, re.Pattern[str]]]] = {}
        self.always: list[tuple[Rule, re.Pattern[str]]] = []
        for rule in dict.fromkeys(rules):
            rarest = min(rule.tokens(), key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
            (self.always if rarest is None else self.filed.setdefault(rarest, [])).append((rule, rule.regex()))

    def fitting(self, url: str, place: str, tokens: Iterable[str]) -> Iterator[Rule]:
        lowered = url.translate(_LOWER)
        for rules in (self.always, *(self.filed[t] for t in tokens if t in self.filed)):
            for rule, regex in rules:
                if regex.search(lowered if rule.pattern else place):
                    yield rule

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """(host, path, rule or null, verdict)."""
        host, path = split_url(url)
        fitting = list(self.fitting(url or "", host + path, url_tokens(url)))
        held = min((r for r in fitting if not r.pattern and host), key=lambda r: (-len(r.text), r.text, r.verdict), default=None)
        if held:
            return host, path, held.text, held.verdict
        verdicts = {r.verdict for r in fitting if r.pattern}
        return host, path, None, BLOCK if BLOCK in verdicts else ALLOW


def url_tokens(url: str | None) -> set[str]:
    return set(_TOKEN.findall((url or "").translate(_LOWER)))


def token_counts(pages: DataFrame, url: str, vocabulary: Iterable[str]) -> dict[str, int]:
    """In how many rows each token of the rules stands; the driver gets one row a token of the rules."""
    wanted = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(wanted & url_tokens(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    counted = pages.select(F.col(url).cast("string")).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``pages`` with (host, path, rule, verdict) of each row."""
    index = RuleIndex(rules, token_counts(pages, url, {t for r in rules for t in r.tokens()}))
    results = ("host", "path", "rule", "verdict")
    rest = [c for c in pages.columns if c.lower() not in results]
    held = pages.select(*[F.col(f"`{c}`") for c in rest])
    # a batch function can't be given names with dots
    kept = pages.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(rest)], F.col(f"`{url}`").cast("string").alias("__url"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [index.judge(u.as_py()) for u in batch.column(batch.num_columns - 1)]
            columns = [pa.array([j[k] for j in judged], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*rest, *results])

    schema = held.schema
    for name in results:
        schema = schema.add(name, "string")
    return kept.mapInArrow(judge, schema)
