"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything is a column expression. A conversation becomes one row with its segments (text and
loss flag), the formatted text, and what the state machine found.

Defined results: turns are ordered by (turn, role, text), a null turn number first; repeated rows
stay turns of their own. Null texts and roles count as empty. Rows with a null ``conv_id`` form
one conversation. Unknown roles are formatted like others and are illegal for the state machine.
An empty table gives no rows; columns other than the four named ones are ignored. A conversation
is one value, so Spark's limit of 2 GB a value holds for it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ESCAPE = "\\"
_BREAK, _SELF, _LINE = "c", "b", "n"

#: ``transitions`` maps a state to the roles that may follow and the state they lead to.
CHATML = {
    "open": "<|im_start|>",
    "close": "<|im_end|>",
    "controls": ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"],
    "loss_roles": ["assistant"],
    "start": "start",
    "accept": ["assistant"],
    "transitions": {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"assistant": "assistant"},
    },
}


def check_template(template: dict) -> None:
    """Raise ``ValueError`` unless escaping with this template is reversible and unambiguous."""
    controls = template["controls"]
    if template["open"] not in controls or template["close"] not in controls:
        raise ValueError("the turn marks must be control strings")
    for control in controls:
        if len(control) < 2 or ESCAPE in control or "\n" in control:
            raise ValueError(f"a control string needs two characters, no line break and no {ESCAPE}: {control!r}")
        for other in controls:
            if any(control.endswith(other[:size]) for size in range(1, min(len(control), len(other)))):
                raise ValueError(f"{other!r} may begin inside {control!r}")


def escape(text: Column, template: dict) -> Column:
    """Break every control string inside ``text``; ``unescape`` gives the text back."""
    marked = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + _SELF))
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template["controls"])
    return F.regexp_replace(marked, starts, f"$0\\\\{_BREAK}")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + _BREAK), F.lit("")), F.lit(ESCAPE + _SELF), F.lit(ESCAPE))


def _escape_role(role: Column, template: dict) -> Column:
    return F.replace(escape(role, template), F.lit("\n"), F.lit(ESCAPE + _LINE))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESCAPE + _LINE), F.lit("\n")))


def _walk(turns: Column, template: dict) -> Column:
    """Run the state machine; an illegal turn is noted and the machine goes on from its role."""
    pairs = [(f"{state}>{role}", target) for state, row in template["transitions"].items() for role, target in row.items()]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    begin = F.struct(F.lit(template["start"]).alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("error_turn"))

    def step(at: Column, turn: Column) -> Column:
        target = table[F.concat(at["state"], F.lit(">"), turn["role"])]
        return F.struct(
            F.coalesce(target, turn["role"]).alias("state"),
            (at["seen"] + 1).alias("seen"),
            F.coalesce(at["error_turn"], F.when(target.isNull(), at["seen"])).alias("error_turn"),
        )

    return F.aggregate(turns, begin, step)


def _segments(turn: Column, template: dict) -> Column:
    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    head = F.concat(F.lit(template["open"]), _escape_role(turn["role"], template), F.lit("\n"))
    return F.array(
        segment(head, F.lit(False)),
        segment(escape(turn["text"], template), turn["role"].isin(*template["loss_roles"])),
        segment(F.lit(template["close"] + "\n"), F.lit(False)),
    )


def format_conversations(rows: DataFrame, template: dict = CHATML) -> DataFrame:
    """One row per conversation: ``segments`` (text, loss), ``formatted``, ``valid``, ``complete``, ``error_turn``.

    ``valid``: every turn was allowed; ``complete``: the last state is an accepting one as well;
    ``error_turn``: position of the first illegal turn, else null.
    """
    check_template(template)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.select("conv_id", turn.alias("_turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    walked = grouped.select(
        "conv_id",
        F.flatten(F.transform("_turns", lambda t: _segments(t, template))).alias("segments"),
        _walk(F.col("_turns"), template).alias("_end"),
    )
    return walked.select(
        "conv_id",
        "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        F.col("_end.error_turn").isNull().alias("valid"),
        (F.col("_end.error_turn").isNull() & F.col("_end.state").isin(*template["accept"])).alias("complete"),
        F.col("_end.error_turn").alias("error_turn"),
    )


def read_turns(formatted: Column, template: dict = CHATML) -> Column:
    """The turns (role, text) written in a formatted conversation."""
    parts = F.split(formatted, re.escape(template["open"]), -1)
    tail = len(template["close"]) + 1

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        size = F.length(part) - F.length(role) - 1 - tail
        text = F.substr(part, F.length(role) + 2, size)
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))


def loss_spans(segments: Column) -> Column:
    """(start, length) of the segments under the loss mask, in characters of the formatted text."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        size = F.length(s["text"])
        span = F.struct(acc["at"].alias("start"), size.alias("length"))
        spans = F.when(s["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + size).alias("at"), spans.alias("spans"))

    return F.aggregate(segments, begin, step)["spans"]


def digest(formatted: DataFrame, template: dict = CHATML) -> DataFrame:
    """Counts and digests of formatted conversations, read back from their text and loss mask."""
    read = formatted.select(
        "conv_id", "valid", "complete", "formatted", read_turns(F.col("formatted"), template).alias("_turns"), loss_text(F.col("segments")).alias("_loss")
    )
    said = F.concat_ws("", F.transform("_turns", lambda t: reduce(lambda a, b: F.concat(a, b), [t["role"], F.lit("\n"), t["text"], F.lit("\n")])))
    return read.select(
        "conv_id",
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
        "complete",
    )
