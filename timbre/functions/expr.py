"""Small column helpers used by every operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# Whitespace as the regex engine of the original data producers sees it.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(col(value), F.lit(""))


def first_truthy(*values: Column | str) -> Column:
    """First value that is neither NULL nor empty; NULL when all are."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def first_truthy_or_blank(*values: Column | str) -> Column:
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(""))


def strip(value: Column | str) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(col(value), f"^{SPACE}+|{SPACE}+$", "")


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def stem(path: Column | str) -> Column:
    """File name without its last suffix; dot-files and trailing dots stay whole."""
    return F.regexp_replace(basename(path), r"(?s)^(.+)\.[^.]+$", "$1")


def suffix(path: Column | str) -> Column:
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1)


def parent_dir(path: Column | str) -> Column:
    """Everything before the last slash, or an empty string."""
    return F.when(
        F.instr(col(path), "/") > 0, F.regexp_replace(col(path), r"(?s)/[^/]*$", "")
    ).otherwise(F.lit(""))


def parent_name(path: Column | str) -> Column:
    return basename(parent_dir(path))


def path_order(path: Column | str) -> Column:
    """Sort key that orders paths component by component."""
    return F.translate(col(path), "/", "\u0001")


def pick(condition_values: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """CASE WHEN over (condition, value) pairs."""
    head, *tail = condition_values
    expr = reduce(lambda acc, cv: acc.when(*cv), tail, F.when(*head))
    return expr if default is None else expr.otherwise(default)


def literal_map(mapping: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def unit_hash(value: Column | str) -> Column:
    """Reproducible number in [0, 2^32) from the first 8 hex digits of an md5."""
    return F.conv(F.substring(F.md5(col(value).cast("string")), 1, 8), 16, 10).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    An expression that occurs inside a higher-order function is evaluated again for every array
    element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def float_text(value: Column | str) -> Column:
    """A double as Python writes it: plain from 1e-4 up to below 1e16, else with a signed exponent."""

    def shortest(v: Column) -> Column:
        # the platform's text may hold a digit or two more than are needed
        java, tries = v.cast("string"), [F.upper(F.format_string(f"%.{n}e", v)) for n in (14, 15)]
        long = F.length(F.regexp_replace(java, "E.*|[.-]", "")) > 15
        same = [F.when(long & (t.try_cast("double") == v), t) for t in tries]
        return F.coalesce(*same, java)

    def parts(java: Column) -> Column:
        mantissa = F.ltrim(F.substring_index(java, "E", 1), F.lit("-"))
        return F.struct(
            java.alias("java"),
            F.when(java.startswith("-"), "-").otherwise("").alias("sign"),
            F.rtrim(F.replace(mantissa, F.lit(".")), F.lit("0")).alias("digits"),
            F.when(F.contains(java, F.lit("E")), F.regexp_extract(java, r"E\+?(-?\d+)$", 1)).try_cast("int").alias("exponent"),
        )

    def spelled(p: Column) -> Column:
        digits, exponent = p["digits"], p["exponent"]
        rest = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
        power = F.format_string("%s%02d", F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent))
        text = (
            F.when((exponent >= 16) | (exponent < -4), F.concat(F.left(digits, F.lit(1)), rest, F.lit("e"), power))
            .when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
            .when(F.length(digits) <= exponent + 1, F.concat(F.rpad(digits, exponent + 1, "0"), F.lit(".0")))
            .otherwise(F.concat(F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2)))
        )
        odd = F.create_map(*[F.lit(x) for x in ("NaN", "nan", "Infinity", "inf", "-Infinity", "-inf")])
        return F.when(exponent.isNull(), F.coalesce(odd[p["java"]], p["java"])).otherwise(F.concat(p["sign"], text))

    return let(let(let(col(value).cast("double"), shortest), parts), spelled)
