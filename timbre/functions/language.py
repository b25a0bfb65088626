"""Language names and the choice of a language per request."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from timbre.functions.expr import blank_to_null, col, literal_map, strip

# --- fixed values ------------------------------------------------------------
LANGUAGE_NAMES = {
    "auto": "Auto",
    "zh": "Chinese",
    "zh-cn": "Chinese",
    "zh-tw": "Chinese",
    "cn": "Chinese",
    "en": "English",
    "fr": "French",
    "de": "German",
    "es": "Spanish",
    "it": "Italian",
    "ja": "Japanese",
    "jp": "Japanese",
    "ko": "Korean",
    "kr": "Korean",
    "pt": "Portuguese",
    "ru": "Russian",
}
LANGUAGE_CODES = {
    "ar": "ar",
    "arabic": "ar",
    "cs": "cs",
    "czech": "cs",
    "de": "de",
    "german": "de",
    "en": "en",
    "english": "en",
    "es": "es",
    "spanish": "es",
    "fr": "fr",
    "french": "fr",
    "hi": "hi",
    "hindi": "hi",
    "hu": "hu",
    "hungarian": "hu",
    "it": "it",
    "italian": "it",
    "ja": "ja",
    "jp": "ja",
    "japanese": "ja",
    "ko": "ko",
    "kr": "ko",
    "korean": "ko",
    "nl": "nl",
    "dutch": "nl",
    "pl": "pl",
    "polish": "pl",
    "pt": "pt",
    "portuguese": "pt",
    "pt-br": "pt",
    "ru": "ru",
    "russian": "ru",
    "tr": "tr",
    "turkish": "tr",
    "zh": "zh-cn",
    "zh-cn": "zh-cn",
    "zh-tw": "zh-cn",
    "cn": "zh-cn",
    "chinese": "zh-cn",
}
# -----------------------------------------------------------------------------

LANGUAGE_TABLES = {"names": LANGUAGE_NAMES, "codes": LANGUAGE_CODES}


def normalize_language(value: Column | str, table: str = "names") -> Column:
    """Alias lookup without case; unknown tokens stay, blank ones become NULL."""
    token = blank_to_null(strip(value))
    return F.coalesce(F.element_at(literal_map(LANGUAGE_TABLES[table]), F.lower(token)), token)


def select_language(
    target: Column | str,
    prompt: Column | str,
    source: str = "target",
    default: str | None = "Auto",
    table: str = "names",
) -> Column:
    """Preferred side, then target, then prompt, then the default, normalised.

    With the ``names`` table a side that is only whitespace still counts as given (and ends as
    NULL); with the ``codes`` table every candidate must survive normalisation.
    """
    sides = {"target": col(target), "prompt": col(prompt)}
    order = [sides[source]] if source in sides else []
    order += [sides["target"], sides["prompt"]]
    if table == "codes":
        candidates = [normalize_language(c, table) for c in order]
        return F.coalesce(*candidates, normalize_language(F.lit(default), table), F.lit("en"))
    given = F.coalesce(*[blank_to_null(c) for c in order])
    return F.when(given.isNotNull(), normalize_language(given, table)).otherwise(
        normalize_language(F.lit(default), table)
    )
