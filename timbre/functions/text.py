"""Text normalisation, tokenisation and transcript helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from timbre.functions.expr import SPACE, col, literal_map, stem, strip, suffix
from timbre.operators.ordering import spread

# --- fixed values ------------------------------------------------------------
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

CJK_BASIC = r"\x{4e00}-\x{9fff}"
CJK_WIDE = (
    r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}"
    r"\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}\x{f900}-\x{faff}\x{2f800}-\x{2fa1f}"
)

ZH_PUNCTUATION = {
    "，": ", ",
    "。": ".",
    "：": ":",
    "；": ";",
    "？": "?",
    "！": "!",
    "（": "(",
    "）": ")",
    "【": "[",
    "】": "]",
    "《": "<",
    "》": ">",
    "“": '"',
    "”": '"',
    "‘": "'",
    "’": "'",
    "、": ",",
    "—": "-",
    "…": "...",
    "·": ".",
    "「": '"',
    "」": '"',
    "『": '"',
    "』": '"',
}

# Punctuation of the phoneme front ends, English and Japanese.
SPEECH_PUNCTUATION = {
    "：": ",",
    "；": ",",
    "，": ",",
    "。": ".",
    "！": "!",
    "？": "?",
    "\n": ".",
    "．": ".",
    "…": "...",
    "···": "...",
    "・・・": "...",
    "·": ",",
    "・": ",",
    "、": ",",
    "$": ".",
    "“": "'",
    "”": "'",
    '"': "'",
    "‘": "'",
    "’": "'",
    "（": "'",
    "）": "'",
    "(": "'",
    ")": "'",
    "《": "'",
    "》": "'",
    "【": "'",
    "】": "'",
    "[": "'",
    "]": "'",
    "—": "-",
    "−": "-",
    "～": "-",
    "~": "-",
    "「": "'",
    "」": "'",
}
# The same for Chinese.
SPEECH_PUNCTUATION_ZH = {
    "：": ",",
    "；": ",",
    "，": ",",
    "。": ".",
    "！": "!",
    "？": "?",
    "\n": ".",
    "·": ",",
    "、": ",",
    "...": "…",
    "$": ".",
    "“": "'",
    "”": "'",
    '"': "'",
    "‘": "'",
    "’": "'",
    "（": "'",
    "）": "'",
    "(": "'",
    ")": "'",
    "《": "'",
    "》": "'",
    "【": "'",
    "】": "'",
    "[": "'",
    "]": "'",
    "—": "-",
    "～": "-",
    "~": "-",
    "「": "'",
    "」": "'",
}
# Repair of single phones.
PHONE_REPAIRS = {
    "：": ",",
    "；": ",",
    "，": ",",
    "。": ".",
    "！": "!",
    "？": "?",
    "\n": ".",
    "·": ",",
    "、": ",",
    "…": "...",
    "···": "...",
    "・・・": "...",
    "v": "V",
}
SPEECH_SYMBOLS = ["!", "?", "…", ",", ".", "'", "-"]
ZH_INTERJECTIONS = {"嗯": "恩", "呣": "母"}
ZH_KEEP = r"\x{4e00}-\x{9fa5}"
JP_KEEP = r"\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3005}"
LETTER_PHONE_TONE = 3
#: Tokens of a chunk of texts, which share their look-ups; a text is not cut.
_TOKENS = 65_536
#: Chunks of a task are numbered from its partition shifted by this.
_CHUNK_SHIFT = 33
# -----------------------------------------------------------------------------


def norm_en_delete(text: Column | str) -> Column:
    """Drop ASCII punctuation, lower-case."""
    return F.lower(F.translate(col(text), ASCII_PUNCTUATION, ""))


def norm_en_space(text: Column | str) -> Column:
    """ASCII punctuation to blanks, collapse whitespace, trim, lower-case."""
    spaced = F.translate(col(text), ASCII_PUNCTUATION, " " * len(ASCII_PUNCTUATION))
    return F.lower(strip(F.regexp_replace(spaced, f"{SPACE}+", " ")))


def contains_cjk(text: Column | str, wide: bool = False) -> Column:
    return F.coalesce(col(text).rlike(f"[{CJK_WIDE if wide else CJK_BASIC}]"), F.lit(False))


def to_simplified(text: Column | str, table: dict[str, str] | None = None) -> Column:
    """Character conversion by a user-supplied table; unchanged without one."""
    if not table:
        return col(text)
    return F.translate(col(text), "".join(table), "".join(table.values()))


def norm_zh(text: Column | str, table: dict[str, str] | None = None) -> Column:
    """Simplify, drop punctuation, collapse blanks, close gaps between CJK characters."""
    single = {k: v for k, v in ZH_PUNCTUATION.items() if len(v) == 1}
    out = to_simplified(F.coalesce(col(text), F.lit("")), table)
    for mark, plain in ZH_PUNCTUATION.items():
        if mark not in single:
            out = F.replace(out, F.lit(mark), F.lit(plain))
    out = F.translate(out, "".join(single), "".join(single.values()))
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}_{SPACE[1:-1]}{CJK_BASIC}]", "")
    out = strip(F.regexp_replace(out, f"{SPACE}+", " "))
    return F.regexp_replace(out, f"(?<=[{CJK_BASIC}]){SPACE}+(?=[{CJK_BASIC}])", "")


def words(text: Column | str) -> Column:
    """Tokens as the error-rate metric sees them: whitespace runs become one blank, then a
    split on blanks, so a lone line break stays inside its token."""
    joined = strip(F.regexp_replace(col(text), f"{SPACE}{SPACE}+", " "))
    return F.filter(F.split(joined, " "), lambda w: w != "")


def zh_words(text: Column | str) -> Column:
    """Default segmentation: one token per CJK character, other runs stay whole."""
    pattern = f"[{CJK_BASIC}]|[^{SPACE[1:-1]}{CJK_BASIC}]+"
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))


def wer_tokens(
    text: Column | str,
    reference: Column | str,
    detected_language: Column | None = None,
    segmented: Column | None = None,
    table: dict[str, str] | None = None,
) -> Column:
    """Token array of ``text``; the route depends on the reference side of the pair."""
    chinese = contains_cjk(reference)
    if detected_language is not None:
        chinese = chinese | F.coalesce(detected_language == "zh", F.lit(False))
    zh = zh_words(norm_zh(text, table))
    if segmented is not None:
        zh = F.coalesce(segmented, zh)
    return F.when(chinese, zh).otherwise(words(norm_en_delete(text)))


def rewrite_matches(text: Column, pattern: str, rewrite) -> Column:
    """Replace every match of ``pattern`` (group 1) by ``rewrite(match)``."""
    pieces = F.split(text, pattern, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), rewrite)
    return F.array_join(
        F.zip_with(pieces, found, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""
    )


def _spell_dollars(match: Column) -> Column:
    parts = F.split(match, r"\.", -1)
    dollars = F.coalesce(F.try_element_at(parts, F.lit(1)).try_cast("bigint"), F.lit(0))
    cents = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("bigint"), F.lit(0))

    def amount(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))

    return (
        F.when(F.size(parts) > 2, F.concat(match, F.lit(" dollars")))
        .when((dollars != 0) & (cents != 0), F.concat_ws(", ", amount(dollars, "dollar"), amount(cents, "cent")))
        .when(dollars != 0, amount(dollars, "dollar"))
        .when(cents != 0, amount(cents, "cent"))
        .otherwise(F.lit("zero dollars"))
    )


def en_numbers_regex(text: Column | str) -> Column:
    """Regex part of English number normalisation; spelling out of numbers is not included."""
    out = rewrite_matches(col(text), r"([0-9][0-9\,]+[0-9])", lambda m: F.replace(m, F.lit(","), F.lit("")))
    out = F.regexp_replace(out, r"£([0-9\,]*[0-9]+)", "$1 pounds")
    out = rewrite_matches(out, r"\$([0-9\.\,]*[0-9]+)", _spell_dollars)
    out = F.regexp_replace(out, r"([0-9]+)\.([0-9]+)", "$1 point $2")
    out = map_punctuation(out, "EN")
    return F.regexp_replace(out, r"([,;.\?\!])([\p{L}\p{N}_])", "$1 $2")


def map_punctuation(text: Column | str, language: str) -> Column:
    """Punctuation of a speech front end; ZH and JP also keep only their own script."""
    out = col(text)
    if language == "ZH":
        out = F.translate(out, "".join(ZH_INTERJECTIONS), "".join(ZH_INTERJECTIONS.values()))
    table = SPEECH_PUNCTUATION_ZH if language == "ZH" else SPEECH_PUNCTUATION
    single = {mark: plain for mark, plain in table.items() if len(mark) == len(plain) == 1}
    # runs first and longest first, so that their characters are not mapped one by one
    for run in sorted(table.keys() - single.keys(), key=len, reverse=True):
        out = F.replace(out, F.lit(run), F.lit(table[run]))
    out = F.translate(out, "".join(single), "".join(single.values()))
    if language == "EN":
        return out
    keep = ZH_KEEP if language == "ZH" else JP_KEEP
    return F.regexp_replace(out, f"[^{keep}{''.join(SPEECH_SYMBOLS)}]+", "")


def refine_phone(phone: Column) -> Column:
    """Phone with a stress digit -> struct(lower-case phone, tone)."""
    stressed = phone.rlike(r"\d$")
    return F.struct(
        F.lower(F.regexp_replace(phone, r"\d$", "")).alias("phone"),
        F.when(stressed, F.regexp_extract(phone, r"(\d)$", 1).cast("int") + 1)
        .otherwise(F.lit(LETTER_PHONE_TONE))
        .alias("tone"),
    )


def repair_symbol(phone: Column, symbols: list[str]) -> Column:
    """Map a phone into the symbol set: punctuation map, ``v`` -> ``V``, unknown -> ``UNK``."""
    mapped = F.coalesce(F.element_at(literal_map(PHONE_REPAIRS), phone), phone)
    return F.when(mapped.isin(symbols), mapped).otherwise(F.lit("UNK"))


def distribute_phones(n_phones: Column | str, n_words: Column | str) -> Column:
    """Phones per word: an even split, the remainder goes to the first words."""
    phones, n = col(n_phones).cast("int"), col(n_words).cast("int")
    return F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.floor(phones / n).cast("int") + F.when(i < phones % n, 1).otherwise(0),
        ),
    ).otherwise(F.array().cast("array<int>"))


def lexicon_phonemes(df: DataFrame, key: str, text: str, lexicon: DataFrame, symbols: list[str]) -> DataFrame:
    """Phonemes, tones and word2ph of every text through a lexicon ``(word, phones)``.

    Words are looked up in upper case; words outside the lexicon are counted in ``oov`` and
    contribute no phones. Texts go in chunks: only the distinct words of a chunk meet the lexicon, and its tokens,
    kept as numbers of these words, take in place what is found. Every row is a text, whatever its ``key``.
    """
    marks = "".join("\\" + s for s in SPEECH_SYMBOLS if s != "'")
    tokens = F.regexp_extract_all(F.col(text), F.lit(rf"[\p{{L}}\p{{N}}']+|[{marks}]"), F.lit(0))
    # shuffled rows come in any order: sorted, a task that runs again cuts the same chunks
    ordered = df.select(key, text).sortWithinPartitions(key, text)
    chunks = ordered.select(key, tokens.alias("_tokens")).mapInArrow(_in_chunks, "_chunk long, _at int, _word string, _texts binary")
    refined = lexicon.select("word", F.transform("phones", refine_phone).alias("_spoken"))
    entries = refined.select(
        F.col("word").alias("_entry"),
        F.array_join(F.transform("_spoken", lambda p: repair_symbol(p["phone"], symbols)), " ").alias("_phones"),
        F.array_join(F.transform("_spoken", lambda p: p["tone"].cast("string")), " ").alias("_tones"),
        F.size("_spoken").alias("_n"),
    )
    looked = chunks.join(entries, F.upper("_word") == F.col("_entry"), "left").filter("_entry IS NOT NULL OR _texts IS NOT NULL")
    kept = T.StructType([df.schema[key], *T._parse_datatype_string("phones array<string>, tones array<int>, word2ph array<int>, oov long")])
    spoken_marks = [_repaired(m, symbols) for m in SPEECH_SYMBOLS]

    def read(chunk: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(_in_place(chunk, spoken_marks), kept.names)

    # words and marks are few bytes for what they become: partitions are not merged by their bytes
    return spread(looked.drop("_word", "_entry"), "_chunk").groupBy("_chunk").applyInArrow(read, kept)


def _repaired(phone: str, symbols: list[str]) -> str:
    mapped = PHONE_REPAIRS.get(phone, phone)
    return mapped if mapped in symbols else "UNK"


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chunks of texts: first one with the keys and numbered tokens of all its texts, then one for each distinct word.

    The first numbers are those of the marks, which need no look-up. The first row has a word of its own, which
    no text can have, for a join on words would bring all rows without a word to one task.
    """
    chunk = TaskContext.get().partitionId() << _CHUNK_SHIFT
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // _TOKENS, prepend=-1))
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            flat = batch.column(1).slice(start, end - start).flatten()
            coded = pa.concat_arrays([pa.array(SPEECH_SYMBOLS, flat.type), flat]).dictionary_encode()
            numbers = coded.indices.slice(len(SPEECH_SYMBOLS)).cast(pa.from_numpy_dtype(np.min_scalar_type(len(coded.dictionary))))
            codes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[start:end])), pa.int32()), numbers)
            texts = pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), codes], ["key", "codes"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts.schema) as stream:
                stream.write_batch(texts)
            words = coded.dictionary.slice(len(SPEECH_SYMBOLS))
            rows = {
                "_chunk": pa.array(np.full(len(words) + 1, chunk)),
                "_at": pa.array(np.append(-1, np.arange(len(words)) + len(SPEECH_SYMBOLS)), pa.int32()),
                "_word": pa.concat_arrays([pa.array([f"\0{chunk}"], words.type), words]),
                "_texts": pa.concat_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(len(words), pa.binary())]),
            }
            yield pa.RecordBatch.from_pydict(rows)
            chunk += 1


def _in_place(chunk: pa.Table, marks: list[str]) -> list[pa.Array]:
    """The key, phones, tones, counts and number of unknown words of each text of a chunk, an edge before and behind it."""
    first = chunk.column("_at").to_numpy() < 0
    texts = pa.ipc.open_stream(chunk.filter(pa.array(first)).column("_texts")[0].as_buffer()).read_next_batch()
    found = chunk.filter(pa.array(~first))
    codes = texts.column("codes")
    words = found.column("_at").to_numpy()
    if len(np.unique(words)) < len(words):
        raise ValueError("a word comes twice in the lexicon")

    # spellings: the edge, the marks, what was found, nothing
    n_own, unknown = len(marks) + 1, len(marks) + 1 + len(words)
    numbers = codes.flatten().to_numpy(zero_copy_only=False)
    spelling = np.full(max(int(numbers.max(initial=0)) + 1, len(marks)), unknown)
    spelling[: len(marks)] = np.arange(1, n_own)
    spelling[words] = np.arange(n_own, unknown)
    ends = np.append(0, np.cumsum(codes.value_lengths().to_numpy().astype(np.int64) + 2))
    at = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(at), bool)
    inside[ends[:-1]] = inside[ends[1:] - 1] = False
    at[inside] = spelling[numbers]

    def lists(values: pa.Array, cuts: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)

    def taken(own: list, column: str, kind: pa.DataType) -> pa.ListArray:
        joined = pa.concat_arrays([c.cast(pa.string()) for c in found.column(column).chunks] or [pa.array([], pa.string())])
        spelled = pc.split_pattern(pc.if_else(pc.equal(joined, ""), None, joined), " ")
        sizes = np.concatenate([np.ones(n_own, np.int64), pc.fill_null(pc.list_value_length(spelled), 0).to_numpy(), [0]])
        each = lists(pa.concat_arrays([pa.array(own, kind), spelled.flatten().cast(kind)]), np.append(0, np.cumsum(sizes)))
        return lists(each.take(pa.array(at)).flatten(), np.append(0, np.cumsum(sizes[at]))[ends])

    counts = pa.concat_arrays([pa.array([1] * n_own, pa.int32()), *found.column("_n").chunks, pa.array([0], pa.int32())])
    missing = np.append(0, np.cumsum(at == unknown))
    return [
        texts.column("key"),
        taken(["_", *marks], "_phones", pa.string()),
        taken([0] * n_own, "_tones", pa.int32()),
        lists(counts.take(pa.array(at)), ends),
        pa.array(missing[ends[1:]] - missing[ends[:-1]], pa.int64()),
    ]


def sanitize(value: Column | str, kind: str) -> Column:
    """``speaker`` keeps dots, ``clone`` keeps plus signs, ``legacy`` keeps neither."""
    allowed = {
        "speaker": r"[^0-9A-Za-z_.-]",
        "clone": r"[^0-9A-Za-z_+\-]",
        "legacy": r"[^a-zA-Z0-9_-]",
    }[kind]
    return F.regexp_replace(col(value), allowed, "_")


def speaker_slug(value: Column | str) -> Column:
    """Folder name of a speaker; ``unknown`` when blank."""
    slug = sanitize(strip(F.coalesce(col(value), F.lit(""))), "speaker")
    return F.when(slug == "", F.lit("unknown")).otherwise(slug)


def duration_tag(seconds: Column | str) -> Column:
    """Six significant digits without trailing zeros, the decimal point written as ``p``."""
    value = col(seconds).cast("double")
    # scientific digits carry the rounding, so the exponent is taken from them; a decimal cast drops it
    rounded = F.format_string("%.5e", value)
    exponent = F.regexp_extract(rounded, r"e([+-]\d+)$", 1).try_cast("int")
    plain = F.regexp_replace(rounded.try_cast("double").try_cast("decimal(30,12)").cast("string"), r"\.?0+$", "")
    scientific = F.regexp_replace(rounded, r"\.?0*e", "e")
    text = (
        F.when(value == 0, F.lit("0"))
        .when((exponent < -4) | (exponent >= 6), scientific)
        .otherwise(plain)
    )
    return F.coalesce(F.replace(text, F.lit("."), F.lit("p")), F.lit("unknown"))


def trim_name(path: Column | str, seconds: Column | str) -> Column:
    """Name of the capped copy: ``<stem>_cap<tag>_<md5 prefix><suffix>``."""
    digest = F.substring(F.md5(col(path)), 1, 8)
    return F.concat(stem(path), F.lit("_cap"), duration_tag(seconds), F.lit("_"), digest, suffix(path))


def speaker_prefix(folder: Column | str) -> Column:
    """``p`` and three digits at the start of a folder name (or the whole of a shorter one)."""
    return F.nullif(F.regexp_extract(col(folder), r"^(p(?:\d{3}|\d{1,2}$))", 1), F.lit(""))
