"""Pair-manifest operators: canonical form, filters, samples, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from timbre.functions.expr import (
    basename,
    blank_to_null,
    col,
    first_truthy,
    first_truthy_or_blank,
    float_text,
    literal_map,
    parent_name,
    path_order,
    stem,
    strip,
)
from timbre.functions.language import select_language
from timbre.functions.text import sanitize, speaker_slug
from timbre.operators.ordering import positions_by_integer, positions_by_sort
from timbre.schema import CANONICAL_TO_LEGACY, FALSY, FILE_ORDER, LEGACY_TO_CANONICAL, MANIFEST_COLUMNS

# --- fixed values ------------------------------------------------------------
DEFAULT_SPLIT = "default"
DEFAULT_SPEAKER = "default"
MIN_PHONES, MAX_PHONES = 1, 640
DEFAULT_REQUEST_TEXT = "Here is a sample of the desired voice."
LANGUAGE_IDS = {"ZH": 0, "JP": 1, "EN": 2}
TONES_PER_LANGUAGE = {"ZH": 6, "JP": 2, "EN": 4}
# -----------------------------------------------------------------------------


def stringify(value: Column | str, data_type: T.DataType) -> Column:
    """NULL and NaN to an empty string, lists joined by a blank, numbers and booleans as Python writes them."""
    value = col(value)
    text = F.coalesce(_item_text(value, data_type), F.lit(""))
    return F.when(F.isnan(value), "").otherwise(text) if isinstance(data_type, (T.DoubleType, T.FloatType)) else text


def _item_text(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.ArrayType):
        return F.array_join(F.transform(value, lambda v: F.coalesce(_item_text(v, data_type.elementType), F.lit("None"))), " ")
    if isinstance(data_type, T.DoubleType):
        return float_text(value)
    if isinstance(data_type, T.FloatType):
        return float_text(value.cast("string").cast("double"))
    return F.initcap(value.cast("string")) if isinstance(data_type, T.BooleanType) else value.cast("string")


def truthy(value: Column | str, data_type: T.DataType) -> Column:
    """Text of a value, or NULL where a chain of alternatives falls through: NULL, an empty
    string or list, zero, false. NaN does not fall through and reads as an empty string."""
    value = col(value)
    if isinstance(data_type, T.StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(data_type, T.ArrayType):
        return F.when(F.size(value) > 0, stringify(value, data_type))
    if isinstance(data_type, T.BooleanType):
        return F.when(value, stringify(value, data_type))
    if isinstance(data_type, T.NumericType):
        return F.when(value != 0, stringify(value, data_type))
    return F.nullif(stringify(value, data_type), F.lit(""))


def make_pair_id(dataset: Column | str, speaker: Column | str, row: Column | str) -> Column:
    """``dataset-speaker-000012``; a blank speaker is written ``unknown``."""
    known = F.coalesce(blank_to_null(speaker), F.lit("unknown"))
    return F.concat_ws("-", col(dataset), known, F.format_string("%06d", col(row)))


def canonicalize(df: DataFrame, dataset: str) -> DataFrame:
    """Bring legacy or partial records into the canonical layout.

    A legacy column is used only where the canonical one is absent from the row. ``df`` carries
    ``source_manifest`` and ``source_row``; every column that is neither canonical nor legacy is
    kept after the canonical ones.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def true(name: str, data_type: T.DataType) -> Column:
        """``truthy``, also where the text of a JSON value hides that it was zero or false."""
        text = truthy(name, data_type)
        return F.when(~F.array_contains(FALSY, name), text) if FALSY in types else text

    def read(name: str, how) -> Column:
        """The canonical column, else its legacy one, as NULL-for-blank text."""
        sources = [n for n in (name, CANONICAL_TO_LEGACY.get(name)) if n in types]
        if not sources:
            return F.lit(None).cast("string")
        values = [how(n, types[n]) for n in sources]
        return values[0] if len(values) == 1 else F.when(F.col(name).isNotNull(), values[0]).otherwise(values[1])

    def text(name: str) -> Column:
        return F.coalesce(read(name, lambda n, t: stringify(n, t)), F.lit(""))

    def given(name: str) -> Column:
        return read(name, true)

    def written(name: str) -> Column:
        return read(name, lambda n, t: blank_to_null(stringify(n, t)) if not isinstance(t, T.StringType) else truthy(n, t))

    prompt_speaker = [given("prompt_speaker_id"), written("speaker_id")]
    target_speaker = [given("target_speaker_id"), *prompt_speaker]
    speaker = [given("speaker_id"), *prompt_speaker, given("target_speaker_id")]
    blank = F.lit("")
    special = {
        "dataset_name": F.coalesce(given("dataset_name"), F.lit(dataset)),
        "split": F.coalesce(given("split"), F.lit(DEFAULT_SPLIT)),
        "pair_id": F.coalesce(
            given("pair_id"),
            F.concat_ws(
                "-", F.lit(dataset), F.coalesce(*speaker, F.lit("unknown")), F.format_string("%06d", F.col("source_row"))
            ),
        ),
        "speaker_id": F.coalesce(*speaker, blank),
        "prompt_speaker_id": F.coalesce(*prompt_speaker, given("target_speaker_id"), blank),
        "target_speaker_id": F.coalesce(*target_speaker, blank),
        "target_file_name": F.coalesce(given("target_file_name"), text("prompt_file_name")),
        "target_language": F.coalesce(given("target_language"), text("prompt_language")),
        "source_manifest": F.col("source_manifest"),
        "source_row": F.col("source_row").cast("bigint"),
    }
    return df.select(
        *[(special[n] if n in special else text(n)).alias(n) for n in MANIFEST_COLUMNS],
        *extra_columns(df),
    )


def extra_columns(df: DataFrame) -> list[str]:
    """Columns that are neither canonical nor legacy, in their order."""
    reserved = {*MANIFEST_COLUMNS, *LEGACY_TO_CANONICAL, FALSY, *FILE_ORDER}
    return [c for c in df.columns if c not in reserved]


def passthrough_extras(df: DataFrame) -> DataFrame:
    """Key columns and the kept extras of a manifest."""
    return df.select("source_manifest", "source_row", *extra_columns(df))


def with_missing_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit("") for c in MANIFEST_COLUMNS if c not in df.columns})


def order_columns(df: DataFrame) -> DataFrame:
    return df.select(*MANIFEST_COLUMNS, *[c for c in df.columns if c not in MANIFEST_COLUMNS])


def to_internal(df: DataFrame) -> DataFrame:
    """Add the legacy-named aliases that are missing."""
    return df.withColumns(
        {old: F.col(new) for new, old in CANONICAL_TO_LEGACY.items() if old not in df.columns and new in df.columns}
    )


def filter_speaker(df: DataFrame, speaker: object) -> DataFrame:
    return df.filter(F.col("speaker_id") == str(speaker))


def discover_speakers(
    df: DataFrame, explicit: object | None = None, inventory: DataFrame | None = None, audio_root: str = "audios"
) -> DataFrame:
    """Speakers of a dataset: the explicit one, else those of the manifest, else the folders
    under ``audios/``, else the top folders, else ``default``."""
    spark = df.sparkSession
    if explicit is not None:
        return spark.range(1).select(F.lit(str(explicit)).alias("speaker_id"))
    found = df.select(F.col("speaker_id").cast("string").alias("speaker_id"), F.lit(0).alias("_level"))
    if inventory is not None:
        top = F.split("relative_path", "/")
        inside = inventory.filter(F.size(top) > 1)
        below = inside.filter((F.element_at(top, 1) == audio_root) & (F.size(top) > 2))
        found = found.unionByName(below.select(F.element_at(top, 2).alias("speaker_id"), F.lit(1).alias("_level")))
        found = found.unionByName(inside.select(F.element_at(top, 1).alias("speaker_id"), F.lit(2).alias("_level")))
    named = found.filter(F.col("speaker_id").isNotNull() & (F.col("speaker_id") != ""))
    named = named.filter((F.col("_level") == 0) | ~F.col("speaker_id").startswith("."))
    fallback = spark.range(1).select(F.lit(DEFAULT_SPEAKER).alias("speaker_id"), F.lit(3).alias("_level"))
    distinct = named.unionByName(fallback).groupBy("speaker_id").agg(F.min("_level").alias("_level"))
    best = distinct.agg(F.min("_level")).scalar()
    return distinct.filter(F.col("_level") == best).select("speaker_id").orderBy("speaker_id")


def speaker_index(speakers: DataFrame) -> DataFrame:
    """Dense 0-based index of the distinct speakers in sorted order."""


    distinct = speakers.select("speaker_id").distinct()
    return positions_by_sort(distinct, ["speaker_id"], out="speaker_index")


def union_manifests(*frames: DataFrame) -> DataFrame:
    """Concatenate manifests whose columns differ."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def sample_index(df: DataFrame) -> DataFrame:
    """0-based position of each stored row over all manifest files.

    With the place of each row in its file (``FILE_ORDER``, see ``read_manifest``) only the file
    sizes are accumulated and nothing is shuffled. Otherwise rows are ordered by file name and
    ``source_row``; gaps are closed, and only these two columns pass the window.
    """
    if set(FILE_ORDER) <= set(df.columns):
        file, row = FILE_ORDER
        sizes = df.groupBy(file).agg((F.max(row) + 1).alias("_n"))
        before = Window.orderBy(path_order(file)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        offsets = sizes.select(file, (F.sum("_n").over(before) - F.col("_n")).alias("_offset"))
        placed = df.join(offsets, file).withColumn("index", (F.col("_offset") + F.col(row)).cast("bigint"))
        return placed.drop("_offset")
    number = F.col("source_row").try_cast("bigint")
    keyed = df.withColumns({"_name": F.coalesce("source_manifest", F.lit("")), "_number": F.coalesce(number, F.lit(0).cast("bigint"))})
    keys = keyed.groupBy("_name", "_number").agg(F.count(F.lit(1)).alias("_same"))
    sizes = keys.groupBy("_name").agg(F.sum("_same").alias("_n"))
    before = Window.orderBy("_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select("_name", (F.sum("_n").over(before) - F.col("_n")).alias("_offset"))
    inside = positions_by_integer(keys.filter("_same = 1"), "_number", ["_name"], out="_at")
    repeated = keys.filter("_same > 1")
    checked = inside.select("_name", "_number", "_at").unionAll(
        repeated.select("_name", "_number", F.raise_error(F.lit("rows of one file share a source_row; read the manifest with file order")).cast("bigint"))
    )
    placed = keyed.join(checked, ["_name", "_number"]).join(offsets, "_name")
    return placed.withColumn("index", (F.col("_offset") + F.col("_at")).cast("bigint")).drop(
        "_name", "_number", "_at", "_offset"
    )


def zero_shot_samples(df: DataFrame, speaker: str | None = None, max_samples: int | None = None) -> DataFrame:
    """One sample per manifest row, with its index in manifest order and the fallbacks from
    target to prompt; ``max_samples`` keeps the first rows after the speaker filter."""
    shaped = sample_index(df).select(
        F.coalesce(
            first_truthy("speaker_id", "prompt_speaker_id", "target_speaker_id"), F.lit("None")
        ).alias("speaker_id"),
        "index",
        blank_to_null("prompt_file_name").alias("prompt_path"),
        F.coalesce("prompt_text", F.lit("")).alias("prompt_text"),
        "prompt_language",
        first_truthy("target_file_name", "prompt_file_name").alias("target_path"),
        first_truthy_or_blank("target_text", "prompt_text").alias("target_text"),
        "target_language",
        "pair_id",
        "source_manifest",
        "source_row",
        *[c for c in extra_columns(df) if c != "index"],
    )
    kept = shaped if speaker is None else shaped.filter(F.col("speaker_id") == str(speaker))
    return kept if max_samples is None else kept.orderBy("index").limit(max_samples)


def resolve_audio_path(
    df: DataFrame, path: str, inventory: DataFrame, roots: list[str], out: str = "resolved_path"
) -> DataFrame:
    """Absolute paths stay; relative ones go to the first root that has the file, else to the
    first root. Blank paths stay NULL. ``inventory`` lists existing files in ``path``."""
    files = inventory.select(F.col("path").alias("_file")).distinct()
    relative = ~F.col(path).startswith("/")
    candidates = F.array(
        *[F.struct(F.lit(i).alias("rank"), F.concat(F.lit(f"{r.rstrip('/')}/"), F.col(path)).alias("file"))
          for i, r in enumerate(roots)]
    )
    wanted = df.filter(relative & (F.col(path) != "")).select(path).distinct()
    hits = (
        wanted.select(path, F.explode(candidates).alias("_c"))
        .join(files, F.col("_c.file") == F.col("_file"))
        .groupBy(path)
        .agg(F.min_by("_file", "_c.rank").alias("_hit"))
    )
    fallback = F.concat(F.lit(f"{roots[0].rstrip('/')}/"), F.col(path))
    return df.join(hits, path, "left").withColumn(
        out,
        F.when(F.col(path).isNull() | (F.col(path) == ""), F.lit(None).cast("string"))
        .when(~relative, F.col(path))
        .otherwise(F.coalesce("_hit", fallback)),
    ).drop("_hit")


def evaluation_map(samples: DataFrame) -> DataFrame:
    """Target path -> speaker, text and language; the last sample of a path wins."""
    usable = samples.filter(F.col("target_path").isNotNull())
    entry = F.struct(
        "speaker_id",
        F.col("target_text").alias("text"),
        first_truthy("target_language", "prompt_language").alias("language"),
    )
    return usable.groupBy("target_path").agg(F.max_by(entry, "index").alias("_e")).select("target_path", "_e.*")


def transcript_map(df: DataFrame, path: str = "prompt_path", order: str = "index") -> DataFrame:
    """Prompt path -> transcript (prompt text, else target text); the last row wins."""
    text = first_truthy_or_blank("prompt_text", "target_text")
    return df.filter(F.col(path).isNotNull()).groupBy(path).agg(F.max_by(text, order).alias("transcript"))


def digit_tokens(value: Column | str) -> Column:
    """Integers of a blank-separated list; tokens with anything but digits are dropped, and one
    beyond 64 bits is NULL."""
    tokens = F.filter(F.split(col(value), " "), lambda t: strip(t).rlike("^[0-9]+$"))
    return F.transform(tokens, lambda t: strip(t).try_cast("bigint"))


def filter_trainable(
    df: DataFrame, inventory: DataFrame | None = None, low: int = MIN_PHONES, high: int = MAX_PHONES
) -> DataFrame:
    """Rows whose phone counts are in range on both sides and whose files exist, with parsed
    phone, tone and word2ph arrays."""
    kept = df
    for side in ("prompt", "target"):
        count = F.size(F.split(f"{side}_phonemes", " ", -1))
        kept = kept.filter(count.between(low, high))
    if inventory is not None:
        files = inventory.select(F.col("path").alias("_file"))
        for side in ("prompt", "target"):
            kept = kept.join(files, F.col(f"{side}_file_name") == F.col("_file"), "left_semi")
    parsed = {}
    for side in ("prompt", "target"):
        parsed[f"{side}_phonemes"] = F.split(f"{side}_phonemes", " ", -1)
        parsed[f"{side}_tone"] = digit_tokens(f"{side}_tone")
        parsed[f"{side}_word2ph"] = digit_tokens(f"{side}_word2ph")
    return kept.withColumns(parsed)


def skip_report(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, kept rows and skipped fraction, overall or per key."""
    by = by or []
    marked = before.select(*by, F.lit(1).alias("_all"), F.lit(0).alias("_kept")).unionByName(
        after.select(*by, F.lit(0).alias("_all"), F.lit(1).alias("_kept"))
    )
    total, kept = F.sum("_all"), F.sum("_kept")
    return marked.groupBy(*by).agg(
        total.cast("bigint").alias("total"),
        kept.cast("bigint").alias("kept"),
        F.when(total > 0, (total - kept) / total).alias("skipped_fraction"),
    )


def spec_length(n_bytes: Column | str, hop: int) -> Column:
    """Spectrogram frames estimated from the file size of 16-bit mono audio."""
    return F.floor(col(n_bytes) / F.lit(2 * hop)).cast("bigint")


def canonical_speaker(value: Column | str) -> Column:
    """Trim, base name, text before the first dot and the first ``_`` or ``-``, lower-case."""
    name = basename(strip(value))
    return F.lower(F.regexp_extract(name, r"^([^._\-]*)", 1))


def speaker_number(df: DataFrame, speaker: str, order: str, out: str = "speaker_number") -> DataFrame:
    """Trailing digits of the canonical speaker; without digits, or with more than 64 bits hold, a
    dense id by first appearance."""
    keyed = df.withColumn("_token", canonical_speaker(speaker))
    number = F.regexp_extract("_token", r"(\d+)$", 1).try_cast("bigint")
    unnumbered = keyed.filter(number.isNull()).groupBy("_token").agg(F.min(order).alias("_first"))
    ids = positions_by_integer(unnumbered, "_first", out="_id").select("_token", "_id")
    return keyed.join(ids, "_token", "left").withColumn(
        out, F.coalesce(number, F.col("_id"))
    ).drop("_token", "_id")


def encode_phones(phones: Column | str, tones: Column | str, language: Column | str, symbols: dict[str, int]) -> Column:
    """struct(phone_ids, tone_ids, language_ids); an unknown symbol or language is an error."""


    starts, total = {}, 0
    for name in LANGUAGE_IDS:
        starts[name] = total
        total += TONES_PER_LANGUAGE[name]
    table = literal_map(symbols)
    unknown = F.raise_error(F.concat(F.lit("unknown symbol or language: "), col(language))).cast("int")
    ids = F.transform(col(phones), lambda p: F.coalesce(F.element_at(table, p), unknown))
    start = F.coalesce(F.element_at(literal_map(starts), col(language)), unknown)
    lang = F.coalesce(F.element_at(literal_map(LANGUAGE_IDS), col(language)), unknown)
    return F.struct(
        ids.alias("phone_ids"),
        F.transform(col(tones), lambda t: t + start).alias("tone_ids"),
        F.transform(col(phones), lambda _: lang).alias("language_ids"),
    )


def intersperse_blank(values: Column | str) -> Column:
    """[a, b] -> [0, a, 0, b, 0]."""
    zero = F.lit(0)
    return F.concat(F.array(zero), F.flatten(F.transform(col(values), lambda v: F.array(v, zero))))


def intersperse_word2ph(word2ph: Column | str) -> Column:
    """Counts after blank insertion: doubled, the first one plus one."""
    return F.transform(col(word2ph), lambda n, i: n * 2 + F.when(i == 0, 1).otherwise(0))


def clone_filename(prompt_path: Column | str, target_path: Column | str, index: Column | str, kind: str = "cloned") -> Column:
    """Output name of a sample: ``<prompt>_to_<target>_cloned.wav`` or what is available."""
    prompt, target = blank_to_null(stem(prompt_path)), blank_to_null(stem(target_path))
    fallback = F.concat(F.lit("sample_"), col(index).cast("string"))
    source = F.coalesce(F.concat(prompt, F.lit("_to_"), target), prompt, target, fallback)
    clean = sanitize(strip(source), "clone")
    return F.concat(F.coalesce(blank_to_null(clean), fallback), F.lit(f"_{kind}.wav"))


def synthesis_requests(
    samples: DataFrame,
    inventory: DataFrame | None = None,
    text_policy: str = "target_first",
    default_text: str | None = DEFAULT_REQUEST_TEXT,
    transcript_policy: str = "x_vector",
    language_source: str = "target",
    default_language: str | None = "Auto",
    language_table: str = "names",
    output_root: str = "generated_audio",
    folder: str = "speaker",
) -> DataFrame:
    """Request table of a synthesis run.

    Samples without an existing prompt file are dropped. ``text_policy`` is ``target_first`` or
    ``prompt_first``; with ``default_text=None`` samples without any text are dropped.
    ``transcript_policy`` flags (``x_vector``) or drops (``drop``) samples without a prompt
    transcript, fills it with the default text (``default``), or ignores it (``none``). ``folder``
    names the output folder: the ``speaker`` or the folder of the ``target`` file.
    """
    usable = samples.filter(F.col("prompt_path").isNotNull())
    if inventory is not None:
        files = inventory.select(F.col("path").alias("_file"))
        usable = usable.join(files, F.col("prompt_path") == F.col("_file"), "left_semi")
    prompt, target = strip(F.coalesce("prompt_text", F.lit(""))), strip(F.coalesce("target_text", F.lit("")))
    order = [target, prompt] if text_policy == "target_first" else [prompt, target]
    transcript = prompt
    if transcript_policy == "default":
        transcript = first_truthy_or_blank(prompt, F.lit(default_text or ""))
    owner = F.col("speaker_id")
    if folder == "target":
        owner = first_truthy(parent_name("target_path"), "speaker_id")
    text = first_truthy(*order) if default_text is None else first_truthy(*order, F.lit(default_text))
    requests = usable.select(
        "index",
        "speaker_id",
        "prompt_path",
        "target_path",
        transcript.alias("prompt_transcript"),
        text.alias("text"),
        select_language("target_language", "prompt_language", language_source, default_language, language_table).alias(
            "language"
        ),
        ((prompt == "") & F.lit(transcript_policy == "x_vector")).alias("x_vector_only"),
        F.concat_ws(
            "/",
            F.lit(output_root),
            speaker_slug(owner),
            clone_filename("prompt_path", "target_path", "index"),
        ).alias("output_path"),
    )
    if default_text is None:
        requests = requests.filter(F.col("text").isNotNull())
    if transcript_policy == "drop":
        requests = requests.filter(F.col("prompt_transcript") != "")
    return requests


def plan_counts(samples: DataFrame, inventory: DataFrame, preview: int = 8) -> DataFrame:
    """Utterances, speakers, available prompts and the first speaker names of a run."""
    files = inventory.select(F.col("path").alias("_file")).distinct()
    joined = samples.join(files, F.col("prompt_path") == F.col("_file"), "left")
    totals = joined.agg(
        F.count(F.lit(1)).alias("utterances"),
        F.countDistinct("speaker_id").alias("speakers"),
        F.count("_file").alias("available_prompts"),
    )
    first = samples.select("speaker_id").distinct().orderBy("speaker_id").limit(preview)
    names = first.agg(F.array_join(F.array_sort(F.collect_list("speaker_id")), ", ")).scalar()
    return totals.withColumn("speaker_preview", names)


def relative_output_path(path: Column | str, speaker: Column | str, root: str) -> Column:
    """Path below the dataset root with a ``.wav`` suffix, else ``<speaker>/<stem>.wav``."""
    prefix = f"{root.rstrip('/')}/"
    inside = F.substring(col(path), F.lit(len(prefix) + 1), F.char_length(col(path)))
    swapped = F.concat(F.regexp_replace(inside, r"(?s)([^/])\.[^./]+$", "$1"), F.lit(".wav"))
    return F.when(col(path).startswith(prefix), swapped).otherwise(
        F.concat(col(speaker), F.lit("/"), stem(path), F.lit(".wav"))
    )
