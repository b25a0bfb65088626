"""Joins between manifest samples and the files that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timbre.functions.expr import basename, blank_to_null, parent_dir, parent_name, path_order, stem, suffix
from timbre.functions.text import sanitize, speaker_slug
from timbre.operators.claims import first_by_name, resolve_generated
from timbre.operators.ordering import positions_by_sort
from timbre.session import cut_lineage

# --- fixed values ------------------------------------------------------------
RUN_FOLDER = r"^\d{8}-\d{6}$"
PROTECTED_STEM = r"(?i)^(.+)_(?:spec|safespeech)_protected\.wav$"
PROTECTED_SUFFIX_KEY = r"(?i)^.*_(\d+?)_(\d+?)\.wav$"
PROTECTED_ORDER = r"(?i)^0_(?:SPEC|SafeSpeech)_(\d+)\.wav$"
EXTENSION_ORDER = [".wav", ".flac", ".mp3", ".m4a"]
CLONE_MARK = "_cloned"
PAIR_MARK = "_to_"
# -----------------------------------------------------------------------------


def extension_rank(path: Column) -> Column:
    """Preference of an audio extension; unknown ones come last."""
    position = F.array_position(F.array(*[F.lit(e) for e in EXTENSION_ORDER]), F.lower(suffix(path)))
    return F.when(position == 0, len(EXTENSION_ORDER) + 1).otherwise(position)


def target_stem(name: Column) -> Column:
    """Stem after the first ``_to_`` without a trailing ``_cloned``."""
    return F.regexp_replace(F.regexp_replace(name, rf"(?s)^.*?{PAIR_MARK}", ""), f"{CLONE_MARK}$", "")


def clone_candidates(target_path: Column, prompt_path: Column) -> Column:
    """Array of (priority, name): combined, prompt-only, target-only."""
    prompt = sanitize(stem(prompt_path), "clone")
    target = sanitize(stem(target_path), "clone")
    names = [
        F.concat(prompt, F.lit(PAIR_MARK), target, F.lit(f"{CLONE_MARK}.wav")),
        F.concat(prompt, F.lit(f"{CLONE_MARK}.wav")),
        F.concat(stem(target_path), F.lit(f"{CLONE_MARK}.wav")),
    ]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("priority"), n.alias("name")) for i, n in enumerate(names)])
    return F.filter(rows, lambda r: r["name"].isNotNull())


def locate_clone(samples: DataFrame, inventory: DataFrame, key: str = "index") -> DataFrame:
    """Direct clone matches: ``(key, clone_path, priority, speaker_dir_exists)`` for every sample.

    The folder is the slug of the target's parent folder (or the speaker), directly below the root
    of the generated files. ``inventory`` lists them with ``name`` and ``relative_path`` (or, for
    files that all lie one folder deep, ``parent``).
    """
    below = parent_dir("relative_path") if "relative_path" in inventory.columns else F.col("parent")
    inventory = inventory.withColumn("parent", below)
    hint = F.coalesce(blank_to_null(parent_name("target_path")), blank_to_null("speaker_id"))
    wanted = samples.select(
        key,
        F.when(hint.isNotNull(), speaker_slug(hint)).alias("_dir"),
        clone_candidates(F.col("target_path"), F.col("prompt_path")).alias("_candidates"),
    )
    folders = inventory.select(F.col("parent").alias("_dir")).distinct().withColumn("_exists", F.lit(True))
    files = inventory.groupBy("parent", "name").agg(F.min_by("path", path_order("path")).alias("_path"))
    tried = wanted.select(key, "_dir", F.explode_outer("_candidates").alias("_c")).select(
        key, "_dir", F.col("_c.priority").alias("priority"), F.col("_c.name").alias("_name")
    )
    hit = F.struct("priority", F.col("_path").alias("path"))
    best = (
        tried.join(files, (F.col("_dir") == F.col("parent")) & (F.col("_name") == F.col("name")), "left")
        .groupBy(key, "_dir")
        .agg(F.min(F.when(F.col("_path").isNotNull(), hit)).alias("_hit"))
    )
    return best.join(folders, "_dir", "left").select(
        key,
        F.col("_hit.path").alias("clone_path"),
        F.col("_hit.priority").alias("priority"),
        F.coalesce("_exists", F.lit(False)).alias("speaker_dir_exists"),
    )


def override_by_basename(df: DataFrame, path: str, inventory: DataFrame | None, out: str = "resolved_path") -> DataFrame:
    """Substitute a path by the first file of the same name; ``duplicates`` tells how many more
    there are."""
    if inventory is None:
        return df.withColumns({out: F.col(path), "duplicates": F.lit(0).cast("bigint")})
    index = first_by_name(inventory).select(
        F.col("name").alias("_name"), F.col("path").alias("_path"), (F.col("copies") - 1).alias("_more")
    )
    return df.join(index, basename(path) == F.col("_name"), "left").select(
        *df.columns,
        F.coalesce("_path", F.col(path)).alias(out),
        F.coalesce("_more", F.lit(0)).cast("bigint").alias("duplicates"),
    )


def collect_pairs(
    samples: DataFrame,
    inventory: DataFrame,
    originals: DataFrame | None = None,
    ground_truth: DataFrame | None = None,
    max_samples: int | None = None,
    fallback: bool = True,
) -> DataFrame:
    """One row per sample with ``target_path``, ``clone_path`` and a ``status``.

    ``status`` is ``paired``, ``no_target``, ``no_ground_truth`` or ``no_clone``. ``originals``
    replaces target paths by file name, ``ground_truth`` lists the files that exist. Samples with
    an existing speaker folder but no direct match go through :func:`resolve_generated`.
    """
    chosen = samples if max_samples is None else samples.orderBy("index").limit(max_samples)
    resolved = override_by_basename(chosen, "target_path", originals, out="_target").withColumn(
        "target_path", F.col("_target")
    ).drop("_target", "duplicates")
    if ground_truth is not None:
        files = ground_truth.select(F.col("path").alias("_gt")).distinct()
        resolved = resolved.join(files, F.col("target_path") == F.col("_gt"), "left")
    else:
        resolved = resolved.withColumn("_gt", F.col("target_path"))
    resolved = resolved.withColumn("_ready", F.col("_gt").isNotNull())
    # matching reads these columns several times, the texts never
    keys = cut_lineage(resolved.select("index", "speaker_id", "target_path", "prompt_path", "_ready"))
    usable = keys.filter("_ready").drop("_ready")
    direct = cut_lineage(locate_clone(usable, inventory))
    found = direct.select("index", "clone_path", F.lit("direct").alias("rule")).filter("clone_path is not null")
    if fallback:
        # a direct hit takes the listed file of its name out of the pool for later samples
        listed = first_by_name(inventory).select(F.col("path").alias("clone_path"))
        held = found.join(listed, "clone_path", "left_semi").select("index", F.col("clone_path").alias("path"))
        open_rows = direct.filter("clone_path is null and speaker_dir_exists").select("index")
        open_samples = usable.join(open_rows, "index", "left_semi")
        claimed = resolve_generated(open_samples, inventory, held=held)
        found = found.unionByName(
            claimed.select("index", F.col("path").alias("clone_path"), F.lit("claimed").alias("rule"))
        )
    # the keys serve a caller that asks for no more of the samples
    rest = [c for c in samples.columns if c not in keys.columns]
    whole = keys if not rest else keys.join(resolved.select("index", *rest), "index")
    return whole.join(found, "index", "left").select(
        *samples.columns,
        "clone_path",
        "rule",
        F.when(F.col("target_path").isNull(), "no_target")
        .when(~F.col("_ready"), "no_ground_truth")
        .when(F.col("clone_path").isNull(), "no_clone")
        .otherwise("paired")
        .alias("status"),
    )


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("status") == "paired").alias("paired"),
        F.count_if(F.col("status") != "paired").alias("missing"),
    )


def protected_indexes(inventory: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lookup tables of a protected folder: by stem, by numeric suffix, by order number."""
    ordered = inventory.select("path", basename("path").alias("name"), path_order("path").alias("_o"))
    plain = ordered.select(stem("path").alias("stem"), "path", "_o")
    stripped = ordered.select(
        blank_to_null(F.regexp_extract("name", PROTECTED_STEM, 1)).alias("stem"), "path", "_o"
    ).filter("stem is not null")
    by_stem = plain.unionByName(stripped).groupBy("stem").agg(F.min_by("path", "_o").alias("stem_path"))
    suffixed = ordered.filter(F.col("name").rlike(PROTECTED_SUFFIX_KEY)).select(
        F.concat_ws(
            "_",
            F.regexp_extract("name", PROTECTED_SUFFIX_KEY, 1),
            F.regexp_extract("name", PROTECTED_SUFFIX_KEY, 2),
        ).alias("suffix_key"),
        "name",
        "path",
        "_o",
    )
    numbered = ordered.filter(F.col("name").rlike(PROTECTED_ORDER)).select(
        F.lpad(F.regexp_extract("name", PROTECTED_ORDER, 1), 20, "0").alias("_n"), "path", "_o"
    )
    return by_stem, suffixed, numbered


def match_protected(originals: DataFrame, inventory: DataFrame, path: str = "path", index: str = "index") -> DataFrame:
    """Protected file of every original: ``(index, original, protected, rule, candidates,
    name_mismatch)``; ``protected`` is NULL when missing.

    Rules in order: stem (a ``_protected`` mark is ignored), the last two parts of the stem (the
    same file name preferred), and the i-th numbered file for the i-th original.
    """
    by_stem, suffixed, numbered = protected_indexes(inventory)
    base = originals.select(F.col(index).alias("index"), F.col(path).alias("original")).withColumns(
        {"_stem": stem("original"), "_name": basename("original")}
    )
    parts = F.split("_stem", "_", -1)
    base = base.withColumn(
        "_key", F.when(F.size(parts) >= 2, F.concat_ws("_", F.slice(parts, -2, 2)))
    )
    groups = suffixed.groupBy("suffix_key").agg(
        F.min_by("path", "_o").alias("_any"), F.count(F.lit(1)).alias("_many")
    )
    exact = suffixed.groupBy("suffix_key", "name").agg(F.min_by("path", "_o").alias("_same"))
    placed = positions_by_sort(numbered, ["_n", "_o"], out="_i").select("_i", F.col("path").alias("_nth"))
    joined = (
        base.join(by_stem, F.col("_stem") == F.col("stem"), "left")
        .join(groups, F.col("_key") == F.col("suffix_key"), "left")
        .drop("suffix_key")
        .join(exact, (F.col("_key") == F.col("suffix_key")) & (F.col("_name") == F.col("name")), "left")
        .join(placed, F.col("index") == F.col("_i"), "left")
    )
    by_suffix = F.coalesce("_same", "_any")
    protected = F.coalesce(F.col("stem_path"), by_suffix, F.col("_nth"))
    return joined.select(
        "index",
        "original",
        protected.alias("protected"),
        F.when(F.col("stem_path").isNotNull(), "stem")
        .when(by_suffix.isNotNull(), "suffix")
        .when(F.col("_nth").isNotNull(), "order")
        .alias("rule"),
        F.when(F.col("stem_path").isNull(), F.coalesce("_many", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias(
            "candidates"
        ),
        (basename(protected) != F.col("_name")).alias("name_mismatch"),
    )


def require_same_names(matches: DataFrame) -> DataFrame:
    """Strict mode of :func:`match_protected`: a match under another file name is an error."""
    message = F.concat(F.lit("file names differ: "), F.col("original"), F.lit(" / "), F.col("protected"))
    return matches.withColumn(
        "protected",
        F.when(F.col("name_mismatch"), F.raise_error(message).cast("string")).otherwise(F.col("protected")),
    )


def override_prompts(samples: DataFrame, inventory: DataFrame, root: str, strict: bool = True) -> DataFrame:
    """Take prompts from a protected folder: ``speaker/name``, ``parent/name``, then ``name``.

    A sample whose prompt has no protected copy raises in strict mode and keeps its prompt
    otherwise (``prompt_missing`` is set).
    """
    base = root.rstrip("/")
    files = inventory.select(F.col("path").alias("_file")).distinct()
    name = basename("prompt_path")
    spots = [F.concat_ws("/", F.lit(base), d, name) for d in (F.col("speaker_id"), parent_name("prompt_path"))]
    spots.append(F.concat_ws("/", F.lit(base), name))
    ranked = F.array(*[F.struct(F.lit(i).alias("rank"), s.alias("file")) for i, s in enumerate(spots)])
    hits = (
        samples.filter(F.col("prompt_path").isNotNull())
        .select("index", F.explode(ranked).alias("_c"))
        .join(files, F.col("_c.file") == F.col("_file"))
        .groupBy("index")
        .agg(F.min_by("_file", "_c.rank").alias("_hit"))
    )
    joined = samples.join(hits, "index", "left")
    missing = F.col("prompt_path").isNotNull() & F.col("_hit").isNull()
    kept = F.coalesce("_hit", "prompt_path")
    if strict:
        message = F.concat(F.lit("protected audio not found for prompt: "), F.col("prompt_path"))
        kept = F.when(missing, F.raise_error(message).cast("string")).otherwise(kept)
    return joined.select(
        *[kept.alias(c) if c == "prompt_path" else F.col(c) for c in samples.columns],
        missing.alias("prompt_missing"),
    )


def latest_run(runs: DataFrame, model: str, folder: str, mtime: str | None = None) -> DataFrame:
    """Greatest run folder per model: only timestamp names, or any name with ``mtime`` as tie."""
    if mtime is None:
        usable = runs.filter(F.col(folder).rlike(RUN_FOLDER))
        return usable.groupBy(model).agg(F.max(folder).alias("latest"))
    usable = runs.filter(~F.col(folder).startswith("."))
    return usable.groupBy(model).agg(F.max_by(folder, F.struct(folder, mtime)).alias("latest"))


def dotted_stems(name: Column) -> Column:
    """Every stem ``s`` for which ``s.*`` covers the name: one per dot."""
    parts = F.split(name, r"\.", -1)
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), ".")),
    ).otherwise(F.array().cast("array<string>"))


def resolve_across_models(utterances: DataFrame, inventory: DataFrame, key: str = "utterance") -> DataFrame:
    """Generated file of every utterance in every model that has one.

    ``utterances``: key, ``speaker_id``, ``gen_basename``. ``inventory``: ``model``, ``parent``
    (speaker folder), ``name``, ``path`` of each model's latest run. Rules: the exact name,
    ``*_to_<name>``, ``*_to_<stem>.*``, ``<stem>.*``. Matching runs through equi-joins on names
    derived from either side, so no utterance × model product is built.
    """
    wanted = utterances.select(
        key,
        F.col("speaker_id").alias("_speaker"),
        F.col("gen_basename").alias("_name"),
        stem("gen_basename").alias("_stem"),
    )
    # every text behind an "_to_" in the file name is a possible target name
    files = inventory.select("model", "parent", "name", "path").withColumns(
        {"_bare": stem("name"), "_ext": extension_rank(F.col("path"))}
    )
    pieces = F.split("name", PAIR_MARK, -1)
    tails = files.withColumn(
        "_tail",
        F.explode(
            F.when(
                F.size(pieces) > 1,
                F.transform(
                    F.sequence(F.lit(2), F.size(pieces)),
                    lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), PAIR_MARK),
                ),
            ).otherwise(F.array().cast("array<string>"))
        ),
    )
    columns = ["model", "parent", "path", "_ext"]
    names = files.select(*columns, F.lit(1).alias("_rule"), F.col("name").alias("_key"))
    names = names.unionByName(tails.select(*columns, F.lit(2).alias("_rule"), F.col("_tail").alias("_key")))
    stems = tails.select(*columns, F.lit(3).alias("_rule"), F.explode(dotted_stems(F.col("_tail"))).alias("_key"))
    stems = stems.unionByName(files.select(*columns, F.lit(4).alias("_rule"), F.explode(dotted_stems(F.col("name"))).alias("_key")))
    same_folder = F.col("_speaker") == F.col("parent")
    hits = wanted.join(names, same_folder & (F.col("_name") == F.col("_key"))).unionByName(
        wanted.join(stems, same_folder & (F.col("_stem") == F.col("_key")))
    )
    best = F.min(F.struct("_rule", "_ext", path_order("path").alias("_o"), "path")).alias("_best")
    return hits.groupBy(key, "model").agg(best).select(
        key, "model", F.col("_best.path").alias("path"), F.col("_best._rule").alias("rule")
    )


def missing_across_models(utterances: DataFrame, resolved: DataFrame, models: DataFrame, key: str = "utterance") -> DataFrame:
    """``(key, model)`` without a generated file. Model names (one row per model) travel as one
    array; only the missing combinations are ever expanded."""
    names = models.agg(F.array_sort(F.collect_set("model"))).scalar()
    have = resolved.groupBy(key).agg(F.collect_set("model").alias("_have"))
    return (
        utterances.select(key)
        .join(have, key, "left")
        .select(key, F.explode(F.array_except(names, F.coalesce("_have", F.array().cast("array<string>")))).alias("model"))
    )


def resolve_reference(utterances: DataFrame, inventory: DataFrame, key: str = "utterance") -> DataFrame:
    """Reference recording of every utterance: the listed path if it exists, else in the
    speaker's folder ``<target stem>.*``, ``<listed stem>.*``, then the listed file name."""
    speaker, anywhere = F.col("speaker_id"), F.lit("")

    def wish(rule: int, folder: Column, name: Column) -> Column:
        return F.struct(F.lit(rule).alias("_rule"), folder.alias("_folder"), name.alias("_key"))

    wanted = utterances.select(
        key,
        F.inline(
            F.array(
                wish(0, anywhere, F.col("ground_truth_path")),
                wish(1, speaker, target_stem(stem("gen_basename"))),
                wish(2, speaker, stem("ground_truth_path")),
                wish(3, speaker, basename("ground_truth_path")),
            )
        ),
    )
    folder = F.col("parent")
    rows = F.concat(
        F.array(wish(0, anywhere, F.col("path")), wish(3, folder, F.col("name"))),
        F.transform(dotted_stems(F.col("name")), lambda s: wish(1, folder, s)),
        F.transform(dotted_stems(F.col("name")), lambda s: wish(2, folder, s)),
    )
    index = inventory.select("path", extension_rank(F.col("path")).alias("_ext"), F.inline(rows))
    hits = wanted.join(index, ["_rule", "_folder", "_key"])
    best = F.min(F.struct("_rule", "_ext", path_order("path").alias("_o"), "path")).alias("_best")
    found = hits.groupBy(key).agg(best).select(
        key, F.col("_best.path").alias("reference_path"), F.col("_best._rule").alias("reference_rule")
    )
    return utterances.join(found, key, "left")


def pair_by_index(test_list: DataFrame, synthesized: DataFrame, strict: bool = True) -> DataFrame:
    """Pair list line i with the file ``<tag>_<speaker>_<i>.wav``.

    ``test_list``: ``line_no``, ``path``, ``speaker``; ``synthesized``: ``path``. In strict mode
    differing row counts or speakers raise.
    """
    parts = F.split(stem("path"), "_", -1)
    files = synthesized.select(
        F.col("path").alias("synthesized_path"),
        F.try_element_at(parts, F.lit(2)).alias("_speaker"),
        F.try_element_at(parts, F.lit(3)).try_cast("bigint").alias("_index"),
    )
    joined = test_list.join(files, F.col("line_no") == F.col("_index"), "left")
    agrees = F.col("_speaker") == F.col("speaker")
    out = joined.select(
        "line_no", "path", "speaker", "synthesized_path", agrees.alias("speaker_agrees")
    )
    if not strict:
        return out
    counts = F.abs(
        test_list.agg(F.count(F.lit(1))).scalar() - synthesized.agg(F.count(F.lit(1))).scalar()
    )
    checked = (
        F.when(counts != 0, F.raise_error(F.lit("file count differs from list length")).cast("string"))
        .when(~F.col("speaker_agrees"), F.raise_error(F.lit("speaker of file and list differ")).cast("string"))
        .otherwise(F.col("synthesized_path"))
    )
    return out.withColumn("synthesized_path", checked)


def attach_timings(pairs: DataFrame, timings: DataFrame, path: str = "clone_path") -> DataFrame:
    known = timings.select(F.col("generated_path").alias("_path"), "synthesis_time_sec")
    return pairs.join(known, F.col(path) == F.col("_path"), "left").drop("_path")


def clean_vs_processed(dataset: DataFrame, processed: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """Match processed files to the clean recordings when they are given, else to the dataset."""
    return match_protected(clean if clean is not None else dataset, processed)
