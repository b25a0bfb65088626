"""Derived datasets: selections, pair sets and splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from timbre.functions.expr import basename, path_order, stem, unit_hash
from timbre.functions.text import speaker_prefix
from timbre.operators.matching import latest_run, resolve_across_models, resolve_reference
from timbre.operators.ordering import positions_by_integer, top_n
from timbre.session import cut_lineage

# --- fixed values ------------------------------------------------------------
DETECTION_TASK = "FakeDetection"
DETECTION_PROMPT = "<audio> Determine if this speech is real or a deepfake."
FAKE, REAL = "fake", "real"
MAX_REAL_PER_SPEAKER = 30
LONGEST_PER_SPEAKER = 10
PAIRS_PER_DIRECTION = 25
PAIRS_PER_SPEAKER = 50
MIXTURE_SNR_DB = [-5.0, 0.0, 5.0, 10.0]
MODEL_FOLDER_SUFFIX = "_ots_on_robotcall"
# -----------------------------------------------------------------------------

#: Rows that a block may grow to so that others are copied to at most so many blocks of sources, or of candidates.
_BLOCK, _DOWN, _ACROSS = 2_048, 32, 8
#: Distances that are added up at once, component by component.
_DISTANCES = 1 << 15


def model_of_folder(folder: Column | str, suffix: str = MODEL_FOLDER_SUFFIX) -> Column:
    """Model name of a result folder, NULL when the folder is not one of the wanted runs."""
    name = F.col(folder) if isinstance(folder, str) else folder
    return F.when(name.endswith(suffix), F.replace(name, F.lit(suffix), F.lit("")))


def _detection_row(model: Column, label: str) -> list[Column]:
    message = F.struct(F.lit("user").alias("role"), F.lit(DETECTION_PROMPT).alias("content"))
    return [
        model.alias("model"),
        basename("path").alias("key"),
        F.lit(DETECTION_TASK).alias("task"),
        F.array(message).alias("messages"),
        F.array("path").alias("audios"),
        F.lit(label).alias("labels"),
        F.col("speaker"),
    ]


def deepfake_set(generated: DataFrame, real: DataFrame, max_real: int = MAX_REAL_PER_SPEAKER) -> DataFrame:
    """Labelled real/fake rows per model.

    ``generated``: ``model``, ``run`` (timestamp folder), ``folder`` (speaker folder), ``path``.
    ``real``: ``speaker``, ``path``. Only each model's latest run counts; reals are limited to
    speakers with fakes and to the first ``max_real`` paths.
    """
    latest = latest_run(generated, "model", "run").withColumnRenamed("latest", "run")
    fakes = (
        generated.join(latest, ["model", "run"], "left_semi")
        .withColumn("speaker", speaker_prefix("folder"))
        .filter(F.col("speaker").isNotNull())
        .select("model", "speaker", "path")
    )
    speakers = fakes.select("model", "speaker").distinct()
    chosen = top_n(real.select("speaker", "path"), ["speaker"], [path_order("path")], max_real).drop("rank")
    reals = chosen.join(speakers, "speaker")
    return fakes.select(*_detection_row(F.col("model"), FAKE)).unionByName(
        reals.select(*_detection_row(F.col("model"), REAL))
    )


def longest_per_speaker(
    df: DataFrame, speaker: str, text: str, key: str, n: int = LONGEST_PER_SPEAKER
) -> DataFrame:
    """The ``n`` longest transcripts per speaker: ``(speaker, key, gt_len, rank)``.

    Only lengths and keys are ranked; texts can be joined back by key.
    """
    lengths = df.select(speaker, key, F.char_length(text).cast("bigint").alias("gt_len"))
    return top_n(lengths, [speaker], [F.desc("gt_len"), F.col(key)], n)


def compression_manifest(df: DataFrame, speakers: list[str] | None = None) -> DataFrame:
    """Selected utterances ordered by speaker and file name; missing required columns are an
    error."""
    required = {"speaker_id", "ground_truth_path", "generated_path"}
    missing = sorted(required - set(df.columns))
    if missing:
        raise ValueError(f"manifest is missing required columns: {missing}")
    kept = df.filter(F.col("speaker_id").isin(speakers)) if speakers else df
    optional = {
        "gt_stem": F.col("gt_stem") if "gt_stem" in df.columns else stem("ground_truth_path"),
        "gt_basename": F.col("gt_basename") if "gt_basename" in df.columns else basename("ground_truth_path"),
    }
    return kept.select(
        F.col("speaker_id").cast("string").alias("speaker_id"),
        F.col("generated_path").alias("gen_path"),
        basename("generated_path").alias("gen_basename"),
        stem("generated_path").alias("gen_stem"),
        "ground_truth_path",
        optional["gt_basename"].alias("gt_basename"),
        optional["gt_stem"].alias("gt_stem"),
    ).orderBy("speaker_id", "gen_basename")


def compression_set(
    manifest: DataFrame, generated: DataFrame, references: DataFrame, out_root: str, reference_name: str = "reference"
) -> DataFrame:
    """Copy plan ``(kind, model, utterance, src, dst)`` for the references and every model.

    ``manifest`` has an ``utterance`` key besides the columns of :func:`compression_manifest`;
    ``generated`` lists the files of each model's latest run.
    """
    base = f"{out_root.rstrip('/')}/compression"
    found = resolve_reference(manifest, references).filter("reference_path is not null")
    refs = found.select(
        F.lit("reference").alias("kind"),
        F.lit(reference_name).alias("model"),
        "utterance",
        "speaker_id",
        F.col("reference_path").alias("src"),
    )
    hits = resolve_across_models(manifest, generated).join(manifest.select("utterance", "speaker_id"), "utterance")
    gens = hits.select(F.lit("generated").alias("kind"), "model", "utterance", "speaker_id", F.col("path").alias("src"))
    plan = refs.unionByName(gens)
    return plan.select(
        "kind",
        "model",
        "utterance",
        "src",
        F.concat_ws("/", F.lit(base), "model", "speaker_id", basename("src")).alias("dst"),
    )


def noisy_clean_pairs(
    noisy: DataFrame, clean: DataFrame, n: int = 20, clean_only: int = 10, order: str = "utterance"
) -> DataFrame:
    """At most ``n`` noisy/clean pairs of one utterance key per speaker, over all environments, and
    ``clean_only`` clean items of utterances without a noisy take (environment and noisy path NULL).

    ``noisy``: ``speaker``, ``utterance``, ``environment``, ``path``; ``clean``: ``speaker``,
    ``utterance``, ``path``.
    """
    references = clean.groupBy("speaker", "utterance").agg(
        F.min_by("path", path_order("path")).alias("clean_path")
    )
    pairs = noisy.withColumnRenamed("path", "noisy_path").join(references, ["speaker", "utterance"])
    paired = top_n(pairs, ["speaker"], [order, "environment", path_order("noisy_path")], n)
    alone = references.join(noisy.select("speaker", "utterance"), ["speaker", "utterance"], "left_anti")
    single = top_n(alone, ["speaker"], [order], clean_only)
    columns = ["speaker", "environment", "utterance", "noisy_path", "clean_path", "rank"]
    return paired.select(*columns).unionByName(single, allowMissingColumns=True).select(*columns)


def cross_emotion_pairs(df: DataFrame, speaker: str, emotion: str, key: str) -> DataFrame:
    """Every utterance with one partner of the same speaker and another emotion.

    Emotions of a speaker form a ring; the k-th utterance of one emotion is paired with the k-th
    of the next (counted round when that one is shorter), so the output has one row per utterance
    and no group is multiplied with itself. Speakers with a single emotion have no pairs.
    """
    labelled = df.select(speaker, emotion, key).filter(F.col(emotion).isNotNull())
    placed = positions_by_integer(labelled, key, [speaker, emotion], out="_k")
    sizes = labelled.groupBy(speaker, emotion).agg(F.count(F.lit(1)).alias("_n"))
    rings = sizes.groupBy(speaker).agg(
        F.array_sort(F.collect_list(F.struct(F.col(emotion).alias("emotion"), F.col("_n").alias("n")))).alias("_ring")
    )
    steps = rings.filter(F.size("_ring") > 1).select(
        speaker, F.posexplode("_ring").alias("_i", "_here"), "_ring"
    )
    nexts = steps.select(
        speaker,
        F.col("_here.emotion").alias(emotion),
        F.element_at("_ring", (F.col("_i") + 1) % F.size("_ring") + 1).alias("_next"),
    )
    sources = placed.join(nexts, [speaker, emotion]).select(
        speaker,
        F.col(key).alias("prompt_key"),
        F.col(emotion).alias("prompt_emotion"),
        F.col("_next.emotion").alias("target_emotion"),
        F.pmod("_k", "_next.n").alias("_slot"),
    )
    targets = placed.select(
        speaker, F.col(emotion).alias("target_emotion"), F.col("_k").alias("_slot"), F.col(key).alias("target_key")
    )
    return sources.join(targets, [speaker, "target_emotion", "_slot"]).select(
        speaker, "prompt_key", "target_key", "prompt_emotion", "target_emotion"
    )


def bilingual_pairs(
    df: DataFrame,
    speaker: str,
    sentence: str,
    language: str,
    key: str,
    directions: list[tuple[str, str]],
    n: int = PAIRS_PER_DIRECTION,
) -> DataFrame:
    """Same sentence in two languages, ``n`` pairs per speaker and direction.

    A sentence that a speaker recorded more than once in a language enters with its first key.
    """
    once = df.groupBy(speaker, sentence, language).agg(F.min(key).alias("_key"))
    wanted = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in directions])
    sources = once.withColumn("_d", F.explode(F.filter(wanted, lambda d: d["source"] == F.col(language)))).select(
        speaker, sentence, F.col("_d.source").alias("prompt_language"), F.col("_d.target").alias("target_language"),
        F.col("_key").alias("prompt_key"),
    )
    targets = once.select(
        speaker, sentence, F.col(language).alias("target_language"), F.col("_key").alias("target_key")
    )
    pairs = sources.join(targets, [speaker, sentence, "target_language"])
    return top_n(pairs, [speaker, "prompt_language", "target_language"], [F.col(sentence)], n)


def balanced_speakers(
    speakers: DataFrame, strata: list[str], speaker: str, per_stratum: int | DataFrame, exclude: list | None = None
) -> DataFrame:
    """A number of speakers per stratum in hash order, without the excluded ones.

    ``per_stratum`` is one number for all, or a table of the strata columns and ``quota``; a
    stratum that the table lacks gives no speakers.
    """
    kept = speakers.filter(~F.col(speaker).isin(exclude)) if exclude else speakers
    hashed = kept.select(*strata, speaker).distinct().withColumn("_h", unit_hash(speaker))
    order = [F.col("_h"), F.col(speaker)]
    if isinstance(per_stratum, int):
        return top_n(hashed, strata, order, per_stratum).drop("_h")
    # one window over the largest quota, so that groups are still cut before the shuffle
    most = per_stratum.agg(F.max("quota")).first()[0] or 0
    return top_n(hashed, strata, order, most).join(per_stratum, strata).filter("rank <= quota").drop("_h", "quota")


def pairs_of_speakers(
    pairs: DataFrame, chosen: DataFrame, speaker: str, key: str, n: int = PAIRS_PER_SPEAKER
) -> DataFrame:
    """The first ``n`` pairs of every chosen speaker."""
    kept = pairs.join(chosen.select(speaker).distinct(), speaker, "left_semi")
    return top_n(kept.select(speaker, key), [speaker], [F.col(key)], n)


def disjoint_split(df: DataFrame, speaker: str, dev_share: float = 0.5, out: str = "split") -> DataFrame:
    """``dev`` or ``test`` by a hash of the speaker, so no speaker is on both sides."""
    limit = int(dev_share * (1 << 32))
    return df.withColumn(out, F.when(unit_hash(speaker) < limit, "dev").otherwise("test"))


def split_overlap(df: DataFrame, speaker: str, split: str = "split") -> DataFrame:
    """Speakers found on both sides of a split; empty when the split is disjoint."""
    sides = [df.filter(F.col(split) == s).select(speaker) for s in ("dev", "test")]
    return sides[0].intersect(sides[1])


def farthest_target(sources: DataFrame, candidates: DataFrame, block_size: int = 1_024) -> DataFrame:
    """The candidate speaker most different from every source: ``(speaker, target, difference)``.

    Both tables have ``speaker``, ``encoder``, ``embedding``; rows repeating a speaker and encoder count
    once. Per encoder the L1 distances are divided by their mean over the candidates, then added up;
    the first name wins a tie. Embeddings that hold a null, or have another length, are not compared.

    Blocks of sources meet blocks of candidates twice, as matrices: first each pair of blocks gives
    the sum of distances of every source, then, the means being known, only its best candidate. Blocks have
    ``block_size`` rows, but grow up to a bounded size before rows are copied to more than a few blocks.
    """
    embedding = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("speaker").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())

    def packed(df: DataFrame) -> DataFrame:
        single = df.filter(usable).groupBy("speaker", "encoder").agg(F.min(embedding).alias("embedding"))
        held = F.array_sort(F.collect_list(F.struct("encoder", "embedding"))).alias("embeddings")
        return cut_lineage(single.groupBy("speaker").agg(held))

    left, right = packed(sources), packed(candidates)
    down, across = (_blocks(side.count(), block_size, few) for side, few in ((left, _DOWN), (right, _ACROSS)))
    place = F.xxhash64("speaker")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    others = right.select(F.col("speaker").alias("target"), F.col("embeddings").alias("others"), F.pmod(place, F.lit(across)).cast("int").alias("across"), everywhere(down).alias("down"))
    asking = left.select("speaker", "embeddings", F.pmod(place, F.lit(down)).cast("int").alias("down"), everywhere(across).alias("across"))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((left, "speaker"), (others, "target"))}
    encoder = left.schema["embeddings"].dataType.elementType["encoder"].dataType.simpleString()
    keys = ("down", "across")
    sums = asking.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(_distance_sums, f"speaker {kinds['speaker']}, encoder {encoder}, total double, n long")
    mean = F.sum("total") / F.nullif(F.sum("n"), F.lit(0))
    means = sums.groupBy("speaker", "encoder").agg(mean.alias("mean"))
    scaled = cut_lineage(left.join(means.groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct("encoder", "mean"))).alias("means")), "speaker"))
    asking = scaled.select("speaker", "embeddings", "means", F.pmod(place, F.lit(down)).cast("int").alias("down"), everywhere(across).alias("across"))
    found = asking.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(
        _farthest, f"speaker {kinds['speaker']}, target {kinds['target']}, difference double"
    )
    best = F.min_by(F.struct("target", "difference"), F.struct(F.negative("difference"), F.col("target")))
    return found.groupBy("speaker").agg(best.alias("_b")).select("speaker", "_b.*")


def _by_encoder(embeddings: list[list[dict]]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Rows and their matrix, for each encoder and length."""
    rows: dict[tuple, tuple[list, list]] = {}
    for k, held in enumerate(embeddings):
        for e in held:
            own = rows.setdefault((e["encoder"], len(e["embedding"])), ([], []))
            own[0].append(k)
            own[1].append(e["embedding"])
    return {key: (np.array(k), np.array(m, float).reshape(len(k), -1)) for key, (k, m) in rows.items()}


def _blocks(rows: int, block_size: int, few: int) -> int:
    wanted = max(1, -(-rows // block_size))
    return min(wanted, max(few, -(-rows // max(block_size, _BLOCK))))


def _comparable(left: pa.Table, right: pa.Table) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(encoder, rows, their matrix, candidates, their matrix) of embeddings that can be compared."""
    one, other = _by_encoder(left.column("embeddings").to_pylist()), _by_encoder(right.column("others").to_pylist())
    for key in sorted(one.keys() & other.keys(), key=lambda k: (str(k[0]), k[1])):
        yield key[0], *one[key], *other[key]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L1 distances of all rows of ``a`` and ``b``."""
    gaps = np.zeros((len(a), len(b)))
    step = max(1, _DISTANCES // max(1, len(b)))
    components, gap = np.ascontiguousarray(b.T), np.empty((step, len(b)))
    for at in range(0, len(a), step):
        part = gaps[at : at + step]
        own = gap[: len(part)]
        for x, y in zip(a[at : at + step].T, components, strict=True):
            np.subtract(x[:, None], y, out=own)
            np.abs(own, out=own)
            part += own
    return gaps


def _total_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of the L1 distances of each row of ``a`` to all rows of ``b``, by sorted components.

    Where much cancels out, or numbers aren't finite, the distances themselves are added up.
    """
    totals, sizes = np.zeros(len(a)), np.zeros(len(a))
    exact = np.ones(len(a), bool)
    if np.isfinite(a).all() and np.isfinite(b).all():
        for x, y in zip(a.T, np.sort(b, axis=0).T, strict=True):
            sums = np.append(0.0, np.cumsum(y))
            below = np.searchsorted(y, x)
            totals += x * (2 * below - len(y)) + sums[-1] - 2 * sums[below]
            sizes += np.abs(x) * len(y) + np.abs(y).sum()
        exact = ~(totals > 0.001 * sizes)
    rows = np.flatnonzero(exact)
    for at in range(0, len(rows), 256):
        totals[rows[at : at + 256]] = _distances(a[rows[at : at + 256]], b).sum(axis=1)
    return totals


def _distance_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    rows, encoders, totals, counts = [], [], [], []
    for encoder, own, a, candidates, b in _comparable(left, right):
        rows += own.tolist()
        encoders += [encoder] * len(own)
        totals += _total_distances(a, b).tolist()
        counts += [len(candidates)] * len(own)
    kind = left.schema.field("embeddings").type.value_type.field("encoder").type
    columns = [left.column("speaker").take(pa.array(rows, pa.int64())), pa.array(encoders, kind), pa.array(totals, pa.float64()), pa.array(counts, pa.int64())]
    return pa.table(columns, ["speaker", "encoder", "total", "n"])


def _farthest(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best candidate of the block for every source; a mean of zero says nothing."""
    means = [{m["encoder"]: m["mean"] for m in held} for held in left.column("means").to_pylist()]
    shares = np.zeros((len(left), len(right)))
    told, met = np.zeros(shares.shape, bool), np.zeros(shares.shape, bool)
    for encoder, rows, a, candidates, b in _comparable(left, right):
        gaps = _distances(a, b)
        mean = np.array([means[k].get(encoder) or np.nan for k in rows.tolist()])[:, None]
        place = np.ix_(rows, candidates)
        met[place] = True
        told[place] |= ~np.isnan(mean)
        shares[place] += np.nan_to_num(gaps / mean)
    names = right.column("target").to_pylist()
    order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    rows, best, values = [], [], []
    for k in range(len(left)):
        open_to = order[met[k, order]]
        if len(open_to):
            silent = open_to[~told[k, open_to]]  # nothing is known of these, which comes before any difference
            at = int(silent[0]) if len(silent) else int(open_to[np.argmax(shares[k, open_to])])
            rows.append(k)
            best.append(at)
            values.append(None if len(silent) else float(shares[k, at]))
    columns = [left.column("speaker").take(pa.array(rows, pa.int64())), right.column("target").take(pa.array(best, pa.int64())), pa.array(values, pa.float64())]
    return pa.table(columns, ["speaker", "target", "difference"])
