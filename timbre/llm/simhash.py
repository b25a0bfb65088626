"""SimHash near-duplicates: fingerprints of word shingles, linked through vantage-point trees.

Defined results: null and wordless texts have fingerprint zero and are linked like any other;
texts with fewer words than a shingle are one shingle; repeated rows and equal ``doc_id`` give a
row each; a null ``doc_id`` takes part but never names a component (null if nothing else can);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from timbre.llm.components import connected_components, parts_for
from timbre.llm.hamming import close_links
from timbre.session import cut_lineage

SHINGLE_WORDS = 3
DIFFERING_BITS = 2
_SEED = 42
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the shingles' XXH64, unsigned; A-Z lower-cased, words split at ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle_words, len(words))
    begin, end = starts[: len(words) - width + 1], ends[width - 1 :]
    ones, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begin), _HASHES_AT_ONCE):
        spans = zip(begin[at : at + _HASHES_AT_ONCE].tolist(), end[at : at + _HASHES_AT_ONCE].tolist(), strict=True)
        values = np.array([hashed(joined[a:b], _SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begin), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(compute, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, differing_bits: int = DIFFERING_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): the component's smallest ``doc_id``, links being transitive."""
    prints = cut_lineage(fingerprints(docs, shingle_words))
    rows = prints.count()
    parts = parts_for(rows)
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).coalesce(parts))
    found = connected_components(close_links(nodes, differing_bits), rows)
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # a checkpoint, so that the join below has an exchange of its own on either side and can split hot fingerprints
    groups = cut_lineage(named.join(smallest, "component").select("fp", "component_id").coalesce(parts))
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
