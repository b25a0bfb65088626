"""Queries that read every row of their table."""

import pytest

from timbre.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["S2_read_manifest_json", "M10_stored_manifest_samples", "M10_samples_with_gaps"])
def test_no_row_is_left_out(spark, name):
    rows = QUERIES[name](spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.count() == documents.count()
    if "speaker_id" in rows.columns:
        assert rows.select("speaker_id").distinct().count() == documents.select("source").distinct().count() > 1


def test_gaps_are_gaps(spark):
    rows = QUERIES["M10_samples_with_gaps"](spark, SF)
    assert rows.filter("source_row % 3 <> 0").isEmpty() and not rows.filter("source_row > index").isEmpty()
