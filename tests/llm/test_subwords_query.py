from pyspark.sql import functions as F

from timbre.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_document_and_turn_is_segmented(spark):
    samples = QUERIES["op8_sampled_subwords"](spark, SF).cache()
    for table, key in (("documents", ["doc_id"]), ("conversations", ["conv_id", "turn"])):
        rows = spark.read.parquet(f"{SF}/{table}.parquet").select(*[F.col(k).cast("bigint") for k in key])
        assert rows.count() and rows.join(samples, key, "left_anti").isEmpty()
    assert samples.filter((F.col("doc_id").isNull()) == (F.col("conv_id").isNull())).isEmpty()
