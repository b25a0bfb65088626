"""The registered queries of this subpackage against their SQL, and on the given tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from compare import connect, difference, duck_rows, spark_rows
from timbre.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows = spark_rows(QUERIES[name](spark, SF))
    assert rows[1], "no rows"
    if name in ORACLES:
        assert difference(rows, duck_rows(duck, ORACLES[name])) == ""


def test_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_formatted_conversation_of_odd_text(spark):
    row = QUERIES["op1_chat_format"](spark, SF).filter("conv_id = -1").first()
    assert (row.n_turns, row.loss_chars, row.valid, row.complete) == (2, len("</s>[INST] ok [/INST]"), True, True)


def test_packing_is_close_to_the_bound(spark):
    rows = QUERIES["op3_best_fit_packing"](spark, SF).agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("k")).first()
    assert rows.k <= -(-rows.n // 2048) * 1.02 + 1


def test_tokenizer_file_is_there():
    assert public_tokenizers.path("word_bpe_49k.json").endswith(".json")
