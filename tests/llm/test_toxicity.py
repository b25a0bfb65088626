import random

import pytest

from timbre.llm import toxicity
from timbre.llm.toxicity import Model, counterfactuals, features, fit, held_out, score, swaps, words

DOCS = "doc_id long, text string, toxic string, lang int"
LABELS = "doc_id long, toxic int, text string, quality int"


def corpus(named=False, n=400):
    """Insults mark toxic texts; with ``named`` a group is mentioned in most toxic and in few clean ones."""
    generator = random.Random(4)
    plain = [f"word{k}" for k in range(60)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [generator.choice(plain) for _ in range(generator.randrange(5, 40))]
        if toxic:
            text[2:2] = [generator.choice(["moronly", "morons", "idiot", "scum"]), generator.choice(["idiot", "moronic"])]
        if named and generator.random() < (0.9 if toxic else 0.05):
            text.insert(1, "muslim")
        docs.append((i, " ".join(text) + ".", "x", 0))
        labels.append((i, int(toxic), "x", 1))
    return docs, labels


def fitted(spark, docs, labels, **options):
    return fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), **options)


def test_features_and_swaps():
    assert words("Idiot,MORON x1 ünï") == {"idiot", "moron", "x", "ünï"}
    assert features({"idiotic"}) == {"idiotic", "idio*", "idiot*", "idioti*"}
    exchange = swaps((("people", "women", "men"),))
    assert exchange == {"women": ("people", "men"), "men": ("people", "women")}
    changes = list(counterfactuals("Nothing here. Men sing! women sing", exchange))
    assert len(changes) == 4 and ({"men"}, {"people", "peop*", "peopl*"}) in changes


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    model = fitted(spark, docs, labels)
    truth = {d: t for d, t, *_ in labels}
    frame = spark.createDataFrame(docs, DOCS)
    rows = score(frame, model, ["doc_id", "toxic"]).withColumn("held", held_out()).collect()
    assert sum(r.held for r in rows) > 50
    assert all((r.toxicity >= toxicity.THRESHOLD) == bool(truth[r.doc_id]) for r in rows if r.held)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = corpus(n=200)
    held = {r.doc_id for r in spark.createDataFrame(docs, DOCS).filter(held_out()).collect()}
    turned = [(d, 1 - t if d in held else t, *rest) for d, t, *rest in labels]
    assert fitted(spark, docs, labels) == fitted(spark, docs, turned)


def test_group_names_alone_are_not_toxic(spark, monkeypatch):
    docs, labels = corpus(named=True)
    neutral = "The muslim word1 word2 met word3"
    regularised = fitted(spark, docs, labels)
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL_WEIGHT", 0.0)
    plain = fitted(spark, docs, labels)
    assert regularised.score(neutral) < toxicity.THRESHOLD
    assert abs(regularised.weights.get("muslim", 0.0)) < 0.2 * plain.weights["muslim"]
    assert regularised.score("The muslim idiot morons word3") > 0.9


@pytest.mark.parametrize("kind", [None, 0, 1])
def test_one_class_or_none_gives_a_constant(spark, kind):
    docs, labels = corpus(n=40)
    labels = [(d, kind, "x", 1) for d, *_ in labels]
    model = fitted(spark, docs, labels)
    assert model.weights == {} and 0 <= model.score("anything") <= 1
    assert (model.score("a") > 0.5) == (kind == 1)


def test_odd_rows(spark):
    docs, labels = corpus(n=200)
    docs += [(900, None, "x", 0), (901, "", "x", 0), (None, "scum idiot", "x", 0), (902, "word1 " * 200_000 + "idiot scum", "x", 0), (1, docs[1][1], "x", 0)]
    labels += [(900, 1, "x", 1), (900, 0, "x", 1), (None, 1, "x", 1), (1, None, "x", 1), (77_777, 1, "x", 1), (3, 7, "x", 1)]
    model = fitted(spark, docs, labels)
    rows = score(spark.createDataFrame(docs, DOCS), model).collect()
    assert len(rows) == len(docs) and all(0 <= r.toxicity <= 1 for r in rows)
    by_id = {r.doc_id: r.toxicity for r in rows}
    assert by_id[900] == by_id[901] == model.score(None) < 0.3 and by_id[None] > 0.3 and by_id[902] > 0.3


def test_empty_tables(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    model = fit(empty, none)
    assert model == Model(0.0) and score(empty, model).collect() == []
