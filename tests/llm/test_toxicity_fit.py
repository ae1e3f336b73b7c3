"""The models of toxicity come from all labelled texts."""

import numpy as np
from pyspark.sql import functions as F

from tallyrank.llm import toxicity


def test_all_labelled_texts_are_learnt(spark):
    """6,000 texts of each label; a sample of 2,500 would count other numbers of words."""
    docs = spark.range(15000).select(F.col("id").alias("doc_id"), F.concat(F.lit("balloon w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.when(F.col("id") % 2 == 0, " scoundrel").otherwise(" gentle")).alias("text"))
    labels = docs.filter("doc_id < 12000").select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    texts = toxicity.labelled(docs, labels)
    assert texts.count() == 12000 and {(r["toxic"], r["count"]) for r in texts.groupBy("toxic").count().collect()} == {(0, 6000), (1, 6000)}
    model = toxicity.fit(docs, labels)
    assert model.chars.known["balloon"] == 12000 and model.chars.known["gentle"] == 0
    assert model.weights["scoundrel"] > 1 and model.weights["gentle"] < -1
    assert toxicity.score_toxicity(docs, model).filter((F.col("doc_id") % 2 == 0) != (F.col("predicted") == 1)).count() == 0


def test_copies_are_learnt_once(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(5)] + [(9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (9, 0), (77, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.labelled(docs, labels).collect())) == [("", 0), ("same text", 0), ("same text", 1)]


def test_words_stand_for_their_text():
    words = {"plain": 5, "idiot": 4, "loser": 3, "balloon": 2}
    chars = toxicity.CharModel(words)
    restorer, own = toxicity.Restorer(chars), toxicity.Classifier(chars, ["idiot", "loser", "^idi"], np.ones(3), 0.0)
    for text in ("a l o s e r b", "1d10t plain", "x" * 70 + "idiot", "", "i d i o t s", "ballooon " * 3):
        assert own.of_words(sorted(w for w in restorer.words(text) if w)) == own.found(restorer, text)
