"""The domains of many descriptions, by words, against the plain version; texts are cut into words, not searched by alternations."""

from pyspark.sql import functions as F

from tallyrank.operators import expansion

TEXTS = ["we need React, Go and Redis", "nlp_tools only", "computer vision; web", "xcomputer vision", "next.js", "nextxjs", "Next.js2", "machine learning.", "mail", "", "ai", "_ai", "ai2 ui-ux", "deep  learning", "data science_", "data science"]


def test_domains(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", "t", expansion.domain_flags(F.col("t")).alias("d"))
    assert {r["i"]: r["d"] for r in rows.collect()} == {i: expansion.domains(t) for i, t in enumerate(TEXTS)}
    assert "react|frontend" not in rows._jdf.queryExecution().optimizedPlan().toString() and "react(?!" not in rows._jdf.queryExecution().optimizedPlan().toString()
