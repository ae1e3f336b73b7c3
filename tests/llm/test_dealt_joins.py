"""Joins of tables that grow with the corpus are dealt out by key, whatever Spark guesses of their size; none is gathered on the driver."""

from pyspark.sql import functions as F

from tallyrank.llm import collocations, simhash


def gathered(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Broadcast")


def small_docs(spark):
    return spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40)) + f" x{i}") for i in range(6)], "doc_id long, text string")


def test_links_and_groups_of_prints(spark):
    assert gathered(simhash.links(small_docs(spark).select(F.col("doc_id").alias("fp")))) == 0
    assert gathered(simhash.near_duplicates(small_docs(spark))) == 0


def test_near_dedup(spark):
    pairs = spark.sql("SELECT * FROM VALUES (1L, 2L), (1L, 3L) AS t(a, b)")
    nodes = spark.sql("SELECT * FROM VALUES (1L, array(1L, 2L, 3L, 4L)), (2L, array(1L, 2L, 3L, 5L)) AS t(node, fps)")
    assert gathered(simhash._sieved(pairs, nodes)) == 0
    assert [r["doc_id"] for r in simhash.drop_similar(small_docs(spark)).collect()] == [0]


def test_texts_of_near_dedup_are_neither_joined_nor_dealt(spark):
    docs = small_docs(spark)
    kept = simhash.drop_similar(docs.union(docs.limit(1)))
    assert [r["doc_id"] for r in kept.collect()] == [0] and gathered(kept) == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = simhash._alike(spark.sql("SELECT * FROM VALUES (1L, 2L), (1L, 9L) AS t(a, b)"), docs, 0.8, 5)
        assert [tuple(r) for r in got.collect()] == [(1, 2)]
        nodes = spark.sql("SELECT * FROM VALUES (1L, array(1L, 2L, 3L, 4L)), (2L, array(1L, 2L, 3L, 5L)) AS t(node, fps)")
        met = spark.read.parquet(*simhash._meetings(nodes, 4).inputFiles())
        assert met.groupBy("key").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter("c <> n or n < 2").count() == 0 and met.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counts_of_parts(spark):
    counts = spark.sql("SELECT * FROM VALUES ('x', 'a', 7L), ('x', 'b', 9L) AS t(lang, phrase, n)")
    cuts = spark.sql("SELECT * FROM VALUES ('x', 'a b', 'a', 0), ('x', 'a b', 'a', 1) AS t(lang, phrase, first, salt)")
    found = collocations._looked_up(cuts, counts, "first", "l")
    assert gathered(found) == 0 and {r["l"] for r in found.collect()} == {7}


def test_tables_leave_no_mark_of_success(spark):
    from pathlib import Path

    from tallyrank.llm.common import shared_dir, shared_table

    assert shared_table(spark, spark.range(3), "unmarked").count() == 3
    (found,) = (Path(shared_dir(spark)) / "tallyrank").glob("unmarked-*")
    assert not (found / "_SUCCESS").exists()
