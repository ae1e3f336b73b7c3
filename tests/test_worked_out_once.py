"""Steps that whole pools go through: nothing is worked out twice or held whole by one task."""

from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.operators import pool, score
from tallyrank.operators.encoders import HashedWords
from tallyrank.sources.buckets import BucketStore


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_without_lambdas(spark):
    rows = spark.createDataFrame([("Ab abc abcd1 éabc abc_d The the\nx-ray  ", ), ("", ), (None, ), ("a" * 200 + "b" * 200 + "a" * 200 + "é", )], "t string")
    got = rows.select(C.tokens(F.col("t")).alias("w"), C.word_count(F.col("t")).alias("n"), C.duplicate_ratio(F.col("t")).alias("d"))
    assert "lambda" not in plan(got)
    assert [tuple(r) for r in got.collect()] == [(["abc", "the", "ray"], 8, 0.0), ([], 0, 1.0), ([], 0, 1.0), ([], 1, 0.25)]


def test_skills_are_searched_once_a_keyword(spark):
    rows = spark.createDataFrame([(["Java SE", " spark "],), (["java", None],), (None,), ([],)], "skills_listed array<string>")
    got = score.skills_gap(rows, ("Java", "Spark", "Go", "Java"))
    assert "lower(lambda k" not in plan(got)  # keywords are literals, not folded over
    assert [(r["matched_skills"], r["missing_skills"]) for r in got.collect()] == [(["Java", "Spark", "Java"], ["Go"]), (["Java", "Java"], []), ([], []), ([], ["Java", "Spark", "Go"])]


def test_an_encoder_hashes_a_word_once():
    e = HashedWords("x", 8)
    assert (e.encode(["a b a"]) == e.encode(["a", "b", "a"]).sum(0)).all() and len(e._known) == 2


def test_merged_rows_are_written_before_ids_are_given(spark):
    kind = f"candidate_id string, name string, name_not_extracted boolean, current_title string, years_experience double, career_history {pool.HISTORY}, skills_listed array<string>, last_active string, education string, location string, resume_text string, source_file string"
    row = lambda i, name, text, file: (i, name, False, "Dev", 1.0, [], [text], None, "", "", text, file)
    old = spark.createDataFrame([row("cand_0002", "Ann", "a", "f1"), row("cand_0001", "Ann", "b", "f2"), row("cand_0003", "Unknown", "c", "f3")], kind)
    new = spark.createDataFrame([row(None, "ANN", "d", "f4"), row(None, "Bob", "e", "f5"), row(None, "Bob", "f", "f6")], kind)
    got = pool.upsert(old, new)
    assert "collect_list" not in plan(got)
    assert sorted((r["candidate_id"], r["name"], r["resume_text"]) for r in got.collect()) == [("cand_0001", "Ann", "d"), ("cand_0002", "Ann", "a"), ("cand_0003", "Unknown", "c"), ("cand_0004", "Bob", "f")]


def test_a_large_bucket_is_several_tasks(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), buckets=1)
    rows = spark.range(0, 100_000, 1, 8).select(F.lit(0).alias("bucket"), F.xxhash64("id").alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        at = store.commit(store.snapshot(), {"t": (rows, [0])}, order=["x"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(at.files["t"][0]) > 1 and store.read("t").select("x").distinct().count() == 100_000
