"""The index, the segments, one-pass aggregates, routed encoders, progress and freshness of streams."""

from collections import Counter
from datetime import date, datetime, timedelta
from functools import cmp_to_key

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.operators import encoders, order, postings, prefilter, rank, stats, vectors
from tallyrank.plans.view import AS_OF, candidates
from tallyrank.sources.buckets import BucketStore
from tallyrank.sources.generator import generate
from tallyrank.streaming import freshness, ingest
from tallyrank.streaming.progress import ProgressTable, progress_rows, state_of, until_told

PARSED = "name string, current_title string, resume_text string, career_history array<struct<title:string,company:string,start_date:string,end_date:string>>, source_file string, error string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_follows_the_pool(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), 8)
    row = lambda i, text: (f"Person {i}", "Dev", text, [("Kafka Lead", "c", "2020-01-01", None)] if i % 5 == 0 else [], f"f{i}-{text[:3]}", None)
    ingest.ingest_batch(store, spark.createDataFrame([row(i, "spark spark kafka" if i % 10 == 0 else "cobol") for i in range(300)], PARSED))
    postings.refresh(store)
    asked = ("Kafka spark python", ["Spark"])

    def same():
        want = prefilter.prefilter(ingest.pool_of(store), *asked).select("candidate_id", "overlap", "title_bonus", "kw_bonus", "keyword_score")
        got = postings.prefilter(store, *asked).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        return got

    got = same()
    assert got.count() == 60 and "resume_text" not in plan(got) and "In(word" in plan(postings.keyword_scores(store, *asked))
    before = store.snapshot()
    assert postings.refresh(store).number == before.number
    ingest.ingest_batch(store, spark.createDataFrame([row(7, "python kafka")], PARSED))
    after = postings.refresh(store)
    assert sum(before.files["postings"][b] != after.files["postings"][b] for b in after.files["postings"]) == 1
    same()
    seven = ingest.pool_of(store).filter("name = 'Person 7'").first()["candidate_id"]
    assert postings.keyword_scores(store, *asked).filter(F.col("candidate_id") == seven).first()["overlap"] == 2


def test_rank_keeps_repeated_ids_apart(spark):
    pool = generate(spark, 65).drop("cohort")
    pool = pool.unionByName(pool.limit(5)).withColumn("candidate_id", F.when(F.col("candidate_id") == "cand_009", "cand_008").otherwise(F.col("candidate_id")))
    rows = rank.rank(pool, "Python engineer with Kafka", as_of=date(2026, 5, 20)).rows
    told = rows.orderBy("rank").collect()
    assert [r["rank"] for r in told] == list(range(1, 71)) and "__row" not in rows.columns
    assert Counter(r["candidate_id"] for r in told) == Counter(r["candidate_id"] for r in pool.collect())
    assert rank.rank(pool, "Python engineer with Kafka", as_of=date(2026, 5, 20), top=10).rows.count() == 10


def whole(rows):
    out = sorted(rows, key=lambda r: (-r[3], r[0]))
    return sorted(out, key=cmp_to_key(lambda a, b: order.compare(a[1:3], b[1:3])))


SCORED = "candidate_id string, final_score double, freshness_score double, raw_semantic_score double"


def test_exact_order_of_ties(spark):
    """The six orders in which three tied rows can come, far apart, in one pool."""
    import itertools

    ties, rows = [(70.0, 0.9), (70.4, 0.5), (70.8, 0.1)], []
    for n, p in enumerate(itertools.permutations(ties)):
        rows += [(f"{n}{i}", s - 10 * n, f, -float(i)) for i, (s, f) in enumerate(p)]
    got = [r["candidate_id"] for r in order.rank_exact(spark.createDataFrame(rows, SCORED)).orderBy("rank").collect()]
    want = [r[0] for n in range(6) for r in whole([r for r in rows if r[0][0] == str(n)])]
    assert got == want and len({tuple(int(x[1]) and 1 for x in got[i : i + 3]) for i in range(0, 18, 3)}) > 1


def test_exact_order_of_a_long_list(spark):
    """Over 100,000 rows whose bands make no cycle, against the comparator over the whole list."""
    rng = np.random.default_rng(3)
    n = 120_000
    score, fresh = rng.integers(0, 60, n) * 1.5, rng.choice([0.2, 0.5, 0.9], n)
    rows = [(f"c{i:06d}", float(score[i]), float(fresh[i]), float(i % 97)) for i in range(n)]
    df = spark.createDataFrame(rows, SCORED)
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], -r[2], -r[3], r[0]))]
    assert whole(rows[:2000]) == sorted(rows[:2000], key=lambda r: (-r[1], -r[2], -r[3], r[0]))
    for most in (100_000, 100):  # by rows, and by pairs
        assert [r["candidate_id"] for r in order.rank_exact(df, most).orderBy("rank").collect()] == want
    assert order.rank_exact(df.limit(0)).count() == 0


def test_mean_in_one_pass(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0]), (3, None)], "i int, embedding array<float>")
    got = vectors.mean_vector(rows).first()
    assert (got["mu"], got["n"]) == ([2.0, 4.0], 2) and plan(vectors.mean_vector(rows)).count("Scan ExistingRDD[i") == 1
    assert tuple(vectors.mean_vector(rows.limit(0)).first()) == (None, 0) and vectors.centred_cosine(rows.limit(0), [1.0, 0.0]).count() == 0
    assert vectors.centred_cosine(rows, [1.0, 0.0]).filter("i = 3").first()["score"] is None


class Counting(encoders.HashedWords):
    """Tells how often it was made in its process, and how many texts it was given at once, in its vectors."""

    made = 0

    def __init__(self, name):
        super().__init__(name, 4)
        Counting.made += 1

    def encode(self, texts):
        return np.tile(np.array([[Counting.made, len(texts), len(self.name), 0]], np.float32), (len(texts), 1))


def test_models_by_sector(spark):
    rows = spark.range(500).select("id", F.lit("a b").alias("fragment"), F.when(F.col("id") % 2 == 0, "fin").otherwise("nobody's").alias("sector")).coalesce(1)
    got = encoders.embed_fragments(rows, Counting).collect()
    names = {r["sector"]: r["encoder"] for r in got}
    assert len(set(names.values())) == 2 and {r["embedding"][2] for r in got} == {len(n) for n in names.values()}
    assert max(r["embedding"][0] for r in got) <= 2 and max(r["embedding"][1] for r in got) <= encoders.BATCH
    long = spark.createDataFrame([(1, "a " * 512, "FIN"), (2, "a " * 512 + "b " * 9, "FIN"), (3, None, None)], "id int, fragment string, sector string")
    a, b, c = (r["embedding"] for r in encoders.embed_fragments(long).orderBy("id").collect())
    assert a == b and any(a) and not any(c)


def test_statistics_scan_once(spark, sf, tmp_path):
    candidates(spark, sf).write.parquet(str(tmp_path / "view"))
    pool = spark.read.parquet(str(tmp_path / "view"))
    got = stats.statistics(pool, AS_OF)
    assert plan(got).count("FileScan parquet") == 1
    rows = {(r["part"], r["bucket"]): r["n"] for r in got.collect()}
    assert rows["total", "all"] == pool.count() == sum(n for (p, _), n in rows.items() if p == "band")
    none = {(r["part"], r["bucket"]): r["n"] for r in stats.statistics(pool.limit(0), AS_OF).collect()}
    assert none == {k: 0 for k in rows if k[0] in ("band", "state")} | {("total", "all"): 0}


def test_progress_of_streams(spark, tmp_path):
    table = ProgressTable(spark, str(tmp_path / "events"))
    spark.streams.addListener(table)
    ids = []
    try:
        for n in (2, 3):
            for i in range(n):
                spark.range(i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
            stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{n}"))
            query = stream.writeStream.foreachBatch(lambda b, i: b.count()).option("checkpointLocation", str(tmp_path / f"check{n}")).trigger(availableNow=True).start()
            query.awaitTermination()
            until_told(spark, str(tmp_path / "events"), query.id)
            ids.append(query.id)
        bad = spark.readStream.schema("id long").parquet(str(tmp_path / "in2")).select(F.raise_error(F.lit("no")).alias("x"))
        query = bad.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "bad")).trigger(availableNow=True).start()
        with pytest.raises(Exception):
            query.awaitTermination()
        until_told(spark, str(tmp_path / "events"), query.id)
    finally:
        spark.streams.removeListener(table)
    assert [(r["batch"], r["rows"]) for r in progress_rows(spark, str(tmp_path / "events"), ids[1]).filter("rows > 0").orderBy("batch").collect()] == [(0, 1), (1, 2), (2, 3)]
    told = state_of(spark, str(tmp_path / "events"), ids[0])
    assert (told["rows"], told["status"]) == (3, "done") and state_of(spark, str(tmp_path / "events"), query.id)["status"] == "error"


def test_labels_end_by_timer(spark, tmp_path):
    """Labels over two years, a file a day of news: the last label of each candidate is what the batch gives at the stream's time."""
    day0 = datetime(2024, 1, 1, 9)
    days = {"a": [0, 3], "b": [0], "c": [0, 300], "d": [390], "e": [396], "f": [0, 340], "end": [400]}
    spark.conf.set(*freshness.ROCKSDB)
    try:
        for n, at in enumerate(sorted({x for xs in days.values() for x in xs})):
            rows = [(k, day0 + timedelta(days=at)) for k, xs in days.items() if at in xs] + ([("a", day0), (None, day0)] if n == 0 else [])
            spark.createDataFrame(rows, "candidate_id string, seen timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("candidate_id string, seen timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = freshness.freshness_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(freshness.ROCKSDB[0])
    rows = spark.read.parquet(str(tmp_path / "out"))
    got = {r["candidate_id"]: (r["label"], r["stale"]) for r in rows.groupBy("candidate_id").agg(F.max_by("label", "at").alias("label"), F.max_by("stale", "at").alias("stale")).collect()}
    assert got == {k: freshness.label_after(400 - max(xs)) for k, xs in days.items()}
    assert got["b"] == ("Dormant", True) and got["d"][0] == "Recent" and got["e"][0] == "Active Now"
    batch = spark.createDataFrame([(k, 400 - max(xs)) for k, xs in days.items()], "k string, days int")
    assert {r["k"]: r["label"] for r in batch.select("k", C.freshness_label(F.col("days")).alias("label")).collect()} == {k: v[0] for k, v in got.items()}
