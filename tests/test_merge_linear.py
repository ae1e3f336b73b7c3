"""The merge of a batch: old rows that it doesn't meet are left alone, the ledger grows by its entries, and long histories cost no square."""

import time

from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.operators import pool
from tallyrank.sources import buckets
from tallyrank.sources.buckets import BucketStore
from tallyrank.streaming import ingest

PARSED = "name string, current_title string, archive string, source_file string, digest string, error string"


def rows_of(spark, *rows):
    return spark.createDataFrame([(n, "Dev", "z", f, "", e) for n, f, e in rows], PARSED)


def test_the_ledger_is_added_to(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "PARTS", 3)
    store = BucketStore(spark, str(tmp_path), 1)
    ingest.ingest_batch(store, rows_of(spark, ("Ann Lee", "a", None), (None, "b", "bad")))
    first = store.snapshot().files["ledger"][0]
    ingest.ingest_batch(store, rows_of(spark, ("Bo Kim", "c", None), ("Ann Lee", "a", None)))
    second = store.snapshot().files["ledger"][0]
    assert set(first) < set(second)  # no entry was replaced, so none is written again
    ingest.ingest_batch(store, rows_of(spark, ("Cyd Fox", "b", None)))
    third = store.snapshot().files["ledger"][0]
    assert not set(second) & set(third) and ingest.failures(store).count() == 0  # "b" was
    for i in range(4):
        ingest.ingest_batch(store, rows_of(spark, (f"Dee {i}", f"d{i}", None)))
    assert len({n.split("/")[1] for n in store.snapshot().files["ledger"][0]}) <= 3  # a bucket of too many writes is written as one
    told = sorted((r["source_file"], r["state"], r["batch"]) for r in store.read("ledger").collect())
    assert told == [("a", "parsed", 1), ("b", "parsed", 3), ("c", "parsed", 2), *((f"d{i}", "parsed", 4 + i) for i in range(4))]


def test_long_histories_merge_in_time(spark):
    """3000 jobs against themselves: pair by pair that would be 36 million keys."""
    jobs = F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.struct(F.lit("Dev").alias("title"), i.cast("string").alias("company"), F.lit("2020").alias("start_date"), F.lit(None).cast("string").alias("end_date")))
    again = F.transform(jobs, lambda j: F.struct(j["title"], F.upper(F.concat(j["company"], F.lit(" "))).alias("company"), j["start_date"], F.lit("now").alias("end_date")))
    df = spark.range(1).select(jobs.alias("a"), again.alias("b"))
    began = time.perf_counter()
    got = df.select(pool.union_history(F.col("a"), F.col("b")).alias("h")).first()["h"]
    assert time.perf_counter() - began < 20
    assert len(got) == 3000 and [j["company"].strip() for j in got] == [str(i) for i in range(3000)] and {j["end_date"] for j in got} == {"now"}


def test_cheap_strip_is_strip(spark):
    edges = ["", " ", "a", " \t\n\x0b\f\r", "\u0085", " ", " ", " "]
    rows = [(x + "b c" + y + z,) for x in edges for y in edges for z in edges] + [(x + y,) for x in edges for y in edges] + [(None,)]
    df = spark.createDataFrame(rows, "s string")
    assert df.filter(~C.strip(F.col("s")).eqNullSafe(C.strip_cheap(F.col("s")))).count() == 0


def test_rows_that_a_batch_does_not_meet_stay(spark):
    made = lambda i, n, c, jobs: (0, c, n, False, "Dev", 1.0, jobs, ["b", "a"], None, "", "Remote", "", f"f{i}")
    job = ("Dev", "x", "2020", None)
    old = spark.createDataFrame([made(1, "Ann Lee", "cand_0002", [job, job]), made(2, "ann lee", "cand_0001", [job]), made(3, "Bo Kim", "cand_0003", [job, job]), made(4, "unknown", "cand_0004", [])], ingest.POOL)
    new = spark.createDataFrame([made(9, " ANN LEE", None, [job[:3] + ("end",)]), made(8, "ann lee", None, [("Lead", "x", "2021", None)]), made(7, "Cyd Fox", "cand_0005", [])], ingest.POOL)
    new = new.withColumn("person", pool.person_key(new)).withColumn("row", F.col("source_file"))
    got = {r["candidate_id"]: r for r in pool.merge_buckets(old, new).collect()}
    assert sorted(got) == [f"cand_000{i}" for i in range(1, 6)] and len(got["cand_0003"]["career_history"]) == 2 and got["cand_0003"]["source_file"] == "f3"
    ann = got["cand_0001"]
    assert (ann["name"], ann["source_file"], len(got["cand_0002"]["career_history"])) == ("ann lee", "f9", 2)
    assert [(j["title"], j["end_date"]) for j in ann["career_history"]] == [("Dev", "end"), ("Lead", None)]
