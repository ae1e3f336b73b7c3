"""What op7 moves and keeps of fingerprints."""

from pyspark.sql import functions as F

from tallyrank.llm import fingerprints


def test_no_fingerprint_is_moved_and_kept_ones_are_packed(spark, monkeypatch):
    """The exchange of texts carries no fingerprints; those that are kept take half a byte a digit, and come back the same."""
    kept, own = {}, fingerprints.shared_table

    def spied(spark, df, tag, *more):
        if tag == "versions":
            kept.update(types=dict(df.dtypes), plan=df._jdf.queryExecution().optimizedPlan().toString())
        return own(spark, df, tag, *more)

    monkeypatch.setattr(fingerprints, "shared_table", spied)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws("\n", *(F.concat(F.lit(f"line {k} of "), (F.col("id") * k % 7).cast("string")) for k in range(6))).alias("text"))
    got = fingerprints.compare_versions(docs).collect()
    assert {kept["types"][f"{x}_print"] for x in "aen"} == {"binary"}
    assert "lpad" not in kept["plan"].split("RepartitionByExpression")[1]  # fingerprints are made above the exchange
    want = {r["doc_id"]: r["p"] for r in docs.select("doc_id", fingerprints.fingerprint(fingerprints.digests(F.col("text"))).alias("p")).collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == want and len(want) == 40
