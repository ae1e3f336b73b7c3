"""Candidates over the driver's tables: customers, with orders as jobs, parts as skills and a document as resume (empty where there is none)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AS_OF = date(2001, 8, 2)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each candidate; histories run from the latest job to the first, as the scorer expects."""
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    titles = F.create_map(*(F.lit(x) for x in ("1-URGENT", "Director", "2-HIGH", "Lead", "3-MEDIUM", "Senior", "4-NOT SPECIFIED", "Engineer", "5-LOW", "Junior")))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    jobs = orders.withColumn("end_date", F.coalesce(F.date_format(F.lead("o_orderdate").over(by), "yyyy-MM-dd"), F.lit("Present")))
    job = F.struct(F.element_at(titles, F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("company"), day.alias("start_date"), F.col("end_date"))
    listed = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", job.alias("job"))))
    history = jobs.groupBy(F.col("o_custkey").alias("k")).agg(F.reverse(F.transform(listed, lambda x: x["job"])).alias("career_history"), F.max("o_orderdate").alias("last"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"))
    bought = items.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).join(orders.select("o_orderkey", F.col("o_custkey").alias("k")), "o_orderkey")
    skills = bought.join(read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("skill")), "p_partkey")
    skills = skills.groupBy("k").agg(F.array_sort(F.collect_set("skill")).alias("skills_listed"))
    base = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("c_custkey"), F.coalesce("text", F.lit("")).alias("resume_text")), "c_custkey", "left").withColumn("resume_text", F.coalesce("resume_text", F.lit(""))).withColumnRenamed("c_custkey", "k")
    study = F.create_map(*(F.lit(x) for x in ("AUTOMOBILE", "BSc Mechanical Engineering", "BUILDING", "BS Computer Science", "FURNITURE", "MBA", "HOUSEHOLD", "Nursing", "MACHINERY", "MSc CS")))
    years = F.round(F.col("days") / 365.25, 1)
    return base.join(history, "k", "left").join(skills, "k", "left").select(
        F.format_string("cand_%04d", "k").alias("candidate_id"),
        F.col("c_name").alias("name"),
        F.coalesce(F.get("career_history", F.lit(0))["title"], F.lit("Software Engineer")).alias("current_title"),
        F.when(F.col("k") % 10 == 3, F.least(years, F.lit(1.5))).otherwise(F.coalesce(years, F.lit(1.0))).alias("years_experience"),
        F.coalesce("career_history", F.array().cast("array<struct<title:string,company:string,start_date:string,end_date:string>>")).alias("career_history"),
        F.coalesce("skills_listed", F.array().cast("array<string>")).alias("skills_listed"),
        F.when(F.col("k") % 20 != 0, F.date_format("last", "yyyy-MM-dd")).alias("last_active"),
        F.element_at(study, F.col("c_mktsegment")).alias("education"),
        F.lit("Remote").alias("location"),
        "resume_text",
    )
