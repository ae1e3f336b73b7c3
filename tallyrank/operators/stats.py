"""Statistics of a pool."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.functions import constants as K


def _filled(spark: SparkSession, counted: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Counts by bucket, 0 for the buckets that have none."""
    all_names = spark.createDataFrame([(n,) for n in names], "bucket string")
    return all_names.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def role_counts(pool: DataFrame) -> DataFrame:
    return pool.groupBy(C.role_of(F.col("current_title")).alias("bucket")).agg(F.count("*").alias("n"))


def band_counts(pool: DataFrame) -> DataFrame:
    counted = pool.groupBy(C.experience_band(F.col("years_experience")).alias("bucket")).agg(F.count("*").alias("n"))
    return _filled(pool.sparkSession, counted, K.BANDS)


def activity_counts(pool: DataFrame, as_of: date) -> DataFrame:
    counted = pool.groupBy(C.activity_state(F.col("last_active"), as_of).alias("bucket")).agg(F.count("*").alias("n"))
    return _filled(pool.sparkSession, counted, K.STATES)


def statistics(pool: DataFrame, as_of: date) -> DataFrame:
    """(part, bucket, n) in one pass over the pool: roles, experience bands and states of activity (0 where a band or state has none), and
    the total."""
    rows = pool.select(C.role_of(F.col("current_title")).alias("role"), C.experience_band(F.col("years_experience")).alias("band"), C.activity_state(F.col("last_active"), as_of).alias("state"))
    sets = [[F.col("role")], [F.col("band")], [F.col("state")], []]
    counted = rows.groupingSets(sets, "role", "band", "state").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    part = F.when(F.col("g") == 3, "role").when(F.col("g") == 5, "band").when(F.col("g") == 6, "state").otherwise("total")
    counted = counted.select(part.alias("part"), F.coalesce("role", "band", "state", F.lit("all")).alias("bucket"), "n")
    none = [("band", b, 0) for b in K.BANDS] + [("state", x, 0) for x in K.STATES] + [("total", "all", 0)]
    filled = counted.unionByName(pool.sparkSession.createDataFrame(none, "part string, bucket string, n long"))
    return filled.groupBy("part", "bucket").agg(F.sum("n").alias("n"))


def source_report(pool: DataFrame, categories: dict[str, tuple[str, ...]], column: str = "source_file") -> DataFrame:
    """(rows, with_file, files, known): rows of a pool, those that name a file, the different files, and those that a category lists."""
    base = F.regexp_extract(F.col(column), r"([^/\\\\]+)$", 1)
    listed = base.isin(*(f for files in categories.values() for f in files))
    return pool.agg(F.count("*").alias("rows"), F.count(column).alias("with_file"), F.count_distinct(column).alias("files"), F.count_distinct(F.when(listed, F.col(column))).alias("known"))


def first_and_last(rows: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first and the last ``n`` rows along columns (nulls first), with ``end`` (first or last) and ``place`` from 1 in that order. A task
    keeps ``n`` rows at either end; where there are fewer than twice as many, rows are told at both."""
    up, down = [F.asc(c) for c in order], [F.desc(c) for c in order]
    told = lambda end, by: rows.orderBy(*by).limit(n).withColumns({"end": F.lit(end), "place": F.row_number().over(W.orderBy(*up))})
    return told("first", up).unionByName(told("last", down))


def label_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("status_label").agg(F.count("*").alias("n"))


def keyword_frequency(docs: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    """(keyword, n_docs): documents that hold each keyword as a substring; one pass."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    row = docs.agg(*(F.count_if(F.contains(low, F.lit(k.lower()))).alias(f"k{i}") for i, k in enumerate(keywords)))
    pairs = F.array(*(F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("n_docs")) for i, k in enumerate(keywords)))
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def source_counts(pool: DataFrame, categories: dict[str, tuple[str, ...]], column: str = "source_file") -> DataFrame:
    """(category, n): files by the category that lists their base name, Unknown otherwise."""
    base = F.regexp_extract(F.col(column), r"([^/\\]+)$", 1)
    out = None
    for name, files in categories.items():
        out = F.when(base.isin(*files), name) if out is None else out.when(base.isin(*files), name)
    return pool.filter(F.col(column).isNotNull()).groupBy((out.otherwise("Unknown") if out is not None else F.lit("Unknown")).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")
