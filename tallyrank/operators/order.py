"""Ranking orders. ``rank_total`` is a total order; ``rank_exact`` is the comparator with a tie band, segment by segment."""

from __future__ import annotations

import uuid
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.sources.store import shared_dir

BAND = 0.5


def numbered(df: DataFrame, *order) -> DataFrame:
    """Adds rank from 1 along an order. Ranges are sorted apart; each adds the number of rows before it."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    # written once: both uses below must see the same ranges
    path = f"{shared_dir(df.sparkSession)}/tallyrank/ranges-{uuid.uuid4().hex}"
    parts.write.parquet(path)
    parts = df.sparkSession.read.schema(parts.schema).parquet(path)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = sizes.select("__part", "__first", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
    ranked = parts.join(F.broadcast(before), "__part")  # a row for each partition
    return ranked.withColumn("rank", F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__part", "__at", "__first", "__before")


def rank_total(scored: DataFrame, top: int | None = None) -> DataFrame:
    """By final score, freshness and id. With ``top`` the best alone, taken before they are numbered."""
    order = (F.desc("final_score"), F.desc("freshness_score"), F.asc("candidate_id"))
    if top is not None:
        return scored.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return numbered(scored, *order)


def compare(a: tuple, b: tuple) -> int:
    """(final score, freshness): within the band the fresher goes first, otherwise the higher score."""
    gap = a[0] - b[0]
    if abs(gap) <= BAND and a[1] != b[1]:
        return -1 if a[1] > b[1] else 1
    return (gap < 0) - (gap > 0)


def segments(classes: DataFrame) -> DataFrame:
    """Adds ``segment`` and ``rows``, the rows in it, to (final_score, freshness_score, n): scores downwards, cut where one lies more than
    the band below the one before it. Across a cut the higher score always goes first."""
    by = W.orderBy(F.desc("final_score"))
    cut = F.lag("final_score").over(by) - F.col("final_score") > BAND
    cut = classes.withColumn("segment", F.sum(F.when(cut, 1).otherwise(0)).over(by))
    return cut.withColumn("rows", F.sum("n").over(W.partitionBy("segment")))


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    """The comparator over (final_score, freshness_score) rows that come by depth, then id; adds their places."""
    rows = rows.sort_values(["depth", "id"], ascending=[False, True], kind="stable")
    pairs = list(zip(rows["final_score"], rows["freshness_score"], strict=True))
    order = sorted(range(len(pairs)), key=cmp_to_key(lambda i, j: compare(pairs[i], pairs[j])))
    return rows.iloc[order].assign(place=range(len(order)))


def rank_exact(scored: DataFrame, most: int = 100_000) -> DataFrame:
    """(rank, candidate_id): the comparator with its tie band over rows that come by semantic depth, then id, segment by segment.

    Scores have one decimal and freshness one value a day of the last year, so their pairs are bounded (some 370,000), whatever the pool;
    they are cut into segments at gaps wider than the band. The rows of a segment are sorted by the comparator in one task, as a
    whole list would be. Where a segment has over ``most`` rows its pairs are sorted in the order of their first rows, and rows of
    one pair stand together as they come. Both are the same unless the band makes a cycle, where the comparator has no order and
    a sort's result depends on how its list comes. Then rows are numbered by segment and place, by ranges.
    """
    pair = ["final_score", "freshness_score"]
    rows = scored.select("candidate_id", *pair, F.col("raw_semantic_score").alias("depth"))
    first = F.min(F.struct((-F.col("depth")).alias("depth"), F.col("candidate_id").alias("id")))
    cut = segments(rows.groupBy(*pair).agg(F.count("*").alias("n"), first.alias("f")))
    cut = cut.select(*pair, "segment", "rows", (-F.col("f.depth")).alias("depth"), F.col("f.id").alias("id"))
    kind = "final_score double, freshness_score double, segment long, depth double, id string, place long"
    asked = lambda df: df.select(F.col("final_score").cast("double"), F.col("freshness_score").cast("double"), "segment", F.col("depth").cast("double"), "id")
    few = rows.withColumnRenamed("candidate_id", "id").join(cut.filter(F.col("rows") <= most).select(*pair, "segment"), pair)
    few = asked(few).groupBy("segment").applyInPandas(_sorted, kind).select("segment", "place", "depth", F.col("id").alias("candidate_id"))
    many = asked(cut.filter(F.col("rows") > most)).groupBy("segment").applyInPandas(_sorted, kind).select(*pair, "segment", "place")
    many = rows.join(many, pair).select("segment", "place", F.col("depth").cast("double").alias("depth"), "candidate_id")
    return numbered(few.unionByName(many), F.asc("segment"), F.asc("place"), F.desc("depth"), F.asc("candidate_id")).select("rank", "candidate_id")
