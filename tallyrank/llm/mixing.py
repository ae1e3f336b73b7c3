"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every document is taken floor(r) times for certain, r being its source's target over its source's size. The
words still missing come from a sample with inclusion probability p, the rest of r, which differs from source to
source: each document is ranked by Q = (U / (1 - U)) / (p / (1 - p)), its random odds over its inclusion odds, U
being a hash of the key. Of each source the documents of smallest Q are taken until the words taken are nearest to
what the source is to give, so that the size of every source's sample is fixed.

No source is sorted in one task: sums over ``CELLS`` cells of Q / (1 + Q) show the cell in which the target is
reached, and only the rows of that cell (some 1/4096 of a source) are summed one by one to place the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.llm.common import replacing, shared_table

CELLS = 4096
#: Hexadecimal digits of the hash that make U: 52 bits, so that U is exact as a double.
DIGITS = 13


def words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]++"), F.lit(0))), F.lit(0)).cast("long")


def rank(key: str, seed: int) -> Column:
    """U as a whole number below 16**DIGITS. Rows of one key share it."""
    told = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(told, 1, DIGITS), 16, 10).cast("long")


def order(u: Column, p: Column) -> Column:
    """Q of a document: its random odds over the odds of its inclusion probability; null where that is 0."""
    chance = (u.cast("double") + 0.5) / float(16**DIGITS)
    return F.when((p > 0) & (p < 1), (chance / (1 - chance)) / (p / (1 - p)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, get the weights in turn.

    The targets are the level at which ``least(most * size, level * weight)`` sums to the whole, which is
    where resharing by weight ends: with the sources in the order in which they fill, the level that the rest
    share rises until no more of them are full, and falls beyond. ``sizes`` has one row for each source.
    """
    order, n = W.orderBy(F.col("source").isNull(), "source"), len(weights)
    nth = ((F.row_number().over(order) - 1) % n + 1).cast("int")
    sizes = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), nth).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    full = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, rest, whole = full.rowsBetween(W.unboundedPreceding, -1), full.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    sizes = sizes.withColumn("level", level).withColumn("open", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    sizes = sizes.withColumn("level", F.coalesce(F.max("open").over(whole), F.lit(0.0)))
    return sizes.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, sources): each row's key, source, U and size, without its text; each source's size, target, sure copies, p and cut."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key), F.col("source").cast("string").alias("source"), rank(key, seed).alias("u"), words(F.col("text")).alias("size"))
    rows = shared_table(spark, rows, "mix-rows")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("sure", F.floor(ratio)).withColumn("missing", F.col("target") - F.col("sure") * F.col("source_size"))
    goal = goal.withColumn("p", F.when(F.col("source_size") > 0, F.col("missing") / F.col("source_size")).otherwise(0.0))
    goal = shared_table(spark, goal, "mix-goal")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    # one row for each source meets its rows: small sides are broadcast, large sources are split by the adaptive plan
    told = rows.join(goal.select(F.col("source").alias("__source"), "p", "missing"), F.col("source").eqNullSafe(F.col("__source")))
    told = told.withColumn("q", order(F.col("u"), F.col("p"))).filter("q is not null").select("source", "size", "q", "missing")
    cell = F.floor(F.col("q") / (1 + F.col("q")) * CELLS).cast("int")
    cells = told.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("n"), F.first("missing").alias("missing"))
    by = W.partitionBy("source").orderBy("cell")
    run = cells.withColumn("upto", F.sum("n").over(by))
    edge = run.filter((F.col("missing") > F.col("upto") - F.col("n")) & (F.col("missing") <= F.col("upto")))
    edge = shared_table(spark, edge.select("source", "cell", "missing", (F.col("upto") - F.col("n")).alias("before")), "mix-edge")

    inside = told.select("source", "size", "q").join(edge, same(told, edge) & (cell == edge["cell"])).groupBy(edge["source"], "q").agg(F.sum("size").alias("n"), F.first("missing").alias("missing"), F.first("before").alias("before"))
    inside = inside.withColumn("prior", F.col("before") + F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    upto = F.col("prior") + F.col("n")
    near = F.abs(upto - F.col("missing")) <= F.abs(F.col("prior") - F.col("missing"))
    crossing = (F.col("missing") > F.col("prior")) & (F.col("missing") <= upto)
    # the last Q taken, or the first one left
    cut = inside.filter(crossing).select("source", F.col("q").alias("cut"), near.alias("with_cut"))
    done = goal.join(cut, same(goal, cut), "left").select(goal["source"], "source_size", "target", "sure", "p", "cut", "with_cut")
    return rows, shared_table(spark, done, "mix-sources")


def _decide(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds p, copies and taken to rows that have source, u and size."""
    s = sources.withColumnRenamed("source", "__source")
    rows = rows.join(s, F.col("source").cast("string").eqNullSafe(F.col("__source"))).drop("__source")
    q = order(F.col("u"), F.col("p"))
    more = F.when((q < F.col("cut")) | (F.col("with_cut") & (q == F.col("cut"))), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("sure") + more).otherwise(0).cast("long")
    return rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("sure", "cut", "with_cut", "u")


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """(key, source, size, source_size, target, p, copies, taken): the mix without the texts. See ``mix_sources``."""
    return _decide(*plan_mix(docs, weights, most, seed, key))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """Adds size, source_size, target, p (the chance of one more copy), copies and taken (size * copies) to the rows of ``docs``.

    A null text has size 0 and no copies; a null source is a source of its own, the last. Rows that share a
    key (a null key too) are taken or left together. A source without words has target 0. The sample ends
    where the words taken are nearest to the target. An empty table stays empty. Columns of these names in
    ``docs`` are replaced.
    """
    sources = plan_mix(docs, weights, most, seed, key)[1]
    docs = docs.select(*replacing(docs, "size", "source_size", "target", "p", "sure", "cut", "with_cut", "copies", "taken", "u", "__source"))
    return _decide(docs.withColumn("u", rank(key, seed)).withColumn("size", words(F.col("text"))), sources)
