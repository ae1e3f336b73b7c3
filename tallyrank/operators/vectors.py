"""Vector scoring: centring on the mean of all fragments, cosine to a query, the best fragment of a candidate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrank.functions import columns as C

DIM = 64


def mean_vector(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row (mu, n): the mean of all vectors and their number, in one pass, a buffer of one vector a task. No vectors, mu null."""
    known = df.filter(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    sums = known.groupBy(F.lit(1).alias("g")).agg(Summarizer.metrics("mean", "count").summary(F.col("v")).alias("s"))  # grouped: none where there are none
    one = df.sparkSession.range(1).select(F.lit(1).alias("g"))
    return one.join(sums, "g", "left").select(F.when(F.col("s").isNotNull(), vector_to_array("s.mean")).alias("mu"), F.coalesce("s.count", F.lit(0)).alias("n"))


def centred_cosine(df: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """Adds score, (cosine + 1) / 2 of the vectors and the query, both less the mean (if there are several)."""
    mu = mean_vector(df, vector).withColumnsRenamed({"mu": "__mu", "n": "__n"})
    q = F.array(*(F.lit(float(x)) for x in query))
    less = lambda v: F.zip_with(v, F.col("__mu"), lambda x, m: x.cast("double") - m)
    joined = df.join(F.broadcast(mu))  # one row
    several = F.col("__n") > 1
    return joined.withColumn("score", (F.when(several, C.cosine(less(F.col(vector)), less(q))).otherwise(C.cosine(F.col(vector), q)) + 1) / 2).drop("__mu", "__n")


def best_fragment(scored: DataFrame, key: str) -> DataFrame:
    return scored.groupBy(key).agg(F.max("score").alias("best"))


def unified_score(df: DataFrame) -> DataFrame:
    """Adds unified: three parts the best fragment, one part jobs over years."""
    tempo = F.least(F.lit(1.0), F.size("career_history") / (F.col("years_experience") + 1))
    return df.withColumn("unified", 100 * (0.75 * F.col("best") + 0.25 * tempo))


def sigmoid(c):
    return 1 / (1 + F.exp(-c))


def mean_pool(df: DataFrame, key: str) -> DataFrame:
    """Token rows (key, vector, mask) to a mean vector a key, over the tokens of mask 1."""
    parts = df.select(key, "mask", F.posexplode("vector").alias("pos", "x")).groupBy(key, "pos").agg((F.sum(F.col("x") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1e-9))).alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


def hashed_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """The default embedder, deterministic and offline: signed counts of word hashes."""
    import xxhash

    out = np.zeros((len(texts), dim), np.float32)
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        h = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))
        out[i] = np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), dim)
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    return pd.Series(list(hashed_vectors(texts.tolist())))
