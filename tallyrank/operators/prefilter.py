"""Keyword prefilter: word overlaps of a query with resumes and titles, and the best of the pool by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.functions import constants as K
from tallyrank.operators.order import numbered

#: The columns that ``keyword_scores`` adds.
KEYWORD_SCORES = ("overlap", "title_bonus", "kw_bonus", "keyword_score")


def words_of(text: str) -> list[str]:
    """The driver-side twin of ``tokens`` for a query: distinct, in order, without stop words."""
    import re

    found = dict.fromkeys(w for w in re.split(r"[^\w]+", text.lower()) if re.fullmatch("[a-z]{3,}", w))
    return [w for w in found if w not in K.STOP_WORDS]


def keyword_scores(pool: DataFrame, query: str, keywords: list[str]) -> DataFrame:
    """Adds overlap (1 a word), title_bonus (3 a word of past titles) and kw_bonus (5 a keyword) and their sum."""
    asked, wanted = C.lit_array(words_of(query)), C.lit_array(words_of(" ".join(keywords)))
    titles = F.array_join(F.transform("career_history", lambda j: F.coalesce(j["title"], F.lit(""))), " ")
    n = lambda a, b: F.size(F.array_intersect(a, b))
    out = pool.withColumn("__t", C.tokens(F.col("resume_text")))
    out = out.withColumn("overlap", n("__t", asked)).withColumn("title_bonus", n(C.tokens(titles), asked) * 3.0).withColumn("kw_bonus", n("__t", wanted) * 5.0)
    return out.withColumn("keyword_score", F.col("overlap") + F.col("title_bonus") + F.col("kw_bonus")).drop("__t")


def pool_limit(n: int) -> int:
    """How many candidates go on: a fifth of the pool, at least 50."""
    return min(n, max(50, int(0.2 * n)))


def prefilter(pool: DataFrame, query: str, keywords: list[str], key: Column | str = "candidate_id") -> DataFrame:
    """The best of the pool; ties go by the key. The pool is read twice."""
    return best_of(keyword_scores(pool, query, keywords), key)


def best_of(scored: DataFrame, key: Column | str = "candidate_id") -> DataFrame:
    """The rows that go on by their keyword_score.

    Scores are few whole numbers: their counts give the pool's size and the score at the edge, all above it are in, and
    only the rows at the edge are numbered. Nothing is sorted as a whole.
    """
    counts = sorted(((r["keyword_score"], r["n"]) for r in scored.groupBy("keyword_score").agg(F.count("*").alias("n")).collect()), reverse=True)
    left = pool_limit(sum(n for _, n in counts))
    for edge, n in counts:
        if left <= n:
            break
        left -= n
    else:
        return scored
    at_edge = scored.filter(F.col("keyword_score") == edge)
    if left < n:
        at_edge = numbered(at_edge, F.asc(key) if isinstance(key, str) else key).filter(F.col("rank") <= left).drop("rank")
    return scored.filter(F.col("keyword_score") > edge).unionByName(at_edge)
