"""The prefilter's inverted index: words to the candidates that have them, kept beside the pool in its buckets.

A request reads the postings of its own words, by their order in the files, and sums weights; no resume is read or cut into words.
The postings of a bucket are made again when the pool's files of that bucket have changed, and only then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.operators.prefilter import best_of, words_of
from tallyrank.sources.buckets import BucketStore, Snapshot

#: The word of the posting that every candidate has, by which candidates are counted.
EVERY = ""


def postings(pool: DataFrame) -> DataFrame:
    """(bucket, word, in_title, candidate_id): the different words of each resume and of its past titles, and ``EVERY``."""
    titles = F.array_join(F.transform("career_history", lambda j: F.coalesce(j["title"], F.lit(""))), " ")
    marked = lambda words, title: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(title).alias("in_title")))
    found = F.concat(F.array(F.struct(F.lit(EVERY).alias("word"), F.lit(False).alias("in_title"))), marked(C.tokens(F.col("resume_text")), False), marked(C.tokens(titles), True))
    return pool.select("bucket", "candidate_id", F.explode(found).alias("p")).select("bucket", "p.word", "p.in_title", "candidate_id")


def refresh(store: BucketStore) -> Snapshot:
    """Brings the table ``postings`` up to the pool's last commit; only buckets with other files than the index knows are read."""
    at = store.snapshot()
    files, known = at.files.get("pool", {}), at.values.get("indexed", {})
    stale = sorted(b for b in files if known.get(str(b)) != files[b])
    if not stale:
        return at
    made = postings(store.read("pool", at, stale))
    return store.commit(at, {"postings": (made, stale)}, {"indexed": {str(b): names for b, names in files.items()}}, order=["word"])


def keyword_scores(store: BucketStore, query: str, keywords: list[str]) -> DataFrame:
    """(candidate_id, overlap, title_bonus, kw_bonus, keyword_score) of every candidate of the index, as ``prefilter.keyword_scores`` has them."""
    asked, wanted = words_of(query), words_of(" ".join(keywords))
    rows = store.read("postings").select("word", "in_title", "candidate_id").filter(F.col("word").isin(EVERY, *asked, *wanted))
    ask, want = F.col("word").isin(*asked) if asked else F.lit(False), F.col("word").isin(*wanted) if wanted else F.lit(False)
    out = rows.groupBy("candidate_id").agg(
        F.count_if(~F.col("in_title") & ask).cast("int").alias("overlap"), (F.count_if(F.col("in_title") & ask) * 3.0).alias("title_bonus"), (F.count_if(~F.col("in_title") & want) * 5.0).alias("kw_bonus")
    )
    return out.withColumn("keyword_score", F.col("overlap") + F.col("title_bonus") + F.col("kw_bonus"))


def prefilter(store: BucketStore, query: str, keywords: list[str]) -> DataFrame:
    """The best of the pool by its index, as ``prefilter.prefilter`` gives them from the resumes; ids must be unique, as ingest makes them."""
    return best_of(keyword_scores(store, query, keywords))
