"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the folder that
driver and executors share and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.llm.common import read, shared_table
from tallyrank.llm.decontamination import decontaminate
from tallyrank.llm.line_dedup import dedup_lines
from tallyrank.llm.mixing import mix_sources
from tallyrank.llm.queries import toxic_labels
from tallyrank.llm.simhash import drop_similar
from tallyrank.llm.toxicity import drop_toxic
from tallyrank.llm.toxicity import fit as fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    classifier = fit_toxicity(docs, toxic_labels(spark, sf_dir))
    return drop_toxic(docs, classifier)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; documents stay, n_chars follows."""
    kept = dedup_lines(docs, min_docs=10, min_chars=1).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays: SimHash proposes, five-word shingles at 0.8 or more decide."""
    return drop_similar(docs, similarity=0.8, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with their copies and the words these take."""
    return mix_sources(docs).filter("copies > 0")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]

#: The first stage's model is beyond SQL; the rows are tested against a brute-force version of the stages after it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = shared_table(spark, stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
