"""The registered queries over the operators of this subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.llm.collocations import collocations
from tallyrank.llm.common import read, remainder
from tallyrank.llm.decontamination import find_items
from tallyrank.llm.divergence import audit
from tallyrank.llm.fingerprints import compare_versions
from tallyrank.llm.langid import fit as fit_languages
from tallyrank.llm.langid import identify
from tallyrank.llm.line_dedup import dedup_lines
from tallyrank.llm.lm_scoring import score_texts
from tallyrank.llm.mixing import mix_sizes
from tallyrank.llm.pii import personal_data
from tallyrank.llm.simhash import near_duplicates
from tallyrank.llm.sql import COLLOCATIONS_SQL, DIVERGENCE_SQL, LINE_DEDUP_SQL, MIXING_SQL
from tallyrank.llm.substring_dedup import drop_repeats
from tallyrank.llm.token_counts import token_counts
from tallyrank.llm.toxicity import fit as fit_toxicity
from tallyrank.llm.toxicity import score_toxicity


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    models = fit_languages(docs.filter(~F.col("held_out")).select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), models).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder("doc_id", 10) == 0, F.lit(False)).alias("held_out"))
    return score_texts(docs, ~F.col("held_out"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, distance=4)
    return docs.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(), limit=1024)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), window=50, digest=True)
    return docs.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, toxic) of the labelled documents that may be learnt from; one row for each."""
    labels = read(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    return labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    classifier = fit_toxicity(docs, toxic_labels(spark, sf_dir))
    docs = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))
    return score_toxicity(docs, classifier).select("doc_id", "held_out", "score", "predicted")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), min_docs=30, smooth=5, top=50)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"), least=30, top=2000, swallowed=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_decontamination": op8_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
    "op11_divergence": op11_divergence,
    "op12_pii": op12_pii,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": LINE_DEDUP_SQL, "op10_mixing": MIXING_SQL, "op11_divergence": DIVERGENCE_SQL, "op13_collocations": COLLOCATIONS_SQL}
