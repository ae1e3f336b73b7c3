"""A versioned pool and the writers of results."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.functions import constants as K
from tallyrank.sources.commits import CommitLog


class PoolStore:
    """Parquet versions under one path and a log of commits that name them. A version is written whole before its commit, and
    the folder that is read is never the one that is written. Works on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/_commits")

    def current(self) -> str | None:
        told = self.log.last()[1]
        return f"{self.path}/{told['version']}" if told else None

    def read(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.parquet(now) if now else None

    def write(self, pool: DataFrame) -> str:
        """Writes the next version; ``Conflict`` where another writer committed one meanwhile."""
        number, name = self.log.last()[0] + 1, uuid.uuid4().hex
        pool.write.parquet(f"{self.path}/{name}")
        self.log.append(number, {"version": name})
        return name

    def truncate(self, schema) -> str:
        return self.write(self.spark.createDataFrame([], schema))


EXPORTED = ("rank", "candidate_id", "name", "current_title", "years_experience", "velocity_score", "freshness_label", "status_label", "semantic_score", "education_bonus", "final_score", "reasoning")


def export_columns(scored: DataFrame) -> DataFrame:
    """What ranking and export need, so that the rest of the rows (their texts) is not sorted."""
    return scored.select(*EXPORTED[1:], "freshness_score")


def export_rows(ranked: DataFrame) -> DataFrame:
    """The twelve export columns, by rank."""
    return ranked.select(*(F.col(c).alias(h) for c, h in zip(EXPORTED, K.EXPORT_HEADERS, strict=True)))


def write_csv(ranked: DataFrame, path: str) -> None:
    export_rows(ranked).orderBy("Rank").write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)


def write_outputs(ranked: DataFrame, csv: str, json: str) -> None:
    write_csv(ranked, csv)
    ranked.drop("resume_text").orderBy("rank").write.mode("overwrite").json(json)


def markdown_brief(ranked: DataFrame, description: str, seniority: str, sector: str, as_of: date, top: int = 5) -> str:
    """A brief of the pool: counts by label, the first 20 as a table, the first ``top`` in detail."""
    counts = ranked.agg(F.count("*").alias("n"), *(F.count_if(F.contains("status_label", F.lit(w))).alias(w.split()[0]) for w in ("Hidden Gem", "Solid Match", "Potential Fit"))).first()
    rows = ranked.drop("resume_text").orderBy("rank").limit(max(20, top)).collect()
    out = [
        "# Search brief", f"**Date**: {as_of:%B %d, %Y} | **Sector**: {sector} ({K.SECTORS.get(sector, 'Specialist Domain')}) | **Target Seniority**: {seniority}", "",
        "## Search parameters", f"> {description.strip()}", "", f"- **Total candidates**: {counts['n']}", f"- **Top hidden gems**: {counts['Hidden']}", f"- **Solid matches**: {counts['Solid']}", f"- **Potential fits**: {counts['Potential']}", "",
        "## Ranking", "| Rank | Name | Current Title | Experience | Velocity | Freshness | Match Label | Final Score |", "| :--- | :--- | :--- | :--- | :--- | :--- | :--- | :--- |",
    ]
    out += [f"| {i:02d} | **{r['name']}** | {r['current_title']} | {r['years_experience']:.1f}y | {r['velocity_score']}/10 | {r['freshness_label']} | {r['status_label']} | **{r['final_score']:.1f}** |" for i, r in enumerate(rows[:20], 1)]
    out += ["", "## Profiles"]
    for i, r in enumerate(rows[:top], 1):
        listed = lambda x: ", ".join(x) if x else "None"
        out += ["", f"### {i}. {r['name']} — {r['status_label']}", f"- **Current title**: {r['current_title']}", f"- **Final score**: **{r['final_score']:.1f} / 100**", f"- **Core matches**: {listed(r['matched_skills'])}", f"- **Key gaps**: {listed(r['missing_skills'])}", f"> {r['reasoning']}"]
        out += [f"- *{j['title']}* at **{j['company']}** ({j['start_date']} to {j['end_date']})" for j in r["career_history"]]
    return "\n".join(out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a
    temporary folder; on a cluster, where executors would not see that, it is an error."""
    import re
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallyrank-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """The name of a folder in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tallyrank/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read again, for what is read several times; in folders ``by`` columns whose values are read apart."""
    path = new_folder(df.sparkSession, tag)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
