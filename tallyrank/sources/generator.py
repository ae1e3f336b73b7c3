"""A synthetic pool with designed cohorts. Each row follows from its number and the seed alone."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: cohorts and their share of the pool in hundredths
COHORTS = (("Hidden Gem", 10), ("Keyword Stuffer", 15), ("Dormant", 15), ("Fresh", 15), ("Seniority Mismatch", 10), ("Missing Career History", 5), ("Standard", 30))
ROLES = ("Frontend Engineer", "Backend Engineer", "Machine Learning Engineer", "DevOps Engineer")
SKILLS = ("React", "TypeScript", "Python", "Go", "Kubernetes", "AWS", "Terraform", "Docker", "PostgreSQL", "Redis", "FastAPI", "PyTorch", "Django", "Java", "Svelte", "Vue", "GraphQL", "Kafka", "Spark", "Airflow", "Rust", "Linux", "Helm", "Istio")


def generate(spark: SparkSession, count: int = 520, seed: int = 42, today: date = date(2026, 5, 20)) -> DataFrame:
    def draw(salt: str, n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n)).cast("int")

    edges, total = [], 0
    for name, share in COHORTS:
        total += share
        edges.append((name, total * count // 100))
    cohort = F.lit(COHORTS[-1][0])
    for name, edge in reversed(edges[:-1]):
        cohort = F.when(F.col("id") < edge, name).otherwise(cohort)
    is_ = lambda name: F.col("cohort") == name
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("id") % len(ROLES) + 1).cast("int"))
    days = F.when(is_("Dormant"), 366 + draw("dormant", 635)).when(is_("Fresh"), draw("fresh", 8)).otherwise(8 + draw("days", 353))
    years = F.when(is_("Hidden Gem"), 2.5 + draw("y", 36) / 10).when(is_("Seniority Mismatch"), 0.5 + draw("y", 14) / 10).otherwise(2.0 + draw("y", 100) / 10)
    rank = F.when(is_("Hidden Gem"), "Lead ").when(is_("Seniority Mismatch"), "Senior ").otherwise("")
    jobs = F.when(is_("Missing Career History"), 1).when(is_("Hidden Gem"), 3).otherwise(2 + draw("jobs", 2))
    n_skills = F.when(is_("Keyword Stuffer"), 20 + draw("s", 4)).otherwise(4 + draw("s", 8))
    start = lambda i: F.date_format(F.date_sub(F.lit(today), (F.col("years_experience") * 365.25 * (i + 1) / F.col("jobs")).cast("int")), "yyyy-MM-dd")
    end = lambda i: F.when(i == 0, F.lit("Present")).otherwise(F.date_format(F.date_sub(F.lit(today), (F.col("years_experience") * 365.25 * i / F.col("jobs")).cast("int")), "yyyy-MM-dd"))
    title = lambda i: F.when(i == 0, F.col("current_title")).when(i == F.col("jobs") - 1, F.concat(F.lit("Junior "), F.col("role"))).otherwise(F.col("role"))
    job = lambda i: F.struct(title(i).alias("title"), F.concat(F.lit("Company "), draw("c", 90).cast("string")).alias("company"), start(i).alias("start_date"), end(i).alias("end_date"))
    rows = spark.range(count).withColumn("cohort", cohort).withColumn("role", role).withColumn("jobs", jobs).withColumn("years_experience", F.round(years, 1)).withColumn("current_title", F.concat(rank, F.col("role")))
    listed = F.slice(F.sort_array(F.transform(F.array(*map(F.lit, SKILLS)), lambda s: F.struct(F.xxhash64(s, F.col("id"), F.lit(seed)).alias("h"), s.alias("s")))), 1, n_skills)
    sentence = F.concat(F.lit("Worked as "), F.col("current_title"), F.lit(" and built systems that many teams rely on every single day. "))
    return rows.select(
        F.format_string("cand_%03d", F.col("id") + 1).alias("candidate_id"), F.format_string("Person %d", F.col("id")).alias("name"), "current_title", "years_experience",
        F.transform(F.sequence(F.lit(0), F.col("jobs") - 1), job).alias("career_history"), F.transform(listed, lambda x: x["s"]).alias("skills_listed"),
        F.when(draw("null", 20) > 0, F.date_format(F.date_sub(F.lit(today), days), "yyyy-MM-dd")).alias("last_active"), F.lit("BS Computer Science").alias("education"), F.lit("Remote").alias("location"),
        F.repeat(sentence, F.when(is_("Keyword Stuffer"), 3).otherwise(20)).alias("resume_text"), "cohort",
    )


