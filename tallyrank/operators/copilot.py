"""Texts about ranked candidates: outreach, interview guides, comparisons, look-alike descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.functions import constants as K


def similar_request(title: Column, skills: Column) -> Column:
    return F.concat(F.lit("Looking for a "), title, F.lit(" skilled in "), F.array_join(skills, ", "), F.lit("."))


def outreach(tone: str = "formal") -> Column:
    """A letter to a candidate; years with one decimal, a stock phrase where no skill is listed."""
    greeting = "Hi" if tone.lower() == "casual" else "Dear"
    title, name, years = F.col("current_title"), F.col("name"), F.format_string("%.1f", F.col("years_experience"))
    skills = F.coalesce(F.nullif(F.array_join("skills_listed", ", "), F.lit("")), F.lit("cutting-edge engineering stacks"))
    return F.concat(
        F.lit("Subject: Career opportunity: "), title, F.lit(f"\n\n{greeting} "), name,
        F.lit(",\n\nI came across your profile while sourcing for a "), title, F.lit(" position. Your background as a "), title, F.lit(" with "), years,
        F.lit(" years of experience and your expertise in "), skills, F.lit(" stood out.\n\nWould you be open to a short call this week?\n\nBest regards"),
    )


def question_guide(sector: str = "TECH") -> Column:
    """Five questions: the sector, the two first gaps, the career, the first matched skill."""
    gap = lambda i, other: F.coalesce(F.get("missing_skills", F.lit(i)), F.lit(other))
    g1, g2, m1 = gap(0, "System Optimization"), gap(1, "Architectural Patterns"), F.coalesce(F.get("matched_skills", F.lit(0)), F.lit("Python"))
    asked = (
        ("sector", F.lit(f"What was the most complex scaling challenge you owned in the {sector} space, and how did you solve it?")),
        ("gap", F.concat(F.lit("The job needs hands-on experience with "), g1, F.lit(". How would you approach adopting it?"))),
        ("gap", F.concat(F.lit("Another key requirement is "), g2, F.lit(". Which failure modes do you watch out for?"))),
        ("growth", F.lit("Which engineering standards did you define at your previous companies?")),
        ("strength", F.concat(F.lit("You listed "), m1, F.lit(" as a strength. Which non-obvious failure mode did you meet in production?"))),
    )
    return F.array(*(F.struct(F.lit(kind).alias("kind"), q.alias("question")) for kind, q in asked))


def history_lines(history: Column) -> Column:
    part = lambda j, f, other: F.coalesce(j[f], F.lit(other))
    return F.array_join(F.transform(history, lambda j: F.concat(F.lit("- "), part(j, "title", "None"), F.lit(" at "), part(j, "company", "None"), F.lit(" ("), part(j, "start_date", "None"), F.lit(" to "), part(j, "end_date", "None"), F.lit(")"))), "\n")


def fact_sheet() -> Column:
    """A candidate as lines of facts, for a request about several."""
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    facts = (
        ("Name", F.col("name")), ("Title", F.col("current_title")), ("Experience", F.concat(F.col("years_experience").cast("string"), F.lit(" years"))),
        ("Final Score", F.col("final_score").cast("string")), ("Semantic Depth", F.concat(F.col("semantic_score").cast("string"), F.lit("%"))),
        ("Velocity Score", F.concat(F.col("velocity_score").cast("string"), F.lit("/10"))), ("Freshness", F.col("freshness_label")), ("Skills", listed("skills_listed")),
        ("Matches", listed("matched_skills")), ("Gaps", listed("missing_skills")), ("Pitch", F.col("reasoning")),
    )
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit("None"))) for k, v in facts))


def strengths(matched: Column) -> Column:
    """Three: the first matched, or a stock one where none is, filled up by stock ones."""
    base = F.when(F.size(matched) > 0, F.slice(matched, 1, 3)).otherwise(F.array(F.lit(K.STRENGTHS[0])))
    return F.slice(F.concat(base, F.array(*map(F.lit, K.STRENGTHS[1:]))), 1, 3)


def weaknesses(missing: Column) -> Column:
    base = F.when(F.size(missing) > 0, F.slice(missing, 1, 2)).otherwise(F.array(F.lit(K.WEAKNESSES[0])))
    return F.slice(F.concat(base, F.array(*map(F.lit, K.WEAKNESSES[1:]))), 1, 2)


def synthesis(scored: DataFrame) -> DataFrame:
    """One row of three texts about compared rows: strengths of the best two, trade-offs, a recommendation."""
    row = F.struct(F.col("pos"), *(F.col(c) for c in ("name", "final_score", "years_experience", "velocity_score", "semantic_score", "matched_skills")))
    listed = scored.agg(F.array_sort(F.collect_list(row)).alias("l"))  # as many rows as were compared
    best = F.array_sort("l", lambda x, y: F.when(x["final_score"] > y["final_score"], -1).when(x["final_score"] < y["final_score"], 1).otherwise(F.when(x["pos"] < y["pos"], -1).otherwise(1)))
    told = listed.select("l", F.get(best, F.lit(0)).alias("a"), F.get(best, F.lit(1)).alias("b"))
    names = F.array_join(F.transform("l", lambda r: r["name"]), " vs ")
    first = lambda r, n: F.array_join(F.slice(F.col(r)["matched_skills"], 1, n), ", ")
    text = lambda c: c.cast("string")
    head = F.concat(names, F.lit(": "), F.col("a")["name"], F.lit(" leads with a score of "), text(F.col("a")["final_score"]), F.lit(" and matches in "), first("a", 3), F.lit("."))
    second = F.when(F.col("b").isNotNull(), F.concat(F.lit(" "), F.col("b")["name"], F.lit(" brings "), first("b", 2), F.lit(" and "), text(F.col("b")["years_experience"]), F.lit(" years of experience."))).otherwise("")
    advice = F.concat(F.lit("Put "), F.col("a")["name"], F.lit(" first: a semantic match of "), text(F.col("a")["semantic_score"]), F.lit("% and a career velocity of "), text(F.col("a")["velocity_score"]), F.lit("/10."))
    return told.select(F.concat(head, second).alias("strengths_synthesis"), F.lit("Long, steady experience stands against fast promotion and an active profile; weigh stability against speed of learning.").alias("tradeoffs_synthesis"), advice.alias("recruiter_recommendation"))


def select_ids(pool: DataFrame, ids: list[str]) -> DataFrame:
    """The candidates asked for, with their place in the request in ``pos``; ids that are not there are left out."""
    if len(ids) < 2:
        raise ValueError("a comparison needs two candidates at least")
    asked = pool.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, candidate_id string")
    return pool.join(F.broadcast(asked), "candidate_id")  # as many rows as were asked for


def compare(scored: DataFrame) -> DataFrame:
    """Rows of a comparison, by request; place counts the best score as 1 (ties by place in the request)."""
    best = F.row_number().over(W.orderBy(F.desc("final_score"), "pos"))
    return scored.select("pos", "candidate_id", "name", "final_score", "years_experience", "velocity_score", "freshness_label", strengths(F.col("matched_skills")).alias("key_strengths"), weaknesses(F.col("missing_skills")).alias("critical_weaknesses"), best.alias("place"))
