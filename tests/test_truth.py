"""Scores, labels and sentences of constructed rows, stated here and not taken from the library's tables."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.operators import pool, score

AS_OF = date(2026, 5, 20)
KIND = f"candidate_id string, name string, current_title string, years_experience double, career_history {pool.HISTORY}, skills_listed array<string>, last_active string, education string, resume_text string, raw_semantic_score double"
WORDS = " ".join(f"w{i}" for i in range(400))


def row(key, semantic=0.0, name="Priya Sharma", title="Engineer", years=5.0, history=(), skills=(), seen="2026-05-20", education="", text=WORDS):
    return (key, name, title, years, [(t, "c", a, b) for t, a, b in history], list(skills), seen, education, text, semantic)


def scored(spark, rows, keywords=("Python", "Kafka"), **how):
    df = spark.createDataFrame(rows, KIND)
    return {r["candidate_id"]: r for r in score.score(df, score.Request("q", keywords, AS_OF, **how)).collect()}


def test_labels_of_days(spark):
    days = [7, 8, 60, 61, 365, 366, 730, 731]
    seen = [(str(AS_OF - timedelta(days=n)),) for n in days]
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(seen)], "i int, last_active string")
    got = score.freshness(df, AS_OF).orderBy("i").collect()
    assert [r["inactive_days"] for r in got] == days
    assert [r["freshness_label"] for r in got] == ["Active Now", "Recent", "Recent", "Dormant", "Dormant", "Dormant", "Dormant", "Dormant"]
    assert [r["staleness_warning"] is None for r in got] == [True] * 5 + [False] * 3 and got[5]["staleness_warning"] == got[6]["staleness_warning"] != got[7]["staleness_warning"]
    assert [r["freshness_score"] for r in got] == pytest.approx([1 - 7 / 365 + 0.1 if 1 - 7 / 365 + 0.1 < 1 else 1.0, 1 - 8 / 365, 1 - 60 / 365, 1 - 61 / 365, 0.0, 0.0, 0.0, 0.0])


def test_stuffers(spark):
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [row(f"{s}-{w}", skills=[f"s{i}" for i in range(s)], text=text(w)) for s in (19, 20) for w in (199, 200)]
    got = scored(spark, rows)
    assert {k for k, r in got.items() if r["guardrail_keyword_penalty_applied"]} == {"20-199"}
    assert got["20-199"]["semantic_score"] == 85.0 and got["20-200"]["semantic_score"] == 100.0


def test_cap_and_its_edge(spark):
    rows = [row("a", 1.0, years=1.9), row("b", 1.0, years=2.0), row("c", 0.0)]
    got = scored(spark, rows)
    assert (got["a"]["final_score"], got["a"]["status_label"]) == (65.0, "Solid Match 🏆") and got["b"]["final_score"] == 82.5
    assert got["a"]["reasoning"] == "Priya Sharma presents 1.9 years of experience for a senior role; capped at 65 due to lack of deep background."
    assert not any(r["guardrail_seniority_cap_applied"] for r in scored(spark, rows, seniority="Junior").values())
    assert all(r["guardrail_seniority_cap_applied"] == (k == "a") for k, r in scored(spark, rows, seniority="lead").items())


def test_histories(spark):
    two = [("Lead", "2022-01-01", "Present"), ("Junior", "2020-05-20", "2022-01-01")]
    rows = [
        row("none"), row("one", history=two[:1]), row("two", history=two), row("slow", history=[("Engineer", "2006-05-20", "Present"), ("Engineer", "2006-05-20", None)]),
        row("no dates", years=4.0, history=[("Lead", "x", None), ("Lead", "y", None)]), row("back", history=[("Director", "2026-01-01", "2020-01-01"), ("Director", "2025-01-01", "2020-01-01")]),
    ]
    got = scored(spark, rows)
    raw = {k: r["velocity_raw"] for k, r in got.items()}
    assert raw["none"] is raw["one"] is None and raw["no dates"] == 1.0 and raw["back"] == 12.0
    assert raw["two"] == pytest.approx(4 / (2191 / 365.25)) and raw["slow"] == pytest.approx(2 / (7305 / 365.25))
    assert {k: r["velocity_score"] for k, r in got.items() if k in ("none", "one", "slow", "back")} == {"none": 3.0, "one": 3.0, "slow": 0.0, "back": 10.0}


def test_sentences(spark):
    far = str(AS_OF - timedelta(days=400))
    rows = [
        row("top", 1.0, skills=["Python", "kafka streams"], history=[("Lead", "2025-01-01", "Present"), ("Junior", "2024-01-01", "2025-01-01")], title="Lead"),
        row("dormant", 1.0, seen=far), row("stuffed", 1.0, skills=[f"s{i}" for i in range(20)], text="short"), row("low", 0.0, seen=far),
    ]
    got = scored(spark, rows)
    assert got["top"]["reasoning"] == "Elite candidate showing exceptional career velocity. Progressed from Junior to Lead over 5.0 years. Aligned with core requirements in Python, Kafka. High-caliber tech lead profile."
    assert got["dormant"]["reasoning"] == "Exceptional technical fit (100.0% semantic match) — but profile dormant. High skill match, low active intent signal."
    assert got["stuffed"]["reasoning"] == "Priya Sharma lists a dense skill set (20 skills) with a very brief resume text; penalized for potential keyword stuffing."
    assert got["low"]["reasoning"] == "Insufficient contextual relevance or dormant profile activity makes this candidate a low-priority match."
    assert {k: r["status_label"] for k, r in got.items()} == {"top": "Top Hidden Gem 🚀", "dormant": "Solid Match 🏆", "stuffed": "Top Hidden Gem 🚀", "low": "Longshot"}


def test_duplicate_content(spark):
    rows = [row("whole"), row("empty", text=""), row("twice", text="x" * 400), row("thrice", text="y" * 600)]
    got = scored(spark, rows)
    assert {k: round(r["semantic_score"], 1) for k, r in got.items()} == {"whole": 100.0, "empty": 50.0, "twice": 75.0, "thrice": 66.7}


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.9, 2.0, 4.9, 5.0, 7.9, 8.0)], "y double")
    bands = [r[0] for r in df.orderBy("y").select(C.experience_band(F.col("y"))).collect()]
    assert [bands.index(b) for b in bands] == [0, 0, 2, 2, 4, 4, 6]
