"""Operators on constructed rows."""

import io
import itertools
import json
import zipfile
from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrank.operators import chunking, copilot, expansion, ocr, order, pool, prefilter, score, vectors
from tallyrank.sources import candidates as source
from tallyrank.sources.generator import COHORTS, generate
from tallyrank.sources.buckets import BucketStore
from tallyrank.sources.store import markdown_brief, write_csv
from tallyrank.streaming.ingest import failures, json_resumes, pool_of, start_ingest

AS_OF = date(2026, 5, 20)
REQUEST = score.Request("python kafka", ("Python", "Kafka"), AS_OF)


def chunk(text: str | None, most: int = 300) -> list[str]:
    """The fold over paragraphs and sentences in plain Python."""
    out: list[str] = []
    open_, size = [], 0
    for para in filter(None, map(str.strip, (text or "").split("\n"))):
        n = len(para.split())
        if size + n <= most:
            open_.append(para)
            size += n
            continue
        if open_:
            out.append("\n".join(open_))
        open_, size = [para], n
        if n > most:
            open_, size = [], 0
            for mark in ("! ", "? "):
                para = para.replace(mark, ". ")
            for sentence in filter(None, map(str.strip, para.split(". "))):
                m = len(sentence.split())
                if size + m > most:
                    if open_:
                        out.append(". ".join(open_) + ".")
                    open_, size = [], 0
                open_.append(sentence)
                size += m
    return [*out, "\n".join(open_)] if open_ else out


CHUNKED = [None, "", " \n\t", "a b\n\nc", ". ".join(" ".join(["w"] * 100) for _ in range(7)) + "\nend", "x " * 900, "a b! c? " * 150 + "\n" + "z " * 10, "p " * 299 + "\n" + "q " * 2 + "\n" + "r. s " * 400, ". . . " * 200, "one\n" * 301]


def test_chunks_of_a_column(spark, sf):
    """The fold in the JVM against the one in Python, on odd texts and on all documents."""
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(CHUNKED)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for rows, most in ((odd, 300), (odd, 5), (docs, 300), (docs, 40)):
        for r in rows.select("text", chunking.chunks(F.col("text"), most).alias("c")).collect():
            assert r["c"] == chunk(r["text"], most)


def test_chunks():
    assert chunk("") == chunk(None) == []
    assert chunk("a b\n\nc") == ["a b\nc"]
    para = ". ".join(" ".join(["w"] * 100) for _ in range(7))
    got = chunk(para + "\nend")
    assert [len(c.split()) for c in got] == [300, 300, 101]
    assert got[0].endswith(".") and got[2].endswith("\nend")


@given(st.lists(st.lists(st.sampled_from(["a", "b.", "c!", "d"]), max_size=60), max_size=12))
def test_chunks_keep_words(paras):
    text = "\n".join(" ".join(p) for p in paras)
    assert sum(len(c.split()) for c in chunk(text, 20)) == len(text.split())


def test_compare_is_no_order():
    rows = [(70.0, 0.9), (70.4, 0.5), (70.8, 0.1)]
    assert order.compare(rows[0], rows[1]) == -1 and order.compare(rows[1], rows[2]) == -1 and order.compare(rows[0], rows[2]) == 1
    from functools import cmp_to_key

    assert len({tuple(sorted(p, key=cmp_to_key(order.compare))) for p in itertools.permutations(rows)}) == 3


def test_skill_in_neither_list(spark):
    rows = spark.createDataFrame([(["react"],)], "skills_listed array<string>")
    got = score.skills_gap(rows, ("react", "react native")).first()
    assert got["matched_skills"] == ["react"] and got["missing_skills"] == []


def test_score_edges(spark):
    job = lambda t, a, b: (t, "c", a, b)
    rows = [
        ("a", "Priya Sharma", "Engineer", 1.9, [job("Engineer", "2024-01-01", "Present"), job("Junior", "2023-01-01", "2024-01-01")], ["Python"], "2026-05-20", "CS", "kafka " * 300, 90.0),
        ("b", None, None, 5.0, [], None, None, None, None, 0.0),
        ("c", "Jo Rivers", "Lead", 6.0, [job("Lead", "bad", None), job("Senior", "worse", None)], [f"s{i}" for i in range(20)], "", "MBA", "x " * 199, 0.0),
    ]
    kind = f"candidate_id string, name string, current_title string, years_experience double, career_history {pool.HISTORY}, skills_listed array<string>, last_active string, education string, resume_text string, raw_semantic_score double"
    got = {r["candidate_id"]: r for r in score.score(spark.createDataFrame(rows, kind), REQUEST).collect()}
    assert got["a"]["guardrail_seniority_cap_applied"] and got["a"]["final_score"] <= 65
    assert got["b"]["career_velocity_score"] == 0.3 and got["b"]["name"] == "Unknown Candidate" and got["b"]["semantic_score"] == 0
    assert got["c"]["guardrail_keyword_penalty_applied"] and got["c"]["velocity_raw"] == pytest.approx(4 / 6)
    assert score.score(spark.createDataFrame([], kind), REQUEST).count() == 0


def test_constant_pool_is_one(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i int, raw double")
    assert {r["out"] for r in score._scaled(rows, ("raw", "out", None)).collect()} == {1.0}


def test_pool_limit():
    assert [prefilter.pool_limit(n) for n in (0, 10, 50, 100, 250, 1000)] == [0, 10, 50, 50, 50, 200]


def test_numbered_is_whole(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert [(r["x"], r["rank"]) for r in order.numbered(rows, F.asc("x")).orderBy("x").collect()] == [(i, i + 1) for i in range(1000)]


def record(spark, rows):
    return pool.build_records(spark.createDataFrame(rows, "name string, current_title string, skills_listed array<string>, source_file string")).withColumn("candidate_id", F.lit(None).cast("string")).select(*pool.COLUMNS)


def test_upsert_is_idempotent(spark):
    empty = spark.createDataFrame([], record(spark, [("x", "t", [], "f")]).schema)
    batch = record(spark, [("Ann Lee", "Dev", ["b "], "f1"), ("ann lee", "Lead", ["a", "b"], "f2"), ("unknown", "Dev", [], "f3"), ("Bo Kim", "Dev", [], "f4")])
    once = pool.upsert(empty, batch)
    rows = sorted(map(repr, once.collect()))
    ann = once.filter("name = 'Ann Lee'").first()
    assert len(rows) == 3 and ann["skills_listed"] == ["b", "a"] and ann["current_title"] == "Lead"
    assert sorted(map(repr, pool.upsert(once, batch).collect())) == rows


def test_ocr_lines(spark):
    boxes = [(0, 0, "b"), (9, 50, "c"), (12, 0, "d"), (0, -5, "a")]
    rows = spark.createDataFrame([("f", 0, 100.0, float(x), float(x + 70 if i < 3 else x), float(y), t) for i, (y, x, t) in enumerate(boxes)], "doc string, page int, width double, x_min double, x_max double, y_min double, text string")
    assert ocr.page_text(rows).first()["text"] == "a b c\nd"


def test_expansion():
    assert expansion.domains("Need a chef") == ["Backend"]
    assert expansion.domains("React and AWS") == ["Frontend", "DevOps"]
    text = expansion.expand("React, aws and React", "lead")
    assert text.startswith("Domain: Frontend") and "(Lead): mentored" in text and text.endswith("Core Tech Stack: React, aws")
    assert expansion.requirements("the quick fox the", "zz") == {"polished_requirements": "the quick fox the", "sector_token": "TECH", "top_keywords": ["the", "quick", "fox"]}


def test_copilot(spark):
    rows = spark.createDataFrame([(["a"], ["x", "y", "z"]), ([], [])], "m array<string>, g array<string>")
    got = rows.select(copilot.strengths(F.col("m")), copilot.weaknesses(F.col("g"))).collect()
    assert got[0][0] == ["a", "Career history progression", "Self-declared skill alignment"] and got[0][1] == ["x", "y"]
    assert got[1][0][0] == "Experience profile" and got[1][1] == ["Profile details verification", "Missing adjacent stack elements"]
    with pytest.raises(ValueError):
        copilot.select_ids(rows, ["one"])


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<float>")
    got = {r["vec_id"]: r["score"] for r in vectors.centred_cosine(rows, [1.0, 0.0]).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.0})
    tokens = spark.createDataFrame([("k", [1.0, 2.0], 1), ("k", [3.0, 4.0], 1), ("k", [9.0, 9.0], 0)], "k string, vector array<double>, mask int")
    assert vectors.mean_pool(tokens, "k").first()["vector"] == [2.0, 3.0]


def test_generator(spark):
    rows = generate(spark, 200).cache()
    counts = {r["cohort"]: r["count"] for r in rows.groupBy("cohort").count().collect()}
    assert counts == {n: s * 2 for n, s in COHORTS}
    assert rows.filter("cohort = 'Keyword Stuffer' AND size(skills_listed) < 20").count() == 0
    assert rows.filter("cohort = 'Missing Career History' AND size(career_history) <> 1").count() == 0
    assert rows.repartition(7).orderBy("candidate_id").collect() == generate(spark, 200).orderBy("candidate_id").collect()


def test_sources(spark, tmp_path):
    (tmp_path / "pool.json").write_text(json.dumps([{"candidate_id": "c1", "name": "A B", "current_title": "Dev", "resume_text": "x", "skills_listed": ["p"]}, {"candidate_id": "c2"}]))
    good, bad = source.validate(source.read_pool(spark, str(tmp_path / "pool.json")))
    assert [r["candidate_id"] for r in good.collect()] == ["c1"] and bad.first()["missing_fields"] == ["name", "current_title", "resume_text"]
    assert source.read_pool(spark, str(tmp_path / "none.json")).count() == 0
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n in ("a.pdf", "d/B.PDF", "d/._c.pdf", "__MACOSX/d.pdf", "e.txt"):
            z.writestr(n, n)
    (tmp_path / "in.zip").write_bytes(data.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    rows = source.zip_entries(spark.read.format("binaryFile").load(str(tmp_path / "*.zip")))
    assert {r["entry"] for r in rows.collect()} == {"a.pdf", "d/B.PDF", None}
    texts = source.extract_text(rows, [lambda b: None, lambda b: b.decode()])
    assert {r["text"] for r in texts.collect()} == {"a.pdf", "d/B.PDF", None}
    (tmp_path / "jd").mkdir()
    (tmp_path / "jd" / "ml_engineer.txt").write_text("hello")
    assert source.templates(spark, str(tmp_path / "jd")).first().asDict() == {"id": "ml_engineer", "name": "Ml Engineer", "content": "hello", "seniority": "Lead"}
    assert source.templates(spark, str(tmp_path / "nothing")).count() == 1


def test_store_and_stream(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "pool"))
    drop = tmp_path / "in"
    drop.mkdir()
    for i in range(4):
        (drop / f"r{i}.json").write_text(json.dumps({"name": f"Person {i % 3}", "current_title": "Dev", "skills_listed": [str(i)]}) if i else "broken")
    for _ in range(2):
        start_ingest(spark, str(drop), json_resumes, store, str(tmp_path / "checkpoint")).awaitTermination()
    rows = {r["name"]: r for r in pool_of(store).collect()}
    assert set(rows) == {"Person 0", "Person 1", "Person 2"} and len({r["candidate_id"] for r in rows.values()}) == 3
    told = store.read("batches").collect()
    assert [(r["total"], r["failed"], r["percent"]) for r in told] == [(4, 1, 100)] and [r["source_file"] for r in failures(store).collect()] == ["r0.json"]


def test_exports(spark, tmp_path):
    rows = score.scored_pool(generate(spark, 60).drop("cohort"), REQUEST)
    ranked = order.rank_total(rows).cache()
    write_csv(ranked, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 60
    text = markdown_brief(ranked, "JD", "Senior", "TECH", AS_OF)
    assert "**Total candidates**: 60" in text and text.count("| **") >= 20


def test_library_does_not_import_llm():
    from pathlib import Path

    import tallyrank

    for p in Path(tallyrank.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "tallyrank.llm" not in p.read_text()
