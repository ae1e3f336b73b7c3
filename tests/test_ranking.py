"""Ranking by description, parsing with fallbacks, settings, progress and the command, on constructed rows."""

import io
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyrank import __main__ as command
from tallyrank.operators import expansion, order, parsing, prefilter, rank, score, vectors
from tallyrank.sources import settings
from tallyrank.sources.candidates import read_candidates
from tallyrank.sources.generator import generate
from tests.test_operators import chunk
from tallyrank.sources.buckets import BucketStore
from tallyrank.streaming import ingest

AS_OF = date(2026, 5, 20)
ASKED = "We look for a Python engineer with Kafka and Kubernetes for our backend"


@pytest.fixture(scope="module")
def pool(spark):
    return generate(spark, 80).drop("cohort").cache()


def test_rank_against_its_parts(spark, pool):
    got = rank.rank(pool, ASKED, "senior", "tech", AS_OF)
    rows = got.rows.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 81)) and all(r["id"] == r["candidate_id"] for r in rows) and got.sector == "TECH"
    assert "Domain: Backend" in got.expanded and got.request.seniority == "Senior"
    # the raw score by hand: hashed vectors of fragments, centred on their mean, best cosine to the polished text
    import numpy as np

    chosen = prefilter.prefilter(pool, got.request.query, list(got.request.keywords)).select("candidate_id", "resume_text").collect()
    parts = [(r["candidate_id"], c) for r in chosen for c in (chunk(r["resume_text"]) or [""])]
    v = vectors.hashed_vectors([c for _, c in parts]).astype(float)
    mu, q = v.mean(0), vectors.hashed_vectors([ASKED])[0].astype(float)
    norm = lambda x: max(np.linalg.norm(x), 1e-12)
    best = {}
    for (k, _), x in zip(parts, v, strict=True):
        best[k] = max(best.get(k, 0), (float((x - mu) @ (q - mu)) / norm(x - mu) / norm(q - mu) + 1) / 2)
    assert len(best) == 50 and {r["candidate_id"]: r["raw_semantic_score"] for r in rows} == pytest.approx({r["candidate_id"]: best.get(r["candidate_id"], 0.0) for r in rows}, abs=1e-6)
    with pytest.raises(ValueError):
        rank.rank(pool, " \n", as_of=AS_OF)


def test_similar_and_find(spark, pool):
    rows, asked = rank.similar(pool, "cand_003", AS_OF)
    got = rows.collect()
    own = rank.find(rank.with_id(pool), "cand_003").first()
    assert len(got) == 10 and "cand_003" not in {r["candidate_id"] for r in got} and asked == f"Looking for a {own['current_title']} skilled in {', '.join(own['skills_listed'])}."
    assert rank.find(pool.withColumn("id", F.concat(F.lit("x"), "candidate_id")), "xcand_003").first()["candidate_id"] == "cand_003"
    with pytest.raises(LookupError):
        rank.find(pool, "nobody")


def test_comparison(spark, pool):
    got = rank.compare_candidates(pool, ["cand_002", "cand_009", "cand_001", "nobody"], ASKED, AS_OF).orderBy("pos").collect()
    assert [r["candidate_id"] for r in got] == ["cand_002", "cand_009", "cand_001"] and sorted(r["place"] for r in got) == [1, 2, 3]
    best = min(got, key=lambda r: r["place"])
    assert got[0]["strengths_synthesis"].startswith("Person 1 vs Person 8 vs Person 0: " + best["name"]) and best["name"] in got[0]["recruiter_recommendation"]
    for ids, error in ((["cand_001"], ValueError), (["a", "b"], LookupError)):
        with pytest.raises(error):
            rank.compare_candidates(pool, ids, ASKED, AS_OF)
    with pytest.raises(ValueError):
        rank.compare_candidates(pool, ["cand_001", "cand_002"], "", AS_OF)


def test_preview_and_console(spark, pool):
    assert rank.preview("a\nb\n") == "a\nb" and rank.preview("1\n2\n3\n4\n5\n6") == "1\n2\n3\n4\n5\n..."
    text = rank.console(rank.rank(pool, ASKED, as_of=AS_OF).rows, "Senior")
    assert text.isascii() and len(text.split("\n")) == 11


def test_request_takes_any_case():
    r = score.Request("q", (), AS_OF, "pRINCIPAL", " health ")
    assert (r.seniority, r.sector) == ("Principal", "HEALTH") and score.Request("q", (), AS_OF, sector="").sector == "TECH"


def test_exact_order(spark):
    rows = spark.range(30).select(F.col("id").cast("string").alias("candidate_id"), (F.col("id") % 7 / 4).alias("final_score"), (F.col("id") % 3 / 10).alias("freshness_score"), (F.col("id") % 5).alias("raw_semantic_score"))
    from functools import cmp_to_key

    want = sorted(rows.collect(), key=lambda r: (-r["raw_semantic_score"], r["candidate_id"]))
    want.sort(key=cmp_to_key(lambda a, b: order.compare((a["final_score"], a["freshness_score"]), (b["final_score"], b["freshness_score"]))))
    assert [r["candidate_id"] for r in order.rank_exact(rows).orderBy("rank").collect()] == [r["candidate_id"] for r in want]
    by = {r["candidate_id"]: (r["final_score"], r["freshness_score"]) for r in want}
    apart = [by[r["candidate_id"]] for r in order.rank_exact(rows, most=29).orderBy("rank").collect()]  # beyond: rows of one pair stand together
    assert sorted(apart) == sorted(by.values()) and sum(a != b for a, b in zip(apart, apart[1:], strict=False)) == len(set(apart)) - 1


def test_prefilter_takes_ties_by_key(spark):
    rows = spark.range(400).select(F.format_string("c%03d", "id").alias("candidate_id"), F.when(F.col("id") % 10 == 0, "kafka spark").otherwise("spark").alias("resume_text"), F.array().cast("array<struct<title:string>>").alias("career_history"))
    got = {r["candidate_id"] for r in prefilter.prefilter(rows, "kafka spark", []).collect()}
    first = [f"c{i:03d}" for i in range(0, 400, 10)]
    assert got == set(first) | set([f"c{i:03d}" for i in range(400) if i % 10][:40])
    assert prefilter.prefilter(rows.limit(0), "kafka", []).count() == 0 and prefilter.prefilter(rows.limit(7), "kafka", []).count() == 7


def test_retries():
    waits, calls = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 4:
            raise (parsing.CallError(429), ConnectionError(), parsing.CallError(503))[len(calls) - 1]
        return "ok"

    assert parsing.retrying(call, 5, sleep=waits.append, jitter=lambda: 1.0) == "ok" and waits == [2.0, 4.0, 8.0]

    def never():
        raise TimeoutError

    with pytest.raises(RuntimeError):
        parsing.retrying(never, sleep=waits.append, jitter=lambda: 1.0)
    assert waits[3:] == [2.0, 4.0, 8.0, 16.0, 32.0, 64.0]

    def refused():
        raise parsing.CallError(400)

    with pytest.raises(parsing.CallError):
        parsing.retrying(refused, sleep=waits.append)
    assert len(waits) == 9


def test_models_are_loaded_once():
    made = []
    load = lambda k: made.append(k) or k
    assert [parsing.cached(load, k) for k in ("a", "b", "a")] == ["a", "b", "a"] and made == ["a", "b"]


class Shaky(parsing.LineParser):
    """Fails where a batch holds the word poison, gives one record too few for the word short, reads pages that begin with %."""

    def parse(self, texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("no answer")
        out = super().parse(texts)
        return out[:-1] if len(texts) > 1 and any("short" in t for t in texts) else out

    def parse_pages(self, content):
        if not content.startswith(b"%"):
            raise RuntimeError("no page")
        return {"name": content[1:].decode(), "resume_text": "seen"}


def test_fallbacks(spark):
    rows = [("a", "Ann\nDev\nSkills: x, y", b"-"), ("b", "Bob short", b"-"), ("c", "Cyd", b"-"), ("d", None, b"%Dee"), ("e", " ", b"-"), ("f", "Fay poison", b"%Fay"), ("g", "Gus", b"-")]
    files = spark.createDataFrame(rows, "source_file string, text string, content binary").coalesce(1)
    got = {r["source_file"]: (r["name"], r["how"], r["error"]) for r in parsing.parse_files(files, Shaky(), size=5).collect()}
    assert got == {"a": ("Ann", "batch", None), "b": ("Bob short", "batch", None), "c": ("Cyd", "alone", None), "d": ("Dee", "pages", None), "e": (None, "failed", "no text; no page"), "f": ("Fay", "pages", None), "g": ("Gus", "alone", None)}
    assert parsing.parse_files(files, Shaky()).filter("source_file = 'a'").first()["skills_listed"] == ["x", "y"]


def test_archives_to_pool(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "pool"))
    (tmp_path / "in").mkdir()
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x/ann.pdf", "Ann Lee\nEngineer\nSkills: Python")
        z.writestr("bob.pdf", "Bob Ray\nEngineer\nSkills: Go")
        z.writestr("empty.pdf", "")
    (tmp_path / "in" / "a.zip").write_bytes(data.getvalue())
    (tmp_path / "in" / "cyd.pdf").write_bytes(b"Cyd Fox\nEngineer")
    parse = ingest.parsed_resumes(Shaky(), [lambda b: None, lambda b: b.decode()])
    for _ in range(2):
        query = ingest.start_ingest(spark, str(tmp_path / "in"), parse, store, str(tmp_path / "check"))
        events = list(ingest.progress(query, store, every=0.2))
        assert events[-1] == {"total": 4, "skipped": 0, "parsed": 3, "failed": 1, "failed_files": ["empty.pdf"], "percent": 100, "status": "done", "total_candidate_count": 3}
    assert {(r["name"], tuple(r["skills_listed"])) for r in ingest.pool_of(store).collect()} == {("Ann Lee", ("Python",)), ("Bob Ray", ("Go",)), ("Cyd Fox", ())}


def test_settings():
    lines = ["# note\n", 'KEY="old"\n', "LOCAL_OCR_BACKEND=auto\n"]
    got = settings.upsert_settings(lines, {"KEY": ' "new" ', "LOCAL_OCR_BACKEND": "vlm", "OTHER": "x", "NONE": None, "MASKED": "ab**cd"})
    assert got == ["# note\n", 'KEY="new"\n', "LOCAL_OCR_BACKEND=vlm\n", 'OTHER="x"\n'] and lines[1] == 'KEY="old"\n'
    assert settings.read_settings(got) == {"KEY": "new", "LOCAL_OCR_BACKEND": "vlm", "OTHER": "x"}
    with pytest.raises(ValueError):
        settings.upsert_settings(lines, {"KEY": "a\nEVIL=1"})


def test_dispatch(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(b"x")
    (tmp_path / "upload").write_text("[]")
    assert read_candidates(spark, str(tmp_path / "one.pdf")).columns == read_candidates(spark, str(tmp_path / "upload"), "application/pdf").columns
    assert "candidate_id" in read_candidates(spark, str(tmp_path / "upload"), "application/json").columns


def test_command(spark, pool, tmp_path, capsys):
    rows = [json.loads(r) for r in pool.limit(12).toJSON().collect()]
    (tmp_path / "pool.json").write_text(json.dumps(rows))
    (tmp_path / "jd.txt").write_text(ASKED + "\n" * 2)
    args = ["--pool", str(tmp_path / "pool.json"), "--jd", str(tmp_path / "jd.txt"), "--out", str(tmp_path / "out"), "--as-of", "2026-05-20"]
    assert command.main(args) == 0
    assert spark.read.csv(str(tmp_path / "out.csv"), header=True).count() == spark.read.json(str(tmp_path / "out.json")).count() == 12
    assert ASKED in capsys.readouterr().out
    assert command.main([*args[:2], "--jd", str(tmp_path / "none.txt")]) == 1


def test_chunk_rules():
    """Every fragment has 300 words at most but a sentence that is longer; words keep their order."""
    text = "\n".join([" ".join(f"w{i}" for i in range(310)), "a b. " * 200, "end"])
    got = chunk(text)
    assert [len(c.split()) for c in got] == [310, 300, 101] and got[1].endswith(".") and got[-1].split()[-1] == "end"


def test_expansion_of_every_domain():
    for d in ("Frontend", "Backend", "Machine Learning", "DevOps"):
        assert f"Domain: {d}" in expansion.expand({"Frontend": "svelte", "Backend": "nothing named", "Machine Learning": "nlp", "DevOps": "sre"}[d])
