"""Personal data against a plain version with Python's ``re``, and what the method adds to it."""

import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyrank.llm import pii, queries
from tallyrank.llm.common import read

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind: str, m: str) -> bool:
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    counts = {f"n_{k}": sum(x[3] == k for x in found) for k in BASE}
    return {**counts, "base_sha256": sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found)).encode()).hexdigest()}


def same(spark, df, told):
    texts = dict(df.select("doc_id", "text").collect())
    rows = told.collect()
    assert len(rows) == df.count()
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert {c: r[c] for c in want} == want, (r, texts[r["doc_id"]])
    return rows


def test_query_against_brute_force(spark, sf):
    rows = same(spark, read(spark, sf, "documents"), queries.op12_pii(spark, sf))
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows) > 0


AWKWARD = [
    None, "", "a@b.c", "x@a@b.c.d..e ü a.b@c_d@e.f.g@h.i", "@@a@b..c", "é@ü.de jo@mail.ex-1.com.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.000.0.007 1.2.3", "999.9.9.9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 12/26", "1 2  3-4--5", "5 4111  1111", "+1 (614) 555-8001, +49 30 1234567-", "+1 (614) 555-8001+1 (614) 555-8001", "+1......", "+12345678901234567890",
    "++1 23 456 789 0", "ß 4111 1111 1111 1111 ä+1 555 123 4567", " ".join(["10.0.0.1 a@b.co"] * 700), "a" * 3000, "1" * 3000, "+" * 2000, "a@" * 1000, "a@b" + ".c" * 900, "1." * 1000, "0" * 500 + ".1.1.1",
]


def test_awkward_texts(spark):
    df = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string").withColumn("TEXT_", F.lit(1)).withColumn("spans", F.lit("mine"))
    same(spark, df, pii.personal_data(df))
    assert pii.personal_data(df.limit(0)).count() == 0
    assert "mine" not in [str(r["spans"]) for r in pii.find_spans(df).collect()]


def test_long_texts_take_linear_time(spark):
    """Runs that a pattern could try from each of their places, or deepen the stack with."""
    texts = ["a" * 1_000_000, "1" * 1_000_000, "+" * 500_000, "a@" * 500_000, "a@b" + ".c" * 300_000, "1." * 500_000, "+1" + " " * 1_000_000, "10.0.0.1 a@b.co " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.personal_data(df).collect()}
    assert got == {0: (0, 0, 0, 0), 1: (0, 0, 0, 0), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0), 4: (1, 0, 0, 0), 5: (0, 125_000, 0, 0), 6: (0, 0, 0, 0), 7: (20_000, 20_000, 0, 0)}


@pytest.mark.parametrize("text, want", [
    ("IBAN GB82 WEST 1234 5698 7654 32 is his", "iban:5:32"),
    ("to de89370400440532013000, now", "iban:3:25"),
    ("to DE88370400440532013000, now", ""),
    ("his social security number 219-09-9999.", "ssn:27:38"),
    ("part 219-09-9999-1 and 000-12-1234", ""),
    ("call me: 030 1234567 8 at night", "phone:9:22"),
    ("lot 030 1234567 8 of the year", ""),
    ("card no. 4111 1111 1111 1111 12345 of his", "card:9:28"),
    ("nos. 4111 1111 1111 1111 12345 of them", ""),
    ("write to jo@example.com or call 555 123 4567", "email:9:23,phone:32:44"),
])
def test_what_the_method_adds(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.personal_data(df).first()["spans"] == want


def test_words_nearby_raise_the_score(spark):
    df = spark.createDataFrame([(1, "my e-mail is jo@example.com"), (2, "see jo@example.com")], "doc_id long, text string")
    a, b = (r["top_score"] for r in pii.personal_data(df).orderBy("doc_id").collect())
    assert a > b
