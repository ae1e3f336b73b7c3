"""Truth tables of the column functions, traps included."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyrank.functions import columns as C

AS_OF = date(2024, 6, 30)


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_title_levels(spark):
    titles = ["SRE", "Internal Auditor", "Head of Data", "Associate Director", "Co-op", "Engineer", "Jr. Dev", "Staff", "Associate"]
    assert column(spark, titles, C.seniority_level) == [3, 0, 4, 6, 0, 2, 1, 5, 1]


def test_dates(spark):
    texts = ["2021-10-05", "2021-10", "2021", "10/05/2021", "2021/10/05", "10/2021", "Oct, 2021", "10 Oct 2021", "Present", "", None, " ", "''", "2021-02-30", "soon"]
    want = [date(2021, 10, 5), date(2021, 10, 1), date(2021, 1, 1), date(2021, 10, 5), date(2021, 10, 5), date(2021, 10, 1), date(2021, 10, 1), date(2021, 10, 10), AS_OF, None, None, AS_OF, AS_OF, None, None]
    assert column(spark, texts, lambda c: C.parse_date(c, AS_OF)) == want


def test_names(spark):
    names = ["Victor Smith", "Priya Sharma", "A/B", "Engineer", "", None, "N/A", "Ann | Bob"]
    assert column(spark, names, lambda c: C.valid_name(c, F.lit("Engineer"))) == [False, True, False, False, False, False, False, False]


def test_freshness(spark):
    seen = [None, "", "2024/01/01", "2024-07-30", "2024-06-30", "2024-06-23", "2023-07-01"]
    got = column(spark, seen, lambda c: C.freshness_score(c, AS_OF))
    assert got[:5] == [0.2, 0.0, 0.0, 1.0, 1.0]
    assert got[5] == pytest.approx(1.0)
    assert got[6] == pytest.approx(0.0, abs=1e-9)
    assert column(spark, seen, lambda c: C.freshness_label(C.active_days(c, AS_OF))) == ["Dormant"] * 3 + ["Active Now"] * 3 + ["Dormant"]


def test_duplicate_ratio(spark):
    assert column(spark, ["", None, "a" * 200, "a" * 400, "x"], C.duplicate_ratio) == [1.0, 1.0, 0.0, 0.5, 0.0]


def test_degrees(spark):
    assert column(spark, ["CFA"], lambda c: C.education_bonus(c, "FIN")) == [5.0]
    assert column(spark, ["m.d.", "MD", None], lambda c: C.education_bonus(c, "HEALTH")) == [0.0, 5.0, 0.0]
    assert column(spark, ["JD"], lambda c: C.education_bonus(c, "LEGAL")) == [5.0]


def test_words_and_masks(spark):
    assert column(spark, ["", None, " a\tb  c\n"], C.word_count) == [0, 0, 3]
    assert column(spark, ["the schpfö and Tion tion"], C.tokens) == [["the", "and", "tion"]]
    assert column(spark, ["short", "sk-1234567890"], C.mask_key) == ["*****", "sk-1*****7890"]
    assert column(spark, ['```json\n{"a": 1}\n```'], C.strip_fences) == ['{"a": 1}']
    assert column(spark, ["tech ", "x", None], C.sector_or_default) == ["TECH", "TECH", "TECH"]
    assert column(spark, ["FIN", "x"], C.sector_name) == ["Finance & Banking", "Specialist Domain"]
    assert column(spark, ["/a/jane_doe_resume.pdf", "x1.pdf"], C.name_from_file) == ["Jane Doe", None]


def test_roles(spark):
    assert column(spark, ["HTML author", "Maintenance", "React dev", "SRE", "Chef"], C.role_of) == ["Machine Learning", "Machine Learning", "Frontend", "DevOps", "Other"]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(C.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([1.0, 0.0, 0.0])
