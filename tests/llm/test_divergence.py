"""The divergence audit against plain Python, and its rows for awkward tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs, smooth, top):
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    docs = [(lang or "", source or "", TERM.findall(low(text))) for lang, source, text in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted((t for t, n in seen[lang].items() if n >= min_docs), key=str.encode)
        sources = [s for g, s in counts if g == lang]
        share = lambda c, n: 1 + 10**9 * (c + smooth) // (n + smooth * len(kept))
        p = {s: [share(counts[lang, s][t], sum(counts[lang, s][t] for t in kept)) for t in kept] for s in sources}
        n = sum(counts[lang, s][t] for s in sources for t in kept)
        q = [share(sum(counts[lang, s][t] for s in sources), n) for t in kept]
        for s in sources:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((q[i] - p[s][i], t.encode(), t) for i, t in enumerate(kept) if counts[lang, s][t] and p[s][i] > q[i])[:top]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms, 1)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"TERM": F.lit(1), "n": F.lit("x"), "rank": F.lit(0)})
    return sorted(map(tuple, divergence.audit(df, **how).collect()))


AWKWARD = [
    (None, None, None), (None, None, ""), ("en", None, "..."), ("en", "a", "Ä ä a B b zz 12 x_y éÉ"), ("en", "a", "Ä ä a B b zz 12 x_y éÉ"), ("en", "b", "a a a zz \U0001f600 Ä"), ("en", "c", None),
    ("de", "a", "nur hier"), ("fr", "a", "mot " * 4), ("fr", "b", "mot autre"), ("fr", "c", "autre"), ("en", "b", "x" * 100_000 + " a"),
]


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_awkward_tables(spark, min_docs):
    how = {"min_docs": min_docs, "smooth": 5, "top": 3}
    assert run(spark, AWKWARD, **how) == brute(AWKWARD, **how)
    assert run(spark, AWKWARD[:0], **how) == []


def test_many_terms_and_ties(spark):
    """More terms than a vector has, counts that tie, sources without any of them, a source with most documents."""
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(6000)]
    rows = [("en", f"s{int(rng.integers(0, 9)) if i % 3 else 0}", " ".join(rng.choice(words, 300))) for i in range(120)] + [("en", "empty", "1 2 3")]
    how = {"min_docs": 2, "smooth": 5, "top": 50}
    assert run(spark, rows, **how) == brute(rows, **how)


def test_proportions_are_exact():
    big = 8 * 10**15
    for count, total in [(5, 5), (1, big), (big - 1, big), (big, big), (7_777_777_777_777, big - 3), (5, 3 * 10**9 + 1)]:
        assert divergence.proportion(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total
