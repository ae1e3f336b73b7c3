"""Phrase mining against plain Python, and its shards against whole texts."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrank.llm import collocations


def phrases_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    for piece in re.split("[.,;:!?\n-\r]", low):
        words = [w for w in re.split("[ \t]", piece) if w]
        for m in range(1, 5):
            for i in range(len(words) - m + 1):
                yield tuple(words[i : i + m])


def brute(rows, least, top=2000, swallowed=80):
    f = defaultdict(Counter)
    for lang, text in rows:
        f[lang or "und"].update(phrases_of(text))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if a >= least}
        scored = []
        for p, a in often.items():
            if len(p) == 1:
                continue
            if any(len(q) > len(p) and 100 * b >= swallowed * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        n = sum(a for p, a in c.items() if len(p) == 1)
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"PHRASE": F.lit(1), "n": F.lit("x"), "words": F.lit(2)})
    return sorted(map(tuple, collocations.collocations(df, **how).collect()))


AWKWARD = [(None, None), (None, ""), ("en", "A b c d e. a B c d e"), ("en", "a b c d e"), ("en", "a b c d e"), ("und", "x y x y x y"), (None, "x  y\tx y"), ("de", ".,;:"), ("de", "é ß é ß é ß\x1f ü"), ("fr", "no no no no no no")]


@pytest.mark.parametrize("least, swallowed", [(1, 80), (2, 80), (3, 30), (3, 101)])
def test_awkward_tables(spark, least, swallowed):
    assert run(spark, AWKWARD, least=least, swallowed=swallowed) == brute(AWKWARD, least, 2000, swallowed)
    assert run(spark, AWKWARD[:2], least=1) == []


def test_random_texts_and_the_first_of_each_language(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(12)] + ["the"] * 8
    rows = [(("en", "de")[i % 5 == 0], "".join(str(w) + str(s) for w, s in zip(rng.choice(vocabulary, 400), rng.choice([" ", "  ", ". ", "\t", "\n"], 400, p=[0.6, 0.1, 0.1, 0.1, 0.1]), strict=True))) for i in range(40)]
    want = brute(rows, 4)
    assert run(spark, rows, least=4) == want and len(want) > 300
    assert run(spark, rows, least=4, top=25) == sorted(r for r in want if r[1] <= 25)


@pytest.mark.parametrize("most", [1, 7, 40, 200, 10**6])
@pytest.mark.parametrize("marks", [" ", " . ", "\t,  "])
def test_shards_count_every_phrase_once(most, marks):
    """A long text cut anywhere, between pieces or between words, in short and long words."""
    rng = np.random.default_rng(most)
    text = "".join(str(w) + str(m) for w, m in zip(rng.choice(["a", "bb", "ccc" * 9, "é"], 300), rng.choice(list(marks), 300), strict=True))
    data = np.frombuffer(text.encode(), np.uint8)
    got = Counter()
    full = np.full(collocations.BLOCKS * collocations.BLOCK_BITS // 8, 255, np.uint8)
    langs = pa.array(["en"])
    for part, off, own in collocations.shards(data, np.array([0, len(data)]), most):
        s = collocations.Shard(part, off, own, np.zeros(1, np.int64))
        for t in [*collocations.words_of(s, langs)[1:], *collocations.pairs_of(s, langs, full), *collocations.long_phrases(s, langs, full, full)]:
            got.update({tuple(p.split(" ")): n for p, n in zip(t["phrase"].to_pylist(), t["n"].to_pylist(), strict=True)})
    assert got == Counter(phrases_of(text))
