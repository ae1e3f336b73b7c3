"""Every pair is held, however small the filters are."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.llm import lm_scoring as L
from tallyrank.llm.common import mix


def test_small_filters_leave_no_pair_out(spark):
    """Some 17,000 pairs found once or twice; one filter of 2**16 bits can't hold them."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(1500)}" for _ in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda **sizes: [r["score"] for r in L.score_texts(docs, docs, **sizes).orderBy("doc_id").collect()]
    assert score(bits=1 << 16) == pytest.approx(score(), rel=2e-3)


def test_condition_stands_for_a_table(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, None), (3, "a b"), (None, "c c")], "doc_id long, text string")
    some = F.col("doc_id") != 3
    assert sorted(map(repr, L.score_texts(docs, some).collect())) == sorted(map(repr, L.score_texts(docs, docs.filter(some)).collect()))


def test_packed_arrays_come_back():
    k = np.sort(mix(np.arange(1000, dtype=np.uint64), 5))
    assert (L._unpacked_keys(L._packed_keys(k)) == k).all() and (np.sort(L._unmixed(k)) == np.arange(1000)).all()
    for x in (np.array([], np.int64), np.array([0, 255]), np.array([256]), np.array([1 << 40, 3])):
        assert (L._wide(L._narrow(x)) == x).all()


def test_larger_filters_are_cut_up():
    """Keys in several filters read back as in one."""
    keys, counts = mix(np.arange(20000, dtype=np.uint64)), np.arange(20000) % 40
    (got,) = L._levels(1 << 16, [(L.PAIR, keys, keys, counts)], [(L.PAIR, keys, keys)])
    want = np.where(counts > 0, L.level(counts), 0)
    assert (got >= want).all() and (got != want).mean() < 0.01
