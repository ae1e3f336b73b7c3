"""Words and beginnings are counted by arrays, as they are by text."""

from collections import Counter

import numpy as np
import pyarrow as pa

from tallyrank.llm import toxicity as T


def test_marks_are_counted_by_arrays():
    texts = [(1, ["worthless", "wor", "^wor", " a run", "nämlich"]), (0, ["worthy", "wört", "worthless"]), (1, []), (1, ["worthy"])]
    want: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for label, words in texts:
        want[label].update(set().union(*map(T.marks, words)))
    batch = pa.RecordBatch.from_pydict({"toxic": pa.array([x[0] for x in texts], pa.int32()), "words": pa.array([x[1] for x in texts], pa.list_(pa.string()))})
    empty = batch.slice(2, 1)
    got = [pa.Table.from_batches([x]).to_pylist() for x in T._told([batch, empty])]
    assert {(r["word"], r["yes"], r["no"]) for r in got[0]} == {(w, want[1][w], want[0][w]) for w in want[0] | want[1]} and got[1] == []


def test_marked_as_marks_say():
    words = ["worth", "^wor", "^worth", "^worthle", "x"]
    own = T.Classifier(None, words, np.ones(5), 0.0)
    for w in ("worth", "wor", "worthless", "worthle", "x", " worth", "", "^wor"):
        assert sorted(own._marked(w)) == sorted(x for x in T.marks(w) if x in own.weights)


def test_words_that_are_plain_are_found_again():
    restorer = T.Restorer(T.CharModel({"letter": 3, "plain": 2}))
    for _ in range(2):
        assert restorer.words("plain plain, l3tter " + "a" * 70) >= {"plain"}
    assert restorer.same == {"plain"} and "plain" in restorer.words("plain")
