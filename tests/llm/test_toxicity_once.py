"""What toxicity works out once instead of for each text or each order of strings."""

from collections import Counter

import numpy as np
from xxhash import xxh64_intdigest

from tallyrank.llm import toxicity as T


def test_strings_of_all_orders_from_the_longest():
    counts, want = {"letter": 3, "a": 1, "nämlich": 2, "letters": 5}, Counter()
    for word, n in counts.items():
        x = T.START + word + T.END
        for i in range(len(T.START), len(x)):
            for k in range(T.ORDER):
                want[k, x[i - k : i + 1]] += n
                want[T.ORDER + k, x[i - k : i]] += n
        if "tt" in word:
            want[T.KNOWN, word] += n
    longest = Counter()
    for (k, g), n in want.items():
        if k == T.ORDER - 1:
            longest[g] += n
    want = {(k, xxh64_intdigest(g)): n for (k, g), n in want.items()}
    assert T.grams(counts) == want and T._orders(longest, {"letter": 3, "letters": 5}) == want


def test_words_are_marked_once(monkeypatch):
    """Words met again, weighted or not, are not looked at again, in texts as in restored words."""
    classifier = T.Classifier(T.CharModel({"plain": 1, "words": 2}), ["word", "^wor"], np.array([1.0, 2.0]), 0.0)
    asked, own = [], T.Classifier._marked
    monkeypatch.setattr(T.Classifier, "_marked", lambda self, plain: asked.append(plain) or own(self, plain))
    restorer = T.Restorer(classifier.chars)
    for _ in range(3):
        assert classifier.found(restorer, "plain words") == ["^wor"]
    assert sorted(asked) == ["plain", "words"]
    asked.clear()
    fresh = classifier.fresh()
    for _ in range(3):
        assert fresh.of_words(["plain", "word", "worse", " the word"]) == ["^wor", "word"]
    assert sorted(asked) == ["plain", "word", "worse"]
