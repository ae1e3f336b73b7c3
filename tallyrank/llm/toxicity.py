"""Toxicity of texts whose words may be disguised.

A disguised word is read as a noisy copy of a plain one: digits and signs stand for letters, letters are
repeated, or separators stand between them. Its characters span a lattice of plain letters; Viterbi finds the
likeliest path under a character model of the training words and the costs of the channel. In a run of single
characters with spaces between them every space is an arc for nothing and one for the end of a word, so that
the same path cuts the run into words. The presence of restored words, and of beginnings of words, is scored by a
ridge logistic regression.

Both models are fitted on all labelled texts, each different one once: the character model on all their words, the regression on
the ``features`` words that tell the labels apart best (its size). Texts, words and counts stay in tables; the driver gets the counts of strings
of up to five characters, which grow as slowly as the vocabulary, and the regression is Spark's own.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from copy import copy
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyrank.llm.bloom import bits_for, bloom_of
from tallyrank.llm.common import dealt, pieces, replacing, shared_table, signed

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "aeiou"}
SEPARATORS = "._-*'~/\\|,:^=+"
#: Costs of the channel, in natural log units.
COST_LEET, COST_DROP, COST_DIGIT, COST_REPEAT = 1.0, 0.7, 4.0, 0.7
#: Characters that a letter's probability looks at, itself included; what stands before and after a word.
ORDER, START, END = 5, "\x02" * 4, "\x03"
#: Beginnings of words that are features too, for languages that put a stem first.
STEMS = (3, 4, 5, 6, 7)
#: Longer words are not counted by the character model, which is one of words, and their readings not remembered.
LONGEST = 64
#: Words and places whose readings a worker remembers, words without a weight among them, and counted words that a task holds.
MEMO, SEEN, GATHERED = 65_536, 200_000, 200_000
#: Counts of so many strings are looked up by a dict.
FEW = 50_000
#: A feature must be found in so many labelled texts.
LEAST_TEXTS = 4
#: The most bits of the filter of labelled ids, which only spares texts a way: what else it lets through goes in the join.
ID_BITS = 1 << 27
#: The ridge of a weight, the steps of the regression, and the decimals that its weights keep, so that the order of sums doesn't show.
RIDGE, STEPS, DECIMALS = 0.2, 60, 4

#: Signs that end words and stand for no letter.
_STOPS = ",.;:?\"'"
SPACED = re.compile(r"(?<!\S)(?:\S[^\S\n]){2,}\S(?!\S)")
_edges = re.compile(r"^[\W_]+|[\W_]+$")
_long_edge = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
_letter, _sign = re.compile(r"[^\W\d_]"), re.compile(r"[^\w\s]|\d")
_twice, _thrice = re.compile(r"([^\W\d_])\1"), re.compile(r"([^\W\d_])\1\1")


def _odd(word: str) -> bool:
    """Whether a word without white space has a letter, and signs, digits, a low line after it or a letter thrice."""
    first = _letter.search(word)
    return bool(first and (_sign.search(word) or word.rfind("_") > first.start() or _thrice.search(word)))


class Counts:
    """Counts of strings in two sorted arrays, by a 64-bit hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = array("Q", keys[order].astype(np.uint64).tobytes()), array("Q", counts[order].astype(np.uint64).tobytes())

        self.few: dict[int, int] | None = None

    def fresh(self) -> Counts:
        """The same, by a dict where the strings are few, as short ones are."""
        own = copy(self)
        own.few = dict(zip(self.keys, self.counts, strict=True)) if len(self.keys) <= FEW else None
        return own

    def __getitem__(self, gram: str) -> int:
        key = xxh64_intdigest(gram)
        if self.few is not None:
            return self.few.get(key, 0)
        at = bisect_left(self.keys, key)
        return self.counts[at] if at < len(self.keys) and self.keys[at] == key else 0


#: Kinds of counted strings beside those of k characters (k) and what stands before their last (ORDER + k).
KNOWN = 2 * ORDER


def grams(counts: dict[str, int]) -> Counter:
    """Counts by (kind, hash) of the strings that the character model needs of words; of whole words those with a letter twice."""
    longest: Counter = Counter()
    known = {word: n for word, n in counts.items() if _twice.search(word)}
    for word, n in counts.items():
        x = START + word + END
        for i in range(len(x) - ORDER + 1):
            longest[x[i : i + ORDER]] += n
    return _orders(longest, known)


def _gathered(batches):
    """Counts of different words (word, n), ``GATHERED`` of them at a time."""
    held: dict[str, int] = {}
    for batch in batches:
        held.update(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True))
        if len(held) >= GATHERED:
            yield held
            held = {}
    if held:
        yield held


def _orders(own: Counter, known: dict[str, int]) -> Counter:
    """What ``grams`` gives, from the counts of strings of ``ORDER`` characters: each shorter one ends some of those, and each
    string without its last character stands before it."""
    made = {KNOWN: known}
    for k in range(ORDER - 1, -1, -1):
        made[k], made[ORDER + k], shorter = own, Counter(), Counter()
        for g, n in own.items():
            made[ORDER + k][g[:-1]] += n
            shorter[g[1:]] += n
        own = shorter
    return Counter({(kind, xxh64_intdigest(g)): n for kind, of in made.items() for g, n in of.items()})


class CharModel:
    """log P(c | up to four characters before) of words' letters, interpolated over the orders."""

    def __init__(self, counts: dict[str, int]):
        got = grams(counts)
        self._take(*(np.array([f(x) for x in got.items()], t) for f, t in ((lambda x: x[0][0], np.int64), (lambda x: x[0][1], np.uint64), (lambda x: x[1], np.int64))))

    @classmethod
    def of(cls, rows: pa.Table) -> CharModel:
        """The model of summed ``grams``: kind, h (signed), n."""
        own = cls.__new__(cls)
        own._take(rows["kind"].to_numpy(), rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy())
        return own

    def _take(self, kind: np.ndarray, h: np.ndarray, n: np.ndarray) -> None:
        made = [Counts(h[kind == k], n[kind == k]) for k in range(KNOWN + 1)]
        self.grams, self.before, self.known, self.memo = made[:ORDER], made[ORDER:KNOWN], made[KNOWN], {}
        self.size, self.total = len(made[0].keys) + 1, sum(made[ORDER].counts)

    def fresh(self) -> CharModel:
        """The same without what it remembers."""
        own = copy(self)
        own.memo, own.grams, own.before = {}, [x.fresh() for x in self.grams], [x.fresh() for x in self.before]
        return own

    def log(self, context: str, c: str) -> float:
        if (got := self.memo.get(context + c)) is None:
            p = (self.grams[0][c] + 0.1) / (self.total + 0.1 * self.size)
            n = b = 1
            for k in range(1, ORDER):
                h = context[-k:]
                # what never stood in a word, or before a letter, doesn't with more before it
                b = b and self.before[k][h]
                n = n and b and self.grams[k][h + c]
                p = (n + 3 * p) / (b + 3)
            if len(self.memo) >= SEEN:
                self.memo.clear()
            got = self.memo[context + c] = log(p)
        return got


def lattice(word: str) -> list[list[tuple[int, str, float]]]:
    """From each place of the word the arcs (next place, letters, cost); a space among the letters ends a word."""
    arcs: list[list[tuple[int, str, float]]] = [[] for _ in word]
    i = 0
    while i < len(word):
        j = i + 1
        while j < len(word) and word[j] == word[i]:
            j += 1
        run, c = j - i, word[i]
        if c == " ":
            arcs[i] = [(j, "", 0.0), (j, " ", 0.0)]
            i = j
            continue
        reads = [(c, 0.0)] if c.isalpha() else [(x, COST_LEET) for x in LEET.get(c, "")]
        for x, cost in reads:
            arcs[i].append((j, x, cost + (COST_REPEAT if run > 1 else 0.0)))
            if run > 1:
                arcs[i].append((j, x + x, cost + (COST_REPEAT if run > 2 else 0.0)))
        if not c.isalnum():
            arcs[i].append((j, "", COST_DROP))
        elif c.isdigit() and (i == 0 or j == len(word)):
            arcs[i].append((j, "", COST_DIGIT))
        elif not reads:
            arcs[i].append((j, c * run, 0.0))
        i = j
    return arcs


def decode(word: str, model: CharModel) -> str:
    """The likeliest plain word behind ``word``, or words where it is a run with spaces; of equals the last by code point."""
    arcs = lattice(word)
    # readings are chains of letters, so that words of any length take time and memory in proportion
    best: list[dict[str, tuple[float, tuple]] | None] = [{} for _ in range(len(word) + 1)]
    best[0][START] = (0.0, ())
    memo = model.memo
    for i in range(len(word)):
        states, best[i] = best[i], None
        for context, (score, read) in states.items():
            for j, letters, cost in arcs[i]:
                s, h = score - cost, context
                for c in letters:
                    if c == " ":
                        s, h = s + model.log(h, END), START
                    else:
                        p = memo.get(x := h + c)
                        s, h = s + (model.log(h, c) if p is None else p), x[1:]
                if h not in best[j] or best[j][h][0] < s:
                    best[j][h] = (s, (read, letters) if letters else read)
    ends = [(s + model.log(h, END), _letters(read)) for h, (s, read) in best[-1].items()]
    return max(ends)[1] if ends else word


def _letters(read: tuple) -> str:
    out = []
    while read:
        read, letters = read
        out.append(letters)
    return "".join(reversed(out))


class Restorer:
    """Plain forms of words and texts; remembers those of words."""

    def __init__(self, model: CharModel):
        self.model, self.memo, self.same = model, {}, set()

    def read(self, word: str) -> str:
        """The plain form of a lower-case word without white space.

        Words with a doubled letter are read unless the model was trained on them; words without a letter are
        read where a sign among others may stand for one. Numbers stay, and other signs alone are empty."""
        got = word.rstrip(_STOPS)
        if got.isalpha() and not _twice.search(got):
            return got
        # a run of signs at an edge has three at least
        core = _long_edge.sub("", _long_edge.sub("", word)) if word[:1] * 3 == word[:3] or word[-1:] * 3 == word[-3:] else word
        plain = _edges.sub("", core)
        if plain.isalpha() and not _odd(plain) and (plain == core or not any(c in LEET for c in core.replace(plain, ""))):
            return decode(plain, self.model) if _twice.search(plain) and not self.model.known[plain] else plain
        if _odd(core) or len(core) > 1 and not _letter.search(core) and any(c in LEET and not c.isdigit() for c in core):
            return decode(core, self.model)
        return plain

    def word(self, word: str) -> str:
        """What ``read`` gives, remembered."""
        if (got := self.memo.get(word)) is None:
            got = self.read(word)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(word) <= LONGEST:
                self.memo[word] = got
        return got

    def words(self, text: str) -> set[str]:
        """The plain forms in a text; those that may hold several words, of spaced-out runs joined and of long words, are
        there with a leading space."""
        text = text.lower()
        found = set(text.split())
        # most words are plain as they stand
        out = found & self.same
        for w in found - out:
            out.add(got := self.word(w))
            if len(w) > LONGEST:
                out.add(" " + got)
            elif got == w:
                if len(self.same) >= MEMO:
                    self.same.clear()
                self.same.add(w)
        return out.union(self.spaced(found, text))

    def spaced(self, words: set[str], text: str) -> set[str]:
        """The words that the spaced-out runs of a lower-case text spell, and each run joined, with a leading space;
        ``words``: the text's words."""
        out: set[str] = set()
        if 1 in map(len, words):
            for run in SPACED.findall(text):
                if any(map(str.isalpha, run)):
                    read = self.run(run)
                    out.update(read.split())
                    out.add(" " + read.replace(" ", ""))
        return out

    def run(self, run: str) -> str:
        """The words that a run of single characters with white space between them spells."""
        return decode(" ".join(run.split()), self.model)

    def text(self, text: str) -> str:
        """The text in its plain form, spaced-out runs as the words they spell, white space as it is."""
        out, at, low = [], 0, text.lower()
        plain = lambda part: re.sub(r"\S+", lambda m: self.word(m[0]), part)
        for m in SPACED.finditer(low):
            if any(map(str.isalpha, m[0])):
                out += [plain(low[at : m.start()]), self.run(m[0])]
                at = m.end()
        return "".join([*out, plain(low[at:])])


def marks(word: str) -> tuple[str, ...]:
    """A word and its beginnings, which are marked by ^; nothing of one with a leading space."""
    return () if word[:1] == " " else (word, *("^" + word[:k] for k in STEMS if len(word) > k))


class Classifier:
    """Weights of plain words; a spaced-out run and a long word count for every weighted word inside them."""

    def __init__(self, chars: CharModel, words: list[str], weights: np.ndarray, bias: float):
        self.chars, self.weights, self.bias = chars, dict(zip(words, weights.tolist(), strict=True)), bias
        self.long, self.memo, self.none = [w for w in words if len(w) >= 4 and w[0] != "^"], {}, set()
        #: Weighted beginnings of words by their first letters.
        self.heads: dict[str, list[str]] = {}
        for w in words:
            if w[:1] == "^":
                self.heads.setdefault(w[1 : 1 + STEMS[0]], []).append(w)

    def fresh(self) -> Classifier:
        """The same without what it remembers, so that a task's memory goes with the task."""
        own = Classifier(self.chars.fresh(), [], np.zeros(0), self.bias)
        own.weights, own.long, own.heads = self.weights, self.long, self.heads
        return own

    def found(self, restorer: Restorer, text: str) -> list[str]:
        out, text = set(), text.lower()
        words, memo = set(text.split()), self.memo
        # most words have no weight, and most of those are plain as they stand
        for w in words.difference(self.none):
            if (got := memo.get(w)) is None:
                plain = w.rstrip(_STOPS)
                if len(w) <= LONGEST and plain.isalpha() and not _twice.search(plain):
                    got = self._kept(w, self._marked(plain))
                else:
                    got = self._of(restorer, w)
            out.update(got)
        for w in restorer.spaced(words, text):
            out.update(x for x in self.long if x in w[1:]) if w[0] == " " else out.update(self._marked(w))
        return sorted(out)

    def of_words(self, words: list[str]) -> list[str]:
        """The weighted words among what ``Restorer.words`` gave for a text; ``found`` gives the same for the text."""
        out, memo = set(), self.memo
        for w in set(words).difference(self.none):
            if w[:1] == " ":
                out.update(x for x in self.long if x in w[1:])
                continue
            if (got := memo.get(w)) is None:
                got = self._kept(w, self._marked(w))
            out.update(got)
        return sorted(out)

    def _marked(self, plain: str) -> tuple[str, ...]:
        own = (plain,) if plain in self.weights and plain[:1] != " " else ()
        if (heads := self.heads.get(plain[: STEMS[0]])) is None:
            return own
        return own + tuple(x for x in heads if plain.startswith(x[1:]) and len(plain) >= len(x))

    def _kept(self, word: str, got: tuple[str, ...]) -> tuple[str, ...]:
        """``got``, remembered as what ``word`` has."""
        if len(self.memo) + len(self.none) >= SEEN:
            self.memo.clear()
            self.none.clear()
        if got:
            self.memo[word] = got
        else:
            self.none.add(word)
        return got

    def _of(self, restorer: Restorer, word: str) -> tuple[str, ...]:
        """The weighted words in a word as it stands; a worker remembers them."""
        plain = restorer.read(word)
        got = self._marked(plain)
        if len(word) > LONGEST:
            return got + tuple(x for x in self.long if x in plain)
        return self._kept(word, got)

    def score(self, restorer: Restorer, text: str) -> float:
        x = self.bias + sum(self.weights[w] for w in self.found(restorer, text))
        return 1 / (1 + np.exp(-min(50.0, max(-50.0, x))))


def _ridge(rows: DataFrame, features: int, total: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression of rows (toxic, has: the places of its features, n: how many texts), ``total`` texts."""
    place = F.udf(lambda has: Vectors.sparse(max(features, 1), sorted(has), [1.0] * len(has)), VectorUDT())
    data = rows.select(F.col("toxic").cast("double").alias("label"), place("has").alias("features"), F.col("n").alias("weight"))
    made = LogisticRegression(weightCol="weight", regParam=RIDGE / total, standardization=False, maxIter=STEPS, tol=1e-8, family="binomial").fit(data)
    return np.round(made.coefficients.toArray()[:features], DECIMALS), round(float(made.intercept), DECIMALS)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): every different labelled text once for each of its labels."""
    ids = labels.select(F.xxhash64("doc_id").alias("h")).distinct()
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(ids, min(ID_BITS, bits_for(ids.count()))))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("h"))

    def likely(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array(sent.value.has(batch.column("h").to_numpy().view(np.uint64)), pa.bool_()))

    texts = texts.mapInArrow(likely, texts.schema)
    return texts.join(dealt(labels), "doc_id").select("text", "toxic").dropDuplicates(["text", "toxic"])


def _told(batches):
    """In how many texts of each label a word of ``Restorer.words`` is found, or a beginning of one (``marks``): word, yes, no."""
    for batch in batches:
        found, label = batch.column("words"), batch.column("toxic").to_numpy()
        words = found.flatten().dictionary_encode()
        row, of = np.repeat(np.arange(len(label)), found.value_lengths().to_numpy()), words.indices.to_numpy()
        own = words.dictionary
        long, single = pc.utf8_length(own).to_numpy(), ~pc.starts_with(own, " ").to_numpy(zero_copy_only=False)
        parts = [own, *(pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(own, 0, k), "") for k in STEMS)]
        marked = pa.concat_arrays([x.cast(pa.string()) for x in parts]).dictionary_encode()
        place, n = marked.indices.to_numpy().reshape(len(parts), -1).astype(np.int64), len(marked.dictionary)
        codes = []
        for at, k in zip(place, (0, *STEMS), strict=True):
            has = ((long > k) & single)[of]
            codes.append(row[has] * n + at[of[has]])
        code = np.unique(np.concatenate(codes)) if n else np.zeros(0, np.int64)
        yes = label[code // max(n, 1)] == 1
        counts = [np.bincount(code[x] % max(n, 1), minlength=n) for x in (yes, ~yes)]
        some = counts[0] + counts[1] > 0
        yield pa.RecordBatch.from_arrays([marked.dictionary.filter(pa.array(some)), *(pa.array(x[some].astype(np.int64)) for x in counts)], names=["word", "yes", "no"])


def fit(docs: DataFrame, labels: DataFrame, features: int = 600) -> Classifier | None:
    """The classifier of all rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic: 0 or 1) marks; other
    labels and null ids don't count. None where either label is missing."""
    spark = docs.sparkSession
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    n = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    texts = shared_table(spark, labelled(docs, labels), "toxic-texts")
    of = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(of) < 2:
        return None

    def count(batches):
        for batch in pieces(batches):
            raw, got = Counter(), Counter()
            for text in batch.column("text").to_pylist():
                raw.update(text.lower().split())
            for x, n in raw.items():
                if (w := x if x.isalpha() else _edges.sub("", x)).isalpha() and len(w) <= LONGEST:
                    got[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["word", "n"])

    def cut(batches):
        for counts in _gathered(batches):
            got = grams(counts)
            h = np.fromiter((k[1] for k in got), np.uint64, len(got))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.int32()), pa.array(signed(h)), pa.array(list(got.values()), pa.int64())], names=["kind", "h", "n"])

    words = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    chars = CharModel.of(words.mapInArrow(cut, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")).toArrow())
    sent = spark.sparkContext.broadcast(chars)

    def restored(batches):
        restorer = Restorer(sent.value.fresh())
        for batch in pieces(batches):
            got = [sorted(w for w in restorer.words(x) if w) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(got, pa.list_(pa.string()))], names=["toxic", "words"])

    # texts are restored once; features and rows of the regression come from their words
    read = shared_table(spark, texts.mapInArrow(restored, "toxic int, words array<string>"), "toxic-words")

    told = read.mapInArrow(_told, "word string, yes long, no long").groupBy("word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    a, b, c, d = F.col("yes"), F.lit(of[1]) - F.col("yes"), F.col("no"), F.lit(of[0]) - F.col("no")
    # the log-likelihood ratio of a word and the label; odds by their error would rank common words over those found with one label only
    part = lambda x, word, label: F.when(x > 0, x * F.log(x * (of[0] + of[1]) / (word * label))).otherwise(0.0)
    tells = part(a, a + c, F.lit(of[1])) + part(b, b + d, F.lit(of[1])) + part(c, a + c, F.lit(of[0])) + part(d, b + d, F.lit(of[0]))
    words = [r["word"] for r in told.filter(F.col("yes") + F.col("no") >= LEAST_TEXTS).orderBy(F.desc(F.round(tells, 6)), "word").limit(features).collect()]
    blank = Classifier(chars, words, np.zeros(len(words)), 0.0)
    at = {w: i for i, w in enumerate(words)}
    weighted = blank.weights, blank.long, blank.heads

    def rows(batches):
        own = Classifier(None, [], np.zeros(0), 0.0)
        own.weights, own.long, own.heads = weighted
        for batch in batches:
            got = [[at[w] for w in own.of_words(found)] for found in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(got, pa.list_(pa.int32()))], names=["toxic", "has"])

    found = read.mapInArrow(rows, "toxic int, has array<int>").groupBy("toxic", "has").agg(F.count("*").cast("double").alias("n"))
    weights, bias = _ridge(shared_table(spark, found, "toxic-rows"), len(words), of[0] + of[1])
    # copies count once above; the bias goes back to the labels' own odds
    return Classifier(chars, words, weights, bias + log(n[1] / n[0]) - log(of[1] / of[0]))


def drop_toxic(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, as they are; without a classifier all."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        classifier = sent.value and sent.value.fresh()
        restorer = classifier and Restorer(classifier.chars)
        for batch in pieces(batches):
            if classifier:
                batch = batch.filter(pa.array([classifier.score(restorer, x or "") < 0.5 for x in batch.column("text").to_pylist()], pa.bool_()))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, classifier: Classifier | None, restored: bool = False) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 where score >= 0.5) to the rows of ``docs``, without ``text``.

    With ``restored`` the text in its plain form comes too, as ``restored_text``. A null text counts as empty
    and gets the score of the bias alone. Without a classifier the score is 0. Only the text is read. Equal
    rows stay, an empty table stays empty. Columns of these names in ``docs`` are replaced.
    """
    made = ["score", "predicted", *["restored_text"] * restored]
    docs = docs.select(*replacing(docs, *made))
    keep = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        classifier = sent.value and sent.value.fresh()
        restorer = classifier and Restorer(classifier.chars)
        for batch in pieces(batches):
            found = [x or "" for x in batch.column("text").to_pylist()]
            score = [classifier.score(restorer, x) if classifier else 0.0 for x in found]
            more = [pa.array([restorer.text(x) if restorer else x for x in found], pa.string())] if restored else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score, pa.float64()), pa.array([int(x >= 0.5) for x in score], pa.int32()), *more], names=[*keep, *made])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*kept, "score double, predicted int", *["restored_text string"] * restored]))
