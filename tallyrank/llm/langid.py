"""Language identification by interpolated Kneser-Ney character models, one for each language.

A model reads the letters of a word between two word boundaries. The n-grams of all languages share one
sorted hash array for each order; beside each n-gram stand its log probabilities in every language, beside
each context the log weights of the next lower order. A text gets the language of lowest cross-entropy per
symbol. Its score is a softmax of the differences, whose scale is fitted on labelled texts that the models
have not seen. A text is rejected where its cross-entropy lies further above that of its language's own texts than
it does for all but ``REJECT_SHARE`` of those unseen texts.

The models are fitted on a bounded sample: about ``docs_per_lang`` different whole labelled texts of each language,
taken by a hash of the text, with all their words.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import mix, replacing, shared_table, span_hashes

ORDER = 5
UNKNOWN = "und"
#: One sampled text in so many is kept for calibration.
FOLDS = 8
#: Words whose scores a worker remembers.
MEMO = 250_000
#: The share of a language's own texts, unseen by its model, that the calibrated threshold rejects.
REJECT_SHARE = 0.001

words_of = regex.compile(r"[\p{L}\p{M}]+").findall
letter = regex.compile(r"\p{L}").search


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the symbols of all words, each word between boundaries, and the place of each word's first."""
    joined = "\x03" + "\x03\x03".join(words) + "\x03"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return mix(codes, 3) | np.uint64(1), np.concatenate([[0], np.cumsum(size)[:-1]])


def _grams(sym: np.ndarray, first: np.ndarray, k: int):
    """Places of the symbols that have k - 1 before them in their word; a word's opening boundary is never one."""
    at = np.arange(len(sym)) - np.repeat(first, np.diff(np.append(first, len(sym))))
    return np.flatnonzero(at >= max(1, k - 1))


class Models:
    """The n-gram tables. ``grams[k]``: sorted hashes; ``logp[k]``: a row of log probabilities, a column for each
    language; ``contexts[k]`` and ``gamma[k]``: the same for the weight of order k - 1."""

    def __init__(self, langs: list[str], counts: list[dict[str, int]]):
        self.langs, self.grams, self.logp, self.contexts, self.gamma = langs, {}, {}, {}, {}
        self.scale, self.mean, self.sd, self.most = 1.0, np.zeros(len(langs)), np.full(len(langs), np.inf), np.inf
        seen = [self._count(c) for c in counts]
        lower = None
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([s[k]["gram"] for s in seen]))
            context = np.unique(np.concatenate([s[k]["context"] for s in seen]))
            own, gamma = np.zeros((len(keys), len(langs))), np.ones((len(context), len(langs)))
            ctx_of, low_of = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for i, s in enumerate(seen):
                g = s[k]
                at, cx = np.searchsorted(keys, g["gram"]), np.searchsorted(context, g["context"])
                total, kinds = np.bincount(cx, weights=g["n"], minlength=len(context)), np.bincount(cx, minlength=len(context))
                once, twice = (g["n"] == 1).sum(), (g["n"] == 2).sum()
                d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
                own[at, i] = (g["n"] - d) / total[cx]
                gamma[total > 0, i] = d * kinds[total > 0] / total[total > 0]
                ctx_of[at] = cx
                if k > 1:
                    low_of[at] = np.searchsorted(self.grams[k - 1], g["suffix"])
            if k == 1:
                self.floor = 1.0 / (len(keys) + 1)
                p = own + gamma[ctx_of] * self.floor
            else:
                p = own + gamma[ctx_of] * lower[low_of]
            lower = p
            self.grams[k], self.contexts[k] = keys, context
            self.logp[k], self.gamma[k] = np.log(p).astype(np.float32), np.log(gamma).astype(np.float32)

    @staticmethod
    def _count(counts: dict[str, int]) -> dict[int, dict[str, np.ndarray]]:
        """For each order the n-grams, their contexts and suffixes, and their counts: of the highest order and of
        n-grams that open a word how often they occur, of others after how many symbols."""
        words = list(counts)
        sym, first = _symbols(words) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        weight = np.repeat(np.fromiter(counts.values(), np.int64, len(words)), np.diff(np.append(first, len(sym))))
        opens = np.zeros(len(sym) + 1, bool)
        opens[first] = True
        out, above = {}, None
        for k in range(ORDER, 0, -1):
            end = _grams(sym, first, k)
            gram, at, inv = np.unique(span_hashes(sym, end - k + 1, end + 1), return_index=True, return_inverse=True)
            n = np.bincount(inv, weights=weight[end], minlength=len(gram))
            e = end[at]
            if above is not None:
                kinds = np.bincount(np.searchsorted(gram, above), minlength=len(gram))
                n = np.where(opens[e - k + 1] & (k > 1), n, np.maximum(kinds, 1))
            above = span_hashes(sym, e - k + 2, e + 1)
            out[k] = {"gram": gram, "context": span_hashes(sym, e - k + 1, e), "suffix": above, "n": n}
        return out

    def strangeness(self, h: np.ndarray, n: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """How many standard deviations a text's cross-entropy lies above the mean of a language; short texts vary more."""
        return (h - self.mean[lang]) / (self.sd[lang] * (1 + 10 / np.sqrt(np.maximum(n, 1))))

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each word in each language, number of symbols of each word)."""
        sym, first = _symbols(words)
        total = np.zeros((len(sym), len(self.langs)), np.float32)
        level = np.zeros(len(sym), np.int64)
        for k in range(1, ORDER + 1):
            level[_grams(sym, first, k)] = k
        for k in range(ORDER, 0, -1):
            at = np.flatnonzero(level == k)
            if not len(at):
                continue
            h = span_hashes(sym, at - k + 1, at + 1)
            i = np.minimum(np.searchsorted(self.grams[k], h), len(self.grams[k]) - 1)
            found = self.grams[k][i] == h
            total[at[found]] += self.logp[k][i[found]]
            rest = at[~found]
            h = span_hashes(sym, rest - k + 1, rest)
            i = np.minimum(np.searchsorted(self.contexts[k], h), len(self.contexts[k]) - 1)
            known = self.contexts[k][i] == h
            total[rest[known]] += self.gamma[k][i[known]]
            level[rest] = k - 1
            if k == 1:
                total[rest] += np.float32(np.log(self.floor))
        return np.add.reduceat(total, first, axis=0), np.diff(np.append(first, len(sym))) - 1


class Reader:
    """Cross-entropies of texts; remembers the scores of words."""

    def __init__(self, models: Models):
        self.models, self.memo = models, {}
        self.table, self.size = np.zeros((0, len(models.langs)), np.float32), np.zeros(0, np.int64)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy of each text in each language, number of symbols; 0 where a text has no letter)."""
        found = [words_of(t.lower()) for t in texts]
        new = list(set().union(*found).difference(self.memo))
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            self.table, self.size = self.table[:0], self.size[:0]
            new = list(set().union(*found))
        if new:
            base = len(self.memo)
            self.memo.update(zip(new, range(base, base + len(new)), strict=True))
            table, size = self.models.score(new)
            self.table, self.size = np.concatenate([self.table, table]), np.concatenate([self.size, size])
        h, n = np.zeros((len(texts), len(self.models.langs))), np.zeros(len(texts), np.int64)
        get = self.memo.__getitem__
        for i, (text, words) in enumerate(zip(texts, found, strict=True)):
            if words and letter(text):
                at = np.fromiter(map(get, words), np.int64, len(words))
                n[i] = self.size[at].sum()
                h[i] = -self.table[at].sum(0, dtype=np.float64) / n[i]
        return h, n


def _groups(batch, names: tuple[str, ...], most: int = 2 << 20):
    """Rows of a batch in groups of about ``most`` characters."""
    got, size = [], 0
    for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
        got.append(row)
        size += len(row[0] or "")
        if size >= most:
            yield got
            got, size = [], 0
    if got:
        yield got


def fit(labelled: DataFrame, docs_per_lang: int = 1500) -> Models | None:
    """The models of rows that have ``text`` and ``lang``; None where there are none."""
    spark = labelled.sparkSession
    labelled = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    kinds = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()
    share = {r["lang"]: min(1.0, docs_per_lang / max(1, r["n"])) for r in kinds}
    if not share:
        return None
    part = F.create_map(*(F.lit(x) for kv in share.items() for x in kv))
    bucket = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 30))
    sample = labelled.filter(bucket < F.element_at(part, F.col("lang")) * (1 << 30)).select("text", "lang", F.pmod(F.xxhash64("text", F.lit(18)), F.lit(FOLDS)).alias("fold"))
    # a hash takes all copies of a text or none; each text counts once, so that copies don't break the bound
    sample = sample.dropDuplicates(["text", "lang"])
    sample = shared_table(spark, sample, "lang-sample")

    def count(batches):
        for batch in batches:
            got = Counter()
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                got.update((lang, w) for w in words_of(text.lower()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()), pa.array(list(got.values()), pa.int64())], names=["lang", "word", "n"])

    words = sample.filter("fold > 0").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    langs = sorted(share)
    counts: list[dict[str, int]] = [{} for _ in langs]
    for r in words.select("lang", "word", "n").collect():
        counts[langs.index(r["lang"])][r["word"]] = r["n"]
    models = Models(langs, counts)
    _calibrate(models, sample.filter("fold = 0"))
    return models


def _calibrate(models: Models, held: DataFrame) -> None:
    """Fits the softmax's scale and each language's usual cross-entropy on texts that the models have not seen."""
    sent = held.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        reader = Reader(sent.value)
        for batch in batches:
            for rows in _groups(batch, ("text", "lang")):
                h, n = reader.read([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string()), pa.array(n), pa.array(list(h), pa.list_(pa.float64()))], names=["lang", "n", "h"])

    rows = [r for r in held.mapInArrow(run, "lang string, n long, h array<double>").collect() if r["n"]]
    if not rows:
        return
    truth, n, h = np.array([models.langs.index(r["lang"]) for r in rows]), np.array([r["n"] for r in rows]), np.array([r["h"] for r in rows])
    def loss(scale: float) -> float:
        p = posterior(h, n, scale)[np.arange(len(truth)), truth]
        return -np.log(np.maximum(p, 1e-6)).mean()

    models.scale = min(2.0 ** np.arange(-4, 7), key=loss)
    for i in range(len(models.langs)):
        if (own := h[truth == i, i]).size > 1:
            models.mean[i], models.sd[i] = own.mean(), own.std() + 0.02
    models.most = float(np.quantile(models.strangeness(h[np.arange(len(truth)), truth], n, truth), 1 - REJECT_SHARE)) + 1e-9


def posterior(h: np.ndarray, n: np.ndarray, scale: float) -> np.ndarray:
    x = -scale * np.sqrt(np.maximum(n, 1))[:, None] * (h - h.min(1, keepdims=True))
    e = np.exp(x)
    return e / e.sum(1, keepdims=True)


def identify(docs: DataFrame, models: Models | None, reject: bool = False) -> DataFrame:
    """Adds lang_pred, score, cross_entropy (per symbol, natural log) and rejected to the rows of ``docs``, without ``text``.

    A null text, or one without a letter, gets ``und`` and score 0, and null for the rest. ``rejected`` tells texts whose
    cross-entropy is further above the mean of their language than the calibrated threshold; with ``reject`` these get
    ``und`` and score 0 too. Of languages of equal cross-entropy the first by code point wins. Without models every
    row gets ``und``. Only the text is read. Columns of these names in ``docs`` are replaced.
    """
    docs = docs.select(*replacing(docs, "lang_pred", "score", "cross_entropy", "rejected"))
    keep = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        models = sent.value
        reader = models and Reader(models)
        for batch in batches:
            pred, score, entropy, strange = [], [], [], []
            for rows in _groups(batch, ("text",)):
                if models is None:
                    pred, score, entropy, strange = pred + [UNKNOWN] * len(rows), score + [0.0] * len(rows), entropy + [None] * len(rows), strange + [None] * len(rows)
                    continue
                h, n = reader.read([r[0] or "" for r in rows])
                best, p = h.argmin(1), posterior(h, n, models.scale).max(1)
                low = h.min(1)
                ok = n > 0
                far = models.strangeness(low, n, best) > models.most
                strange += [bool(x) if k else None for x, k in zip(far, n > 0, strict=True)]
                if reject:
                    ok &= ~far
                pred += [models.langs[b] if x else UNKNOWN for b, x in zip(best, ok, strict=True)]
                score += [float(v) if x else 0.0 for v, x in zip(p, ok, strict=True)]
                entropy += [float(v) if x else None for v, x in zip(low, n > 0, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(strange, pa.bool_())], names=[*keep, "lang_pred", "score", "cross_entropy", "rejected"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*kept, "lang_pred string, score double, cross_entropy double, rejected boolean"]))
