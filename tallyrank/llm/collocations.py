"""Phrase collocation mining: phrases of two to four words that stand together more than their parts would have it.

A task cuts its texts into shards of ``SHARD_BYTES``, turns them into word ids and sorts the suffixes by prefix doubling (by one
word, two, four: no phrase is longer). Suffixes that share n words are neighbours then; each LCP interval of depth n is one
phrase, its length the count. Counts are summed in the task, then merged by (lang, phrase) over all tasks.

Words are counted first, then pairs of frequent words, then phrases of three and four words whose pairs are frequent. What is
frequent goes out as a Bloom filter of a fixed size (16 MB), which lets some others through but loses none, so counts stay exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.llm.common import _BYTE, bounded_batches, chunks, dealt, mix, pieces, shared_table, span_hashes, word_hashes

#: Bytes of text in a shard, and rows of counts that a task holds back to sum them.
SHARD_BYTES, HELD_ROWS = 2 << 20, 200_000
#: Words of the longest phrase.
LONGEST = 4
#: The filter of frequent pairs: blocks of so many bits each, and probes of a pair in its block.
BLOCKS, BLOCK_BITS, PROBES = 1024, 1 << 17, 3
#: Parts that the candidates of one frequent word are dealt out to.
SALTS = 16

_SPACE, _CUT = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_CUT[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~(_SPACE | _CUT)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

COUNTED = "lang string, phrase string, n long"


# -- shards ----------------------------------------------------------------------------------------


def _ahead(data: np.ndarray, at: int) -> int:
    """Where the words end that a phrase from before ``at`` may reach."""
    size = 1024
    while True:
        part = data[at : at + size]
        cut = np.flatnonzero(_CUT[part])
        part = part[: cut[0]] if len(cut) else part
        word = _WORD[part]
        ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        if len(ends) >= LONGEST - 1:
            return at + int(ends[LONGEST - 2])
        if len(cut) or at + size >= len(data):
            return at + len(part)
        size *= 2


def shards(data: np.ndarray, off: np.ndarray, most: int = SHARD_BYTES):
    """(bytes, row offsets, own) of rows data[off[i]:off[i + 1]]. Rows stay whole but for a row of over ``most`` bytes, which is cut
    between pieces, or else between words; then bytes from ``own`` on are there to look ahead and belong to the next shard."""
    if len(data) <= most or len(off) > 2:
        yield data, off, len(data)
        return
    at = 0
    while at < len(data):
        to = min(len(data), at + most)
        own = end = to
        while to < len(data):
            cut, gap = np.flatnonzero(_CUT[data[at:to]]), np.flatnonzero(_SPACE[data[at:to]])
            if len(cut):
                own = end = at + int(cut[-1]) + 1
                break
            if len(gap):
                own = at + int(gap[-1]) + 1
                end = _ahead(data, own)
                break
            to = min(len(data), to + most)  # one very long word
            own = end = to
        yield data[at:end], np.array([0, end - at]), own - at
        at = own


class Shard:
    """The words of some texts: ids (from 1, by language and word), the piece that each lies in, and whether it is the shard's own."""

    def __init__(self, data: np.ndarray, off: np.ndarray, own: int, lang: np.ndarray):
        data = _LOWER[data]
        inside = _WORD[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = off[1:-1][off[1:-1] < len(data)]
        first[cut] = inside[cut]
        last[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(off, starts, "right") - 1
        self.n, self.own, self.lang = len(starts), starts < own, lang[row]
        self.piece = np.cumsum(_CUT[data])[starts] + row if self.n else row
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        self.word = np.asarray(coded.indices, np.int64)
        self.words = coded.dictionary.cast(pa.string())
        self.ids = self.lang * len(self.words) + self.word + 1
        self.hash = span_hashes(_BYTE[data], starts, ends)
        self.left = np.ones(self.n, np.int8)  # words from here to the end of the piece, up to LONGEST
        for h in range(1, LONGEST):
            self.left[: max(self.n - h, 0)] += self.piece[h:] == self.piece[: max(self.n - h, 0)]

    def known(self, bits: np.ndarray, langs: pa.Array) -> np.ndarray:
        """Whether a word is in a filter; each different word is looked up once."""
        place = np.zeros(int(self.ids.max(initial=0)) + 1, np.int64)
        place[self.ids[::-1]] = np.arange(self.n)[::-1]
        first = place[np.flatnonzero(np.bincount(self.ids, minlength=len(place)))]
        hit = np.zeros(len(place), bool)
        hit[self.ids[first]] = held(bits, keys(lang_hashes(langs)[self.lang[first]], self.hash[first]))
        return hit[self.ids]

    def pair_ranks(self, known: np.ndarray):
        """(rank of each place by two words, a place of each rank): the first round of prefix doubling. Ranks count from 1; 0 is for
        places without a second word, or where a word is not ``known``."""
        at = np.flatnonzero((self.left >= 2) & known & np.roll(known, -1))
        key, rank = self.ids[at] * (int(self.ids.max(initial=0)) + 1) + self.ids[(at + 1) % max(self.n, 1)], np.zeros(self.n, np.int64)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        rank[at] = back.reshape(-1) + 1
        return rank, at[first]

    def intervals(self, suffixes: np.ndarray, rank: np.ndarray):
        """(place, count) of the LCP intervals: suffixes are sorted by their rank at a depth, and neighbours of one rank share that many
        words. Only the shard's own suffixes count."""
        order = suffixes[np.argsort(rank[suffixes], kind="stable")]
        if not len(order):
            return order, order
        fresh = np.ones(len(order), bool)
        fresh[1:] = rank[order][1:] != rank[order][:-1]
        first = order[fresh]
        count = np.bincount(np.cumsum(fresh) - 1, self.own[order], len(first)).astype(np.int64)
        return first[count > 0], count[count > 0]

    def table(self, depth: int, at: np.ndarray, count: np.ndarray, langs: pa.Array) -> pa.Table:
        words = [self.words.take(pa.array(self.word[at + i])) for i in range(depth)]
        phrase = words[0] if depth == 1 else pc.binary_join_element_wise(*words, " ")
        return pa.table({"lang": langs.take(pa.array(self.lang[at])), "phrase": phrase, "n": count})


def words_of(s: Shard, langs: pa.Array) -> list[pa.Table]:
    """The words of a shard, and their number by language as the count of the empty phrase."""
    total = np.bincount(s.lang, s.own, len(langs)).astype(np.int64)
    return [pa.table({"lang": langs, "phrase": pa.array([""] * len(langs)), "n": total}), s.table(1, *s.intervals(np.arange(s.n), s.ids), langs)]


def pairs_of(s: Shard, langs: pa.Array, words: np.ndarray) -> list[pa.Table]:
    """The pairs of a shard both of whose words are in the filter."""
    two, _ = s.pair_ranks(s.known(words, langs))
    return [s.table(2, *s.intervals(np.flatnonzero(two), two), langs)]


def long_phrases(s: Shard, langs: pa.Array, words: np.ndarray, pairs: np.ndarray) -> list[pa.Table]:
    """Phrases of three and four words of a shard all of whose pairs are in the filter."""
    two, at = s.pair_ranks(s.known(words, langs))
    hit = np.concatenate([[False], held(pairs, keys(lang_hashes(langs)[s.lang[at]], s.hash[at], s.hash[(at + 1) % max(s.n, 1)]))])[two]
    three = np.flatnonzero((s.left >= 3) & hit & np.roll(hit, -1))
    four = three[(s.left[three] >= 4) & np.roll(hit, -2)[three]]
    rank = np.zeros(s.n, np.int64)
    rank[three] = two[three] * (int(s.ids.max(initial=0)) + 1) + s.ids[three + 2]
    deep = np.zeros(s.n, np.int64)  # the last round of prefix doubling: two words by two
    deep[four] = two[four] * (int(two.max(initial=0)) + 1) + two[four + 2]
    return [s.table(3, *s.intervals(three, rank), langs), s.table(4, *s.intervals(four, deep), langs)]


# -- the filter of pairs ----------------------------------------------------------------------------


def lang_hashes(langs: pa.Array) -> np.ndarray:
    return mix(word_hashes([x.encode() for x in langs.to_pylist()]), 3) if len(langs) else np.zeros(0, np.uint64)


def keys(lang: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """The filter's key of a word or of a pair."""
    return mix(lang + a * np.uint64(0x9E3779B97F4A7C15) + (mix(b, 1) if b is not None else np.uint64(0)), 2)


def probes(h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(block, places in it) of hashes."""
    low = BLOCK_BITS - 1
    return (h >> np.uint64(54)).astype(np.int64), [((h >> np.uint64(17 * i)) & np.uint64(low)).astype(np.int64) for i in range(PROBES)]


def held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    block, places = probes(h)
    out = np.ones(len(h), bool)
    for p in places:
        at = block * BLOCK_BITS + p
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def _marks(batches):
    for b in batches:
        words = [p.encode().split(b" ") for p in b.column("phrase").to_pylist()]
        lang = b.column("lang").dictionary_encode()
        if words:
            parts = [word_hashes(list(w)) for w in zip(*words, strict=True)]
            block, places = probes(keys(lang_hashes(lang.dictionary)[np.asarray(lang.indices)], *parts))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(block, PROBES)), pa.array(np.concatenate(places))], ["block", "place"])


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(BLOCK_BITS, np.uint8)
    bits[rows["place"].to_numpy()] = 1
    return pd.DataFrame({"block": rows["block"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def filter_of(phrases: DataFrame) -> np.ndarray:
    """The bytes of a filter of words, or of pairs. A block has ``BLOCK_BITS`` places and ``BLOCKS`` of them come to the driver, however
    many phrases there are."""
    marks = phrases.select("lang", "phrase").mapInArrow(_marks, "block long, place long").distinct()
    out = np.zeros(BLOCKS * BLOCK_BITS // 8, np.uint8)
    size = BLOCK_BITS // 8
    for r in marks.groupBy("block").applyInPandas(_block, "block long, bits binary").toLocalIterator():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


# -- counts -----------------------------------------------------------------------------------------


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
    return out.rename_columns(["lang", "phrase", "n"])


def _counter(phrases):
    def run(batches):
        tables, rows = [], 0
        for piece in pieces(batches, most=SHARD_BYTES):
            coded = piece.column("lang").dictionary_encode()
            lang = np.asarray(coded.indices, np.int64)
            for at, data, off in chunks(piece.column("text"), SHARD_BYTES):
                for part, cut, own in shards(data, off):
                    made = phrases(Shard(part, cut, own, lang[at:]), coded.dictionary)
                    tables += made
                    rows += sum(t.num_rows for t in made)
                    if rows > 2 * HELD_ROWS:
                        tables = [_summed(tables)]
                        rows = tables[0].num_rows
                        if rows > HELD_ROWS:
                            yield from tables[0].to_batches(max_chunksize=1 << 15)
                            tables, rows = [], 0
        if tables:
            yield from _summed(tables).to_batches(max_chunksize=1 << 15)

    return run


def frequent(texts: DataFrame, phrases, least: int) -> DataFrame:
    """(lang, phrase, words, n) of all phrases found ``least`` times, and of the empty phrase. Each task has summed its own, so rows are
    dealt out by phrase as they are."""
    counted = texts.mapInArrow(_counter(phrases), COUNTED).repartition("lang", "phrase")
    summed = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("phrase") == ""))
    return summed.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("words"), "n")


def count_phrases(docs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, n) of ``docs`` (lang, text): every phrase of one to four words found ``least`` times, written."""
    spark = bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    send = lambda rows: spark.sparkContext.broadcast(filter_of(rows))  # noqa: E731  # 16 MB, whatever the corpus
    words = shared_table(spark, frequent(texts, words_of, least), "words")
    w = send(words.filter("words = 1"))
    pairs = shared_table(spark, frequent(texts, lambda s, langs: pairs_of(s, langs, w.value), least), "pairs")
    p = send(pairs)
    longer = shared_table(spark, frequent(texts, lambda s, langs: long_phrases(s, langs, w.value, p.value), least), "phrases")
    return words.unionByName(pairs).unionByName(longer)


# -- scores -----------------------------------------------------------------------------------------


def _looked_up(cuts: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """Adds the count of a part. A frequent word is part of very many phrases, so both sides are salted."""
    table = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return cuts.join(dealt(table), ["lang", part, "salt"]).drop(part)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, swallowed: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs`` (lang, text; other columns are left out).

    A-Z are lower-cased; pieces end at ``[.,;:!?\\n-\\r]``, words are runs of other bytes than space and tab; null text is empty, null
    lang is ``und``. a: how often the phrase of two to four words stands within pieces, ``least`` times at least; l, r: the counts of
    its parts where it is cut so that score = floor(2000000 a / (l + r)) is lowest, after fewest words among equals; n: all words of
    the language. Phrases that lie inside a longer candidate with ``swallowed`` per cent of their count go. The first ``top`` of each
    language by score, count and phrase. Repeated rows count each time; without documents or candidates there are no rows.
    64 bits hold every step while counts are below 2 * 10**15.
    """
    counts = count_phrases(docs, least)
    found = counts.filter("words >= 2").withColumnRenamed("n", "a")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = _looked_up(_looked_up(cuts, counts.filter("words between 1 and 3"), "first", "l"), counts.filter("words between 1 and 3"), "rest", "r")
    # floor(2000000 a / d) in two steps of long division
    cuts = cuts.withColumn("score", F.expr("((a * 1000) div (l + r)) * 2000 + (((a * 1000) % (l + r)) * 2000) div (l + r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.score", "c.l", "c.r")
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longer = found.filter("words >= 3").select("lang", F.col("a").alias("longer"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(dealt(longer), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * swallowed))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # the best of each of many parts first, so that no task sorts a whole language
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(counts.filter("words = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
