"""Source divergence audit: how far the sources of a language lie apart in the terms they use.

Terms are coded as integers. A language's kept terms stand in sorted arrays, in chunks of ``CHUNK_TERMS``; a term's id is its
chunk and its place there (``searchsorted``), so ids go up in UTF-8 order and ties are broken by them. Counts of a group
are one ``bincount`` of ids a chunk, dense vectors of one length for all groups of the language.

The work is dealt out by term, then by chunk: no dictionary is held whole anywhere, and a source that has most of the
documents has no more terms than the others. A task holds one fragment's counts and a sum for each pair of a language's groups. What grows with the square of a language's sources is the answer itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.llm.common import bounded_batches, chunks, pieces, shared_table

#: Terms of a chunk, and counts (terms by groups) of a fragment of it, at most.
CHUNK_TERMS, CELLS = 4096, 1 << 22
#: Bytes of text that are counted at once, and rows of counts that a task holds back to sum them.
TEXT_BYTES, HELD_ROWS = 4 << 20, 400_000
#: Groups that are compared with one group at a time.
BLOCK = 256

_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

COUNTED = "lang string, source string, term string, n long, docs long"
VECTORS = "lang string, chunk long, terms array<string>, sources array<string>, counts array<long>"
FOUND = "lang string, source string, item string, id long, value long"


def proportion(count: np.ndarray, total: np.ndarray, scale_steps=(1000, 1000, 1000)) -> np.ndarray:
    """1 + floor(10**9 * count / total) for 0 < count <= total, by long division: 64 bits hold every step while the total
    is below 9 * 10**15."""
    count, out = np.asarray(count, np.int64), 0
    for step in scale_steps:
        q, count = np.divmod(count * step, total)
        out = out * step + q
    return out + 1


def term_spans(data: np.ndarray, off: np.ndarray):
    """(start, end, row) of the terms of the rows data[off[i]:off[i + 1]]; a term never crosses rows."""
    inside = _TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[1:-1][off[1:-1] < len(data)]
    first[cut] = inside[cut]
    last[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def count_terms(batch: pa.RecordBatch) -> pa.Table:
    """COUNTED of some documents (lang, source, text): occurrences and documents by group and term."""
    codes = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
    lang, source = (np.asarray(c.indices, np.int64) for c in codes)
    made = []
    for at, data, off in chunks(batch.column("text"), TEXT_BYTES):
        starts, ends, row = term_spans(data, off)
        if not len(starts):
            continue
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        held = _LOWER[data[_TERM[data]]]
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
        n = len(coded.dictionary)
        pair, times = np.unique(row * n + np.asarray(coded.indices, np.int64), return_counts=True)  # one for each document and term
        row, term = pair // n + at, pair % n
        key, where = np.unique((lang[row] * len(codes[1].dictionary) + source[row]) * n + term, return_inverse=True)
        where = where.reshape(-1)
        group, term = key // n, key % n
        made.append(pa.table({
            "lang": codes[0].dictionary.take(pa.array(group // len(codes[1].dictionary))), "source": codes[1].dictionary.take(pa.array(group % len(codes[1].dictionary))),
            "term": coded.dictionary.take(pa.array(term)).cast(pa.string()), "n": np.bincount(where, times, len(key)).astype(np.int64), "docs": np.bincount(where, minlength=len(key)),
        }))
    return pa.concat_tables(made) if made else None


def _summed(table: pa.Table) -> pa.Table:
    out = table.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns(["lang", "source", "term", "n", "docs"])


def _count(batches):
    held, rows = [], 0
    for piece in pieces(batches, most=TEXT_BYTES):
        made = count_terms(piece)
        if made is None:
            continue
        held.append(made)
        rows += made.num_rows
        if rows > 2 * HELD_ROWS:
            held = [_summed(pa.concat_tables(held))]
            rows = held[0].num_rows
            if rows > HELD_ROWS:
                yield from held[0].to_batches(max_chunksize=1 << 15)
                held, rows = [], 0
    if held:
        yield from _summed(pa.concat_tables(held)).to_batches(max_chunksize=1 << 15)


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n): occurrences of the terms that ``min_docs`` documents of the language have. One exchange, by
    language and term, of counts that each task has summed."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count, COUNTED)
    summed = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    known = summed.withColumn("docs", F.sum("docs").over(W.partitionBy("lang", "term")))
    return known.filter(F.col("docs") >= min_docs).drop("docs")


def _vectors(batches):
    """Rows in order of (lang, term) to rows of ``VECTORS``, at most ``CHUNK_TERMS`` terms and one language each."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    lang, rows, n_terms, last, names = None, [], 0, None, set()

    def chunk():
        nonlocal made, rows, n_terms
        kept = np.array(sorted({t for t, _, _ in rows}), object)
        ids = np.searchsorted(kept, np.array([t for t, _, _ in rows], object))
        sources = sorted(names)
        place = {s: i for i, s in enumerate(sources)}
        at = np.fromiter((place[s] for _, s, _ in rows), np.int64, len(rows)) * len(kept) + ids
        counts = np.zeros(len(sources) * len(kept), np.int64)
        np.add.at(counts, at, np.fromiter((n for _, _, n in rows), np.int64, len(rows)))  # a bincount in whole numbers
        out = pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([(part << 32) + made], pa.int64()), pa.array([[t.decode() for t in kept]]), pa.array([[s.decode() for s in sources]]), pa.array([counts], pa.list_(pa.int64()))], ["lang", "chunk", "terms", "sources", "counts"])
        made, rows, n_terms = made + 1, [], 0
        names.clear()
        return out

    for b in batches:
        binary = (b.column(c).cast(pa.binary()).to_pylist() for c in ("term", "source"))
        for this, term, source, n in zip(b.column("lang").to_pylist(), *binary, b.column("n").to_pylist(), strict=True):
            if this != lang or term != last:
                if rows and (this != lang or n_terms == CHUNK_TERMS or (n_terms + 1) * len(names) > CELLS):
                    yield chunk()
                lang, last, n_terms = this, term, n_terms + 1
            rows.append((term, source, n))
            names.add(source)
    if rows:
        yield chunk()


def vectors(kept: DataFrame) -> DataFrame:
    """VECTORS of (lang, source, term, n): dense counts, source after source, by chunks of the sorted terms. Chunk numbers go up
    with the terms."""
    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.select("lang", "source", "term", "n").mapInArrow(_vectors, VECTORS)


def _fragments(column: pa.ListArray, at: int):
    """(terms, sources, counts by source and term) of a chunk's fragments, in order; counts never become Python numbers."""
    held = column[at].values
    for i in range(len(held) if held is not None else 0):
        terms, sources, counts = (held.field(c)[i].values for c in ("terms", "sources", "counts"))
        yield terms, sources.to_pylist(), counts.to_numpy(zero_copy_only=False).reshape(len(sources), len(terms))


class Comparison:
    """The groups of a language over one chunk: sums of differences of all pairs, and each group's terms that lie highest above the
    language. A fragment's counts are held at a time, and one sum for each pair."""

    def __init__(self, names: list[str], n: np.ndarray, v: int, smooth: int, top: int):
        self.names, self.smooth, self.top, self.terms = names, smooth, top, 0
        self.total, self.whole = n + smooth * v, int(n.sum()) + smooth * v
        self.alone = proportion(np.full(len(names), smooth), self.total) if v else np.zeros(len(names), np.int64)  # p of a term that a group lacks
        self.far = np.zeros((len(names), len(names)), np.int64)
        self.best: list[list[tuple[int, int, str]]] = [[] for _ in names]

    def add(self, terms: pa.Array, mine: list[int], counts: np.ndarray) -> None:
        """A fragment's terms: ``counts`` of the groups ``mine``, by their places."""
        size = len(terms)
        share = proportion(counts + self.smooth, self.total[mine][:, None])
        q = proportion(counts.sum(0) + self.smooth, self.whole)
        others = np.setdiff1d(np.arange(len(self.names)), mine)
        for i, m in enumerate(mine):
            for at in range(i + 1, len(mine), BLOCK):
                self._put(m, mine[at : at + BLOCK], np.abs(share[at : at + BLOCK] - share[i]).sum(1))
            for at in range(0, len(others), BLOCK):
                self._put(m, others[at : at + BLOCK], np.abs(self.alone[others[at : at + BLOCK], None] - share[i]).sum(1))
            over = share[i] - q
            high = np.flatnonzero((counts[i] > 0) & (over > 0))
            high = high[np.argsort(-over[high], kind="stable")[: self.top]]  # ids go up in UTF-8 order, so ties are in it
            self.best[m] += [(-int(over[j]), self.terms + int(j), terms[int(j)].as_py()) for j in high]
        for i, m in enumerate(others):
            self._put(m, others[i + 1 :], np.abs(self.alone[others[i + 1 :]] - self.alone[m]) * size)
        self.terms += size

    def _put(self, m: int, others, values: np.ndarray) -> None:
        others = np.asarray(others, np.int64)
        np.add.at(self.far, (np.minimum(m, others), np.maximum(m, others)), values)

    def found(self, lang: str, chunk: int):
        """Batches of FOUND."""

        def batch(source, items, ids, values):
            columns = [pa.array([lang] * len(items), pa.string()), pa.array([source] * len(items), pa.string()), pa.array(items, pa.string()), pa.array(ids, pa.int64()), pa.array(values, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "id", "value"])

        for i, name in enumerate(self.names):
            rest = self.names[i + 1 :]
            yield batch(name, rest, np.full(len(rest), -1), self.far[i, i + 1 :])
            best = sorted(self.best[i])[: self.top]
            yield batch(name, [t for _, _, t in best], [(chunk << 13) + j for _, j, _ in best], [-v for v, _, _ in best])


def _compare(top: int, smooth: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                groups = b.column("groups")[i].as_py()
                names = [g["source"] for g in groups]
                told = Comparison(names, np.array([g["n"] for g in groups], np.int64), b.column("v")[i].as_py(), smooth, top)
                place = {s: j for j, s in enumerate(names)}
                for terms, sources, counts in _fragments(b.column("fragments"), i):
                    told.add(terms, [place[s] for s in sources], counts)
                yield from told.found(b.column("lang")[i].as_py(), b.column("chunk")[i].as_py())

    return run


def audit(docs: DataFrame, min_docs: int = 30, smooth: int = 5, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text; null is empty, other columns are left out).

    A language keeps the terms (runs of A-Z, a-z and non-ASCII characters, A-Z lower-cased) that ``min_docs`` of its rows have; every
    row is a document, repeated or not. A group (lang, source) gives each kept term p = 1 + floor(10**9 (count + smooth) / (N +
    smooth V)). Part ``pair``: the sum of \\|p - p'\\| over all kept terms, to every other source of the language (0 where it keeps
    none). Part ``term``: the ``top`` terms of the group that lie above the language's own p, and how far. Ranks go by value
    downwards, then by item in UTF-8 order. No documents, no rows; a group without terms is compared too.
    """
    spark = bounded_batches(docs.sparkSession)
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = shared_table(spark, kept_counts(named, min_docs), "kept-terms")
    dense = shared_table(spark, vectors(kept), "term-vectors")
    n = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = named.select("lang", "source").distinct().join(n, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("g"))
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("groups"))  # as many as the rows of the answer, or fewer
    sizes = dense.select("lang", F.col("chunk").alias("fragment"), F.size("terms").alias("n"))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("fragment"))
    sizes = sizes.withColumn("chunk", F.floor((upto - F.col("n")) / CHUNK_TERMS))  # fragments of small partitions go together
    fragment = F.struct("fragment", "terms", "sources", "counts")
    packed = dense.withColumnRenamed("chunk", "fragment").join(sizes.drop("n"), ["lang", "fragment"]).groupBy("lang", "chunk").agg(F.array_sort(F.collect_list(fragment)).alias("fragments"))  # below 2 CHUNK_TERMS terms
    langs = langs.join(dense.groupBy("lang").agg(F.sum(F.size("terms")).alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    none = langs.select("lang", F.lit(-1).cast("long").alias("chunk"))  # a language without kept terms has its pairs too
    told = sizes.select("lang", "chunk").distinct().unionByName(none).join(langs, "lang").join(packed, ["lang", "chunk"], "left")
    told = told.withColumn("fragments", F.coalesce("fragments", F.array().cast(packed.schema["fragments"].dataType)))
    found = shared_table(spark, told.repartition("lang", "chunk").select("lang", "chunk", "groups", "v", "fragments").mapInArrow(_compare(top, smooth), FOUND), "divergence")
    half = found.filter("id < 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = _ranked(pairs.withColumn("part", F.lit("pair")), F.asc("item"))
    terms = _ranked(found.filter("id >= 0").withColumn("part", F.lit("term")), F.asc("id"))
    return pairs.unionByName(terms.filter(F.col("rank") <= top))


def _ranked(rows: DataFrame, tie: Column) -> DataFrame:
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), tie)
    return rows.withColumn("rank", F.row_number().over(by)).select("lang", "source", "part", "item", "value", "rank")
