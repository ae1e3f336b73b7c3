"""Substring dedup by prefix-partitioned suffix trees.

Every window of ``window`` words has one anchor: the run of ``K`` words inside it that hashes lowest. Equal
windows have their anchor at the same place, so only suffixes that begin at anchors are needed, and an anchor
is the prefix by which suffixes are split into groups. Anchors of one document only end there. The others'
suffixes, with the words before them, are gathered by anchor, and each group is made a suffix tree: the sorted
suffixes and their common lengths give the inner nodes of every depth, and a tree of the words read backwards
does so to the left. A window is repeated where a node at the depth right of the anchor and one at the depth
left of it are shared; the smallest document below both keeps its words.

A prefix that occurs more than ``group`` times is lengthened to the whole window, where a node is a sum that needs
no tree: those windows are summed by a 128-bit hash, which no single task has to hold.

The anchors found in several documents are sent to all tasks as a Bloom filter of ``filter_bits`` bits at
most; where that is too small for them, they are joined to the documents instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.bloom import bits_for, bloom_of
from tallyrank.llm.common import chunks, mix, pieces, replacing, run_hashes, shared_table, signed, span_hashes, tokenise

K = 20
#: Suffixes that a tree is made of at once; a group is never split.
TREE_ROWS = 2048
#: Parts into which the occurrences of one window are dealt.
SALTS = 64
_RUNS = pa.schema([("big", pa.bool_()), ("key", pa.int64()), ("key2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("words", pa.binary())])
_RUNS_SQL = "big boolean, key long, key2 long, doc long, row long, at long, left int, words binary"


def anchors(h: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, place of each window's anchor, hash of the anchor), for windows that lie in one row."""
    empty = np.zeros(0, np.int64)
    if len(h) < window:
        return empty, empty, np.zeros(0, np.uint64)
    k = min(K, window)
    starts = np.flatnonzero(rows[: len(rows) - window + 1] == rows[window - 1 :])
    value = np.full(len(h), np.uint64(2**64 - 1))
    gram, at = run_hashes(h, rows, k)
    value[at] = mix(gram, 31)
    place, low, span = np.arange(len(h)), value, 1
    width = window - k + 1

    def least(v, p, step):
        other_v, other_p = v[step:], p[step:]
        keep = v[: len(v) - step] <= other_v
        return np.where(keep, v[: len(v) - step], other_v), np.where(keep, p[: len(p) - step], other_p)

    while span * 2 <= width:
        low, place = least(low, place, span)
        span *= 2
    if span < width:
        low, place = least(low, place, width - span)
    return starts, place[starts], low[starts]


def _sightings(window: int):
    """(anchor, doc, n): how often each document has each of its anchors."""

    def run(batches):
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            for first, data, off in chunks(batch.column("text")):
                _, _, h, rows = tokenise(data, off, False)
                starts, place, key = anchors(h, rows, window)
                if len(starts):
                    new = np.concatenate([[True], place[1:] != place[:-1]])
                    pair, n = np.unique(np.stack([signed(key[new]), docs[first + rows[starts[new]]]]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(n.astype(np.int64))], names=["anchor", "doc", "n"])

    return run


def _runs(window: int, repeated, big):
    """The windows whose anchor is repeated: runs of neighbours with one anchor, or each alone where it is big.
    ``repeated`` and ``big`` tell of a batch's rows and keys whether they are."""

    def run(batches):
        for batch in batches:
            docs, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
            for first, data, off in chunks(batch.column("text")):
                ws, we, h, rows = tokenise(data, off, False)
                starts, place, key = anchors(h, rows, window)
                if not len(starts):
                    continue
                new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                end = np.append(new[1:], len(starts)) - 1
                mine = first + rows[starts[new]]
                ok = repeated(batch, mine, key[new])
                new, end, mine = new[ok], end[ok], mine[ok]
                large = big(batch, mine, key[new])
                a, b = starts[new], starts[end]
                begin = np.searchsorted(rows, rows[a])
                small = np.flatnonzero(~large)
                raw = data.tobytes()
                cut = [raw[x:y] for x, y in zip(ws[a[small]].tolist(), we[b[small] + window - 1].tolist(), strict=True)]
                n = len(small)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, bool)), pa.array(signed(key[new[small]])), pa.array(np.zeros(n, np.int64)), pa.array(docs[mine[small]]), pa.array(ids[mine[small]]), pa.array(a[small] - begin[small]), pa.array((place[new[small]] - a[small]).astype(np.int32)), pa.array(cut, pa.binary())],
                    schema=_RUNS,
                )
                if large.any():
                    size = (b - a + 1)[large]
                    at = np.repeat(a[large], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    back = np.repeat(np.flatnonzero(large), size)
                    h1, h2 = span_hashes(h, at, at + window), span_hashes(mix(h, 41), at, at + window)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ones(len(at), bool)), pa.array(signed(h1)), pa.array(signed(h2)), pa.array(docs[mine[back]]), pa.array(ids[mine[back]]), pa.array(at - begin[back]), pa.array(np.zeros(len(at), np.int32)), pa.nulls(len(at), pa.binary())],
                        schema=_RUNS,
                    )

    return run


def _nodes(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the order of the rows by group and words, and how many words each has in common with the
    one before it in that order, -1 across groups. Rows share the node of depth d where no ``common`` between them is below d."""
    raw = np.ascontiguousarray(np.concatenate([group[:, None].astype(np.uint64), words], axis=1).astype(">u8"))
    order = np.argsort(raw.view(f"S{raw.shape[1] * 8}").ravel(), kind="stable")
    words, group = words[order], group[order]
    differ = words[1:] != words[:-1]
    common = np.where(differ.any(1), differ.argmax(1), words.shape[1])
    common[group[1:] != group[:-1]] = -1
    return order, np.concatenate([[-1], common])


def tree_repeats(key: np.ndarray, doc: np.ndarray, left: np.ndarray, contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): of each row of whole groups the first and the last window, counted in words from the
    anchor to the left, that a smaller document of its group has too."""
    off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, contents), np.int64, len(contents)))])
    data = np.frombuffer(b"".join(contents), np.uint8)
    _, _, h, rows = tokenise(data, off, False)
    base = np.searchsorted(rows, np.arange(len(contents) + 1))
    size, k = np.diff(base), min(K, window)
    right, most_left = size - left, window - k
    h = np.append(h, np.uint64(0))
    at = base[:-1, None] + left[:, None] + np.arange(window)
    ahead = h[np.where(at < base[1:, None], at, len(h) - 1)]
    at = base[:-1, None] + left[:, None] - 1 - np.arange(max(1, most_left))
    behind = h[np.where(at >= base[:-1, None], at, len(h) - 1)]
    group = np.unique(key, return_inverse=True)[1]
    fwd, fwd_common = _nodes(group, ahead)
    back, back_common = _nodes(group, behind)
    first, last = np.full(len(key), -1), np.full(len(key), -1)
    node_r, node_l = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    for o in range(most_left + 1):
        node_r[fwd] = np.cumsum(fwd_common < window - o)
        node_l[back] = np.cumsum(back_common < o)
        has = np.flatnonzero((left >= o) & (right >= window - o))
        if len(has) < 2:
            continue
        both = node_r[has] * (len(key) + 1) + node_l[has]
        by = np.argsort(both, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], both[by][1:] != both[by][:-1]]))
        least = np.repeat(np.minimum.reduceat(doc[has[by]], edge), np.diff(np.append(edge, len(by))))
        hit = has[by[doc[has[by]] > least]]
        last[hit] = np.where(last[hit] < 0, o, last[hit])
        first[hit] = o
    row = np.flatnonzero(first >= 0)
    return row, first[row], last[row]


def _trees(window: int):
    """(row, start, end): stretches of words that smaller documents have too. The rows come sorted by key."""

    def whole(table: pa.Table):
        key, doc, rows, at = (table.column(c).to_numpy() for c in ("key", "doc", "row", "at"))
        left = table.column("left").to_numpy().astype(np.int64)
        row, far, near = tree_repeats(key, doc, left, table.column("words").to_pylist(), window)
        anchor = at[row] + left[row]
        return pa.RecordBatch.from_arrays([pa.array(rows[row]), pa.array(anchor - far), pa.array(anchor - near + window)], names=["row", "start", "end"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, TREE_ROWS):
                held.append(batch.slice(i, TREE_ROWS))
                n += held[-1].num_rows
                if n >= TREE_ROWS:
                    table = pa.Table.from_batches(held)
                    key = table.column("key").to_numpy()
                    cut = int(np.searchsorted(key, key[-1]))
                    if cut:
                        yield whole(table.slice(0, cut))
                        held = table.slice(cut).to_batches()
                        n -= cut
        if n:
            yield whole(pa.Table.from_batches(held))

    return run


def repeats(docs: DataFrame, window: int = 50, group: int = 16384, filter_bits: int = 1 << 27) -> DataFrame:
    """(row, start, end): the stretches of words of each row that documents with smaller ids have too.

    ``docs`` has doc (a long), row (a key of the row) and text.
    """
    spark = docs.sparkSession
    docs = docs.filter(F.col("doc").isNotNull() & F.col("text").isNotNull())
    seen = docs.select("doc", "text").mapInArrow(_sightings(window), "anchor long, doc long, n long")
    often = seen.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.sum("n").alias("n")).filter("a < b")
    often = shared_table(spark, often.select("anchor", (F.col("n") > group).alias("big")), "anchors")
    n = {r["big"]: r["count"] for r in often.groupBy("big").count().collect()}
    total = sum(n.values())
    if bits_for(total) <= filter_bits:
        known = [bloom_of(often.select("anchor"), bits_for(total)), bloom_of(often.filter("big").select("anchor"), bits_for(n.get(True, 0)))]
        sent = spark.sparkContext.broadcast(known)
        is_repeated, is_big = (lambda batch, rows, keys: sent.value[0].has(keys)), (lambda batch, rows, keys: sent.value[1].has(keys))
        source = docs.select("doc", "row", "text")
    else:
        # the anchors of each document that are repeated go to its row
        own = seen.select("anchor", "doc").distinct().join(often, "anchor").groupBy("doc").agg(F.collect_list(F.when(~F.col("big"), F.col("anchor"))).alias("__small"), F.collect_list(F.when(F.col("big"), F.col("anchor"))).alias("__big"))
        source = docs.join(own, "doc").select("doc", "row", "text", "__small", "__big")

        def among(columns):
            def test(batch, rows, keys):
                out = np.zeros(len(keys), bool)
                for r in np.unique(rows):
                    mine = np.concatenate([np.array(batch.column(c)[int(r)].as_py() or [], np.int64) for c in columns])
                    out[rows == r] = np.isin(signed(keys[rows == r].copy()), mine)
                return out

            return test

        is_repeated, is_big = among(["__small", "__big"]), among(["__big"])
    runs = shared_table(spark, source.mapInArrow(_runs(window, is_repeated, is_big), _RUNS_SQL), "runs")
    small = runs.filter(~F.col("big")).select("key", "doc", "row", "at", "left", "words")
    trees = small.repartition("key").sortWithinPartitions("key").mapInArrow(_trees(window), "row long, start long, end long")
    # a window that very many documents share is dealt out by row, and its least document goes to every part; windows
    # of one document, by far the most, need no join
    large = runs.filter("big").select("key", "key2", "doc", "row", "at", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int").alias("salt"))
    least = large.groupBy("key", "key2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").drop("most")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    whole = large.join(least, ["key", "key2", "salt"]).filter(F.col("doc") > F.col("least")).select("row", F.col("at").alias("start"), (F.col("at") + window).alias("end"))
    return trees.union(whole)


def drop_repeats(docs: DataFrame, window: int = 50, digest: bool = False, **sizes) -> DataFrame:
    """Removes from every document the words covered by windows that a document with a smaller doc_id has too.

    Words are runs of characters other than ASCII white space, as they are. Windows are judged on the texts as
    they come. Returns the columns of ``docs`` with ``text`` replaced by the kept words, joined by one space,
    and n_words and n_removed; with ``digest``, kept_sha256 instead of the text. A null or empty text has no
    words; a text of fewer than ``window`` words keeps all. Rows that share a doc_id don't take words from each
    other; rows with a null doc_id neither lose words nor take any. Columns of the made names are replaced.
    """
    docs = docs.select(*replacing(docs, "n_words", "n_removed", *["kept_sha256"] * digest))
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = repeats(keyed.select(F.col("doc_id").cast("long").alias("doc"), F.col("__row").alias("row"), "text"), window, **sizes)
    gone = found.distinct().groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("__gone")).withColumnRenamed("row", "__row")
    joined = keyed.join(gone, "__row", "left").drop("__row")
    keep = [c for c in docs.columns if c != "text"]
    made = "kept_sha256" if digest else "text"

    def run(batches):
        for batch in pieces(batches):
            kept, words_n, gone_n = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                words = (text or b"").split()
                if spans:
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, [s["start"] for s in spans], 1)
                    np.add.at(mark, [s["end"] for s in spans], -1)
                    stay = np.cumsum(mark)[:-1] == 0
                    rest = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                else:
                    rest = words
                out = b" ".join(rest)
                kept.append(hashlib.sha256(out).hexdigest().encode() if digest else out)
                words_n.append(len(words))
                gone_n.append(len(words) - len(rest))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words_n, pa.int64()), pa.array(gone_n, pa.int64())], names=[*keep, made, "n_words", "n_removed"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return joined.mapInArrow(run, ", ".join([*kept, f"{made} string, n_words long, n_removed long"]))
