"""Line dedup by a sharded minimal perfect hash.

Lines are counted by a 128-bit hash of their key. Over the hashes that reach the threshold, each shard
builds a minimal perfect hash (a cascade of bit arrays: keys that meet in one level go on to the next),
whose slots index two compact arrays: fingerprints, which turn away lines that are not in the set, and
counts. Documents probe these arrays; lines are never joined with lines.

The arrays are broadcast only where their measured size is at most ``broadcast_bytes``. Beyond that,
packed probes are sent to the shards instead and the answers come back by document.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import bounded_batches, mix, pieces, replacing, shared_table, signed, texts

#: Distinct lines that a task holds before it hands their counts on.
HELD = 200_000
LEVELS = 40


def keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys; both strips and lower-casing are those of ASCII."""
    lines = text.split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def hashes(keys: list[bytes]) -> np.ndarray:
    """A 128-bit hash of each key, as two columns."""
    raw = b"".join(map(xxhash.xxh3_128_digest, keys))
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def _chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _count(min_chars: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held: dict[bytes, int] = defaultdict(int)

        def out():
            h = np.frombuffer(b"".join(held), ">u8").astype(np.uint64).reshape(-1, 2)
            n = np.fromiter(held.values(), np.int64, len(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(h[:, 0].copy())), pa.array(signed(h[:, 1].copy())), pa.array(n)], schema=schema)

        for batch in pieces(batches):
            for text in texts(batch):
                for key in set(keys(text)[1]):
                    if _chars(key) >= min_chars:
                        held[xxhash.xxh3_128_digest(key)] += 1
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    return run


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): in how many documents each line key is found. Each task sums its own rows before the shuffle."""
    part = docs.select("text").mapInArrow(_count(min_chars), "h1 long, h2 long, n long")
    return part.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


# -- the minimal perfect hash ----------------------------------------------------------------------


def _at(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """The places of 128-bit keys in a level of ``size`` bits; keys that share a half differ by the other."""
    return (mix(h1, level + 1) ^ mix(h2, level + 101)) % np.uint64(size)


def build_mph(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offsets, order): the levels' bits, where each level's words begin, and the slot of each key."""
    words, offsets, slot = [], [0], np.full(len(h1), -1, np.int64)
    left, base = np.arange(len(h1)), 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, -(-2 * len(left) // 64) * 64)
        at = _at(h1[left], h2[left], level, size).astype(np.int64)
        once = np.bincount(at, minlength=size) == 1
        bits = np.packbits(once, bitorder="little").view(np.uint64)
        rank = np.cumsum(once) - 1
        alone = once[at]
        slot[left[alone]] = base + rank[at[alone]]
        base += int(once.sum())
        words.append(bits)
        offsets.append(offsets[-1] + len(bits))
        left = left[~alone]
    if len(left):
        raise ValueError("keys of a minimal perfect hash must differ")
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(offsets, np.int64), slot


class Shard:
    """One shard's levels, fingerprints and counts; ``find`` gives the counts of the lines it holds, 0 for others."""

    def __init__(self, words: bytes, offsets: bytes, prints: bytes, counts: bytes):
        self.words, self.offsets = np.frombuffer(words, np.uint64), np.frombuffer(offsets, np.int64)
        self.prints, self.counts = np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32)
        ones = np.unpackbits(self.words.view(np.uint8)).reshape(-1, 64).sum(1) if len(self.words) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(h1), np.int64), np.arange(len(h1))
        for level in range(len(self.offsets) - 1):
            if not len(left):
                break
            lo, hi = self.offsets[level], self.offsets[level + 1]
            at = _at(h1[left], h2[left], level, int(hi - lo) * 64)
            word, bit = lo + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            bits = self.words[word]
            here = (bits >> bit) & np.uint64(1) == 1
            below = bits[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            slot = self.before[word[here]] + np.bitwise_count(below).astype(np.int64)
            own = self.prints[slot] == h2[left[here]]
            out[left[here][own]] = self.counts[slot[own]]
            left = left[~here]
        return out


def _shard_of(h1: np.ndarray, n: int) -> np.ndarray:
    return (mix(h1, 99) % np.uint64(n)).astype(np.int64)


_SHARD = "shard long, words binary, offsets binary, prints binary, counts binary"


def _build(n_shards: int):
    def tag(batches):
        for b in batches:
            h1 = b.column("h1").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(h1, n_shards)), b.column("h1"), b.column("h2"), b.column("n")], names=["shard", "h1", "h2", "n"])

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        words, offsets, slot = build_mph(h1, h2)
        prints, counts = np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.uint32)
        prints[slot], counts[slot] = h2, np.minimum(table.column("n").to_numpy(), 2**32 - 1)
        return pa.table({"shard": [table.column("shard")[0].as_py()], "words": [words.tobytes()], "offsets": [offsets.tobytes()], "prints": [prints.tobytes()], "counts": [counts.tobytes()]})

    return tag, build


def line_index(counts: DataFrame, min_docs: int, shard_keys: int = 1 << 16) -> tuple[DataFrame, int]:
    """The shards over all lines found in at least ``min_docs`` documents, and their number; it grows with the lines."""
    spark = counts.sparkSession
    often = shared_table(spark, counts.filter(F.col("n") >= min_docs), "lines")
    n_shards = max(1, -(-often.count() // shard_keys))
    tag, build = _build(n_shards)
    shards = often.mapInArrow(tag, "shard long, h1 long, h2 long, n long").groupBy("shard").applyInArrow(build, _SHARD)
    return shared_table(spark, shards, "line-shards"), n_shards


def _rewrite(batch: pa.RecordBatch, drops: list[np.ndarray], out: list[str], counted: list[int]) -> pa.RecordBatch:
    """The rows without the lines marked; ``counted``: how many lines each row has."""
    kept = []
    for text, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), drops, strict=True):
        if text is None:
            kept.append(b"")
        elif not gone.any():
            kept.append(text)
        else:
            kept.append(b"\n".join(x for x, y in zip(text.split(b"\n"), gone, strict=True) if not y))
    made = {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(counted, pa.int64()), "n_dropped": pa.array([int(x.sum()) for x in drops], pa.int64())}
    return pa.RecordBatch.from_arrays([made.get(c, batch.column(c) if c not in made else None) for c in out], names=out)


def _flags(found: list[bytes], min_chars: int, find) -> list[np.ndarray]:
    """For each text which of its lines ``find`` counts."""
    if not found:
        return []
    per = [keys(t)[1] for t in found]
    flat = [k for ks in per for k in ks]
    h = hashes(flat)
    long = np.fromiter((_chars(k) >= min_chars for k in flat), bool, len(flat))
    hit = find(h[:, 0].copy(), h[:, 1].copy()) > 0
    return np.split(hit & long, np.cumsum([len(x) for x in per])[:-1])


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = 16 << 20, shard_keys: int = 1 << 16) -> DataFrame:
    """Drops from every document the lines found in at least ``min_docs`` documents.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys of fewer than
    ``min_chars`` code points are kept. A line repeated in one document counts once there. Every row counts
    as a document, repeated rows too. A null text is one empty line and comes back empty; an empty table
    comes back empty. Returns the columns of ``docs`` with ``text`` rewritten, and n_lines and n_dropped
    (columns of these names in ``docs`` are replaced).
    """
    spark = bounded_batches(docs.sparkSession)
    shards, n_shards = line_index(line_counts(docs, min_chars), min_docs, shard_keys)
    size = shards.select(F.sum(F.octet_length("words") + F.octet_length("prints") + F.octet_length("counts"))).first()[0] or 0
    docs = docs.select(*replacing(docs, "n_lines", "n_dropped"))
    out = [c for c in docs.columns if c != "text"] + ["text", "n_lines", "n_dropped"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"] + ["text string, n_lines long, n_dropped long"])
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast([tuple(map(bytes, r[1:])) if r[0] == i else None for i, r in _dense(shards, n_shards)])

        def probe(batches):
            index = [Shard(*x) if x else None for x in held.value]

            def find(h1, h2):
                got, at = np.zeros(len(h1), np.int64), _shard_of(h1, len(index))
                for s in np.unique(at):
                    if index[s] is not None:
                        got[at == s] = index[s].find(h1[at == s], h2[at == s])
                return got

            for batch in pieces(batches):
                found = texts(batch)
                yield _rewrite(batch, _flags(found, min_chars, find), out, _line_numbers(found))

        return docs.mapInArrow(probe, schema)
    return _by_shard(docs, shards, n_shards, min_chars, out, schema)


def _line_numbers(found: list[bytes]) -> list[int]:
    return [x.count(b"\n") + 1 for x in found]


def _dense(shards: DataFrame, n: int):
    """Every shard number with its row; a number without keys gets a row that does not match."""
    got = {r[0]: r for r in shards.collect()}
    return [(i, got.get(i, (-1,))) for i in range(n)]


def _by_shard(docs: DataFrame, shards: DataFrame, n_shards: int, min_chars: int, out: list[str], schema: str) -> DataFrame:
    """The same where the arrays are too large to broadcast: packed probes go to the shards, salted by their number."""
    row = F.xxhash64(F.col("doc_id"), F.col("text"))
    names = "shard long, salt long, row long, lines binary, h1 binary, h2 binary"

    def pack(batches):
        for batch in pieces(batches):
            found = texts(batch)
            got = defaultdict(list)
            for r, text in zip(batch.column("__row").to_pylist(), found, strict=True):
                ks = keys(text)[1]
                h = hashes(ks)
                at = _shard_of(h[:, 0].copy(), n_shards)
                long = np.fromiter((_chars(k) >= min_chars for k in ks), bool, len(ks))
                for s in np.unique(at[long]):
                    i = np.flatnonzero((at == s) & long)
                    got["shard"].append(int(s))
                    got["salt"].append(r & 0xFFFF)
                    got["row"].append(r)
                    for c, v in (("lines", i), ("h1", h[i, 0]), ("h2", h[i, 1])):
                        got[c].append(v.tobytes())
            if got:
                yield pa.RecordBatch.from_pydict(dict(got), schema=pa.schema([("shard", pa.int64()), ("salt", pa.int64()), ("row", pa.int64()), ("lines", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary())]))

    spark = docs.sparkSession
    probes = shared_table(spark, docs.select("text", row.alias("__row")).mapInArrow(pack, names), "line-probes")
    most = probes.groupBy("shard").agg(F.sum(F.octet_length("h1")).alias("n")).agg(F.max("n")).first()[0] or 0
    salts = max(1, -(-most // (8 << 20)))
    probes = probes.withColumn("salt", F.col("salt") % salts)
    copies = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))

    def look(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "lines": pa.array([], pa.binary())})
        shard = Shard(*(right.column(c)[0].as_py() for c in ("words", "offsets", "prints", "counts")))
        join = lambda c, t: np.frombuffer(b"".join(left.column(c).to_pylist()), t)
        lines, n = join("lines", np.int64), [len(x) // 8 for x in left.column("lines").to_pylist()]
        hit = shard.find(join("h1", np.uint64).copy(), join("h2", np.uint64).copy()) > 0
        parts = [(r, a[b].tobytes()) for r, a, b in zip(left.column("row").to_pylist(), np.split(lines, np.cumsum(n)[:-1]), np.split(hit, np.cumsum(n)[:-1]), strict=True) if b.any()]
        return pa.table({"row": pa.array([x[0] for x in parts], pa.int64()), "lines": pa.array([x[1] for x in parts], pa.binary())})

    found = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(look, "row long, lines binary")
    # a row that stands there twice has its lines found twice; writing a mark again changes nothing
    gone = found.groupBy("row").agg(F.collect_list("lines").alias("__gone")).withColumnRenamed("row", "__row")
    joined = docs.withColumn("__row", row).join(gone, "__row", "left").drop("__row")

    def write(batches):
        for batch in pieces(batches):
            counted = _line_numbers(texts(batch))
            drops = []
            for n, lists in zip(counted, batch.column("__gone").to_pylist(), strict=True):
                mark = np.zeros(n, bool)
                for x in lists or ():
                    mark[np.frombuffer(x, np.int64)] = True
                drops.append(mark)
            yield _rewrite(batch, drops, out, counted)

    return joined.mapInArrow(write, schema)
