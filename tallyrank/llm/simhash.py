"""SimHash fingerprints and near-duplicate groups.

A fingerprint bit is set where it is set in over half of a text's shingle hashes. Fingerprints link at
``distance`` or fewer differing bits. The 64 bits are cut into blocks; two linked fingerprints agree in all
blocks but ``distance`` of them, so each fingerprint goes to one bucket for every choice of that many other
blocks, linked pairs meet in a bucket, and Hamming distance is verified there.

Only distinct fingerprints take part, so copies never make pairs. A bucket of more than ``bucket`` members
is not paired: there every member names all values within half the distance of itself (two values link
if and only if they name one in common), and members that name a value are tied to the smallest of them.
That is linear in the members and gives the same groups. Groups are found by large-star and small-star
rounds over shared tables; no links are collected.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.llm.bloom import bits_for, bloom_of
from tallyrank.llm.common import chunks, dealt, mix, passing_tables, pieces, replacing, shared_table, span_hashes, texts, tokenise

BITS = 64
#: Shingles whose bits are summed at once.
STEP = 1 << 14
#: Independent word-set fingerprints of a text where an exact check follows, and the bits that two of one seed
#: may differ in to be checked (chance meetings in a bucket differ in over 16 as a rule), and that all may differ in together:
#: pairs at a similarity of 0.8 to 0.9 differ in 24 of 256 on average, and in 52 at most of 1500 tried.
SEEDS, FAR, FAR_ALL = 4, 12, 52
#: Of two texts' shingle hashes together the smallest so many are compared before whole sets are, and how many standard deviations
#: below the similarity asked for their share may lie: a pair that is as similar is lost once in 30,000, and never where both sets are smaller.
SAMPLE, BELOW = 64, 4.0
#: Parts that the rows of one text, or of one print, are dealt out to.
SALTS = 16
#: How many times more random prints fill buckets as much.
CROWDED = 64
#: Bits, at most, of a filter of doc_ids that tasks and driver hold.
ID_BITS = 1 << 26


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of a text; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size).tolist(), ends.tolist()
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, STEP):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : min(n, at + STEP)], ends[min(at + shingle, len(words)) - 1 :])])
        total += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int = 4, name: str = "fp") -> DataFrame:
    """Replaces ``text`` by the fingerprint, as a signed long."""
    keep = [c for c in replacing(docs, name) if c.lower() != "text"]

    def run(batches):
        for batch in pieces(batches):
            got = [fingerprint(x, shingle) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.array(got, np.uint64).view(np.int64))], names=[*keep, name])

    docs = docs.select(*keep, "text")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*kept, f"`{name}` long"]))


# -- links between distinct fingerprints -----------------------------------------------------------


def blocks_for(n: int, distance: int) -> int:
    """The number of blocks at which buckets of n random fingerprints hold less than a quarter of one on average."""
    for b in range(distance + 1, 2 * distance):
        if n <= 2 ** (BITS * (b - distance) // b) / 4:
            return b
    return 2 * distance


def block_masks(blocks: int, distance: int) -> list[int]:
    """For each choice of blocks - distance blocks, the bits they cover."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [reduce(int.__or__, c) for c in combinations(parts, blocks - distance)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near_values(fp: Column, df: DataFrame, radius: int) -> DataFrame:
    """One row for each way to flip up to ``radius`` bits of the fingerprint."""
    df = df.withColumn("value", fp).withColumn("__from", F.lit(0))
    for _ in range(radius):
        df = df.withColumn("__bit", F.explode(F.sequence("__from", F.lit(BITS))))
        flip = F.when(F.col("__bit") < BITS, F.expr("shiftleft(1L, __bit)")).otherwise(F.lit(0).cast("long"))
        df = df.withColumn("value", F.col("value").bitwiseXOR(flip)).withColumn("__from", F.least(F.col("__bit") + 1, F.lit(BITS)))
    return df.drop("__bit", "__from")


def links(fps: DataFrame, distance: int = 4, bucket: int = 64) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them that the groups are those of all links.

    ``fps``: one row for each fingerprint, in ``fp``. ``distance`` must be even (the middle of two linked
    values must lie equally near to both).
    """
    if distance % 2:
        raise ValueError("distance must be even")
    spark, n = fps.sparkSession, fps.count()
    masks = block_masks(blocks_for(n, distance), distance)
    keyed = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("m")) for i, m in enumerate(masks))))
    rows = fps.select("fp", keyed.alias("k")).select("k.c", "k.m", "fp")
    shared = rows.groupBy("c", "m").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    rows = shared_table(spark, rows.join(dealt(shared), ["c", "m"]), "buckets")
    small = rows.filter(F.col("n") <= bucket)
    pairs = small.select("c", "m", F.col("fp").alias("a")).join(dealt(small.select("c", "m", F.col("fp").alias("b"))), ["c", "m"])
    pairs = pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    crowd = shared_table(spark, rows.filter(F.col("n") > bucket).select("fp").distinct(), "crowd")
    near = _near_values(F.col("fp"), crowd, distance // 2)
    least = near.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).filter(F.col("a") < F.col("most")).select("value", "a")
    tied = near.join(dealt(least), "value").filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.union(tied).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the edges (a, b), itself included."""
    spark = edges.sparkSession

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = shared_table(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(dealt(least), "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b")
        # large star ends; edges now point from a smaller node a to b, and small star ties b's smaller nodes together
        large = shared_table(spark, large.union(edges.join(dealt(least.withColumnRenamed("a", "b")), "b").select(F.col("m").alias("a"), "b").filter("a < b")).distinct(), "edges")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(dealt(least), "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("x"))
        edges = shared_table(spark, small.filter("m < x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _salt(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")


def _given(rows: DataFrame, groups: DataFrame, on: list[str], key: str) -> DataFrame:
    """``rows`` with what ``groups`` (on, first, n and more) says of theirs. The rows of one text, or print, may be very many: their group
    is there once for each of ``SALTS`` parts of them, by ``key``; that of a single row, ``first``, once."""
    parts = F.when(F.col("n") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(_salt("first")))
    salted = groups.withColumn("__salt", F.explode(parts)).drop("first", "n")
    return rows.withColumn("__salt", _salt(key)).join(dealt(salted), [*on, "__salt"]).drop("__salt")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, bucket: int = 64) -> DataFrame:
    """The rows of ``docs`` with their fingerprint ``fp`` (a signed long) and component_id, without ``text``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer words than a
    shingle has one, the whole; a null or wordless text has fingerprint 0, which links like any other.
    component_id is the smallest doc_id that linked fingerprints reach; null ids take no part in that, and a
    group that has no other id gets null. Equal rows stay. Columns of these names in ``docs`` are replaced.
    """
    spark = docs.sparkSession
    docs = shared_table(spark, with_fingerprints(docs.select(*replacing(docs, "fp", "component_id")), shingle), "prints")
    fps = shared_table(spark, docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-prints")
    roots = components(links(fps.select("fp"), distance, bucket))
    grouped = fps.join(dealt(roots), F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return _given(docs, grouped.join(dealt(least), "root").select("fp", "first", "n", "component_id"), ["fp"], "doc_id")


def _similarity(a: bytes, b: bytes, shingle: int) -> float:
    """Jaccard similarity of two texts' shingles; of texts without words, 1."""
    sets = []
    for text in (a, b):
        words = text.lower().split()
        sets.append({b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def word_prints(column: pa.Array, seeds: int = SEEDS) -> np.ndarray:
    """Fingerprints of the sets of words of texts, one for each seed, as signed longs; 0 for texts without words."""
    out = np.zeros((len(column), seeds), np.uint64)
    for first, data, off in chunks(column):
        _, _, h, rows = tokenise(data, off, True)
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        h, rows = h[new], rows[new]
        if not len(h):
            continue
        has, at, n = np.unique(rows, return_index=True, return_counts=True)
        for seed in range(seeds):
            bits = np.unpackbits(mix(h, 100 + seed).view(np.uint8)).reshape(-1, BITS)
            total = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
            out[first + has, seed] = np.packbits(2 * total > n[:, None], axis=1).view(np.uint64).ravel()
    return out.view(np.int64)


def _differing(a: str | Column, b: str | Column) -> Column:
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b))


def shingle_sets(column: pa.Array, shingle: int) -> list[bytes]:
    """For each text the sorted 64-bit hashes of its different shingles of words, A-Z lower-cased; of a text of fewer words
    the hash of them all."""
    out = []
    for _, data, off in chunks(column):
        _, _, h, rows = tokenise(data, off, True)
        edges = np.searchsorted(rows, np.arange(len(off)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            n = max(1, b - a - shingle + 1)
            at = np.arange(a, a + n)
            out.append(np.unique(span_hashes(h[a:b], at - a, np.minimum(at - a + shingle, b - a))).tobytes())
    return out


def sample_alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sorted sets may be as similar, by the ``SAMPLE`` smallest hashes of both together: each side's own smallest hold those."""
    x, y = np.frombuffer(a, np.uint64)[:SAMPLE], np.frombuffer(b, np.uint64)[:SAMPLE]
    least = np.union1d(x, y)[:SAMPLE]
    both = len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), least, assume_unique=True))
    n = len(least)
    return both >= similarity * n - BELOW * (similarity * (1 - similarity) * n) ** 0.5 - 1e-9


def _likely(ids: DataFrame):
    """A test of arrays of longs, true for all that stand in the only column of ``ids`` and few others. Texts pass it before they are dealt
    out; its size is bounded, however many ids there are."""
    sent = ids.sparkSession.sparkContext.broadcast(bloom_of(ids, min(ID_BITS, bits_for(ids.count()))))
    return lambda found: sent.value.has(np.ascontiguousarray(found, np.int64).view(np.uint64))


def _alike(pairs: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts' shingles are alike; only texts that some pair asks for are looked at."""
    spark = docs.sparkSession
    pairs = shared_table(spark, pairs.select("a", "b").distinct(), "candidates")
    # sets that no pair asks for may pass; they meet none
    asked = _likely(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))

    def cut(batches):
        for batch in pieces(batches):
            batch = batch.filter(pa.array(asked(batch.column("doc_id").to_numpy()), pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shingle_sets(batch.column("text"), shingle), pa.binary())], names=["node", "shingles"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "node long, shingles binary")
    # the rows of one doc_id are one document; its smallest text counts
    held = shared_table(spark, held.groupBy("node").agg(F.min("shingles").alias("shingles")), "shingles")

    def whole(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both) - 1e-9

    def kept(pairs: DataFrame, sets: Column, test) -> DataFrame:
        side = lambda x: held.select(F.col("node").alias(x), sets.alias(f"of_{x}"))

        def check(batches):
            for batch in pieces(batches, "of_a"):
                ok = [test(x, y) for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

        return pairs.join(dealt(side("a")), "a").join(dealt(side("b")), "b").select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long")

    pairs = kept(pairs, F.substring("shingles", 1, 8 * SAMPLE), lambda a, b: sample_alike(a, b, similarity))
    return shared_table(spark, kept(shared_table(spark, pairs, "sampled"), F.col("shingles"), whole), "alike")


def _meetings(nodes: DataFrame, distance: int) -> DataFrame:
    """(key, node, fp, n): the buckets of two texts or more, n being their texts.

    Each of a text's fingerprints ``fps`` goes to buckets of its own seed, so that two texts within ``distance``
    bits by any seed meet.
    """
    spark = nodes.sparkSession
    # prints of word sets are crowded, since texts of a language share words: blocks are as wide as for more random ones
    masks = block_masks(blocks_for(nodes.count() * CROWDED, distance), distance)
    rows = nodes.select("node", F.posexplode("fps").alias("seed", "fp"))
    keyed = F.explode(F.array(*(F.xxhash64(F.lit(i), "seed", F.col("fp").bitwiseAND(F.lit(_long(m)))) for i, m in enumerate(masks))))
    rows = rows.select(keyed.alias("key"), "node", "fp")
    # counted where they are dealt to: each row is shuffled once
    return shared_table(spark, rows.withColumn("n", F.count("*").over(W.partitionBy("key"))).filter("n > 1"), "buckets")


def _sieved(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b), each once, that differ in ``FAR_ALL`` bits of all seeds together at most."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("fps").alias(f"of_{x}"))
    pairs = pairs.select("a", "b").distinct().join(dealt(side("a")), "a").join(dealt(side("b")), "b")
    bits = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: _differing(x, y)), F.lit(0), lambda t, x: t + x)
    return pairs.filter(bits <= FAR_ALL).select("a", "b")


def _unlinked(met: DataFrame, roots: DataFrame, part, parts: Column) -> DataFrame:
    """Pairs (a, b) that meet in a bucket and lie in different groups, one of them outside the largest group of the bucket. ``part`` deals
    a bucket's texts out to ``parts``; one outside goes to all of them."""
    met = shared_table(met.sparkSession, met.join(dealt(roots), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    mode = met.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("mode"), F.count("*").alias("roots"))
    split = met.join(dealt(mode.filter("roots > 1").drop("roots")), "key")
    left = split.filter("root <> mode").select("key", F.col("node").alias("x"), F.col("fp").alias("x_fp"), F.col("root").alias("x_root"), F.explode(parts).alias("part"))
    every = split.select("key", F.col("node").alias("y"), "fp", "root", "mode", part(F.col("node")).alias("part"))
    pairs = left.join(dealt(every), ["key", "part"]).filter((F.col("root") != F.col("x_root")) & ((F.col("root") == F.col("mode")) | (F.col("x") < F.col("y"))) & (_differing("fp", "x_fp") <= FAR))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, distance: int = 4, block: int = 1024) -> DataFrame:
    """(doc_id, group): the documents that have near copies or exact ones, and the smallest doc_id of their group.

    ``SEEDS`` independent fingerprints of the set of words propose pairs: those that meet in a bucket of any seed
    (within ``distance`` bits they always do) and differ in ``FAR`` bits there, and in ``FAR_ALL`` bits of all seeds
    together, at most. A near copy is a pair whose shingles have a Jaccard similarity of ``similarity`` or more; groups
    are what such pairs connect. Each text is checked against two hubs of its buckets first: the smallest, and the one
    that meets most others, which is the original of its edited copies as a rule. Pairs that these links have put into
    one group already need no check. The others of a bucket are checked pair by pair, in parts of ``block`` texts: where
    r texts lie outside the largest group of a bucket of n, r * n pairs at most, first by a sample of their shingles. Pairs that meet by no seed are not found.
    Rows of one doc_id count as one document; rows with a null doc_id are left out.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull())
    with passing_tables(spark):
        return shared_table(spark, _groups(spark, docs, similarity, shingle, distance, block), "near-groups", keep=True)


def _groups(spark: SparkSession, docs: DataFrame, similarity: float, shingle: int, distance: int, block: int) -> DataFrame:
    def run(batches):
        for batch in pieces(batches):
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * SEEDS, pa.int32()), pa.array(word_prints(batch.column("text")).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), fps], names=["doc_id", "copy", "fps"])

    prints = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text").mapInArrow(run, "doc_id long, copy long, fps array<long>")
    prints = shared_table(spark, prints, "word-prints")
    nodes = shared_table(spark, prints.groupBy("copy", "fps").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "texts")
    met = _meetings(nodes, distance)
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    hub = lambda df, by: df.groupBy("key").agg(F.max_by(F.struct("node", "fp"), by).alias("hub"))
    hubs = hub(met, -F.col("node")).union(hub(met.filter("n > 2").join(dealt(weight), "node"), F.struct("weight", -F.col("node")))).distinct()
    near = met.join(dealt(hubs), "key").filter((F.col("hub.node") != F.col("node")) & (_differing("fp", "hub.fp") <= FAR))
    near = near.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    edges = _alike(_sieved(near, nodes), docs, similarity, shingle)
    roots = shared_table(spark, components(edges), "roots")

    every = _unlinked(met.filter("n > 2"), roots, lambda node: F.pmod(F.xxhash64(node), F.ceil(F.col("n") / block)).cast("int"), F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1))
    edges = edges.union(_alike(_sieved(every, nodes), docs, similarity, shingle))
    roots = shared_table(spark, components(edges), "roots")
    texts = nodes.withColumnRenamed("node", "first").join(dealt(roots.withColumnRenamed("node", "first")), "first", "left")
    copies = _given(prints, texts.withColumn("group", F.coalesce("root", "first")).drop("root"), ["copy", "fps"], "doc_id").select("doc_id", "group")
    # rows of one doc_id whose texts lie in different groups: the smallest counts
    return copies.groupBy("doc_id").agg(F.min("group").alias("group"))


def drop_similar(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without those of ``near_groups`` but the smallest doc_id of each group.

    Of rows that share a doc_id the one with the smallest text stays (of equal texts the smallest row, columns in
    order). Rows with a null doc_id all stay. A null text counts as empty; texts without words are copies of each other.
    """
    spark = docs.sparkSession
    gone = near_groups(docs.select("doc_id", "text"), **how).filter(F.col("doc_id") > F.col("group")).select("doc_id")
    named = docs.filter(F.col("doc_id").isNotNull())
    again = shared_table(spark, named.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    # only rows that may be among them are dealt out with their texts
    test = _likely(gone.union(again).select(F.col("doc_id").cast("long")))
    likely = F.pandas_udf(lambda ids: pd.Series(test(ids)), "boolean")(F.col("doc_id").cast("long"))
    kept = named.filter(likely).join(dealt(gone), "doc_id", "left_anti").select(*docs.columns)
    alone = kept.join(dealt(again), "doc_id", "left_anti").select(*docs.columns)
    first = kept.join(dealt(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")))).alias("r"))
    first = first.select("doc_id", "r.*").select(*docs.columns)
    return named.filter(~likely).union(alone).union(first).union(docs.filter(F.col("doc_id").isNull()))
