"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches, with DataFrame functions only.

A text's paragraphs are its lines, those of more than ``WORDS`` words in stretches of so many. Their 64-bit
digests go to one cell in each of three tables; a cell holds a count, the xor of its digests and the xor of
their checks. The fingerprint is the sketch with ``CELLS`` cells a table, as hexadecimal digits.

Two fingerprints are compared by subtracting the cells of one from those of the other, where shared paragraphs
cancel out. Peeling then takes cells that hold one digest alone and removes that digest from its other cells,
table by table, until nothing is left: the digests recovered are those that differ. Where something is left,
both texts are sketched again with more cells (by their counts in the fingerprints, then twice as many each time)
and other hashes. Likeness is the number of shared paragraphs over that of all, from the counts of the sketches.

All work on a pair stays in the task that its key was dealt to; cells are never moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.llm.common import shared_table

WORDS, CELLS, TABLES = 16, 8, 3
#: Passes over the three tables before a sketch counts as too small, and sketches before giving up.
PASSES, ATTEMPTS = 4, 12
#: Hexadecimal digits of a cell.
DIGITS = 32
#: Documents to a range of the order by id, ranges at most, and bounds that are searched at a time.
RANGE_DOCS, RANGES, FAN = 8192, 1 << 14, 128
#: Pairs of documents dealt to one task.
TASK_DOCS = 4096
PIECE = r"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){1,%d}+" % WORDS
_SHIFT = 24


def digests(text: Column) -> Column:
    """The digests of a text's paragraphs, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x)))


def _small(key: Column, j: int) -> Column:
    """The cell of a fingerprint's table j that a digest goes to."""
    return F.shiftright(key, 7 * j + 5).bitwiseAND(F.lit(CELLS - 1)).cast("long")


def _check32(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 32) - 1))


def fingerprint(keys: Column) -> Column:
    """The sketch of ``CELLS`` cells a table: for each cell 8 digits of the count, 16 of the digests, 8 of the checks."""
    tables = []
    for j in range(TABLES):
        mine = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.filter(keys, lambda k: _small(k, j) == c))
        tables.append(F.transform(mine, lambda own: F.concat(
            F.lpad(F.hex(F.size(own)), 8, "0"),
            F.lpad(F.hex(F.aggregate(own, F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(k))), 16, "0"),
            F.lpad(F.hex(F.aggregate(own, F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(_check32(k)))), 8, "0"),
        )))
    return F.lower(F.array_join(F.flatten(F.array(*tables)), ""))


def packed(text: Column) -> Column:
    """A fingerprint as it is moved and kept: two digits a byte."""
    return F.unhex(text)


def unpacked(held: Column) -> Column:
    return F.lower(F.hex(held))


def _part(text: Column, cell: Column, at: int, digits: int) -> Column:
    """A number in a fingerprint's cell, as a signed long."""
    return F.conv(F.substring(text, cell * DIGITS + at + 1, F.lit(digits)), 16, -10).cast("long")


def count_of(text: Column) -> Column:
    """The number of digests in a fingerprint: the counts of its first table."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda n, c: n + _part(text, c, 0, 8))


def subtract(a: Column, b: Column) -> Column:
    """The cells (cell, sign, key, check) of one fingerprint less those of another, without those that cancel out; cells
    are counted through the tables."""
    both = lambda c, at, n: _part(a, c, at, n).bitwiseXOR(_part(b, c, at, n))
    cell = lambda c: F.struct(c.cast("long").alias("cell"), (_part(a, c, 0, 8) - _part(b, c, 0, 8)).alias("sign"), both(c, 8, 16).alias("key"), both(c, 24, 8).alias("check"))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(TABLES * CELLS - 1)), cell), lambda x: (x["sign"] != 0) | (x["key"] != 0) | (x["check"] != 0))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """The number of the range that holds a key: the bounds not above it, less one."""
    lits = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    if len(bounds) <= FAN:
        return F.size(F.filter(lits(bounds), lambda b: b <= key)) - 1
    parts = [bounds[i : i + FAN] for i in range(0, len(bounds), FAN)]
    part = F.size(F.filter(lits([p[0] for p in parts]), lambda b: b <= key))
    return (part - 1) * FAN + F.size(F.filter(F.element_at(F.array(*map(lits, parts)), part), lambda b: b <= key)) - 1


def with_next(docs: DataFrame, made: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """(doc_id, text, next, rid) and for every other column x of ``docs`` x and next_x: each row with what the next one by
    doc_id, then text, has; the last is followed by the first, and a null doc_id is the smallest. rid tells rows apart.
    ``made``: more such columns, which are worked out where rows were dealt to, so that they are not moved.

    The order is cut into ranges that begin at ids there are, so that the row after a range's last one is known:
    rows with the id at which the next range begins are copied to the range before.
    """
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("k"))
    n = docs.count()
    ranges = max(1, min(RANGES, -(-n // RANGE_DOCS)))
    shares = F.array(*(F.lit(i / ranges) for i in range(ranges)))
    told = docs.agg(F.min("k").alias("low"), F.percentile_approx("k", shares, F.lit(max(10_000, 20 * ranges))).alias("at")).first()
    bounds = sorted({told["low"], *(told["at"] or [])}) if n else [0]
    own = F.struct(_bucket(F.col("k"), bounds).alias("bucket"), F.lit(0).alias("copy"))
    before = F.struct(((_bucket(F.col("k"), bounds) + len(bounds) - 1) % len(bounds)).alias("bucket"), F.lit(1).alias("copy"))
    starts = F.element_at(F.array(*(F.lit(b).cast("long") for b in bounds)), _bucket(F.col("k"), bounds) + 1) == F.col("k") if len(bounds) <= FAN else F.col("k").isin(bounds)
    dealt = docs.withColumn("to", F.explode(F.when(starts, F.array(own, before)).otherwise(F.array(own)))).select("doc_id", "text", *more, "k", "to.*")
    if made:
        dealt, more = dealt.repartition("bucket").withColumns({c: f() for c, f in made.items()}), [*more, *made]
    order = W.partitionBy("bucket").orderBy("copy", "k", "text")
    placed = dealt.withColumns({"next": F.lead("text").over(order), **{f"next_{c}": F.lead(c).over(order) for c in more}, "rn": F.row_number().over(order)})
    rid = F.shiftleft(F.col("bucket").cast("long"), 40) + F.col("rn")
    return placed.filter("copy = 0").select("doc_id", "text", "next", *more, *(f"next_{c}" for c in more), rid.alias("rid"))


def _at(pair: Column, j: int, place: Column) -> Column:
    """A number for a cell of a pair's table."""
    return F.shiftleft((pair * 4 + j).cast("long"), _SHIFT) + place


def _peel(cells: DataFrame, place, check) -> DataFrame:
    """(rid, pair, plus, minus, left): what peeling recovers of each pair's difference, and the cells it leaves.

    ``cells``: rid, m (cells of a table), cell, sign, key and check, dealt by rid, with several rows of a cell perhaps.
    ``place`` gives the place of a key in table j of m cells, ``check`` a key's check.
    """

    def summed(df: DataFrame) -> DataFrame:
        out = df.groupBy("rid", "cell").agg(F.max("m").alias("m"), F.sum("sign").alias("sign"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
        return out.filter((F.col("sign") != 0) | (F.col("key") != 0) | (F.col("check") != 0))

    cells = summed(cells)
    table, of = F.shiftright("cell", _SHIFT).bitwiseAND(F.lit(3)), F.shiftright("cell", _SHIFT + 2)
    row = lambda cell, sign, key, check: F.struct(cell.alias("cell"), sign.cast("long").alias("sign"), key.alias("key"), check.alias("check"))
    zero, key, m = F.lit(0).cast("long"), F.col("key"), F.col("m")
    for _ in range(PASSES):
        for j in range(TABLES):
            alone = (table == j) & (F.abs("sign") == 1) & (F.col("check") == check(key)) & (F.col("cell").bitwiseAND(F.lit((1 << _SHIFT) - 1)) == place(key, j, m))
            itself = row(F.col("cell"), F.col("sign"), key, F.col("check"))
            taken = [row(_at(of, i, place(key, i, m)), -F.col("sign"), key, F.col("check")) for i in range(TABLES) if i != j]
            # what is recovered is counted in two cells of a fourth table, by its side
            noted = row(_at(of, 3, F.when(F.col("sign") > 0, 0).otherwise(1).cast("long")), F.lit(1), zero, zero)
            cells = summed(cells.withColumn("x", F.explode(F.when(alone, F.array(*taken, noted)).otherwise(F.array(itself)))).select("rid", "m", "x.*"))
    side = F.col("cell").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    count = lambda what: F.sum(F.when(what, F.col("sign")).otherwise(0))
    return cells.groupBy("rid", of.alias("pair")).agg(count((table == 3) & (side == 0)).alias("plus"), count((table == 3) & (side == 1)).alias("minus"), F.sum(F.when(table < 3, 1).otherwise(0)).alias("left"))


def _first(pairs: DataFrame, versions: list[tuple[str, str, float]], tasks: int) -> DataFrame:
    """What peeling recovers from the fingerprints themselves."""
    prints = sorted({f"{c}_print" for v in versions for c in v[:2]})
    dealt = pairs.select("rid", *(packed(F.col(c)).alias(c) for c in prints)).repartition(tasks, "rid")
    dealt = dealt.withColumns({c: unpacked(F.col(c)) for c in prints})
    marked = lambda i: lambda x: F.struct(F.lit(i).alias("pair"), x.alias("c"))
    sides = [F.transform(subtract(F.col(f"{a}_print"), F.col(f"{b}_print")), marked(i)) for i, (a, b, _) in enumerate(versions)]
    cells = dealt.select("rid", F.explode(F.concat(*sides)).alias("x")).select("rid", F.lit(CELLS).alias("m"), F.col("x.pair").alias("pair"), "x.c.*")
    cell = _at(F.col("pair"), 0, F.lit(0)) + F.shiftleft(F.floor(F.col("cell") / CELLS).cast("long"), _SHIFT) + F.col("cell") % CELLS
    return _peel(cells.select("rid", "m", cell.alias("cell"), "sign", "key", "check"), lambda key, j, m: _small(key, j), _check32)


def _again(pairs: DataFrame, versions: list[tuple[str, str, float]], tasks: int, attempt: int) -> DataFrame:
    """The same from larger sketches of the texts of the pairs in ``open``."""
    sides = []
    for i, (a, b, share) in enumerate(versions):
        m = (F.ceil((F.size(a) + F.size(b)) * share * 2 ** (attempt - 1)) + 4).cast("int")
        sides += [F.when(F.array_contains("open", F.lit(i)), F.struct(F.lit(i).alias("pair"), m.alias("m"), F.lit(s).cast("long").alias("sign"), F.col(c).alias("keys"))) for c, s in ((a, 1), (b, -1))]
    place = lambda key, j, m: F.pmod(F.xxhash64(key, F.lit((1000 + attempt) * 31 + j)), m.cast("long"))
    dealt = pairs.repartition(tasks, "rid").select("rid", "open", *({c for v in versions for c in v[:2]}))
    keys = dealt.select("rid", F.explode(F.array(*sides)).alias("s")).filter(F.col("s").isNotNull()).select("rid", "s.pair", "s.m", "s.sign", F.explode("s.keys").alias("key"))
    put = F.explode(F.array(*(_at(F.col("pair"), j, place(F.col("key"), j, F.col("m"))) for j in range(TABLES))))
    return _peel(keys.withColumn("cell", put).withColumn("check", F.xxhash64("key")), place, lambda key: F.xxhash64(key))


def differences(pairs: DataFrame, versions: list[tuple[str, str, float]], tasks: int) -> DataFrame:
    """(rid, pair, plus, minus): the numbers of digests that only the first or only the second version has, for
    pairs that differ. ``versions``: for each pair its two columns of digests, whose fingerprints stand in columns of
    these names and _print, and the cells that a table of the second sketch has for each of their digests."""
    spark = pairs.sparkSession
    told = None
    for attempt in range(ATTEMPTS):
        got = shared_table(spark, _again(pairs, versions, tasks, attempt) if attempt else _first(pairs, versions, tasks), "peeled")
        done = got.filter("left = 0").select("rid", "pair", "plus", "minus")
        told = done if told is None else told.union(done)
        again = got.filter("left > 0").groupBy("rid").agg(F.collect_set("pair").alias("open"))
        if not got.filter("left > 0").limit(1).count():
            return told
        pairs = shared_table(spark, pairs.select("rid", *({c for v in versions for c in v[:2]})).join(again, "rid"), "again")
    raise RuntimeError("sketches could not be peeled")


def compare_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited version, and their likeness.

    The edited version has the last quarter of the code points (rounded down) replaced by the first as many of
    the next document by doc_id, or all it has; the last document is followed by the first, a null doc_id is the
    smallest, and rows of one doc_id follow by text. A null text is empty. Texts without words are alike.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next; equal
    rows stay, an empty table stays empty, other columns are left out.
    """
    spark = docs.sparkSession
    keys = digests(F.coalesce("text", F.lit("")))
    # digests and fingerprint of a text are worked out once, and go to the row before it as those of its next text
    rows = with_next(docs.select("doc_id", "text", keys.alias("a")), {"a_print": lambda: packed(fingerprint(F.col("a")))})
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut)))
    rows = rows.select("rid", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "a_print", F.col("next_a").alias("n"), F.col("next_a_print").alias("n_print"), digests(F.col("edited")).alias("e"))
    rows = shared_table(spark, rows.withColumn("e_print", packed(fingerprint(F.col("e")))), "versions")
    tasks = max(8, -(-rows.count() // TASK_DOCS))
    told = rows.select("rid", "a", "e", "n", *(unpacked(F.col(c)).alias(c) for c in ("a_print", "e_print", "n_print")))
    found = differences(told, [("a", "e", 0.25), ("a", "n", 0.55)], tasks)
    wide = found.groupBy("rid").agg(*(F.sum(F.when(F.col("pair") == i, F.col(c))).alias(f"{c}{i}") for i in range(2) for c in ("plus", "minus")))
    rows = rows.select("rid", "doc_id", "n_chars", "edited_sha256", "a_print", "e_print").withColumns({c: unpacked(F.col(c)) for c in ("a_print", "e_print")}).withColumn("size", count_of(F.col("a_print"))).join(wide, "rid", "left")

    def near(i: int) -> Column:
        plus, minus = (F.coalesce(f"{c}{i}", F.lit(0)) for c in ("plus", "minus"))
        return F.when(F.col("size") + minus == 0, 1.0).otherwise((F.col("size") - plus) / (F.col("size") + minus))

    return rows.select("doc_id", "n_chars", "edited_sha256", F.col("a_print").alias("fingerprint"), F.col("e_print").alias("edited_fingerprint"), near(0).alias("near_edited"), near(1).alias("near_next"))
