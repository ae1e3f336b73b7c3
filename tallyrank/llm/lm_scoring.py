"""Language-model scoring with a log-frequency Bloom filter that grows with the corpus.

Texts are packed into units of about ``UNIT_TOKENS`` tokens, whose words are numbered. A unit asks for each of its different
words and word pairs once, and says how often it has them itself; what it asks is dealt out to buckets, as many as the corpus
needs. A bucket sums the counts of its n-grams and holds them in a filter of its own: a count c is held at level
1 + floor(log_BASE c), the filter gets one key for each level from 1 to that, and a count is read back by probing level after
level until one is missing. Contexts are held the same way, with the sum and the number of the pairs after them. All n-grams
are held, those found once too, however large the corpus; no filter goes to all tasks or through the driver. The levels that a
filter gives go back to the units, a byte for each.

Probabilities are Witten-Bell interpolations of the counts read back:
P1(w) = (c(w) + ADD) / (all + ADD * (V + 1)) and P(w | h) = (c(h w) + (C(h) - R(h) + T(h)) * P1(w)) / (C(h) + T(h)),
where C is the count of h, R the sum and T the number of the pairs after h. R and C are rounded up to
the top of their level, pairs to its middle, so that probabilities sum to 1 at most.

The exact counts that ``base_score`` needs come back with the words' levels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import chunks, mix, replacing, shared_table, tokenise, word_hashes

BASE, ADD, HASHES, UNIT_BITS = 1.5, 0.1, 6, 16.0
_LOG = np.log(BASE)
#: Tokens of a unit; a longer text is one by itself.
UNIT_TOKENS = 2_500_000
#: What stands for the end and the start of a text; no word has a space.
END, START = (int(x) for x in word_hashes([b" end", b" start"]))
#: Kinds of keys in a filter.
WORD, PAIR, KEPT_SUM, KEPT_KINDS = 1, 2, 3, 4
#: Parts of packed rows beside ``WORD`` and ``PAIR``: a unit, contexts, and a bucket's numbers of words.
UNIT, CONTEXT, NUMBERS = 0, 5, 6
#: The least bits of a filter.
LEAST_BITS = 1 << 16
_M32 = np.uint64(0xFFFFFFFF)


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / _LOG + 1e-9).astype(np.int64)


def middle(lv: np.ndarray) -> np.ndarray:
    """The count that a level stands for; 0 for level 0."""
    low = np.ceil(BASE ** (lv - 1) - 1e-9)
    return np.where(lv > 0, np.maximum(low, (low + np.ceil(BASE**lv - 1e-9) - 1) / 2), 0.0)


def top(lv: np.ndarray) -> np.ndarray:
    return np.where(lv > 0, np.ceil(BASE ** lv.astype(float) - 1e-9) - 1, 0.0).clip(0)


def token_hashes(data: np.ndarray, off: np.ndarray):
    """(hash, row) of every token of a chunk of texts: its words and an end for every text."""
    _, _, h, rows = tokenise(data, off, True)
    n = len(off) - 1
    at = np.searchsorted(rows, np.arange(n), "right")
    return np.insert(h, at, np.uint64(END)), np.insert(rows, at, np.arange(n))


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers of 0 or more in as few bytes each as the largest needs, after a byte that says how many."""
    size = next(n for n in (1, 2, 4, 8) if n == 8 or not len(x) or int(x.max()) < 1 << 8 * n)
    return bytes([size]) + x.astype(f"u{size}").tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: the upper ones of small numbers compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _of_planes(b: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed_keys(k: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    d = k.copy()
    d[1:] -= k[:-1]
    return _planes(d)


def _unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(b, np.uint64), dtype=np.uint64)


def _inverse(x: int) -> np.uint64:
    return np.uint64(pow(x, -1, 1 << 64))


def _unmixed(x: np.ndarray) -> np.ndarray:
    """The keys that ``mix`` with seed 5 has made these of."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= _inverse(0x94D049BB133111EB)
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= _inverse(0xBF58476D1CE4E5B9)
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x - np.uint64((5 * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))


_PACKED = pa.schema([("unit", pa.int64()), ("part", pa.int32()), ("bucket", pa.int64()), *((c, pa.binary()) for c in "abcd")])
PACKED = "unit long, part int, bucket long, a binary, b binary, c binary, d binary"


def _row(unit: int, part: int, bucket: int, *parts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((unit, part, bucket, *parts, *[None] * (4 - len(parts))), _PACKED, strict=True)], schema=_PACKED)


def _rows(unit: int, part: int, bucket: np.ndarray, *columns: tuple) -> pa.RecordBatch:
    """A row for each bucket; entries come by bucket. ``columns``: arrays, and how to pack a bucket's part of each."""
    edges = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist(), len(bucket)] if len(bucket) else [0]
    n = len(edges) - 1
    packed = [[pack(x[a:b]) for a, b in zip(edges, edges[1:])] for x, pack in columns]
    packed += [[None] * n] * (4 - len(packed))
    return pa.RecordBatch.from_arrays([pa.array([unit] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(bucket[edges[:-1]].astype(np.int64)), *(pa.array(x, pa.binary()) for x in packed)], schema=_PACKED)


def _pack_units(batches):
    """Units: the rows' columns without the text (a), the tokens by the number of their word (b), the words by frequency and
    START (c), and how often the texts to learn from have each (d)."""
    place, nth, held, size = TaskContext.get().partitionId() << 33, 0, [], 0

    def unit():
        h, inv, n = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        at = np.empty(len(h), np.uint32)
        at[order] = np.arange(len(h), dtype=np.uint32)
        idx = at[inv]
        rows = pa.Table.from_batches([x[1] for x in held]).combine_chunks()
        lengths = np.concatenate([x[2] for x in held])
        rows = rows.append_column("__length", pa.array(lengths))
        learn = np.repeat(rows["__learn"].to_numpy(), lengths)
        counts = np.append(np.bincount(idx[learn], minlength=len(h)), 0)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return _row(place + nth, UNIT, -1, sink.getvalue().to_pybytes(), pa.compress(_planes(idx), "zstd", asbytes=True), np.append(h[order], np.uint64(START)).tobytes(), _narrow(counts))

    for batch in batches:
        own = batch.drop_columns(["text"])
        for first, data, off in chunks(batch.column("text")):
            n = len(off) - 1
            h, rows = token_hashes(data, off)
            held.append((h, own.slice(first, n), np.bincount(rows, minlength=n)))
            size += len(h)
            if size >= UNIT_TOKENS:
                yield unit()
                nth, size = nth + 1, 0
                held.clear()
    if held:
        yield unit()


class Unit:
    """A unit's rows, tokens and words, and its pairs: ``codes`` of two word numbers."""

    def __init__(self, a: bytes, b: bytes, c: bytes):
        self.rows = pa.ipc.open_stream(a).read_all()
        self.lengths = self.rows["__length"].to_numpy()
        self.idx = _of_planes(pa.decompress(b, int(4 * self.lengths.sum()), "zstd", asbytes=True), np.uint32)
        self.words = np.frombuffer(c, np.uint64)
        before = np.empty_like(self.idx)
        before[1:] = self.idx[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = len(self.words) - 1
        self.codes = before.astype(np.uint64) * np.uint64(len(self.words)) + self.idx

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """Keys of pairs, mixed; their upper bits tell the bucket."""
        low, n = self.words & _M32, np.uint64(len(self.words))
        return mix(low[codes // n] << np.uint64(32) | low[codes % n], 5)


def word_places(words: np.ndarray) -> np.ndarray:
    """Mixed keys of words as contexts; their upper bits tell the bucket."""
    return mix(words & _M32, 5)


def _bucket(mixed: np.ndarray, buckets: int) -> np.ndarray:
    """``buckets`` is a power of two of 2 at least."""
    return mixed >> np.uint64(65 - buckets.bit_length())


def _ask_pairs(buckets: int):
    """What units ask of the pairs' buckets: keys, and how often the texts to learn from have them."""

    def run(batches):
        for batch in batches:
            for unit, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("unit", "a", "b", "c")), strict=True):
                own = Unit(a, b, c)
                learn = np.repeat(own.rows["__learn"].to_numpy(), own.lengths)
                s = np.sort(own.codes << np.uint64(1) | learn)
                code = s >> np.uint64(1)
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                n = np.add.reduceat((s & np.uint64(1)).astype(np.int64), first)
                k = own.keys(code[first])
                order = np.argsort(k, kind="stable")
                k = k[order]
                yield _rows(unit, PAIR, _bucket(k, buckets), (k, _packed_keys), (n[order], _narrow))

    return run


def _ask_words(buckets: int):
    """What units ask of the words' buckets: hashes, and how often the texts to learn from have them."""

    def run(batches):
        for batch in batches:
            for unit, c, d in zip(*(batch.column(x).to_pylist() for x in ("unit", "c", "d")), strict=True):
                words, n = np.frombuffer(c, np.uint64), _wide(d)
                place = word_places(words)
                order = np.argsort(place, kind="stable")
                yield _rows(unit, WORD, _bucket(place[order], buckets), (words[order], lambda x: x.tobytes()), (n[order], _narrow))

    return run


def _by_bucket(batches):
    """(bucket, its rows); rows come sorted by bucket."""
    held, own = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "unit", "a", "b", "c")), strict=True):
            if held and own != row[0]:
                yield own, held
                held = []
            own = row[0]
            held.append(row[1:])
    if held:
        yield own, held


def _summed(keys: np.ndarray, *counts: np.ndarray):
    """(different keys, which of them each key is, the sums of their counts)"""
    k, inv = np.unique(keys, return_inverse=True)
    return k, inv, *(np.bincount(inv, weights=c, minlength=len(k)).astype(np.int64) for c in counts)


class Filter:
    """A filter of ``size`` bits. ``levels`` reads counts back as levels, 0 where there is none."""

    def __init__(self, size: int, held: list[tuple[int, np.ndarray, np.ndarray]]):
        """``held``: kind, keys and levels of what it holds."""
        self.size = np.uint64(size)
        marked = np.zeros(size, bool)
        for kind, keys, lv in held:
            at = 1
            while (up := lv >= at).any():
                keys, lv = keys[up], lv[up]
                a, b = self._ways(keys, kind, at)
                for i in range(HASHES):
                    marked[self._place(a, b, i)] = True
                at += 1
        self.bits = np.packbits(marked, bitorder="little")

    @staticmethod
    def _ways(keys: np.ndarray, kind: int, lv: int):
        a = mix(keys ^ mix(np.array([kind << 20 | lv], np.uint64), 11), 1)
        return a, mix(a, 2) | np.uint64(1)

    def _place(self, a, b, i: int) -> np.ndarray:
        return ((a + np.uint64(i) * b >> np.uint64(32)) * self.size) >> np.uint64(32)

    def has(self, keys: np.ndarray, kind: int, lv: int) -> np.ndarray:
        left, (a, b) = np.arange(len(keys)), self._ways(keys, kind, lv)
        for i in range(HASHES):
            p = self._place(a, b, i)
            found = np.flatnonzero(self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1)
            if len(found) < len(left):
                left, a, b = left[found], a[found], b[found]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        out, left, lv = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 1
        while len(left):
            left = left[self.has(keys[left], kind, lv)]
            out[left] = lv
            lv += 1
        return out


def _levels(bits: int, held: list[tuple], asked: list[tuple]) -> list[np.ndarray]:
    """The levels of ``asked`` (kind, keys, mixed), read back from filters of ``bits`` bits at most of what is ``held`` (kind, keys, mixed,
    counts). Where one filter would be larger the keys are dealt out to several, one after another; none is left out."""
    held = [(kind, k[n > 0], m[n > 0], level(n[n > 0])) for kind, k, m, n in held]
    need = int(UNIT_BITS * sum(int(lv.sum()) for *_, lv in held))
    parts = -(-need // bits) if need > bits else 1
    out = [np.zeros(len(k), np.uint8) for _, k, _ in asked]
    for i in range(parts):
        mine = lambda m, i=i: m % np.uint64(parts) == np.uint64(i) if parts > 1 else slice(None)
        got = Filter(max(LEAST_BITS, -(-need // parts)), [(kind, k[mine(m)], lv[mine(m)]) for kind, k, m, lv in held])
        for x, (kind, k, m) in zip(out, asked, strict=True):
            x[mine(m)] = got.levels(k[mine(m)], kind)
    return out


def _tell_pairs(buckets: int, bits: int):
    """The levels of the pairs that units ask for, and the contexts of the pairs held: numbers of kinds, and twice their sums, which
    may be halves, dealt out to the words' buckets."""

    def run(batches):
        for bucket, rows in _by_bucket(batches):
            keys, counts = [_unpacked_keys(r[2]) for r in rows], [_wide(r[3]) for r in rows]
            k, inv, n = _summed(np.concatenate(keys), np.concatenate(counts))
            (lv,) = _levels(bits, [(PAIR, k, k, n)], [(PAIR, k, k)])
            got, at = lv[inv], np.cumsum([0, *map(len, keys)])
            for i, r in enumerate(rows):
                yield _row(r[1], PAIR, bucket, got[at[i] : at[i + 1]].tobytes())
            h, inv = np.unique(_unmixed(k[n > 0]) >> np.uint64(32), return_inverse=True)
            kinds, twice = np.bincount(inv, minlength=len(h)), np.bincount(inv, weights=2 * middle(level(n[n > 0])), minlength=len(h)).astype(np.int64)
            place = word_places(h)
            order = np.argsort(place, kind="stable")
            yield _rows(-1, CONTEXT, _bucket(place[order], buckets), (h[order], _narrow), (kinds[order], _narrow), (twice[order], _narrow))

    return run


def _tell_words(bits: int):
    """Of the words that units ask for the exact counts (a) and the levels of word, kinds after it and their sum (b, c, d); and the
    bucket's numbers: tokens, and words by level."""

    def run(batches):
        for bucket, rows in _by_bucket(batches):
            asked, after = [r for r in rows if r[0] == WORD], [r for r in rows if r[0] == CONTEXT]
            keys = [np.frombuffer(r[2], np.uint64) for r in asked]
            none = [np.zeros(0, np.int64)]
            k, inv, n = _summed(np.concatenate([*keys, none[0].view(np.uint64)]), np.concatenate([*(_wide(r[3]) for r in asked), *none]))
            h, kinds, twice = (np.concatenate([*(_wide(r[i]) for r in after), *none]) for i in (2, 3, 4))
            h, _, kinds, twice = _summed(h.view(np.uint64), kinds, twice)
            low, m, of = k & _M32, word_places(k), word_places(h)
            got = _levels(bits, [(WORD, k, m, n), (KEPT_KINDS, h, of, kinds), (KEPT_SUM, h, of, (twice + 1) // 2)], [(WORD, k, m), (KEPT_KINDS, low, m), (KEPT_SUM, low, m)])
            at = np.cumsum([0, *map(len, keys)])
            for i, r in enumerate(asked):
                mine = inv[at[i] : at[i + 1]]
                yield _row(r[1], WORD, bucket, _narrow(n[mine]), *(x[mine].tobytes() for x in got))
            yield _row(-1, NUMBERS, bucket, _narrow(np.array([n.sum()])), _narrow(np.bincount(level(n[n > 0]))))

    return run


def _numbers(batches):
    """(level, n): words by level; at level 0 the tokens."""
    for batch in batches:
        for a, b in zip(*(batch.column(x).to_pylist() for x in "ab"), strict=True):
            n = _wide(b)
            n = np.concatenate([_wide(a), n[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)).astype(np.int32)), pa.array(n)], names=["level", "n"])


@dataclass
class Model:
    """What scoring needs beside the answers of the filters: tokens and kinds of words, and the sum of all words' counts as they are read back."""

    tokens: int
    kinds: int
    total: float
    #: The lowest levels that filters hold.
    least: dict[int, int] = field(default_factory=lambda: {WORD: 1, PAIR: 1})

    def log10(self, unit: Unit, codes: np.ndarray, count: np.ndarray, lv: np.ndarray, kinds: np.ndarray, kept: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 P of every different pair. Of words (START last): exact counts, levels, levels of kinds and sums after them; ``pair``: levels of pairs."""
        n = np.uint64(len(unit.words))
        before, after = codes // n, codes % n
        p = ((middle(lv) + ADD) / (self.total + ADD * (self.kinds + 1)))[after]
        # every text starts after START, which is as frequent as END
        known, ends = lv > 0, int(count[unit.words == np.uint64(END)].sum())
        known[-1] = True
        t, r = middle(np.where(known, kinds, 0)), top(np.where(known & (kinds > 0), kept, 0))  # a filter may say more than it holds
        c = top(lv)
        c[-1] = top(level(np.array([ends])))[0] if ends else 0.0
        c = np.maximum(c, r)
        C, R, T = c[before], r[before], t[before]
        pair = np.where((T > 0) & (lv[after] > 0), middle(pair), 0.0)
        return np.log10(np.where(C > 0, (pair + (C - R + T) * p) / np.maximum(C + T, 1e-300), p))


def train(docs: DataFrame, bits: int = 1 << 28, words: int = 1 << 20, bucket_bytes: int = 16 << 20, fan: int = 1024) -> tuple[Model, DataFrame]:
    """The model of the texts of ``docs`` (those that are true in ``__learn``, where there is such a column), and packed rows: the units of
    all texts, and what the filters say of their words and pairs.

    ``bits``: the most bits of one filter; a bucket that needs more has several. ``bucket_bytes``: about the bytes of text whose n-grams a
    bucket holds. ``words`` and ``fan`` bounded what earlier versions held and dealt out; they are accepted and bound nothing.
    """
    spark = docs.sparkSession
    if "__learn" not in docs.columns:
        docs = docs.withColumn("__learn", F.lit(True))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 8
    while buckets * bucket_bytes < size:
        buckets *= 2
    units = shared_table(spark, docs.mapInArrow(_pack_units, PACKED), "units")
    dealt = lambda df: df.repartition("bucket").sortWithinPartitions("bucket", "part", "unit")
    pairs = dealt(units.select("unit", "a", "b", "c").mapInArrow(_ask_pairs(buckets), PACKED))
    pairs = shared_table(spark, pairs.mapInArrow(_tell_pairs(buckets, bits), PACKED), "pairs")
    asked = units.select("unit", "c", "d").mapInArrow(_ask_words(buckets), PACKED).unionByName(pairs.filter(F.col("part") == CONTEXT))
    told = shared_table(spark, dealt(asked).mapInArrow(_tell_words(bits), PACKED), "words")
    numbers = told.filter(F.col("part") == NUMBERS).select("a", "b").mapInArrow(_numbers, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    numbers = {r["level"]: r["n"] for r in numbers.collect()}
    tokens = numbers.pop(0, 0)
    total = float(sum(n * middle(np.array([lv]))[0] for lv, n in sorted(numbers.items())))
    answers = pairs.filter(F.col("part") == PAIR).unionByName(told.filter(F.col("part") == WORD))
    return Model(tokens, sum(numbers.values()), total), units.drop("d").withColumn("d", F.lit(None).cast("binary")).unionByName(answers)


def _scored(model: Model, keep: list[str]):
    """The scores of units, whose rows come together: the unit, then what its words and pairs were told, by bucket."""

    def score(rows: list) -> pa.RecordBatch:
        own = Unit(*rows[0][1:4])
        words, pairs = ([r for r in rows if r[0] == part] for part in (WORD, PAIR))
        order = np.argsort(word_places(own.words), kind="stable")
        of = np.empty((4, len(order)), np.int64)
        of[:, order] = [np.concatenate([_wide(r[1]) for r in words]), *(np.frombuffer(b"".join(r[i] for r in words), np.uint8) for i in (2, 3, 4))]
        codes, inv = np.unique(own.codes, return_inverse=True)
        pair = np.empty(len(codes), np.int64)
        pair[np.argsort(own.keys(codes), kind="stable")] = np.frombuffer(b"".join(r[1] for r in pairs), np.uint8)
        count, n = of[0], len(own.lengths)
        at = np.repeat(np.arange(n), own.lengths)
        summed = lambda x: np.bincount(at, weights=x, minlength=n)
        made = {
            "n_tokens": own.lengths.astype(np.int64), "n_known": summed((count > 0)[own.idx]).astype(np.int64), "train_tokens": np.full(n, model.tokens, np.int64),
            "base_score": summed(np.log10(count + ADD)[own.idx]) - own.lengths * np.log10(model.tokens + ADD * (model.kinds + 1)),
            "score": summed(model.log10(own, codes, *of, pair)[inv]),
        }
        (batch,) = own.rows.to_batches()
        batch = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, made.values())], names=[*keep, *made])
        return batch.filter(own.rows["__ask"].combine_chunks())

    def run(batches):
        held, unit = [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("unit", "part", "a", "b", "c", "d")), strict=True):
                if held and row[0] != unit:
                    yield score(held)
                    held = []
                unit = row[0]
                held.append(row[1:])
        if held:
            yield score(held)

    return run


def score_texts(docs: DataFrame, training: DataFrame | Column, **sizes) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to the rows of ``docs``, without ``text``.

    ``training``: texts to learn from, or a condition on the rows of ``docs``; rows that are asked and learnt from are cut into words once.
    Tokens are the words of a text, A-Z lower-cased, and an end; a null or empty text has the end only. An empty
    training table gives base_score and score 0 for every token. Equal rows stay. ``sizes``: see ``train``.
    Columns of these names in ``docs`` are replaced. Words count as equal where their 64-bit hashes are.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    learn = F.coalesce(training, F.lit(False)) if isinstance(training, Column) else F.lit(False)
    docs = docs.withColumns({"__learn": learn, "__ask": F.lit(True)})
    docs = docs.select(*replacing(docs, *made))
    keep = [c for c in docs.columns if c not in ("text", "__learn", "__ask")]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    if not isinstance(training, Column):
        docs = docs.unionByName(training.select("text", F.lit(True).alias("__learn"), F.lit(False).alias("__ask")), allowMissingColumns=True)
    model, rows = train(docs, **sizes)
    rows = rows.repartition("unit").sortWithinPartitions("unit", "part", "bucket")
    return rows.mapInArrow(_scored(model, keep), ", ".join([*kept, "n_tokens long, n_known long, train_tokens long, base_score double, score double"]))
