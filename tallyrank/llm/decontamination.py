"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are lower-cased (A-Z) and their white space is one space. Windows open in documents at every ``stride``-th
word, whatever the words are, and in items at every word that leaves a window's length. The CGK random walk goes
over a window: by a random bit of step and character it moves on or stays, so that a few edits make a few places
of the embedding differ. The walk is repeated ``walks`` times. A table of the LSH samples ``places`` places of one
walk, spread over its length; a window that agrees with an item's window in all places of a table is a candidate.
Candidates whose whole embeddings agree in ``agree`` places or more are verified by the exact edit distance of the
item to the best matching stretch around them (bit-parallel, in code points).

The number of tables follows from the wanted recall: a table holds with the probability that a sampled place
agrees, to the power of its places, and items longer than a window have a chance at each of the document's windows
inside them. ``LONG`` and ``SHORT`` are set so that at least 0.9 of random edits of characters or words at a similarity
of 0.82 are found, for items of any length (see the tests). Three steps of the walk are taken at once: a place is the three characters there.

Items are the stated query set; items of one text are searched for once. They are taken in blocks of ``block_bytes``
bytes at most (an item of more is a block of its own), each broadcast to one pass over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import bounded_batches, chunks

#: Windows that are walked over at once.
WINDOWS = 1 << 16
_SEED = 977


@dataclass(frozen=True)
class Search:
    """How items of ``least`` characters and more are searched for: a window at every ``stride``-th word, ``steps``
    triple steps of ``walks`` walks, ``tables`` tables of ``places`` places for each walk; ``agree``: see above."""

    least: int
    stride: int
    steps: int
    walks: int
    tables: int
    places: int
    agree: int

    @property
    def width(self) -> int:
        """Characters that a walk passes on average: half a character a step."""
        return 3 * self.steps // 2


LONG = Search(least=64, stride=2, steps=24, walks=4, tables=40, places=4, agree=19)
SHORT = Search(least=16, stride=1, steps=9, walks=6, tables=60, places=3, agree=8)

# -- characters and texts --------------------------------------------------------------------------

#: 0 for white space, 1 to 26 for letters, digits and signs by five more; bytes beyond ASCII are spread over all.
_KIND = np.full(256, 31, np.uint16)
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
for _i in range(26):
    _KIND[97 + _i] = _KIND[65 + _i] = 1 + _i
for _i in range(10):
    _KIND[48 + _i] = 27 + _i % 4
_KIND[128:] = 1 + (np.arange(128) * 37) % 30


def plain(text: str | bytes | None) -> bytes:
    text = (text or b"") if not isinstance(text, str) else text.encode()
    return b" ".join(text.lower().split())


def flat(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with one space for each run of white space, row offsets in them); every row ends in a space."""
    kind = _KIND[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (kind[1:] > 0) | (kind[:-1] > 0)
    keep[off[1:-1][off[1:-1] < len(data)]] = True
    out = data[keep]
    out[kind[keep] == 0] = 32
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    # a space between rows, so that no word reaches over
    out = np.insert(out, at[1:], 32)
    return out, at + np.arange(len(at))


def triples(data: np.ndarray) -> np.ndarray:
    """At each byte the kinds of it and of the two after it, in 15 bits; spaces follow the end."""
    kind = np.concatenate([_KIND[data], np.zeros(3, np.uint16)])
    return (kind[:-2] << 10) | (kind[1:-1] << 5) | kind[2:]


def word_starts(triple: np.ndarray) -> np.ndarray:
    """Where a byte that is no space follows a space, or the beginning."""
    space = (triple >> 10) == 0
    first = ~space
    first[1:] &= space[:-1]
    return np.flatnonzero(first)


def edit_distance(pattern: str, text: str) -> int:
    """The least edit distance of ``pattern`` to a stretch of ``text`` (Myers' bit vectors)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best


# -- walks and tables ------------------------------------------------------------------------------


def _advances(rng: np.random.Generator) -> np.ndarray:
    """For every triple how far three steps of a walk go, by a random bit of each step and kind."""
    t = np.arange(1 << 15)
    kinds = np.stack([t >> 10, t >> 5 & 31, t & 31])
    bits = rng.integers(0, 2, (3, 32))
    gone = np.zeros(1 << 15, np.int64)
    for step in range(3):
        gone += bits[step][kinds[gone, t]]
    return gone


class Index:
    """The tables of the windows of items. ``texts``: plain texts, each once."""

    def __init__(self, how: Search, texts: list[bytes]):
        self.how, rng = how, np.random.Generator(np.random.PCG64(_SEED + how.least))
        self.advance = [[_advances(rng) for _ in range(how.steps)] for _ in range(how.walks)]
        self.factor = rng.integers(0, 2**63, (how.walks, how.steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        edges = [how.steps * i // how.places for i in range(how.places + 1)]
        self.places = [[rng.integers(a, b) for a, b in zip(edges, edges[1:])] for _ in range(how.walks * how.tables)]
        at, self.item, self.offset, base = [], [], [], 0
        for i, text in enumerate(texts):
            starts = word_starts(triples(np.frombuffer(text, np.uint8)))
            starts = starts[(np.arange(len(starts)) < how.stride) | (starts <= len(text) - how.width)]
            at.append(starts + base)
            self.item.append(np.full(len(starts), i))
            self.offset.append(starts)
            base += len(text) + how.width * 2
        self.item, self.offset, at = (np.concatenate(x).astype(np.int64) for x in (self.item, self.offset, at))
        room = b" " * (how.width * 2)
        self.seen = self.walk(triples(np.frombuffer(b"".join(t + room for t in texts), np.uint8)), at)
        self.bits = max(12, int(np.ceil(np.log2(len(at) + 1))) + 4)
        self.tables = []
        for n in range(len(self.places)):
            key = self._keys(n, self._hashed(self.seen, n // how.tables))
            order = np.argsort(key, kind="stable")
            sieve = np.zeros(1 << self.bits, bool)
            sieve[(key >> np.uint64(64 - self.bits)).astype(np.int64)] = True
            self.tables.append((sieve, key[order], order))

    def walk(self, triple: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(walks * steps, windows): the triple at every third step of each walk from the places ``at``."""
        how = self.how
        out = np.empty((how.walks * how.steps, len(at)), np.uint16)
        for w in range(how.walks):
            pos = at.copy()
            for j in range(how.steps):
                x = triple.take(pos, mode="clip")
                out[w * how.steps + j] = x
                pos += self.advance[w][j].take(x)
        return out

    def _hashed(self, seen: np.ndarray, w: int) -> np.ndarray:
        own = seen[w * self.how.steps : (w + 1) * self.how.steps]
        return (own + np.uint64(1)) * self.factor[w][:, None]

    def _keys(self, n: int, hashed: np.ndarray) -> np.ndarray:
        first, *rest = self.places[n]
        key = hashed[first].copy()
        for p in rest:
            key += hashed[p]
        return key

    def candidates(self, triple: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window), each pair once: those that agree in a table and in ``agree`` places in all."""
        seen, found = self.walk(triple, at), []
        for n, (sieve, keys, order) in enumerate(self.tables):
            if n % self.how.tables == 0:
                hashed = self._hashed(seen, n // self.how.tables)
            key = self._keys(n, hashed)
            may = np.flatnonzero(sieve.take((key >> np.uint64(64 - self.bits)).view(np.int64)))
            low = np.minimum(np.searchsorted(keys, key[may]), len(keys) - 1)
            hit = np.flatnonzero(keys[low] == key[may])
            if len(hit):
                may, low = may[hit], low[hit]
                n_same = np.searchsorted(keys, key[may], "right") - low
                place = np.repeat(low, n_same) + np.arange(n_same.sum()) - np.repeat(np.cumsum(n_same) - n_same, n_same)
                found.append(np.repeat(may, n_same) * len(order) + order[place])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate(found))
        mine, own = pair // len(self.item), pair % len(self.item)
        keep = []
        for i in range(0, len(pair), WINDOWS):
            same = seen[:, mine[i : i + WINDOWS]] == self.seen[:, own[i : i + WINDOWS]]
            keep.append(same.sum(0) >= self.how.agree)
        keep = np.concatenate(keep)
        return mine[keep], own[keep]


class Items:
    """A block of items: ids and plain text of each, the index of each kind, and the short items by their text."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float):
        ids: dict[bytes, list[int]] = {}
        for i, t in items:
            ids.setdefault(t, []).append(i)
        self.texts, self.ids = list(ids), list(ids.values())
        self.told = [t.decode("utf-8", "ignore") for t in self.texts]
        self.limit = [int((1 - similarity) * len(t) + 1e-9) for t in self.told]
        # triples of items in ASCII: each edit takes three of them at most
        self.grams = [triples(np.frombuffer(t, np.uint8))[:-3].tolist() if t.isascii() else None for t in self.texts]
        self.parts = []
        for how, most in ((LONG, None), (SHORT, LONG.least)):
            mine = [n for n, t in enumerate(self.texts) if len(t) >= how.least and (most is None or len(t) < most)]
            if mine:
                self.parts.append((Index(how, [self.texts[n] for n in mine]), mine))
        self.tiny = [n for n, t in enumerate(self.texts) if len(t) < SHORT.least]

    def near(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, distance) of the items that rows hold; ``data`` and ``off`` as ``flat`` makes them."""
        triple, raw = triples(data), data.tobytes()
        best: dict[tuple[int, int], int] = {}
        starts = word_starts(triple)
        for index, mine in self.parts:
            opened = starts[:: index.how.stride]
            spots: dict[tuple[int, int], list[int]] = {}
            for i in range(0, len(opened), WINDOWS):
                at = opened[i : i + WINDOWS]
                window, own = index.candidates(triple, at)
                row = np.searchsorted(off, at[window], "right") - 1
                for r, n, p in zip(row.tolist(), index.item[own].tolist(), (at[window] - index.offset[own]).tolist()):
                    spots.setdefault((r, mine[n]), []).append(p)
            for (r, n), places in spots.items():
                d = self._least(raw, triple, n, sorted(set(places)), int(off[r]), int(off[r + 1]) - 1)
                if d <= self.limit[n]:
                    best[r, n] = d
        if self.tiny:
            for r in range(len(off) - 1):
                text = b" " + raw[off[r] : off[r + 1] - 1].strip().lower() + b" "
                for n in self.tiny:
                    if b" " + self.texts[n] + b" " in text:
                        best[r, n] = 0
        return [(r, n, d) for (r, n), d in sorted(best.items())]

    def _least(self, raw: bytes, triple: np.ndarray, n: int, places: list[int], begin: int, end: int) -> int:
        """The least distance of item n to the stretches of a row at which it may begin."""
        best, done, slack, size = len(self.told[n]) + 1, -1, self.limit[n] + 8, len(self.texts[n])
        for p in places:
            if p < done or best == 0:
                continue
            # places near each other share a stretch
            done = p + slack // 2
            a, b = max(begin, p - slack), min(end, p + size + 2 * slack)
            text = raw[a:b].lower()
            if self.texts[n] in text:
                best = 0
            elif self._may(n, triple[a:b]):
                best = min(best, edit_distance(self.told[n], text.decode("utf-8", "ignore")))
        return best

    def _may(self, n: int, triple: np.ndarray) -> bool:
        """Whether a stretch has as many of an item's triples as must be left within the limit of edits."""
        if self.grams[n] is None:
            return True
        have = set(triple.tolist())
        return sum(g in have for g in self.grams[n]) >= len(self.grams[n]) - 3 * self.limit[n]


_built: dict[bytes, Items] = {}


def _items(items: list[tuple[int, bytes]], similarity: float) -> Items:
    """The items of a broadcast block; a worker keeps those of the last one."""
    key = repr((similarity, items)).encode()
    if key not in _built:
        _built.clear()
        _built[key] = Items(items, similarity)
    return _built[key]


def _search(sent, similarity: float):
    def run(batches):
        items = _items(sent.value, similarity)
        for batch in batches:
            docs = batch.column("doc_id")
            for first, data, off in chunks(batch.column("text")):
                hits = [(first + r, i, d, n) for r, n, d in items.near(*flat(data, off)) for i in items.ids[n]]
                if hits:
                    row, item, distance, n = zip(*hits, strict=True)
                    like = [1 - d / max(1, len(items.told[k])) for d, k in zip(distance, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(distance, pa.int64()), pa.array(like, pa.float64())], names=["doc_id", "item_id", "distance", "similarity"])

    return run


def find_items(docs: DataFrame, items: DataFrame, similarity: float = 0.8, block_bytes: int = 1 << 19) -> DataFrame:
    """The pairs of a row of ``docs`` and an item that a stretch of its text equals up to edits.

    ``items`` has item_id and text. Returns doc_id (a long), item_id, distance (edits of code points, the least of
    the stretches found) and similarity (1 - distance / length of the item), at ``similarity`` or more. Items of fewer
    than ``SHORT.least`` bytes are found where their words stand in a text as they are. Null texts hold and match
    nothing, nor do texts without words and items without an id. Rows of equal items and equal rows each get their
    pairs. A passage that agrees with its item in no table is not found.
    """
    spark = bounded_batches(docs.sparkSession)
    size = F.octet_length("text")
    items = items.select(F.col("item_id").cast("long"), "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = items.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes))
    schema = "doc_id long, item_id long, distance long, similarity double"
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for b in range(blocks):
        # a hash deals the items out to blocks of half the most bytes on average
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        held = sorted((r["item_id"], plain(r["text"])) for r in block.collect())
        held = [x for x in held if len(x[1]) > 0]
        if held:
            found = docs.mapInArrow(_search(spark.sparkContext.broadcast(held), similarity), schema)
            out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = 0.8, **sizes) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; rows with a null doc_id are kept and not searched."""
    found = find_items(docs.filter(F.col("doc_id").isNotNull()), items, similarity, **sizes)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
