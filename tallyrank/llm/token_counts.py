"""Token counts by byte-pair merging over a heap and a linked list.

A text is cut into pieces by the vocabulary's pattern; a piece starts as its bytes, and the adjacent pair of
lowest rank (the leftmost of equals) is merged until no pair has a rank. The count is the initial symbols
minus the merges; no identifiers are made. A single space between two characters that are not white space
always begins a piece, so a text may be cut there first; each worker remembers the counts of such parts and
of pieces, up to ``MEMO`` of each.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyrank.llm.common import replacing

#: Pieces whose counts a worker remembers, and the longest of them; beyond that it begins anew.
MEMO, MEMO_CHARS = 600_000, 64
#: Fixed value: the pattern by which byte-level vocabularies of this family cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A space next to other white space, or at an end of the text.
UNEVEN = re.compile(r"^ |\s | \s| $").search
EVEN_SPACE = re.compile(r"(?<=\S) (?=\S)").split


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Parts(dict):
    """Counts of parts that follow a space; a part it has not seen is cut into pieces when asked for."""

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, part: str) -> int:
        n = self.counter.pieces(" " + part)
        if len(part) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[part] = n
        return n


class Counter(dict):
    """Counts of pieces; a piece it has not seen is merged when asked for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.first = [self.ids[s] for s in byte_symbols()]
        self.find = regex.compile(PATTERN).findall
        specials = sorted((t["content"] for t in told.get("added_tokens", []) if t.get("special")), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, specials))).split if specials else None
        self.parts = Parts(self)

    def merged(self, piece: str) -> int:
        sym = [self.first[b] for b in piece.encode()]
        n = len(sym)
        if n < 2:
            return n
        after, before, merges = list(range(1, n)) + [-1], list(range(-1, n - 1)), self.merges
        heap = []
        for i in range(n - 1):
            if m := merges.get((sym[i], sym[i + 1])):
                heap.append((m[0], i, sym[i], sym[i + 1], m[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = new, -1
            count -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, sym[k])):
                    heapq.heappush(heap, (m[0], i, new, sym[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((sym[h], new))):
                heapq.heappush(heap, (m[0], h, sym[h], new, m[1]))
        return count

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n

    def pieces(self, text: str) -> int:
        return sum(map(self.__getitem__, self.find(text)))

    def count(self, text: str) -> int:
        texts = self.cut(text) if self.cut else [text]
        total = len(texts) - 1
        for x in texts:
            if x:
                first, *rest = EVEN_SPACE(x) if UNEVEN(x) else x.split(" ")
                total += self.pieces(first) + sum(map(self.parts.__getitem__, rest))
        return total


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a vocabulary file, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > ``limit``) to the rows of ``docs``.

    ``path``: a byte-level vocabulary that every worker can open. Special strings inside a text count as one
    token and are not merged across. A null or empty text has 0 bytes and 0 tokens. Columns of these names
    in ``docs`` are replaced; repeated rows stay, an empty table stays empty.
    """
    docs = docs.select(*replacing(docs, "n_bytes", "n_tokens", "over_limit"))
    keep = docs.columns

    def run(batches):
        count = counter(path).count
        for batch in batches:
            found = [x or "" for x in batch.column("text").to_pylist()]
            n = [count(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep if c != "text"), pa.array([len(x.encode()) for x in found], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[*(c for c in keep if c != "text"), "n_bytes", "n_tokens", "over_limit"],
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*kept, "n_bytes long, n_tokens long, over_limit boolean"]))
