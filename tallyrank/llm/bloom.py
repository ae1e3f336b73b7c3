"""Bloom filters of a fixed most size, filled block by block where their keys lie."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import mix

HASHES, KEY_BITS, BLOCKS = 6, 10, 64


def _places(keys: np.ndarray, size: int) -> list[np.ndarray]:
    a = mix(keys, 21)
    b = mix(a, 22) | np.uint64(1)
    return [((a + np.uint64(i) * b) >> np.uint64(17)) % np.uint64(size) for i in range(HASHES)]


class Bloom:
    """A set of 64-bit keys; it may hold others too, but never lacks one."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, len(bits) * 8 // BLOCKS

    def __contains__(self, keys):
        raise TypeError("use has()")

    def has(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(keys), bool), np.arange(len(keys))
        base = (mix(keys, 23) % np.uint64(BLOCKS)) * np.uint64(self.size)
        for at in _places(keys, self.size):
            p = base[left] + at[left]
            left = left[(self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out[left] = True
        return out


def bits_for(n: int) -> int:
    """Bits for n keys: a power of two, KEY_BITS a key or more."""
    bits = 1 << 14
    while bits < KEY_BITS * n:
        bits *= 2
    return bits


def bloom_of(keys: DataFrame, bits: int) -> Bloom:
    """The filter of the longs in the only column of ``keys``. The driver gets ``bits`` bits, however many keys there are."""
    size, name = bits // BLOCKS, keys.columns[0]

    def mark(batches):
        held = np.zeros((BLOCKS, size // 8), np.uint8)
        for batch in batches:
            k = batch.column(0).to_numpy().view(np.uint64)
            block = (mix(k, 23) % np.uint64(BLOCKS)).astype(np.int64)
            for p in _places(k, size):
                np.bitwise_or.at(held, (block, (p >> np.uint64(3)).astype(np.int64)), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))
        used = np.flatnonzero(held.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([held[b].tobytes() for b in used], pa.binary())], names=["block", "bits"])

    def join(table: pa.Table) -> pa.Table:
        got = np.zeros(size // 8, np.uint8)
        for x in table.column("bits").to_pylist():
            got |= np.frombuffer(x, np.uint8)
        return pa.table({"block": [table.column("block")[0].as_py()], "bits": [got.tobytes()]})

    # keys of a block meet in few tasks, so that each task marks few blocks
    dealt = keys.repartition(F.pmod(F.xxhash64(F.col(name)), F.lit(16)))
    parts = dealt.mapInArrow(mark, "block long, bits binary").groupBy("block").applyInArrow(join, "block long, bits binary").collect()
    held = np.zeros(bits // 8, np.uint8)
    for b, x in parts:
        held[b * (size // 8) : (b + 1) * (size // 8)] = np.frombuffer(x, np.uint8)
    return Bloom(held)
