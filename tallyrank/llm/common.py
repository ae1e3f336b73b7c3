"""What the operators of this subpackage share: reading, shared tables, and vectorised word hashing.

Words are runs of bytes other than space and \\x09-\\x0D. Python's ``bytes.split()`` cuts at exactly
those six bytes, and no multi-byte UTF-8 character holds one of them, so words can be cut from bytes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed together; the arrays beside them take about 60 times as much.
CHUNK_BYTES = 1 << 20
#: Bytes of a row group of an intermediate table.
GROUP_BYTES = 16 << 20
#: Bytes of an Arrow batch that Spark sends to Python.
BATCH_BYTES = 4 << 20
#: Spark's regular expression for a word.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of ``BATCH_BYTES`` at most on their way to Python; texts are long, and a batch is
    held several times over on either side. (The bound on batches that come back loses columns in Spark 4.1.2; the
    operators send small ones by themselves.)"""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a
    temporary folder; on a cluster, where executors would not see that, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallyrank-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the tables that ``passing_tables`` deletes at its end.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession):
    """Tables shared inside are deleted at the end, but for those shared with ``keep``. What is returned from inside must come from kept
    tables only."""
    outer = _passing.set([])
    try:
        yield
    finally:
        for path in _passing.get():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _passing.reset(outer)


def shared_table(spark: SparkSession, df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again; this cuts its lineage. There is no mark of success: on local files the driver
    would start two more processes for its permissions, table after table."""
    path = f"{shared_dir(bounded_batches(spark))}/tallyrank/{tag}-{uuid.uuid4().hex}"
    if not keep and _passing.get() is not None:
        _passing.get().append(path)
    # a task that writes or reads holds a row group, and rows of packed arrays are long
    df.write.option("parquet.block.size", GROUP_BYTES).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt out by its key whatever Spark guesses of its size. The guess leaves out what ``explode`` adds and
    how far Parquet shrinks numbers, so tables that grow with the corpus would be gathered and hashed on the driver to be broadcast."""
    return df.hint("merge")


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def replacing(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` without those that an output column replaces (names compare without case)."""
    gone = {x.lower() for x in names}
    return [c for c in df.columns if c.lower() not in gone]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- 64-bit hashes in numpy ------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, n of each at least."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        a, b = np.full(n, _P, np.uint64), np.full(n, _PINV, np.uint64)
        a[0] = b[0] = 1
        have = _powers[0] = (np.multiply.accumulate(a), np.multiply.accumulate(b))
    return have


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalises 64-bit keys, so that every bit of a key reaches every bit of the result."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair of bounds; it depends on the values only, not on their place."""
    p, inv = powers(len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * p[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _BYTE[7])


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes that ``tokenise`` gives to these words."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return span_hashes(_BYTE[data], np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def pieces(batches, name: str = "text", most: int = CHUNK_BYTES):
    """The batches in slices of whole rows, of about ``most`` bytes of a text column each."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        end, at = np.cumsum(size.astype(np.int64)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def chunks(column: pa.Array, most: int = CHUNK_BYTES):
    """(first row, bytes, row offsets) of groups of whole rows, of about ``most`` bytes; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def tokenise(data: np.ndarray, off: np.ndarray, lower: bool):
    """(start, end, hash, row) of every word; row counts from 0 within this chunk."""
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = off[1:-1][off[1:-1] < len(data)]
    first[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    prev = cut[cut > 0] - 1
    last[prev] = word[prev]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, span_hashes(_BYTE[data], starts, ends), np.searchsorted(off, starts, "right") - 1


def run_hashes(words: np.ndarray, rows: np.ndarray, n: int):
    """Hashes of n consecutive words that lie in one row, and where they start."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    return span_hashes(words, at, at + n), at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
