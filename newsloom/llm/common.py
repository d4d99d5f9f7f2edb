"""Helpers of the text operators: storage, Arrow text as bytes, word and shingle hashes.

Words are runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``. All of these are one
byte in UTF-8, so words are found in the bytes of a whole Arrow column at once.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import cut_lineage, shared_folder, ship

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
BYTE_BASE = 0x2127599BF4325C37 * 8 + 3
WORD_BASE = 0x880355F21E6D1965 * 8 + 5
#: Text of one vectorised step; a single longer document is one step of its own.
CHUNK_BYTES = 1 << 20
#: Arrow bytes that a Python worker is sent at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of bounded bytes, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(ship(spark)).read.parquet(f"{sf_dir}/{table}.parquet")


def release(spark: SparkSession) -> None:
    """A hint to drop shuffle files and checkpoints that no table in use refers to any more.

    Spark removes them when the driver collects its garbage, which a small driver
    heap may not do for a whole job. Results never depend on it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder, read by what follows; files of earlier steps go."""
    release(df.sparkSession)
    return cut_lineage(df)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; on a cluster without ``spark.checkpoint.dir`` an error."""
    base = shared_folder(spark) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, U(base & (2**64 - 1)))
    if n:
        p[0] = U(1)
    return np.cumprod(p, dtype=np.uint64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, kept for the next call."""

    def __init__(self, base: int):
        self.base = base & (2**64 - 1)
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


BYTE_POWERS, WORD_POWERS = Powers(BYTE_BASE), Powers(WORD_BASE)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``; equal spans have equal hashes."""
    up, down = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:], dtype=np.uint64)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * STEP)


class Words:
    """The words of a run of documents: byte spans, document bounds and word hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        inside = ~SPACE[data] if len(data) else np.zeros(0, bool)
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.data = data
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: Words of document d are ``first[d]`` to ``first[d + 1]``.
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        table = mix((np.arange(256, dtype=np.uint64) + U(1 + 256 * seed)) * STEP)
        return span_hashes(table[self.data], self.start, self.end, BYTE_POWERS)

    def windows(self, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end word and document of each window of ``size`` words.

        With ``short``, a document of fewer words is one window of all its words.
        """
        n = np.maximum(self.count - size + 1, 0)
        length = np.full(len(n), size)
        if short:
            small = (n == 0) & (self.count > 0)
            length[small] = self.count[small]
            n = np.where(small, 1, n)
        doc = np.repeat(np.arange(len(n)), n)
        begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[:-1][doc]
        return begin, begin + length[doc], doc


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_steps(
    batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = 1 << 30
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``CHUNK_BYTES`` of text and at most ``rows`` rows each, and their bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, bounds = column_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive runs of ``values`` as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n
