"""Shared helpers: byte-level numpy kernels over Arrow text columns and staged tables.

Text columns reach Python as Arrow batches.  ``text_chunks`` exposes the UTF-8
buffer behind them in pieces of about ``CHUNK_BYTES``, so the temporaries of a
kernel stay small however long the batch is (one longer text forms a piece of
its own).  Hashes are 64-bit and depend on content alone.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1024
BATCH_BYTES, BATCH_ROWS = 2 << 20, 20_000
U64 = np.uint64

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
OTHER_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))  # for a second hash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse for exponents 0..n-1."""
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        grown = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, U64)
            p[0] = 1
            grown.append(np.multiply.accumulate(p))
        _pow, _inv = grown
    return _pow, _inv


class RollingHash:
    """Hashes of substrings of one byte buffer in O(1) each, from prefix sums; ``values`` gives each byte its number."""

    def __init__(self, buf: np.ndarray, values: np.ndarray = _BYTE):
        power, self._inverse = _powers(len(buf) + 1)
        self._sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(values[buf] * power[: len(buf)], out=self._sums[1:])

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of buf[lo:hi] for arrays of bounds; the length takes part."""
        raw = (self._sums[hi] - self._sums[lo]) * self._inverse[lo]
        return mix(raw ^ ((hi - lo).astype(U64) * U64(0xA0761D6478BD642F)))

    def grams(self, k: int) -> np.ndarray:
        """Hash of every buf[i:i+k]."""
        n = len(self._sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        raw = (self._sums[k:] - self._sums[:n]) * self._inverse[:n]
        return mix(raw ^ (U64(k) * U64(0xA0761D6478BD642F)))


def text_chunks(col: pa.Array, max_bytes: int = CHUNK_BYTES, max_rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null texts are empty."""
    n = len(col)
    if not n:
        return
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        j = min(j, n, i + max_rows)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than space and \\x09-\\x0D."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:n]
    lo = np.flatnonzero(first)
    hi = np.flatnonzero(last) + 1
    row = np.searchsorted(offs, lo, "right") - 1
    return lo, hi, row


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle of ``width`` lower-cased words, sorted by both.

    A row of fewer words has one shingle, its whole sequence; one without words has none.
    """
    buf = LOWER[buf]
    lo, hi, row = words(buf, offs)
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = RollingHash(buf).spans(lo, hi)
    rows, hashes = [], []
    if len(h) >= width:
        m = len(h) - width + 1
        acc = np.zeros(m, U64)
        for j in range(width):
            acc = acc * U64(0xC2B2AE3D27D4EB4F) + h[j : j + m]
        whole = row[:m] == row[width - 1 :]
        rows.append(row[:m][whole])
        hashes.append(mix(acc[whole]))
    counts = np.bincount(row, minlength=len(offs) - 1)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        acc = U64(counts[r])
        with np.errstate(over="ignore"):
            for x in h[first[r] : first[r] + counts[r]]:
                acc = acc * U64(0xC2B2AE3D27D4EB4F) + x
        rows.append(np.array([r]))
        hashes.append(mix(np.array([acc ^ U64(0x5851F42D4C957F2D)], U64)))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables, ``spark.checkpoint.dir``; where it is unset, one of our own, in local mode only."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), f"quantloom-{os.getuid()}")


class Stage:
    """Tables of one run, written to the shared folder so that later steps reread them.

    A written table survives the loss of an executor and cuts the lineage.  Tables
    named in ``drop`` go when nothing reads them any more; the others belong to
    the frames that were returned, and go with the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: few long texts, or many short rows.  All operators share the one setting."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def grouped_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    if not len(keys):
        z = np.zeros(0, np.int64)
        return z, z
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return start, np.append(start[1:], len(keys))


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Joins batches that are sorted by ``key`` so that no group is cut between two tables."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))[-1])
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
