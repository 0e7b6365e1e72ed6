"""Whitening of embeddings by an exact scatter in a residue number system.

Entries are scaled to whole numbers.  The scatter, the sum of x x' over all rows, is exact: each partition
multiplies its rows' residues modulo several primes of about 20 bits as float64 matrices, blocks small
enough that no product sum passes 2^53; the residues are summed over partitions, and the
Chinese remainder theorem gives the whole numbers back.  So the covariance n * scatter - S S' is
exact too, however many rows there are and in whatever order tasks end; only then is it divided and
given to a symmetric eigensolver in doubles, twice: the second solve, in the basis of the first one,
takes away what the first left off the diagonal.

Only matrices of dimension x dimension reach the driver, never rows.  Partial matrices are dealt by
(prime, row) and summed as they come, so a reducer holds a few rows of matrices.  A lost task adds its rows again.

Defined results: a null vector, and one with null or non-finite entries, is dropped.  The dimension is that of most rows
left (of equally frequent ones the larger); rows of another length are dropped.  Entries are held to +-2^40.
A component without variance has null ``whitened``; ``explained`` is null if no component has any.
``deviation`` is null where it passes a long.  Rows that repeat an id each have their
own.  An empty table, or one of empty vectors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Stage, arrow_batches

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 40)
COMPONENTS = 8
BLOCK_ROWS = 4096  # rows of a product: 2^12 residues below 2^20 each sum to less than 2^52


def primes(count: int, below: int = 1 << 20) -> list[int]:
    """The largest primes below a bound."""
    found, at = [], below - 1
    while len(found) < count:
        if all(at % q for q in range(3, int(at**0.5) + 1, 2)):
            found.append(at)
        at -= 2
    return found


def matrix(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scaled entries (rows x dim) of the vectors that count; without ``dim``, row numbers and lengths."""
    offsets = np.asarray(col.offsets, np.int64)
    flat = col.values.slice(offsets[0], offsets[-1] - offsets[0])
    size = np.diff(offsets)
    entries = np.nan_to_num(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf, neginf=np.inf)  # nulls are nan
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))[offsets - offsets[0]]
    good = (np.diff(bad) == 0) & col.is_valid().to_numpy(zero_copy_only=False)
    if dim is None:
        rows = np.flatnonzero(good)
        return rows, size[rows]
    rows = np.flatnonzero(good & (size == dim))
    x = entries[(offsets[rows] - offsets[0])[:, None] + np.arange(dim)]
    return rows, np.floor(np.clip(x, -LARGEST, LARGEST) * SCALE).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Scatter:
    """n, S and the sum of x x' in whole numbers (object arrays)."""

    n: int
    sums: np.ndarray
    products: np.ndarray

    def covariance(self) -> np.ndarray:
        """(n * products - S S') / n^2, each entry the double nearest to the exact one."""
        exact = self.n * self.products - np.outer(self.sums, self.sums)
        return np.array([[int(v) / (self.n * self.n) for v in row] for row in exact], float)


def scatter(vectors: DataFrame, dim: int, rows: int, widest: int) -> Scatter:
    """The exact scatter of a column ``v`` of vectors; |entries| are ``widest`` at most, ``rows`` bounds their number."""
    bound, moduli, product = 2 * rows * widest * widest + 1, [], 1
    while product < bound:
        moduli = primes(len(moduli) + 1)
        product = int(np.prod(np.array(moduli, object)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), dim + 1, dim), np.int64)  # the last row holds the sums

        def add(x: np.ndarray) -> None:
            for k, p in enumerate(moduli):
                r = x % p
                f = r.astype(np.float64)
                total[k, :dim] = (total[k, :dim] + (f.T @ f).astype(np.int64)) % p
                total[k, dim] = (total[k, dim] + r.sum(0)) % p

        seen = False
        for b in batches:
            _, x = matrix(b.column(0), dim)
            for lo in range(0, len(x), BLOCK_ROWS):
                seen = True
                add(x[lo : lo + BLOCK_ROWS])
        if seen:
            for k in range(len(moduli)):
                yield _packed([k] * (dim + 1), list(range(dim + 1)), total[k])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            values = b.column(2).flatten().to_numpy().reshape(-1, dim)
            for key, row in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), values, strict=True):
                held[key] = (held.get(key, 0) + row) % moduli[key[0]]
        if held:
            yield _packed([k for k, _ in held], [i for _, i in held], np.stack(list(held.values())))

    kinds = "k int, i int, residues array<long>"
    found = vectors.select("v").mapInArrow(part, kinds).repartition("k", "i").mapInArrow(joined, kinds).collect()  # a matrix for each prime
    residues = np.zeros((len(moduli), dim + 1, dim), object)
    for r in found:
        residues[r["k"], r["i"]] = r["residues"]
    whole = np.zeros((dim + 1, dim), object)
    for k, p in enumerate(moduli):
        rest = product // p
        whole = whole + residues[k] * (rest * pow(rest, -1, p))
    whole = whole % product
    whole = np.where(whole > product // 2, whole - product, whole)  # sums may be negative
    return Scatter(rows, whole[dim], whole[:dim])


def _packed(k: list[int], i: list[int], rows: np.ndarray) -> pa.RecordBatch:
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel(), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), flat], ["k", "i", "residues"])


def components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, solved again in its own eigenbasis."""
    _, q = np.linalg.eigh(v)
    e, r = np.linalg.eigh(q.T @ v @ q)
    q = q @ r
    order = np.argsort(-e, kind="stable")[:count]
    q = q[:, order]
    return e[order], q / np.sqrt((q * q).sum(0))


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each kept row's largest ``count`` components."""
    spark = embeddings.sparkSession
    arrow_batches(spark)
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[int]] = {}
        for b in batches:
            r, sizes = matrix(b.column(0))
            for dim in np.unique(sizes):
                _, x = matrix(b.column(0).take(pa.array(r[sizes == dim])), int(dim))
                mine = found.setdefault(int(dim), [0, 0])
                mine[0] += len(x)
                mine[1] = max(mine[1], int(np.abs(x).max(initial=0)))
        yield pa.RecordBatch.from_pydict({"dim": list(found), "n": [x[0] for x in found.values()], "widest": [x[1] for x in found.values()]}, pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("widest", pa.int64())]))

    sizes = rows.select("v").mapInArrow(seen, "dim int, n long, widest long").groupBy("dim").agg(F.sum("n").alias("n"), F.max("widest").alias("widest"))
    most = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None or not most["dim"]:
        return spark.createDataFrame([], kinds)
    dim, n = most["dim"], most["n"]
    exact = scatter(rows, dim, n, most["widest"])
    v = exact.covariance()
    e, q = components(v, min(count, dim))
    trace = float(np.trace(v))
    told = e > max(float(e[0]), 0.0) * dim * np.finfo(float).eps
    k = len(e)
    share = [float(x) / trace if trace > 0 else None for x in e]
    sums = exact.sums.copy()
    fits = 2 * n * most["widest"] < 1 << 62
    short = np.array(sums.tolist(), np.int64) if fits else None
    deep = q[:, told] / np.sqrt(e[told])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, x = matrix(b.column(1), dim)
            y = n * x - short if fits else n * x.astype(object) - sums
            if fits and len(y) and dim * int(np.abs(y).max()) ** 2 < 1 << 63:
                deviation = (y * y).sum(1).tolist()
            else:
                deviation = [s if (s := sum(int(a) * int(a) for a in row)) < 1 << 63 else None for row in y]
            w = (y / n).astype(np.float64) @ deep
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(w.shape[1], 1)) if w.shape[1] else np.zeros(len(w) + 1, int), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(deviation, pa.int64()), flat], ["vec_id", "deviation", "w"])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = int(told.sum())
        total = np.zeros((m + 1, m))
        for b in batches:
            w = b.column(0).flatten().to_numpy().reshape(-1, m)
            total[:m] += w.T @ w
            total[m] += w.sum(0)
        yield pa.RecordBatch.from_pydict({"i": list(range(total.size)), "value": total.ravel()}, pa.schema([("i", pa.int32()), ("value", pa.float64())]))

    written = Stage(spark, "whitening").write(rows.mapInArrow(project, "vec_id long, deviation long, w array<double>"), "rows")
    error = None
    if told.any():
        got = written.select("w").mapInArrow(moments, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()  # count^2 values
        total = np.array([r["value"] for r in sorted(got, key=lambda r: r["i"])]).reshape(-1, int(told.sum())) / n
        error = float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(total) - 1)).max())
    place = np.where(told, np.cumsum(told) - 1, k)  # of a component in w
    shares = F.array(*[F.lit(s).cast("double") for s in share])
    at = F.array(*[F.lit(int(p)) for p in place])
    out = written.withColumn("component", F.explode(F.sequence(F.lit(1), F.lit(k))))
    pick = F.get("w", F.get(at, F.col("component") - 1))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", pick.alias("whitened"), F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
