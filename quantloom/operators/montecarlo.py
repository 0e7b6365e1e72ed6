"""Resampling tests of trade results, with randomness from integer hashes so that any engine repeats them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from quantloom.functions.workers import sent_whole
from quantloom.operators.metrics import metrics
from quantloom.operators.search import deflated_sharpe

sent_whole(__name__)

MODULUS = 2_147_483_647


def pseudo(*ids: Column) -> Column:
    """A number of 0..MODULUS-1 from ids by two rounds of a linear congruential step each."""
    x = F.lit(12_345).cast("long")
    for i in ids:
        x = (x * 48_271 + i.cast("long") * 69_621 + 11) % MODULUS
        x = (x * 16_807 + 7) % MODULUS
    return x


RANGE = 1 << 20  # results whose blocks one task holds
DRAWS = 1 << 16  # draws at a time


def _state(state: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A step of ``pseudo`` for arrays of the states before and of ids."""
    return ((state * 48_271 + (ids * 69_621 + 11)) % MODULUS * 16_807 + 7) % MODULUS


def _block_sums(rows: pa.Table, keys: tuple[str, ...], iterations: int, block: int) -> pa.Table:
    """What the blocks that begin in one range of a key add to each resample: iter, number, sum and sum of squares."""
    low, n = rows["_range"][0].as_py() * RANGE, rows["_n"][0].as_py()
    size = min(RANGE, n - low)
    seen = rows["pnl"].is_valid().to_numpy()
    at = rows["seq"].to_numpy()[seen] - low
    value = rows["pnl"].cast(pa.float64()).to_numpy()[seen]
    sums = []
    for x in (np.ones(len(value)), value, value * value):
        one = np.zeros(size + block - 1)
        one[at] = x
        starts = np.zeros(size + 1)  # the last one is for blocks that begin elsewhere
        for k in range(block):
            starts[:size] += one[k : k + size]
        sums.append(starts)
    out = np.zeros((3, iterations))
    states = _state(np.int64(12_345), np.arange(iterations, dtype=np.int64))
    draws = -(-n // block)
    for first in range(0, draws, DRAWS):
        ids = np.arange(first, min(first + DRAWS, draws), dtype=np.int64)
        step = max(1, DRAWS // len(ids))
        for i in range(0, iterations, step):
            start = _state(states[i : i + step, None], ids) % n - low
            if size < n:
                start[(start < 0) | (start >= size)] = size
            for total, x in zip(out, sums, strict=True):
                total[i : i + step] += x[start].sum(axis=1)
    made = {k: pa.array([rows[k][0].as_py()] * iterations, rows.schema.field(k).type) for k in keys}
    return pa.table(made | {"iter": pa.array(range(iterations), pa.int32()), "n": out[0], "s1": out[1], "s2": out[2]})


def block_bootstrap(pnl: DataFrame, iterations: int = 1000, block: int = 10, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Per key: Sharpe per trade of each resample of whole blocks, as mean and 5, 50, 95 % points.

    ``seq`` counts from 0.  Blocks are cut short at the end of the series, so a sample can be shorter than it; null
    results stay out.  A task holds what a block adds for each place of a range where it may begin, makes the draws of the
    key anew, and adds up those that fall into its range; so no draw is ever a row.
    """
    n = pnl.groupBy(*keys).agg(F.count("*").alias("_n"))  # a row for each key
    ranges = F.sequence(F.floor(F.greatest(F.col("seq") - (block - 1), F.lit(0)) / RANGE), F.floor(F.col("seq") / RANGE))
    rows = pnl.join(n, list(keys)).where("seq >= 0 and seq < _n").select(*keys, F.col("seq").cast("long").alias("seq"), "pnl", "_n", F.explode(ranges).alias("_range"))
    schema = StructType([pnl.schema[k] for k in keys]).add("iter", "integer").add("n", "double").add("s1", "double").add("s2", "double")
    made = rows.groupBy(*keys, "_range").applyInArrow(lambda t: _block_sums(t, keys, iterations, block), schema)
    per = made.groupBy(*keys, "iter").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    variance = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1)
    per = per.withColumn("sharpe", F.when((F.col("n") > 1) & (variance > 0), F.col("s1") / F.col("n") / F.sqrt(variance)).otherwise(0.0))
    return per.groupBy(*keys).agg(F.avg("sharpe").alias("mean"), *(F.percentile("sharpe", F.lit(p)).alias(f"p{int(100 * p):02d}") for p in (0.05, 0.5, 0.95)))


BITS = 30  # of a pseudo-random number: the signs of as many iterations


def sign_flip(pnl: DataFrame, iterations: int = 1000, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Share of sign-flipped resamples whose mean reaches the observed one.

    One number for a result and 30 iterations has a bit for each; the totals of 30 iterations are columns of one row.
    """
    rows = pnl.select(*keys, "seq", "pnl", F.explode(F.sequence(F.lit(0), F.lit(-(-iterations // BITS) - 1))).alias("_set"))
    rows = rows.withColumn("_h", pseudo(F.col("_set"), F.col("seq")))
    sign = lambda b: 1.0 - 2.0 * F.shiftright("_h", b).bitwiseAND(F.lit(1))
    per = rows.groupBy(*keys, "_set").agg(F.array(*[F.round(F.sum(F.col("pnl") * sign(b)), 4) for b in range(BITS)]).alias("_totals"))
    per = per.select(*keys, "_set", F.posexplode("_totals").alias("_b", "total")).where(F.col("_set") * BITS + F.col("_b") < iterations)
    seen = pnl.groupBy(*keys).agg(F.round(F.sum("pnl"), 4).alias("observed"))
    return per.join(seen, list(keys)).groupBy(*keys).agg(F.avg(F.when(F.col("total") >= F.col("observed"), 1.0).otherwise(0.0)).alias("p_value"))


def trade_skip(pnl: DataFrame, share: float = 0.05, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The results kept when a share of the trades is skipped by hash; order stays."""
    w = Window.partitionBy(*keys).orderBy(pseudo(F.col("seq"), F.lit(1)), "seq")
    n = F.count("*").over(Window.partitionBy(*keys))
    return pnl.withColumns({"_r": F.row_number().over(w), "_n": n}).where(F.col("_r") <= F.col("_n") - F.floor(F.col("_n") * F.lit(share))).drop("_r", "_n")


def skip_quality(pnl: DataFrame, keys: list[str], order: list[str], share: float = 0.05) -> DataFrame:
    """Quality per key of the results that are left when a share of the trades is skipped."""
    return metrics(trade_skip(pnl, share, tuple(keys)), keys, order).select(*keys, "quality")


def record(pnl: DataFrame, keys: list[str], order: list[str], trials: int, iterations: int = 1000, block: int = 10, skips: tuple[float, ...] = (0.05, 0.1), dsr_gate: float = 0.95, p_gate: float = 0.05) -> DataFrame:
    """Per key the whole Monte Carlo record and whether it passes.

    observed_sharpe (per trade), bootstrap mean and points, p_value of the sign flips, quality_skip_<percent>,
    stress_quality and its ratio to the quality (0 without quality), dsr for the number of trials, passed.
    """
    plain = metrics(pnl, keys, order, annual=1.0).select(*keys, F.col("sharpe").alias("observed_sharpe"), F.col("trades").alias("n"))
    out = plain.join(metrics(pnl, keys, order).select(*keys, F.col("quality").alias("_quality")), keys)
    boot = block_bootstrap(pnl, iterations, block, tuple(keys)).withColumnsRenamed({c: f"bootstrap_{c}" for c in ("mean", "p05", "p50", "p95")})
    out = out.join(boot, keys).join(sign_flip(pnl, iterations, tuple(keys)), keys)
    for share in skips:
        out = out.join(skip_quality(pnl, keys, order, share).withColumnRenamed("quality", f"quality_skip_{round(100 * share)}"), keys)
    out = out.join(metrics(cost_stress(pnl), keys, order).select(*keys, F.col("quality").alias("stress_quality")), keys)
    out = out.withColumn("stress_ratio", F.when(F.col("_quality") > 0, F.col("stress_quality") / F.col("_quality")).otherwise(0.0)).drop("_quality")
    out = out.withColumn("dsr", deflated_sharpe(F.col("observed_sharpe"), F.col("n"), F.lit(trials)))
    return out.withColumn("passed", (F.col("dsr") >= dsr_gate) & (F.col("p_value") <= p_gate))


def cost_stress(pnl: DataFrame, slippage: float = 0.5, commission: float = 0.7, slip_factor: float = 1.5, comm_factor: float = 1.3) -> DataFrame:
    """pnl less the extra cost of worse execution."""
    return pnl.withColumn("pnl", F.col("pnl") - slippage * (slip_factor - 1) - commission * (comm_factor - 1))
