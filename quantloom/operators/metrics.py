"""Ten metrics of an ordered sequence of trade results, and statistics around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("trades", "win_rate", "profit_factor", "sharpe", "sortino", "max_dd_pct", "return_pct", "r_squared", "ulcer", "quality")


def equity(pnl: DataFrame, keys: Sequence[str], order: Sequence[str], col: str = "pnl") -> DataFrame:
    """Adds seq (1-based), eq (running sum), peak (running maximum, from 0) and dd (peak - eq)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = pnl.withColumns({"seq": F.row_number().over(w), "eq": F.sum(col).over(run)})
    return out.withColumn("peak", F.greatest(F.lit(0.0), F.max("eq").over(run))).withColumn("dd", F.col("peak") - F.col("eq"))


def metrics(
    pnl: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    annual: Column | float = 252.0,
    col: str = "pnl",
    sl_pips: str | None = None,
    n_bars: str | None = None,
    bars_per_year: float = 6048.0,
) -> DataFrame:
    """The ten metrics per key; ``annual`` is the number of trades a year (a number, or an expression over ``n``).

    With ``n_bars``, a column that holds the length of the key's series, it is n * bars_per_year / n_bars.
    Drawdown is held against the largest equity ever reached, in absolute terms.  Order
    matters for drawdown, R squared and Ulcer index.  One shuffle by key serves the window and the
    aggregation.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = equity(pnl, keys, order, col).withColumn("base", F.greatest(F.abs("eq"), "peak"))
    rows = rows.withColumn("run_base", F.max("base").over(w))
    x = F.col(col)
    aggs = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.when(x > 0, 1.0).otherwise(0.0)).alias("wins"),
        F.sum(F.when(x > 0, x).otherwise(0.0)).alias("gain"),
        F.sum(F.when(x < 0, -x).otherwise(0.0)).alias("loss"),
        F.sum(x).alias("total"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.sum(F.when(x < 0, x * x)).alias("down2"),
        F.sum(F.when(x < 0, 1.0).otherwise(0.0)).alias("downs"),
        F.max("dd").alias("dd"),
        F.max("base").alias("base"),
        F.regr_r2(F.col("eq"), F.col("seq").cast("double")).alias("r2"),
        F.sum(F.pow(100 * F.col("dd") / F.when(F.col("run_base") > 0, F.col("run_base")).otherwise(1.0), F.lit(2.0))).alias("pct2"),
        (F.lit(30.0) if sl_pips is None else F.coalesce(F.avg(sl_pips), F.lit(30.0))).alias("sl"),
        (F.lit(None).cast("double") if n_bars is None else F.max(n_bars)).alias("n_bars"),
    )
    if n_bars is not None:
        annual = F.col("n") * bars_per_year / F.col("n_bars")
    root = F.sqrt(annual if isinstance(annual, Column) else F.lit(float(annual)))
    base = F.col("base")
    out = aggs.select(
        *keys,
        F.col("n").alias("trades"),
        (F.col("wins") / F.col("n")).alias("win_rate"),
        F.when(F.col("loss") > 0, F.col("gain") / F.col("loss")).when(F.col("gain") > 0, 10.0).otherwise(0.0).alias("profit_factor"),
        F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("mean") / F.col("sd") * root).otherwise(0.0).alias("sharpe"),
        F.when(F.col("downs") == 0, F.when(F.col("mean") > 0, 10.0).otherwise(0.0)).otherwise(F.col("mean") / F.sqrt(F.col("down2") / F.col("downs")) * root).alias("sortino"),
        (100 * F.col("dd") / F.when(base > 0, base).otherwise(1.0)).alias("max_dd_pct"),
        (F.when(F.col("sl") > 0, F.col("total") / F.col("sl")).otherwise(0.0) * 100).alias("return_pct"),
        F.greatest(F.coalesce("r2", F.lit(0.0)), F.lit(0.0)).alias("r_squared"),
        F.sqrt(F.col("pct2") / F.col("n")).alias("ulcer"),
    )
    return out.withColumn("quality", quality())


def quality() -> Column:
    """The score that the search maximises, from the other metrics."""
    c = F.col
    up = F.log1p("sortino") * c("r_squared") * F.least("profit_factor", F.lit(5.0)) * (F.least(c("trades"), F.lit(300)) / 300 * 14.14) * (1 + F.least(F.greatest("return_pct", F.lit(0.0)), F.lit(200.0)) / 100)
    return F.when(c("sortino") > 0, up / (c("ulcer") + c("max_dd_pct") / 2 + 5)).otherwise(0.0)


def with_empty(found: DataFrame, every: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zero metrics for the keys that have no trade."""
    return every.select(*keys).distinct().join(found, list(keys), "left").na.fill(0, list(METRICS))


def trade_statistics(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, means and spread of results per key."""
    x = F.col("pnl")
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.avg(x), 4).alias("mean"),
        F.round(F.percentile(x, F.lit(0.5)), 4).alias("median"),
        F.round(F.stddev_pop(x), 4).alias("sd"),
        F.round(F.max(x), 4).alias("best"),
        F.round(F.min(x), 4).alias("worst"),
        F.round(F.avg(F.when(x > 0, x)), 4).alias("mean_win"),
        F.round(F.avg(F.when(x <= 0, x)), 4).alias("mean_loss"),
    )


def breakdown(trades: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Count, share, win rate and total per key and value of a column (exit reason, direction)."""
    x = F.col("pnl")
    out = trades.groupBy(*keys, by).agg(F.count("*").alias("n"), F.round(F.sum(x), 4).alias("total"), F.round(F.avg(F.when(x > 0, 1.0).otherwise(0.0)), 4).alias("win_rate"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 4))


def equity_curve(trades: DataFrame, keys: Sequence[str], order: Sequence[str] = ("exit_bar", "seq")) -> DataFrame:
    """Points (step, equity) with a first one at 0, two digits."""
    run = Window.partitionBy(*keys).orderBy(*order)
    out = trades.select(*keys, F.row_number().over(run).cast("long").alias("step"), F.round(F.sum("pnl").over(run.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("equity"))
    return out.unionByName(trades.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("step"), F.lit(0.0).alias("equity")))


def rank_by_quality(rows: DataFrame, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """rank 0 is the best quality; ties by ``tie``."""
    return rows.withColumn("rank", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("quality"), tie)) - 1).cast("long"))
