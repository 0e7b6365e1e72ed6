"""Checks before an order, its size, and identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pre_trade(max_daily_trades: int = 10, max_daily_loss_pct: float = 3.0, max_drawdown_pct: float = 10.0, max_open: int = 3, max_spread_pips: float = 3.0) -> Column:
    """The first check that fails, in fixed order, or ``ok``: over breaker, daily_trades, daily_pnl, balance, equity, peak_equity, open_positions, same_symbol, spread_pips."""
    c = F.col
    return (
        F.when(c("breaker"), "circuit_breaker")
        .when(c("daily_trades") >= max_daily_trades, "daily_trades")
        .when(c("daily_pnl") <= -c("balance") * max_daily_loss_pct / 100, "daily_loss")
        .when((c("peak_equity") > 0) & ((c("peak_equity") - c("equity")) / c("peak_equity") * 100 >= max_drawdown_pct), "drawdown")
        .when(c("open_positions") >= max_open, "open_positions")
        .when(c("same_symbol") > 0, "same_symbol")
        .when(c("spread_pips") > max_spread_pips, "spread")
        .otherwise("ok")
    )


def position_size(balance: Column, sl_pips: Column, pip_value: Column, risk_pct: float = 1.0, step: float = 0.01, least: float = 0.01, most: float = 100.0) -> Column:
    """Lots that lose ``risk_pct`` of the balance at the stop, in whole steps between the limits."""
    raw = balance * risk_pct / 100 / (sl_pips * pip_value)
    lots = F.round(F.floor(raw / step + 1e-9) * step, 8)
    return F.when((sl_pips <= 0) | (pip_value <= 0), least).otherwise(F.least(F.greatest(lots, F.lit(least)), F.lit(most)))


def magic(name: Column) -> Column:
    """A stable 31-bit identifier: the first eight hexadecimal digits of the MD5, modulo 2^31."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % (1 << 31)


def breaker(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds reason, why the breaker is active after each event, empty where it isn't.

    Events have a kind: ``trip`` (with the reason in ``said``), ``reset``, or ``day``, the change of day, which
    resets a breaker that a daily loss has tripped and no other.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(w)
    value = F.when(F.col("kind") == "trip", F.col("said")).when(F.col("kind") == "reset", "")
    out = events.withColumns({"_n": place, "_value": value})
    out = out.withColumns({"_set": F.max(F.when(F.col("_value").isNotNull(), F.col("_n"))).over(run), "_day": F.max(F.when(F.col("kind") == "day", F.col("_n"))).over(run), "_last": F.last("_value", ignorenulls=True).over(run)})
    over = (F.col("_last") == "daily_loss") & (F.col("_day") > F.col("_set"))
    return out.withColumn("reason", F.when(over, "").otherwise(F.coalesce("_last", F.lit("")))).drop("_n", "_value", "_set", "_day", "_last")


def close_accounting(closed: DataFrame, pip: float, keys: list[str]) -> DataFrame:
    """closed, wins (0 pips count as one), losses and pips per key of closed positions: what is left of each, and what was realised before."""
    pips = F.round(F.col("direction") * (F.col("exit_price") - F.col("entry_price")) / pip * F.col("position_pct") + F.col("realised_pips"), 4)
    return closed.groupBy(*keys).agg(F.count("*").alias("closed"), F.count(F.when(pips >= 0, 1)).alias("wins"), F.count(F.when(pips < 0, 1)).alias("losses"), F.sum(pips).alias("pips"))
