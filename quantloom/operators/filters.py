"""Predicates between signals and trials, and filters before and after evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENERIC = 10


def off(x: Column) -> Column:
    """A filter is off where it is null or negative."""
    return x.isNull() | (x < 0)


def variant_passes(trial: Column, signal: Column) -> Column:
    return off(trial) | off(signal) | (trial == signal)


def value_passes(direction: Column, value: Column, buy_value: Column, sell_value: Column) -> Column:
    """Exact equality with the trial's value for the direction; off passes."""
    wanted = F.when(direction > 0, buy_value).otherwise(sell_value)
    return off(wanted) | value.isNull() | (wanted == value)


def generic_passes(signal: str = "s.", trial: str = "t.", count: int = GENERIC) -> Column:
    one = [off(F.col(f"{trial}sig_filter_{i}")) | off(F.col(f"{signal}sig_filter_{i}")) | (F.col(f"{trial}sig_filter_{i}") == F.col(f"{signal}sig_filter_{i}")) for i in range(count)]
    return reduce(lambda a, b: a & b, one)


def time_passes(day: Column, hour: Column, mask: Column, start: Column, end: Column) -> Column:
    """Day in the bit mask (Monday is bit 0), hour in the inclusive range, which may wrap around midnight."""
    in_range = F.when(start <= end, (hour >= start) & (hour <= end)).otherwise((hour >= start) | (hour <= end))
    return (F.getbit(mask.cast("long"), day.cast("int")) == 1) & in_range


def spread_passes(spread: Column, most: Column) -> Column:
    """Spread known and at most ``most``; off if that is null or not positive."""
    return F.coalesce(most <= 0, F.lit(True)) | F.coalesce(~F.isnan(spread) & (spread <= most), F.lit(False))


def day_mask(days: Column) -> Column:
    """Bit mask of an array of weekdays."""
    return F.aggregate(days, F.lit(0), lambda acc, d: acc.bitwiseOR(F.pow(F.lit(2.0), d).cast("int")))


def slice_window(signals: DataFrame, windows: DataFrame) -> DataFrame:
    """Signals of each window (window_id, start_bar, end_bar), bar_idx rebased to its start."""
    joined = signals.join(windows, (signals["bar_idx"] >= windows["start_bar"]) & (signals["bar_idx"] < windows["end_bar"]))
    return joined.withColumn("window_bar", F.col("bar_idx") - F.col("start_bar"))


def on_kept_bars(signals: DataFrame, kept: DataFrame) -> DataFrame:
    """Signals whose bar is among the kept ones, in either direction."""
    return signals.join(kept.select("pair", "bar_idx").distinct(), ["pair", "bar_idx"], "left_semi")


def valid_params(trials: DataFrame) -> DataFrame:
    """Without the trials whose breakeven offset reaches their trigger."""
    return trials.where(~(F.col("be_enabled") & (F.col("be_offset") >= F.col("be_trigger"))))


def min_trades(years: Column) -> Column:
    return F.greatest(F.lit(200), F.floor(30 * years))


def passing(results: DataFrame, years: Column | float, max_dd: float = 30.0, min_r2: float = 0.5) -> DataFrame:
    years = years if isinstance(years, Column) else F.lit(years)
    return results.where((F.col("trades") >= min_trades(years)) & (F.col("max_dd_pct") <= max_dd) & (F.col("r_squared") >= min_r2))
