"""Data quality of bar tables: gaps, empty cells, anomalies, coverage, score and gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.bars import KEYS, TIMEFRAMES, seconds

#: Range anomalies: a bar's range beyond so many medians.
RANGE_FACTOR = {"M1": 50, "M5": 20}
SPARSE_ROWS = 130_000


def _weekend(start: Column, end: Column) -> Column:
    day, hour = lambda t: F.weekday(t), lambda t: F.hour(t)
    days = F.floor((seconds(end) - seconds(start)) / 86400)
    to_saturday = F.pmod(5 - day(start), F.lit(7))
    return (
        ((day(start) == 4) & (hour(start) >= 20))
        | (day(start) == 5)
        | (day(start) == 6)
        | ((day(end) == 0) & (hour(end) <= 1))
        | ((days >= 2) & (F.datediff(end, start) >= to_saturday))
    )


def _holiday(start: Column, end: Column) -> Column:
    christmas = lambda t: (F.month(t) == 12) & F.dayofmonth(t).between(24, 26)
    return christmas(start) | christmas(end) | ((F.month(start) == 12) & (F.dayofmonth(start) == 31)) | ((F.month(end) == 1) & (F.dayofmonth(end) <= 2))


def gaps(bars: DataFrame, timeframe: str, factor: float = 3.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Steps longer than ``factor`` times the expected one: start_s, end_s, kind (weekend, holiday, unexpected)."""
    w = Window.partitionBy(*keys).orderBy("ts")
    steps = bars.select(*keys, F.lag("ts").over(w).alias("start"), F.col("ts").alias("end")).where("start is not null")
    wide = steps.where(seconds("end") - seconds("start") > factor * TIMEFRAMES[timeframe])
    kind = F.when(_weekend(F.col("start"), F.col("end")), "weekend").when(_holiday(F.col("start"), F.col("end")), "holiday").otherwise("unexpected")
    return wide.select(*keys, seconds("start").alias("start_s"), seconds("end").alias("end_s"), kind.alias("kind"))


def gap_details(found: DataFrame, first: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first unexpected gaps of each key."""
    w = Window.partitionBy(*keys).orderBy("start_s")
    return found.where("kind = 'unexpected'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)


def cells(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Zero and missing price cells, and their shares in per cent (4 digits)."""
    prices = ["open", "high", "low", "close"]
    zero = sum((F.when(F.col(c) == 0, 1).otherwise(0) for c in prices), F.lit(0))
    none = sum((F.when(F.col(c).isNull() | F.isnan(c), 1).otherwise(0) for c in prices), F.lit(0))
    out = bars.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(zero).alias("zeros"), F.sum(none).alias("missing"))
    for c in ("zeros", "missing"):
        out = out.withColumn(f"{c}_pct", F.round(100.0 * F.col(c) / (4 * F.col("n_rows")), 4))
    return out


def anomalies(bars: DataFrame, timeframe: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars of extreme range, of no range, and with high below low."""
    factor = RANGE_FACTOR.get(timeframe, 10)
    median = bars.groupBy(*keys).agg(F.percentile(F.col("high") - F.col("low"), F.lit(0.5)).alias("median"))
    span = F.col("high") - F.col("low")
    return bars.join(median, list(keys)).groupBy(*keys).agg(
        F.sum(F.when((F.col("median") > 0) & (span > factor * F.col("median")), 1).otherwise(0)).alias("extreme"),
        F.sum(F.when(span == 0, 1).otherwise(0)).alias("flat"),
        F.sum(F.when(F.col("high") < F.col("low"), 1).otherwise(0)).alias("violations"),
    )


def yearly_coverage(bars: DataFrame, expected_from: int, sparse: int = SPARSE_ROWS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of each year from the expected one to the last with data, as missing, sparse or good."""
    counts = bars.groupBy(*keys, F.year("ts").alias("year")).agg(F.count("*").alias("n_rows"))
    years = counts.groupBy(*keys).agg(F.max("year").alias("last")).select(*keys, F.explode(F.sequence(F.least(F.lit(expected_from), "last"), "last")).alias("year"))
    out = years.join(counts, [*keys, "year"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n_rows") == 0, "missing").when(F.col("n_rows") < sparse, "sparse").otherwise("good"))


def usable_from(coverage: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first good year of each key."""
    return coverage.where("status = 'good'").groupBy(*keys).agg(F.min("year").alias("usable_from"))


def quality_score(unexpected: Column, missing_pct: Column, zero_pct: Column, violations: Column, extreme: Column, good_years: Column, expected_years: Column) -> Column:
    """100 less capped penalties, between 0 and 100, one digit."""
    lost = (
        F.least(F.lit(20.0), 0.5 * unexpected)
        + F.least(F.lit(20.0), 5.0 * missing_pct)
        + F.least(F.lit(20.0), 5.0 * zero_pct)
        + F.least(F.lit(20.0), 10.0 * violations)
        + F.least(F.lit(5.0), 0.1 * extreme)
        + F.when(expected_years > 0, 15.0 * (1 - good_years / expected_years)).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - lost)), 1)


def report(bars: DataFrame, timeframe: str, expected_from: int, current_year: int, sparse: int = SPARSE_ROWS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Everything above per key, the score, and the gate (empty, too_few, poor or ok)."""
    kinds = gaps(bars, timeframe, keys=keys).groupBy(*keys).agg(*(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"gaps_{k}") for k in ("weekend", "holiday", "unexpected")))
    good = yearly_coverage(bars, expected_from, sparse, keys).where("status = 'good'").groupBy(*keys).agg(F.count("*").alias("good_years"))
    out = cells(bars, keys).join(anomalies(bars, timeframe, keys), list(keys)).join(kinds, list(keys), "left").join(good, list(keys), "left").na.fill(0)
    expected = F.lit(max(0, current_year - expected_from + 1))
    out = out.withColumn("score", quality_score(F.col("gaps_unexpected"), F.col("missing_pct"), F.col("zeros_pct"), F.col("violations"), F.col("extreme"), F.col("good_years"), expected))
    return out.withColumn("gate", gate(F.col("n_rows"), F.col("score")))


def gate(rows: Column, score: Column, min_rows: int = 5000, min_score: float = 50.0) -> Column:
    return F.when(rows == 0, "empty").when(rows < min_rows, "too_few").when(score < min_score, "poor").otherwise("ok")
