"""Bars: consolidation, resampling, spreads, sub-bar mapping, splits and freshness.

A bar table has pair, ts (timestamp without zone, UTC), open, high, low, close, volume
and spread (price units, null where there is no ask).  Everything is partitioned by
``keys`` and ordered by ``ts``; positions are 0-based ``bar_idx``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("pair",)
#: Seconds of each timeframe; W is the week from Tuesday to Monday, labelled by its Monday.
TIMEFRAMES = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D": 86400, "W": 7 * 86400}
#: Bars a year by timeframe.
BARS_PER_YEAR = {"M1": 362_880, "M5": 72_576, "M15": 24_192, "M30": 12_096, "H1": 6_048, "H4": 1_512, "D": 252, "W": 52}
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.expr(EPOCH), ts.cast("timestamp_ntz"))


def at_second(s: Column) -> Column:
    return F.timestamp_add("SECOND", s, F.expr(EPOCH))


def bucket(ts: str | Column, timeframe: str) -> Column:
    """Start of the timeframe's bucket in seconds; for W the Monday that ends it."""
    s = seconds(ts)
    if timeframe == "W":
        day = F.floor(s / 86400) - 1  # Tuesday becomes Monday
        return (day - F.pmod(day + 3, F.lit(7)) + 7) * 86400
    size = TIMEFRAMES[timeframe]
    return s - F.pmod(s, F.lit(size))


def with_bar_idx(bars: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",)) -> DataFrame:
    return bars.withColumn("bar_idx", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def ticks_to_bars(ticks: DataFrame, timeframe: str = "H1", price: str = "price", keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",), spread: Column | None = None) -> DataFrame:
    """Bars of single prices: first, highest, lowest, last, and the number of ticks as volume."""
    at = F.struct(*order)
    out = ticks.withColumn("bucket", bucket("ts", timeframe)).groupBy(*keys, "bucket").agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.count("*").cast("double").alias("volume"),
        (F.lit(None).cast("double") if spread is None else spread).alias("spread"),
    )
    return out.withColumn("ts", at_second(F.col("bucket"))).drop("bucket")


def resample(bars: DataFrame, timeframe: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close (nulls skipped), summed volume, median spread; buckets without a close go."""
    present = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))
    at = lambda c: F.when(present(c).isNotNull(), F.col("ts"))
    aggs = [
        F.min_by(present("open"), at("open")).alias("open"),
        F.max(present("high")).alias("high"),
        F.min(present("low")).alias("low"),
        F.max_by(present("close"), at("close")).alias("close"),
        F.sum(present("volume")).alias("volume"),
    ]
    if "spread" in bars.columns:
        aggs.append(F.percentile(present("spread"), F.lit(0.5)).alias("spread"))
    out = bars.withColumn("bucket", bucket("ts", timeframe)).groupBy(*keys, "bucket").agg(*aggs)
    return out.where("close is not null").withColumn("ts", at_second(F.col("bucket"))).drop("bucket")


def resample_all(bars: DataFrame, timeframes: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Several timeframes as one table with a column ``tf``; unknown names raise."""
    if unknown := [t for t in timeframes if t not in TIMEFRAMES]:
        raise ValueError(f"unknown timeframes {unknown}")
    out = None
    for t in timeframes:
        part = resample(bars, t, keys).withColumn("tf", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


def join_ask(bid: DataFrame, ask: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bid bars with the spread to the ask bar of the same time, averaged over open and close; null where there is none."""
    other = ask.select(*keys, "ts", F.col("open").alias("_ask_open"), F.col("close").alias("_ask_close"))
    spread = ((F.col("_ask_open") - F.col("open")) + (F.col("_ask_close") - F.col("close"))) / 2
    return bid.drop("spread").join(other, [*keys, "ts"], "left").withColumn("spread", spread).drop("_ask_open", "_ask_close")


def ask_coverage(joined: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars, share with a spread in per cent, and median spread."""
    return joined.groupBy(*keys).agg(F.count("*").alias("bars"), (100.0 * F.count("spread") / F.count("*")).alias("coverage_pct"), F.percentile("spread", F.lit(0.5)).alias("median_spread"))


def consolidate(chunks: DataFrame, chunk_col: str = "chunk", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per time: that of the first chunk by name."""
    w = Window.partitionBy(*keys, "ts").orderBy(chunk_col)
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", chunk_col)


def map_sub_bars(parents: DataFrame, subs: DataFrame, tail_seconds: int | None = 3600, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sub-bars with the position of their parent: the last one that starts at or before them.

    A gap belongs to the parent before it; the last parent takes ``tail_seconds``.
    Sub-bars before the first parent or past the tail go.  One sort per key, no range join.
    """
    marks = parents.select(*keys, "ts", F.col("bar_idx").alias("_p"), F.lit(0).alias("_sub"))
    rows = subs.drop("bar_idx").withColumns({"_p": F.lit(None).cast("long"), "_sub": F.lit(1)})
    w = Window.partitionBy(*keys).orderBy("ts", "_sub").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumns({"bar_idx": F.last("_p", ignorenulls=True).over(w), "_from": F.last(F.when(F.col("_sub") == 0, F.col("ts")), ignorenulls=True).over(w)})
    last = parents.groupBy(*keys).agg(F.max("ts").alias("_last"))
    out = both.where("_sub = 1 and bar_idx is not null").join(last, list(keys))
    if tail_seconds is not None:
        out = out.where((F.col("_from") < F.col("_last")) | (seconds("ts") < seconds("_last") + tail_seconds))
    return out.drop("_p", "_sub", "_from", "_last")


def sub_bar_ranges(parents: DataFrame, subs: DataFrame, tail_seconds: int | None = 3600, keys: Sequence[str] = KEYS) -> DataFrame:
    """Half-open range of sub-bar positions of each parent; empty ranges start where the next begins."""
    numbered = subs.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1)
    inside = map_sub_bars(parents, numbered, tail_seconds, keys).groupBy(*keys, "bar_idx").agg(F.min("_i").alias("a"), (F.max("_i") + 1).alias("b"))
    w = Window.partitionBy(*keys).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = parents.select(*keys, "bar_idx").join(inside, [*keys, "bar_idx"], "left")
    floor = F.coalesce(F.max("b").over(w), F.lit(0))
    return out.select(*keys, "bar_idx", F.coalesce("a", floor).cast("long").alias("sub_start"), F.coalesce("b", floor).cast("long").alias("sub_end"))


def split_back_forward(bars: DataFrame, share: float = 0.8, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars with part = back for the first int(n * share) positions, else forward."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return bars.withColumn("part", F.when(F.col("bar_idx") < F.floor(n * F.lit(share)), "back").otherwise("forward"))


def split_holdout(bars: DataFrame, months: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars with part = train before the last time less so many calendar months, else holdout."""
    last = F.max("ts").over(Window.partitionBy(*keys))
    return bars.withColumn("part", F.when(F.col("ts") < last - F.make_ym_interval(F.lit(0), F.lit(months)), "train").otherwise("holdout"))


def split(bars: DataFrame, mode: str, **options) -> DataFrame:
    modes = {"backforward": split_back_forward, "holdout": split_holdout}
    if mode not in modes:
        raise ValueError(f"unknown split mode {mode!r}; known: {sorted(modes)}")
    return modes[mode](bars, **options)


def freshness(bars: DataFrame, now_seconds: int, max_age_hours: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last time of each key and whether it is older than ``max_age_hours``."""
    last = bars.groupBy(*keys).agg(seconds(F.max("ts")).alias("last_s"))
    return last.withColumn("stale", F.lit(now_seconds) - F.col("last_s") > max_age_hours * 3600)


def catalogue_status(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, first and last time of each key."""
    return bars.groupBy(*keys).agg(F.count("*").alias("n_rows"), seconds(F.min("ts")).alias("first_s"), seconds(F.max("ts")).alias("last_s"))


def missing_years(wanted: DataFrame, existing: DataFrame, current_year: int, force: bool = False) -> DataFrame:
    """(pair, year) to fetch: those not there, the current year always, all of them with ``force``."""
    if force:
        return wanted
    return wanted.join(existing.where(F.col("year") != current_year), ["pair", "year"], "left_anti")


def to_utc(server: Column, zone: str = "EET") -> Column:
    """Server-local wall time as UTC."""
    return F.to_utc_timestamp(server, zone)
