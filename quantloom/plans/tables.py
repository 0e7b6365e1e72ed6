"""Stand-in series over the driver's tables, and the same tables as SQL.

``events`` is the tick stream: event_type is the instrument, value the price; hours are
bars.  ``orders`` gives sequences of trade results per priority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quantloom.operators import bars as B

PIP = 0.01


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("pair"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", F.col("value").alias("price"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, ts, open, high, low, close, volume, spread, bar_idx."""
    spread = 0.01 * (1 + F.max("event_id") % 3)
    return B.with_bar_idx(B.ticks_to_bars(ticks(spark, sf_dir), "H1", order=("ts", "event_id"), spread=spread))


def sub_bars(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """Ticks as sub-bars of the hours: high = low = close, the hour's spread, sub_seq by time."""
    bars = (hourly(spark, sf_dir) if bars is None else bars).select("pair", "bar_idx", "spread", B.seconds("ts").alias("_s"))
    w = Window.partitionBy("pair").orderBy("ts", "event_id")
    t = ticks(spark, sf_dir).withColumns({"sub_seq": F.row_number().over(w).cast("long"), "_s": B.bucket("ts", "H1")})
    return t.join(bars, ["pair", "_s"]).select("pair", "bar_idx", "sub_seq", F.col("price").alias("high"), F.col("price").alias("low"), F.col("price").alias("close"), "spread")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq (0-based), pnl: trade results per order priority in order of date and key."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("seq"), (F.floor(F.col("o_totalprice") / 10) / 100 - 250).alias("pnl"))


TICKS = """ticks AS MATERIALIZED (
  SELECT event_type AS pair, epoch_us(ts) // 1000000 AS sec, ts, event_id, value AS price FROM events)"""
BARS = f"""{TICKS}, bars0 AS (
  SELECT pair, sec - sec % 3600 AS ts_s, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume, 1e-2 * (1 + max(event_id) % 3) AS spread
  FROM ticks GROUP BY ALL), bars AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts_s) - 1 AS bar_idx FROM bars0)"""
SUBS = f"""{BARS}, subs AS MATERIALIZED (
  SELECT t.pair, b.bar_idx, row_number() OVER (PARTITION BY t.pair ORDER BY t.ts, t.event_id) AS sub_seq, price AS high, price AS low, price AS close, b.spread
  FROM ticks t JOIN bars b ON b.pair = t.pair AND b.ts_s = t.sec - t.sec % 3600)"""
RESULTS = """results AS MATERIALIZED (
  SELECT o_orderpriority AS key, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS seq,
         floor(o_totalprice / 10) / 100 - 250 AS pnl FROM orders)"""
BY = "PARTITION BY pair ORDER BY bar_idx"


def rows(period: int) -> str:
    """A frame of the last so many rows."""
    return f"({BY} ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW)"


def smooth(x: str, seed: str, at: int, a: str, weight: str) -> str:
    """x[i] = a x[i-1] + weight * x, from the seed on, in closed form."""
    return f"pow({a}, bar_idx - {at}) * sum(CASE WHEN bar_idx = {at} THEN {seed} WHEN bar_idx > {at} THEN {weight} * {x} * pow({a}, {at} - bar_idx) ELSE 0 END) OVER ({BY})"


def metric_sql(source: str, keys: str, order: str, annual: str = "252", sl: str = "30.0::DOUBLE") -> str:
    """CTEs that end in ``mq``: the ten metrics of ``source`` (pnl) per key."""
    w = f"PARTITION BY {keys} ORDER BY {order}"
    return f"""
  m_eq AS (
    SELECT *, sum(pnl) OVER ({w}) AS m_eq, row_number() OVER ({w}) AS m_x FROM {source}
  ), m_pk AS (
    SELECT *, greatest(0.0, max(m_eq) OVER ({w})) AS m_peak FROM m_eq
  ), m_run AS (
    SELECT *, m_peak - m_eq AS m_dd,
           greatest(max(abs(m_eq)) OVER ({w}), m_peak) AS m_base FROM m_pk
  ), m_agg AS (
    SELECT {keys}, count(*) AS n, count(*) FILTER (pnl > 0) AS wins,
           coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gain, coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS loss,
           sum(pnl) AS total, avg(pnl) AS mean, stddev_samp(pnl) AS sd,
           sqrt(avg(pnl * pnl) FILTER (pnl < 0)) AS down,
           max(m_dd) AS dd, max(m_base) AS base,
           regr_r2(m_eq, m_x) AS r2,
           sqrt(avg(CASE WHEN m_base > 0 THEN pow(100 * m_dd / m_base, 2) ELSE 0 END)) AS ulcer,
           {sl} AS sl, {annual} AS annual
    FROM m_run GROUP BY {keys}
  ), m_out AS (
    SELECT {keys}, n AS trades, wins::DOUBLE / n AS win_rate,
           CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN 10.0 ELSE 0.0 END AS profit_factor,
           CASE WHEN n > 1 AND sd > 0 THEN mean / sd * sqrt(annual) ELSE 0 END AS sharpe,
           CASE WHEN down > 0 THEN mean / down * sqrt(annual) WHEN mean > 0 THEN 10.0 ELSE 0.0 END AS sortino,
           100 * dd / CASE WHEN base > 0 THEN base ELSE 1 END AS max_dd_pct,
           total / sl * 100 AS return_pct, greatest(coalesce(r2, 0), 0) AS r_squared, ulcer
    FROM m_agg
  ), mq AS (
    SELECT *, CASE WHEN sortino > 0 THEN
             ln(1 + sortino) * r_squared * least(profit_factor, 5.0)
             * (least(trades, 300) / 300.0::DOUBLE * 14.14)
             * (1 + least(greatest(return_pct, 0.0), 200.0) / 100)
             / (ulcer + max_dd_pct / 2 + 5)
           ELSE 0 END AS quality
    FROM m_out
  )"""
