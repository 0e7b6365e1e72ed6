"""Queries on bars and their quality."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quantloom.functions.numeric import tidy
from quantloom.operators import bars as B
from quantloom.operators import quality as Q
from quantloom.plans.registry import register
from quantloom.plans.tables import BARS, hourly, read, ticks

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

_COLS = ("open", "high", "low", "close", "volume")


def _flat(df, *keys):
    return df.select("pair", *keys, B.seconds("ts").alias("ts_s"), *(tidy(F.col(c)).alias(c) for c in (*_COLS, "spread")))


_FLAT = "round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume, round(spread, 6) + 0.0 AS spread"


@query("ag1_bars", f"WITH {BARS} SELECT pair, bar_idx, ts_s, {_FLAT} FROM bars")
def ag1_bars(spark, d):
    return _flat(hourly(spark, d), "bar_idx")


def _resampled(bucket: str) -> str:
    return f"""WITH {BARS}, r AS (SELECT pair, {bucket} AS ts_s, first(open ORDER BY ts_s) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts_s) AS close,
      sum(volume) AS volume, median(spread) AS spread FROM bars GROUP BY pair, {bucket}) SELECT pair, ts_s, {_FLAT} FROM r"""


@query("ag1_resample_h4", _resampled("bars.ts_s - bars.ts_s % 14400"))
def ag1_resample_h4(spark, d):
    return _flat(B.resample(hourly(spark, d), "H4"))


@query("ag2_resample_day", _resampled("bars.ts_s - bars.ts_s % 86400"))
def ag2_resample_day(spark, d):
    return _flat(B.resample(hourly(spark, d), "D"))


_WEEK = "((bars.ts_s // 86400 - 1) - ((bars.ts_s // 86400 - 1) + 3) % 7 + 7) * 86400"


@query("ag2_resample_week", _resampled(_WEEK))
def ag2_resample_week(spark, d):
    return _flat(B.resample(hourly(spark, d), "W"))


@query("ag3_timeframes", f"""WITH {BARS}, s AS (SELECT *, unnest([{{'tf': 'H1', 'n': 3600}}, {{'tf': 'H4', 'n': 14400}}, {{'tf': 'D', 'n': 86400}}]) AS f FROM bars)
  SELECT f.tf AS tf, pair, count(DISTINCT ts_s - ts_s % f.n) AS n_bars, round(sum(volume), 6) + 0.0 AS volume FROM s GROUP BY ALL""")
def ag3_timeframes(spark, d):
    every = B.resample_all(hourly(spark, d), ["H1", "H4", "D"])
    return every.groupBy("tf", "pair").agg(F.count("*").alias("n_bars"), tidy(F.sum("volume")).alias("volume"))


def _sides(spark, d):
    bars = hourly(spark, d)
    bid, ask = (bars.where(F.col("pair") == p).withColumn("pair", F.lit("bid/ask")) for p in ("view", "click"))
    return B.join_ask(bid, ask)


_SIDES = f"""{BARS}, j AS (SELECT b.bar_idx, b.ts_s, ((a.open - b.open) + (a.close - b.close)) / 2 AS spread
  FROM bars b LEFT JOIN (SELECT * FROM bars WHERE pair = 'click') a ON a.ts_s = b.ts_s WHERE b.pair = 'view')"""


@query("j1_join_ask", f"WITH {_SIDES} SELECT ts_s, round(spread, 6) + 0.0 AS spread FROM j")
def j1_join_ask(spark, d):
    return _sides(spark, d).select(B.seconds("ts").alias("ts_s"), tidy(F.col("spread")).alias("spread"))


@query("j1_ask_coverage", f"WITH {_SIDES} SELECT count(*) AS bars, round(100.0 * count(spread) / count(*), 6) + 0.0 AS coverage_pct, round(median(spread), 6) + 0.0 AS median_spread FROM j")
def j1_ask_coverage(spark, d):
    c = B.ask_coverage(_sides(spark, d))
    return c.select("bars", tidy(F.col("coverage_pct")).alias("coverage_pct"), tidy(F.col("median_spread")).alias("median_spread"))


_PARENTS = f"""{BARS}, parents AS (SELECT pair, p AS ts_s, row_number() OVER (PARTITION BY pair ORDER BY p) - 1 AS parent, lead(p) OVER (PARTITION BY pair ORDER BY p) AS next_s
  FROM (SELECT DISTINCT pair, ts_s - ts_s % 14400 AS p FROM bars))"""


def _parents(spark, d):
    return B.with_bar_idx(B.resample(hourly(spark, d), "H4"))


@query("j2_map_sub_bars", f"""WITH {_PARENTS} SELECT b.pair, b.ts_s, p.parent FROM bars b JOIN parents p ON p.pair = b.pair AND b.ts_s >= p.ts_s AND b.ts_s < coalesce(p.next_s, p.ts_s + 3600)""")
def j2_map_sub_bars(spark, d):
    return B.map_sub_bars(_parents(spark, d), hourly(spark, d)).select("pair", B.seconds("ts").alias("ts_s"), F.col("bar_idx").alias("parent"))


@query("j2_sub_bar_ranges", f"""WITH {_PARENTS}, m AS (SELECT p.pair, p.parent, min(b.bar_idx) AS a, max(b.bar_idx) + 1 AS z FROM parents p LEFT JOIN bars b
  ON p.pair = b.pair AND b.ts_s >= p.ts_s AND b.ts_s < coalesce(p.next_s, p.ts_s + 3600) GROUP BY ALL), f AS (SELECT *, coalesce(max(z) OVER (PARTITION BY pair ORDER BY parent), 0) AS fl FROM m) SELECT pair, parent AS bar_idx, coalesce(a, fl) AS sub_start, coalesce(z, fl) AS sub_end FROM f""")
def j2_sub_bar_ranges(spark, d):
    return B.sub_bar_ranges(_parents(spark, d), hourly(spark, d))


@query("set1_consolidate", """WITH c AS (SELECT event_type AS pair, event_id, value, unnest(['b', 'a']) AS chunk FROM events),
  k AS (SELECT pair, event_id, CASE WHEN chunk = 'a' THEN value ELSE value + 1 END AS price, chunk FROM c WHERE (chunk = 'a' AND event_id % 3 > 0) OR (chunk = 'b' AND event_id % 3 < 2))
  SELECT pair, count(*) AS n, round(sum(price), 4) + 0.0 AS total FROM (SELECT pair, event_id, arg_min(price, chunk) AS price FROM k GROUP BY ALL) GROUP BY pair""")
def set1_consolidate(spark, d):
    t = ticks(spark, d)
    a = t.where("event_id % 3 > 0").withColumn("chunk", F.lit("a"))
    b = t.where("event_id % 3 < 2").withColumns({"chunk": F.lit("b"), "price": F.col("price") + 1})
    one = B.consolidate(b.unionByName(a), keys=("pair", "event_id"))
    return one.groupBy("pair").agg(F.count("*").alias("n"), tidy(F.sum("price"), 4).alias("total"))


@query("set3_back_forward", f"""WITH {BARS} SELECT pair, CASE WHEN bar_idx < floor(n * 0.8::DOUBLE) THEN 'back' ELSE 'forward' END AS part, count(*) AS n_bars, min(ts_s) AS first_s
  FROM (SELECT *, count(*) OVER (PARTITION BY pair) AS n FROM bars) GROUP BY ALL""")
def set3_back_forward(spark, d):
    return B.split(hourly(spark, d), "backforward").groupBy("pair", "part").agg(F.count("*").alias("n_bars"), B.seconds(F.min("ts")).alias("first_s"))


@query("set4_holdout", f"""WITH {BARS}, t AS (SELECT *, make_timestamp(ts_s * 1000000) AS tt FROM bars), l AS (SELECT *, max(tt) OVER (PARTITION BY pair) - INTERVAL 1 MONTH AS cut FROM t)
  SELECT pair, CASE WHEN tt < cut THEN 'train' ELSE 'holdout' END AS part, count(*) AS n_bars FROM l GROUP BY ALL""")
def set4_holdout(spark, d):
    return B.split(hourly(spark, d), "holdout", months=1).groupBy("pair", "part").agg(F.count("*").alias("n_bars"))


_GAPS = f"""{BARS}, g AS (SELECT pair, lag(ts_s) OVER ({'PARTITION BY pair ORDER BY ts_s'}) AS a, ts_s AS b FROM bars),
 w AS (SELECT pair, a AS start_s, b AS end_s, make_timestamp(a * 1000000) AS s, make_timestamp(b * 1000000) AS e FROM g WHERE b - a > 3 * 3600),
 gaps AS (SELECT pair, start_s, end_s, CASE
   WHEN (isodow(s) = 5 AND hour(s) >= 20) OR isodow(s) IN (6, 7) OR (isodow(e) = 1 AND hour(e) <= 1)
     OR ((end_s - start_s) // 86400 >= 2 AND date_diff('day', s, e) >= (6 - isodow(s) + 7) % 7) THEN 'weekend'
   WHEN (month(s) = 12 AND day(s) BETWEEN 24 AND 26) OR (month(e) = 12 AND day(e) BETWEEN 24 AND 26) OR (month(s) = 12 AND day(s) = 31) OR (month(e) = 1 AND day(e) <= 2) THEN 'holiday'
   ELSE 'unexpected' END AS kind FROM w)"""


_MINUTE_GAPS = _GAPS.replace("3600", "60")


def _minutes(spark, d):
    """Minutes, of which many have no tick."""
    return B.ticks_to_bars(ticks(spark, d), "M1", order=("ts", "event_id"))


@query("ag4_gaps", f"WITH {_MINUTE_GAPS} SELECT * FROM gaps")
def ag4_gaps(spark, d):
    return Q.gaps(_minutes(spark, d), "M1")


@query("ag4_gap_details", f"WITH {_MINUTE_GAPS} SELECT pair, start_s, end_s, kind, row_number() OVER (PARTITION BY pair ORDER BY start_s)::INTEGER AS rank FROM gaps WHERE kind = 'unexpected' QUALIFY rank <= 20")
def ag4_gap_details(spark, d):
    return Q.gap_details(Q.gaps(_minutes(spark, d), "M1"))


def _of_users(spark, d):
    """Hours of each user as a series of its own: few ticks, so many gaps, over weekends and the turn of the year."""
    t = read(spark, d, "events").select(F.col("user_id").cast("string").alias("pair"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", F.col("value").alias("price"))
    return B.ticks_to_bars(t, "H1", order=("ts", "event_id"))


_USER_GAPS = _GAPS.replace("event_type AS pair", "user_id::VARCHAR AS pair")


@query("ag4_ag5_user_gaps", f"WITH {_USER_GAPS} SELECT * FROM gaps")
def ag5_user_gaps(spark, d):
    return Q.gaps(_of_users(spark, d), "H1")


@query("ag4_user_gap_details", f"WITH {_USER_GAPS} SELECT pair, start_s, end_s, kind, row_number() OVER (PARTITION BY pair ORDER BY start_s)::INTEGER AS rank FROM gaps WHERE kind = 'unexpected' QUALIFY rank <= 20")
def ag4_user_gap_details(spark, d):
    return Q.gap_details(Q.gaps(_of_users(spark, d), "H1"))


_CELLS = "count(*) AS n_rows, sum((open = 0)::INT + (high = 0)::INT + (low = 0)::INT + (close = 0)::INT)::BIGINT AS zeros, sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT)::BIGINT AS missing"


@query("ag7_cells", f"WITH {BARS}, c AS (SELECT pair, {_CELLS} FROM bars GROUP BY pair) SELECT *, round(100.0 * zeros / (4 * n_rows), 4)::DOUBLE AS zeros_pct, round(100.0 * missing / (4 * n_rows), 4)::DOUBLE AS missing_pct FROM c")
def ag7_cells(spark, d):
    return Q.cells(hourly(spark, d))


_ANOMALIES = """a AS (SELECT pair, sum((median > 0 AND high - low > 10 * median)::INT)::BIGINT AS extreme, sum((high = low)::INT)::BIGINT AS flat, sum((high < low)::INT)::BIGINT AS violations
  FROM (SELECT *, median(high - low) OVER (PARTITION BY pair) AS median FROM bars) GROUP BY pair)"""


@query("ag8_anomalies", f"WITH {BARS}, {_ANOMALIES} SELECT * FROM a")
def ag8_anomalies(spark, d):
    return Q.anomalies(hourly(spark, d), "H1")


_YEARS = """c AS (SELECT pair, year(make_timestamp(ts_s * 1000000)) AS year, count(*) AS n FROM bars GROUP BY ALL),
 y AS (SELECT pair, unnest(range(2022, max(year) + 1)) AS year FROM c GROUP BY pair),
 cover AS (SELECT y.pair, y.year::INTEGER AS year, coalesce(n, 0) AS n_rows, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 650 THEN 'sparse' ELSE 'good' END AS status
  FROM y LEFT JOIN c ON c.pair = y.pair AND c.year = y.year)"""


@query("ag9_yearly_coverage", f"WITH {BARS}, {_YEARS} SELECT * FROM cover")
def ag9_yearly_coverage(spark, d):
    return Q.yearly_coverage(hourly(spark, d), 2022, 650)


@query("ag10_quality_report", f"""WITH {_GAPS}, {_ANOMALIES}, {_YEARS}, k AS (SELECT pair, {_CELLS} FROM bars GROUP BY pair),
 n AS (SELECT pair, sum((kind = 'weekend')::INT)::BIGINT AS gaps_weekend, sum((kind = 'holiday')::INT)::BIGINT AS gaps_holiday, sum((kind = 'unexpected')::INT)::BIGINT AS gaps_unexpected FROM gaps GROUP BY pair),
 o AS (SELECT pair, count(*) AS good_years FROM cover WHERE status = 'good' GROUP BY pair),
 f AS (SELECT k.pair, k.n_rows, coalesce(gaps_unexpected, 0) AS gaps_unexpected, coalesce(good_years, 0) AS good_years,
   greatest(0.0, least(100.0, 100 - least(20.0, 0.5 * coalesce(gaps_unexpected, 0)) - least(20.0, 5.0 * round(100.0 * missing / (4 * n_rows), 4)) - least(20.0, 5.0 * round(100.0 * zeros / (4 * n_rows), 4))
     - least(20.0, 10.0 * violations) - least(5.0, 0.1 * extreme) - 15.0 * (1 - coalesce(good_years, 0) / 3.0)))::DOUBLE AS raw
   FROM k JOIN a ON a.pair = k.pair LEFT JOIN n ON n.pair = k.pair LEFT JOIN o ON o.pair = k.pair)
 SELECT pair, n_rows, gaps_unexpected, good_years, round(raw, 1) + 0.0 AS score, CASE WHEN n_rows = 0 THEN 'empty' WHEN n_rows < 5000 THEN 'too_few' WHEN round(raw, 1) < 50 THEN 'poor' ELSE 'ok' END AS gate FROM f""")
def ag10_quality_report(spark, d):
    r = Q.report(hourly(spark, d), "H1", 2022, 2024, 650)
    return r.select("pair", "n_rows", "gaps_unexpected", "good_years", tidy(F.col("score"), 1).alias("score"), "gate")


@query("ag12_status", f"WITH {BARS} SELECT pair, count(*) AS n_rows, min(ts_s) AS first_s, max(ts_s) AS last_s FROM bars GROUP BY pair")
def ag12_status(spark, d):
    return B.catalogue_status(hourly(spark, d))


@query("src9_freshness", f"WITH {BARS} SELECT pair, max(ts_s) AS last_s, 1706659200 - max(ts_s) > 7200 AS stale FROM bars GROUP BY pair")
def src9_freshness(spark, d):
    return B.freshness(hourly(spark, d), 1_706_659_200)


@query("src3_missing_years", "SELECT DISTINCT event_type AS pair, y::INTEGER AS year FROM events, (SELECT unnest(range(2022, 2026)) AS y) WHERE y <> 2024")
def src3_missing_years(spark, d):
    pairs = ticks(spark, d).select("pair").distinct()
    wanted = pairs.withColumn("year", F.explode(F.sequence(F.lit(2022), F.lit(2025))))
    there = ticks(spark, d).select("pair", F.year("ts").alias("year")).distinct()
    return B.missing_years(wanted, there, 2025)


def _last_sunday(month: int) -> str:
    day = f"make_date(year(ts), {month}, 31)"
    return f"({day}::TIMESTAMP - to_days(dayofweek({day})::INTEGER))"


@query("src5_server_time", f"""SELECT event_id, epoch_us(ts) // 1000000 - CASE WHEN ts >= {_last_sunday(3)} + INTERVAL 3 HOUR AND ts < {_last_sunday(10)} + INTERVAL 4 HOUR THEN 10800 ELSE 7200 END AS utc_s FROM events""")
def src5_server_time(spark, d):
    """The broker's zone is two hours ahead of UTC, three from the last Sunday of March to that of October."""
    return ticks(spark, d).select("event_id", B.seconds(B.to_utc(F.col("ts"), "EET").cast("timestamp_ntz")).alias("utc_s"))
