"""Queries on the full simulation: managed trades, batches of trials with metrics, telemetry.

The SQL walks each trade's sub-bars one by one in a recursive CTE, the state of the stop in its columns.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quantloom.functions.numeric import tidy
from quantloom.functions.reuse import settled
from quantloom.operators import metrics as M
from quantloom.operators import replay as RE
from quantloom.operators import signals as S
from quantloom.operators import simulate as T
from quantloom.plans.registry import register
from quantloom.plans.tables import PIP, SUBS, hourly, metric_sql, read, sub_bars
from quantloom.plans.trading import PREP, SMA_SIGNALS

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

CAP = 50
TRIAL_COUNT = 200
#: Parameters of trial i, as SQL of both engines; stops and targets in pips of 0.01.
GRID = {
    "trial": "CAST(i AS INT)",
    "dist": "CAST(1000 + 500 * (floor(i / 3) % 6) AS DOUBLE)",
    "rr": "CAST(1 + (floor(i / 18) % 4) / 2 AS DOUBLE)",
    "trailing_mode": "CASE i % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'fixed_pip' ELSE 'atr_chandelier' END",
    "trail_activate": "CAST(400 * (floor(i / 5) % 4) AS DOUBLE)",
    "trail_distance": "CAST(500 + 250 * (floor(i / 4) % 5) AS DOUBLE)",
    "trail_atr_mult": "CAST(1 + (floor(i / 6) % 5) / 2 AS DOUBLE)",
    "be_enabled": "floor(i / 2) % 2 = 1",
    "be_trigger": "CAST(500 + 250 * (floor(i / 8) % 5) AS DOUBLE)",
    "be_offset": "CAST(50 * (floor(i / 9) % 4) AS DOUBLE)",
    "partial_enabled": "floor(i / 7) % 2 = 1",
    "partial_pct": "CAST(30 + 10 * (floor(i / 10) % 5) AS DOUBLE)",
    "partial_trigger": "CAST(600 + 300 * (floor(i / 12) % 4) AS DOUBLE)",
    "max_bars": "CAST(50 * (floor(i / 11) % 4) AS DOUBLE)",
    "stale_enabled": "floor(i / 13) % 2 = 1",
    "stale_bars": "CAST(10 + 15 * (floor(i / 15) % 3) AS DOUBLE)",
    "stale_thr": "CAST(2 + (floor(i / 14) % 3) / 2 AS DOUBLE)",
}
_GRID = f"grid AS MATERIALIZED (SELECT {', '.join(f'{v} AS {k}' for k, v in GRID.items())} FROM range({TRIAL_COUNT}) r(i))"
#: Trial, breakeven trigger and offset, trailing activation and distance, partial trigger, max_bars, stale_bars of tr4.
FOUR = (
    (0, None, 0.0, None, None, None, 24.0, 0.0),
    (1, 1000.0, 100.0, None, None, None, 0.0, 0.0),
    (2, None, 0.0, 1500.0, 1000.0, None, 48.0, 0.0),
    (3, 500.0, 50.0, 2000.0, 1500.0, 1000.0, 36.0, 12.0),
)
_FOUR = ", ".join("(" + ", ".join("NULL::DOUBLE" if v is None else str(v) if isinstance(v, int) else f"{v}::DOUBLE" for v in t) + ")" for t in FOUR)


def managed_sql(trades: str) -> str:
    """CTEs up to ``done``: every trade of ``trades`` (with its management columns) and how it ended."""
    return f"""{SUBS}, {PREP}, {SMA_SIGNALS}, {trades}, lengths AS (
    SELECT DISTINCT stale_bars::BIGINT AS n FROM managed WHERE stale_bars > 0
  ), wide AS MATERIALIZED (
    SELECT pair, n, bar_idx, max(high - low) OVER (PARTITION BY pair, n ORDER BY bar_idx ROWS BETWEEN n - 1 PRECEDING AND CURRENT ROW) AS width
    FROM bars CROSS JOIN lengths
  ), stale AS (
    SELECT m.pair, m.sig_seq, m.trial, min(w.bar_idx) AS b FROM managed m JOIN wide w
      ON w.pair = m.pair AND w.n = m.stale_bars AND w.bar_idx >= m.bar_idx + w.n AND w.width < m.stale_thr * m.atr GROUP BY ALL
  ), timed AS (
    SELECT m.*, x.b AS stale_at, l.last_bar, CASE WHEN max_bars > 0 AND m.bar_idx + max_bars <= last_bar THEN (m.bar_idx + max_bars)::BIGINT END AS cap_at
    FROM managed m JOIN (SELECT pair, max(bar_idx) AS last_bar FROM bars GROUP BY pair) l ON l.pair = m.pair
    LEFT JOIN stale x ON x.pair = m.pair AND x.sig_seq = m.sig_seq AND x.trial = m.trial
  ), edges AS MATERIALIZED (
    SELECT pair, bar_idx, max(sub_seq) AS last_sub, arg_min(spread, sub_seq) AS first_spread FROM subs GROUP BY ALL
  ), opened AS MATERIALIZED (
    SELECT t.*, direction AS d, least(stale_at, cap_at) AS bar_exit, CASE WHEN stale_at < coalesce(cap_at, 1000000000000) THEN 'stale' ELSE 'max_bars' END AS bar_reason,
      CASE WHEN direction > 0 THEN entry_price + 0.5 * 1e-2 + coalesce(first_spread, 0) ELSE entry_price - 0.5 * 1e-2 END AS fill, last_sub
    FROM timed t JOIN edges e ON e.pair = t.pair AND e.bar_idx = t.bar_idx
  ), walk(pair, sig_seq, trial, seq, stop, tried, be, trail, part_price, part_spread, reason, price, spread, at_bar,
      d, bar_exit, bar_reason, bar_close, bar_spread, be_trigger, trail_activate, partial_trigger, target, dist, be_price, signed_fill) USING KEY (pair, sig_seq, trial) AS (
    SELECT o.pair, sig_seq, trial, last_sub, d * sl, FALSE, FALSE, FALSE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, o.bar_idx,
      d, bar_exit, bar_reason, b.close, b.spread, be_trigger, trail_activate, partial_trigger, d * tp, trail_pips * 1e-2, d * fill + be_offset * 1e-2, d * fill
    FROM opened o LEFT JOIN bars b ON b.pair = o.pair AND b.bar_idx = o.bar_exit
    UNION
    SELECT pair, sig_seq, trial, seq, CASE WHEN end_reason IS NULL AND trails THEN greatest(moved, best - dist) ELSE moved END, tried OR pulls, be OR locks, trails,
      CASE WHEN takes THEN close ELSE part_price END, CASE WHEN takes THEN sub_spread ELSE part_spread END, end_reason,
      CASE WHEN closed THEN bar_close - d * 0.5 * 1e-2 WHEN worst <= stop THEN d * stop - d * 0.5 * 1e-2 WHEN best >= target THEN d * target END,
      CASE WHEN closed THEN bar_spread ELSE sub_spread END, sub_bar,
      d, bar_exit, bar_reason, bar_close, bar_spread, be_trigger, trail_activate, partial_trigger, target, dist, be_price, signed_fill
    FROM (
      SELECT *, pulls AND be_price > stop AS locks, CASE WHEN pulls AND be_price > stop THEN be_price ELSE stop END AS moved,
        CASE WHEN closed THEN bar_reason WHEN worst <= stop THEN CASE WHEN trail THEN 'trailing' WHEN be THEN 'breakeven' ELSE 'sl' END WHEN best >= target THEN 'tp' END AS end_reason
      FROM (
        SELECT *, NOT tried AND coalesce(gain >= be_trigger, FALSE) AS pulls, trail OR coalesce(gain >= trail_activate, FALSE) AS trails,
          NOT closed AND part_price IS NULL AND coalesce(gain >= partial_trigger, FALSE) AS takes
        FROM (
          SELECT w.* EXCLUDE (seq, price, spread, at_bar), u.sub_seq AS seq, u.bar_idx AS sub_bar, u.close, u.spread AS sub_spread, CASE WHEN w.d > 0 THEN u.high ELSE -u.low END AS best,
            CASE WHEN w.d > 0 THEN u.low ELSE -u.high END AS worst, ((CASE WHEN w.d > 0 THEN u.high ELSE -u.low END) - w.signed_fill) / 1e-2 AS gain, coalesce(u.bar_idx >= w.bar_exit, FALSE) AS closed
          FROM walk w JOIN subs u ON u.pair = w.pair AND u.sub_seq = w.seq + 1 WHERE w.reason IS NULL
        )
      )
    )
  ), ended AS (
    SELECT o.*, coalesce(f.reason, 'none') AS reason, f.part_price, f.part_spread, CASE WHEN f.reason IS NULL THEN u.close - o.d * 0.5 * 1e-2 ELSE f.price END AS exit_price, CASE WHEN f.reason IS NULL THEN u.spread ELSE f.spread END AS xs,
      CASE WHEN f.reason IN ('max_bars', 'stale') THEN o.bar_exit ELSE f.at_bar END AS exit_bar, CASE WHEN part_price IS NULL THEN 0 ELSE partial_pct / 100 END AS share
    FROM opened o JOIN walk f ON f.pair = o.pair AND f.sig_seq = o.sig_seq AND f.trial = o.trial JOIN subs u ON u.pair = f.pair AND u.sub_seq = f.seq
  ), done AS MATERIALIZED (
    SELECT *, share > 0 AS partial, (1 - share) * (d * (exit_price - fill) - CASE WHEN d < 0 THEN xs ELSE 0 END) / 1e-2 - 0.7
      + CASE WHEN share > 0 THEN share * (d * (part_price - d * 0.5 * 1e-2 - fill) - CASE WHEN d < 0 THEN part_spread ELSE 0 END) / 1e-2 ELSE 0 END AS pnl FROM ended
  )"""


_FOUR_SQL = managed_sql(f"""four(trial, be_trigger, be_offset, trail_activate, trail_pips, partial_trigger, max_bars, stale_bars) AS (VALUES {_FOUR}), managed AS MATERIALIZED (
  SELECT s.*, f.*, entry_price - 30 * direction AS sl, entry_price + 60 * direction AS tp, 50::DOUBLE AS partial_pct, 2.5::DOUBLE AS stale_thr, atr_pips * 1e-2 AS atr FROM sig s CROSS JOIN four f)""")
_BATCH_SQL = managed_sql(f"""{_GRID}, managed AS MATERIALIZED (
  SELECT s.*, g.trial, g.dist AS sl_pips, entry_price - direction * dist * 1e-2 AS sl, entry_price + direction * dist * rr * 1e-2 AS tp,
    CASE WHEN trailing_mode <> 'off' THEN trail_activate END AS trail_activate, CASE trailing_mode WHEN 'fixed_pip' THEN trail_distance WHEN 'atr_chandelier' THEN trail_atr_mult * atr_pips END AS trail_pips,
    CASE WHEN be_enabled THEN be_trigger END AS be_trigger, be_offset, CASE WHEN partial_enabled THEN partial_trigger END AS partial_trigger, partial_pct, max_bars,
    CASE WHEN stale_enabled THEN stale_bars ELSE 0 END AS stale_bars, stale_thr, atr_pips * 1e-2 AS atr
  FROM sig s CROSS JOIN grid g)""")


def four_trades(spark, d):
    bars = settled(hourly(spark, d))
    t = spark.createDataFrame(list(FOUR), "trial int, be_trigger double, be_offset double, trail_activate double, trail_pips double, partial_trigger double, max_bars double, stale_bars double")
    r = T.evaluate(S.sma_crossover(bars, PIP), t).withColumns({
        "sl": F.col("entry_price") - 30 * F.col("direction"), "tp": F.col("entry_price") + 60 * F.col("direction"), "partial_pct": F.lit(50.0), "stale_thr": F.lit(2.5),
        "atr": F.col("atr_pips") * PIP, "trade_id": F.concat_ws("/", "pair", "sig_seq", "trial"),
    })
    return T.simulate_full(r, bars, sub_bars(spark, d, bars), PIP)


def batch_trades(spark, d):
    """The moving-average signals under 200 trials of the management parameters."""
    bars = settled(hourly(spark, d))
    grid = spark.range(TRIAL_COUNT).withColumnRenamed("id", "i").select(*[F.expr(v).alias(k) for k, v in GRID.items()])
    c = F.col
    r = T.management(T.evaluate(S.sma_crossover(bars, PIP), grid), PIP).withColumns({
        "sl_pips": c("dist"), "sl": c("entry_price") - c("direction") * c("dist") * PIP, "tp": c("entry_price") + c("direction") * c("dist") * c("rr") * PIP,
        "trade_id": F.concat_ws("/", "pair", "sig_seq", "trial"),
    })
    return T.simulate_full(r, bars, sub_bars(spark, d, bars), PIP), bars


_ROW = "round(pnl, 3) + 0.0 AS pnl"


@query("tr4_full_simulation", f"WITH RECURSIVE {_FOUR_SQL} SELECT pair, sig_seq, trial, direction, reason, exit_bar, partial, {_ROW} FROM done")
def tr4(spark, d):
    """Breakeven, trailing, partial, time and stale exits of four trials."""
    return four_trades(spark, d).select("pair", "sig_seq", "trial", "direction", "reason", "exit_bar", "partial", tidy(F.col("pnl"), 3).alias("pnl"))


@query("tr8_trailing_modes", f"""WITH RECURSIVE {_BATCH_SQL}
 SELECT pair, trailing_mode, reason, count(*) AS n, count(*) FILTER (partial) AS partials, round(avg(exit_bar - bar_idx), 4) + 0.0 AS held, round(sum(pnl), 2) + 0.0 AS pnl
 FROM done JOIN (SELECT trial, trailing_mode FROM grid) USING (trial) GROUP BY ALL""")
def tr8(spark, d):
    """How trades end with trailing off, by a fixed distance and by a multiple of the ATR (chandelier)."""
    t, _ = batch_trades(spark, d)
    return t.groupBy("pair", "trailing_mode", "reason").agg(
        F.count("*").alias("n"), F.count_if("partial").alias("partials"), tidy(F.avg(F.col("exit_bar") - F.col("bar_idx")), 4).alias("held"), tidy(F.sum("pnl"), 2).alias("pnl")
    )


_CAPPED = f"""numbered AS (
    SELECT * REPLACE (sum(sl_pips) OVER (PARTITION BY pair, trial) / least(count(*) OVER (PARTITION BY pair, trial), {CAP}) AS sl_pips),
      row_number() OVER (PARTITION BY pair, trial ORDER BY sig_seq) AS nth FROM done
  ), sized AS (
    SELECT t.*, n.n_bars FROM numbered t JOIN (SELECT pair, count(*) AS n_bars FROM bars GROUP BY pair) n ON n.pair = t.pair WHERE nth <= {CAP}
  ), {metric_sql('sized', 'pair, trial', 'sig_seq', annual='count(*) * 6048.0::DOUBLE / max(n_bars)', sl='avg(sl_pips)')}"""


@query("tr13_full_batch", f"WITH RECURSIVE {_BATCH_SQL}, {_CAPPED} SELECT pair, trial, trades, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in M.METRICS[1:]) + " FROM mq")
def tr13_full(spark, d):
    """Ten metrics of 200 fully managed trials in one batch, over the first 50 trades of each trial and pair."""
    trades, bars = batch_trades(spark, d)
    sized = bars.groupBy("pair").agg(F.count("*").alias("n_bars"))
    kept = T.capped(trades, ["pair", "trial"], ["sig_seq"], CAP).join(sized, "pair")
    m = M.metrics(kept, ["pair", "trial"], ["sig_seq"], sl_pips="sl_pips", n_bars="n_bars")
    return m.select("pair", "trial", "trades", *(tidy(F.col(c), 4).alias(c) for c in M.METRICS[1:]))


@query("tr12_full_telemetry", f"""WITH RECURSIVE {_FOUR_SQL}
 SELECT t.pair, t.sig_seq, t.trial, reason, t.exit_bar - t.bar_idx AS bars_held, round(exit_price, 4) + 0.0 AS exit_price, round(fill, 4) + 0.0 AS fill, partial, round(pnl, 3) + 0.0 AS pnl,
  round(greatest(coalesce(max(CASE WHEN direction > 0 THEN high - fill ELSE fill - low END), 0) / 1e-2, 0), 3) + 0.0 AS mfe,
  round(greatest(coalesce(max(CASE WHEN direction > 0 THEN fill - low ELSE high - fill END), 0) / 1e-2, 0), 3) + 0.0 AS mae
 FROM done t LEFT JOIN bars b ON b.pair = t.pair AND b.bar_idx > t.bar_idx AND b.bar_idx <= t.exit_bar GROUP BY ALL""")
def tr12_full(spark, d):
    """Every managed trade with its exit and its excursions, as telemetry records it."""
    t = T.excursions(four_trades(spark, d), hourly(spark, d), PIP)
    return t.select("pair", "sig_seq", "trial", "reason", "bars_held", *(tidy(F.col(c), n).alias(c) for c, n in (("exit_price", 4), ("fill", 4), ("pnl", 3), ("mfe", 3), ("mae", 3))), "partial")


#: Stand-in deployments: orders as versions of parameters, dealt to pairs and two groups; they hold from some time of January 2024 on and were stored up to half a day before or after.
_VERSION = {
    "grp": "CAST(o_custkey % 2 AS INT)",
    "valid_s": "1704067200 + o_orderkey * 7919 % 2592000",
    "recorded_s": "1704067200 + o_orderkey * 7919 % 2592000 + o_orderkey * 31 % 86400 - 43200",
    "hours_start": "CAST(o_custkey % 12 AS INT)",
    "hours_end": "CAST(12 + o_custkey % 12 AS INT)",
} | {k: v.replace("i ", "(o_orderkey % 200) ") for k, v in GRID.items() if k != "trial"}
_PAIRS = ("click", "error", "purchase", "signup", "view")
_PAIR_OF = "CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PAIRS)) + " END"
_REPLAY_SQL = managed_sql(f"""versions AS MATERIALIZED (SELECT {_PAIR_OF} AS pair, {', '.join(f'{v} AS {k}' for k, v in _VERSION.items())} FROM orders),
 asked AS (SELECT s.*, b.ts_s AS s, hour(make_timestamp(b.ts_s * 1000000)) AS hr, g.grp AS trial FROM sig s JOIN bars b ON b.pair = s.pair AND b.bar_idx = s.bar_idx JOIN (SELECT DISTINCT pair, grp FROM versions) g ON g.pair = s.pair),
 live AS (SELECT a.*, v.* EXCLUDE (pair, grp) FROM asked a JOIN versions v ON v.pair = a.pair AND v.grp = a.trial AND v.valid_s <= a.s AND v.recorded_s <= a.s
   QUALIFY row_number() OVER (PARTITION BY a.pair, a.trial, a.sig_seq ORDER BY v.valid_s DESC, v.recorded_s DESC) = 1),
 managed AS MATERIALIZED (
  SELECT pair, bar_idx, direction, variant, filter_value, entry_price, atr_pips, sig_seq, trial, valid_s, dist AS sl_pips, entry_price - direction * dist * 1e-2 AS sl, entry_price + direction * dist * rr * 1e-2 AS tp,
    CASE WHEN trailing_mode <> 'off' THEN trail_activate END AS trail_activate, CASE trailing_mode WHEN 'fixed_pip' THEN trail_distance WHEN 'atr_chandelier' THEN trail_atr_mult * atr_pips END AS trail_pips,
    CASE WHEN be_enabled THEN be_trigger END AS be_trigger, be_offset, CASE WHEN partial_enabled THEN partial_trigger END AS partial_trigger, partial_pct, max_bars,
    CASE WHEN stale_enabled THEN stale_bars ELSE 0 END AS stale_bars, stale_thr, atr_pips * 1e-2 AS atr
  FROM live WHERE hr BETWEEN hours_start AND hours_end)""")


def versions(spark, d):
    return read(spark, d, "orders").select(F.expr(_PAIR_OF).alias("pair"), *[F.expr(v).alias(k) for k, v in _VERSION.items()]).withColumn("days_mask", F.lit(127))


@query("c1_replay", f"""WITH RECURSIVE {_REPLAY_SQL} SELECT t.pair, t.trial AS grp, t.sig_seq, t.valid_s, t.direction, reason, t.exit_bar - t.bar_idx AS bars_held, {_ROW},
  round(greatest(coalesce(max(CASE WHEN direction > 0 THEN high - fill ELSE fill - low END), 0) / 1e-2, 0), 3) + 0.0 AS mfe
 FROM done t LEFT JOIN bars b ON b.pair = t.pair AND b.bar_idx > t.bar_idx AND b.bar_idx <= t.exit_bar GROUP BY ALL""")
def c1(spark, d):
    """Trades of the moving-average signals by the parameters that were known and in force at each signal, with telemetry."""
    bars = settled(hourly(spark, d))
    c = F.col
    made = RE.replay_trades(S.sma_crossover(bars, PIP), versions(spark, d), bars, sub_bars(spark, d, bars), PIP, stops=lambda r: r.withColumns({
        "sl": c("entry_price") - c("direction") * c("dist") * PIP, "tp": c("entry_price") + c("direction") * c("dist") * c("rr") * PIP,
    }))
    return made.select("pair", "grp", "sig_seq", "valid_s", "direction", "reason", "bars_held", tidy(c("pnl"), 3).alias("pnl"), tidy(c("mfe"), 3).alias("mfe"))
