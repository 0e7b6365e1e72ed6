"""Queries on indicators, regimes and metrics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quantloom.functions.numeric import tidy
from quantloom.operators import indicators as I
from quantloom.operators import metrics as M
from quantloom.operators import regime as R
from quantloom.plans.registry import register
from quantloom.plans.tables import BARS, BY, RESULTS, hourly, metric_sql, results, rows, smooth

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)


def _out(df, *cols, keys=("pair", "bar_idx"), digits=5):
    return df.select(*keys, *(tidy(F.col(c), digits).alias(c) for c in cols))


def _sql(cols: dict[str, str], ctes: str = "", source: str = "bars", digits: int = 5) -> str:
    picked = ", ".join(f"round({x}, {digits}) + 0.0 AS {n}" for n, x in cols.items())
    return f"WITH {BARS}{', ' + ctes if ctes else ''} SELECT pair, bar_idx, {picked} FROM {source}"


def _warm(x: str, first: int) -> str:
    return f"CASE WHEN bar_idx >= {first} THEN {x} END"


@query("w01_rolling", _sql({"hi_20": _warm(f"max(high) OVER {rows(20)}", 19), "lo_20": _warm(f"min(low) OVER {rows(20)}", 19)}))
def w01(spark, d):
    return _out(I.rolling(I.rolling(hourly(spark, d), "max", "high", 20, "hi_20"), "min", "low", 20, "lo_20"), "hi_20", "lo_20")


@query("w02_sma", _sql({"sma_20": _warm(f"avg(close) OVER {rows(20)}", 19)}))
def w02(spark, d):
    return _out(I.sma(hourly(spark, d), 20), "sma_20")


def _ema(p: int, x: str = "close", start: int = 0) -> str:
    alpha = f"(2e0 / {p + 1})"
    return smooth(x, f"_seed{p}", start + p - 1, f"(1 - {alpha})", alpha)


def _seeds(*periods: int, x: str = "close", source: str = "bars", name: str = "seeded") -> str:
    return f"{name} AS (SELECT *, {', '.join(f'avg({x}) OVER {rows(p)} AS _seed{p}' for p in periods)} FROM {source})"


@query("w03_ema", _sql({f"ema_{p}": _warm(_ema(p), p - 1) for p in (5, 20, 50)}, _seeds(5, 20, 50), "seeded"))
def w03(spark, d):
    return _out(I.ema(hourly(spark, d), (5, 20, 50)), "ema_5", "ema_20", "ema_50")


_TR = f"tr AS (SELECT *, CASE WHEN bar_idx = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER ({BY})), abs(low - lag(close) OVER ({BY}))) END AS tr FROM bars)"


def _atr(p: int, source: str = "tr", name: str = "atr") -> str:
    wilder = smooth("tr", "_seed", p - 1, f"(1 - 1e0 / {p})", f"(1e0 / {p})")
    return f"{name}0 AS (SELECT *, avg(tr) OVER {rows(p)} AS _seed FROM {source}), {name} AS (SELECT * EXCLUDE (_seed), {_warm(wilder, p - 1)} AS {name} FROM {name}0)"


@query("w04_true_range", _sql({"tr": "tr"}, _TR, "tr"))
def w04(spark, d):
    return _out(I.true_range(hourly(spark, d)), "tr")


@query("w05_atr", _sql({"atr_14": "atr"}, f"{_TR}, {_atr(14)}", "atr"))
def w05(spark, d):
    return _out(I.atr(hourly(spark, d)), "atr_14")


_RSI = f"""mv AS (SELECT *, close - lag(close) OVER ({BY}) AS mv FROM bars), gl AS (SELECT *, greatest(mv, 0e0) AS g, greatest(-mv, 0e0) AS l FROM mv),
 sd AS (SELECT *, avg(g) OVER {rows(14)} AS sg, avg(l) OVER {rows(14)} AS sl FROM gl),
 sm AS (SELECT *, {smooth('g', 'sg', 14, '(1 - 1e0 / 14)', '(1e0 / 14)')} AS ag, {smooth('l', 'sl', 14, '(1 - 1e0 / 14)', '(1e0 / 14)')} AS al FROM sd),
 rsi AS (SELECT *, {_warm('CASE WHEN al = 0 THEN 100e0 ELSE 100 - 100 / (1 + ag / al) END', 14)} AS rsi_14 FROM sm)"""


@query("w06_rsi", _sql({"rsi_14": "rsi_14"}, _RSI, "rsi"))
def w06(spark, d):
    return _out(I.rsi(hourly(spark, d)), "rsi_14")


@query("w07_bollinger", _sql({n: _warm(f"avg(close) OVER {rows(20)} {s}", 19) for n, s in (("bb_mid", ""), ("bb_upper", f"+ 2 * stddev_pop(close) OVER {rows(20)}"), ("bb_lower", f"- 2 * stddev_pop(close) OVER {rows(20)}"))}))
def w07(spark, d):
    return _out(I.bollinger(hourly(spark, d)), "bb_mid", "bb_upper", "bb_lower")


def _hl(p: int) -> str:
    return f"hl AS (SELECT *, max(high) OVER {rows(p)} AS hh, min(low) OVER {rows(p)} AS ll FROM bars)"


_STOCH = f"{_hl(14)}, st AS (SELECT *, {_warm('CASE WHEN hh = ll THEN 50e0 ELSE 100 * (close - ll) / (hh - ll) END', 13)} AS stoch_k FROM hl)"


@query("w08_stochastic", _sql({"stoch_k": "stoch_k", "stoch_d": _warm(f"avg(stoch_k) OVER {rows(3)}", 15)}, _STOCH, "st"))
def w08(spark, d):
    return _out(I.stochastic(hourly(spark, d)), "stoch_k", "stoch_d")


_MACD = f"""{_seeds(12, 26)}, mc AS (SELECT *, {_warm(f'{_ema(12)} - {_ema(26)}', 25)} AS macd FROM seeded), {_seeds(9, x='macd', source='mc', name='ms')},
 md AS (SELECT *, {_warm(_ema(9, 'macd', 25), 33)} AS macd_signal FROM ms)"""


@query("w09_macd", _sql({"macd": "macd", "macd_signal": "macd_signal", "macd_hist": "macd - macd_signal"}, _MACD, "md"))
def w09(spark, d):
    return _out(I.macd(hourly(spark, d)), "macd", "macd_signal", "macd_hist")


_ADX = f"""{_TR}, {_atr(14)}, ud AS (SELECT *, high - lag(high) OVER ({BY}) AS u, lag(low) OVER ({BY}) - low AS dn FROM atr),
 pn AS (SELECT *, CASE WHEN u > dn AND u > 0 THEN u ELSE 0e0 END AS p, CASE WHEN dn > u AND dn > 0 THEN dn ELSE 0e0 END AS n FROM ud),
 ps AS (SELECT *, sum(p) OVER {rows(14)} AS sp0, sum(n) OVER {rows(14)} AS sn0 FROM pn),
 di AS (SELECT *, {_warm('100 * ' + smooth('p', 'sp0', 14, '(1 - 1e0 / 14)', '1') + ' / (atr * 14)', 14)} AS plus_di, {_warm('100 * ' + smooth('n', 'sn0', 14, '(1 - 1e0 / 14)', '1') + ' / (atr * 14)', 14)} AS minus_di FROM ps),
 dx AS (SELECT *, CASE WHEN plus_di + minus_di > 0 THEN 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END AS dx FROM di),
 dq AS (SELECT *, avg(dx) OVER {rows(14)} AS dx0 FROM dx),
 adx AS (SELECT *, {_warm(smooth('dx', 'dx0', 27, '(1 - 1e0 / 14)', '(1e0 / 14)'), 27)} AS adx FROM dq)"""


@query("w10_adx", _sql({"adx": "adx", "plus_di": "plus_di", "minus_di": "minus_di"}, _ADX, "adx"))
def w10(spark, d):
    return _out(I.adx(hourly(spark, d)), "adx", "plus_di", "minus_di")


@query("w11_donchian", _sql({"dc_upper": _warm("hh", 19), "dc_lower": _warm("ll", 19), "dc_mid": _warm("(hh + ll) / 2", 19)}, _hl(20), "hl"))
def w11(spark, d):
    return _out(I.donchian(hourly(spark, d)), "dc_upper", "dc_lower", "dc_mid")


@query("w12_supertrend", f"""WITH RECURSIVE {BARS}, {_TR}, {_atr(10)}, bd AS MATERIALIZED (SELECT pair, bar_idx, close, (high + low) / 2 + 3 * atr AS up, (high + low) / 2 - 3 * atr AS dn FROM atr),
 st AS (SELECT pair, bar_idx, close, up AS hi, dn AS lo, -1 AS way FROM bd WHERE bar_idx = 9
  UNION ALL SELECT * FROM (
   SELECT pair, bar_idx, close, hi, lo, CASE WHEN was < 0 THEN CASE WHEN close > hi THEN 1 ELSE -1 END ELSE CASE WHEN close < lo THEN -1 ELSE 1 END END AS way FROM (
    SELECT b.pair, b.bar_idx, b.close, CASE WHEN b.up < s.hi OR s.close > s.hi THEN b.up ELSE s.hi END AS hi, CASE WHEN b.dn > s.lo OR s.close < s.lo THEN b.dn ELSE s.lo END AS lo, s.way AS was
    FROM st s JOIN bd b ON b.pair = s.pair AND b.bar_idx = s.bar_idx + 1)))
 SELECT b.pair, b.bar_idx, round(CASE WHEN way > 0 THEN lo ELSE hi END, 5) + 0.0 AS supertrend, coalesce(way, 0)::BIGINT AS st_dir FROM bars b LEFT JOIN st ON st.pair = b.pair AND st.bar_idx = b.bar_idx""")
def w12(spark, d):
    return I.supertrend(hourly(spark, d)).select("pair", "bar_idx", tidy(F.col("supertrend"), 5).alias("supertrend"), "st_dir")


@query("w13_keltner", _sql({"kc_mid": "mid", "kc_upper": "mid + 2 * atr", "kc_lower": "mid - 2 * atr"}, f"{_TR}, {_atr(10)}, {_seeds(20, source='atr')}, kc AS (SELECT *, {_warm(_ema(20), 19)} AS mid FROM seeded)", "kc"))
def w13(spark, d):
    return _out(I.keltner(hourly(spark, d)), "kc_mid", "kc_upper", "kc_lower")


@query("w14_williams_r", _sql({"williams_r": _warm("CASE WHEN hh = ll THEN -50e0 ELSE -100 * (hh - close) / (hh - ll) END", 13)}, _hl(14), "hl"))
def w14(spark, d):
    return _out(I.williams_r(hourly(spark, d)), "williams_r")


@query("w15_cci", f"""WITH {BARS}, tp AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), mn AS (SELECT *, avg(tp) OVER {rows(20)} AS mean FROM tp),
 dv AS (SELECT a.pair, a.bar_idx, a.tp, a.mean, sum(abs(b.tp - a.mean)) / 20 AS dev FROM mn a JOIN mn b ON b.pair = a.pair AND b.bar_idx BETWEEN a.bar_idx - 19 AND a.bar_idx GROUP BY ALL)
 SELECT pair, bar_idx, round({_warm('CASE WHEN dev = 0 THEN 0e0 ELSE (tp - mean) / (0.015 * dev) END', 19)}, 5) + 0.0 AS cci FROM dv""")
def w15(spark, d):
    return _out(I.cci(hourly(spark, d)), "cci")


_MID = f"({BY} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
_FULL = f"bar_idx >= 5 AND lead(bar_idx, 5) OVER ({BY}) IS NOT NULL"


@query("w16_swings", _sql({"swing_high": f"CASE WHEN {_FULL} AND high = max(high) OVER {_MID} THEN high END", "swing_low": f"CASE WHEN {_FULL} AND low = min(low) OVER {_MID} THEN low END"}))
def w16(spark, d):
    return _out(I.swings(hourly(spark, d)), "swing_high", "swing_low")


_PAST = f"({BY} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"


@query("w17_recent_swing", _sql({"recent_low": f"min(low) OVER {_PAST}", "recent_high": f"max(high) OVER {_PAST}"}))
def w17(spark, d):
    return _out(I.recent_swing(hourly(spark, d)), "recent_low", "recent_high")


@query("w18_percent_rank", f"""WITH {BARS}, k AS (SELECT a.pair, a.bar_idx, sum((b.close <= a.close)::INT) AS below FROM bars a JOIN bars b ON b.pair = a.pair AND b.bar_idx BETWEEN a.bar_idx - 99 AND a.bar_idx GROUP BY ALL)
 SELECT pair, bar_idx, CASE WHEN bar_idx >= 99 THEN below::DOUBLE END AS pct_rank FROM k""")
def w18(spark, d):
    return _out(I.percent_rank(hourly(spark, d), "close"), "pct_rank")


_REGIME = f"""{_ADX}, nr AS MATERIALIZED (SELECT pair, bar_idx, adx, atr / close AS natr FROM adx),
 rk AS (SELECT a.pair, a.bar_idx, any_value(a.adx) AS adx, CASE WHEN count(b.natr) = 100 THEN 100.0 * sum((b.natr <= a.natr)::INT) / 100 END AS rank FROM nr a JOIN nr b ON b.pair = a.pair AND b.bar_idx BETWEEN a.bar_idx - 99 AND a.bar_idx GROUP BY a.pair, a.bar_idx),
 tn AS (SELECT *, coalesce(last_value(CASE WHEN rank IS NULL THEN NULL WHEN adx >= 25 THEN 1 WHEN adx < 20 THEN 0 END IGNORE NULLS) OVER ({BY}), 0) AS trend FROM rk),
 raw AS (SELECT pair, bar_idx, (CASE WHEN adx IS NULL OR rank IS NULL THEN -1 ELSE 2 * trend + (rank >= 75)::INT END)::INTEGER AS regime_raw FROM tn),
 stp AS (SELECT *, CASE WHEN lag(regime_raw) OVER ({BY}) = regime_raw THEN 0 ELSE 1 END AS s FROM raw), run AS MATERIALIZED (SELECT *, sum(s) OVER ({BY}) AS run FROM stp),
 runs AS MATERIALIZED (SELECT pair, run, any_value(regime_raw) AS v, count(*) AS n FROM run GROUP BY ALL),
 fold AS (SELECT pair, run, v, v AS last, -1 AS before FROM runs WHERE run = 1 UNION ALL SELECT pair, run, new, CASE WHEN new <> -1 THEN new ELSE last END, CASE WHEN new <> -1 AND new <> last THEN last ELSE before END FROM (
   SELECT r.pair, r.run, f.last, f.before, CASE WHEN r.v <> -1 AND r.n < 8 AND CASE WHEN f.last <> r.v THEN f.last ELSE f.before END <> -1 THEN CASE WHEN f.last <> r.v THEN f.last ELSE f.before END ELSE r.v END AS new FROM fold f JOIN runs r ON r.pair = f.pair AND r.run = f.run + 1))"""


@query("w21_regime", f"WITH RECURSIVE {BARS}, {_REGIME} SELECT r.pair, r.bar_idx, r.regime_raw, f.v AS regime FROM run r JOIN fold f ON f.pair = r.pair AND f.run = r.run")
def w21(spark, d):
    return R.classify(hourly(spark, d)).select("pair", "bar_idx", "regime_raw", "regime")


EQUITY = f"""{RESULTS}, eq AS (SELECT *, sum(pnl) OVER (PARTITION BY key ORDER BY seq) AS eq FROM results), pk AS (SELECT *, greatest(0.0, max(eq) OVER (PARTITION BY key ORDER BY seq)) AS peak FROM eq),
 dd AS (SELECT *, peak - eq AS dd, greatest(abs(eq), peak) AS base FROM pk), rb AS (SELECT *, max(base) OVER (PARTITION BY key ORDER BY seq) AS run_base FROM dd)"""


@query("w23_equity", f"WITH {EQUITY} SELECT key, seq + 1 AS seq, round(eq, 2) + 0.0 AS eq, round(peak, 2) + 0.0 AS peak, round(dd, 2) + 0.0 AS dd FROM rb")
def w23(spark, d):
    return M.equity(results(spark, d), ["key"], ["seq"]).select("key", F.col("seq").cast("long").alias("seq"), *(tidy(F.col(c), 2).alias(c) for c in ("eq", "peak", "dd")))


@query("w24_equity_curve", f"WITH {EQUITY} SELECT key, seq + 1 AS step, round(eq, 2) + 0.0 AS equity FROM rb UNION ALL SELECT DISTINCT key, 0, 0.0::DOUBLE FROM results")
def w24(spark, d):
    c = M.equity_curve(results(spark, d).withColumn("exit_bar", F.col("seq")), ["key"])
    return c.select("key", "step", tidy(F.col("equity"), 2).alias("equity"))


METRIC_CTES = f"{RESULTS}, {metric_sql('results', 'key', 'seq')}"
METRIC_COLS = "key, trades, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in M.METRICS[1:])


@query("m10_metrics", f"WITH {METRIC_CTES} SELECT {METRIC_COLS} FROM mq")
def m10(spark, d):
    m = M.metrics(results(spark, d), ["key"], ["seq"])
    return m.select("key", "trades", *(tidy(F.col(c), 5).alias(c) for c in M.METRICS[1:]))


@query("w25_rank", f"WITH {METRIC_CTES} SELECT key, row_number() OVER (ORDER BY round(quality, 5) + 0.0 DESC, key) - 1 AS rank FROM mq")
def w25(spark, d):
    m = M.metrics(results(spark, d), ["key"], ["seq"]).select("key", tidy(F.col("quality"), 5).alias("quality"))
    return M.rank_by_quality(m, "key").select("key", "rank")


@query("v22_trade_statistics", f"""WITH {RESULTS} SELECT key, count(*) AS n, round(avg(pnl), 4) + 0.0 AS mean, round(median(pnl), 4) + 0.0 AS median, round(stddev_pop(pnl), 4) + 0.0 AS sd, round(max(pnl), 4) + 0.0 AS best, round(min(pnl), 4) + 0.0 AS worst,
  round(avg(CASE WHEN pnl > 0 THEN pnl END), 4) + 0.0 AS mean_win, round(avg(CASE WHEN pnl <= 0 THEN pnl END), 4) + 0.0 AS mean_loss FROM results GROUP BY key""")
def v22(spark, d):
    return M.trade_statistics(results(spark, d), ["key"])


@query("v22_breakdown", f"""WITH {RESULTS}, s AS (SELECT key, pnl, CASE WHEN seq % 3 = 0 THEN 'sl' WHEN seq % 3 = 1 THEN 'tp' ELSE 'trailing' END AS reason FROM results), g AS (
  SELECT key, reason, count(*) AS n, round(sum(pnl), 4) + 0.0 AS total, round(avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 4) + 0.0 AS win_rate FROM s GROUP BY ALL)
  SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY key), 4) + 0.0 AS share FROM g""")
def v22_breakdown(spark, d):
    r = results(spark, d).withColumn("reason", F.element_at(F.array(F.lit("sl"), F.lit("tp"), F.lit("trailing")), (F.col("seq") % 3 + 1).cast("int")))
    return M.breakdown(r, ["key"], "reason").withColumn("total", tidy(F.col("total"), 4))
