"""Queries on signals, filters, stops and simulated trades."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql import Window

from quantloom.functions.numeric import tidy
from quantloom.functions.reuse import settled
from quantloom.operators import filters as FI
from quantloom.operators import indicators as I
from quantloom.operators import metrics as M
from quantloom.operators import regime as R
from quantloom.operators import signals as S
from quantloom.operators import simulate as T
from quantloom.operators import sltp
from quantloom.plans.registry import register
from quantloom.plans.tables import BARS, BY, PIP, SUBS, hourly, metric_sql, rows, smooth, sub_bars
from quantloom.plans.windows import _ADX, _MACD, _REGIME, _RSI, _TR, _atr, _ema, _hl, _seeds

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)


def _flat(signals):
    return signals.select("pair", "bar_idx", "direction", "variant", tidy(F.col("filter_value"), 2).alias("filter_value"), tidy(F.col("entry_price"), 4).alias("entry_price"), tidy(F.col("atr_pips"), 3).alias("atr_pips"), "sig_seq")


#: Bars with what every generator needs.
PREP = f"{_TR}, {_atr(14)}, prep AS MATERIALIZED (SELECT * EXCLUDE (tr), coalesce(lead(open) OVER ({BY}), close) AS entry_price, atr / 1e-2 AS atr_pips FROM atr)"


def _signals(cases: list[tuple[str, int, int | str, str]], ctes: str = "", source: str = "prep", recursive: str = "") -> str:
    """SQL of the signals where (condition, direction, variant, filter value) hold."""
    every = " UNION ALL ".join(f"SELECT pair, bar_idx, {d}::INTEGER AS direction, {v}::BIGINT AS variant, {f} AS filter_value, entry_price, atr_pips FROM {source} WHERE atr_pips > 0 AND {c}" for c, d, v, f in cases)
    return f"{ctes + ', ' if ctes else ''}hits AS ({every}), sig AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY variant, direction DESC, filter_value NULLS FIRST, bar_idx) AS sig_seq FROM hits)"


def _whole(ctes: str) -> str:
    return f"WITH {BARS}, {PREP}, {ctes} SELECT pair, bar_idx, direction, variant, filter_value, round(entry_price, 4) + 0.0 AS entry_price, round(atr_pips, 3) + 0.0 AS atr_pips, sig_seq FROM sig"


_NONE = "NULL::DOUBLE"
_SMA_CTE = f"ma0 AS (SELECT *, CASE WHEN bar_idx >= 4 THEN avg(close) OVER {rows(5)} END AS f, CASE WHEN bar_idx >= 19 THEN avg(close) OVER {rows(20)} END AS s FROM prep), ma AS MATERIALIZED (SELECT *, lag(f) OVER ({BY}) AS pf, lag(s) OVER ({BY}) AS ps FROM ma0)"
SMA_SIGNALS = _signals([("pf <= ps AND f > s", 1, 5020, _NONE), ("pf >= ps AND f < s", -1, 5020, _NONE)], _SMA_CTE, "ma")


@query("st0_sma_crossover", _whole(SMA_SIGNALS))
def st0(spark, d):
    return _flat(S.sma_crossover(hourly(spark, d), PIP))


_EMA_CTE = f"{_seeds(5, 10, 30, 50, source='prep')}, em AS (SELECT *, " + ", ".join(f"CASE WHEN bar_idx >= {p - 1} THEN {_ema(p)} END AS e{p}" for p in (5, 10, 30, 50)) + f" FROM seeded), el AS MATERIALIZED (SELECT *, " + ", ".join(f"lag(e{p}) OVER ({BY}) AS p{p}" for p in (5, 10, 30, 50)) + " FROM em)"
EMA_SIGNALS = _signals([(f"p{f} {a} p{s} AND e{f} {b} e{s} AND bar_idx >= {s + 1}", w, 1000 * f + s, _NONE) for f in (5, 10) for s in (30, 50) for a, b, w in (("<=", ">", 1), (">=", "<", -1))], _EMA_CTE, "el")


@query("st1_ema_crossover", _whole(EMA_SIGNALS))
def st1(spark, d):
    return _flat(S.ema_crossover(hourly(spark, d), PIP, (5, 10), (30, 50)))


_RSI_CTE = _RSI.replace("FROM bars)", "FROM prep)") + f", rl AS MATERIALIZED (SELECT *, lag(rsi_14) OVER ({BY}) AS pr FROM rsi)"
RSI_SIGNALS = _signals([(f"bar_idx >= 29 AND pr >= {t} AND rsi_14 < {t}", 1, 14, f"{t}::DOUBLE") for t in range(15, 41, 5)] + [(f"bar_idx >= 29 AND pr <= {t} AND rsi_14 > {t}", -1, 14, f"{t}::DOUBLE") for t in range(60, 86, 5)], _RSI_CTE, "rl")


def _wilder(x: str, p: int) -> str:
    return smooth(x, f"s{x}{p}", p, f"(1 - 1e0 / {p})", f"(1e0 / {p})")


_RSIS = S.RSI_PERIODS
_RSI_GRID = f"""mv AS (SELECT *, close - lag(close) OVER ({BY}) AS mv FROM prep), gl AS (SELECT *, greatest(mv, 0e0) AS g, greatest(-mv, 0e0) AS l FROM mv),
 sd AS (SELECT *, {', '.join(f'avg({x}) OVER {rows(p)} AS s{x}{p}' for p in _RSIS for x in 'gl')} FROM gl),
 sm AS (SELECT *, {', '.join(f'{_wilder(x, p)} AS a{x}{p}' for p in _RSIS for x in 'gl')} FROM sd),
 rsi AS (SELECT *, {', '.join(f'CASE WHEN bar_idx >= {p} THEN CASE WHEN al{p} = 0 THEN 100e0 ELSE 100 - 100 / (1 + ag{p} / al{p}) END END AS r{p}' for p in _RSIS)} FROM sm),
 rl AS MATERIALIZED (SELECT *, {', '.join(f'lag(r{p}) OVER ({BY}) AS p{p}' for p in _RSIS)} FROM rsi)"""
_RSI_RULES = [x for p in _RSIS for t in range(15, 41, 5) for x in ((f"bar_idx >= 29 AND p{p} >= {t} AND r{p} < {t}", 1, p, f"{t}::DOUBLE"), (f"bar_idx >= 29 AND p{p} <= {t + 45} AND r{p} > {t + 45}", -1, p, f"{t + 45}::DOUBLE"))]


@query("st2_rsi_mean_reversion", _whole(_signals(_RSI_RULES, _RSI_GRID, "rl")))
def st2(spark, d):
    return _flat(S.rsi_mean_reversion(hourly(spark, d), PIP))


_FAST, _SLOW, _SIGNAL = (5, 8, 12, 16), (21, 26, 30, 40, 50), (5, 7, 9, 12)
_LINES = [(f, w) for f in _FAST for w in _SLOW]
_MACD_GRID = f"""{_seeds(*_FAST, *_SLOW, source='prep')}, em AS (SELECT *, {', '.join(f'{_ema(p)} AS e{p}' for p in (*_FAST, *_SLOW))} FROM seeded),
 mc AS (SELECT *, {', '.join(f'CASE WHEN bar_idx >= {w - 1} THEN e{f} - e{w} END AS m{f}_{w}' for f, w in _LINES)} FROM em),
 ms AS (SELECT *, {', '.join(f'avg(m{f}_{w}) OVER {rows(g)} AS s{f}_{w}_{g}' for f, w in _LINES for g in _SIGNAL)} FROM mc),
 mg AS (SELECT *, {', '.join(f"CASE WHEN bar_idx >= {w + g - 2} THEN {smooth(f'm{f}_{w}', f's{f}_{w}_{g}', w + g - 2, f'(1 - 2e0 / {g + 1})', f'(2e0 / {g + 1})')} END AS g{f}_{w}_{g}" for f, w in _LINES for g in _SIGNAL)} FROM ms),
 ml AS MATERIALIZED (SELECT *, {', '.join(f'lag(m{f}_{w}) OVER ({BY}) AS pm{f}_{w}' for f, w in _LINES)}, {', '.join(f'lag(g{f}_{w}_{g}) OVER ({BY}) AS pg{f}_{w}_{g}' for f, w in _LINES for g in _SIGNAL)} FROM mg)"""
_MACD_RULES = [
    (f"bar_idx >= {w + g + 1} AND pm{f}_{w} {a} pg{f}_{w}_{g} AND m{f}_{w} {b} g{f}_{w}_{g}", d, 10_000 * f + 100 * w + g, _NONE)
    for f, w in _LINES for g in _SIGNAL for a, b, d in (("<=", ">", 1), (">=", "<", -1))
]


@query("st3_macd_crossover", _whole(_signals(_MACD_RULES, _MACD_GRID, "ml")))
def st3(spark, d):
    return _flat(S.macd_crossover(hourly(spark, d), PIP))


_BB_CTE = f"bb0 AS (SELECT *, avg(close) OVER {rows(20)} AS m, stddev_pop(close) OVER {rows(20)} AS sd FROM prep), bb AS MATERIALIZED (SELECT *, lag(close) OVER ({BY}) AS pc, lag(m) OVER ({BY}) AS pm, lag(sd) OVER ({BY}) AS psd FROM bb0)"


@query("st4_bollinger_reversion", _whole(_signals([x for k in (1.5, 2.0) for x in ((f"bar_idx >= 21 AND pc >= pm - {k}::DOUBLE * psd AND close < m - {k}::DOUBLE * sd", 1, 2000 + int(10 * k), _NONE), (f"bar_idx >= 21 AND pc <= pm + {k}::DOUBLE * psd AND close > m + {k}::DOUBLE * sd", -1, 2000 + int(10 * k), _NONE))], _BB_CTE, "bb")))
def st4(spark, d):
    return _flat(S.bollinger_reversion(hourly(spark, d), PIP, (20,), (1.5, 2.0)))


_KS, _DS = (5, 7, 9, 14, 21), (3, 5, 7)
_BOTH = [(k, d) for k in _KS for d in _DS]
_STOCH = f"""hl AS (SELECT *, {', '.join(f'max(high) OVER {rows(k)} AS hh{k}, min(low) OVER {rows(k)} AS ll{k}' for k in _KS)} FROM prep),
 sk AS (SELECT *, {', '.join(f'CASE WHEN bar_idx >= {k - 1} THEN CASE WHEN hh{k} = ll{k} THEN 50e0 ELSE 100 * (close - ll{k}) / (hh{k} - ll{k}) END END AS k{k}' for k in _KS)} FROM hl),
 sd AS (SELECT *, {', '.join(f'CASE WHEN bar_idx >= {k + d - 2} THEN avg(k{k}) OVER {rows(d)} END AS d{k}_{d}' for k, d in _BOTH)} FROM sk),
 sl AS MATERIALIZED (SELECT *, {', '.join(f'lag(k{k}) OVER ({BY}) AS pk{k}' for k in _KS)}, {', '.join(f'lag(d{k}_{d}) OVER ({BY}) AS pd{k}_{d}' for k, d in _BOTH)} FROM sd)"""
_STOCH_RULES = [
    (f"bar_idx >= {k + d + 1} AND pk{k} {a} pd{k}_{d} AND k{k} {b} d{k}_{d} AND k{k} {c} {t}", w, 100 * k + d, f"{t}::DOUBLE")
    for k, d in _BOTH for a, b, c, w, levels in (("<=", ">", "<", 1, (15, 20, 25, 30)), (">=", "<", ">", -1, (70, 75, 80, 85))) for t in levels
]


@query("st5_stochastic_crossover", _whole(_signals(_STOCH_RULES, _STOCH, "sl")))
def st5(spark, d):
    return _flat(S.stochastic_crossover(hourly(spark, d), PIP))


_ADX_CTE = _ADX.replace(_TR + ", ", "").replace(_atr(14) + ", ", "").replace("FROM atr)", "FROM prep)") + f", al AS MATERIALIZED (SELECT *, lag(plus_di) OVER ({BY}) AS pp, lag(minus_di) OVER ({BY}) AS pm FROM adx)"


@query("st6_adx_trend", _whole(_signals([x for t in (20, 25, 30, 35, 40) for x in ((f"bar_idx >= 43 AND pp <= pm AND plus_di > minus_di AND adx >= {t}", 1, 1400 + t, _NONE), (f"bar_idx >= 43 AND pp >= pm AND plus_di < minus_di AND adx >= {t}", -1, 1400 + t, _NONE))], _ADX_CTE, "al")))
def st6(spark, d):
    return _flat(S.adx_trend(hourly(spark, d), PIP, (14,)))


_DC_CTE = f"dc0 AS (SELECT *, max(high) OVER {rows(20)} AS hh, min(low) OVER {rows(20)} AS ll FROM prep), dc AS MATERIALIZED (SELECT *, lag(CASE WHEN bar_idx >= 19 THEN hh END) OVER ({BY}) AS ph, lag(CASE WHEN bar_idx >= 19 THEN ll END) OVER ({BY}) AS pl, lag(close) OVER ({BY}) AS pc FROM dc0)"
DC_SIGNALS = _signals([("bar_idx >= 21 AND close > ph AND pc <= ph", 1, 20, _NONE), ("bar_idx >= 21 AND close < pl AND pc >= pl", -1, 20, _NONE)], _DC_CTE, "dc")


_DCS = (10, 15, 20, 30, 40, 50, 60)
_DC_GRID = f"""dg AS (SELECT *, {', '.join(f'CASE WHEN bar_idx >= {p - 1} THEN max(high) OVER {rows(p)} END AS h{p}, CASE WHEN bar_idx >= {p - 1} THEN min(low) OVER {rows(p)} END AS l{p}' for p in _DCS)} FROM prep),
 dl AS MATERIALIZED (SELECT *, lag(close) OVER ({BY}) AS pc, {', '.join(f'lag(h{p}) OVER ({BY}) AS ph{p}, lag(l{p}) OVER ({BY}) AS pl{p}' for p in _DCS)} FROM dg)"""
_DC_RULES = [x for p in _DCS for x in ((f"bar_idx >= {p + 1} AND close > ph{p} AND pc <= ph{p}", 1, p, _NONE), (f"bar_idx >= {p + 1} AND close < pl{p} AND pc >= pl{p}", -1, p, _NONE))]


@query("st7_donchian_breakout", _whole(_signals(_DC_RULES, _DC_GRID, "dl")))
def st7(spark, d):
    return _flat(S.donchian_breakout(hourly(spark, d), PIP))


def _smash_bars(p: int) -> str:
    """Bars with the ATR of a period and what the two bars before were."""
    before = ", ".join(f"lag({x}, {n}) OVER ({BY}) AS {x[0]}{n}" for x, n in (("open", 1), ("high", 1), ("low", 1), ("close", 1), ("close", 2)))
    return f"{_atr(p, name=f'atr{p}')}, hs{p} AS (SELECT pair, bar_idx, high, low, close, coalesce(lead(open) OVER ({BY}), close) AS entry_price, atr{p} / 1e-2 AS atr_pips, {p} AS p, {before} FROM atr{p})"


_HS_CTE = f"{', '.join(map(_smash_bars, (10, 14, 20)))}, hs AS MATERIALIZED (SELECT * FROM hs10 UNION ALL SELECT * FROM hs14 UNION ALL SELECT * FROM hs20)"
_PLACE = "CASE WHEN h1 > l1 THEN (c1 - l1) / (h1 - l1) END"
_HS_RULES = [
    x for b in (0, 1) for s in (15, 20, 25, 30, 35, 40) for x in (
        (f"bar_idx >= 22 AND c1 > c2 AND {_PLACE} <= {s} / 100e0 AND close > h1" + " AND c1 < o1" * b, 1, f"(10000 * p + {1000 * b + s})", _NONE),
        (f"bar_idx >= 22 AND c1 < c2 AND {_PLACE} >= 1 - {s} / 100e0 AND close < l1" + " AND c1 > o1" * b, -1, f"(10000 * p + {1000 * b + s})", _NONE),
    )
]


@query("st8_hidden_smash_day", _whole(_signals(_HS_RULES, _HS_CTE, "hs")))
def st8(spark, d):
    return _flat(S.hidden_smash_day(hourly(spark, d), PIP))


_A5, _A10 = "(1 - 1e0 / 5)", "(1 - 1e0 / 10)"
_ST9 = f"""v0 AS (SELECT * EXCLUDE (entry_price), close AS entry_price, avg(close) OVER {rows(3)} AS _seed3, avg(close) OVER {rows(8)} AS _seed8, avg(close) OVER {rows(5)} AS _seed5, avg(close) OVER {rows(13)} AS _seed13,
  close - lag(close) OVER ({BY}) AS mv, avg(close) OVER {rows(10)} AS bm, stddev_pop(close) OVER {rows(10)} AS bs, max(high) OVER {rows(5)} AS h5, min(low) OVER {rows(5)} AS l5,
  max(high) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS top, min(low) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS bottom,
  CASE WHEN bar_idx = 0 THEN 0e0 ELSE greatest(high - low, abs(high - lag(close) OVER ({BY})), abs(low - lag(close) OVER ({BY}))) END AS t, high - lag(high) OVER ({BY}) AS u, lag(low) OVER ({BY}) - low AS dn FROM prep),
 v1 AS (SELECT *, greatest(mv, 0e0) AS g, greatest(-mv, 0e0) AS l, CASE WHEN u > dn AND u > 0 THEN u ELSE 0e0 END AS p, CASE WHEN dn > u AND dn > 0 THEN dn ELSE 0e0 END AS n,
  CASE WHEN bar_idx >= 2 THEN {_ema(3)} END AS e3, CASE WHEN bar_idx >= 7 THEN {_ema(8)} END AS e8, CASE WHEN bar_idx >= 12 THEN ({_ema(5)}) - ({_ema(13)}) END AS mc, CASE WHEN bar_idx >= 4 THEN CASE WHEN h5 = l5 THEN 50e0 ELSE 100 * (close - l5) / (h5 - l5) END END AS k FROM v0),
 v2 AS (SELECT *, avg(g) OVER {rows(5)} AS sg, avg(l) OVER {rows(5)} AS sl, avg(mc) OVER {rows(5)} AS sm, CASE WHEN bar_idx >= 6 THEN avg(k) OVER {rows(3)} END AS dd, sum(t) OVER {rows(10)} AS st, sum(p) OVER {rows(10)} AS sp, sum(n) OVER {rows(10)} AS sn FROM v1),
 v3 AS (SELECT *, {smooth('g', 'sg', 5, _A5, '(1e0 / 5)')} AS ag, {smooth('l', 'sl', 5, _A5, '(1e0 / 5)')} AS al, CASE WHEN bar_idx >= 16 THEN {smooth('mc', 'sm', 16, '(1 - 2e0 / 6)', '(2e0 / 6)')} END AS ms,
  {smooth('t', 'st', 10, _A10, '1')} AS wt, {smooth('p', 'sp', 10, _A10, '1')} AS wp, {smooth('n', 'sn', 10, _A10, '1')} AS wn FROM v2),
 v4 AS (SELECT *, CASE WHEN bar_idx >= 6 THEN CASE WHEN al = 0 THEN 100 - 100 / 101e0 ELSE 100 - 100 / (1 + ag / al) END END AS rsi, CASE WHEN bar_idx > 10 AND wt > 0 THEN 100 * wp / wt ELSE 0 END AS pd, CASE WHEN bar_idx > 10 AND wt > 0 THEN 100 * wn / wt ELSE 0 END AS md FROM v3),
 v5 AS (SELECT *, CASE WHEN bar_idx > 10 AND pd + md > 0 THEN 100 * abs(pd - md) / (pd + md) ELSE 0 END AS dx FROM v4), v6 AS (SELECT *, avg(dx) OVER {rows(11)} AS sdx FROM v5),
 v7 AS (SELECT *, CASE WHEN bar_idx >= 21 THEN {smooth('dx', 'sdx', 21, _A10, '(1e0 / 10)')} END AS adx FROM v6),
 vv AS MATERIALIZED (SELECT *, lag(e3) OVER o AS pe3, lag(e8) OVER o AS pe8, lag(rsi) OVER o AS pr, lag(mc) OVER o AS pmc, lag(ms) OVER o AS pms, lag(close) OVER o AS pc, lag(bm) OVER o AS pbm, lag(bs) OVER o AS pbs, lag(k) OVER o AS pk, lag(dd) OVER o AS pdd, lag(pd) OVER o AS ppd, lag(md) OVER o AS pmd FROM v7 WINDOW o AS ({BY}))"""
_ST9_RULES = [
    ("bar_idx >= 9 AND pe3 <= pe8 AND e3 > e8", 1, 1), ("bar_idx >= 9 AND pe3 >= pe8 AND e3 < e8", -1, 1),
    ("bar_idx >= 7 AND pr >= 30 AND rsi < 30", 1, 2), ("bar_idx >= 7 AND pr <= 70 AND rsi > 70", -1, 2),
    ("bar_idx >= 20 AND pmc <= pms AND mc > ms", 1, 3), ("bar_idx >= 20 AND pmc >= pms AND mc < ms", -1, 3),
    ("bar_idx >= 11 AND pc >= pbm - 15e-1 * pbs AND close < bm - 15e-1 * bs", 1, 4), ("bar_idx >= 11 AND pc <= pbm + 15e-1 * pbs AND close > bm + 15e-1 * bs", -1, 4),
    ("bar_idx >= 8 AND pk <= pdd AND k > dd AND k < 25", 1, 5), ("bar_idx >= 8 AND pk >= pdd AND k < dd AND k > 75", -1, 5),
    ("bar_idx >= 22 AND adx >= 15 AND ppd <= pmd AND pd > md", 1, 6), ("bar_idx >= 22 AND adx >= 15 AND ppd >= pmd AND pd < md", -1, 6),
    ("bar_idx >= 11 AND close > top", 1, 7), ("bar_idx >= 11 AND close < bottom", -1, 7),
]


@query("st9_verification_modes", _whole(_signals([(*r, _NONE) for r in _ST9_RULES], _ST9, "vv")))
def st9(spark, d):
    return _flat(S.verification_modes(hourly(spark, d), PIP))


@query("st10_always_buy", f"WITH {BARS} SELECT pair, bar_idx, 1::INTEGER AS direction, (-1)::BIGINT AS variant, NULL::DOUBLE AS filter_value, round(close, 4) + 0.0 AS entry_price, 30.0::DOUBLE AS atr_pips, bar_idx AS sig_seq FROM bars WHERE bar_idx >= 1")
def st10(spark, d):
    return _flat(S.always_buy(hourly(spark, d), PIP))


def _two(spark, d):
    return S.union_all([S.sma_crossover(hourly(spark, d), PIP), S.donchian_breakout(hourly(spark, d), PIP, (20,))])


_TWO = SMA_SIGNALS.replace("hits AS", "hits1 AS").replace(", sig AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY variant, direction DESC, filter_value NULLS FIRST, bar_idx) AS sig_seq FROM hits)", "") + ", " + DC_SIGNALS.replace("FROM hits)", "FROM (SELECT * FROM hits UNION ALL SELECT * FROM hits1))")


@query("set2_union_signals", _whole(_TWO))
def set2(spark, d):
    return _flat(_two(spark, d))


#: trial, variant, days (mask), start, end, max spread.
TRIALS = ((0, 5020, 127, 0, 23, 0.0), (1, -1, 31, 8, 17, 0.02), (2, 20, 127, 22, 6, 0.025), (3, -1, 96, 0, 23, 0.01))


def _trials(spark):
    return spark.createDataFrame(list(TRIALS), "trial int, t_variant long, mask long, start int, finish int, max_spread double")


_VALUES = ", ".join(map(str, TRIALS))


@query("f_trial_filters", f"""WITH {BARS}, {PREP}, {_TWO}, t(trial, t_variant, mask, start, finish, max_spread) AS (VALUES {_VALUES})
 SELECT s.pair, s.bar_idx, s.direction, s.variant, t.trial FROM (SELECT sig.*, b.spread, isodow(make_timestamp(b.ts_s * 1000000)) - 1 AS dow, hour(make_timestamp(b.ts_s * 1000000)) AS hr FROM sig JOIN bars b ON b.pair = sig.pair AND b.bar_idx = sig.bar_idx) s JOIN t
 ON (t.t_variant < 0 OR t.t_variant = s.variant) AND (t.mask::INTEGER >> dow::INTEGER) & 1 = 1 AND CASE WHEN start <= finish THEN hr BETWEEN start AND finish ELSE hr >= start OR hr <= finish END AND (max_spread <= 0 OR s.spread <= max_spread)""")
def f_trial_filters(spark, d):
    """variant, weekday, hour and spread filters of four trials."""
    s = _two(spark, d).join(hourly(spark, d).select("pair", "bar_idx", "spread"), ["pair", "bar_idx"])
    c = F.col
    cond = FI.time_passes(c("day_of_week"), c("hour"), c("mask"), c("start"), c("finish")) & FI.spread_passes(c("spread"), c("max_spread"))
    return T.evaluate_by_variant(s, _trials(spark), cond).select("pair", "bar_idx", "direction", "variant", "trial")


@query("f2_value_filter", f"WITH {BARS}, {PREP}, {RSI_SIGNALS} SELECT pair, bar_idx, direction, filter_value FROM sig WHERE filter_value = CASE WHEN direction > 0 THEN 30 ELSE 70 END")
def f2(spark, d):
    s = S.rsi_mean_reversion(hourly(spark, d), PIP, (14,))
    return s.where(FI.value_passes(F.col("direction"), F.col("filter_value"), F.lit(30.0), F.lit(70.0))).select("pair", "bar_idx", "direction", "filter_value")


@query("f6_window_slice", f"WITH {BARS}, {PREP}, {SMA_SIGNALS}, w(window_id, a, z) AS (VALUES (0, 100, 300), (1, 250, 500)) SELECT pair, window_id, bar_idx, bar_idx - a AS window_bar, direction FROM sig JOIN w ON bar_idx >= a AND bar_idx < z")
def f6(spark, d):
    w = spark.createDataFrame([(0, 100, 300), (1, 250, 500)], "window_id int, start_bar long, end_bar long")
    return FI.slice_window(S.sma_crossover(hourly(spark, d), PIP), w).select("pair", "window_id", "bar_idx", "window_bar", "direction")


@query("f7_kept_bars", f"WITH {BARS}, {PREP}, {_TWO} SELECT pair, bar_idx, direction, variant FROM sig WHERE bar_idx IN (SELECT bar_idx FROM bars WHERE bars.pair = sig.pair AND bars.close > bars.open)")
def f7(spark, d):
    bars = hourly(spark, d)
    return FI.on_kept_bars(_two(spark, d), bars.where("close > open")).select("pair", "bar_idx", "direction", "variant")


#: sl_mode, sl value, tp_mode, tp value of the stop variants.
STOPS = (("fixed_pips", 1500.0, 1.0, "rr_ratio", 2.0, 2.0, 1000.0), ("atr_based", 1500.0, 1.5, "atr_based", 2.0, 1.0, 1000.0), ("swing", 1500.0, 1.0, "fixed_pips", 2.0, 2.0, 1000.0))
_STOP_COLS = "sl_mode, sl_fixed_pips, sl_atr_mult, tp_mode, tp_rr_ratio, tp_atr_mult, tp_fixed_pips"
_PAST = f"({BY} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"


@query("p1_p2_stops", f"""WITH {BARS}, {PREP}, {SMA_SIGNALS}, sw AS (SELECT pair, bar_idx, min(low) OVER {_PAST} AS rl, max(high) OVER {_PAST} AS rh FROM bars), t({_STOP_COLS}) AS (VALUES {', '.join(map(str, STOPS))}),
 j AS (SELECT s.pair, s.bar_idx, s.direction, t.sl_mode, t.tp_mode, t.tp_rr_ratio, t.tp_atr_mult, t.tp_fixed_pips, s.atr_pips, CASE sl_mode WHEN 'fixed_pips' THEN sl_fixed_pips WHEN 'atr_based' THEN s.atr_pips * sl_atr_mult ELSE coalesce(greatest(abs(entry_price - CASE WHEN direction > 0 THEN rl ELSE rh END) / 1e-2, 5), s.atr_pips * 1.5) END AS sl
  FROM sig s JOIN sw ON sw.pair = s.pair AND sw.bar_idx = s.bar_idx CROSS JOIN t)
 SELECT pair, bar_idx, direction, sl_mode, round(sl, 3) + 0.0 AS sl_pips, round(greatest(CASE tp_mode WHEN 'rr_ratio' THEN sl * tp_rr_ratio WHEN 'atr_based' THEN atr_pips * tp_atr_mult ELSE tp_fixed_pips END, sl), 3) + 0.0 AS tp_pips FROM j""")
def p1(spark, d):
    bars = I.recent_swing(hourly(spark, d)).select("pair", "bar_idx", "recent_low", "recent_high")
    t = spark.createDataFrame(list(STOPS), "sl_mode string, sl_fixed_pips double, sl_atr_mult double, tp_mode string, tp_rr_ratio double, tp_atr_mult double, tp_fixed_pips double")
    r = sltp.with_stops(T.evaluate(S.sma_crossover(hourly(spark, d), PIP).join(bars, ["pair", "bar_idx"]), t), PIP)
    return r.select("pair", "bar_idx", "direction", "sl_mode", tidy(F.col("sl_pips"), 3).alias("sl_pips"), tidy(F.col("tp_pips"), 3).alias("tp_pips"))


def basic_trades(spark, d):
    """Trades of the moving-average signals with stops of 1500 and 4000 pips and targets of twice that."""
    bars = settled(hourly(spark, d))
    t = spark.createDataFrame([(0, 15.0), (1, 40.0)], "trial int, dist double")
    r = T.evaluate(S.sma_crossover(bars, PIP), t).withColumns({"sl": F.col("entry_price") - F.col("direction") * F.col("dist"), "tp": F.col("entry_price") + 2 * F.col("direction") * F.col("dist"), "sl_pips": F.col("dist") / PIP})
    return T.simulate_basic(r, bars, sub_bars(spark, d, bars), PIP)


BASIC = f"""{SUBS}, {PREP}, {SMA_SIGNALS}, tr0 AS (SELECT s.*, t.trial, t.dist, entry_price - direction * dist AS sl, entry_price + 2 * direction * dist AS tp FROM sig s CROSS JOIN (VALUES (0, 15e0), (1, 40e0)) t(trial, dist)),
 fs AS (SELECT pair, bar_idx, arg_min(spread, sub_seq) AS sp FROM subs GROUP BY ALL),
 tr1 AS (SELECT t.*, CASE WHEN direction > 0 THEN entry_price + 0.5 * 1e-2 + coalesce(sp, 0) ELSE entry_price - 0.5 * 1e-2 END AS fill FROM tr0 t LEFT JOIN fs ON fs.pair = t.pair AND fs.bar_idx = t.bar_idx),
 touch AS (SELECT t.pair, t.sig_seq, t.trial, min(CASE WHEN (CASE WHEN direction > 0 THEN low <= sl ELSE high >= sl END) THEN sub_seq END) AS qs, min(CASE WHEN (CASE WHEN direction > 0 THEN high >= tp ELSE low <= tp END) THEN sub_seq END) AS qt
  FROM tr1 t JOIN subs u ON u.pair = t.pair AND u.bar_idx > t.bar_idx GROUP BY ALL),
 ends AS (SELECT pair, max(bar_idx) AS last_bar, arg_max(close, sub_seq) AS last_close, arg_max(spread, sub_seq) AS last_spread FROM subs GROUP BY pair),
 ex AS (SELECT t.*, e.*EXCLUDE (pair), CASE WHEN qs IS NULL AND qt IS NULL THEN 'none' WHEN qt IS NULL OR qs <= qt THEN 'sl' ELSE 'tp' END AS reason, least(qs, qt) AS q FROM tr1 t JOIN ends e ON e.pair = t.pair LEFT JOIN touch c ON c.pair = t.pair AND c.sig_seq = t.sig_seq AND c.trial = t.trial),
 done AS MATERIALIZED (SELECT x.pair, x.sig_seq, x.trial, x.bar_idx, direction, reason, fill, dist / 1e-2 AS sl_pips, CASE WHEN reason = 'none' THEN greatest(last_bar, x.bar_idx) ELSE u.bar_idx END AS exit_bar,
  CASE reason WHEN 'sl' THEN sl - direction * 0.5 * 1e-2 WHEN 'tp' THEN tp ELSE last_close - direction * 0.5 * 1e-2 END AS exit_price, CASE WHEN reason = 'none' THEN last_spread ELSE u.spread END AS xs
  FROM ex x LEFT JOIN subs u ON u.pair = x.pair AND u.sub_seq = x.q),
 trades AS MATERIALIZED (SELECT *, direction * (exit_price - fill) / 1e-2 - CASE WHEN direction < 0 THEN xs / 1e-2 ELSE 0 END - 0.7 AS pnl FROM done)"""


@query("tr2_basic_simulation", f"WITH {BASIC} SELECT pair, sig_seq, trial, direction, reason, exit_bar, round(fill, 4) + 0.0 AS fill, round(exit_price, 4) + 0.0 AS exit_price, round(pnl, 3) + 0.0 AS pnl FROM trades")
def tr2(spark, d):
    return basic_trades(spark, d).select("pair", "sig_seq", "trial", "direction", "reason", "exit_bar", *(tidy(F.col(c), n).alias(c) for c, n in (("fill", 4), ("exit_price", 4), ("pnl", 3))))


@query("tr12_excursions", f"""WITH {BASIC} SELECT t.pair, t.sig_seq, t.trial, t.exit_bar - t.bar_idx AS bars_held, round(greatest(coalesce(max(CASE WHEN direction > 0 THEN high - fill ELSE fill - low END), 0) / 1e-2, 0), 3) + 0.0 AS mfe, round(greatest(coalesce(max(CASE WHEN direction > 0 THEN fill - low ELSE high - fill END), 0) / 1e-2, 0), 3) + 0.0 AS mae
 FROM trades t LEFT JOIN bars b ON b.pair = t.pair AND b.bar_idx > t.bar_idx AND b.bar_idx <= t.exit_bar GROUP BY t.pair, t.sig_seq, t.trial, t.exit_bar, t.bar_idx""")
def tr12(spark, d):
    t = basic_trades(spark, d).withColumn("trade_id", F.concat_ws("/", "pair", "sig_seq", "trial"))
    return T.excursions(t, hourly(spark, d), PIP).select("pair", "sig_seq", "trial", "bars_held", tidy(F.col("mfe"), 3).alias("mfe"), tidy(F.col("mae"), 3).alias("mae"))


@query("flagship_sma_metrics", f"WITH {BASIC}, {metric_sql('trades', 'pair, trial', 'sig_seq', sl='avg(sl_pips)')} SELECT pair, trial, trades, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in M.METRICS[1:]) + " FROM mq")
def flagship(spark, d):
    """Hourly bars, SMA(5)/SMA(20) crossover, fixed stops, ten metrics per pair and trial."""
    m = M.metrics(basic_trades(spark, d), ["pair", "trial"], ["sig_seq"], sl_pips="sl_pips")
    return m.select("pair", "trial", "trades", *(tidy(F.col(c), 4).alias(c) for c in M.METRICS[1:]))


def grid_trades(spark, d):
    """The moving-average signals under 200 trials: 20 stop distances by 10 reward ratios; n_bars is the length of the pair's series."""
    bars = settled(hourly(spark, d))
    t = spark.range(200).select(F.col("id").cast("int").alias("trial"), (5.0 + 2.5 * F.floor(F.col("id") / 10)).alias("dist"), (1.0 + 0.25 * (F.col("id") % 10)).alias("rr"))
    r = T.evaluate(S.sma_crossover(bars, PIP), t).withColumns({"sl": F.col("entry_price") - F.col("direction") * F.col("dist"), "tp": F.col("entry_price") + F.col("rr") * F.col("direction") * F.col("dist"), "sl_pips": F.col("dist") / PIP})
    sized = bars.groupBy("pair").agg(F.count("*").alias("n_bars"))
    return T.simulate_basic(r, bars, sub_bars(spark, d, bars), PIP).join(F.broadcast(sized), "pair")  # a row for each pair


_GRID = BASIC.replace("(VALUES (0, 15e0), (1, 40e0)) t(trial, dist)", "(SELECT i::INTEGER AS trial, 5e0 + 25e-1 * (i // 10) AS dist, 1e0 + 25e-2 * (i % 10) AS rr FROM range(200) r(i)) t").replace("SELECT s.*, t.trial, t.dist,", "SELECT s.*, t.trial, t.dist, t.rr,").replace("entry_price + 2 * direction * dist AS tp", "entry_price + rr * direction * dist AS tp")


#: Metrics of the batch: trades a year are those of the series' length in hours.
_BATCH = "sized AS (SELECT t.*, n.n_bars FROM trades t JOIN (SELECT pair, count(*) AS n_bars FROM bars GROUP BY pair) n ON n.pair = t.pair), "
_BATCH += metric_sql("sized", "pair, trial", "sig_seq", annual="count(*) * 6048.0::DOUBLE / max(n_bars)", sl="avg(sl_pips)")


@query("tr13_batch_evaluation", f"WITH {_GRID}, {_BATCH} SELECT pair, trial, trades, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in M.METRICS[1:]) + " FROM mq")
def tr13(spark, d):
    """Ten metrics of 200 trials in one batch."""
    m = M.metrics(grid_trades(spark, d), ["pair", "trial"], ["sig_seq"], sl_pips="sl_pips", n_bars="n_bars")
    return m.select("pair", "trial", "trades", *(tidy(F.col(c), 4).alias(c) for c in M.METRICS[1:]))


_BY_REGIME = _REGIME.replace(_TR + ", ", "").replace(_atr(14) + ", ", "") + """, tt AS (
  SELECT t.pair, f.v AS regime, t.bar_idx, t.sig_seq, t.pnl FROM trades t JOIN run r ON r.pair = t.pair AND r.bar_idx = t.bar_idx JOIN fold f ON f.pair = r.pair AND f.run = r.run WHERE t.trial = 0 AND f.v >= 0),
 te AS (SELECT *, sum(pnl) OVER (PARTITION BY pair, regime ORDER BY bar_idx, sig_seq) AS eq FROM tt), tp AS (SELECT *, max(eq) OVER (PARTITION BY pair, regime ORDER BY bar_idx, sig_seq) AS peak FROM te),
 ta AS (SELECT pair, regime, count(*) AS n, avg((pnl > 0)::INT) AS w, avg(pnl) AS m, stddev_pop(pnl) AS s, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS g, sum(CASE WHEN pnl <= 0 THEN -pnl ELSE 0 END) AS l, max(peak - eq) AS dd, max(peak) AS top FROM tp GROUP BY ALL)
 SELECT pair, regime, n, round(100 * w, 4) + 0.0 AS win_pct, round(CASE WHEN s > 0 THEN m / s * sqrt(n) ELSE 0 END, 4) + 0.0 AS sharpe, round(CASE WHEN l > 0 THEN g / l WHEN g > 0 THEN 'Infinity'::DOUBLE ELSE 0 END, 4) + 0.0 AS profit_factor,
  round(CASE WHEN top > 0 THEN 100 * dd / top ELSE 100 END, 4) + 0.0 AS max_dd_pct, n >= 5 AS sufficient FROM ta"""


@query("j5_v15_regime_statistics", f"WITH RECURSIVE {BASIC}, {_BY_REGIME}")
def v15(spark, d):
    t = basic_trades(spark, d).where("trial = 0").withColumn("trade_id", F.col("sig_seq"))
    st = R.regime_statistics(t, R.classify(hourly(spark, d)), 5)
    return st.select("pair", "regime", "n", *(tidy(F.col(c), 4).alias(c) for c in ("win_pct", "sharpe", "profit_factor", "max_dd_pct")), "sufficient")


_NAMED = "CASE x " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in R.NAMES.items()) + " END"
_ROBUST = _BY_REGIME.rsplit("\n SELECT pair, regime", 1)[0] + f""",
 st AS (SELECT pair, regime, CASE WHEN s > 0 THEN m / s * sqrt(n) ELSE 0 END AS sharpe, CASE WHEN top > 0 THEN 100 * dd / top ELSE 100 END AS dd FROM ta WHERE n >= 5),
 us AS (SELECT pair, count(*) AS n, sum((sharpe > 0)::INT) AS good, max(dd) AS dd, avg(sharpe) AS m, stddev_pop(sharpe) AS s,
   list(regime ORDER BY regime) FILTER (sharpe > 0) AS up, list(regime ORDER BY regime) FILTER (sharpe < 0) AS weak FROM st GROUP BY pair),
 nt AS (SELECT *, array_to_string(list_transform(up, lambda x: {_NAMED}), ', ') AS ups, array_to_string(list_transform(weak, lambda x: {_NAMED}), ', ') AS weaks,
   CASE WHEN abs(m) > 1e-10 THEN least(greatest(1 - (abs(s / m) - 0.5) / 1.5, 0), 1) ELSE 0 END AS spread FROM us)
 SELECT pair, round(40.0::DOUBLE * good / n + CASE WHEN dd < 40 THEN 30 WHEN dd < 60 THEN 30 * (1 - (dd - 40) / 20) ELSE 0 END + CASE WHEN n >= 2 THEN 30 * spread ELSE 15 END, 4) + 0.0 AS score,
   concat_ws('; ', CASE WHEN good = 0 THEN 'no regime is profitable' WHEN good = 1 AND n > 1 THEN 'profitable in one regime only: ' || ups WHEN good = n THEN 'profitable in every regime' END,
     CASE WHEN dd > 40 THEN printf('worst drawdown %.1f %%', dd) END, CASE WHEN len(weak) > 0 THEN 'weak in ' || weaks END) AS note FROM nt"""


@query("v16_robustness", f"WITH RECURSIVE {BASIC}, {_ROBUST}")
def v16(spark, d):
    t = basic_trades(spark, d).where("trial = 0").withColumn("trade_id", F.col("sig_seq"))
    r = R.robustness(R.regime_statistics(t, R.classify(hourly(spark, d)), 5))
    return r.select("pair", tidy(F.col("score"), 4).alias("score"), "note")
