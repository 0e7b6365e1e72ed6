"""Signal generators: predicates over indicator windows, one row per bar, direction and variant.

A signal at bar t enters at the open of t + 1 (the close of t on the last bar), and needs
a positive ATR.  Columns: pair, bar_idx, ts, direction, entry_price, atr_pips, variant,
filter_value, hour, day_of_week, sig_seq.  ``sig_seq`` is the order in which results are
accumulated: variant, then buys before sells (and threshold), then bar.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import indicators as I
from quantloom.operators.bars import KEYS

EMA_FAST, EMA_SLOW = (3, 5, 8, 10, 13, 15, 20, 25, 30, 40, 50), (30, 50, 75, 100, 150, 200, 250, 300)
RSI_PERIODS = (5, 7, 9, 11, 14, 18, 21, 28)


def _by():
    return Window.partitionBy(*KEYS).orderBy("bar_idx")


def _prev(c: str) -> Column:
    return F.lag(c).over(_by())


def prepared(bars: DataFrame, pip: float, atr_period: int = 14, enter: str = "next_open") -> DataFrame:
    """Bars with entry_price, atr_pips, hour and day_of_week."""
    bars = I.atr(bars, atr_period, "_atr")
    entry = F.coalesce(F.lead("open").over(_by()), F.col("close")) if enter == "next_open" else F.col("close")
    return bars.withColumns({"entry_price": entry, "atr_pips": F.col("_atr") / pip, "hour": F.hour("ts"), "day_of_week": F.weekday("ts")}).drop("_atr")


def emit(rows: DataFrame, sides: Sequence[tuple[Column, int, Column, Column]], warmup: Column | int = 0) -> DataFrame:
    """One row for each (condition, direction, variant, filter value) that holds on a bar past the warm-up."""
    none = F.lit(None).cast("struct<direction:int,variant:bigint,filter_value:double>")
    made = [F.when(c, F.struct(F.lit(d).alias("direction"), v.cast("long").alias("variant"), f.cast("double").alias("filter_value"))).otherwise(none) for c, d, v, f in sides]
    hits = F.filter(F.array(*made), lambda x: x.isNotNull())
    out = rows.where((F.col("atr_pips") > 0) & (F.col("bar_idx") >= warmup)).withColumn("_s", F.explode(hits))
    return out.select("pair", "bar_idx", "ts", "_s.direction", "entry_price", "atr_pips", "_s.variant", "_s.filter_value", "hour", "day_of_week")


def ordered(signals: DataFrame) -> DataFrame:
    w = Window.partitionBy("pair").orderBy("variant", F.desc("direction"), "filter_value", "bar_idx")
    return signals.withColumn("sig_seq", F.row_number().over(w).cast("long"))


def _none() -> Column:
    return F.lit(None).cast("double")


def crosses(a: str, b: str | Column) -> tuple[Column, Column]:
    """a crosses above b, below b, from the bar before to this one."""
    b_now = F.col(b) if isinstance(b, str) else b
    b_before = _prev(b) if isinstance(b, str) else b
    up = (_prev(a) <= b_before) & (F.col(a) > b_now)
    down = (_prev(a) >= b_before) & (F.col(a) < b_now)
    return up, down


def ema_crossover(bars: DataFrame, pip: float, fast: Sequence[int] = EMA_FAST, slow: Sequence[int] = EMA_SLOW) -> DataFrame:
    rows = I.ema(prepared(bars, pip), sorted({*fast, *slow}))
    pairs = [(f, s) for f in fast for s in slow if f < s]
    flags = {f"_u{f}_{s}": crosses(f"ema_{f}", f"ema_{s}")[0] & (F.col("bar_idx") >= s + 1) for f, s in pairs} | {f"_d{f}_{s}": crosses(f"ema_{f}", f"ema_{s}")[1] & (F.col("bar_idx") >= s + 1) for f, s in pairs}
    rows = rows.withColumns(flags)
    sides = [x for f, s in pairs for x in ((F.col(f"_u{f}_{s}"), 1, F.lit(1000 * f + s), _none()), (F.col(f"_d{f}_{s}"), -1, F.lit(1000 * f + s), _none()))]
    return ordered(emit(rows, sides))


def sma_crossover(bars: DataFrame, pip: float, fast: int = 5, slow: int = 20) -> DataFrame:
    rows = I.sma(I.sma(prepared(bars, pip), fast), slow)
    up, down = crosses(f"sma_{fast}", f"sma_{slow}")
    rows = rows.withColumns({"_u": up, "_d": down})
    code = F.lit(1000 * fast + slow)
    return ordered(emit(rows, [(F.col("_u"), 1, code, _none()), (F.col("_d"), -1, code, _none())]))


def rsi_mean_reversion(bars: DataFrame, pip: float, periods: Sequence[int] = RSI_PERIODS, oversold: Sequence[int] = tuple(range(15, 41, 5)), overbought: Sequence[int] = tuple(range(60, 86, 5))) -> DataFrame:
    rows = I.rsi_grid(prepared(bars, pip), periods)
    rows = rows.withColumns({f"_p{p}": _prev(f"rsi_{p}") for p in periods})
    sides = []
    for p in periods:
        now, before = F.col(f"rsi_{p}"), F.col(f"_p{p}")
        sides += [((before >= t) & (now < t), 1, F.lit(p), F.lit(float(t))) for t in oversold]
        sides += [((before <= t) & (now > t), -1, F.lit(p), F.lit(float(t))) for t in overbought]
    return ordered(emit(rows, sides, 29))


def macd_crossover(bars: DataFrame, pip: float, fast: Sequence[int] = (5, 8, 12, 16), slow: Sequence[int] = (21, 26, 30, 40, 50), signal: Sequence[int] = (5, 7, 9, 12)) -> DataFrame:
    rows = I.macd_grid(prepared(bars, pip), fast, slow, signal)
    made, sides = {}, []
    for f in fast:
        for s in slow:
            for g in signal:
                up, down = crosses(f"macd_{f}_{s}", f"signal_{f}_{s}_{g}")
                late = F.col("bar_idx") >= s + g + 1
                n = f"{f}_{s}_{g}"
                made |= {f"_u{n}": up & late, f"_d{n}": down & late}
                code = F.lit(10_000 * f + 100 * s + g)
                sides += [(F.col(f"_u{n}"), 1, code, _none()), (F.col(f"_d{n}"), -1, code, _none())]
    return ordered(emit(rows.withColumns(made), sides))


def bollinger_reversion(bars: DataFrame, pip: float, periods: Sequence[int] = (10, 15, 20, 25, 30), widths: Sequence[float] = (1.5, 2.0, 2.5, 3.0)) -> DataFrame:
    rows = prepared(bars, pip)
    sides = []
    for p in periods:
        for k in widths:
            rows = I.bollinger(rows, p, k)
            n = f"{p}_{int(10 * k)}"
            late = F.col("bar_idx") >= p + 1
            rows = rows.withColumns({f"_d{n}": crosses("close", "bb_lower")[1] & late, f"_u{n}": crosses("close", "bb_upper")[0] & late}).drop("bb_mid", "bb_upper", "bb_lower")
            code = F.lit(100 * p + int(10 * k))
            sides += [(F.col(f"_d{n}"), 1, code, _none()), (F.col(f"_u{n}"), -1, code, _none())]
    return ordered(emit(rows, sides))


def stochastic_crossover(bars: DataFrame, pip: float, k: Sequence[int] = (5, 7, 9, 14, 21), d: Sequence[int] = (3, 5, 7), oversold: Sequence[int] = (15, 20, 25, 30), overbought: Sequence[int] = (70, 75, 80, 85)) -> DataFrame:
    rows = prepared(bars, pip)
    sides = []
    for a in k:
        for b in d:
            rows = I.stochastic(rows, a, b)
            up, down = crosses("stoch_k", "stoch_d")
            n, late = f"{a}_{b}", F.col("bar_idx") >= a + b + 1
            rows = rows.withColumns({f"_u{n}": up & late, f"_d{n}": down & late, f"_k{n}": F.col("stoch_k")}).drop("stoch_k", "stoch_d")
            code = F.lit(100 * a + b)
            sides += [(F.col(f"_u{n}") & (F.col(f"_k{n}") < t), 1, code, F.lit(float(t))) for t in oversold]
            sides += [(F.col(f"_d{n}") & (F.col(f"_k{n}") > t), -1, code, F.lit(float(t))) for t in overbought]
    return ordered(emit(rows, sides))


def adx_trend(bars: DataFrame, pip: float, periods: Sequence[int] = (10, 14, 20, 28), thresholds: Sequence[int] = (20, 25, 30, 35, 40)) -> DataFrame:
    rows = prepared(bars, pip)
    sides = []
    for p in periods:
        rows = I.adx(rows, p)
        up, down = crosses("plus_di", "minus_di")
        late = F.col("bar_idx") >= 3 * p + 1
        rows = rows.withColumns({f"_u{p}": up & late, f"_d{p}": down & late, f"_a{p}": F.col("adx")}).drop("adx", "plus_di", "minus_di")
        for t in thresholds:
            code = F.lit(100 * p + t)
            strong = F.col(f"_a{p}") >= t
            sides += [(F.col(f"_u{p}") & strong, 1, code, _none()), (F.col(f"_d{p}") & strong, -1, code, _none())]
    return ordered(emit(rows, sides))


def donchian_breakout(bars: DataFrame, pip: float, periods: Sequence[int] = (10, 15, 20, 30, 40, 50, 60)) -> DataFrame:
    rows = prepared(bars, pip)
    sides = []
    for p in periods:
        rows = I.donchian(rows, p)
        top, bottom, before = _prev("dc_upper"), _prev("dc_lower"), _prev("close")
        late = F.col("bar_idx") >= p + 1
        rows = rows.withColumns({f"_u{p}": (F.col("close") > top) & (before <= top) & late, f"_d{p}": (F.col("close") < bottom) & (before >= bottom) & late}).drop("dc_upper", "dc_lower", "dc_mid")
        sides += [(F.col(f"_u{p}"), 1, F.lit(p), _none()), (F.col(f"_d{p}"), -1, F.lit(p), _none())]
    return ordered(emit(rows, sides))


def hidden_smash_day(bars: DataFrame, pip: float, atr_periods: Sequence[int] = (10, 14, 20), bodies: Sequence[int] = (0, 1), shares: Sequence[int] = (15, 20, 25, 30, 35, 40)) -> DataFrame:
    """Bar t-1 closes up but low in its range (for a buy), optionally with an opposite body; bar t closes beyond it.  Sells mirror."""
    out = None
    for p in atr_periods:
        rows = prepared(bars, pip, p)
        w = _by()
        o, h, l, c, c2 = (F.lag(x, n).over(w) for x, n in (("open", 1), ("high", 1), ("low", 1), ("close", 1), ("close", 2)))
        rows = rows.withColumns({"_o": o, "_h": h, "_l": l, "_c": c, "_c2": c2})
        place = F.when(F.col("_h") > F.col("_l"), (F.col("_c") - F.col("_l")) / (F.col("_h") - F.col("_l")))
        sides = []
        for b in bodies:
            for s in shares:
                code = F.lit(10_000 * p + 1000 * b + s)
                buy = (F.col("_c") > F.col("_c2")) & (place <= s / 100) & (F.col("close") > F.col("_h"))
                sell = (F.col("_c") < F.col("_c2")) & (place >= 1 - s / 100) & (F.col("close") < F.col("_l"))
                if b:
                    buy, sell = buy & (F.col("_c") < F.col("_o")), sell & (F.col("_c") > F.col("_o"))
                sides += [(buy, 1, code, _none()), (sell, -1, code, _none())]
        part = emit(rows, sides, 22)
        out = part if out is None else out.unionByName(part)
    return ordered(out)


def verification_modes(bars: DataFrame, pip: float, modes: Sequence[int] = (1, 2, 3, 4, 5, 6, 7)) -> DataFrame:
    """Seven quick rules that enter at the close of their own bar, for live-against-replay checks.

    1 EMA 3/8, 2 RSI 5 at 30/70, 3 MACD 5/13/5, 4 Bollinger 10 at 1.5, 5 stochastic 5/3
    below 25 and above 75, 6 ADX 10 from 15, 7 break of the ten bars before.
    """
    rows = I.ema(prepared(bars, pip, enter="close"), [3, 8])
    rows = I.adx_late(I.stochastic(I.bollinger(I.macd(I.rsi_late(rows, 5), 5, 13, 5), 10, 1.5), 5, 3), 10)
    before = _by().rowsBetween(-10, -1)
    rows = rows.withColumns({"_top": F.max("high").over(before), "_bottom": F.min("low").over(before), "_rsi": _prev("rsi_late")})
    c, late = F.col, lambda n: F.col("bar_idx") >= n
    up, down = {}, {}
    for m, pair, n in ((1, ("ema_3", "ema_8"), 9), (3, ("macd", "macd_signal"), 20), (5, ("stoch_k", "stoch_d"), 8), (6, ("plus_late", "minus_late"), 22)):
        x, y = crosses(*pair)
        up[m], down[m] = x & late(n), y & late(n)
    up[5], down[5] = up[5] & (c("stoch_k") < 25), down[5] & (c("stoch_k") > 75)
    up[6], down[6] = up[6] & (c("adx_late") >= 15), down[6] & (c("adx_late") >= 15)
    up[2], down[2] = (c("_rsi") >= 30) & (c("rsi_late") < 30) & late(7), (c("_rsi") <= 70) & (c("rsi_late") > 70) & late(7)
    up[4], down[4] = crosses("close", "bb_lower")[1] & late(11), crosses("close", "bb_upper")[0] & late(11)
    up[7], down[7] = (c("close") > c("_top")) & late(11), (c("close") < c("_bottom")) & late(11)
    rows = rows.withColumns({f"_{way}{m}": flags[m] for way, flags in (("u", up), ("d", down)) for m in modes})
    sides = [x for m in modes for x in ((F.col(f"_u{m}"), 1, F.lit(m), _none()), (F.col(f"_d{m}"), -1, F.lit(m), _none()))]
    return ordered(emit(rows, sides))


def always_buy(bars: DataFrame, pip: float) -> DataFrame:
    """A buy at the close of every bar but the first, ATR fixed at 30 pips."""
    rows = bars.withColumns({"entry_price": F.col("close"), "atr_pips": F.lit(30.0), "hour": F.hour("ts"), "day_of_week": F.weekday("ts")})
    return ordered(emit(rows, [(F.lit(True), 1, F.lit(-1), _none())], 1))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Signals of several generators in one table, numbered anew."""
    return ordered(reduce(lambda a, b: a.unionByName(b), [p.drop("sig_seq") for p in parts]))


def newest(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals on the last bar of each pair: what a live cycle acts on."""
    last = bars.groupBy("pair").agg(F.max("bar_idx").alias("bar_idx"))
    return signals.join(last, ["pair", "bar_idx"], "left_semi")
