"""Indicators as window plans.

Every function takes a bar table and returns it with more columns; null is warm-up.
Fixed windows are ROWS frames.  Recursive smoothing is an affine map per row, so it is summed by
lags that double (``recurrences``), with the partitioning of the other windows and no join.
``keys`` partition the series, ``bar_idx`` is the dense position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.bars import KEYS

LAST_DIGIT = 1e-18


def _by(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("bar_idx")


def _rows(keys: Sequence[str], period: int):
    return _by(keys).rowsBetween(-(period - 1), 0)


def _warm(x: Column, period: int, start: int = 0) -> Column:
    return F.when(F.col("bar_idx") >= start + period - 1, x)


def rolling(bars: DataFrame, fn: str, col: str, period: int, out: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """max, min, avg, sum or stddev_pop of the last ``period`` rows."""
    return bars.withColumn(out, _warm(getattr(F, fn)(col).over(_rows(keys, period)), period))


def sma(bars: DataFrame, period: int, col: str = "close", out: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    return rolling(bars, "avg", col, period, out or f"sma_{period}", keys)


def true_range(bars: DataFrame, out: str = "tr", keys: Sequence[str] = KEYS) -> DataFrame:
    last = F.lag("close").over(_by(keys))
    return bars.withColumn(out, F.when(last.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))))


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    w = _rows(keys, period)
    mid, dev = F.avg("close").over(w), F.stddev_pop("close").over(w)
    return bars.withColumns({"bb_mid": _warm(mid, period), "bb_upper": _warm(mid + width * dev, period), "bb_lower": _warm(mid - width * dev, period)})


def stochastic(bars: DataFrame, k: int = 14, d: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    w = _rows(keys, k)
    high, low = F.max("high").over(w), F.min("low").over(w)
    bars = bars.withColumn("stoch_k", _warm(F.when(high == low, 50.0).otherwise(100 * (F.col("close") - low) / (high - low)), k))
    return bars.withColumn("stoch_d", _warm(F.avg("stoch_k").over(_rows(keys, d)), d, k - 1))


def williams_r(bars: DataFrame, period: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    w = _rows(keys, period)
    high, low = F.max("high").over(w), F.min("low").over(w)
    return bars.withColumn("williams_r", _warm(F.when(high == low, -50.0).otherwise(-100 * (high - F.col("close")) / (high - low)), period))


def donchian(bars: DataFrame, period: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    w = _rows(keys, period)
    high, low = F.max("high").over(w), F.min("low").over(w)
    return bars.withColumns({"dc_upper": _warm(high, period), "dc_lower": _warm(low, period), "dc_mid": _warm((high + low) / 2, period)})


def cci(bars: DataFrame, period: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    w = _rows(keys, period)
    bars = bars.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    bars = bars.withColumns({"_list": F.collect_list("_tp").over(w), "_mean": F.avg("_tp").over(w)})
    dev = F.aggregate("_list", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_mean"))) / period
    return bars.withColumn("cci", _warm(F.when(dev == 0, 0.0).otherwise((F.col("_tp") - F.col("_mean")) / (0.015 * dev)), period)).drop("_tp", "_list", "_mean")


def swings(bars: DataFrame, lookback: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """swing_high / swing_low: the centre's price if it is the extreme of ``lookback`` rows either side.  Looks ahead."""
    w = _by(keys).rowsBetween(-lookback, lookback)
    full = (F.col("bar_idx") >= lookback) & (F.lead("bar_idx", lookback).over(_by(keys)).isNotNull())
    return bars.withColumns({"swing_high": F.when(full & (F.col("high") == F.max("high").over(w)), F.col("high")), "swing_low": F.when(full & (F.col("low") == F.min("low").over(w)), F.col("low"))})


def recent_swing(bars: DataFrame, lookback: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """recent_low / recent_high of the rows before; null at the first."""
    w = _by(keys).rowsBetween(-lookback, -1)
    return bars.withColumns({"recent_low": F.min("low").over(w), "recent_high": F.max("high").over(w)})


def percent_rank(bars: DataFrame, col: str, period: int = 100, out: str = "pct_rank", keys: Sequence[str] = KEYS) -> DataFrame:
    """Share in per cent of the last ``period`` values that don't exceed the current one; null until there are as many."""
    bars = bars.withColumn("_list", F.collect_list(col).over(_rows(keys, period)))
    full = F.size("_list") == period
    return bars.withColumn(out, F.when(full & F.col(col).isNotNull(), 100.0 * F.size(F.filter("_list", lambda x: x <= F.col(col))) / period)).drop("_list")


def recurrences(bars: DataFrame, maps: dict[str, tuple[float, Column]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Columns x with x[i] = a * x[i-1] + b[i], x[-1] = 0, for each name: (a, b); b is never null and a lies in (0, 1).

    The sum of the last n terms gives that of the last 2n: s + a^n * s as it was n rows before.  So a few lags, each twice as far,
    reach back until a^n is below the last digit of a double.  All series share the windows, which
    have the partitioning and order that the other indicators use: nothing is shuffled again, and no table joined to itself.
    """
    w = _by(keys)
    bars = bars.withColumns({n: b for n, (_, b) in maps.items()})
    reach = 1
    while more := {n: a for n, (a, _) in maps.items() if a**reach > LAST_DIGIT}:
        bars = bars.withColumns({n: F.col(n) + F.lit(a**reach) * F.coalesce(F.lag(n, reach).over(w), F.lit(0.0)) for n, a in more.items()})
        reach *= 2
    return bars


def _seeded(x: Column, seed: Column, at: int, weight: float) -> Column:
    """b of a smoothing that starts with ``seed`` at position ``at`` and then adds weight * x."""
    return F.when(F.col("bar_idx") < at, 0.0).when(F.col("bar_idx") == at, F.coalesce(seed, F.lit(0.0))).otherwise(weight * F.coalesce(x, F.lit(0.0)))


def _ema_map(col: str, period: int, keys: Sequence[str], start: int = 0) -> tuple[float, Column]:
    alpha = 2.0 / (period + 1)
    return 1 - alpha, _seeded(F.col(col), F.avg(col).over(_rows(keys, period)), start + period - 1, alpha)


def ema(bars: DataFrame, periods: Sequence[int], col: str = "close", keys: Sequence[str] = KEYS) -> DataFrame:
    """ema_<p> for each period: seeded with the mean of the first p; all periods share one scan."""
    maps = {f"ema_{p}": _ema_map(col, p, keys) for p in periods if p > 1}
    out = recurrences(bars, maps, keys) if maps else bars
    out = out.withColumns({f"ema_{p}": _warm(F.col(f"ema_{p}"), p) for p in periods if p > 1})
    return out.withColumns({"ema_1": F.col(col)}) if 1 in periods else out


def atr(bars: DataFrame, period: int = 14, out: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Wilder's average true range: seeded with the mean of the first p true ranges."""
    out = out or f"atr_{period}"
    bars = true_range(bars, "_tr", keys)
    bars = recurrences(bars, {out: (1 - 1.0 / period, _seeded(F.col("_tr"), F.avg("_tr").over(_rows(keys, period)), period - 1, 1.0 / period))}, keys) if period > 1 else bars.withColumn(out, F.col("_tr"))
    return bars.withColumn(out, _warm(F.col(out), period)).drop("_tr")


def rsi(bars: DataFrame, period: int = 14, out: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Wilder's RSI: seeded at position p with the means of the first p moves; 100 where there is no average loss."""
    out = out or f"rsi_{period}"
    move = F.col("close") - F.lag("close").over(_by(keys))
    bars = bars.withColumn("_m", move).withColumns({"_g": F.greatest(F.col("_m"), F.lit(0.0)), "_l": F.greatest(-F.col("_m"), F.lit(0.0))})
    maps = {f"_a{c}": (1 - 1.0 / period, _seeded(F.col(f"_{c}"), F.avg(f"_{c}").over(_rows(keys, period)), period, 1.0 / period)) for c in "gl"}
    bars = recurrences(bars, maps, keys)
    return bars.withColumn(out, _warm(F.when(F.col("_al") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_ag") / F.col("_al"))), period + 1)).drop("_m", "_g", "_l", "_ag", "_al")


def rsi_grid(bars: DataFrame, periods: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """rsi_<p> for each period in one scan."""
    move = F.col("close") - F.lag("close").over(_by(keys))
    bars = bars.withColumn("_m", move).withColumns({"_g": F.greatest(F.col("_m"), F.lit(0.0)), "_l": F.greatest(-F.col("_m"), F.lit(0.0))})
    maps = {f"_a{c}{p}": (1 - 1.0 / p, _seeded(F.col(f"_{c}"), F.avg(f"_{c}").over(_rows(keys, p)), p, 1.0 / p)) for p in periods for c in "gl"}
    bars = recurrences(bars, maps, keys)
    value = lambda p: F.when(F.col(f"_al{p}") == 0, 100.0).otherwise(100 - 100 / (1 + F.col(f"_ag{p}") / F.col(f"_al{p}")))
    return bars.withColumns({f"rsi_{p}": _warm(value(p), p + 1) for p in periods}).drop("_m", "_g", "_l", *maps)


def macd_grid(bars: DataFrame, fast: Sequence[int], slow: Sequence[int], signal: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """macd_<f>_<s> and signal_<f>_<s>_<g> of every combination in two scans: all averages, then all signals."""
    bars = recurrences(bars, {f"_e{p}": _ema_map("close", p, keys) for p in sorted({*fast, *slow})}, keys)
    bars = bars.withColumns({f"macd_{f}_{s}": _warm(F.col(f"_e{f}") - F.col(f"_e{s}"), s) for f in fast for s in slow}).drop(*(f"_e{p}" for p in {*fast, *slow}))
    every = [(f, s, g) for f in fast for s in slow for g in signal]
    bars = recurrences(bars, {f"signal_{f}_{s}_{g}": _ema_map(f"macd_{f}_{s}", g, keys, s - 1) for f, s, g in every}, keys)
    return bars.withColumns({f"signal_{f}_{s}_{g}": _warm(F.col(f"signal_{f}_{s}_{g}"), s + g - 1) for f, s, g in every})


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys: Sequence[str] = KEYS) -> DataFrame:
    """macd, macd_signal (an EMA over the valid part) and macd_hist."""
    bars = recurrences(bars, {"_f": _ema_map("close", fast, keys), "_s": _ema_map("close", slow, keys)}, keys)
    bars = bars.withColumn("macd", _warm(F.col("_f") - F.col("_s"), slow)).drop("_f", "_s")
    bars = recurrences(bars, {"macd_signal": _ema_map("macd", signal, keys, slow - 1)}, keys)
    bars = bars.withColumn("macd_signal", _warm(F.col("macd_signal"), slow + signal - 1))
    return bars.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def adx(bars: DataFrame, period: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    """adx, plus_di, minus_di.  Smoothed moves start with the sum of the first p; ADX with the mean of the first p values of DX.

    A DX that doesn't exist (no directional movement at all) leaves ADX null from there on.
    """
    w = _by(keys)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    bars = bars.withColumns({"_u": up, "_d": down}).withColumns({"_p": F.when((F.col("_u") > F.col("_d")) & (F.col("_u") > 0), F.col("_u")).otherwise(0.0), "_n": F.when((F.col("_d") > F.col("_u")) & (F.col("_d") > 0), F.col("_d")).otherwise(0.0)})
    a = 1 - 1.0 / period
    bars = atr(bars, period, "_atr", keys)
    maps = {f"_s{c}": (a, _seeded(F.col(f"_{c}"), F.sum(f"_{c}").over(_rows(keys, period)), period, 1.0)) for c in "pn"}
    bars = recurrences(bars, maps, keys)
    di = lambda c: _warm(F.when(F.col("_atr") > 0, 100 * F.col(c) / (F.col("_atr") * period)).otherwise(0.0), period + 1)
    bars = bars.withColumns({"plus_di": di("_sp"), "minus_di": di("_sn")})
    total = F.col("plus_di") + F.col("minus_di")
    bars = bars.withColumn("_dx", F.when(total > 0, 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / total))
    first = 2 * period - 1
    bars = recurrences(bars, {"adx": (a, _seeded(F.col("_dx"), F.avg("_dx").over(_rows(keys, period)), first, 1.0 / period))}, keys)
    broken = F.max(F.when((F.col("bar_idx") >= period) & F.col("_dx").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return bars.withColumn("adx", F.when((F.col("bar_idx") >= first) & ~broken, F.col("adx"))).drop("_u", "_d", "_p", "_n", "_atr", "_sp", "_sn", "_dx")


def rsi_late(bars: DataFrame, period: int, out: str = "rsi_late", keys: Sequence[str] = KEYS) -> DataFrame:
    """RSI as the verification strategy takes it: a position later, and a relative strength of 100 where there is no average loss."""
    bars = rsi(bars, period, out, keys)
    return bars.withColumn(out, F.when(F.col("bar_idx") > period, F.when(F.col(out) == 100.0, 100 - 100 / F.lit(101.0)).otherwise(F.col(out))))


def adx_late(bars: DataFrame, period: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """ADX as the verification strategy takes it: adx_late, plus_late, minus_late.

    The first bar has no range; true ranges and moves are smoothed as sums from
    position p; directional indexes are 0 up to there; ADX starts at 2p + 1 with the mean of p + 1 values.
    """
    w, a = _by(keys), 1 - 1.0 / period
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    bars = true_range(bars, "_t", keys).withColumns({"_t": F.when(F.col("bar_idx") == 0, 0.0).otherwise(F.col("_t")), "_u": up, "_d": down})
    bars = bars.withColumns({"_p": F.when((F.col("_u") > F.col("_d")) & (F.col("_u") > 0), F.col("_u")).otherwise(0.0), "_n": F.when((F.col("_d") > F.col("_u")) & (F.col("_d") > 0), F.col("_d")).otherwise(0.0)})
    bars = recurrences(bars, {f"_s{c}": (a, _seeded(F.col(f"_{c}"), F.sum(f"_{c}").over(_rows(keys, period)), period, 1.0)) for c in "tpn"}, keys)
    di = lambda c: F.when((F.col("bar_idx") > period) & (F.col("_st") > 0), 100 * F.col(c) / F.col("_st")).otherwise(0.0)
    bars = bars.withColumns({"plus_late": di("_sp"), "minus_late": di("_sn")})
    total = F.col("plus_late") + F.col("minus_late")
    bars = bars.withColumn("_dx", F.when((F.col("bar_idx") > period) & (total > 0), 100 * F.abs(F.col("plus_late") - F.col("minus_late")) / total).otherwise(0.0))
    first = 2 * period + 1
    bars = recurrences(bars, {"adx_late": (a, _seeded(F.col("_dx"), F.avg("_dx").over(_rows(keys, period + 1)), first, 1.0 / period))}, keys)
    return bars.withColumn("adx_late", F.when(F.col("bar_idx") >= first, F.col("adx_late"))).drop("_t", "_u", "_d", "_p", "_n", "_st", "_sp", "_sn", "_dx")


def keltner(bars: DataFrame, period: int = 20, atr_period: int = 10, width: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    bars = atr(ema(bars, [period], keys=keys), atr_period, "_atr", keys)
    mid = F.col(f"ema_{period}")
    return bars.withColumns({"kc_mid": mid, "kc_upper": mid + width * F.col("_atr"), "kc_lower": mid - width * F.col("_atr")}).drop("_atr", f"ema_{period}")


def supertrend(bars: DataFrame, period: int = 10, width: float = 3.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """supertrend and st_dir (1 up, -1 down, 0 in warm-up).

    The final bands depend on their own past, which no window frame can express: each
    series is folded on its own by a grouped map over four columns.
    """
    mid = (F.col("high") + F.col("low")) / 2
    bars = atr(bars, period, "_atr", keys).withColumns({"_up": mid + width * F.col("_atr"), "_dn": mid - width * F.col("_atr")})

    def fold(pdf):
        import numpy as np

        pdf = pdf.sort_values("bar_idx")
        up, dn, close = pdf["_up"].to_numpy(float), pdf["_dn"].to_numpy(float), pdf["close"].to_numpy(float)
        line, way = np.full(len(pdf), np.nan), np.zeros(len(pdf), int)
        hi = lo = last = 0.0
        state = 0
        for i in range(len(pdf)):
            if np.isnan(up[i]):
                continue
            if not state:
                hi, lo, state = up[i], dn[i], -1
            else:
                hi = up[i] if up[i] < hi or last > hi else hi
                lo = dn[i] if dn[i] > lo or last < lo else lo
                state = (1 if close[i] > hi else -1) if state < 0 else (-1 if close[i] < lo else 1)
            line[i], way[i], last = (lo if state > 0 else hi), state, close[i]
        return pdf[[*keys, "bar_idx"]].assign(supertrend=line, st_dir=way)

    few = bars.select(*keys, "bar_idx", "close", "_up", "_dn")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.select(*keys, "bar_idx").schema)
    folded = few.groupBy(*keys).applyInPandas(fold, f"{schema}, supertrend double, st_dir long").withColumn("supertrend", F.when(~F.isnan("supertrend"), F.col("supertrend")))
    return bars.drop("_atr", "_up", "_dn").join(folded, [*keys, "bar_idx"])
