"""Recursive indicators against literal loops, over several scan blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import indicators as I

N = 1000


@pytest.fixture(scope="module")
def series():
    rng = random.Random(7)
    price, out = 100.0, []
    for i in range(N):
        o = price
        price = max(1.0, price + rng.gauss(0, 1))
        out.append((i, o, max(o, price) + rng.random(), min(o, price) - rng.random(), price))
    return out


@pytest.fixture(scope="module")
def bars(spark, series):
    rows = [("x", *r) for r in series]
    return spark.createDataFrame(rows, "pair string, bar_idx long, open double, high double, low double, close double")


def column(df, name):
    return [r[0] for r in df.orderBy("bar_idx").select(name).collect()]


def close_to(got, want):
    assert len(got) == len(want)
    for i, (a, b) in enumerate(zip(got, want, strict=True)):
        assert (a is None) == (b is None), (i, a, b)
        assert a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (i, a, b)


def ema(x, p):
    out = [None] * len(x)
    v = None
    for i in range(p - 1, len(x)):
        v = sum(x[:p]) / p if v is None else v + 2 / (p + 1) * (x[i] - v)
        out[i] = v
    return out


@pytest.mark.parametrize("period", [2, 5, 200])
def test_ema(bars, series, period):
    close_to(column(I.ema(bars, [period]), f"ema_{period}"), ema([r[4] for r in series], period))


def true_ranges(s):
    return [r[2] - r[3] if i == 0 else max(r[2] - r[3], abs(r[2] - s[i - 1][4]), abs(r[3] - s[i - 1][4])) for i, r in enumerate(s)]


def wilder(x, p):
    out = [None] * len(x)
    v = None
    for i in range(p - 1, len(x)):
        v = sum(x[:p]) / p if v is None else v * (p - 1) / p + x[i] / p
        out[i] = v
    return out


def test_atr(bars, series):
    close_to(column(I.atr(bars, 14), "atr_14"), wilder(true_ranges(series), 14))


def test_rsi(bars, series):
    c = [r[4] for r in series]
    d = [b - a for a, b in zip(c, c[1:], strict=False)]
    g, l = wilder([max(x, 0) for x in d], 14), wilder([max(-x, 0) for x in d], 14)
    want = [None] + [None if a is None else 100.0 if b == 0 else 100 - 100 / (1 + a / b) for a, b in zip(g, l, strict=True)]
    close_to(column(I.rsi(bars), "rsi_14"), want)


def test_rsi_of_flat_prices_is_100(spark):
    flat = spark.createDataFrame([("x", i, 1.0, 1.0, 1.0, 1.0) for i in range(30)], "pair string, bar_idx long, open double, high double, low double, close double")
    assert column(I.rsi(flat), "rsi_14")[14:] == [100.0] * 16


def test_macd(bars, series):
    c = [r[4] for r in series]
    m = [None if a is None or b is None else a - b for a, b in zip(ema(c, 12), ema(c, 26), strict=True)]
    s = [None] * 25 + ema(m[25:], 9)
    out = I.macd(bars)
    close_to(column(out, "macd"), m)
    close_to(column(out, "macd_signal"), s)


def test_adx(bars, series):
    p = 14
    tr = true_ranges(series)
    atr = wilder(tr, p)
    pdm, ndm = [0.0], [0.0]
    for a, b in zip(series, series[1:], strict=False):
        up, down = b[2] - a[2], a[3] - b[3]
        pdm.append(up if up > down and up > 0 else 0.0)
        ndm.append(down if down > up and down > 0 else 0.0)
    sp, sn = sum(pdm[1 : p + 1]), sum(ndm[1 : p + 1])
    dx, plus = [None] * N, [None] * N
    for i in range(p, N):
        if i > p:
            sp, sn = sp - sp / p + pdm[i], sn - sn / p + ndm[i]
        a, b = 100 * sp / (atr[i] * p), 100 * sn / (atr[i] * p)
        plus[i], dx[i] = a, 100 * abs(a - b) / (a + b)
    adx = [None] * (2 * p - 1) + wilder(dx[p:], p)[p - 1 :]
    out = I.adx(bars)
    close_to(column(out, "plus_di"), plus)
    close_to(column(out, "adx"), adx)


def test_causal_indicators_do_not_look_ahead(bars):
    """Changing the future leaves the past as it was."""
    cut = 600
    changed = bars.withColumns({c: F.when(F.col("bar_idx") >= cut, F.col(c) * 2).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    for f in (I.rsi, I.adx, I.macd, I.supertrend, I.keltner, I.cci, I.stochastic):
        a, b = f(bars).where(F.col("bar_idx") < cut), f(changed).where(F.col("bar_idx") < cut)
        assert a.orderBy("bar_idx").collect() == b.orderBy("bar_idx").collect(), f.__name__
