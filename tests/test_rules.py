"""Rules on labels, filters and scores against plain loops and hand values."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import filters, metrics, regime, search, validation


def literal_smoothing(labels, k):
    out = list(labels)
    i = 0
    while i < len(out):
        j = i + 1
        while j < len(out) and labels[j] == labels[i]:
            j += 1
        v = labels[i]
        if v != -1 and j - i < k:
            earlier = [x for x in reversed(out[:i]) if x not in (-1, v)]
            if earlier:
                out[i:j] = [earlier[0]] * (j - i)
        i = j
    return out


def test_short_runs_take_the_last_other_label(spark):
    rng = random.Random(1)
    labels = [-1] * 5
    while len(labels) < 900:
        labels += [rng.choice([0, 1, 2, 3, 3, -1])] * rng.choice([1, 2, 5, 9, 20])
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(labels)], "pair string, bar_idx long, v int")
    got = [r["out"] for r in regime.smooth(df, "v", "out", 8).orderBy("bar_idx").collect()]
    assert got == literal_smoothing(labels, 8)


def test_robustness_of_one_and_of_no_good_regime(spark):
    rows = [("a", 0, 40, 50.0, 1.0, 2.0, 10.0, True), ("a", 3, 40, 50.0, -1.0, 0.5, 50.0, True), ("b", 1, 40, 50.0, 2.0, 3.0, 5.0, True), ("b", 2, 3, 0.0, -9.0, 0.0, 100.0, False)]
    st = spark.createDataFrame(rows, "pair string, regime int, n long, win_pct double, sharpe double, profit_factor double, max_dd_pct double, sufficient boolean")
    got = {r["pair"]: (round(r["score"], 6), r["note"]) for r in regime.robustness(st).collect()}
    assert got["a"][0] == 40 * 0.5 + 30 * 0.5 and "one regime only: ranging_quiet" in got["a"][1] and "50.0 %" in got["a"][1]
    assert got["b"] == (40 + 30 + 15, "profitable in every regime")


@pytest.mark.parametrize("start,end,hour,ok", [(8, 17, 8, True), (8, 17, 17, True), (8, 17, 18, False), (22, 6, 23, True), (22, 6, 6, True), (22, 6, 12, False)])
def test_hours_wrap_around(spark, start, end, hour, ok):
    r = spark.range(1).select(filters.time_passes(F.lit(0), F.lit(hour), F.lit(1), F.lit(start), F.lit(end)).alias("x"), filters.time_passes(F.lit(1), F.lit(hour), F.lit(1), F.lit(start), F.lit(end)).alias("other_day")).first()
    assert r["x"] is ok and r["other_day"] is False


def test_spread_filter_rejects_unknown_spreads(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (0.5, 1.0), (2.0, 1.0), (2.0, 0.0), (None, None)], "s double, m double")
    assert [r[0] for r in df.select(filters.spread_passes(F.col("s"), F.col("m"))).collect()] == [False, False, True, False, True, True]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate([30.0, -10.0, 20.0, -10.0])], "key string, seq int, pnl double")
    m = metrics.metrics(df, ["key"], ["seq"]).first()
    assert m["trades"] == 4 and m["win_rate"] == 0.5 and m["profit_factor"] == 2.5
    assert abs(m["max_dd_pct"] - 25.0) < 1e-9 and abs(m["return_pct"] - 100.0) < 1e-9
    one = metrics.metrics(df.where("seq = 0"), ["key"], ["seq"]).first()
    assert one["profit_factor"] == 10.0 and one["sharpe"] == 0.0 and one["sortino"] == 10.0 and one["max_dd_pct"] == 0.0
    empty = metrics.with_empty(metrics.metrics(df, ["key"], ["seq"]), spark.createDataFrame([("k",), ("none",)], "key string"), ["key"])
    assert {r["key"]: r["trades"] for r in empty.collect()} == {"k": 4, "none": 0}


def test_day_masks_agree(spark):
    df = spark.createDataFrame([([0, 1, 2, 3, 4],), ([5],), ([],)], "d array<int>")
    assert [r[0] for r in df.select(filters.day_mask(F.col("d"))).collect()] == [search.days_to_mask(x) for x in ([0, 1, 2, 3, 4], [5], [])]


def test_stability_without_perturbations_is_robust(spark):
    r = spark.range(1).select(validation.stability_rating(F.lit(0.0), F.lit(0.0), F.lit(0)).alias("a"), validation.stability_rating(F.lit(0.9), F.lit(0.4), F.lit(3)).alias("b"), validation.stability_rating(F.lit(0.3), F.lit(0.4), F.lit(3)).alias("c")).first()
    assert tuple(r) == ("ROBUST", "MODERATE", "OVERFIT")


def test_unknown_names_raise(spark):
    from quantloom.operators import bars

    with pytest.raises(ValueError):
        bars.split(spark.range(1), "none")
    with pytest.raises(ValueError):
        bars.resample_all(spark.range(1), ["X9"])


@pytest.mark.parametrize("pnl,want", [([-100.0, 90.0], 100.0), ([10.0, -60.0, 55.0, -3.0], 120.0), ([-50.0, 20.0, -80.0, 100.0, 5.0], 100.0)])
def test_drawdown_is_held_against_the_largest_equity_ever(spark, pnl, want):
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(pnl)], "key string, seq int, pnl double")
    assert abs(metrics.metrics(df, ["key"], ["seq"]).first()["max_dd_pct"] - want) < 1e-9


def test_batch_annualisation(spark):
    df = spark.createDataFrame([("k", i, x, 100) for i, x in enumerate([30.0, -10.0, 20.0, -10.0])], "key string, seq int, pnl double, bars long")
    plain = metrics.metrics(df, ["key"], ["seq"], annual=1.0).first()
    batch = metrics.metrics(df, ["key"], ["seq"], n_bars="bars", bars_per_year=2500.0).first()
    assert abs(batch["sharpe"] - plain["sharpe"] * 10) < 1e-9 and abs(batch["sortino"] - plain["sortino"] * 10) < 1e-9
