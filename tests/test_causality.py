"""Plans that look ahead are told by their windows and by runs over a cut series."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from quantloom import causality, strategy
from quantloom.operators import indicators as I
from quantloom.operators import signals as S
from quantloom.plans.tables import hourly

PIP = 0.01


@pytest.fixture(scope="module")
def bars(spark):
    return hourly(spark, "/root/testdata/sf0.001").persist()


@pytest.mark.parametrize("name", strategy.names())
def test_every_strategy_is_accepted(bars, name):
    """The registered strategies over their whole parameter grids; recursive averages included."""
    assert strategy.get(name).generate(bars, PIP) is not None


def test_windows_that_look_ahead_are_refused(bars):
    w = Window.partitionBy("pair").orderBy("bar_idx")
    cases = {
        "swings": I.swings(bars).where("swing_low is not null"),
        "centred": bars.withColumn("x", F.avg("close").over(w.rowsBetween(-2, 2))).where("close > x"),
        "whole": bars.withColumn("x", F.avg("close").over(Window.partitionBy("pair"))).where("close > x"),
        "unbounded": bars.withColumn("x", F.max("high").over(w.rowsBetween(0, Window.unboundedFollowing))).where("close = x"),
        "lead": bars.withColumn("x", F.lead("close").over(w)).where("x > close"),
        "aggregate": bars.join(bars.groupBy("pair").agg(F.avg("close").alias("x")), "pair").where("close > x"),
    }
    for name, plan in cases.items():
        assert causality.look_ahead(plan), name
    both = bars.withColumn("n", F.lead("open").over(w)).select("pair", F.coalesce("n", "close").alias("entry_price"), (F.col("n") > F.col("close")).alias("up"))
    assert causality.look_ahead(both)
    assert causality.look_ahead(bars.select("pair", F.coalesce(F.lead("open").over(w), "close").alias("entry_price"))) == []
    with pytest.raises(ValueError, match="looks ahead"):
        strategy.Strategy("peek", lambda b, pip: cases["centred"]).generate(bars, PIP)


def test_runs_over_a_cut_series(bars):
    w = Window.partitionBy("pair").orderBy("bar_idx")
    none = F.lit(None).cast("double").alias("filter_value")

    def peek(b):
        return b.withColumn("x", F.lead("close", 3).over(w)).where("x > close").select("pair", "bar_idx", F.lit(1).alias("direction"), F.lit(0).alias("variant"), none)

    cut = bars.agg(F.max("bar_idx")).first()[0] // 2
    assert causality.prefix_differences(peek, bars, cut) > 0 and causality.prefix_differences(peek, bars, cut, shake=True) > 0
    for plan in (lambda b: S.sma_crossover(b, PIP), lambda b: S.ema_crossover(b, PIP, (5, 10), (30,)), lambda b: S.rsi_mean_reversion(b, PIP, (5, 7))):
        assert plan(bars).count() > 0
        assert causality.prefix_differences(plan, bars, cut) == 0 and causality.prefix_differences(plan, bars, cut, shake=True) == 0
