"""Market regimes of bars and statistics of trades by regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import indicators as I
from quantloom.operators.bars import KEYS

#: Labels: trend and volatility; -1 while warming up.
NAMES = {0: "ranging_quiet", 1: "ranging_volatile", 2: "trending_quiet", 3: "trending_volatile", -1: "unknown"}


def classify(bars: DataFrame, adx_period: int = 14, atr_period: int = 14, on: float = 25.0, off: float = 20.0, lookback: int = 100, volatile: float = 75.0, min_bars: int = 8) -> DataFrame:
    """regime_raw and regime (after runs shorter than ``min_bars`` took over the label before them).

    Trend is a hysteresis on ADX (on at 25, off below 20); volatility is the percentile
    rank of ATR over close within the last 100 bars.
    """
    w = Window.partitionBy(*KEYS).orderBy("bar_idx")
    rows = I.atr(I.adx(bars, adx_period), atr_period, "_atr").withColumn("_natr", F.col("_atr") / F.col("close"))
    rows = I.percent_rank(rows, "_natr", lookback, "_rank")
    turn = F.when(F.col("_rank").isNotNull(), F.when(F.col("adx") >= on, 1).when(F.col("adx") < off, 0))
    rows = rows.withColumn("_trend", F.coalesce(F.last(turn, ignorenulls=True).over(w), F.lit(0)))
    raw = F.when(F.col("adx").isNull() | F.col("_rank").isNull(), -1).otherwise(2 * F.col("_trend") + F.when(F.col("_rank") >= volatile, 1).otherwise(0))
    rows = rows.withColumn("regime_raw", raw).drop("_atr", "_natr", "_rank", "_trend", "plus_di", "minus_di")
    return smooth(rows, "regime_raw", "regime", min_bars)


def smooth(rows: DataFrame, col: str, out: str, min_bars: int) -> DataFrame:
    """Runs shorter than ``min_bars`` take the nearest earlier label that differs, as already smoothed.

    Without a differing one they keep theirs; unknown (-1) runs stay and are looked past.  Runs are found by windows;
    only (label, length) of each run is folded, with the last label and the last that differs from it.
    """
    w = Window.partitionBy(*KEYS).orderBy("bar_idx")
    step = F.when(F.lag(col).over(w) == F.col(col), 0).otherwise(1)
    rows = rows.withColumn("_step", step).withColumn("_run", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
    runs = rows.groupBy(*KEYS, "_run").agg(F.first(col).alias("v"), F.count("*").alias("n"))
    folded = runs.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("_run", "v", "n"))).alias("_all"))

    def step_run(state, x):
        other = F.when(state["last"] != x["v"], state["last"]).otherwise(state["before"])
        new = F.when((x["v"] != -1) & (x["n"] < min_bars) & (other != -1), other).otherwise(x["v"])
        moved = (new != -1) & (new != state["last"])
        return F.struct(F.array_append(state["all"], new).alias("all"), F.when(moved, new).otherwise(state["last"]).alias("last"), F.when(moved, state["last"]).otherwise(state["before"]).alias("before"))

    start = F.struct(F.array().cast("array<int>").alias("all"), F.lit(-1).alias("last"), F.lit(-1).alias("before"))
    fold = F.aggregate("_all", start, step_run, lambda state: state["all"])
    return rows.join(folded.select(*KEYS, fold.alias("_labels")), list(KEYS)).withColumn(out, F.get("_labels", (F.col("_run") - 1).cast("int"))).drop("_labels", "_run")


def regime_statistics(trades: DataFrame, bars: DataFrame, min_trades: int = 30) -> DataFrame:
    """Per pair and regime at entry: n, win_pct, sharpe (population sd times sqrt n), profit_factor, max_dd_pct, sufficient.

    Zero results count as losses; without losses the profit factor is infinite.
    Unknown regimes and trades without a bar go.
    """
    rows = trades.join(bars.select("pair", "bar_idx", "regime"), ["pair", "bar_idx"]).where("regime >= 0")
    w = Window.partitionBy("pair", "regime").orderBy("bar_idx", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_eq", F.sum("pnl").over(w)).withColumn("_peak", F.max("_eq").over(w))
    x = F.col("pnl")
    out = rows.groupBy("pair", "regime").agg(F.count("*").alias("n"), (100 * F.avg(F.when(x > 0, 1.0).otherwise(0.0))).alias("win_pct"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"), F.sum(F.when(x > 0, x).otherwise(0.0)).alias("_g"), F.sum(F.when(x <= 0, -x).otherwise(0.0)).alias("_l"), F.max(F.col("_peak") - F.col("_eq")).alias("_dd"), F.max("_peak").alias("_top"))
    return out.select("pair", "regime", "n", "win_pct", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt("n")).otherwise(0.0).alias("sharpe"), F.when(F.col("_l") > 0, F.col("_g") / F.col("_l")).when(F.col("_g") > 0, F.lit(float("inf"))).otherwise(0.0).alias("profit_factor"), F.when(F.col("_top") > 0, 100 * F.col("_dd") / F.col("_top")).otherwise(100.0).alias("max_dd_pct"), (F.col("n") >= min_trades).alias("sufficient"))


def robustness(stats: DataFrame) -> DataFrame:
    """Per pair, over regimes with enough trades: score and note.

    Profitable regimes count 40, a worst drawdown below 40 % (nothing from 60 % on) 30, and little variation of
    Sharpe ratios (full below 0.5, nothing from 2 on; half with one regime) 30.
    """
    used = stats.where("sufficient").groupBy("pair").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("sharpe") > 0, 1).otherwise(0)).alias("good"), F.max("max_dd_pct").alias("dd"), F.avg("sharpe").alias("m"), F.stddev_pop("sharpe").alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("sharpe") > 0, F.col("regime")))).alias("up"), F.array_sort(F.collect_list(F.when(F.col("sharpe") < 0, F.col("regime")))).alias("weak"),
    )
    calm = F.when(F.col("dd") < 40, 30.0).when(F.col("dd") < 60, 30 * (1 - (F.col("dd") - 40) / 20)).otherwise(0.0)
    spread = F.when(F.abs("m") > 1e-10, F.least(F.greatest(1 - (F.abs(F.col("s") / F.col("m")) - 0.5) / 1.5, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    even = F.when(F.col("n") >= 2, 30 * spread).otherwise(15.0)
    names = lambda c: F.array_join(F.transform(c, label), ", ")
    first = F.when(F.col("good") == 0, "no regime is profitable").when((F.col("good") == 1) & (F.col("n") > 1), F.concat(F.lit("profitable in one regime only: "), names(F.col("up")))).when(F.col("good") == F.col("n"), "profitable in every regime")
    deep = F.when(F.col("dd") > 40, F.format_string("worst drawdown %.1f %%", F.col("dd")))
    weak = F.when(F.size("weak") > 0, F.concat(F.lit("weak in "), names(F.col("weak"))))
    return used.select("pair", (40 * F.col("good") / F.col("n") + calm + even).alias("score"), F.concat_ws("; ", first, deep, weak).alias("note"))


def label(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), code)
