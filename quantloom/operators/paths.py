"""What a price does after a start, kept so that any stop, target or trailing distance is looked up in it.

Prices are signed by the direction, so higher is better.  Of the path of a start (pair, bar_idx,
direction) three lists of sub-bars are kept, in the order of time:

* ``ups``: the best price exceeds all before, so a target, a trigger or an activation is the first one at a level;
* ``downs``: the worst price is below all before: a fixed stop is the first one at its level;
* ``legs``: the worst price is below all since the last of ``ups``: a stop that trails the best price by some distance, or
  one that begins later, is the first leg behind that point at its level.

They depend on the start alone, so thousands of trials share them.  Bars that can hold none of the three are
left out by their extremes before sub-bars are met.  A path goes on until ``top`` or ``bottom``, the widest
target and stop of the start, is reached; bars ahead are met by blocks, an equi-join, as many as a horizon that grows
fourfold for what hasn't ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.reuse import settled

BLOCK = 64
START = ("pair", "bar_idx", "direction")


def signed(high: Column, low: Column) -> tuple[Column, Column]:
    """Best and worst price of a bar in the trade's direction."""
    buy = F.col("direction") > 0
    return F.when(buy, high).otherwise(-low), F.when(buy, low).otherwise(-high)


def last_bar(bars: DataFrame) -> int:
    return bars.agg(F.max("bar_idx")).first()[0] or 0


def bars_ahead(starts: DataFrame, bars: DataFrame, horizon: int, seen: int = 0) -> DataFrame:
    """Starts by the bars (renamed at_bar) that are more than ``seen`` and up to ``horizon`` bars on."""
    few = bars.withColumnRenamed("bar_idx", "at_bar").withColumn("_blk", F.floor(F.col("at_bar") / BLOCK))
    blocks = F.sequence(F.floor((F.col("bar_idx") + seen + 1) / BLOCK), F.floor((F.col("bar_idx") + horizon) / BLOCK))
    both = starts.withColumn("_blk", F.explode(blocks)).join(few, ["pair", "_blk"])
    return both.where((F.col("at_bar") > F.col("bar_idx") + seen) & (F.col("at_bar") <= F.col("bar_idx") + horizon)).drop("_blk")


def _told_bars(starts: DataFrame, subs: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """(starts by the bars that may hold an up, a down or a leg, starts with path_end, their last bar)."""
    bars = settled(subs.groupBy("pair", "bar_idx").agg(F.max("high").alias("high"), F.min("low").alias("low")))
    last, none = last_bar(bars), F.lit(None).cast("double")
    open_, seen, told, ends = starts.withColumns({"_hi": none, "_lo": none, "_leg": none}), 0, [], []
    w = Window.partitionBy(*START).orderBy("at_bar")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    since = Window.partitionBy(*START, "_run").orderBy("at_bar").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        rows = bars_ahead(open_, bars, horizon, seen)
        best, worst = signed(F.col("high"), F.col("low"))
        rows = rows.withColumns({"_best": best, "_worst": worst}).drop("high", "low")
        rows = rows.withColumns({"_h": F.greatest("_hi", F.max("_best").over(before)), "_l": F.least("_lo", F.min("_worst").over(before))})
        rows = rows.where((F.col("_h").isNull() | (F.col("_h") < F.col("top"))) & (F.col("_l").isNull() | (F.col("_l") > F.col("bottom"))))
        rows = rows.withColumn("_up", F.col("_h").isNull() | (F.col("_best") > F.col("_h")))
        rows = rows.withColumn("_run", F.sum(F.col("_up").cast("int")).over(w))
        # the bar of an up is told anyway; of the bars after it, those below all of these
        whole = F.when(~F.col("_up"), F.col("_worst"))
        rows = rows.withColumn("_low", F.least(F.min(whole).over(since), F.when(F.col("_run") == 0, F.col("_leg"))))
        rows = rows.withColumn("_told", F.col("_up") | F.col("_l").isNull() | (F.col("_worst") < F.col("_l")) | F.col("_low").isNull() | (F.col("_worst") < F.col("_low")))
        rows = settled(rows.select(*START, "top", "bottom", "at_bar", "_best", "_worst", "_h", "_l", F.least("_low", whole).alias("_leg"), "_told"))
        told.append(rows.where("_told").select(*START, "at_bar"))
        state = rows.groupBy(*START).agg(
            F.max("top").alias("top"), F.max("bottom").alias("bottom"), F.max(F.greatest("_best", "_h")).alias("_hi"), F.min(F.least("_worst", "_l")).alias("_lo"),
            F.max_by("_leg", "at_bar").alias("_leg"), F.max("at_bar").alias("path_end"),
        )
        ends.append(state.select(*START, "path_end"))
        if horizon >= last:
            break
        open_ = settled(state.where((F.col("_hi") < F.col("top")) & (F.col("_lo") > F.col("bottom")) & (F.col("path_end") < last)).drop("path_end"))
        if open_.isEmpty():
            break
        seen, horizon = horizon, horizon * 4
    joined = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(joined(parts[1:]))
    return joined(told), joined(ends).groupBy(*START).agg(F.max("path_end").alias("path_end"))


def price_paths(starts: DataFrame, subs: DataFrame, horizon: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(START, ups, downs, legs) of each start (START, top, bottom in signed prices) that has bars ahead, and (START, path_end).

    ups are structs (seq, v, bar, close, spread), downs (seq, v, bar, spread), legs (seq, v, top, run, bar, spread): ``run`` is the
    number of ups before, ``top`` the price of the last of them.
    """
    told, ends = _told_bars(starts, subs, horizon)
    rows = told.join(subs.withColumnRenamed("bar_idx", "at_bar"), ["pair", "at_bar"])
    best, worst = signed(F.col("high"), F.col("low"))
    rows = rows.select(*START, F.col("at_bar").alias("bar"), F.col("sub_seq").alias("seq"), "close", "spread", best.alias("_best"), worst.alias("_worst"))
    before = Window.partitionBy(*START).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_h": F.max("_best").over(before), "_l": F.min("_worst").over(before)})
    rows = rows.withColumns({"_up": F.col("_h").isNull() | (F.col("_best") > F.col("_h")), "_down": F.col("_l").isNull() | (F.col("_worst") < F.col("_l"))})
    rows = rows.withColumn("run", F.coalesce(F.sum(F.col("_up").cast("int")).over(before), F.lit(0)).cast("int"))
    least = F.min("_worst").over(Window.partitionBy(*START, "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_m", least)
    worst_ = F.col("_worst").alias("v")
    up = F.when(F.col("_up"), F.struct("seq", F.col("_best").alias("v"), "bar", "close", "spread"))
    down = F.when(F.col("_down"), F.struct("seq", worst_, "bar", "spread"))
    leg = F.when((F.col("run") > 0) & (F.col("_m").isNull() | (F.col("_worst") < F.col("_m"))), F.struct("seq", worst_, F.col("_h").alias("top"), "run", "bar", "spread"))
    listed = lambda x: F.sort_array(F.collect_list(x))
    return rows.groupBy(*START).agg(listed(up).alias("ups"), listed(down).alias("downs"), listed(leg).alias("legs")), ends


def quiet_paths(starts: DataFrame, bars: DataFrame, longest: int) -> DataFrame:
    """(pair, bar_idx, n, quiet) of starts (pair, bar_idx, n, path_end): n bars' widest range, each time it is below all before.

    quiet are structs (bar, width), from the n-th bar after the start on.  Widths of any n come from those of powers of two: two of
    them cover n bars, found by an equi-join, so lengths are data; ``longest`` bounds them.
    """
    powers = range(max(1, longest).bit_length())
    w = Window.partitionBy("pair").orderBy("bar_idx")
    spans = bars.withColumn("_r", F.col("high") - F.col("low"))
    spans = spans.select("pair", "bar_idx", F.array(*[F.max("_r").over(w.rowsBetween(1 - 2**k, 0)) for k in powers]).alias("widths"))
    lengths = starts.select("pair", "n").distinct().withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int"))
    ends = lengths.join(spans, "pair").select("pair", "n", "bar_idx", F.get("widths", F.col("k")).alias("_late"), (F.col("bar_idx") - F.col("n") + F.pow(F.lit(2), "k")).cast("long").alias("_at"), "k")
    both = ends.join(spans.select("pair", F.col("bar_idx").alias("_at"), F.col("widths").alias("_w")), ["pair", "_at"])
    wide = both.select("pair", "n", F.col("bar_idx").alias("at_bar"), F.greatest("_late", F.get("_w", F.col("k"))).alias("width"), F.floor(F.col("bar_idx") / BLOCK).alias("_blk"))
    first, last = F.col("bar_idx") + F.col("n"), F.col("path_end")
    rows = starts.where(first <= last).withColumn("_blk", F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK)))).join(wide, ["pair", "n", "_blk"]).where((F.col("at_bar") >= first) & (F.col("at_bar") <= last))
    least = F.min("width").over(Window.partitionBy("pair", "bar_idx", "n").orderBy("at_bar").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_m", least).where(F.col("_m").isNull() | (F.col("width") < F.col("_m")))
    return rows.groupBy("pair", "bar_idx", "n").agg(F.sort_array(F.collect_list(F.struct(F.col("at_bar").alias("bar"), "width"))).alias("quiet"))
