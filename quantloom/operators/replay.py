"""Replay of a live period with the parameters that were live at each bar.

Parameters are a table with two times: from when a version holds (``valid_s``) and when it was stored (``recorded_s``).
At a bar the version counts that holds by then and was known by then, the latest such.  A late correction
changes what follows it, never what was decided before it was known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import filters as FI
from quantloom.operators import indicators as I
from quantloom.operators import simulate as T
from quantloom.operators import sltp
from quantloom.operators.bars import seconds

TIMES = ("pair", "grp", "valid_s", "recorded_s")


def params_at(signals: DataFrame, params: DataFrame) -> DataFrame:
    """Signals (pair, s, ...) of each deployment (pair, grp) with the columns of its parameters at s; without any they go.

    An as-of join: versions and signals in one order of time, the greatest version so far by a window; at equal times a version counts.
    """
    own = [c for c in signals.columns if c != "pair"]
    names = [c for c in params.columns if c not in TIMES]
    known = params.select("pair", "grp", F.greatest("valid_s", "recorded_s").alias("_s"), F.lit(0).alias("_k"), F.struct("valid_s", "recorded_s", *names).alias("_p"))
    asked = signals.join(params.select("pair", "grp").distinct(), "pair").select("pair", "grp", F.col("s").alias("_s"), F.lit(1).alias("_k"), F.struct(*own).alias("_row"))
    w = Window.partitionBy("pair", "grp").orderBy("_s", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(asked, allowMissingColumns=True).withColumn("_p", F.max("_p").over(w))
    return both.where((F.col("_k") == 1) & F.col("_p").isNotNull()).select("pair", "grp", "_row.*", "_p.*")


def replay_trades(signals: DataFrame, params: DataFrame, bars: DataFrame, subs: DataFrame, pip: float, stops: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The managed trades of each deployment, with fill, exit, reason, pnl, mfe and mae.

    Parameters are those of the standard space, hours and days included, with a variant (null or negative takes all).  ``stops`` adds the
    prices sl and tp; by default they follow sl_mode and tp_mode.
    """
    swing = [] if stops else ["recent_low", "recent_high"]
    at = (bars if stops else I.recent_swing(bars)).select("pair", "bar_idx", seconds("ts").alias("s"), F.hour("ts").alias("_hour"), F.weekday("ts").alias("_day"), *swing)
    rows = params_at(signals.drop("hour", "day_of_week").join(at, ["pair", "bar_idx"]), params)
    c = F.col
    if "hours_start" in rows.columns:
        rows = rows.where(FI.time_passes(c("_day"), c("_hour"), c("days_mask"), c("hours_start"), c("hours_end")))
    if "trial_variant" in rows.columns:
        rows = rows.where(FI.variant_passes(c("trial_variant"), c("variant")))
    rows = stops(rows) if stops else sltp.with_stops(rows, pip)
    rows = T.management(rows, pip).withColumn("trade_id", F.concat_ws("/", "pair", "grp", "sig_seq"))
    return T.excursions(T.simulate_full(rows, bars, subs, pip), bars, pip)


def deployed(signals: Callable[[DataFrame, float], DataFrame], params: DataFrame, subs: DataFrame, pip: float) -> Callable[[DataFrame], DataFrame]:
    """What ``runs.verify`` replays: the trades of a strategy's deployments, from the bars of the live period."""

    def replay(bars: DataFrame) -> DataFrame:
        made = replay_trades(signals(bars, pip), params, bars, subs, pip)
        number = F.row_number().over(Window.partitionBy("pair").orderBy("grp", "s", "sig_seq"))
        names = {"pair": "pair", "grp": "group", "direction": "direction", "s": "s", "fill": "entry", "exit_price": "exit", "pnl": "pnl", "reason": "reason"}
        return made.select(number.cast("long").alias("replay_id"), *(F.col(k).alias(v) for k, v in names.items()))

    return replay
