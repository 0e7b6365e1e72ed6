"""Trade simulation: first touch of stop or target on the sub-bars after the signal bar.

Trades: trade_id, pair, bar_idx, direction (+1, -1), entry_price, sl, tp, and for the
full mode the management columns.  Bars: pair, bar_idx, open, high, low, close, spread;
sub-bars: pair, bar_idx (of the parent), sub_seq (dense order per pair), high, low, close, spread.

Bars to come are met by (pair, block of bars), an equi-join; a horizon bounds how far is
looked, and what hasn't ended looks on from there, four times as far.  In the basic mode the bars are
met once for each bar with trades, however many trades it has: what is kept of them are the records, the
sub-bars that are higher or lower than all since, and each trade looks its stop and target up in these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.reuse import settled
from quantloom.operators.paths import START, price_paths, quiet_paths

BLOCK = 64
SLIPPAGE, COMMISSION = 0.5, 0.7  # pips
#: Exit reasons in order of precedence on one sub-bar.
REASONS = ("none", "sl", "tp", "trailing", "breakeven", "max_bars", "stale")


def fill_entries(trades: DataFrame, subs: DataFrame, pip: float, slippage: float = SLIPPAGE) -> DataFrame:
    """Adds fill: a buy pays slippage and the spread of the signal bar's first sub-bar, a sell the slippage."""
    first = subs.groupBy("pair", "bar_idx").agg(F.min_by("spread", "sub_seq").alias("_first_spread"))
    out = trades.join(first, ["pair", "bar_idx"], "left")
    buy = F.col("entry_price") + slippage * pip + F.coalesce(F.nanvl("_first_spread", F.lit(0.0)), F.lit(0.0))
    return out.withColumn("fill", F.when(F.col("direction") > 0, buy).otherwise(F.col("entry_price") - slippage * pip)).drop("_first_spread")


def _ahead(trades: DataFrame, subs: DataFrame, horizon: int | None, seen: int = 0) -> DataFrame:
    """Trades by the sub-bars of the bars after theirs, those more than ``seen`` and up to ``horizon`` bars on."""
    few = subs.select("pair", F.col("bar_idx").alias("at_bar"), "sub_seq", F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("spread").alias("sp"))
    few = few.withColumn("_blk", F.floor(F.col("at_bar") / BLOCK))
    if horizon is None:
        horizon = _last_bar(subs) + 1
    blocks = F.sequence(F.floor((F.col("bar_idx") + seen + 1) / BLOCK), F.floor((F.col("bar_idx") + horizon) / BLOCK))
    both = trades.withColumn("_blk", F.explode(blocks)).join(few, ["pair", "_blk"])
    return both.where((F.col("at_bar") > F.col("bar_idx") + seen) & (F.col("at_bar") <= F.col("bar_idx") + horizon)).drop("_blk")


def _last_bar(subs: DataFrame) -> int:
    return subs.agg(F.max("bar_idx")).first()[0] or 0


def _record_bars(starts: DataFrame, subs: DataFrame, horizon: int) -> DataFrame:
    """(pair, bar_idx, at_bar): the bars after each start whose range exceeds all since, until top or bottom is reached."""
    bars = settled(subs.groupBy("pair", "bar_idx").agg(F.max("high").alias("high"), F.min("low").alias("low")).withColumns({"sub_seq": F.col("bar_idx"), "close": F.lit(0.0), "spread": F.lit(0.0)}))
    last = _last_bar(bars)
    none = F.lit(None).cast("double")
    open_, found, seen = starts.withColumns({"_hi": none, "_lo": none}), None, 0
    w = Window.partitionBy("pair", "bar_idx").orderBy("at_bar")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    while True:
        ahead = _ahead(open_, bars, horizon, seen).withColumns({"_h": F.greatest("_hi", F.max("h").over(before)), "_l": F.least("_lo", F.min("l").over(before))})
        going = (F.col("_h").isNull() | (F.col("_h") < F.col("top"))) & (F.col("_l").isNull() | (F.col("_l") > F.col("bottom")))
        ahead = settled(ahead.where(going).select("pair", "bar_idx", "top", "bottom", "at_bar", "h", "l", "_h", "_l"))
        record = ahead.where(F.col("_h").isNull() | (F.col("h") > F.col("_h")) | (F.col("l") < F.col("_l"))).select("pair", "bar_idx", "at_bar")
        found = record if found is None else found.unionByName(record)
        if horizon >= last:
            return found
        ends = ahead.groupBy("pair", "bar_idx").agg(F.max("top").alias("top"), F.max("bottom").alias("bottom"), F.max(F.greatest("h", "_h")).alias("_hi"), F.min(F.least("l", "_l")).alias("_lo"))
        open_ = settled(ends.where((F.col("_hi") < F.col("top")) & (F.col("_lo") > F.col("bottom"))))
        if open_.isEmpty():
            return found
        seen, horizon = horizon, horizon * 4


def records(starts: DataFrame, subs: DataFrame, horizon: int = 64) -> DataFrame:
    """pair, bar_idx, ups, downs: the sub-bars after each start (pair, bar_idx, top, bottom) that exceed all since.

    ups and downs are arrays of structs (seq, v, bar, spread) in the order of time, so v rises or falls; they go
    on until top or bottom is reached, or to the end.
    """
    inside = subs.select("pair", F.col("bar_idx").alias("at_bar"), "sub_seq", "high", "low", "spread")
    rows = _record_bars(starts, subs, horizon).join(inside, ["pair", "at_bar"])
    before = Window.partitionBy("pair", "bar_idx").orderBy("sub_seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_h": F.max("high").over(before), "_l": F.min("low").over(before)})
    point = lambda c: F.struct(F.col("sub_seq").alias("seq"), F.col(c).alias("v"), F.col("at_bar").alias("bar"), "spread")
    up = F.when(F.col("_h").isNull() | (F.col("high") > F.col("_h")), point("high"))
    down = F.when(F.col("_l").isNull() | (F.col("low") < F.col("_l")), point("low"))
    return rows.groupBy("pair", "bar_idx").agg(F.sort_array(F.collect_list(up)).alias("ups"), F.sort_array(F.collect_list(down)).alias("downs"))


def first_touch(trades: DataFrame, subs: DataFrame, horizon: int = 64) -> DataFrame:
    """exit_seq, exit_bar, exit_spread and reason (sl, tp) of each trade that ends; stop before target on one sub-bar.

    The work on bars grows with the bars that have trades, not with trades or trials.
    """
    buy = F.col("direction") > 0
    above, below = F.when(buy, F.col("tp")).otherwise(F.col("sl")), F.when(buy, F.col("sl")).otherwise(F.col("tp"))
    starts = settled(trades.groupBy("pair", "bar_idx").agg(F.max(above).alias("top"), F.min(below).alias("bottom")))
    out = trades.join(records(starts, subs, horizon), ["pair", "bar_idx"], "left").withColumns({"_above": above, "_below": below})
    up = F.get(F.filter("ups", lambda x: x["v"] >= F.col("_above")), 0)
    down = F.get(F.filter("downs", lambda x: x["v"] <= F.col("_below")), 0)
    out = out.withColumns({"_up": up, "_down": down}).drop("ups", "downs", "_above", "_below")
    sl, tp = F.when(buy, F.col("_down")).otherwise(F.col("_up")), F.when(buy, F.col("_up")).otherwise(F.col("_down"))
    out = out.withColumns({"_sl": sl, "_tp": tp}).drop("_up", "_down")
    by_sl = F.col("_sl").isNotNull() & (F.col("_tp").isNull() | (F.col("_sl.seq") <= F.col("_tp.seq")))
    hit = F.when(by_sl, F.col("_sl")).otherwise(F.col("_tp"))
    out = out.withColumns({"reason": F.when(by_sl, "sl").when(F.col("_tp").isNotNull(), "tp"), "_hit": hit})
    return out.withColumns({"exit_seq": F.col("_hit.seq"), "exit_bar": F.col("_hit.bar"), "exit_spread": F.col("_hit.spread")}).drop("_hit", "_sl", "_tp")


def simulate_basic(trades: DataFrame, bars: DataFrame, subs: DataFrame, pip: float, slippage: float = SLIPPAGE, commission: float = COMMISSION, horizon: int = 64) -> DataFrame:
    """Adds fill, exit_bar, exit_price, reason and pnl (pips).

    A trade without a touch ends at the pair's last close; one that signals on the last bar at its own.
    A stop pays slippage, a target doesn't; a sell pays the spread on its exit; all pay the commission.
    """
    trades, subs = settled(trades), settled(subs)  # read several times below
    ends = subs.groupBy("pair").agg(F.max("bar_idx").alias("_last_bar"), F.max_by("close", "sub_seq").alias("_last_close"), F.max_by("spread", "sub_seq").alias("_last_spread"))
    out = first_touch(fill_entries(trades, subs, pip, slippage), subs, horizon).join(ends, "pair")
    d, slip = F.col("direction"), slippage * pip
    reason = F.coalesce("reason", F.lit("none"))
    price = F.when(reason == "sl", F.col("sl") - d * slip).when(reason == "tp", F.col("tp")).otherwise(F.col("_last_close") - d * slip)
    spread = F.coalesce(F.when(reason == "none", F.col("_last_spread")).otherwise(F.col("exit_spread")), F.lit(0.0))
    out = out.withColumns({"exit_price": price, "reason": reason, "exit_bar": F.coalesce("exit_bar", F.greatest("_last_bar", "bar_idx"))})
    cost = F.when(d < 0, F.nanvl(spread, F.lit(0.0)) / pip).otherwise(0.0) + commission
    return out.withColumn("pnl", d * (F.col("exit_price") - F.col("fill")) / pip - cost).drop("_last_bar", "_last_close", "_last_spread", "exit_seq", "exit_spread")


def evaluate(signals: DataFrame, trials: DataFrame, condition: Column | None = None) -> DataFrame:
    """Signals by trials under a condition over aliases s and t; an equality on variant makes it a hash join."""
    s, t = signals.alias("s"), trials.alias("t")
    return s.join(t, F.lit(True) if condition is None else condition)


def evaluate_by_variant(signals: DataFrame, trials: DataFrame, condition: Column | None = None) -> DataFrame:
    """Signals by the trials that take their variant, under a further condition: negative or null variants take and are taken by all.

    Wildcards become keys, so it is an equi-join: a trial of a variant stands under it and under ``#``, where signals of no variant
    look; a trial of all stands under ``*``, where every signal looks once.  Trials have t_variant.
    """
    keys = lambda x, known, any_: F.explode(F.when(F.coalesce(F.col(x), F.lit(-1)) >= 0, F.array(*(F.col(x).cast("string") if k == "=" else F.lit(k) for k in known))).otherwise(F.array(*map(F.lit, any_))))
    s = signals.withColumn("_key", keys("variant", "=*", "*#"))
    t = trials.withColumn("_key", keys("t_variant", "=#", "*"))
    both = s.alias("s").join(t.alias("t"), F.col("s._key") == F.col("t._key")).drop("_key")
    return both if condition is None else both.where(condition)


#: Management columns of the full mode and what switches each off.
MANAGEMENT = {"max_bars": 0, "stale_bars": 0, "stale_thr": 0.0, "be_trigger": None, "be_offset": 0.0, "trail_activate": None, "trail_pips": None, "partial_trigger": None, "partial_pct": 0.0}


def management(rows: DataFrame, pip: float | Column) -> DataFrame:
    """The management columns of (signal, trial) rows from the parameters of the standard space and the signal's atr_pips.

    A module that is off has a null trigger; the chandelier mode trails by a multiple of the ATR at the signal.
    """
    c = F.col
    trail = F.when(c("trailing_mode") == "fixed_pip", c("trail_distance")).when(c("trailing_mode") == "atr_chandelier", c("trail_atr_mult") * c("atr_pips"))
    on = lambda flag, x: F.when(c(flag), c(x)).cast("double")
    return rows.withColumns({
        "trail_pips": trail.cast("double"), "trail_activate": F.when(c("trailing_mode").isin("fixed_pip", "atr_chandelier"), c("trail_activate")).cast("double"),
        "be_trigger": on("be_enabled", "be_trigger"), "be_offset": c("be_offset").cast("double"), "partial_trigger": on("partial_enabled", "partial_trigger"), "partial_pct": c("partial_pct").cast("double"),
        "max_bars": c("max_bars").cast("double"), "stale_bars": F.coalesce(on("stale_enabled", "stale_bars"), F.lit(0.0)), "stale_thr": c("stale_thr").cast("double"), "atr": c("atr_pips") * pip,
    })


def _first(items: str, holds: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, holds), 0)


def _exits(trades: DataFrame, pip: float) -> DataFrame:
    """Adds x_sl (with price and reason), x_tp and x_part to trades that have their start's ups, downs and legs."""
    c, d = F.col, F.col("direction")
    gain = lambda x: (x["v"] - c("_f")) / pip
    behind = lambda trigger: F.when(F.exists("ups", lambda x: gain(x) >= c(trigger)), F.size(F.filter("ups", lambda x: gain(x) < c(trigger))))
    at = lambda x: F.struct(x["seq"].alias("seq"), x["bar"].alias("bar"), x["spread"].alias("spread"))
    out = trades.withColumns({"_f": d * c("fill"), "_s0": d * c("sl"), "_d": c("trail_pips") * pip, "_be": d * c("fill") + c("be_offset") * pip})
    out = out.withColumns({"_a": behind("trail_activate"), "_k": behind("be_trigger")})  # the ups that switch on trailing and breakeven
    stop = F.greatest("_s0", F.when(c("_a") < c("_k"), F.get("ups", c("_k") - 1)["v"] - c("_d")))
    out = out.withColumn("_lock", F.when(c("_be") > stop, c("_k")))
    fixed = _first("downs", lambda x: x["v"] <= c("_s0"))
    moved = _first("legs", lambda x: (x["run"] > c("_lock")) & (x["v"] <= c("_be")))
    trailed = _first("legs", lambda x: (x["run"] > c("_a")) & (x["v"] <= x["top"] - c("_d")))
    out = out.withColumns({"_x1": fixed, "_x2": moved, "_x3": trailed})
    out = out.withColumn("_x", F.least(*[F.when(c(x).isNotNull(), at(c(x))) for x in ("_x1", "_x2", "_x3")])).drop("_x1", "_x2", "_x3")
    out = out.withColumn("_n", F.size(F.filter("ups", lambda x: x["seq"] < c("_x.seq"))))
    locked, trails = c("_lock") < c("_n"), c("_a") < c("_n")
    price = F.greatest("_s0", F.when(locked, c("_be")), F.when(trails, F.get("ups", c("_n") - 1)["v"] - c("_d")))
    reason = F.when(trails, "trailing").when(locked, "breakeven").otherwise("sl")
    hit = F.when(c("_x").isNotNull(), F.struct(c("_x.seq").alias("seq"), c("_x.bar").alias("b"), price.alias("p"), reason.alias("r"), c("_x.spread").alias("s")))
    target = _first("ups", lambda x: x["v"] >= d * c("tp"))
    part = _first("ups", lambda x: gain(x) >= c("partial_trigger"))
    out = out.withColumns({"x_sl": hit, "_t": target, "x_part": part})
    out = out.withColumn("x_tp", F.when(c("_t").isNotNull(), F.struct(c("_t.seq").alias("seq"), c("_t.bar").alias("b"), (d * c("tp")).alias("p"), F.lit("tp").alias("r"), c("_t.spread").alias("s"))))
    return out.drop("ups", "downs", "legs", "_f", "_s0", "_d", "_be", "_a", "_k", "_lock", "_x", "_n", "_t")


def simulate_full(trades: DataFrame, bars: DataFrame, subs: DataFrame, pip: float, slippage: float = SLIPPAGE, commission: float = COMMISSION, horizon: int | None = None) -> DataFrame:
    """As simulate_basic, with breakeven, trailing, partial close, time and stale exits; adds partial (whether it was taken).

    Moves of the stop take effect on the next sub-bar.  Time and stale exits close a bar before its sub-bars are looked
    at.  Null triggers switch a module off.  The work on bars grows with the starts (bar and direction) that have trades; each trade
    looks its exits up in the path of its start.  ``horizon`` is how far is looked at first.
    """
    trades = trades.withColumns({c: F.lit(v).cast("double") for c, v in MANAGEMENT.items() if c not in trades.columns})
    trades, subs = settled(trades), settled(subs)  # read several times below
    d = F.col("direction")
    starts = trades.groupBy(*START).agg(F.max(d * F.col("tp")).alias("top"), F.min(d * F.col("sl")).alias("bottom"))
    paths, ends = price_paths(starts, subs, horizon or 1024)
    filled = fill_entries(trades, subs, pip, slippage)
    out = _exits(filled.join(paths, list(START), "left"), pip)
    out = out.join(_bar_exits(trades, bars, ends), "trade_id", "left")
    final = subs.groupBy("pair").agg(F.max("bar_idx").alias("_last_bar"), F.max_by("close", "sub_seq").alias("_last_close"), F.max_by("spread", "sub_seq").alias("_last_spread"))
    own = bars.select("pair", "bar_idx", F.col("close").alias("_own_close"), F.col("spread").alias("_own_spread"))
    out = out.join(final, "pair", "left").join(own, ["pair", "bar_idx"], "left")
    goes_on = F.col("_last_bar") > F.col("bar_idx")
    end = lambda a, b: F.when(goes_on, F.col(a)).otherwise(F.col(b))
    touch = F.when(F.col("x_tp").isNull() | (F.col("x_sl.seq") <= F.col("x_tp.seq")), F.col("x_sl")).otherwise(F.col("x_tp"))
    out = out.withColumn("_x", touch)
    by_bar = F.col("bar_exit").isNotNull() & (F.col("_x").isNull() | (F.col("_x.b") >= F.col("bar_exit")))
    out = out.withColumn("_by_bar", by_bar)
    slip = slippage * pip
    reason = F.when(F.col("_by_bar"), F.col("bar_reason")).when(F.col("_x").isNotNull(), F.col("_x.r")).otherwise("none")
    price = (
        F.when(F.col("_by_bar"), F.col("bar_price") - d * slip)
        .when(F.col("_x.r") == "tp", F.col("tp"))
        .when(F.col("_x").isNotNull(), d * F.col("_x.p") - d * slip)
        .otherwise(end("_last_close", "_own_close") - d * slip)
    )
    exit_bar = F.when(F.col("_by_bar"), F.col("bar_exit")).when(F.col("_x").isNotNull(), F.col("_x.b")).otherwise(end("_last_bar", "bar_idx"))
    spread = F.when(F.col("_by_bar"), F.col("bar_spread")).when(F.col("_x").isNotNull(), F.col("_x.s")).otherwise(end("_last_spread", "_own_spread"))
    taken = F.when(F.col("_by_bar"), F.col("x_part.bar") < F.col("bar_exit")).when(F.col("_x").isNotNull(), F.col("x_part.seq") <= F.col("_x.seq")).otherwise(F.col("x_part").isNotNull())
    out = out.withColumns({"reason": reason, "exit_price": price, "exit_bar": exit_bar, "partial": F.coalesce(taken, F.lit(False)), "_spread": F.coalesce(F.nanvl(spread, F.lit(0.0)), F.lit(0.0))})
    share = F.when(F.col("partial"), F.col("partial_pct") / 100).otherwise(0.0)
    part_cost = F.when(d < 0, F.coalesce(F.nanvl(F.col("x_part.spread"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    part = F.when(F.col("partial"), share * ((d * (F.col("x_part.close") - d * slip - F.col("fill"))) - part_cost) / pip).otherwise(0.0)
    rest = (1 - share) * (d * (F.col("exit_price") - F.col("fill")) - F.when(d < 0, F.col("_spread")).otherwise(0.0)) / pip
    out = out.withColumn("pnl", part + rest - commission)
    return out.drop("x_sl", "x_tp", "x_part", "_x", "_by_bar", "_spread", "_own_close", "_own_spread", "_last_bar", "_last_close", "_last_spread", "bar_exit", "bar_reason", "bar_price", "bar_spread")


def _bar_exits(trades: DataFrame, bars: DataFrame, ends: DataFrame) -> DataFrame:
    """trade_id, bar_exit, bar_reason, bar_price, bar_spread: the first bar at which max_bars or the stale rule closes a trade; max_bars first."""
    cap, length = F.coalesce("max_bars", F.lit(0.0)), F.coalesce("stale_bars", F.lit(0.0)).cast("int")
    timed = trades.where((cap > 0) | (length > 0)).select("trade_id", "pair", "bar_idx", F.when(cap > 0, F.col("bar_idx") + cap.cast("long")).alias("_cap"), length.alias("n"), (F.col("stale_thr") * F.col("atr")).alias("_width"))
    starts = trades.where(length > 0).select(*START, length.alias("n")).distinct().join(ends, list(START)).groupBy("pair", "bar_idx", "n").agg(F.max("path_end").alias("path_end"))
    out = timed.join(quiet_paths(starts, bars, trades.agg(F.max(length)).first()[0] or 1), ["pair", "bar_idx", "n"], "left")
    out = out.withColumn("_stale", _first("quiet", lambda x: x["width"] < F.col("_width"))["bar"]).drop("quiet")
    out = out.withColumns({"bar_exit": F.least("_cap", "_stale"), "bar_reason": F.when(F.col("_stale") < F.coalesce("_cap", F.lit(2**62)), "stale").otherwise("max_bars")})
    at = bars.select("pair", F.col("bar_idx").alias("bar_exit"), F.col("close").alias("bar_price"), F.col("spread").alias("bar_spread"))
    return out.join(at, ["pair", "bar_exit"]).select("trade_id", "bar_exit", "bar_reason", "bar_price", "bar_spread")


def capped(trades: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` trades of each evaluation; sl_pips becomes the stops of all its signals by the number of trades kept."""
    all_ = Window.partitionBy(*keys)
    held = F.least(F.count("*").over(all_), F.lit(cap))
    out = trades.withColumns({"_n": F.row_number().over(all_.orderBy(*order)), "sl_pips": F.sum("sl_pips").over(all_) / held})
    return out.where(F.col("_n") <= cap).drop("_n")


def excursions(trades: DataFrame, bars: DataFrame, pip: float) -> DataFrame:
    """Adds bars_held, mfe and mae (pips) over the bars after the entry's, exit bar included.

    Whole blocks of bars count by their extremes, only the first and last block of a trade bar by bar.
    """
    d = F.col("direction")
    few = bars.select("pair", F.col("bar_idx").alias("_b"), "high", "low", F.floor(F.col("bar_idx") / BLOCK).alias("_blk"))
    whole = few.groupBy("pair", "_blk").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    first, last = F.floor((F.col("bar_idx") + 1) / BLOCK), F.floor(F.col("exit_bar") / BLOCK)
    held = trades.where("exit_bar > bar_idx").select("trade_id", "pair", "bar_idx", "exit_bar", first.alias("_x"), last.alias("_y"))
    edges = held.withColumn("_blk", F.explode(F.array_distinct(F.array("_x", "_y")))).join(few, ["pair", "_blk"]).where("_b > bar_idx and _b <= exit_bar").select("trade_id", "high", "low")
    inner = held.where("_y > _x + 1").withColumn("_blk", F.explode(F.sequence(F.col("_x") + 1, F.col("_y") - 1))).join(whole, ["pair", "_blk"]).select("trade_id", "high", "low")
    found = edges.unionByName(inner).groupBy("trade_id").agg(F.max("high").alias("_top"), F.min("low").alias("_low"))
    out = trades.join(found, "trade_id", "left")
    best = F.when(d > 0, F.col("_top") - F.col("fill")).otherwise(F.col("fill") - F.col("_low")) / pip
    worst = F.when(d > 0, F.col("fill") - F.col("_low")).otherwise(F.col("_top") - F.col("fill")) / pip
    zero = F.lit(0.0)
    out = out.withColumns({"mfe": F.greatest(F.coalesce(best, zero), zero), "mae": F.greatest(F.coalesce(worst, zero), zero)})
    return out.drop("_top", "_low").withColumn("bars_held", F.col("exit_bar") - F.col("bar_idx"))
