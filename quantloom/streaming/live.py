"""The live side: closed bars from a tick stream, and positions as keyed state.

``closed_bars`` adds what a polling loop lacks: event time, a watermark, and bars that
are emitted once, when they can't change any more.  ``manage_positions`` keeps the
open positions of each pair in the state store and moves stops as soon as a bar closes
(the simulation defers a move by one sub-bar instead).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def closed_bars(ticks: DataFrame, size: str = "1 hour", late: str = "10 minutes", price: str = "price") -> DataFrame:
    """Bars of a stream of (pair, ts, price), each once its window has passed the watermark; later ticks are dropped."""
    at = F.struct("ts", "event_id") if "event_id" in ticks.columns else F.col("ts")
    bars = ticks.withWatermark("ts", late).groupBy("pair", F.window("ts", size)).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume"))
    return bars.select("pair", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def late_ticks(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """Batch side table: ticks that came after the bar of their hour had been written."""
    written = bars.select("pair", F.col("ts").alias("_bar"), F.col("volume").alias("_n"))
    counted = ticks.withColumn("_bar", F.date_trunc("hour", "ts")).groupBy("pair", "_bar").agg(F.count("*").alias("_all"))
    return counted.join(written, ["pair", "_bar"]).where("_all > _n").select("pair", F.col("_bar").alias("ts"), (F.col("_all") - F.col("_n")).alias("late"))


@dataclass
class Position:
    """An open position and how it is managed; None switches a module off."""

    ticket: int
    direction: int
    entry: float
    sl: float
    tp: float
    atr: float = 0.0
    bars_held: int = 0
    be_trigger: float | None = None
    be_offset: float = 0.0
    trail_activate: float | None = None
    trail_distance: float = 0.0
    partial_trigger: float | None = None
    partial_pct: float = 50.0
    max_bars: int = 0
    stale_bars: int = 0
    stale_thr: float = 0.0
    be_done: bool = False
    trailing: bool = False
    partial_done: bool = False


def manage(p: Position, bar: dict, recent: list[float], pip: float) -> tuple[Position | None, list[tuple[str, float]]]:
    """What one closed bar does to a position: the position that stays (or None) and the actions, in order.

    recent: ranges of the last bars, this one included.
    """
    p.bars_held += 1
    d, close = p.direction, bar["close"]
    best, worst = (bar["high"], bar["low"]) if d > 0 else (bar["low"], bar["high"])
    if p.max_bars and p.bars_held >= p.max_bars:
        return None, [("close_max_bars", close)]
    if p.stale_bars and p.bars_held >= p.stale_bars and max(recent[-p.stale_bars :]) < p.stale_thr * p.atr:
        return None, [("close_stale", close)]
    if d * worst <= d * p.sl:
        return None, [("close_trailing" if p.trailing else "close_breakeven" if p.be_done else "close_sl", p.sl)]
    if d * best >= d * p.tp:
        return None, [("close_tp", p.tp)]
    actions: list[tuple[str, float]] = []
    gain = d * (best - p.entry) / pip
    if p.be_trigger is not None and not p.be_done and gain >= p.be_trigger:
        price = p.entry + d * p.be_offset * pip
        p.be_done = True
        if d * price > d * p.sl:
            p.sl = price
            actions.append(("move_stop", price))
    if p.trail_activate is not None and gain >= p.trail_activate:
        p.trailing = True
    if p.trailing:
        price = best - d * p.trail_distance * pip
        if d * price > d * p.sl:
            p.sl = price
            actions.append(("move_stop", price))
    if p.partial_trigger is not None and not p.partial_done and gain >= p.partial_trigger:
        p.partial_done = True
        actions.append(("partial_close", close))
    return p, actions


def manage_positions(events: DataFrame, pip: float) -> DataFrame:
    """Actions (pair, bar_s, ticket, action, price) from a stream of (pair, seq, kind, body): ``open`` with a Position and
    ``bar`` with open, high, low, close and s (seconds), both as JSON.  A bar that was seen before does nothing."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"last": -1, "ranges": [], "open": []}
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for kind, body in zip(rows["kind"], rows["body"], strict=True):
            b = json.loads(body)
            if kind == "open":
                held["open"].append(asdict(Position(**b)))
            elif b["s"] > held["last"]:
                held["last"] = b["s"]
                held["ranges"] = [*held["ranges"], b["high"] - b["low"]][-500:]
                left = []
                for x in held["open"]:
                    p, actions = manage(Position(**x), b, held["ranges"], pip)
                    out += [(key[0], b["s"], x["ticket"], a, price) for a, price in actions]
                    if p is not None:
                        left.append(asdict(p))
                held["open"] = left
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["pair", "bar_s", "ticket", "action", "price"])

    return events.groupBy("pair").applyInPandasWithState(step, "pair string, bar_s long, ticket long, action string, price double", "held string", "append", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame) -> DataFrame:
    """Latest state of each run from a table of progress events: best quality, trials done."""
    return events.groupBy("run").agg(F.max("done").alias("done"), F.max("best").alias("best"), F.max_by("stage", "seq").alias("stage"))


def breaker(errors: Column, most: int = 10) -> Column:
    """Whether so many errors in a row stop the loop."""
    return errors >= most


def backoff_seconds(errors: int, base: float = 5.0, most: float = 300.0) -> float:
    """Pause after so many errors in a row."""
    return min(most, base * 2 ** max(0, errors - 1)) if errors else 0.0
