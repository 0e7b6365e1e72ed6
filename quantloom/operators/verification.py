"""Live trades against their replay: sources, pairing, deltas and aggregates."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.workers import sent_whole

sent_whole(__name__)

#: Exit reasons of the broker and the replay by their common name; fixed values.
REASONS = {"sl": "stop", "stop_loss": "stop", "so": "stop", "tp": "target", "take_profit": "target", "trailing": "trailing", "trailing_stop": "trailing", "breakeven": "breakeven", "be": "breakeven", "max_bars": "time", "stale": "stale", "none": "open"}


def normal_reason(reason: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in sorted(REASONS.items()) for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.trim(reason))), F.lit("other"))


def trades_from_deals(deals: DataFrame) -> DataFrame:
    """One trade per position with two deals or more: the first is the entry, the last the exit; position 0 goes."""
    at = F.struct("ts", "deal_id")
    rows = deals.where("position_id <> 0").groupBy("position_id").agg(F.count("*").alias("n_deals"), F.min_by("price", at).alias("entry_price"), F.max_by("price", at).alias("exit_price"), F.min("ts").alias("entry_ts"), F.max("ts").alias("exit_ts"), F.sum("profit").alias("profit"))
    return rows.where("n_deals >= 2")


def deal_reason(comment: Column) -> Column:
    """Why a position was closed, by the comment of its last deal; fixed marks, the first that occurs."""
    said = F.lower(F.coalesce(comment, F.lit("")))
    return F.when(said.rlike("sl|stop"), "stop_loss").when(said.rlike("tp|profit"), "take_profit").when(said.contains("close"), "manual").otherwise("unknown")


def live_trades(deals: DataFrame, pip: Column | float) -> DataFrame:
    """Trades of the broker's deals (symbol, position_id, deal_id, ts, type, price, volume, profit, commission, swap, comment).

    A position with two deals or more is one trade: its first deal tells direction (type 0 buys) and entry, its last one the exit and
    the reason; profit, commission and swap are sums over all.  Position 0 goes.  The order is that of (ts, deal_id).
    """
    at = F.struct("ts", "deal_id")
    first, last = (lambda c: F.min_by(c, at)), (lambda c: F.max_by(c, at))
    rows = deals.where("position_id <> 0").groupBy("symbol", "position_id").agg(
        F.count("*").alias("n_deals"), F.when(first("type") == 0, 1).otherwise(-1).alias("direction"), first("volume").alias("volume"), first("price").alias("entry_price"), F.min("ts").alias("entry_ts"),
        last("price").alias("exit_price"), F.max("ts").alias("exit_ts"), F.sum("profit").alias("profit"), F.sum("commission").alias("commission"), F.sum("swap").alias("swap"), last("comment").alias("_said"),
    )
    out = rows.where("n_deals >= 2").withColumns({"pnl_pips": F.col("direction") * (F.col("exit_price") - F.col("entry_price")) / pip, "exit_reason": deal_reason(F.col("_said"))})
    return out.drop("_said")


def trades_from_audit(events: DataFrame) -> DataFrame:
    """Opens with the first close of their ticket after them; a ticket is used once, closes without an open go."""
    w = Window.partitionBy("ticket").orderBy("seq")
    opened = events.where("kind = 'open'").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("ticket", F.col("seq").alias("open_seq"), F.col("price").alias("entry_price"))
    closed = events.where("kind = 'close'").select("ticket", F.col("seq").alias("close_seq"), F.col("price").alias("exit_price"))
    both = opened.join(closed, "ticket").where("close_seq > open_seq")
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("ticket").orderBy("close_seq"))).where("_n = 1")
    return first.drop("_n")


def closed_by_broker(tracked: DataFrame, positions: DataFrame) -> DataFrame:
    """Tracked tickets that the broker doesn't hold any more."""
    return tracked.join(positions.select("ticket"), "ticket", "left_anti")


class _Free:
    """Replay trades of a run that aren't taken: a linked list of their times, each with its ids in order.

    A node is [time, ids, place of the first id that may be free, node before, node after].
    """

    def __init__(self) -> None:
        self.start: list = [float("-inf"), [], 0, None, None]
        self.end: list = [float("inf"), [], 0, self.start, None]
        self.start[4] = self.place = self.end  # place: the first node not before the last live trade
        self.used: set = set()

    def add(self, s: float, replay_id: int) -> None:
        """Times never fall from call to call."""
        last = self.end[3]
        if last[0] == s:
            last[1].append(replay_id)
            return
        last[4] = self.end[3] = node = [s, [replay_id], 0, last, self.end]
        if self.place is self.end:
            self.place = node

    def _drop(self, node: list) -> None:
        node[3][4], node[4][3] = node[4], node[3]
        if node is self.place:
            self.place = node[4]

    def _first(self, node: list, way: int) -> list:
        """``node``, or the next one that way (3 back, 4 on), that has a free id; those without leave the list."""
        while node[1]:
            while node[2] < len(node[1]) and node[1][node[2]] in self.used:
                node[2] += 1
            if node[2] < len(node[1]):
                return node
            self._drop(node)
            node = node[way]
        return node

    def take(self, s: float, span: int) -> int | None:
        """The nearest free trade within ``span``, the least id of equals.  Times never fall from call to call."""
        while self.place[0] < s:
            self.place = self.place[4]
        while self.start[4][0] < s - span:
            self._drop(self.start[4])
        after = self._first(self.place, 4)
        before = self._first(after[3], 3)
        gap, back = after[0] - s, s - before[0]
        if min(gap, back) > span:
            return None
        at = after if gap < back or (gap == back and after[1][after[2]] < before[1][before[2]]) else before
        self.used.add(found := at[1][at[2]])
        return found


def _greedy(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows group, direction, run, s, live, id, which come in that order.

    A live trade waits until all replay trades that it may take have come.
    """
    now, free, waiting, out = None, _Free(), deque(), []

    def settle(until: float) -> None:
        while waiting and waiting[0][0] + span < until:
            s, live_id = waiting.popleft()
            if (replay_id := free.take(s, span)) is not None:
                out.append((now[0], live_id, replay_id))

    def told(kind: pa.DataType) -> pa.RecordBatch:
        cols = zip(*out, strict=True) if out else ([], [], [])
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64()), strict=True)], ["group", "live_id", "replay_id"])
        out.clear()
        return made

    kind = None
    for batch in batches:
        kind = batch.schema.field("group").type
        for *key, s, is_live, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                settle(float("inf"))
                now, free = key, _Free()
            settle(s)
            if not is_live:
                free.add(s, i)
            elif not waiting or waiting[-1] != (s, i):
                waiting.append((s, i))
        yield told(kind)
    if kind is not None:
        settle(float("inf"))
        yield told(kind)


def match(live: DataFrame, replay: DataFrame, minutes: float = 120.0) -> DataFrame:
    """Pairs (group, live_id, replay_id): each live trade in order of entry takes the nearest free replay trade of its
    direction within ``minutes``; the least id of equals.  ``group`` separates pairs and strategies.

    The choice depends on those before it, so trades run in order: both sides as one sorted stream, each trade once.
    Candidate pairs, whose number grows with the square of the trades in an hour, are never formed.  Live trades further
    apart than twice ``minutes`` can't want the same replay trade: a run of live trades without such a gap (seen by
    buckets of ``minutes``) is settled on its own.  A run is one stream, whose task holds the replay trades within
    ``minutes`` and the ids taken.  Rows with a null group, direction, id or time match nothing; a live trade or a
    replay id that comes twice counts once.
    """
    span = int(minutes * 60)
    keys = ["group", "direction"]
    bucket = F.floor(F.col("s") / max(span, 1)).alias("b")
    a = live.select(*keys, "s", F.lit(True).alias("live"), F.col("live_id").alias("id"), bucket)
    b = replay.select(*keys, "s", F.lit(False).alias("live"), F.col("replay_id").alias("id"), bucket)
    w = Window.partitionBy(*keys).orderBy("b")  # over a row for each bucket with live trades
    apart = F.when(F.col("b") - F.lag("b").over(w) > 2, 1).otherwise(0)  # two buckets between: more than twice the span
    busy = a.select(*keys, "b").distinct().withColumn("_new", apart).withColumn("run", F.sum("_new").over(w))
    reach = busy.select(*keys, "run", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b")).distinct()
    rows = a.unionByName(b).where(F.col("id").isNotNull()).join(reach, [*keys, "b"]).select(*keys, "run", "s", "live", "id")
    kind = dict(rows.dtypes)["group"]
    dealt = rows.repartition(*keys, "run").sortWithinPartitions(*keys, "run", "s", "live", "id")
    return dealt.mapInArrow(lambda batches: _greedy(batches, span), f"group {kind}, live_id long, replay_id long")


def compare(pairs: DataFrame, pip: float) -> DataFrame:
    """Deltas of matched trades (live_* against replay_*): entry and exit slippage (pips, positive is worse), minutes, pnl, reasons."""
    d = F.col("direction")
    c = F.col
    return pairs.select(
        "live_id",
        "replay_id",
        F.round(d * (c("live_entry") - c("replay_entry")) / pip, 2).alias("entry_slippage"),
        F.round(-d * (c("live_exit") - c("replay_exit")) / pip, 2).alias("exit_slippage"),
        F.round((c("live_s") - c("replay_s")) / 60, 1).alias("minutes"),
        F.round(c("live_pnl") - c("replay_pnl"), 2).alias("pnl_delta"),
        (normal_reason(c("live_reason")) == normal_reason(c("replay_reason"))).alias("same_reason"),
    )


def aggregates(compared: DataFrame, n_live: int, n_replay: int) -> DataFrame:
    return compared.agg(F.count("*").alias("matched"), F.round(F.avg("entry_slippage"), 4).alias("mean_slippage"), F.round(F.avg("pnl_delta"), 4).alias("mean_pnl_delta"), F.round(F.avg(F.when(F.col("same_reason"), 1.0).otherwise(0.0)), 4).alias("reason_rate"), F.round(F.count("*") / max(1, n_live), 4).alias("live_rate"), F.round(F.count("*") / max(1, n_replay), 4).alias("replay_rate"))
