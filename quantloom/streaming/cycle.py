"""The live cycle as keyed state: day's rollover, bars once, managed positions, the broker's closes, risk, orders.

Each trading instance is a key of a stream of events (instance, ts, seq, kind, body as JSON), whose state lies
in four variables of the state store: the day's count and result, the account with its breaker, what was seen of
each pair, and the open positions by ticket.  Events of a key are taken in the order of (ts, seq):

* ``account`` (balance, equity): the account; its peak stays.
* ``bar`` (pair, s, open, high, low, close): positions of the pair are managed, unless the bar, or a later one, was seen.
* ``deal`` (ticket, price, comment): the broker has closed a position; the comment tells stop, target or another reason.
* ``signal`` (pair, s, ticket, direction, entry, sl, tp, sl_pips, pip_value, spread_pips, management columns): once per pair and bar,
  and only on the latest bar; the risk checks refuse it or an order goes out.
* ``trip`` (said) and ``reset``: the breaker.

A day ends by the first event of the next one, or by a timer at midnight of event time when none comes; a new day
clears a breaker that a daily loss has tripped.  Nothing is kept outside the state store, so a lost executor
or a restart goes on from the last batch; ``state_tables`` reads the variables of a stopped query, and
``initial_state`` makes them the beginning of another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, fields
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quantloom.streaming.live import Position, manage

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "instance string, ts long, pair string, ticket long, action string, price double, said string"
VARIABLES = {
    "day": "date string, trades long, wins long, losses long, pips double, money double",
    "account": "balance double, equity double, peak double, breaker string",
    "pairs": "last_bar long, last_signal long, ranges string",
    "positions": "pair string, share double, realised double, volume double, pip_value double, body string",
}
KEYS = {"pairs": "pair string", "positions": "ticket long"}
LIMITS = {"daily_trades": 10, "daily_loss_pct": 3.0, "drawdown_pct": 10.0, "open": 3, "spread_pips": 3.0, "risk_pct": 1.0}
DAY_MS = 86_400_000
REASONS = (("sl", "stop_loss"), ("tp", "take_profit"))


def refusal(day: dict, account: dict, held: list[str], pair: str, spread_pips: float, limits: dict) -> str:
    """The first risk check that fails, in the order of ``risk.pre_trade``; empty if none does."""
    checks = (
        (account["breaker"] != "", "circuit_breaker"),
        (day["trades"] >= limits["daily_trades"], "daily_trades"),
        (day["money"] <= -account["balance"] * limits["daily_loss_pct"] / 100, "daily_loss"),
        (account["peak"] > 0 and (account["peak"] - account["equity"]) / account["peak"] * 100 >= limits["drawdown_pct"], "drawdown"),
        (len(held) >= limits["open"], "open_positions"),
        (pair in held, "same_symbol"),
        (spread_pips > limits["spread_pips"], "spread"),
    )
    return next((name for failed, name in checks if failed), "")


def lots(balance: float, sl_pips: float, pip_value: float, risk_pct: float, step: float = 0.01, most: float = 100.0) -> float:
    """As ``risk.position_size``."""
    if sl_pips <= 0 or pip_value <= 0:
        return step
    whole = round((balance * risk_pct / 100 / (sl_pips * pip_value) / step + 1e-9) // 1 * step, 8)
    return min(max(whole, step), most)


class Cycle(StatefulProcessor):
    """The cycle of one instance."""

    def __init__(self, pip: float, limits: dict | None = None):
        self.pip, self.limits = pip, LIMITS | (limits or {})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day, self.account = (handle.getValueState(n, VARIABLES[n]) for n in ("day", "account"))
        self.pairs, self.positions = (handle.getMapState(n, KEYS[n], VARIABLES[n]) for n in ("pairs", "positions"))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:  # noqa: N802, N803
        state = json.loads(initialState["state"])
        for name, variable in (("day", self.day), ("account", self.account)):
            if name in state:
                variable.update(tuple(state[name]))
        for name, variable in (("pairs", self.pairs), ("positions", self.positions)):
            for k, v in state.get(name, []):
                variable.updateValue((k,), tuple(v))
        if "day" in state:
            self._midnight(state["day"][0])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        self.out: list[Row] = []
        for r in sorted(rows, key=lambda r: (r["ts"], r["seq"])):
            self.key, self.ms = key[0], int(r["ts"].replace(tzinfo=UTC).timestamp() * 1000)
            self._roll(r["ts"].strftime("%Y-%m-%d"))
            getattr(self, "_" + r["kind"])(json.loads(r["body"] or "{}"))
        return iter(self.out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        self.out, self.key, self.ms = [], key[0], expiredTimerInfo.getExpiryTimeInMs()
        self._roll(datetime.fromtimestamp(self.ms / 1000, UTC).strftime("%Y-%m-%d"))
        return iter(self.out)

    def close(self) -> None:
        pass

    def _say(self, action: str, pair: str | None = None, ticket: int | None = None, price: float | None = None, said: str = "") -> None:
        self.out.append(Row(instance=self.key, ts=self.ms, pair=pair, ticket=ticket, action=action, price=price, said=said))

    def _get(self, name: str) -> dict:
        names = [x.split()[0] for x in VARIABLES[name].split(", ")]
        variable = getattr(self, name)
        empty = {"day": ("", 0, 0, 0, 0.0, 0.0), "account": (0.0, 0.0, 0.0, "")}[name]
        return dict(zip(names, variable.get() if variable.exists() else empty, strict=True))

    def _put(self, name: str, value: dict) -> None:
        getattr(self, name).update(tuple(value.values()))

    def _midnight(self, date: str) -> None:
        self.handle.registerTimer(int(datetime.strptime(date, "%Y-%m-%d").replace(tzinfo=UTC).timestamp() * 1000) + DAY_MS)

    def _roll(self, date: str) -> None:
        day = self._get("day")
        if date <= day["date"]:  # also a late event of the day before
            return
        if day["date"]:
            self._say("rollover", said=f"{day['date']} {day['trades']}")
        self._put("day", {"date": date, "trades": 0, "wins": 0, "losses": 0, "pips": 0.0, "money": 0.0})
        account = self._get("account")
        if account["breaker"] == "daily_loss":
            self._put("account", account | {"breaker": ""})
            self._say("breaker_reset", said="daily_loss")
        self._midnight(date)

    def _account(self, b: dict) -> None:
        account = self._get("account")
        self._put("account", {"balance": b["balance"], "equity": b.get("equity", b["balance"]), "peak": max(account["peak"], b["balance"]), "breaker": account["breaker"]})

    def _trip(self, b: dict) -> None:
        self._put("account", self._get("account") | {"breaker": b["said"]})
        self._say("breaker_trip", said=b["said"])

    def _reset(self, b: dict) -> None:
        self._put("account", self._get("account") | {"breaker": ""})
        self._say("breaker_reset")

    def _seen(self, pair: str) -> tuple[int, int, list[float]]:
        if not self.pairs.containsKey((pair,)):
            return -1, -1, []
        last_bar, last_signal, ranges = self.pairs.getValue((pair,))
        return last_bar, last_signal, json.loads(ranges)

    def _open(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.positions.iterator()}

    def _bar(self, b: dict) -> None:
        last_bar, last_signal, ranges = self._seen(b["pair"])
        if b["s"] <= last_bar:
            return
        ranges = [*ranges, b["high"] - b["low"]][-500:]
        self.pairs.updateValue((b["pair"],), (b["s"], last_signal, json.dumps(ranges)))
        for ticket, held in sorted(self._open().items()):
            if held[0] != b["pair"]:
                continue
            pair, share, realised, volume, pip_value, body = held
            p, actions = manage(Position(**json.loads(body)), b, ranges, self.pip)
            before = Position(**json.loads(body))
            for action, price in actions:
                self._say(action, pair, ticket, price)
                if action == "partial_close":
                    realised += before.direction * (price - before.entry) / self.pip * share * before.partial_pct / 100
                    share *= 1 - before.partial_pct / 100
            if p is None:
                self._closed(ticket, (pair, share, realised, volume, pip_value, body), actions[-1][1])
            else:
                self.positions.updateValue((ticket,), (pair, share, realised, volume, pip_value, json.dumps(asdict(p))))

    def _closed(self, ticket: int, held: tuple, price: float) -> None:
        _, share, realised, volume, pip_value, body = held
        p = Position(**json.loads(body))
        pips = round(p.direction * (price - p.entry) / self.pip * share + realised, 4)
        day = self._get("day")
        day |= {"wins": day["wins"] + (pips >= 0), "losses": day["losses"] + (pips < 0), "pips": day["pips"] + pips, "money": day["money"] + pips * pip_value * volume}
        self._put("day", day)
        self.positions.removeKey((ticket,))

    def _deal(self, b: dict) -> None:
        held = self._open().get(b["ticket"])
        if held is None:
            return
        said = (b.get("comment") or "").lower()
        self._say("closed_by_broker", held[0], b["ticket"], b["price"], next((name for mark, name in REASONS if mark in said), "broker_close"))
        self._closed(b["ticket"], held, b["price"])

    def _signal(self, b: dict) -> None:
        last_bar, last_signal, ranges = self._seen(b["pair"])
        if b["s"] != last_bar or b["s"] == last_signal:
            return
        self.pairs.updateValue((b["pair"],), (last_bar, b["s"], json.dumps(ranges)))
        account, day = self._get("account"), self._get("day")
        reason = refusal(day, account, [x[0] for x in self._open().values()], b["pair"], b.get("spread_pips", 0.0), self.limits)
        if reason:
            self._say("refused", b["pair"], b["ticket"], b["entry"], reason)
            if reason in ("daily_loss", "drawdown"):
                self._trip({"said": reason})
            return
        volume = lots(account["balance"], b["sl_pips"], b["pip_value"], self.limits["risk_pct"])
        known = {f.name for f in fields(Position)}
        body = json.dumps(asdict(Position(**{k: v for k, v in b.items() if k in known})))
        self.positions.updateValue((b["ticket"],), (b["pair"], 1.0, 0.0, volume, b["pip_value"], body))
        self._put("day", day | {"trades": day["trades"] + 1})
        self._say("order", b["pair"], b["ticket"], b["entry"], f"{volume:.2f}")


def run_cycle(events: DataFrame, pip: float, limits: dict | None = None, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """Actions of a stream of events; the session's state store must be RocksDB (``PROVIDER``).

    Events later than ``late`` may come in any order between batches; within a batch they are sorted.
    """
    conf = "spark.sql.streaming.stateStore.providerClass"
    if not events.sparkSession.conf.get(conf, "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {conf} to {PROVIDER}")
    keyed = events.withWatermark("ts", late).groupBy("instance")
    first = None if initial is None else initial.groupBy("instance")
    return keyed.transformWithState(Cycle(pip, limits), OUT, "Append", "EventTime", initialState=first)


def state_tables(spark: SparkSession, checkpoint: str) -> dict[str, DataFrame]:
    """The four state variables of a query by its checkpoint folder, as tables."""
    out = {}
    for name in VARIABLES:
        table = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        key = F.col("key.instance").alias("instance")
        if name in KEYS:
            user = KEYS[name].split()[0]
            out[name] = table.select(key, F.col(f"user_map_key.{user}").alias(user), *[F.col(f"user_map_value.{x.split()[0]}") for x in VARIABLES[name].split(", ")]) if "user_map_key" in table.columns else table.select(key, F.explode("map_value").alias("k", "v")).select("instance", f"k.{user}", "v.*")
        else:
            out[name] = table.select(key, "value.*")
    return out


def initial_state(tables: dict[str, DataFrame]) -> DataFrame:
    """(instance, state): one JSON text for each instance, to begin another query with."""
    parts = None
    for name, t in tables.items():
        if name in KEYS:
            user, rest = t.columns[1], t.columns[2:]
            mine = t.groupBy("instance").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("["), _quoted(user), F.lit(","), _listed(rest), F.lit("]")))), ","), F.lit("]")).alias("text"))
        else:
            mine = t.select("instance", _listed(t.columns[1:]).alias("text"))
        mine = mine.select("instance", F.concat(F.lit(f'"{name}":'), "text").alias("text"))
        parts = mine if parts is None else parts.unionByName(mine)
    return parts.groupBy("instance").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("text")), ","), F.lit("}")).alias("state"))


def _quoted(name: str) -> Column:
    """A column as a JSON value."""
    return F.regexp_extract(F.to_json(F.struct(F.col(name).alias("x")), {"ignoreNullFields": "false"}), r'(?s)^\{"x":(.*)\}$', 1)


def _listed(names: list[str]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[_quoted(n) for n in names]), F.lit("]"))


class Heartbeat(StreamingQueryListener):
    """Appends one JSON line for each batch of a query to a folder: time, batch, rows, whether it still runs.

    Files are written through Spark, so the folder may lie in any store that it knows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _beat(self, query: str, batch: int | None, rows: int | None, status: str) -> None:
        row = [(datetime.now(UTC).replace(tzinfo=None), query, batch, rows, status)]
        self.spark.createDataFrame(row, "at timestamp_ntz, query string, batch long, rows long, status string").coalesce(1).write.mode("append").json(self.path)

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        self._beat(str(event.id), None, None, "started")

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        self._beat(str(event.progress.id), event.progress.batchId, event.progress.numInputRows, "running")

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        self._beat(str(event.id), None, 0, "idle")

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        self._beat(str(event.id), None, None, "failed" if event.exception else "stopped")


def latest_beat(spark: SparkSession, path: str) -> DataFrame:
    """The last heartbeat of each query."""
    beats = spark.read.schema("at timestamp_ntz, query string, batch long, rows long, status string").json(path)
    return beats.groupBy("query").agg(F.max_by(F.struct("at", "batch", "rows", "status"), "at").alias("x")).select("query", "x.*")
