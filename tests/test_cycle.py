"""The live cycle: repeats, a change of day, a broker's close, a breaker, restart from state, heartbeats."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.streaming import cycle

START = datetime(2024, 3, 4, 20, 0)
EVENTS = "instance string, ts timestamp, seq long, kind string, body string"


@pytest.fixture()
def rocks(spark):
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, cycle.PROVIDER)
    yield spark
    spark.conf.unset(conf)


def event(hour, seq, kind, instance="a", **body):
    return (instance, START + timedelta(hours=hour), seq, kind, json.dumps(body))


def bar(hour, low, high, pair="x", **more):
    return event(hour, 10 * hour, "bar", pair=pair, s=3600 * hour, open=low, high=high, low=low, close=(low + high) / 2, **more)


def signal(hour, ticket, seq=1, pair="x", spread=1.0, **more):
    body = {"pair": pair, "s": 3600 * hour, "ticket": ticket, "direction": 1, "entry": 100.0, "sl": 99.0, "tp": 103.0, "sl_pips": 100.0, "pip_value": 1.0, "spread_pips": spread}
    return event(hour, 10 * hour + seq, "signal", **(body | more))


BATCHES = [
    [event(0, -1, "account", balance=10_000.0), bar(0, 99.9, 100.1), signal(0, 1, be_trigger=50.0, be_offset=5.0), signal(0, 2, seq=2)],
    [bar(1, 99.9, 100.6), bar(1, 90.0, 100.6), signal(1, 3), bar(2, 100.2, 100.9)],  # breakeven; the second bar 1 is a repeat; x is held already
    [event(2, 25, "deal", ticket=1, price=101.5, comment="[tp 101.5]"), signal(2, 4, seq=6, spread=9.0)],
    [bar(3, 99.9, 100.2), signal(3, 5), event(3, 39, "deal", ticket=5, price=96.0, comment="by hand")],
    [bar(5, 99.0, 100.0), signal(5, 6)],  # the next day: trades start again
    [event(6, 60, "account", balance=1000.0, equity=1000.0), event(6, 61, "trip", said="manual"), bar(6, 99.5, 100.0), signal(6, 7, seq=3), event(6, 64, "reset")],
    [bar(80, 99.5, 100.0)],  # days later: the timer of midnight has closed the days between
]
WANT = [
    (0, 1, "order", "1.00"), (1, 1, "move_stop", ""), (1, 3, "refused", "same_symbol"), (2, 1, "closed_by_broker", "take_profit"), (2, 4, "refused", "spread"), (3, 5, "order", "1.00"),
    (3, 5, "closed_by_broker", "broker_close"), (5, None, "rollover", "2024-03-04 2"), (5, 6, "order", "1.00"), (6, None, "breaker_trip", "manual"), (6, 7, "refused", "circuit_breaker"),
    (6, None, "breaker_reset", ""),
]


def play(spark, tmp_path, name, batches, initial=None, listener=None):
    """Run batches one by one through a query; its actions in order."""
    source, checkpoint = tmp_path / f"{name}-in", str(tmp_path / f"{name}-cp")
    source.mkdir(exist_ok=True)
    out = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        if k and initial is not None:
            raise AssertionError("an initial state belongs to the first batch")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source))
    acts = cycle.run_cycle(stream, 0.01, {"daily_trades": 3}, initial=initial)
    q = acts.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    q.awaitTermination()
    out = [tuple(r) for r in spark.table(name).orderBy("ts").collect()]
    return out, checkpoint


def told(rows):
    hour = lambda ms: round((ms / 1000 - (START - datetime(1970, 1, 1)).total_seconds()) / 3600)
    return sorted(((hour(r[1]), r[3], r[4], r[6]) for r in rows), key=repr)


def test_cycle(rocks, tmp_path):
    rows, checkpoint = play(rocks, tmp_path, "whole", BATCHES)
    got = told(rows)
    days = [x for x in got if x[2] == "rollover" and x[0] > 6]
    assert sorted((x for x in got if x not in days), key=repr) == sorted([*WANT, *[x for x in got if x[2] in ("close_max_bars",)]], key=repr)
    assert days
    tables = {k: v.collect() for k, v in cycle.state_tables(rocks, checkpoint).items()}
    assert [r["ticket"] for r in tables["positions"]] == [6] and tables["pairs"][0]["last_bar"] == 80 * 3600
    assert tables["account"][0]["balance"] == 1000.0 and tables["account"][0]["peak"] == 10_000.0


def test_restart_from_state_goes_on_as_without_a_stop(rocks, tmp_path):
    before, checkpoint = play(rocks, tmp_path, "half", [[x for b in BATCHES[:2] for x in b]])
    tables = cycle.state_tables(rocks, checkpoint)
    assert [(r["ticket"], json.loads(r["body"])["be_done"]) for r in tables["positions"].collect()] == [(1, True)]
    state = rocks.createDataFrame(cycle.initial_state(tables).collect(), "instance string, state string")
    after, _ = play(rocks, tmp_path, "rest", [[x for b in BATCHES[2:6] for x in b]], initial=state)
    assert told([*before, *after]) == sorted(WANT, key=repr)


def test_daily_loss_trips_until_midnight(rocks, tmp_path):
    loss = [event(0, -1, "account", balance=1000.0), bar(0, 99.9, 100.1), signal(0, 1, pip_value=10.0), event(0, 5, "deal", ticket=1, price=60.0, comment="sl"), bar(1, 99.9, 100.1), signal(1, 2), bar(2, 99.9, 100.1), signal(2, 3), bar(4, 99.9, 100.1), signal(4, 4)]
    rows, _ = play(rocks, tmp_path, "loss", [loss])
    assert [x[2:] for x in told(rows) if x[2] != "order"] == sorted([("closed_by_broker", "stop_loss"), ("refused", "daily_loss"), ("breaker_trip", "daily_loss"), ("refused", "circuit_breaker"), ("rollover", "2024-03-04 1"), ("breaker_reset", "daily_loss")], key=lambda x: next(repr(y) for y in told(rows) if y[2:] == x))
    assert (4, 4, "order", "0.10") in told(rows)


def test_scalar_rules_equal_the_columns(spark):
    from quantloom.operators import risk

    day, limits = {"trades": 2, "money": -5.0}, cycle.LIMITS
    cases = [("", 0, 0.0, 100.0, 100.0, 100.0, [], 1.0), ("m", 99, 0.0, 100.0, 1.0, 100.0, [], 9.0), ("", 10, -9.0, 100.0, 1.0, 100.0, ["x"], 9.0), ("", 0, -3.0, 100.0, 1.0, 100.0, [], 1.0), ("", 0, 0.0, 100.0, 90.0, 100.0, ["x"], 1.0), ("", 0, 0.0, 100.0, 100.0, 0.0, ["a", "b", "c"], 1.0), ("", 0, 0.0, 100.0, 100.0, 0.0, ["x"], 1.0), ("", 0, 0.0, 100.0, 100.0, 0.0, [], 3.5)]
    rows = [(b != "", t, m, bal, eq, pk, len(h), h.count("x"), s) for b, t, m, bal, eq, pk, h, s in cases]
    df = spark.createDataFrame(rows, "breaker boolean, daily_trades int, daily_pnl double, balance double, equity double, peak_equity double, open_positions int, same_symbol int, spread_pips double").coalesce(1)
    want = [r["x"] for r in df.select(risk.pre_trade().alias("x")).collect()]
    got = [cycle.refusal(day | {"trades": t, "money": m}, {"breaker": b, "balance": bal, "equity": eq, "peak": pk}, h, "x", s, limits) or "ok" for b, t, m, bal, eq, pk, h, s in cases]
    assert got == want and len(set(want)) == 8
    sizes = [(10_000.0, 30.0, 10.0), (10_000.0, 33.0, 7.0), (50.0, 100.0, 10.0), (1e9, 1.0, 1.0), (100.0, 0.0, 1.0)]
    df = spark.createDataFrame(sizes, "a double, b double, c double").coalesce(1)
    assert [r["x"] for r in df.select(risk.position_size(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == [cycle.lots(*x, 1.0) for x in sizes]


def test_heartbeat(rocks, tmp_path):
    beats = str(tmp_path / "beats")
    listener = cycle.Heartbeat(rocks, beats)
    rocks.streams.addListener(listener)
    try:
        play(rocks, tmp_path, "beat", BATCHES[:1])
        for _ in range(100):
            try:
                last = cycle.latest_beat(rocks, beats).collect()
            except Exception:  # nothing is written yet
                last = []
            if last and last[0]["status"] == "stopped":
                break
            import time

            time.sleep(0.2)
    finally:
        rocks.streams.removeListener(listener)
    assert last[0]["status"] == "stopped"
    assert rocks.read.json(beats).where("status = 'running' and rows = 4").count() == 1
