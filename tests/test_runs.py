"""Staged validation, the search as a whole, and verification runs."""

import json

import numpy as np
from pyspark.sql import functions as F

from quantloom.operators import quality, runs, search


def test_stages_eliminate_resume_and_stop(spark, tmp_path):
    candidates = spark.range(6).withColumnRenamed("id", "candidate")
    seen = {"a": 0, "b": 0}

    def stage(name, rule):
        def run(df):
            seen[name] += 1
            return df.select("candidate", rule.alias("passed"), (F.col("candidate") * 10).alias("measure"))
        return name, run

    c = F.col("candidate")
    stages = [stage("a", c > 1), stage("b", F.when(c != 4, c != 3)), ("late", lambda df: df.select("candidate", F.lit(False).alias("passed")))]
    want = {0: "a", 1: "a", 2: None, 3: "b", 4: "b", 5: None}
    out = runs.validate(candidates, stages, str(tmp_path), stop=lambda name: name == "late")
    assert "late" not in out.columns
    rows = {r.candidate: r for r in out.collect()}
    assert {k: r.eliminated_by for k, r in rows.items()} == want
    assert rows[0].b is None and rows[3].b.measure == 30
    out = runs.validate(candidates, stages, str(tmp_path), advisory=("late",))
    rows = {r.candidate: r for r in out.collect()}
    assert seen == {"a": 1, "b": 1}  # taken from the folder
    assert {k: r.eliminated_by for k, r in rows.items()} == want
    assert all(r.late.passed is False for r in rows.values())


def test_stages_without_candidates(spark, tmp_path):
    none = spark.createDataFrame([], "candidate long")
    out = runs.validate(none, [("a", lambda df: df.select("candidate", F.lit(True).alias("passed")))], str(tmp_path))
    assert out.count() == 0 and "a" in out.columns


def _space():
    return search.ParamSpace().add("x", range(20), "signal").add("y", range(20), "risk").add("z", range(20), "exit_time")


def test_optimise_finds_the_best_and_counts():
    modes = []

    def evaluate(index, full=False):
        modes.append(full)
        return 100.0 - ((index - np.array([13, 4, 9])) ** 2).sum(1)

    found, count = runs.optimise(_space(), evaluate, 400, refine=500, passing=lambda i: i[:, 0] >= 13)
    assert found[0] == ({"x": 13, "y": 4, "z": 9}, 100.0)
    assert all(v["x"] >= 13 for v, _ in found) and count["passing"] == len(found)
    assert [q for _, q in found] == sorted((q for _, q in found), reverse=True)
    assert count["refined"] == 500 and set(modes) == {False, True}
    single, count = runs.optimise(_space(), evaluate, 400, refine=100, passing=lambda i: np.zeros(len(i), bool))
    assert len(single) == 1 and count["passing"] == 0


def test_params_come_from_the_checkpoint_or_a_sample(spark):
    stored = spark.createDataFrame([(1.0, 3, 4, 5), (None, 9, 9, 9), (2.0, 6, 7, 8)], "composite double, x int, y int, z int")
    assert runs.load_params(stored, _space()) == {"x": 6, "y": 7, "z": 8}
    assert set(runs.load_params(stored.limit(0), _space())) == {"x", "y", "z"}


def test_verification_over_the_live_period(spark):
    day = 86400
    bars = spark.range(100).select(F.lit("p").alias("pair"), F.timestamp_seconds(F.col("id") * day).cast("timestamp_ntz").alias("ts"))
    live = spark.createDataFrame(
        [("p", "g", 1, 1, 50 * day, 51 * day, 1.10, 1.20, 10.0, "TP"), ("p", "g", 2, -1, 60 * day, None, 1.30, 1.25, 5.0, "sl")],
        "pair string, group string, live_id long, direction int, s long, exit_s long, entry double, exit double, pnl double, reason string",
    )
    seen = {}

    def replay(df):
        seen["bars"] = [r[0] for r in df.select((F.unix_seconds(F.col("ts").cast("timestamp")) / day).cast("long")).orderBy("ts").collect()]
        made = [("p", "g", 7, 1, 40 * day, 1.0, 1.0, 0.0, "sl"), ("p", "g", 8, 1, 50 * day + 600, 1.09, 1.20, 11.0, "take_profit"), ("p", "g", 9, -1, 60 * day, 1.30, 1.26, 4.0, "tp")]
        return spark.createDataFrame(made, "pair string, group string, replay_id long, direction int, s long, entry double, exit double, pnl double, reason string")

    compared, totals = runs.verify(live, bars, replay, 0.01)
    assert seen["bars"] == list(range(20, 61))
    rows = {r.live_id: r for r in compared.collect()}
    assert (rows[1].replay_id, rows[1].entry_slippage, rows[1].minutes, rows[1].same_reason) == (8, 1.0, -10.0, True)
    assert (rows[2].replay_id, rows[2].exit_slippage, rows[2].same_reason) == (9, -1.0, False)
    total = totals.first()
    assert (total.matched, total.live_rate, total.replay_rate) == (2, 1.0, 1.0)
    lines = runs.verification_report(compared, totals).collect()
    assert sorted(r.kind for r in lines) == ["total", "trade", "trade"]
    assert json.loads(next(r.json for r in lines if r.live_id == 2))["pnl_delta"] == 1.0


def test_gaps_by_hand(spark):
    steps = [
        ("2024-03-06 10:00", "2024-03-06 14:00", "unexpected"),  # a Wednesday
        ("2024-03-08 20:00", "2024-03-10 23:00", "weekend"),  # Friday evening
        ("2024-03-09 12:00", "2024-03-09 20:00", "weekend"),  # Saturday
        ("2024-03-10 12:00", "2024-03-10 20:00", "weekend"),  # Sunday
        ("2024-03-11 00:00", "2024-03-11 04:00", "unexpected"),  # Monday, ends too late
        ("2024-03-07 12:00", "2024-03-09 12:00", "weekend"),  # two days up to a Saturday
        ("2024-03-05 12:00", "2024-03-07 12:00", "unexpected"),  # two days without one
        ("2024-12-24 08:00", "2024-12-24 16:00", "holiday"),
        ("2024-12-31 08:00", "2024-12-31 16:00", "holiday"),
        ("2025-01-02 08:00", "2025-01-02 16:00", "holiday"),
    ]
    rows = [(str(i), t) for i, (a, b, _) in enumerate(steps) for t in (a, b)]
    bars = spark.createDataFrame(rows, "pair string, t string").select("pair", F.col("t").cast("timestamp_ntz").alias("ts"))
    got = {int(r.pair): r.kind for r in quality.gaps(bars, "H1").collect()}
    assert got == {i: kind for i, (_, _, kind) in enumerate(steps)}
