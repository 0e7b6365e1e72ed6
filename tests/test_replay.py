"""Parameters of a point in time against a literal search, and a verification run over deployments."""

import random

from pyspark.sql import functions as F

from quantloom.operators import replay, runs
from quantloom.operators import signals as S
from quantloom.plans import full
from quantloom.plans.tables import PIP, hourly, sub_bars

DATA = "/root/testdata/sf0.001"


def test_params_at_a_point_in_time(spark):
    """Late corrections, equal times, versions of other groups and pairs, signals before any version."""
    rng = random.Random(9)
    versions = {(rng.choice("xy"), rng.choice([0, 1]), rng.randrange(50), rng.randrange(60)): k for k in range(60)}
    params = [(*key, k) for key, k in versions.items()]
    signals = [(rng.choice("xyz"), rng.randrange(70), i) for i in range(120)]
    got = replay.params_at(spark.createDataFrame(signals, "pair string, s long, n int"), spark.createDataFrame(params, "pair string, grp int, valid_s long, recorded_s long, k int"))
    want = set()
    for pair, s, n in signals:
        for grp in {p[1] for p in params if p[0] == pair}:
            known = [p for p in params if p[0] == pair and p[1] == grp and p[2] <= s and p[3] <= s]
            if known:
                best = max(known, key=lambda p: (p[2], p[3]))
                want.add((pair, grp, s, n, best[4]))
    assert {(r["pair"], r["grp"], r["s"], r["n"], r["k"]) for r in got.collect()} == want


def test_verification_of_deployments(spark):
    """Live trades that are the replay's own, one with another exit: all are matched, and only that one differs."""
    bars = hourly(spark, DATA).persist()
    subs = sub_bars(spark, DATA, bars)
    space = {
        "sl_mode": "fixed_pips", "sl_fixed_pips": 1500.0, "sl_atr_mult": 1.0, "tp_mode": "rr_ratio", "tp_rr_ratio": 2.0, "tp_atr_mult": 1.0, "tp_fixed_pips": 100.0, "trailing_mode": "fixed_pip",
        "trail_activate": 500.0, "trail_distance": 400.0, "trail_atr_mult": 1.0, "be_enabled": True, "be_trigger": 300.0, "be_offset": 10.0, "partial_enabled": False, "partial_pct": 50.0,
        "partial_trigger": 100.0, "max_bars": 100.0, "stale_enabled": False, "stale_bars": 10.0, "stale_thr": 1.0, "days_mask": 127, "hours_start": 0, "hours_end": 23, "trial_variant": -1,
    }
    lit = [F.lit(v).alias(k) for k, v in space.items()]
    params = spark.createDataFrame([("view", 0), ("click", 0)], "pair string, grp int").select("*", F.lit(0).alias("valid_s"), F.lit(0).alias("recorded_s"), *lit)
    made = replay.deployed(S.sma_crossover, params, subs, PIP)(bars).persist()
    assert {r["pair"] for r in made.select("pair").distinct().collect()} == {"view", "click"}
    last = F.col("replay_id") == 1
    live = made.withColumns({"live_id": F.col("replay_id"), "exit": F.when(last, F.col("exit") + 1.0).otherwise(F.col("exit")), "exit_s": F.lit(None).cast("long")}).where("pair = 'view'").drop("replay_id")
    compared, totals = runs.verify_deployed(live, bars, subs, S.sma_crossover, params, PIP)
    rows = compared.collect()
    n = live.count()
    assert len(rows) == n > 3 and all(r["same_reason"] for r in rows)
    assert sorted(round(abs(r["exit_slippage"]), 6) for r in rows) == [0.0] * (n - 1) + [1.0] or sum(abs(r["exit_slippage"]) > 1e-9 for r in rows) == 1
    assert totals.first()["matched"] == n
    some = sorted(r["s"] for r in live.collect())
    part, _ = runs.verify_deployed(live, bars, subs, S.sma_crossover, params, PIP, some[1], some[-2])
    assert part.count() == n - 2


def test_replay_uses_versions_that_differ(spark):
    t = full.c1(spark, DATA)
    assert t.count() > 50 and t.select("valid_s").distinct().count() > 20


def test_variants_and_wildcards_meet_once(spark):
    from quantloom.operators import simulate as T

    signals = [(i, v) for i, v in enumerate([5, 5, 7, -1, None, 0])]
    trials = [(i, v) for i, v in enumerate([5, 7, 9, -1, None, 0])]
    got = T.evaluate_by_variant(spark.createDataFrame(signals, "n int, variant long"), spark.createDataFrame(trials, "trial int, t_variant long"))
    off = lambda v: v is None or v < 0
    want = sorted((n, t) for n, v in signals for t, w in trials if off(v) or off(w) or v == w)
    assert sorted((r["n"], r["trial"]) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
