"""Registry, search, live state, streaming, sources and verification."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import strategy
from quantloom.operators import articles, search, validation, verification
from quantloom.streaming import live


def test_registry_knows_names_aliases_and_stages():
    assert strategy.get("ema") is strategy.get("ema_crossover")
    assert len(strategy.names()) == 11
    strategy.set_stage("ema", "validated")
    assert strategy.stage_of("ema_crossover") == "validated" and strategy.names("validated") == ["ema_crossover"]
    strategy.set_stage("ema", "research")
    with pytest.raises(KeyError):
        strategy.get("none")
    with pytest.raises(ValueError):
        strategy.Strategy("x", None, causal=False).generate(None, 0.01)


def test_days_round_trip():
    assert search.days_to_mask([0, 1, 2, 3, 4]) == 31
    assert all(search.days_to_mask(search.mask_to_days(m)) == m for m in range(128))


def test_space_encodes_and_decodes():
    s = search.standard_space()
    index = [len(p.values) // 2 for p in s.params]
    assert s.encode(s.decode(index)) == index
    assert s.combinations("time") == 24 * 24 * 4
    assert [n for n, _ in search.stages(s)] == ["time", "core_trade_profile", "rest"]


def test_widening_keeps_originals_and_stays_positive():
    wide = search.widen([10, 20, 30], 4)
    assert {10, 20, 30} <= set(wide) and min(wide) > 0 and len(wide) > 3


@pytest.mark.parametrize("kind", [search.RandomSampler, search.LowDiscrepancySampler, search.DistributionSampler, search.GeneticSampler, search.CovarianceSampler])
def test_samplers_respect_locks_and_ranges(kind):
    s = search.standard_space()
    x = kind(s, 1).sample(50, locked={"hours_end": 5}, centre={"hours_start": 10}, radius=2)
    names = s.names
    assert x.shape == (50, len(names))
    assert (x >= 0).all() and all((x[:, i] < len(p.values)).all() for i, p in enumerate(s.params))
    assert (x[:, names.index("hours_end")] == 5).all()
    assert (abs(x[:, names.index("hours_start")] - 10) <= 2).all()


def test_staged_search_finds_a_separable_optimum():
    s = search.ParamSpace().add("a", range(20), "signal").add("b", range(20), "time")
    best, value = search.staged_search(s, lambda m: -((m[:, 0] - 13) ** 2) - (m[:, 1] - 4) ** 2.0, 200, batch=50, exploiter=search.GeneticSampler)
    assert best["a"] == 13 and value <= 0


def test_distribution_sampler_learns():
    s = search.ParamSpace().add("a", range(5), "g")
    d = search.DistributionSampler(s)
    before = d.entropy()
    for _ in range(20):
        d.update(np.full((10, 1), 3))
    assert d.tables[0].argmax() == 3 and d.entropy() < before


def test_fold_layout_covers_the_end():
    folds = search.fold_layout(1000, 4, 20)
    assert folds[0][0] == 0 and folds[-1][1] == 1000 and all(b[0] - a[1] == 20 for a, b in zip(folds, folds[1:], strict=False))
    assert search.fold_count(30, 1) == 3 and search.fold_count(10_000, 40) == 7


def test_weights_add_up():
    assert abs(sum(validation.WEIGHTS.values()) - 1) < 1e-9
    assert validation.auto_window(60_000, [2_000], 6_048) == (720, 360)
    assert validation.auto_window(60_000, [100], 6_048) == (3_000, 1_500)
    assert validation.auto_window(60_000, [], 6_048) == (2_000, 1_000)


def test_greedy_matching_equals_a_loop(spark):
    rng = random.Random(5)
    times = [rng.randrange(40_000) for _ in range(60)] + [900_000 + rng.randrange(9_000) for _ in range(20)]  # two runs with a quiet time between
    a = [("g", i, rng.choice([1, -1]), s) for i, s in enumerate(times)]
    b = [("g", i, rng.choice([1, -1]), s + rng.randrange(-9_000, 9_000)) for i, s in enumerate(times)]
    used, want = set(), set()
    for _, i, d, s in sorted(a, key=lambda x: (x[3], x[1])):
        free = [(abs(x[3] - s), x[1]) for x in b if x[2] == d and x[1] not in used and abs(x[3] - s) <= 7200]
        if free:
            j = min(free)[1]
            used.add(j)
            want.add((i, j))
    got = verification.match(spark.createDataFrame(a, "group string, live_id long, direction int, s long"), spark.createDataFrame(b, "group string, replay_id long, direction int, s long"))
    assert {(r["live_id"], r["replay_id"]) for r in got.collect()} == want


def test_matching_without_candidate_pairs(spark):
    """20,000 trades of either side at one time: 400 million pairs are near enough, the stream reads 40,000 rows."""
    n = 20_000
    live = spark.range(n).select(F.lit("g").alias("group"), F.col("id").alias("live_id"), F.lit(1).alias("direction"), F.lit(5).alias("s"))
    replay = spark.range(n).select(F.lit("g").alias("group"), (F.col("id") * 3).alias("replay_id"), F.lit(1).alias("direction"), F.lit(7).alias("s"))
    got = verification.match(live, replay).collect()
    assert sorted((r["live_id"], r["replay_id"]) for r in got) == [(i, 3 * i) for i in range(n)]


@pytest.mark.parametrize("wide, minutes", [(60, 0.5), (9_000, 2), (9_000, 120), (3_000_000, 120)])
def test_matching_with_ties_nulls_and_copies(spark, wide, minutes):
    rng = random.Random(wide + int(minutes))
    some = lambda xs: rng.choice([*xs, None]) if rng.random() < 0.1 else rng.choice(xs)
    a = [(some(["g", "h"]), i, some([1, -1]), some([rng.randrange(-wide, wide)])) for i in range(300)]
    b = [(some(["g", "h"]), i, some([1, -1]), some([rng.randrange(-wide, wide)])) for i in range(300)]
    used, want = set(), []
    for g, i, d, s in sorted((x for x in a if None not in x), key=lambda x: (x[3], x[1])):
        free = [(abs(x[3] - s), x[1]) for x in b if None not in x and (x[0], x[2]) == (g, d) and x[1] not in used and abs(x[3] - s) <= 60 * minutes]
        if free:
            used.add(min(free)[1])
            want.append((g, i, min(free)[1]))
    frame = lambda rows, name: spark.createDataFrame(rows + rows[:40], f"group string, {name} long, direction int, s long")
    got = verification.match(frame(a, "live_id"), frame(b, "replay_id"), minutes)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_markdown():
    html = "<h2>T</h2><p>a <a href='u'>b</a></p><ul><li>x</li><li>y</li></ul><pre>k = 1\n</pre><table><tr><th>h</th></tr><tr><td>1</td></tr></table><script>no</script>"
    md = articles.to_markdown(html)
    assert "## T" in md and "a [b](u)" in md and "- x\n- y" in md and "```\nk = 1\n```" in md and "| h |\n| --- |\n| 1 |" in md and "no" not in md
    assert articles.to_markdown(None) == ""


def test_listing(spark):
    long = "A description of more than twenty characters. " * 20
    title = "T" * 600
    html = f"""<a href='/en/articles/1'>Outside a section</a>
    <section><header><h3><a href='/en/articles/12'>Title <b>in parts</b></a></h3></header><div>{long}</div><p>short</p></section>
    <section><header><a href='/en/articles/13'><img src='x' alt='From the image'></a></header><p>A first part of the text here</p><p>and a second one to follow it</p></section>
    <section><header><a href='/en/articles/14'>Tiny</a></header></section>
    <section><header><a href='/en/users/15'>Someone else</a><a href='/en/articles/16'>{title}</a></header></section>
    <section><a href='/en/articles/17'>Without a header</a></section>"""
    got = [tuple(r) for r in articles.links(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).collect()]
    assert got == [
        (1, 0, "12", "/en/articles/12", "Titlein parts", long[:500]),
        (1, 1, "13", "/en/articles/13", "From the image", "A first part of the text here and a second one to follow it"),
        (1, 2, "16", "/en/articles/16", title, ""),
    ]


def position(**more):
    return live.Position(ticket=1, direction=1, entry=100.0, sl=99.0, tp=103.0, **more)


def bar(high, low, close):
    return {"high": high, "low": low, "close": close}


def test_position_stops_targets_and_time():
    assert live.manage(position(), bar(100, 98.9, 99), [1.1], 0.01) == (None, [("close_sl", 99.0)])
    assert live.manage(position(), bar(103.5, 100, 103), [3.5], 0.01)[1] == [("close_tp", 103.0)]
    assert live.manage(position(max_bars=1), bar(100, 98, 99), [2], 0.01)[1] == [("close_max_bars", 99)]


def test_position_moves_stop_at_once():
    p, actions = live.manage(position(be_trigger=50.0, be_offset=1.0, trail_activate=100.0, trail_distance=50.0), bar(101.2, 100, 101), [1.2], 0.01)
    assert [a for a, _ in actions] == ["move_stop", "move_stop"] and abs(p.sl - 100.7) < 1e-9 and p.be_done and p.trailing
    assert live.backoff_seconds(0) == 0 and live.backoff_seconds(20) == 300


def test_stream_of_ticks_gives_closed_bars_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [{"pair": "x", "ts": f"2024-01-01T0{h}:{m:02d}:00", "price": float(10 * h + m)} for h in range(4) for m in (1, 30)]
    (src / "a.json").write_text("\n".join(map(json.dumps, lines)))
    ticks = spark.readStream.schema("pair string, ts timestamp, price double").json(str(src))
    q = live.closed_bars(ticks).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    rows = spark.table("closed").orderBy("ts").collect()
    assert [(r["open"], r["high"], r["close"], r["volume"]) for r in rows] == [(1.0, 30.0, 30.0, 2), (11.0, 40.0, 40.0, 2), (21.0, 50.0, 50.0, 2)]


def test_stream_of_bars_manages_positions(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    o = {"ticket": 7, "direction": 1, "entry": 100.0, "sl": 99.0, "tp": 103.0}
    b = [{"s": 1, "open": 100, "high": 101, "low": 99.5, "close": 100.5}, {"s": 1, "open": 0, "high": 0, "low": 0, "close": 0}, {"s": 2, "open": 100, "high": 104, "low": 100, "close": 103}]
    events = [("open", o), *(("bar", x) for x in b)]
    (src / "a.json").write_text("\n".join(json.dumps({"pair": "x", "seq": i, "kind": k, "body": json.dumps(v)}) for i, (k, v) in enumerate(events)))
    stream = spark.readStream.schema("pair string, seq long, kind string, body string").json(str(src))
    q = live.manage_positions(stream, 0.01).writeStream.format("memory").queryName("acts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert [(r["bar_s"], r["ticket"], r["action"], r["price"]) for r in spark.table("acts").collect()] == [(2, 7, "close_tp", 103.0)]


def test_sources(spark, tmp_path):
    from quantloom.sources import store, ticks

    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/EURUSD_2023.csv").write_text("ts,bid,ask\n2023-01-02T00:00:00,1.1,1.2\n2023-01-02T00:01:00,1.3,\n")
    ticks.register(spark)
    df = spark.read.format("yearly_prices").option("path", str(tmp_path / "csv")).option("pairs", "EURUSD").option("first", 2022).option("last", 2023).load()
    assert df.count() == 2 and df.where("ask is null").count() == 1
    root = str(tmp_path / "bars")
    rows = spark.createDataFrame([("a", "H1", 1.0), ("b", "H1", 2.0)], "pair string, tf string, close double")
    store.write_bars(rows, root)
    store.write_bars(rows.where("pair = 'a'").withColumn("close", rows["close"] + 5), root, overwrite=True)
    assert {(r["pair"], r["close"]) for r in store.read_bars(spark, root, timeframe="H1").collect()} == {("a", 6.0), ("b", 2.0)}
    nested = spark.createDataFrame([(1, {"x": 0.5})], "id int, gates map<string,double>")
    store.write_checkpoint(nested, str(tmp_path / "cp"))
    assert store.read_checkpoint(spark, str(tmp_path / "cp"), nested.schema).collect() == nested.collect()


def test_widening_fills_a_budget():
    s = search.ParamSpace().add("a", [1, 2, 3], "signal").add("b", [10.0, 20.0], "signal").add("mode", ["x", "y"], "signal").add("t", list(range(24)), "time")
    assert search.fill_factor(s, 12, "signal") == 1.0 and abs(search.fill_factor(s, 48, "signal") - 2.0) < 1e-9
    assert search.fill_factor(s, 10**9, "signal") == 10.0 and search.fill_factor(s, 5, "none") == 1.0
    wide, report = search.widen_to_budget(s, 480)
    assert report["signal"][0] == 12 < report["signal"][1] and wide.params[2].values == ("x", "y")
    assert report["time"][0] == 24 <= report["time"][1] and search.widen_to_budget(s, 100)[0].combinations() == s.combinations()


def test_config_errors():
    assert validation.config_errors(pass_rate_gate=0.6, dsr_gate=0.95, p_gate=0.05) == []
    found = validation.config_errors({"a": 0.5, "b": 0.4}, dsr_gate=1.2)
    assert len(found) == 2 and "0.900" in found[0] and "dsr_gate" in found[1]
