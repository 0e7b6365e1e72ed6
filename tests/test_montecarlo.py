"""Resampling against literal loops, and the rows that a plan makes."""

import statistics

import pytest

from quantloom.operators import montecarlo


def literal(pnl, iterations, block):
    """Sharpe per trade of each resample; nulls stay out of mean and deviation."""
    out = []
    for i in range(iterations):
        kept = []
        for d in range(-(-len(pnl) // block)):
            x = 12_345
            for part in (i, d):
                x = ((x * 48_271 + part * 69_621 + 11) % montecarlo.MODULUS * 16_807 + 7) % montecarlo.MODULUS
            kept += [v for v in pnl[x % len(pnl) :][:block] if v is not None]
        sd = statistics.stdev(kept) if len(kept) > 1 else 0
        out.append(statistics.mean(kept) / sd if sd > 0 else 0.0)
    return out


def most_rows(df):
    """The most rows that an operator of an executed plan gave."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            rows = node.metrics().get("numOutputRows")
            most = max(most, rows.get().value() if rows.isDefined() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


SERIES = {"a": [(37 * i % 101) - 48.5 for i in range(230)], "b": [1.5], "c": [None if i % 5 == 2 else (i * i % 13) - 5.0 for i in range(41)], "d": [2.0] * 12}


@pytest.mark.parametrize("held, draws", [(1 << 20, 1 << 16), (64, 7)])
def test_bootstrap_equals_a_loop(spark, monkeypatch, held, draws):
    """Ranges smaller than a series, blocks over their ends, one result, nulls, equal results."""
    monkeypatch.setattr(montecarlo, "RANGE", held)
    monkeypatch.setattr(montecarlo, "DRAWS", draws)
    rows = [(k, i, v) for k, pnl in SERIES.items() for i, v in enumerate(pnl)] + [(None, 0, 1.0)]
    got = {r["key"]: r for r in montecarlo.block_bootstrap(spark.createDataFrame(rows, "key string, seq long, pnl double"), 60).collect()}
    assert set(got) == set(SERIES)
    for k, pnl in SERIES.items():
        want = sorted(literal(pnl, 60, 10))
        assert got[k]["mean"] == pytest.approx(statistics.mean(want), abs=1e-9)
        assert got[k]["p50"] == pytest.approx(statistics.median(want), abs=1e-9)


def test_no_draw_is_a_row(spark):
    """4,000 results make 400,000 draws."""
    pnl = spark.range(4_000).selectExpr("'a' as key", "id as seq", "cast(id * 7 % 23 - 10 as double) as pnl")
    assert most_rows(montecarlo.block_bootstrap(pnl)) < 10_000


def test_record_makes_no_row_of_a_draw(spark):
    """Signs of 1,000 iterations are 34 rows a result; draws would be 400,000 rows."""
    pnl = spark.range(4_000).selectExpr("'a' as key", "id as seq", "cast(id * 7 % 23 - 10 as double) as pnl")
    assert most_rows(montecarlo.record(pnl, ["key"], ["seq"], trials=10)) <= 34 * 4_000
