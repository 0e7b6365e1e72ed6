"""Out-of-sample validation: walk-forward, purged cross-validation, stability, gates and confidence."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.order import ranked


def windows(n_bars: DataFrame, size: int = 3024, step: int = 1512, embargo: int = 168, anchored: bool = False) -> DataFrame:
    """Full windows (pair, window_id, start_bar, end_bar) over pair, n; the stride is step + embargo.  Anchored ones all start at 0."""
    stride = step + embargo
    out = n_bars.where(F.col("n") >= size).select("pair", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - size) / stride))).alias("window_id"))
    start = F.col("window_id") * stride
    return out.select("pair", "window_id", (F.lit(0).cast("long") if anchored else start).alias("start_bar"), (start + size).alias("end_bar"), "n")


def label_windows(found: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds is_oos: the window doesn't overlap the first int(share * n) bars."""
    return found.withColumn("is_oos", F.col("start_bar") >= F.floor(F.col("n") * F.lit(share)))


def window_passes(min_trades: int = 10) -> Column:
    return (F.col("trades") >= min_trades) & (F.col("sharpe") > 0) & (F.col("quality") > 0)


def walk_forward(results: DataFrame, keys: tuple[str, ...] = ("candidate",), min_trades: int = 10, pass_gate: float = 0.6, sharpe_gate: float = 0.3) -> DataFrame:
    """Per candidate over window results (is_oos, trades, sharpe, quality): rates, means, WFE, and the gate."""
    oos, enough = F.col("is_oos"), F.col("trades") >= min_trades
    passed = oos & window_passes(min_trades)
    q = F.col("quality")
    out = results.groupBy(*keys).agg(
        F.sum(F.when(oos, 1).otherwise(0)).alias("n_oos"),
        F.sum(F.when(passed, 1).otherwise(0)).alias("n_passed"),
        F.avg(F.when(oos & enough, F.col("sharpe"))).alias("mean_sharpe"),
        F.avg(F.when(oos, q)).alias("mean_quality"),
        F.min(F.when(oos, q)).alias("min_quality"),
        F.exp(F.avg(F.when(passed, F.ln(q)))).alias("geo_quality"),
        F.stddev_pop(F.when(oos, q)).alias("_sd"),
        F.max(F.when(~oos, q)).alias("_is"),
    )
    out = out.withColumns({"pass_rate": F.when(F.col("n_oos") > 0, F.col("n_passed") / F.col("n_oos")).otherwise(0.0), "cv_quality": F.when(F.col("mean_quality") > 0, F.col("_sd") / F.col("mean_quality")).otherwise(0.0), "wfe": F.when(F.col("_is") > 0, F.col("mean_quality") / F.col("_is")).otherwise(0.0)})
    ok = (F.col("n_oos") > 0) & (F.col("pass_rate") >= pass_gate) & (F.coalesce("mean_sharpe", F.lit(0.0)) >= sharpe_gate)
    return out.withColumn("passed", ok).drop("_sd", "_is").na.fill(0.0)


def blocks(n_bars: DataFrame, count: int = 10) -> DataFrame:
    """(pair, block, start_bar, end_bar): equal blocks, the first ones take the remainder."""
    size, rest = F.floor(F.col("n") / count), F.col("n") % count
    out = n_bars.select("pair", "n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"))
    start = F.col("block") * size + F.least(F.col("block"), rest)
    return out.select("pair", "block", start.cast("long").alias("start_bar"), (start + size + F.when(F.col("block") < rest, 1).otherwise(0)).cast("long").alias("end_bar"))


def folds(spark: SparkSession, count: int = 10, k: int = 2) -> DataFrame:
    """(fold, block) of every choice of k test blocks: C(count, k) folds."""
    rows = [(i, b) for i, chosen in enumerate(combinations(range(count), k)) for b in chosen]
    return spark.createDataFrame(rows, "fold int, block int")


def purged(found: DataFrame, chosen: DataFrame, purge: int = 200, embargo: int = 168) -> DataFrame:
    """Per pair and fold the number of training bars lost to the purge on both sides of test blocks and the embargo after them."""
    test = found.join(chosen, "block").select("pair", "fold", F.col("block").alias("tb"), F.col("start_bar").alias("ts_"), F.col("end_bar").alias("te_"))
    pieces = test.select("pair", "fold", F.explode(F.array(F.struct((F.col("ts_") - purge).alias("a"), F.col("ts_").alias("b")), F.struct(F.col("te_").alias("a"), (F.col("te_") + max(purge, embargo)).alias("b")))).alias("x")).select("pair", "fold", "x.a", "x.b")
    train = found.crossJoin(F.broadcast(chosen.select("fold").distinct())).join(chosen, ["fold", "block"], "left_anti")  # C(count, k) folds
    cut = train.join(pieces, ["pair", "fold"]).select("pair", "fold", "block", F.greatest("start_bar", "a").alias("a"), F.least("end_bar", "b").alias("b")).where("a < b")
    w = Window.partitionBy("pair", "fold", "block").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = cut.withColumn("seen", F.coalesce(F.max("b").over(w), F.col("a"))).select("pair", "fold", F.greatest(F.col("b") - F.greatest("a", "seen"), F.lit(0)).alias("n"))
    every = found.select("pair").distinct().crossJoin(F.broadcast(chosen.select("fold").distinct()))
    return every.join(fresh.groupBy("pair", "fold").agg(F.sum("n").alias("n_purged")), ["pair", "fold"], "left").na.fill(0)


def cpcv(fold_scores: DataFrame, keys: tuple[str, ...] = ("candidate",), pct_gate: float = 0.6, sharpe_gate: float = 0.2) -> DataFrame:
    """Distribution of fold Sharpe ratios (fold means over test blocks) per candidate, with a 95 % interval and the gate."""
    per = fold_scores.groupBy(*keys, "fold").agg(F.avg("sharpe").alias("s"), F.avg("quality").alias("q"))
    out = per.groupBy(*keys).agg(F.count("*").alias("n_folds"), F.avg("s").alias("mean_sharpe"), F.percentile("s", F.lit(0.5)).alias("median_sharpe"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("sd_sharpe"), F.avg("q").alias("mean_quality"), F.avg(F.when(F.col("s") > 0, 1.0).otherwise(0.0)).alias("pct_positive"))
    half = 1.96 * F.col("sd_sharpe") / F.sqrt("n_folds")
    out = out.withColumns({"ci_low": F.col("mean_sharpe") - half, "ci_high": F.col("mean_sharpe") + half})
    return out.withColumn("passed", (F.col("pct_positive") >= pct_gate) & (F.col("mean_sharpe") >= sharpe_gate))


def perturbations(space: DataFrame, chosen: DataFrame, steps: int = 3) -> DataFrame:
    """(candidate, name, change, value) from space (name, kind, position, value) and chosen (candidate, name, position).

    Numeric parameters move 1..steps places either way, others take every other value.
    """
    both = chosen.withColumnRenamed("position", "at").join(space, "name").withColumn("change", F.col("position") - F.col("at"))
    near = F.when(F.col("kind") == "numeric", F.abs("change") <= steps).otherwise(F.lit(True))
    return both.where((F.col("change") != 0) & near).select("candidate", "name", "kind", "change", "value")


def stability(perturbed: DataFrame, keys: tuple[str, ...] = ("candidate",)) -> DataFrame:
    """Mean and least ratio to the original quality, the worst parameter, and a rating; no perturbation is robust."""
    ratio = F.when(F.col("original") > 0, F.col("quality") / F.col("original")).otherwise(0.0)
    rows = perturbed.withColumn("r", ratio)
    out = rows.groupBy(*keys).agg(F.count("r").alias("n"), F.avg("r").alias("mean_ratio"), F.min("r").alias("min_ratio"), F.min_by("name", F.struct("r", "seq")).alias("worst"))
    return out.withColumn("rating", stability_rating(F.col("mean_ratio"), F.col("min_ratio"), F.col("n")))


def stability_rating(mean: Column, least: Column, n: Column) -> Column:
    return F.when(n == 0, "ROBUST").when((mean >= 0.8) & (least >= 0.5), "ROBUST").when(mean >= 0.6, "MODERATE").when(mean >= 0.4, "FRAGILE").otherwise("OVERFIT")


def _scale(x: Column, low: float, high: float, share: float = 1.0) -> Column:
    """0 to 100 times ``share`` between two values; the product is one factor, for the same last digits as in SQL."""
    return 100 * share * F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


#: Weights of the composite; they add up to 1.
WEIGHTS = {"walk_forward": 0.30, "monte_carlo": 0.25, "forward_back": 0.15, "stability": 0.10, "dsr": 0.10, "backtest": 0.10}


#: Share of the cross-validation score in the walk-forward component, where there is one.
CPCV_SHARE = 0.4


def _ramp(x: Column, *points: tuple[float, float]) -> Column:
    """Straight lines through (x, score) points, level outside them.

    A line starts from its lower score, its width is the decimal difference of its points: so scores
    that end in few digits come out even, and a composite of 40 or 70 isn't a last digit below it.
    """
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        width, rise = round(x1 - x0, 12), float(abs(y1 - y0))
        line = float(min(y0, y1)) + rise * ((x - x0) if y1 >= y0 else (x1 - x)) / width
        out = F.when(x <= x1, line).otherwise(out)
    return F.when(x <= points[0][0], F.lit(float(points[0][1]))).otherwise(out)


def sub_scores() -> dict[str, Column]:
    """Scores of 0 to 100.

    From n_oos, pass_rate, geo_quality, min_quality, cv_quality (walk-forward); ci_low, ci_high, p_value,
    skip_quality (null if not tested), stress_ratio, dsr (resampling); ratio (forward to back);
    mean_ratio, min_ratio (stability); quality, trades, sharpe (back test); cpcv_folds (null or
    0 without), cpcv_positive, cpcv_sharpe, cpcv_low, cpcv_high.
    """
    c = F.col
    wf = 0.40 * 100 * c("pass_rate") + _scale(c("geo_quality"), 0, 50, 0.20) + _scale(c("min_quality"), 0, 20, 0.15) + 0.15 * 100 * F.greatest(1 - c("cv_quality"), F.lit(0.0)) + _scale(c("n_oos"), 0, 4, 0.10)
    width = c("ci_high") - c("ci_low")
    ci = F.when(c("ci_low") > 0, _scale(c("ci_low"), 0, 1)).when(width > 0, 50 * F.greatest(c("ci_high") / width, F.lit(0.0))).otherwise(0.0)
    chance = F.when(c("p_value") <= 0.001, 100.0).otherwise(_ramp(c("p_value"), (0.001, 100), (0.05, 80), (0.5, 0)))
    mc = 0.30 * ci + 0.30 * chance + 0.20 * F.coalesce(_scale(c("skip_quality"), 0, 30), F.lit(50.0)) + _scale(c("stress_ratio"), 0, 0.8, 0.20)
    cpcv = 0.40 * 100 * c("cpcv_positive") + _scale(c("cpcv_sharpe"), 0, 2, 0.30) + 0.20 * 100 * F.greatest(1 - (c("cpcv_high") - c("cpcv_low")) / 2, F.lit(0.0)) + _scale(c("cpcv_folds"), 0, 20, 0.10)
    wf = F.when(c("n_oos") > 0, wf).otherwise(0.0)
    return {
        "walk_forward": F.when(F.coalesce(c("cpcv_folds"), F.lit(0)) > 0, (1 - CPCV_SHARE) * wf + CPCV_SHARE * cpcv).otherwise(wf),
        "monte_carlo": mc,
        "forward_back": _scale(c("ratio"), 0, 1),
        "stability": _scale(c("mean_ratio"), 0.4, 1, 0.7) + _scale(c("min_ratio"), 0, 0.5, 0.3),
        "dsr": _ramp(c("dsr"), (0.5, 0), (0.95, 80), (0.99, 100)),
        "backtest": 0.50 * F.least(2 * c("quality"), F.lit(100.0)) + _scale(c("trades"), 0, 100, 0.25) + _scale(c("sharpe"), 0, 2, 0.25),
    }


def confidence(candidates: DataFrame, gates: tuple[str, ...]) -> DataFrame:
    """Adds the sub-scores (score_<name>), composite and rating: RED if a gate fails, else GREEN from 70, YELLOW from 40."""
    out = candidates.withColumns({f"score_{k}": v for k, v in sub_scores().items()})
    out = out.withColumn("composite", sum((F.col(f"score_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0)))
    failed = ~F.lit(True)
    for g in gates:
        failed = failed | ~F.coalesce(F.col(g), F.lit(False))
    return out.withColumn("confidence", F.when(failed, "RED").when(F.col("composite") >= 70, "GREEN").when(F.col("composite") >= 40, "YELLOW").otherwise("RED"))


def eliminate_thin(candidates: DataFrame, years: float) -> DataFrame:
    """Adds eliminated: fewer trades than max(200, int(30 * years))."""
    return candidates.withColumn("eliminated", F.col("trades") < max(200, int(30 * years)))


def auto_window(n_bars: int, trades: list[int], bars_per_year: float, trades_each: int = 30, share: float = 0.8) -> tuple[int, int]:
    """(size, step) for about ``trades_each`` trades a window at the median candidate's rate.

    Between a month and two years; no longer than lets three windows (two for slow
    candidates, under one trade in a hundred bars) fit into the bars after the first ``share``.
    """
    back = int(n_bars * share)
    counts = sorted(t for t in trades if t > 0)
    rate = counts[len(counts) // 2] / back if counts and back else 0.0
    size = int(trades_each / rate) if rate else int(bars_per_year * 0.5)
    least = int(bars_per_year / 12)
    size = max(least, min(size, int(bars_per_year * 2)))
    most = (n_bars - back) // (2 * (2 if 0 < rate < 0.01 else 3))
    if most > 0:
        size = min(size, max(least, most))
    return size, size // 2


def report(candidates: DataFrame) -> DataFrame:
    """rank and a JSON line per candidate, survivors first, best composite first."""
    told = candidates.select("*", F.to_json(F.struct(*candidates.columns)).alias("json"))
    return ranked(told, "rank", "eliminated", F.desc("composite"), "candidate").select("candidate", F.col("rank").cast("long").alias("rank"), "json")


def config_errors(weights: dict[str, float] | None = None, **gates: float) -> list[str]:
    """What is wrong with a configuration: weights that don't add up to 1 (give or take 0.01), gates outside 0 to 1."""
    total = sum((WEIGHTS if weights is None else weights).values())
    found = [f"the weights add up to {total:.3f} instead of 1"] if abs(total - 1) > 0.01 else []
    return found + [f"{name} must be between 0 and 1, not {x}" for name, x in gates.items() if not 0 <= x <= 1]
