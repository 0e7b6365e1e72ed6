"""Runs of several steps: staged validation, a search as a whole, live trades against their replay."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import verification as VE
from quantloom.operators.bars import seconds
from quantloom.operators.replay import deployed
from quantloom.operators.search import ParamSpace, RandomSampler, staged_search


def _finished(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def validate(
    candidates: DataFrame,
    stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]],
    folder: str,
    advisory: Sequence[str] = (),
    stop: Callable[[str], bool] = lambda name: False,
) -> DataFrame:
    """Candidates with eliminated_by, the first stage they failed (null: none), and a struct of measures per finished stage.

    A stage takes the candidates left and returns candidate, passed and its measures; a candidate
    that it leaves out or whose passed is null has failed.  An advisory stage takes all candidates and
    eliminates none.  What a stage returns is written below ``folder``, which belongs to one run; a run
    that starts again takes finished stages from there.  ``stop`` is asked before each stage that isn't finished.
    """
    spark = candidates.sparkSession
    state = candidates.withColumn("eliminated_by", F.lit(None).cast("string"))
    for name, stage in stages:
        path = f"{folder}/{name}"
        if not _finished(spark, path):
            if stop(name):
                break
            entered = state if name in advisory else state.where("eliminated_by is null")
            stage(entered.select(*candidates.columns)).write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
        state = state.join(found.select("candidate", F.struct(*[c for c in found.columns if c != "candidate"]).alias(name)), "candidate", "left")
        if name not in advisory:
            failed = F.col("eliminated_by").isNull() & ~F.coalesce(F.col(f"{name}.passed"), F.lit(False))
            state = state.withColumn("eliminated_by", F.when(failed, name).otherwise(F.col("eliminated_by")))
    return state


#: Groups whose parameters act only in the full simulation; fixed values.
FULL_GROUPS = ("exit_trailing", "exit_protection_be", "exit_protection", "exit_time")


def optimise(
    space: ParamSpace,
    evaluate: Callable[..., np.ndarray],
    trials: int,
    refine: int = 2000,
    passes: int = 3,
    gain: float = 0.01,
    radius: int = 5,
    batch: int = 2048,
    passing: Callable[[np.ndarray], np.ndarray] | None = None,
    seed: int = 0,
) -> tuple[list[tuple[dict[str, int], float]], dict[str, int]]:
    """Passing candidates, best first, and counters of how many came how far.

    ``evaluate`` takes a matrix of indices and ``full``: one Spark batch each.  Stages are searched in the basic
    mode unless a group of theirs needs the full one; passes over all stages go on from the best so far until
    one gains less than ``gain``.  Last, all parameters move up to ``radius`` places around the best, in full
    mode.  If nothing passes, the single best is returned.
    """
    count = {"evaluated": 0, "passes": 0, "refined": 0, "passing": 0}

    def counted(index: np.ndarray, full: bool = False) -> np.ndarray:
        count["evaluated"] += len(index)
        return evaluate(index, full=full)

    locked, best = {}, -math.inf
    for n in range(passes):
        found, quality = staged_search(space, counted, trials, batch, seed=seed + n, passing=passing, start=locked, full_groups=FULL_GROUPS)
        count["passes"] += 1
        gained = not math.isfinite(best) or quality > best + gain * abs(best)
        if quality > best:
            locked, best = found, quality
        if not gained:
            break
    sampler = RandomSampler(space, seed)
    around = [np.array([[locked[p.name] for p in space.params]])]
    while sum(map(len, around)) < refine:
        around.append(sampler.sample(min(batch, refine - sum(map(len, around))), centre=locked, radius=radius))
    scored: dict[tuple, tuple[float, bool]] = {}
    for index in around:
        quality = np.asarray(counted(index, full=True), float)
        ok = np.ones(len(index), bool) if passing is None else np.asarray(passing(index), bool)
        scored |= {tuple(map(int, row)): (float(q), bool(o)) for row, q, o in zip(index, quality, ok, strict=True)}
        count["refined"] += len(index)
    order = sorted(scored.items(), key=lambda kv: (-kv[1][0], kv[0]))
    kept = [x for x in order if x[1][1]]
    count["passing"] = len(kept)
    return [(dict(zip(space.names, row, strict=True)), q) for row, (q, _) in kept or order[:1]], count


def load_params(stored: DataFrame, space: ParamSpace, seed: int = 0) -> dict:
    """Values of the best row of a checkpoint (composite and a column per parameter); a random sample if it has none."""
    best = stored.orderBy(F.desc_nulls_last("composite")).limit(1).collect()
    if best:
        return {name: best[0][name] for name in space.names}
    return space.decode(RandomSampler(space, seed).sample(1)[0])


def live_span(live: DataFrame) -> DataFrame:
    """first_s and last_s per pair of live trades (s, exit_s; open trades count by their entry)."""
    return live.groupBy("pair").agg(F.min("s").alias("first_s"), F.max(F.coalesce("exit_s", "s")).alias("last_s"))


def replay_bars(bars: DataFrame, live: DataFrame, lead_days: int = 30, tail_hours: int = 2) -> DataFrame:
    """Bars of each pair from ``lead_days`` before its first live entry, for indicators to settle, to ``tail_hours`` after its last exit."""
    at = seconds("ts")
    inside = at.between(F.col("first_s") - lead_days * 86400, F.col("last_s") + tail_hours * 3600)
    return bars.join(live_span(live), "pair").where(inside).drop("first_s", "last_s")


def verify(
    live: DataFrame,
    bars: DataFrame,
    replay: Callable[[DataFrame], DataFrame],
    pip: float,
    minutes: float = 120.0,
    lead_days: int = 30,
    tail_hours: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Compared trades and their aggregates.

    Live trades have pair, group, live_id, direction, s, exit_s, entry, exit, pnl, reason; ``replay`` makes such
    trades (replay_id for live_id) of the bars of the live period with lead-in and tail.  Those that it
    opens outside the live period don't count.
    """
    again = replay(replay_bars(bars, live, lead_days, tail_hours)).join(live_span(live), "pair").where("s between first_s and last_s")
    values = ("s", "entry", "exit", "pnl", "reason")
    pairs = VE.match(live, again, minutes)
    pairs = pairs.join(live.select("live_id", "direction", *(F.col(c).alias(f"live_{c}") for c in values)), "live_id")
    pairs = pairs.join(again.select("replay_id", *(F.col(c).alias(f"replay_{c}") for c in values)), "replay_id")
    compared = VE.compare(pairs, pip)
    return compared, VE.aggregates(compared, live.count(), again.count())


def verify_deployed(
    live: DataFrame,
    bars: DataFrame,
    subs: DataFrame,
    signals: Callable[[DataFrame, float], DataFrame],
    params: DataFrame,
    pip: float,
    first_s: int | None = None,
    last_s: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``verify`` of a strategy's deployments between two dates, each bar with the parameters that were live then (``replay.params_at``)."""
    s = F.col("s")
    inside = (F.lit(True) if first_s is None else s >= first_s) & (F.lit(True) if last_s is None else s <= last_s)
    return verify(live.where(inside), bars, deployed(signals, params, subs, pip), pip)


def verification_report(compared: DataFrame, totals: DataFrame) -> DataFrame:
    """kind (total, trade), live_id and a JSON line each; store.write_checkpoint or a text writer saves it."""
    def line(df: DataFrame, kind: str, key) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), key.cast("long").alias("live_id"), F.to_json(F.struct(*df.columns)).alias("json"))

    return line(totals, "total", F.lit(None)).unionByName(line(compared, "trade", F.col("live_id")))
