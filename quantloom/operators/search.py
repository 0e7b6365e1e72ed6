"""Parameter search: spaces, samplers, ranking, selection and archives.

What is small stays on the driver (a space, a population); results of evaluations stay
in DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import normal_cdf
from quantloom.functions.order import quantile, ranked


@dataclass(frozen=True)
class Param:
    name: str
    values: tuple
    group: str

    @property
    def kind(self) -> str:
        v = self.values[0]
        if isinstance(v, bool):
            return "bool"
        return "numeric" if isinstance(v, (int, float)) else "days" if isinstance(v, (list, tuple)) else "categorical"


@dataclass
class ParamSpace:
    params: list[Param] = field(default_factory=list)

    def add(self, name: str, values: Sequence, group: str) -> ParamSpace:
        self.params.append(Param(name, tuple(values), group))
        return self

    @property
    def names(self) -> list[str]:
        return [p.name for p in self.params]

    @property
    def groups(self) -> list[str]:
        return list(dict.fromkeys(p.group for p in self.params))

    def combinations(self, group: str | None = None) -> int:
        return math.prod(len(p.values) for p in self.params if group in (None, p.group))

    def table(self, spark: SparkSession) -> DataFrame:
        """name, kind, position, value (text) of every value."""
        rows = [(p.name, p.kind, i, str(v)) for p in self.params for i, v in enumerate(p.values)]
        return spark.createDataFrame(rows, "name string, kind string, position int, value string")

    def decode(self, index: Sequence[int]) -> dict:
        return {p.name: p.values[i] for p, i in zip(self.params, index, strict=True)}

    def encode(self, values: dict) -> list[int]:
        return [p.values.index(values[p.name]) for p in self.params]


def days_to_mask(days: Sequence[int]) -> int:
    return sum(1 << d for d in set(days))


def mask_to_days(mask: int) -> list[int]:
    return [d for d in range(7) if mask >> d & 1]


def standard_space() -> ParamSpace:
    """Risk, time and management parameters; fixed values."""
    s = ParamSpace()
    s.add("sl_mode", ("fixed_pips", "atr_based", "swing"), "risk").add("sl_fixed_pips", range(10, 101, 5), "risk").add("sl_atr_mult", (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0), "risk")
    s.add("tp_mode", ("rr_ratio", "atr_based", "fixed_pips"), "risk").add("tp_rr_ratio", (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0), "risk").add("tp_atr_mult", (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0), "risk").add("tp_fixed_pips", range(10, 201, 10), "risk")
    s.add("hours_start", range(24), "time").add("hours_end", range(24), "time").add("days", ((0, 1, 2, 3, 4), (0, 1, 2, 3), (1, 2, 3), (0, 1, 2, 3, 4, 5, 6)), "time")
    s.add("trailing_mode", ("off", "fixed_pip", "atr_chandelier"), "exit_trailing").add("trail_activate", (0, 10, 15, 20, 30, 40, 50), "exit_trailing").add("trail_distance", (5, 10, 15, 20, 30), "exit_trailing").add("trail_atr_mult", (1.0, 1.5, 2.0, 2.5, 3.0), "exit_trailing")
    s.add("be_enabled", (False, True), "exit_protection_be").add("be_trigger", (7, 10, 15, 20, 30), "exit_protection_be").add("be_offset", (0, 1, 2, 3), "exit_protection_be")
    s.add("partial_enabled", (False, True), "exit_protection").add("partial_pct", range(30, 71, 10), "exit_protection").add("partial_trigger", (10, 15, 20, 30, 50), "exit_protection")
    s.add("max_bars", (0, 50, 100, 200, 500, 1000), "exit_time").add("stale_enabled", (False, True), "exit_time").add("stale_bars", (20, 50, 100), "exit_time").add("stale_thr", (0.3, 0.5, 0.75, 1.0), "exit_time")
    return s


def stages(space: ParamSpace) -> list[tuple[str, list[str]]]:
    """Search order: signal parameters, time, risk with trailing and breakeven, the rest."""
    core = {"risk", "exit_trailing", "exit_protection_be"}
    order = [("signal", [g for g in space.groups if g == "signal"]), ("time", ["time"]), ("core_trade_profile", [g for g in space.groups if g in core]), ("rest", [g for g in space.groups if g not in core | {"signal", "time"}])]
    return [(n, g) for n, g in order if any(x in space.groups for x in g)]


def budgets(space: ParamSpace, trials: int, factor: int = 10) -> list[tuple[str, int, int]]:
    """(stage, combinations, trials), trials capped at ``factor`` times the combinations."""
    out = []
    for name, groups in stages(space):
        n = math.prod(space.combinations(g) for g in groups)
        out.append((name, n, min(trials, factor * n)))
    return out


def widen(values: Sequence[float], factor: float) -> list[float]:
    """A numeric range with steps finer by sqrt(factor) and longer by (sqrt(factor) - 1) / 2 of it on each side; originals stay."""
    values = sorted(values)
    low, high = values[0], values[-1]
    if factor <= 1 or len(values) < 2:
        return values
    root = math.sqrt(factor)
    whole = all(isinstance(v, int) for v in values)
    step = (high - low) / (len(values) - 1) / root
    more = (root - 1) * (high - low) / 2
    start, stop = low - more, high + more
    if whole:
        start, stop, step = round(start), round(stop), max(1, round(step))
    if low > 0:
        start = max(1 if whole else 0.0, start)
    count = int((stop - start) / step + (0 if whole else 0.01)) + 1
    made = [start + i * step for i in range(count)]
    return sorted({*values, *(made if whole else (round(v, 6) for v in made)), *([stop] if whole else [])})


def widen_space(space: ParamSpace, factor: float, groups: Sequence[str] | None = None) -> ParamSpace:
    """The space with the numeric parameters of some groups (all by default) widened."""
    out = ParamSpace()
    for p in space.params:
        wide = p.kind == "numeric" and (groups is None or p.group in groups)
        out.add(p.name, widen(p.values, factor) if wide else p.values, p.group)
    return out


def fill_factor(space: ParamSpace, target: int, group: str) -> float:
    """The factor that brings a group to a number of combinations, spread evenly over its numeric parameters; 1 to 10."""
    now = space.combinations(group)
    numeric = sum(p.kind == "numeric" for p in space.params if p.group == group)
    if not numeric or not 0 < now < target:
        return 1.0
    return min(max((target / now) ** (1 / numeric), 1.0), 10.0)


def widen_to_budget(space: ParamSpace, trials: int, coverage: int = 10) -> tuple[ParamSpace, dict[str, tuple[int, int]]]:
    """Widen the stages whose combinations a number of trials would cover more than ``coverage`` times; combinations before and after by stage."""
    report = {}
    for name, groups in stages(space):
        groups = [g for g in groups if g in space.groups]
        before = math.prod(space.combinations(g) for g in groups)
        if trials > before * coverage:
            target = max(1, int((trials // coverage) ** (1 / len(groups))))
            for g in groups:
                space = widen_space(space, fill_factor(space, target, g), [g])
        report[name] = (before, math.prod(space.combinations(g) for g in groups))
    return space, report


class RandomSampler:
    """Uniform indices; locked values first, then a neighbourhood, then the whole range."""

    def __init__(self, space: ParamSpace, seed: int = 0):
        self.space, self.rng = space, np.random.default_rng(seed)

    def bounds(self, locked: dict[str, int], centre: dict[str, int], radius: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = [], []
        for p in self.space.params:
            last = len(p.values) - 1
            if p.name in locked:
                a = b = locked[p.name]
            elif p.name in centre:
                a, b = max(0, centre[p.name] - radius), min(last, centre[p.name] + radius)
            else:
                a, b = 0, last
            lo.append(a)
            hi.append(b)
        return np.array(lo), np.array(hi)

    def sample(self, n: int, locked: dict[str, int] | None = None, centre: dict[str, int] | None = None, radius: int = 0) -> np.ndarray:
        lo, hi = self.bounds(locked or {}, centre or {}, radius)
        return self.rng.integers(lo, hi + 1, (n, len(lo)))


class LowDiscrepancySampler(RandomSampler):
    """A scrambled additive recurrence with square roots of primes: even coverage from the first points on."""

    def sample(self, n: int, locked: dict[str, int] | None = None, centre: dict[str, int] | None = None, radius: int = 0) -> np.ndarray:
        lo, hi = self.bounds(locked or {}, centre or {}, radius)
        primes = [p for p in range(2, 2000) if all(p % q for q in range(2, int(p**0.5) + 1))][: len(lo)]
        u = (self.rng.random(len(lo)) + np.arange(1, n + 1)[:, None] * np.sqrt(primes)) % 1.0
        return np.minimum(lo + np.floor(u * (hi - lo + 1)).astype(int), hi)


class DistributionSampler(RandomSampler):
    """One probability table per parameter, moved towards the elite's frequencies with a falling rate."""

    FLOOR = 0.01

    def __init__(self, space: ParamSpace, seed: int = 0, rate: float = 0.3, least_rate: float = 0.05, decay: float = 0.95):
        super().__init__(space, seed)
        self.tables = [np.full(len(p.values), 1 / len(p.values)) for p in space.params]
        self.rate, self.least, self.decay, self.updates = rate, least_rate, decay, 0

    def sample(self, n: int, locked: dict[str, int] | None = None, centre: dict[str, int] | None = None, radius: int = 0) -> np.ndarray:
        lo, hi = self.bounds(locked or {}, centre or {}, radius)
        cols = []
        for t, a, b in zip(self.tables, lo, hi, strict=True):
            p = t[a : b + 1] / t[a : b + 1].sum()
            cols.append(self.rng.choice(np.arange(a, b + 1), n, p=p))
        return np.stack(cols, 1)

    def update(self, elite: np.ndarray) -> None:
        lr = self.least + (self.rate - self.least) * self.decay**self.updates
        for i, t in enumerate(self.tables):
            share = np.bincount(elite[:, i], minlength=len(t)) / len(elite)
            t = np.maximum((1 - lr) * t + lr * share, self.FLOOR)
            self.tables[i] = t / t.sum()
        self.updates += 1

    def entropy(self) -> float:
        each = [float(-(t * np.log(t)).sum() / math.log(len(t))) if len(t) > 1 else 0.0 for t in self.tables]
        return float(np.mean(each))


class GeneticSampler(RandomSampler):
    """Elites, tournaments of three, uniform crossover, and mutation by one or two places."""

    def __init__(self, space: ParamSpace, seed: int = 0, population: int = 200, elite: float = 0.2, crossover: float = 0.8, mutation: float = 0.08):
        super().__init__(space, seed)
        self.size, self.elite, self.crossover, self.mutation = population, elite, crossover, mutation
        self.people = np.zeros((0, len(space.params)), int)
        self.fitness = np.zeros(0)

    def sample(self, n: int, locked: dict[str, int] | None = None, centre: dict[str, int] | None = None, radius: int = 0) -> np.ndarray:
        lo, hi = self.bounds(locked or {}, centre or {}, radius)
        if not len(self.people):
            return super().sample(n, locked, centre, radius)
        keep = self.people[np.argsort(-self.fitness)[: max(1, int(self.elite * n))]][:n]
        pick = lambda: self.people[(c := self.rng.integers(0, len(self.people), (n - len(keep), 3)))[np.arange(n - len(keep)), self.fitness[c].argmax(1)]]
        a, b = pick(), pick()
        mixed = np.where((self.rng.random(a.shape) < 0.5) & (self.rng.random((len(a), 1)) < self.crossover), b, a)
        moves = self.rng.choice([-2, -1, 1, 2], mixed.shape)
        fresh = self.rng.integers(lo, hi + 1, mixed.shape)
        numeric = np.array([p.kind == "numeric" for p in self.space.params])
        changed = np.where(numeric, mixed + moves, fresh)
        mixed = np.where(self.rng.random(mixed.shape) < self.mutation, changed, mixed)
        return np.clip(np.concatenate([keep, mixed]), lo, hi)

    def update(self, index: np.ndarray, quality: np.ndarray) -> None:
        people, fitness = np.concatenate([self.people, index]), np.concatenate([self.fitness, quality])
        best = np.argsort(-fitness, kind="stable")[: self.size]
        self.people, self.fitness = people[best], fitness[best]


class CovarianceSampler(RandomSampler):
    """A Gaussian over index space whose mean, covariance and step follow the best half; integers keep a margin of change."""

    def __init__(self, space: ParamSpace, seed: int = 0):
        super().__init__(space, seed)
        n = len(space.params)
        self.width = np.array([max(1, len(p.values) - 1) for p in space.params], float)
        self.mean, self.cov, self.step = self.width / 2, np.eye(n), 0.3

    def sample(self, n: int, locked: dict[str, int] | None = None, centre: dict[str, int] | None = None, radius: int = 0) -> np.ndarray:
        lo, hi = self.bounds(locked or {}, centre or {}, radius)
        root = np.linalg.cholesky(self.cov + 1e-9 * np.eye(len(lo)))
        z = self.rng.standard_normal((n, len(lo))) @ root.T
        return np.clip(np.rint(self.mean + self.step * self.width * z).astype(int), lo, hi)

    def update(self, index: np.ndarray, quality: np.ndarray) -> None:
        best = index[np.argsort(-quality, kind="stable")[: max(2, len(index) // 2)]]
        weight = np.log(len(best) + 0.5) - np.log(np.arange(1, len(best) + 1))
        weight /= weight.sum()
        move = (best - self.mean) / (self.step * self.width)
        self.mean = self.mean + (weight[:, None] * (best - self.mean)).sum(0)
        self.cov = 0.7 * self.cov + 0.3 * (move.T * weight) @ move
        spread = np.sqrt(np.diag(self.cov))
        self.cov += np.diag(np.maximum(0, 0.25 / (self.step * self.width) - spread) ** 2)
        self.step = float(np.clip(self.step * np.exp(0.2 * (np.sqrt(np.trace(self.cov) / len(self.cov)) - 1)), 0.02, 1.0))


def entropy(indices: DataFrame) -> DataFrame:
    """Normalised Shannon entropy of the chosen positions (name, position) of each parameter with ``size`` values."""
    n = F.sum("c").over(Window.partitionBy("name"))
    counts = indices.groupBy("name", "size", "position").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / n)
    return counts.groupBy("name").agg(F.when(F.max("size") > 1, -F.sum(F.col("p") * F.ln("p")) / F.ln(F.max("size"))).otherwise(0.0).alias("entropy"))


def elite_histogram(indices: DataFrame) -> DataFrame:
    """Share of each position of each parameter among elite rows."""
    counts = indices.groupBy("name", "position").agg(F.count("*").alias("c"))
    return counts.select("name", "position", (F.col("c") / F.sum("c").over(Window.partitionBy("name"))).alias("share"))


def combined_rank(results: DataFrame, weight: float = 1.5) -> DataFrame:
    """rank_back + weight * rank_forward (0 is best); order by it, ties by trial."""
    out = ranked(results, "rank_back", F.desc("quality_back"), "trial")
    out = ranked(out, "rank_forward", F.desc("quality_forward"), "trial")
    return out.withColumn("combined", F.col("rank_back") + weight * F.col("rank_forward"))


def forward_back(results: DataFrame, least: float = 0.4) -> DataFrame:
    """ratio of forward to back quality (0 without back quality) and whether it passes."""
    out = results.withColumn("ratio", F.when(F.col("quality_back") > 0, F.col("quality_forward") / F.col("quality_back")).otherwise(0.0))
    return out.withColumn("ratio_ok", F.col("ratio") >= least)


def deflated_sharpe(sharpe: Column, trades: Column, trials: Column, skew: Column | float = 0.0, kurtosis: Column | float = 3.0) -> Column:
    """Probability that the Sharpe ratio beats the best of ``trials`` by chance; 0 for fewer than two trades or no trial."""
    skew = skew if isinstance(skew, Column) else F.lit(float(skew))
    kurtosis = kurtosis if isinstance(kurtosis, Column) else F.lit(float(kurtosis))
    sd = F.sqrt(F.greatest((1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / F.greatest(trades - 1, F.lit(1)), F.lit(1e-10)))
    hurdle = F.sqrt(2 * F.ln(F.greatest(trials, F.lit(2)).cast("double")))
    return F.when((trades < 2) | (trials < 1), 0.0).otherwise(normal_cdf(sharpe / sd - hurdle))


def select(results: DataFrame, key: Column, per_key: int = 3, top: int = 20, levels: tuple[float, ...] = (0.95, 0.90)) -> DataFrame:
    """Rows above the highest DSR level that any row reaches (else all), best ``per_key`` of each key, best ``top`` of these."""
    best = F.col("_best")
    results = results.crossJoin(F.broadcast(results.agg(F.max("dsr").alias("_best"))))  # one row
    floor = F.lit(-1.0)
    for level in sorted(levels):
        floor = F.when(best >= level, level).otherwise(floor)
    rows = results.withColumns({"_floor": floor, "_key": key}).where(F.col("dsr") >= F.col("_floor"))
    w = Window.partitionBy("_key").orderBy(F.desc("quality"), "trial")
    rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_key)
    return rows.orderBy(F.desc("quality"), "trial").limit(top).drop("_floor", "_r", "_best").withColumnRenamed("_key", "dedup_key")


def fold_count(trades: int, years: float) -> int:
    return min(7, max(3, round(min(trades / 30, years / 2))))


def fold_layout(n_bars: int, k: int, embargo: int) -> list[tuple[int, int]]:
    """Half-open test folds; an embargo separates them, the last takes the rest."""
    size = (n_bars - embargo * (k - 1)) // k
    out = [(i * (size + embargo), i * (size + embargo) + size) for i in range(k)]
    return [*out[:-1], (out[-1][0], n_bars)]


def aggregate_folds(scores: DataFrame, how: str = "cvar", min_trades: int = 5, penalty: float = 0.5, tail: float = 0.4) -> DataFrame:
    """One score per trial from fold scores with enough trades: mean less penalty * sd, mean of the worst ``tail``, or geometric mean.

    Fewer than two valid folds score 0, and no score is negative.
    """
    w = Window.partitionBy("trial")
    rows = scores.where(F.col("trades") >= min_trades).withColumns({"k": F.count("*").over(w), "r": F.row_number().over(w.orderBy("quality", "fold"))})
    kept = rows.where(F.col("r") <= F.greatest(F.lit(1), F.floor(tail * F.col("k")))) if how == "cvar" else rows
    value = {"cvar": F.avg("quality"), "mean_std": F.avg("quality") - penalty * F.stddev_pop("quality"), "geometric": F.exp(F.avg(F.ln(F.greatest("quality", F.lit(1e-9)))))}[how]
    out = kept.groupBy("trial").agg(F.max("k").alias("valid"), F.greatest(value, F.lit(0.0)).alias("score"))
    return scores.select("trial").distinct().join(out, "trial", "left").select("trial", F.coalesce("valid", F.lit(0)).alias("valid"), F.when(F.col("valid") >= 2, F.col("score")).otherwise(0.0).alias("score"))


def survivors(fold_result: DataFrame, first: bool, share: float = 0.3, few: int = 10) -> DataFrame:
    """Culling between folds: after the first those above 0; later all but the worst share, if more than ``few`` are left."""
    if first:
        return fold_result.where("quality > 0")
    both = quantile(fold_result, "quality", share).crossJoin(fold_result.agg(F.count("*").alias("_n")))  # one row
    return fold_result.crossJoin(F.broadcast(both)).where((F.col("_n") <= few) | (F.col("quality") >= F.col("cut"))).drop("cut", "_n")


def archive(results: DataFrame, per_cell: int = 1, frequency: tuple[float, ...] = (30, 100), tiers: tuple[float, ...] = (5, 15, 30)) -> DataFrame:
    """Best rows of each cell of a grid (number of trades by quality); the first of equals stays."""
    grade = lambda x, cuts: sum((F.when(x >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = results.withColumns({"cell_trades": grade(F.col("trades"), frequency), "cell_quality": grade(F.col("quality"), tiers)})
    w = Window.partitionBy("cell_trades", "cell_quality").orderBy(F.desc("quality"), "trial")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_cell).drop("_r")


def staged_search(space: ParamSpace, evaluate, trials: int, batch: int = 2048, explore: float = 0.4, seed: int = 0, exploiter=GeneticSampler, passing=None, start: dict[str, int] | None = None, full_groups: Sequence[str] = ()) -> tuple[dict[str, int], float]:
    """Stage by stage: even coverage first, then an exploiter; the best of a stage is locked for the next ones.

    ``evaluate`` takes a matrix of indices and returns qualities: one Spark batch each; in stages with
    one of ``full_groups`` it is called with full=True.  ``passing`` may mask results; the best ungated one
    stands in where none passes.  ``start`` has the values that later stages' parameters are held at.
    """
    locked: dict[str, int] = dict(start or {})
    best = -math.inf
    for name, _, budget in budgets(space, trials):
        groups = dict(stages(space))[name]
        free = {p.name for p in space.params if p.group in groups}
        mode = {"full": True} if set(groups) & set(full_groups) else {}
        fixed = {p.name: locked.get(p.name, 0) for p in space.params if p.name not in free}
        even, sharp = LowDiscrepancySampler(space, seed), exploiter(space, seed)
        done, top = 0, None
        while done < budget:
            n = min(batch, budget - done)
            index = (even if done < explore * budget else sharp).sample(n, fixed)
            quality = np.asarray(evaluate(index, **mode), float)
            gated = quality if passing is None else np.where(passing(index), quality, -math.inf)
            use = gated if np.isfinite(gated).any() else quality
            if top is None or use.max() > top[0]:
                top = (float(use.max()), index[int(use.argmax())])
            if hasattr(sharp, "people") or isinstance(sharp, CovarianceSampler):
                sharp.update(index, quality)
            else:
                sharp.update(index[np.argsort(-quality)[: max(1, n // 10)]])
            done += n
        if top is not None:
            best = max(best, top[0])
            locked |= {p.name: int(i) for p, i in zip(space.params, top[1], strict=True) if p.name in free}
    return locked, best
