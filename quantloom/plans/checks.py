"""Queries on validation, resampling, search, verification, risk and articles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql import Window

from quantloom.functions.numeric import rounded, tidy
from quantloom.operators import articles as A
from quantloom.operators import montecarlo as MC
from quantloom.operators import risk
from quantloom.operators import search as SE
from quantloom.operators import validation as V
from quantloom.operators import verification as VE
from quantloom.operators import metrics as M
from quantloom.plans.registry import register
from quantloom.plans.tables import BARS, RESULTS, hourly, metric_sql, read, results

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)


def _n(spark, d):
    return hourly(spark, d).groupBy("pair").agg(F.count("*").alias("n"))


_N = f"{BARS}, nb AS (SELECT pair, count(*) AS n FROM bars GROUP BY pair)"
_WINDOWS = f"{_N}, w AS (SELECT pair, n, unnest(range(0, (n - 200) // 120 + 1)) AS window_id FROM nb WHERE n >= 200)"


@query("v1_v2_windows", f"WITH {_WINDOWS} SELECT pair, window_id, window_id * 120 AS start_bar, window_id * 120 + 200 AS end_bar, window_id * 120 >= floor(n * 0.8::DOUBLE) AS is_oos FROM w")
def v1(spark, d):
    return V.label_windows(V.windows(_n(spark, d), 200, 100, 20)).drop("n")


@query("v1_anchored_windows", f"WITH {_WINDOWS} SELECT pair, window_id, 0::BIGINT AS start_bar, window_id * 120 + 200 AS end_bar FROM w")
def v1_anchored(spark, d):
    return V.windows(_n(spark, d), 200, 100, 20, anchored=True).drop("n")


def _window_results(spark, d):
    """Results in windows of 100 trades as stand-in for evaluated windows of a candidate."""
    r = results(spark, d).withColumn("window_id", F.floor(F.col("seq") / 100))
    m = M.metrics(r, ["key", "window_id"], ["seq"])
    last = F.max("window_id").over(Window.partitionBy("key"))
    return m.select(F.col("key").alias("candidate"), "window_id", "trades", F.round("sharpe", 6).alias("sharpe"), (F.round(F.col("win_rate") * 10, 6)).alias("quality"), (F.col("window_id") > last * 0.5).alias("is_oos"))


_WR = f"""{RESULTS}, wr0 AS (SELECT key AS candidate, seq // 100 AS window_id, count(*) AS trades, round(CASE WHEN count(*) > 1 AND stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252) ELSE 0 END, 6) AS sharpe,
  round(sum((pnl > 0)::INT)::DOUBLE / count(*) * 10, 6) AS quality FROM results GROUP BY ALL), wr AS MATERIALIZED (SELECT *, window_id > max(window_id) OVER (PARTITION BY candidate) * 0.5 AS is_oos FROM wr0)"""
_PASS = "is_oos AND trades >= 10 AND sharpe > 0 AND quality > 0"


@query("v4_walk_forward", f"""WITH {_WR}, a AS (SELECT candidate, sum(is_oos::INT)::BIGINT AS n_oos, sum(({_PASS})::INT)::BIGINT AS n_passed, coalesce(avg(CASE WHEN is_oos AND trades >= 10 THEN sharpe END), 0) AS ms, coalesce(avg(CASE WHEN is_oos THEN quality END), 0) AS mq,
  coalesce(min(CASE WHEN is_oos THEN quality END), 0) AS nq, coalesce(exp(avg(CASE WHEN {_PASS} THEN ln(quality) END)), 0) AS gq, stddev_pop(CASE WHEN is_oos THEN quality END) AS sd, max(CASE WHEN NOT is_oos THEN quality END) AS bi FROM wr GROUP BY candidate)
 SELECT candidate, n_oos, n_passed, round(ms, 5) + 0.0 AS mean_sharpe, round(mq, 5) + 0.0 AS mean_quality, round(nq, 5) + 0.0 AS min_quality, round(gq, 5) + 0.0 AS geo_quality, round(n_passed::DOUBLE / n_oos, 5) + 0.0 AS pass_rate,
  round(CASE WHEN mq > 0 THEN sd / mq ELSE 0 END, 5) + 0.0 AS cv_quality, round(CASE WHEN bi > 0 THEN mq / bi ELSE 0 END, 5) + 0.0 AS wfe, n_oos > 0 AND n_passed::DOUBLE / n_oos >= 0.6 AND ms >= 0.3 AS passed FROM a""")
def v4(spark, d):
    w = V.walk_forward(_window_results(spark, d))
    return w.select("candidate", "n_oos", "n_passed", *(tidy(F.col(c), 5).alias(c) for c in ("mean_sharpe", "mean_quality", "min_quality", "geo_quality", "pass_rate", "cv_quality", "wfe")), "passed")


_BLOCKS = f"{_N}, bl AS (SELECT pair, k::INTEGER AS block, k * (n // 10) + least(k, n % 10) AS start_bar, k * (n // 10) + least(k, n % 10) + n // 10 + (k < n % 10)::INT AS end_bar FROM nb, (SELECT unnest(range(10)) AS k))"


@query("v5_blocks", f"WITH {_BLOCKS} SELECT pair, block, start_bar, end_bar::BIGINT AS end_bar FROM bl")
def v5(spark, d):
    return V.blocks(_n(spark, d))


_FOLDS = "fo AS (SELECT (row_number() OVER (ORDER BY a, b) - 1)::INTEGER AS fold, a, b FROM (SELECT unnest(range(10)) AS a) x, (SELECT unnest(range(10)) AS b) y WHERE a < b)"


@query("v5_folds", f"WITH {_BLOCKS}, {_FOLDS} SELECT pair, fold, block, start_bar, end_bar::BIGINT AS end_bar FROM fo JOIN bl ON block = a OR block = b")
def v5_folds(spark, d):
    """The test blocks of every fold of each pair."""
    return V.blocks(_n(spark, d)).join(V.folds(spark), "block").select("pair", "fold", "block", "start_bar", "end_bar")


@query("v6_purged", f"""WITH {_BLOCKS}, {_FOLDS}, ts AS (SELECT pair, fold, block, start_bar, end_bar FROM fo JOIN bl ON block = a OR block = b), bs AS (SELECT pair, bar_idx FROM bars),
 tr AS (SELECT b.pair, f.fold, b.bar_idx FROM bs b CROSS JOIN fo f WHERE NOT EXISTS (SELECT 1 FROM ts WHERE ts.pair = b.pair AND ts.fold = f.fold AND b.bar_idx >= ts.start_bar AND b.bar_idx < ts.end_bar)),
 pu AS (SELECT DISTINCT t.pair, t.fold, t.bar_idx FROM tr t JOIN ts ON ts.pair = t.pair AND ts.fold = t.fold AND ((t.bar_idx >= ts.start_bar - 20 AND t.bar_idx < ts.start_bar) OR (t.bar_idx >= ts.end_bar AND t.bar_idx < ts.end_bar + 20)))
 SELECT n.pair, f.fold, count(p.bar_idx) AS n_purged FROM nb n CROSS JOIN fo f LEFT JOIN pu p ON p.pair = n.pair AND p.fold = f.fold GROUP BY ALL""")
def v6(spark, d):
    return V.purged(V.blocks(_n(spark, d)), V.folds(spark), 20, 15)


@query("v7_cpcv", f"""WITH {_WR}, {_FOLDS}, fs AS (SELECT candidate, fold, avg(sharpe) AS s, avg(quality) AS q FROM wr JOIN fo ON window_id = a OR window_id = b GROUP BY ALL),
 a AS (SELECT candidate, count(*) AS n_folds, avg(s) AS m, median(s) AS md, coalesce(stddev_samp(s), 0) AS sd, avg(q) AS q, avg((s > 0)::INT) AS pp FROM fs GROUP BY candidate)
 SELECT candidate, n_folds, round(m, 5) + 0.0 AS mean_sharpe, round(md, 5) + 0.0 AS median_sharpe, round(sd, 5) + 0.0 AS sd_sharpe, round(q, 5) + 0.0 AS mean_quality, round(pp, 5) + 0.0 AS pct_positive, round(m - 1.96 * sd / sqrt(n_folds), 5) + 0.0 AS ci_low, round(m + 1.96 * sd / sqrt(n_folds), 5) + 0.0 AS ci_high, pp >= 0.6 AND m >= 0.2 AS passed FROM a""")
def v7(spark, d):
    w = _window_results(spark, d).withColumn("block", F.col("window_id").cast("int"))
    c = V.cpcv(w.join(V.folds(spark), "block"))
    return c.select("candidate", "n_folds", *(tidy(F.col(x), 5).alias(x) for x in ("mean_sharpe", "median_sharpe", "sd_sharpe", "mean_quality", "pct_positive", "ci_low", "ci_high")), "passed")


def _space():
    return SE.ParamSpace().add("sl", (10, 15, 20, 25, 30), "risk").add("mode", ("off", "fixed", "atr"), "exit").add("be", (False, True), "exit")


_SPACE = "sp(name, kind, position, value) AS (VALUES ('sl', 'numeric', 0, '10'), ('sl', 'numeric', 1, '15'), ('sl', 'numeric', 2, '20'), ('sl', 'numeric', 3, '25'), ('sl', 'numeric', 4, '30'), ('mode', 'categorical', 0, 'off'), ('mode', 'categorical', 1, 'fixed'), ('mode', 'categorical', 2, 'atr'), ('be', 'bool', 0, 'False'), ('be', 'bool', 1, 'True'))"
#: Stand-in candidates: customers, their keys as places in the space.
_CHOSEN = "ch AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT c_custkey AS candidate, '{n}' AS name, (c_custkey % {k})::INTEGER AS at_ FROM customer" for n, k in (("sl", 5), ("mode", 3), ("be", 2))) + ")"


def _chosen(spark, d):
    k = F.col("c_custkey")
    place = lambda n, m: F.struct(F.lit(n).alias("name"), (k % m).cast("int").alias("position"))
    return read(spark, d, "customer").select(k.alias("candidate"), F.inline(F.array(place("sl", 5), place("mode", 3), place("be", 2))))


@query("v8_perturbations", f"WITH {_SPACE}, {_CHOSEN} SELECT candidate, c.name, kind, position - at_ AS change, value FROM ch c JOIN sp s ON s.name = c.name WHERE position <> at_ AND (kind <> 'numeric' OR abs(position - at_) <= 3)")
def v8(spark, d):
    return V.perturbations(_space().table(spark), _chosen(spark, d))


@query("v9_stability", f"""WITH {_WR}, p AS (SELECT candidate, 'p' || (window_id % 7)::VARCHAR AS name, window_id AS seq, CASE WHEN 5.0 > 0 THEN quality / 5.0::DOUBLE ELSE 0 END AS r FROM wr),
 a AS (SELECT candidate, count(*) AS n, avg(r) AS m, min(r) AS l, first(name ORDER BY r, seq) AS worst FROM p GROUP BY candidate)
 SELECT candidate, n, round(m, 5) + 0.0 AS mean_ratio, round(l, 5) + 0.0 AS min_ratio, worst, CASE WHEN m >= 0.8 AND l >= 0.5 THEN 'ROBUST' WHEN m >= 0.6 THEN 'MODERATE' WHEN m >= 0.4 THEN 'FRAGILE' ELSE 'OVERFIT' END AS rating FROM a""")
def v9(spark, d):
    w = _window_results(spark, d).select("candidate", F.concat(F.lit("p"), (F.col("window_id") % 7).cast("string")).alias("name"), F.col("window_id").alias("seq"), "quality", F.lit(5.0).alias("original"))
    return V.stability(w).select("candidate", "n", tidy(F.col("mean_ratio"), 5).alias("mean_ratio"), tidy(F.col("min_ratio"), 5).alias("min_ratio"), "worst", "rating")




def _pseudo(*ids: str) -> str:
    x = "12345::BIGINT"
    for i in ids:
        x = f"((((({x}) * 48271 + ({i}) * 69621 + 11) % 2147483647) * 16807 + 7) % 2147483647)"
    return x


@query("v10_block_bootstrap", f"""WITH {RESULTS}, n AS (SELECT key, count(*) AS n FROM results GROUP BY key), dr AS (SELECT key, n, iter, unnest(range(ceil(n / 10.0)::BIGINT)) AS draw FROM n, (SELECT unnest(range(1000)) AS iter)),
 st AS (SELECT key, iter, n, {_pseudo('iter', 'draw')} % n AS s FROM dr), rw AS (SELECT key, iter, unnest(range(s, least(s + 10, n))) AS seq FROM st),
 pe AS (SELECT w.key, iter, CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) ELSE 0 END AS sh FROM rw w JOIN results r ON r.key = w.key AND r.seq = w.seq GROUP BY ALL)
 SELECT key, round(avg(sh), 6) + 0.0 AS mean, round(quantile_cont(sh, 0.05), 6) + 0.0 AS p05, round(median(sh), 6) + 0.0 AS p50, round(quantile_cont(sh, 0.95), 6) + 0.0 AS p95 FROM pe GROUP BY key""")
def v10(spark, d):
    b = MC.block_bootstrap(results(spark, d))
    return b.select("key", *(tidy(F.col(c)).alias(c) for c in ("mean", "p05", "p50", "p95")))


@query("v11_sign_flip", f"""WITH {RESULTS}, f AS (SELECT key, iter, round(sum(pnl * CASE WHEN ({_pseudo('iter // 30', 'seq')} >> (iter % 30)) & 1 = 0 THEN 1 ELSE -1 END), 4) AS total FROM results, (SELECT unnest(range(1000)) AS iter) GROUP BY ALL),
 o AS (SELECT key, round(sum(pnl), 4) AS observed FROM results GROUP BY key) SELECT f.key, round(avg((total >= observed)::INT), 6) + 0.0 AS p_value FROM f JOIN o ON o.key = f.key GROUP BY f.key""")
def v11(spark, d):
    return MC.sign_flip(results(spark, d)).select("key", tidy(F.col("p_value")).alias("p_value"))


@query("v12_trade_skip", f"""WITH {RESULTS}, s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_pseudo('seq', '1')}, seq) AS r, count(*) OVER (PARTITION BY key) AS n FROM results)
 SELECT key, count(*) AS n, round(sum(pnl), 4) + 0.0 AS total FROM s WHERE r <= n - floor(n * 0.05::DOUBLE) GROUP BY key""")
def v12(spark, d):
    return MC.trade_skip(results(spark, d)).groupBy("key").agg(F.count("*").alias("n"), tidy(F.sum("pnl"), 4).alias("total"))


_SKIPPED = f"""{RESULTS}, sk AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_pseudo('seq', '1')}, seq) AS r, count(*) OVER (PARTITION BY key) AS n FROM results
), kept AS (SELECT key, seq, pnl FROM sk WHERE r <= n - floor(n * 0.05::DOUBLE))"""


@query("v12_skip_quality", f"WITH {_SKIPPED}, {metric_sql('kept', 'key', 'seq')} SELECT key, round(quality, 5) + 0.0 AS quality FROM mq")
def v12_quality(spark, d):
    return MC.skip_quality(results(spark, d), ["key"], ["seq"]).select("key", tidy(F.col("quality"), 5).alias("quality"))


_PLAIN = metric_sql("results", "key", "seq").replace("m_", "a_").replace("mq AS", "aq AS")
_STRESS = metric_sql("stressed", "key", "seq")


@query("v14_monte_carlo_gates", f"""WITH {RESULTS}, {_PLAIN}, stressed AS (SELECT key, seq, pnl - 0.5 * 0.5 - 0.7 * 0.3 AS pnl FROM results), {_STRESS},
 f AS (SELECT key, iter, round(sum(pnl * CASE WHEN ({_pseudo('iter // 30', 'seq')} >> (iter % 30)) & 1 = 0 THEN 1 ELSE -1 END), 4) AS total FROM results, (SELECT unnest(range(1000)) AS iter) GROUP BY ALL),
 o AS (SELECT key, round(sum(pnl), 4) AS observed FROM results GROUP BY key), pv AS (SELECT f.key, avg((total >= observed)::INT) AS p FROM f JOIN o ON o.key = f.key GROUP BY f.key)
 SELECT aq.key, round(aq.sharpe / sqrt(252), 6) + 0.0 AS observed_sharpe, round(p, 6) + 0.0 AS p_value, round(mq.quality, 4) + 0.0 AS stress_quality,
  round(CASE WHEN aq.quality > 0 THEN mq.quality / aq.quality ELSE 0 END, 4) + 0.0 AS stress_ratio, p <= 0.05 AS p_ok
 FROM aq JOIN mq ON mq.key = aq.key JOIN pv ON pv.key = aq.key""")
def v14(spark, d):
    r = MC.record(results(spark, d), ["key"], ["seq"], trials=100)
    return r.select("key", tidy(F.col("observed_sharpe")).alias("observed_sharpe"), tidy(F.col("p_value")).alias("p_value"), tidy(F.col("stress_quality"), 4).alias("stress_quality"), tidy(F.col("stress_ratio"), 4).alias("stress_ratio"), (F.col("p_value") <= 0.05).alias("p_ok"))


@query("v13_cost_stress", f"WITH {RESULTS} SELECT key, seq, round(pnl - 0.5 * 0.5 - 0.7 * 0.3, 4) + 0.0 AS pnl FROM results")
def v13(spark, d):
    return MC.cost_stress(results(spark, d)).select("key", "seq", tidy(F.col("pnl"), 4).alias("pnl"))


def _candidates(spark, d):
    """Stand-in candidates: customers with derived measures."""
    c = read(spark, d, "customer")
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return c.select(k.alias("trial"), (k % 40 + 10).alias("trades"), (F.pmod(k * 37, F.lit(200)) / 100 - 0.5).alias("sharpe"), rounded(b / 100, 2).alias("quality"), (rounded(b / 200, 2) + k % 7).alias("quality_forward"), F.pmod(k, F.lit(12)).alias("group"), F.pmod(k * 13, F.lit(90)).alias("mean_held"))


_CAND = "cand AS MATERIALIZED (SELECT c_custkey AS trial, c_custkey % 40 + 10 AS trades, (c_custkey * 37) % 200 / 100::DOUBLE - 0.5 AS sharpe, round(c_acctbal / 100, 2) AS quality, round(c_acctbal / 200, 2) + c_custkey % 7 AS quality_forward, c_custkey % 12 AS grp, (c_custkey * 13) % 90 AS mean_held FROM customer)"
_PHI = "CASE WHEN z >= 0 THEN (1 + erf) / 2 ELSE (1 - erf) / 2 END"
_DSR = """ds0 AS (SELECT *, CASE WHEN trades < 2 THEN NULL ELSE sharpe / sqrt(greatest((1 + 0.5 * sharpe * sharpe) / greatest(trades - 1, 1), 1e-10)) - sqrt(2 * ln(25e0)) END AS z FROM cand),
 ds1 AS (SELECT *, abs(z) / sqrt(2e0) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2e0)) AS t FROM ds0),
 ds2 AS (SELECT *, 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS erf FROM ds1),
 dsr AS MATERIALIZED (SELECT *, round(""" + _PHI + ", 6) + 0.0 AS dsr FROM ds2)"


def _dsr(spark, d):
    return _candidates(spark, d).withColumn("dsr", tidy(SE.deflated_sharpe(F.col("sharpe"), F.col("trades"), F.lit(25))))


@query("o18_deflated_sharpe", f"WITH {_CAND}, {_DSR} SELECT trial, dsr FROM dsr")
def o18(spark, d):
    return _dsr(spark, d).select("trial", "dsr")


@query("o19_selection", f"""WITH {_CAND}, {_DSR}, fl AS (SELECT *, CASE WHEN max(dsr) OVER () >= 0.95 THEN 0.95 WHEN max(dsr) OVER () >= 0.9 THEN 0.9 ELSE -1 END AS floor_ FROM dsr), k AS (SELECT * FROM fl WHERE dsr >= floor_ QUALIFY row_number() OVER (PARTITION BY grp ORDER BY quality DESC, trial) <= 3)
 SELECT trial, grp AS dedup_key, round(quality, 4) + 0.0 AS quality FROM k ORDER BY quality DESC, trial LIMIT 20""")
def o19(spark, d):
    return SE.select(_dsr(spark, d), F.col("group")).select("trial", "dedup_key", tidy(F.col("quality"), 4).alias("quality"))


@query("o16_combined_rank", f"WITH {_CAND} SELECT trial, row_number() OVER (ORDER BY quality DESC, trial) - 1 + 1.5::DOUBLE * (row_number() OVER (ORDER BY quality_forward DESC, trial) - 1) AS combined FROM cand")
def o16(spark, d):
    return SE.combined_rank(_candidates(spark, d).withColumnRenamed("quality", "quality_back")).select("trial", "combined")


@query("o17_forward_back", f"WITH {_CAND}, r AS (SELECT trial, CASE WHEN quality > 0 THEN quality_forward / quality ELSE 0 END AS ratio FROM cand) SELECT trial, round(ratio, 6) + 0.0 AS ratio, ratio >= 0.4 AS ratio_ok FROM r")
def o17(spark, d):
    return SE.forward_back(_candidates(spark, d).withColumnRenamed("quality", "quality_back")).select("trial", tidy(F.col("ratio")).alias("ratio"), "ratio_ok")


@query("o15_top_n", f"WITH {_CAND} SELECT trial, round(quality, 4) + 0.0 AS quality FROM cand WHERE trades >= 20 ORDER BY cand.quality DESC, trial LIMIT 50")
def o15(spark, d):
    """A top-n report: its limit is the feature."""
    return _candidates(spark, d).where("trades >= 20").orderBy(F.desc("quality"), "trial").limit(50).select("trial", tidy(F.col("quality"), 4).alias("quality"))


@query("f8_prefilter", f"WITH {_CAND} SELECT trial FROM cand WHERE NOT (trial % 2 = 0 AND trial % 4 >= trades % 3)")
def f8(spark, d):
    from quantloom.operators.filters import valid_params

    c = _candidates(spark, d).withColumns({"be_enabled": F.col("trial") % 2 == 0, "be_offset": F.col("trial") % 4, "be_trigger": F.col("trades") % 3})
    return valid_params(c).select("trial")


@query("f9_postfilter", f"WITH {_CAND} SELECT trial FROM cand WHERE trades * 10 >= greatest(200, floor(30 * 8.5)) AND mean_held <= 30 AND (trial % 10) / 10::DOUBLE >= 0.5")
def f9(spark, d):
    from quantloom.operators.filters import passing

    c = _candidates(spark, d).withColumns({"trades": F.col("trades") * 10, "max_dd_pct": F.col("mean_held").cast("double"), "r_squared": (F.col("trial") % 10) / 10})
    return passing(c, 8.5).select("trial")


_FOLD_SCORES = f"{_CAND}, fs AS (SELECT trial, k AS fold, (trial * (k + 3)) % 12 AS trades, round(((trial * (k + 7)) % 50)::DOUBLE / 5, 4) AS quality FROM cand, (SELECT unnest(range(5)) AS k))"


def _fold_scores(spark, d):
    c = _candidates(spark, d).select("trial", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    return c.select("trial", "fold", (F.col("trial") * (F.col("fold") + 3) % 12).alias("trades"), F.round(F.col("trial") * (F.col("fold") + 7) % 50 / 5, 4).alias("quality"))


@query("o12_fold_aggregation", f"""WITH {_FOLD_SCORES}, v AS (SELECT *, count(*) OVER (PARTITION BY trial) AS k, row_number() OVER (PARTITION BY trial ORDER BY quality, fold) AS r FROM fs WHERE trades >= 5),
 a AS (SELECT trial, max(k) AS valid, greatest(avg(quality), 0) AS score FROM v WHERE r <= greatest(1, floor(0.4 * k)) GROUP BY trial)
 SELECT t.trial, coalesce(valid, 0) AS valid, round(CASE WHEN valid >= 2 THEN score ELSE 0 END, 6) + 0.0 AS score FROM (SELECT DISTINCT trial FROM fs) t LEFT JOIN a ON a.trial = t.trial""")
def o12(spark, d):
    return SE.aggregate_folds(_fold_scores(spark, d)).select("trial", F.col("valid").cast("long").alias("valid"), tidy(F.col("score")).alias("score"))


@query("o13_culling", f"WITH {_FOLD_SCORES} SELECT trial FROM fs WHERE fold = 1 AND quality >= (SELECT quantile_cont(quality, 0.3) FROM fs WHERE fold = 1)")
def o13(spark, d):
    return SE.survivors(_fold_scores(spark, d).where("fold = 1"), first=False).select("trial")


@query("o14_archive", f"""WITH {_CAND} SELECT trial, (trades * 3 >= 30)::INTEGER + (trades * 3 >= 100)::INTEGER AS cell_trades, (quality >= 5)::INTEGER + (quality >= 15)::INTEGER + (quality >= 30)::INTEGER AS cell_quality FROM cand
 QUALIFY row_number() OVER (PARTITION BY cell_trades, cell_quality ORDER BY quality DESC, trial) = 1""")
def o14(spark, d):
    return SE.archive(_candidates(spark, d).withColumn("trades", F.col("trades") * 3)).select("trial", "cell_trades", "cell_quality")


@query("o5_entropy", f"WITH {_CAND}, c AS (SELECT grp % 3 AS name, trades % 5 AS position, count(*) AS c FROM cand GROUP BY ALL), p AS (SELECT name, c::DOUBLE / sum(c) OVER (PARTITION BY name) AS p FROM c) SELECT name, round(-sum(p * ln(p)) / ln(5), 6) + 0.0 AS entropy FROM p GROUP BY name")
def o5(spark, d):
    c = _candidates(spark, d).select((F.col("group") % 3).alias("name"), F.lit(5).alias("size"), (F.col("trades") % 5).alias("position"))
    return SE.entropy(c).select("name", tidy(F.col("entropy")).alias("entropy"))


@query("o4_elite_histogram", f"WITH {_CAND}, c AS (SELECT grp % 3 AS name, trades % 5 AS position, count(*) AS c FROM cand WHERE quality > 50 GROUP BY ALL) SELECT name, position, round(c::DOUBLE / sum(c) OVER (PARTITION BY name), 6) + 0.0 AS share FROM c")
def o4(spark, d):
    c = _candidates(spark, d).where("quality > 50").select((F.col("group") % 3).alias("name"), (F.col("trades") % 5).alias("position"))
    return SE.elite_histogram(c).select("name", "position", tidy(F.col("share")).alias("share"))


_S = "100 * least(greatest(({x}) / {d}::DOUBLE, 0), 1)"


def _sc(x: str, d: float) -> str:
    return _S.format(x=x, d=d)


@query("v17_v19_confidence", f"""WITH {_CAND}, m AS (SELECT trial, trial % 6 AS n_oos, (trial % 11) / 10::DOUBLE AS pass_rate, (trial % 61)::DOUBLE AS geo, (trial % 25)::DOUBLE - 2 AS minq, (trial % 7) / 5::DOUBLE AS cv, (trial % 13) / 10::DOUBLE - 0.4::DOUBLE AS lo, (trial % 13) / 10::DOUBLE + (trial % 3) / 2::DOUBLE - 0.4::DOUBLE AS hi,
  (trial % 21) / 40::DOUBLE AS p, CASE WHEN trial % 5 = 0 THEN NULL ELSE (trial % 37)::DOUBLE END AS sk, (trial % 17) / 15::DOUBLE AS st, (trial % 19) / 12::DOUBLE AS ratio, (trial % 23) / 20::DOUBLE AS mr, (trial % 9) / 12::DOUBLE AS nr, (trial % 101) / 100::DOUBLE AS dsr, quality, trades * 3 AS tr, sharpe * 4 AS sh,
  CASE WHEN trial % 2 = 0 THEN trial % 30 ELSE 0 END AS folds, (trial % 8) / 8::DOUBLE AS cp FROM cand),
 s AS (SELECT *, CASE WHEN n_oos > 0 THEN 40 * pass_rate + 0.2::DOUBLE * {_sc('geo', 50)} + 0.15::DOUBLE * {_sc('minq', 20)} + 15 * greatest(1 - cv, 0) + 0.1::DOUBLE * {_sc('n_oos', 4)} ELSE 0 END AS wf0,
  40 * cp + 0.3::DOUBLE * {_sc('sh', 2)} + 20 * greatest(1 - (hi - lo) / 2, 0) + 0.1::DOUBLE * {_sc('folds', 20)} AS cv0,
  0.3::DOUBLE * CASE WHEN lo > 0 THEN {_sc('lo', 1)} WHEN hi - lo > 0 THEN 50 * greatest(hi / (hi - lo), 0) ELSE 0 END + 0.3::DOUBLE * CASE WHEN p <= 1e-3 THEN 100 WHEN p <= 5e-2 THEN 80 + 20 * (5e-2 - p) / 49e-3 WHEN p <= 5e-1 THEN 80 * (5e-1 - p) / 45e-2 ELSE 0 END + 0.2::DOUBLE * coalesce({_sc('sk', 30)}, 50) + 0.2::DOUBLE * {_sc('st', 0.8)} AS mc,
  {_sc('ratio', 1)} AS fb, 0.7::DOUBLE * {_sc('mr - 4e-1', 0.6)} + 0.3::DOUBLE * {_sc('nr', 0.5)} AS sb, CASE WHEN dsr <= 5e-1 THEN 0 WHEN dsr <= 95e-2 THEN 80 * (dsr - 5e-1) / 45e-2 WHEN dsr <= 99e-2 THEN 80 + 20 * (dsr - 95e-2) / 4e-2 ELSE 100 END AS ds,
  0.5::DOUBLE * least(2 * quality, 100) + 0.25::DOUBLE * {_sc('tr', 100)} + 0.25::DOUBLE * {_sc('sh', 2)} AS bt FROM m),
 c AS (SELECT trial, pass_rate, 0.30::DOUBLE * CASE WHEN folds > 0 THEN 0.6::DOUBLE * wf0 + 0.4::DOUBLE * cv0 ELSE wf0 END + 0.25::DOUBLE * mc + 0.15::DOUBLE * fb + 0.10::DOUBLE * sb + 0.10::DOUBLE * ds + 0.10::DOUBLE * bt AS composite FROM s)
 SELECT trial, round(composite, 7) + 0.0 AS composite, CASE WHEN pass_rate < 0.3 THEN 'RED' WHEN composite >= 70 THEN 'GREEN' WHEN composite >= 40 THEN 'YELLOW' ELSE 'RED' END AS confidence FROM c""")
def v19(spark, d):
    t = F.col("trial")
    low = t % 13 / 10 - 0.4
    c = _candidates(spark, d).withColumns({"n_oos": t % 6, "pass_rate": t % 11 / 10, "geo_quality": (t % 61).cast("double"), "min_quality": (t % 25).cast("double") - 2, "cv_quality": t % 7 / 5, "ci_low": low, "ci_high": t % 13 / 10 + t % 3 / 2 - 0.4, "p_value": t % 21 / 40, "skip_quality": F.when(t % 5 != 0, (t % 37).cast("double")), "stress_ratio": t % 17 / 15, "ratio": t % 19 / 12, "mean_ratio": t % 23 / 20, "min_ratio": t % 9 / 12, "dsr": t % 101 / 100, "trades": F.col("trades") * 3, "sharpe": F.col("sharpe") * 4, "cpcv_folds": F.when(t % 2 == 0, t % 30).otherwise(0), "cpcv_positive": t % 8 / 8})
    c = c.withColumns({"cpcv_sharpe": F.col("sharpe"), "cpcv_low": F.col("ci_low"), "cpcv_high": F.col("ci_high"), "gate_wf": F.col("pass_rate") >= 0.3})
    return V.confidence(c, ("gate_wf",)).select("trial", tidy(F.col("composite"), 7).alias("composite"), "confidence")


@query("v20_eliminated", f"WITH {_CAND} SELECT trial, trades * 8 < 255 AS eliminated FROM cand")
def v20(spark, d):
    return V.eliminate_thin(_candidates(spark, d).withColumn("trades", F.col("trades") * 8), 8.5).select("trial", "eliminated")


@query("j7_deals", "WITH d AS (SELECT user_id % 200 AS position_id, event_id AS deal_id, ts, value AS price, round(value / 10 - 25, 4) AS profit FROM events) SELECT position_id, count(*) AS n_deals, round(first(price ORDER BY ts, deal_id), 4) + 0.0 AS entry_price, round(last(price ORDER BY ts, deal_id), 4) + 0.0 AS exit_price, round(sum(profit), 4) + 0.0 AS profit FROM d WHERE position_id <> 0 GROUP BY position_id HAVING count(*) >= 2")
def j7(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 200).alias("position_id"), F.col("event_id").alias("deal_id"), "ts", F.col("value").alias("price"), F.round(F.col("value") / 10 - 25, 4).alias("profit"))
    t = VE.trades_from_deals(e)
    return t.select("position_id", "n_deals", tidy(F.col("entry_price"), 4).alias("entry_price"), tidy(F.col("exit_price"), 4).alias("exit_price"), tidy(F.col("profit"), 4).alias("profit"))


_AUDIT = "a AS (SELECT user_id AS ticket, event_id AS seq, value AS price, CASE WHEN event_type IN ('view', 'click') THEN 'open' ELSE 'close' END AS kind FROM events)"


def _audit(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("ticket"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.when(F.col("event_type").isin("view", "click"), "open").otherwise("close").alias("kind"))


@query("j8_audit", f"WITH {_AUDIT}, o AS (SELECT ticket, min(seq) AS open_seq FROM a WHERE kind = 'open' GROUP BY ticket), c AS (SELECT o.ticket, open_seq, min(seq) AS close_seq FROM o JOIN a ON a.ticket = o.ticket AND a.kind = 'close' AND a.seq > open_seq GROUP BY ALL) SELECT * FROM c")
def j8(spark, d):
    return VE.trades_from_audit(_audit(spark, d)).select("ticket", "open_seq", "close_seq")


@query("j9_closed_by_broker", "WITH t AS (SELECT user_id * 100 + day(ts) AS ticket, event_type FROM events) SELECT DISTINCT ticket FROM t WHERE event_type = 'view' AND ticket NOT IN (SELECT ticket FROM t WHERE event_type = 'click')")
def j9(spark, d):
    """Users by day as tickets: those with a view are tracked, those with a click are still held."""
    e = read(spark, d, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("ticket"), "event_type")
    return VE.closed_by_broker(e.where("event_type = 'view'").select("ticket").distinct(), e.where("event_type = 'click'").select("ticket"))


@query("j9_without_open_order", "SELECT c_custkey AS ticket FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def j9_without_open_order(spark, d):
    """Customers as tracked tickets, open orders as the positions that the broker still holds."""
    tracked = read(spark, d, "customer").select(F.col("c_custkey").alias("ticket"))
    held = read(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("ticket"))
    return VE.closed_by_broker(tracked, held)


def _live_and_replay(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("group"), F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1).alias("direction"), (F.col("o_orderkey") * 97 % 864_000).alias("s"), F.col("o_totalprice").alias("p"))
    return o.where("id % 2 = 0"), o.where("id % 2 = 1")


def _matched(spark, d):
    """Each order as a live trade beside the order of the next key as its replay."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("p"), (F.col("o_orderkey") * 97 % 864_000).alias("s"))
    k = F.col("o_orderkey")
    live = o.select(k.alias("live_id"), F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1).alias("direction"), F.col("s").alias("live_s"), F.col("p").alias("live_entry"), (F.col("p") + 10).alias("live_exit"), (F.col("p") / 1000).alias("live_pnl"), F.when(k % 2 == 0, "SL").otherwise("tp").alias("live_reason"))
    replay = o.select(k.alias("replay_id"), F.col("s").alias("replay_s"), F.col("p").alias("replay_entry"), (F.col("p") + 7).alias("replay_exit"), (F.col("p") / 1000).alias("replay_pnl"), F.when(k % 3 == 0, "stop_loss").otherwise("take_profit").alias("replay_reason"))
    return live.join(replay, F.col("live_id") + 1 == F.col("replay_id"))


_COMPARED = """pr AS (
  SELECT a.o_orderkey AS live_id, b.o_orderkey AS replay_id, CASE WHEN a.o_custkey % 2 = 0 THEN 1 ELSE -1 END AS d,
         a.o_totalprice::DOUBLE AS p, b.o_totalprice::DOUBLE AS q, a.o_orderkey * 97 % 864000 AS s, b.o_orderkey * 97 % 864000 AS t
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1
), co AS (
  SELECT live_id, replay_id, round(d * (p - q) / 1e-2, 2) + 0.0 AS entry_slippage, round(-d * ((p + 10) - (q + 7)) / 1e-2, 2) + 0.0 AS exit_slippage,
         round((s - t) / 60.0::DOUBLE, 1) + 0.0 AS minutes, round(p / 1000 - q / 1000, 2) + 0.0 AS pnl_delta,
         (live_id % 2 = 0) = (replay_id % 3 = 0) AS same_reason
  FROM pr)"""


_MATCHED = """WITH RECURSIVE o AS (
  SELECT o_orderpriority AS g, o_orderkey AS id, o_custkey % 2 AS way, o_orderkey * 97 % 864000 AS s FROM orders
), near AS (
  SELECT a.g, a.id, a.s, list(b.id ORDER BY abs(b.s - a.s), b.id) AS wish
  FROM o a JOIN o b ON a.g = b.g AND a.way = b.way AND a.id % 2 = 0 AND b.id % 2 = 1 AND abs(b.s - a.s) <= 7200 GROUP BY ALL
), turn AS MATERIALIZED (
  SELECT g, id, wish, row_number() OVER (PARTITION BY g ORDER BY s, id) AS n FROM near
), walk(g, n, id, got, used) USING KEY (g) AS (
  SELECT DISTINCT g, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM turn
  UNION
  SELECT w.g, t.n, t.id, list_filter(t.wish, lambda x: NOT list_contains(w.used, x))[1], list_append(w.used, list_filter(t.wish, lambda x: NOT list_contains(w.used, x))[1])
  FROM walk w JOIN turn t ON t.g = w.g AND t.n = w.n + 1
), taken AS (SELECT g, unnest(used) AS replay_id, generate_subscripts(used, 1) AS n FROM walk)
SELECT taken.g AS "group", turn.id AS live_id, replay_id FROM taken JOIN turn ON turn.g = taken.g AND turn.n = taken.n WHERE replay_id IS NOT NULL"""


@query("j6_match", _MATCHED)
def j6(spark, d):
    """Greedy in order of entry; the SQL takes them one by one."""
    live, replay = _live_and_replay(spark, d)
    return VE.match(live.withColumnRenamed("id", "live_id"), replay.withColumnRenamed("id", "replay_id"))


def _compared(spark, d):
    c = VE.compare(_matched(spark, d), 0.01)
    return c.select("live_id", "replay_id", *(tidy(F.col(x), n).alias(x) for x, n in (("entry_slippage", 2), ("exit_slippage", 2), ("minutes", 1), ("pnl_delta", 2))), "same_reason")


@query("c2_compare", f"WITH {_COMPARED} SELECT * FROM co")
def c2(spark, d):
    return _compared(spark, d)


@query("c3_aggregates", f"""WITH {_COMPARED} SELECT count(*) AS matched, round(avg(entry_slippage), 3) + 0.0 AS mean_slippage, round(avg(pnl_delta), 4) + 0.0 AS mean_pnl_delta,
  round(avg(same_reason::INT), 4) + 0.0 AS reason_rate FROM co""")
def c3(spark, d):
    n = read(spark, d, "orders").count()
    a = VE.aggregates(_compared(spark, d), n, n)
    return a.select("matched", tidy(F.col("mean_slippage"), 3).alias("mean_slippage"), tidy(F.col("mean_pnl_delta"), 4).alias("mean_pnl_delta"), tidy(F.col("reason_rate"), 4).alias("reason_rate"))


@query("l5_pre_trade", """SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'circuit_breaker' WHEN c_custkey % 13 >= 10 THEN 'daily_trades' WHEN c_acctbal - 5000 <= -(10000 * 3.0 / 100) AND c_custkey % 3 = 0 THEN 'daily_loss' WHEN (12000 - (11000 - c_custkey % 2000)) / 12000.0::DOUBLE * 100 >= 10 THEN 'drawdown'
  WHEN c_custkey % 5 >= 3 THEN 'open_positions' WHEN c_custkey % 7 = 0 THEN 'same_symbol' WHEN (c_custkey % 9) / 2.0::DOUBLE > 3 THEN 'spread' ELSE 'ok' END AS verdict FROM customer""")
def l5(spark, d):
    k = F.col("c_custkey")
    pnl = F.when(k % 3 == 0, F.col("c_acctbal") - 5000).otherwise(0.0)
    c = read(spark, d, "customer").withColumns({"breaker": k % 50 == 0, "daily_trades": k % 13, "daily_pnl": pnl, "balance": F.lit(10_000.0), "equity": (11_000 - k % 2000).cast("double"), "peak_equity": F.lit(12_000.0), "open_positions": k % 5, "same_symbol": F.when(k % 7 == 0, 1).otherwise(0), "spread_pips": k % 9 / 2})
    return c.select("c_custkey", risk.pre_trade().alias("verdict"))


@query("l6_position_size", "SELECT c_custkey, round(least(greatest(round(floor((10000 + c_custkey) * 1.0::DOUBLE / 100 / ((c_custkey % 90 + 10) * 10.0::DOUBLE) / 0.01::DOUBLE + 1e-9) * 0.01::DOUBLE, 8), 0.01), 100.0), 4) + 0.0 AS lots FROM customer")
def l6(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select("c_custkey", tidy(risk.position_size((10_000 + k).cast("double"), (k % 90 + 10).cast("double"), F.lit(10.0)), 4).alias("lots"))


_BREAKER = """e AS (
  SELECT event_type AS pair, event_id, user_id % 4 AS u, ts FROM events
), k AS (
  SELECT *, CASE u WHEN 0 THEN 'daily_loss' WHEN 1 THEN 'drawdown' WHEN 2 THEN '' END AS said, row_number() OVER (PARTITION BY pair ORDER BY ts, event_id) AS n FROM e
), w AS (
  SELECT *, last_value(said IGNORE NULLS) OVER z AS reason, max(CASE WHEN said IS NOT NULL THEN n END) OVER z AS at_set, max(CASE WHEN u = 3 THEN n END) OVER z AS at_day
  FROM k WINDOW z AS (PARTITION BY pair ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("l7_breaker", f"WITH {_BREAKER} SELECT event_id, CASE WHEN reason = 'daily_loss' AND at_day > at_set THEN '' ELSE coalesce(reason, '') END AS reason FROM w")
def l7(spark, d):
    u = F.col("user_id") % 4
    kind = F.when(u <= 1, "trip").when(u == 2, "reset").otherwise("day")
    e = read(spark, d, "events").select(F.col("event_type").alias("pair"), "ts", "event_id", kind.alias("kind"), F.when(u == 0, "daily_loss").when(u == 1, "drawdown").alias("said"))
    return risk.breaker(e, ["pair"], ["ts", "event_id"]).select("event_id", "reason")


@query("l8_close_accounting", """WITH c AS (
  SELECT o_orderpriority AS key, o_orderdate AS day, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END * ((o_totalprice::DOUBLE / 1000 + o_orderkey % 7 - 3) - o_totalprice::DOUBLE / 1000) / 1e-2 * 0.5 + o_orderkey % 5 AS pips FROM orders)
 SELECT key, count(*) AS closed, count(*) FILTER (round(pips, 4) >= 0) AS wins, count(*) FILTER (round(pips, 4) < 0) AS losses, round(sum(round(pips, 4)), 2) + 0.0 AS pips FROM c GROUP BY key""")
def l8(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("double") / 1000
    closed = read(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1).alias("direction"), p.alias("entry_price"), (p + k % 7 - 3).alias("exit_price"), F.lit(0.5).alias("position_pct"), (k % 5).cast("double").alias("realised_pips"))
    r = risk.close_accounting(closed, 0.01, ["key"])
    return r.select("key", "closed", "wins", "losses", tidy(F.col("pips"), 2).alias("pips"))


@query("l10_magic", "SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 8))::BIGINT % 2147483648 AS magic FROM customer")
def l10(spark, d):
    return read(spark, d, "customer").select("c_custkey", risk.magic(F.col("c_name")).alias("magic"))


@query("x1_links")
def x1(spark, d):
    return A.links(read(spark, d, "pages"))


@query("x2_first_of", "SELECT host, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) GROUP BY host")
def x2(spark, d):
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return A.first_of(p, "host", ("page_id",))


@query("x3_markdown")
def x3(spark, d):
    return A.markdown(read(spark, d, "pages"))




@query("x4_x5_label_counts", "WITH l AS (SELECT CASE event_id % 6 WHEN 0 THEN 'SIGNAL' WHEN 1 THEN 'EXIT' WHEN 2 THEN 'RISK' ELSE 'SKIP' END AS label FROM events), c AS (SELECT label, count(*) AS n FROM l GROUP BY label) SELECT label, n, round(100.0::DOUBLE * n / sum(n) OVER (), 2) + 0.0 AS pct FROM c")
def x5(spark, d):
    raw = F.element_at(F.array(*map(F.lit, (" signal", "Exit ", "RISK", "other", "", "skip"))), (F.col("event_id") % 6 + 1).cast("int"))
    e = read(spark, d, "events").select(A.normal_label(raw).alias("label"))
    return A.label_counts(e)


_GENERIC = ((0, (0, -1, -1, -1, -1, -1, -1, -1, -1, -1)), (1, (1, 2, -1, -1, -1, -1, -1, -1, -1, -1)), (2, (-1, -1, 3, -1, -1, -1, 4, -1, -1, -1)), (3, (-1,) * 10))


@query("f3_generic_filters", "WITH s AS (SELECT c_custkey, [" + ", ".join(f"c_custkey % {i + 2} - {i % 2}" for i in range(10)) + "] AS v FROM customer), t(trial, w) AS (VALUES " + ", ".join(f"({t}, {list(w)})" for t, w in _GENERIC) + """)
 SELECT c_custkey, trial FROM s CROSS JOIN t WHERE """ + " AND ".join(f"(w[{i}] < 0 OR v[{i}] < 0 OR w[{i}] = v[{i}])" for i in range(1, 11)))
def f3(spark, d):
    from quantloom.operators.filters import generic_passes
    from quantloom.operators.simulate import evaluate

    k = F.col("c_custkey")
    s = read(spark, d, "customer").select(k, *((k % (i + 2) - i % 2).alias(f"sig_filter_{i}") for i in range(10)))
    t = spark.createDataFrame([(n, *w) for n, w in _GENERIC], "trial int, " + ", ".join(f"sig_filter_{i} long" for i in range(10)))
    return evaluate(s, t, generic_passes()).select("c_custkey", "trial")


@query("p4_index_to_value", f"WITH {_SPACE}, {_CHOSEN} SELECT candidate AS trial, c.name, value FROM ch c JOIN sp ON sp.name = c.name AND sp.position = c.at_")
def p4(spark, d):
    return _chosen(spark, d).join(_space().table(spark), ["name", "position"]).select(F.col("candidate").alias("trial"), "name", "value")


@query("p6_combinations", """WITH sp AS (SELECT DISTINCT name, value FROM (SELECT p_brand AS brand, p_type AS type, p_size::VARCHAR AS size FROM part) UNPIVOT (value FOR name IN (brand, type, size))),
 n AS (SELECT name, count(*) AS n FROM sp GROUP BY name) SELECT product(n)::BIGINT AS combinations FROM n""")
def p6(spark, d):
    """Combinations of a space whose parameters are columns of parts, their values what occurs."""
    parts = read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"))
    n = parts.unpivot([], ["brand", "type", "size"], "name", "value").where("value is not null").distinct().groupBy("name").agg(F.count("*").alias("n"))
    return n.agg(F.product("n").cast("long").alias("combinations"))


@query("v3_window_pass", f"WITH {_WR} SELECT candidate, window_id, trades >= 10 AND sharpe > 0 AND quality > 0 AS passed FROM wr")
def v3(spark, d):
    return _window_results(spark, d).select("candidate", F.col("window_id").cast("long").alias("window_id"), V.window_passes().alias("passed"))


@query("v23_report_rank", f"WITH {_CAND} SELECT trial AS candidate, row_number() OVER (ORDER BY trades < 20, quality DESC, trial) - 1 AS rank FROM cand")
def v23(spark, d):
    c = _candidates(spark, d).select(F.col("trial").alias("candidate"), (F.col("trades") < 20).alias("eliminated"), F.col("quality").alias("composite"))
    return V.report(c).select("candidate", "rank")


@query("snk4_best_runs", f"WITH {_CAND} SELECT grp AS run, first(trial ORDER BY quality DESC, trial) AS candidate, round(max(quality), 4) + 0.0 AS composite FROM cand WHERE trades >= 20 GROUP BY grp")
def snk4(spark, d):
    from quantloom.sources.store import best_runs

    c = _candidates(spark, d).select(F.col("group").alias("run"), F.col("trial").alias("candidate"), (F.col("trades") < 20).alias("eliminated"), F.col("quality").alias("composite"))
    return best_runs(c).select("run", "candidate", tidy(F.col("composite"), 4).alias("composite"))


@query("l3_newest_signals", f"WITH {BARS} SELECT pair, max(bar_idx) AS bar_idx, 1::INTEGER AS direction FROM bars GROUP BY pair")
def l3(spark, d):
    from quantloom.operators import signals as S

    bars = hourly(spark, d)
    return S.newest(S.always_buy(bars, 0.01), bars).select("pair", "bar_idx", "direction")


@query("u5_progress", "SELECT user_id % 10 AS run, max(event_id) AS done, round(max(value), 4) + 0.0 AS best, last(event_type ORDER BY event_id) AS stage FROM events GROUP BY ALL")
def u5(spark, d):
    from quantloom.streaming.live import progress

    e = read(spark, d, "events").select((F.col("user_id") % 10).alias("run"), F.col("event_id").alias("done"), F.col("value").alias("best"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"))
    return progress(e).select("run", "done", tidy(F.col("best"), 4).alias("best"), "stage")
