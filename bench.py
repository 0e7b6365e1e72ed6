"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is written to the no-op sink, so all rows and columns are computed.  A
first untimed pass over the smallest query starts the JVM's compilers.  ``evals`` is
the number of evaluations of the batch, one trial over one pair's signals each, ``evals_per_s``
the rate, metrics included, ``full_evals_per_s`` that of the full mode (as many evaluations, with a cap of trades); ``trades`` the number of trades that the basic mode resolves.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from quantloom.plans import catalogue, trading

HEADLINES = (
    "ag1_bars", "ag1_resample_h4", "j2_map_sub_bars", "ag10_quality_report", "w03_ema", "w06_rsi", "w10_adx", "w21_regime", "m10_metrics",
    "st1_ema_crossover", "f_trial_filters", "p1_p2_stops", "tr2_basic_simulation", "flagship_sma_metrics", "tr4_full_simulation", "tr13_batch_evaluation", "tr13_full_batch", "v7_cpcv", "v11_sign_flip", "o19_selection",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()

    def timed(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        spark.catalog.clearCache()
        return round(took, 3)

    timed("ag12_status")
    took = {name: timed(name) for name in HEADLINES}
    found = trading.grid_trades(spark, sf_dir).groupBy("pair", "trial").count().agg({"*": "count", "count": "sum"}).first()
    evals, trades = found["count(1)"], found["sum(count)"]
    sf = re.search(r"sf([\d.]+)", sf_dir)
    total = {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took}
    total |= {"sf": float(sf[1]) if sf else sf_dir, "evals": evals, "trades": trades, "evals_per_s": round(evals / took["tr13_batch_evaluation"], 1), "full_evals_per_s": round(evals / took["tr13_full_batch"], 1)}
    print(json.dumps(total))
    spark.stop()


if __name__ == "__main__":
    main()
