"""Positions and quantiles over ranges against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.functions.order import quantile, ranked
from quantloom.operators.search import survivors


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_ranks_and_quantiles(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, *map(float, range(40))])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x double").repartition(5)
    got = [r["id"] for r in ranked(df, "place", F.desc_nulls_last("x"), "id").orderBy("place").collect()]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert [r["place"] for r in ranked(df, "place", "x", "id").orderBy("place").collect()] == list(range(n))
    for share in (0.0, 0.3, 0.5, 1.0):
        want = df.agg(F.percentile("x", F.lit(share)).alias("cut")).first()["cut"]
        mine = quantile(df, "x", share).first()["cut"]
        assert mine == want or abs(mine - want) < 1e-9
    kept = survivors(df.withColumnRenamed("x", "quality"), first=False).count()
    cut = df.agg(F.percentile("x", F.lit(0.3)).alias("cut")).first()["cut"]
    assert kept == (n if n <= 10 else sum(x is not None and x >= cut for _, x in rows))
