"""Halves and last digits: queries on derived measures of customers against their SQL on balances made for it."""

import duckdb
import pytest

from quantloom.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()
BALANCES = [78.83, 7883.5, 7884.0, 7219.5, 7220.0, 100.5, 101.0, 845.0, 3591.0, -100.5, -845.0, 0.0]


def both(spark, folder, name, rows):
    """Rows of a query and of its SQL, sorted, over customers of (key, balance)."""
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{folder}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{folder}/customer.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    cols = [x[0] for x in want.description]
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*cols).collect()), key=repr), sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["v23_report_rank", "o16_combined_rank"])
def test_ranks_of_rounded_halves(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, [(10 + i, b) for i, b in enumerate(BALANCES)])
    assert got == want


def test_ratio_of_rounded_halves(spark, tmp_path):
    got, want = both(spark, tmp_path, "o17_forward_back", [(10 + i, b) for i, b in enumerate(BALANCES)])
    assert got == want


@pytest.mark.parametrize("rows", [[(1724280, 8599.13)], [(10 + i, b) for i, b in enumerate(BALANCES)] + [(4772, 7883.5)]], ids=["threshold", "halves"])
def test_confidence_at_a_threshold(spark, tmp_path, rows):
    """The first composite is 40 in SQL; lines summed in another order gave a last digit below it."""
    got, want = both(spark, tmp_path, "v17_v19_confidence", rows)
    assert got == want
