"""A thousand messages give one, the last always arrives, late readers see the latest state."""

import time

import pytest

from quantloom.streaming import cycle, progress

MESSAGES = "run string, seq long, body string"


@pytest.fixture()
def rocks(spark):
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, cycle.PROVIDER)
    yield spark
    spark.conf.unset(conf)


def until(found, wanted, seconds=90):
    """Ask again until an answer is there; a query with timers of processing time never rests, so it isn't waited for."""
    end = time.time() + seconds
    while found() != wanted and time.time() < end:
        time.sleep(0.5)
    assert found() == wanted


def test_throttle_and_snapshot(rocks, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    put = lambda rows: rocks.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(source)
    put([("a", i, f"a{i}") for i in range(1000)] + [("b", 7, "b7")])
    told = progress.throttled(rocks.readStream.schema(MESSAGES).parquet(source), 20_000)
    q = told.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    try:
        sent = lambda: sorted(tuple(r) for r in rocks.table("told").collect())
        first = [("a", 999, "a999"), ("b", 7, "b7")]
        until(sent, first)
        began = time.time()
        put([("a", i, f"a{i}") for i in range(900, 1500)] + [("b", 3, "old")])
        until(lambda: sorted(tuple(r) for r in progress.snapshot(rocks, checkpoint).collect()), [("a", 1499, "a1499"), ("b", 7, "b7")])
        assert sent() == first or time.time() - began > 19  # within the interval, and an old one
        until(sent, [("a", 999, "a999"), ("a", 1499, "a1499"), ("b", 7, "b7")])  # the timer has sent the last
    finally:
        q.stop()
