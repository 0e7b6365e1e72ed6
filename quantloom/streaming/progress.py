"""Progress of runs as a throttled stream: the latest message of each run, at most one in an interval, with a snapshot.

A run may report a thousand times a second; those who watch want its latest state now and then.  Each run is a key
whose latest message lies in the state store.  A message goes out at once if the interval since the last one is over;
else a timer sends what is latest when it ends.  So the last message of a run always arrives, and none is sent twice.
Late readers take ``snapshot`` of the query's state: a row for each run, without waiting for the next message.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "run string, seq long, body string"
STATE = "seq long, body string, sent_seq long, sent_ms long"


class Throttle(StatefulProcessor):
    """Of the messages (run, seq, body) of a run the one of the greatest seq, once an interval."""

    def __init__(self, interval_ms: int):
        self.interval = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        seq, body, sent_seq, sent_ms = self.state.get() if self.state.exists() else (-1, "", -1, 0)
        for r in rows:
            if r["seq"] > seq:
                seq, body = r["seq"], r["body"]
        self.state.update((seq, body, sent_seq, sent_ms))
        return self._send(key[0], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        return self._send(key[0], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass

    def _send(self, run: str, now: int) -> Iterator[Row]:
        seq, body, sent_seq, sent_ms = self.state.get()
        if seq <= sent_seq:
            return iter([])
        if now - sent_ms < self.interval:
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(sent_ms + self.interval)
            return iter([])
        self.state.update((seq, body, seq, now))
        return iter([Row(run=run, seq=seq, body=body)])


def throttled(messages: DataFrame, interval_ms: int = 100) -> DataFrame:
    """(run, seq, body) of a stream of such, throttled; the session's state store must be RocksDB."""
    return messages.select("run", "seq", "body").groupBy("run").transformWithState(Throttle(interval_ms), OUT, "Append", "ProcessingTime")


def snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(run, seq, body): the latest message of each run, by the state of a query's last finished batch."""
    state = spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint)
    return state.select(F.col("key.run").alias("run"), "value.seq", "value.body")
