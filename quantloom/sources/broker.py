"""A broker's candles and deals as Python data sources: ``broker_candles`` and ``broker_deals``.

What the broker answers comes from a feed, named by the option ``feed`` as ``module:class`` and made with all
options; ``FolderFeed`` reads CSV files.  Filters on symbol and time go to the feed: a range of time becomes slices that
load in parallel, each a request for its own days, so a lost task asks again for one slice.  Without a range, the option
``latest`` asks for the newest bars of each symbol.  The session must have ``spark.sql.python.filterPushdown.enabled``; without it
whole series are read and Spark filters them.

The broker's clock is in its own zone (option ``zone``, EET by default); rows are in UTC.  ``broker_deals`` can be streamed:
deal numbers are the offsets, so a restarted query goes on after the last deal it has committed.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from importlib import import_module
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

CANDLES = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume long, spread_points long"
DEALS = "symbol string, position_id long, deal_id long, ts timestamp, type int, price double, volume double, profit double, commission double, swap double, comment string, magic long"
SLICE_DAYS = 31
FIRST = datetime(1990, 1, 1)


class FolderFeed:
    """candles_<symbol>_<tf>.csv and deals.csv below the option ``path``; times are the broker's."""

    def __init__(self, options: dict):
        self.root = Path(options["path"])

    def candles(self, symbol: str, tf: str, start: datetime, end: datetime) -> Iterator[dict]:
        for r in self._rows(f"candles_{symbol}_{tf}.csv"):
            if start <= datetime.fromisoformat(r["ts"]) < end:
                yield r

    def latest(self, symbol: str, tf: str, count: int) -> list[dict]:
        return sorted(self._rows(f"candles_{symbol}_{tf}.csv"), key=lambda r: r["ts"])[-count:]

    def last_deal(self) -> int:
        return max((int(r["deal_id"]) for r in self._rows("deals.csv")), default=0)

    def deals(self, after: int, upto: int) -> Iterator[dict]:
        for r in self._rows("deals.csv"):
            if after < int(r["deal_id"]) <= upto:
                yield r

    def _rows(self, name: str) -> list[dict]:
        try:
            with (self.root / name).open(newline="") as f:
                return list(csv.DictReader(f))
        except FileNotFoundError:
            return []


def feed_of(options: dict) -> object:
    module, _, name = options.get("feed", "quantloom.sources.broker:FolderFeed").partition(":")
    return getattr(import_module(module), name)(options)


def server_time(at: datetime, zone: str) -> datetime:
    """UTC (with or without zone) as the broker's wall time."""
    return at.replace(tzinfo=at.tzinfo or UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None)


def utc(text: str, zone: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone)).astimezone(UTC)


class Slice(InputPartition):
    """A request: a symbol between two UTC times, or (without them) its latest bars."""

    def __init__(self, symbol: str, start: datetime | None = None, end: datetime | None = None):
        self.symbol, self.start, self.end = symbol, start, end


class Candles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "broker_candles"

    def schema(self) -> str:
        return CANDLES

    def reader(self, schema: object) -> DataSourceReader:
        return CandleReader(dict(self.options))


class CandleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.symbols = [s for s in options["symbols"].split(",") if s]
        self.tf, self.zone = options.get("tf", "M1"), options.get("zone", "EET")
        self.start = self.end = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Symbols narrow the requests exactly; times do so by slices, and Spark looks at the edges again."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "symbol" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = [s for s in self.symbols if s in wanted]
                continue
            if column == "ts" and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)):
                at = f.value.replace(tzinfo=None) if f.value.tzinfo is None else f.value.astimezone(UTC).replace(tzinfo=None)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.start = max(self.start or at, at)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    upto = at + timedelta(seconds=1)
                    self.end = min(self.end or upto, upto)
            yield f

    def partitions(self) -> list[Slice]:
        if self.start is None and self.end is None and "latest" in self.options:
            return [Slice(s) for s in self.symbols]
        start, end = self.start, self.end or datetime.now(UTC).replace(tzinfo=None) + timedelta(days=1)
        if start is None:
            return [Slice(s, FIRST, end) for s in self.symbols]
        days = timedelta(days=int(self.options.get("slice_days", SLICE_DAYS)))
        edges = []
        while start < end:
            edges.append((start, min(start + days, end)))
            start += days
        return [Slice(s, a, b) for s in self.symbols for a, b in edges] or [Slice("", FIRST, FIRST)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        feed = feed_of(self.options)
        if partition.start is None:
            rows = feed.latest(partition.symbol, self.tf, int(self.options["latest"]))
        else:
            rows = feed.candles(partition.symbol, self.tf, server_time(partition.start, self.zone), server_time(partition.end, self.zone))
        for r in rows:
            yield (partition.symbol, self.tf, utc(r["ts"], self.zone), float(r["open"]), float(r["high"]), float(r["low"]), float(r["close"]), int(r["volume"]), int(r["spread_points"]))


class Deals(DataSource):
    @classmethod
    def name(cls) -> str:
        return "broker_deals"

    def schema(self) -> str:
        return DEALS

    def reader(self, schema: object) -> DataSourceReader:
        return DealReader(dict(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return DealStream(dict(self.options))


class Numbers(InputPartition):
    """Deals after one number up to another."""

    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


def _numbers(after: int, upto: int, options: dict) -> list[Numbers]:
    size = int(options.get("slice_deals", 100_000))
    return [Numbers(a, min(a + size, upto)) for a in range(after, upto, size)] or [Numbers(after, after)]


def _read_deals(options: dict, p: Numbers) -> Iterator[tuple]:
    zone = options.get("zone", "EET")
    for r in feed_of(options).deals(p.after, p.upto):
        yield (
            r["symbol"], int(r["position_id"]), int(r["deal_id"]), utc(r["ts"], zone), int(r["type"]), float(r["price"]), float(r["volume"]), float(r["profit"] or 0),
            float(r["commission"] or 0), float(r["swap"] or 0), r["comment"], int(r["magic"] or 0),
        )


class DealReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Numbers]:
        return _numbers(0, feed_of(self.options).last_deal(), self.options)

    def read(self, partition: Numbers) -> Iterator[tuple]:
        return _read_deals(self.options, partition)


class DealStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"deal": int(self.options.get("after", 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"deal": feed_of(self.options).last_deal()}

    def partitions(self, start: dict, end: dict) -> list[Numbers]:
        return _numbers(start["deal"], end["deal"], self.options)

    def read(self, partition: Numbers) -> Iterator[tuple]:
        return _read_deals(self.options, partition)


def register(spark: SparkSession) -> None:
    """Make the sources known, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Candles)
    spark.dataSource.register(Deals)
