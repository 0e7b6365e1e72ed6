"""A Python data source for yearly price files: ``spark.read.format("yearly_prices")``.

A real provider sits behind ``fetch``; here it is a folder of CSV files <pair>_<year>.csv
(ts, bid, ask).  Years are those from ``first`` to ``last`` of ``pairs``, or a list ``years`` of pair:year.  Each (pair, year)
is one partition, so years load in parallel and a lost one is fetched again.
"""

from __future__ import annotations

import csv
import time
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIES, PAUSE = 7, 1.0


class YearPartition(InputPartition):
    def __init__(self, pair: str, year: int):
        self.pair, self.year = pair, year


class YearlyPrices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "yearly_prices"

    def schema(self) -> str:
        return "pair string, ts timestamp, bid double, ask double"

    def reader(self, schema) -> DataSourceReader:
        return YearlyReader(self.options)


class YearlyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        if "years" in options:
            self.years = [(p, int(y)) for p, y in (x.split(":") for x in options["years"].split(","))]
        else:
            self.years = [(p, y) for p in options["pairs"].split(",") for y in range(int(options["first"]), int(options["last"]) + 1)]
        self.pause = float(options.get("pause", PAUSE))

    def partitions(self) -> list[YearPartition]:
        return [YearPartition(p, y) for p, y in self.years]

    def read(self, partition: YearPartition) -> Iterator[tuple]:
        """Rows of a year; none where there is no file; reading is tried again a few times."""
        for left in reversed(range(RETRIES)):
            try:
                rows = self._fetch(partition)
                break
            except FileNotFoundError:
                return
            except OSError:
                if not left:
                    raise
                time.sleep(self.pause)
        yield from rows

    def _fetch(self, p: YearPartition) -> list[tuple]:
        with Path(self.root, f"{p.pair}_{p.year}.csv").open(newline="") as f:
            return [(p.pair, datetime.fromisoformat(r["ts"]), float(r["bid"]), float(r["ask"]) if r["ask"] else None) for r in csv.DictReader(f)]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(YearlyPrices)
