"""Reading and writing of bars, audits and checkpoints."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.operators.bars import missing_years


def read_bars(spark: SparkSession, root: str, pair: str | None = None, timeframe: str | None = None, ignore_corrupt: bool = False) -> DataFrame:
    """Bars below ``root``, partitioned by pair and tf; both prune folders."""
    df = spark.read.option("ignoreCorruptFiles", ignore_corrupt).parquet(root)
    for name, value in (("pair", pair), ("tf", timeframe)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def write_bars(bars: DataFrame, root: str, by: tuple[str, ...] = ("pair", "tf"), overwrite: bool = False) -> None:
    """Append bars, or replace exactly the partitions that the bars cover."""
    out = bars.write.partitionBy(*by)
    if overwrite:
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)
    else:
        out.mode("append").parquet(root)


def _folder(spark: SparkSession, path: str) -> tuple[object, object]:
    """The file system of a path, whatever its scheme, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _parts(fs: object, path: object, name: str) -> list[tuple[str, object]]:
    """(value, path) of the folders name=value below a path."""
    if not fs.exists(path):
        return []
    found = [x.getPath() for x in fs.listStatus(path) if x.isDirectory()]
    return sorted((p.getName().split("=", 1)[1], p) for p in found if p.getName().startswith(f"{name}="))


def years_present(spark: SparkSession, root: str) -> DataFrame:
    """(pair, year) by the folder names of a table partitioned by pair and year; no file is opened."""
    fs, top = _folder(spark, root)
    rows = [(pair, int(year)) for pair, p in _parts(fs, top, "pair") for year, _ in _parts(fs, p, "year")]
    return spark.createDataFrame(rows, "pair string, year int")


def write_years(bars: DataFrame, root: str) -> list[tuple[str, int]]:
    """Write bars (pair, year, ...) so that each year is there whole or not at all; the years written.

    All years are written to a folder of their own below ``root``, which readers of the table don't see; each then takes its place by
    one renaming.  A job that is lost before leaves old years as they were.
    """
    spark = bars.sparkSession
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    fs, place = _folder(spark, staged)
    try:
        bars.write.partitionBy("pair", "year").option("compression", "snappy").parquet(staged)
        done = []
        for pair, p in _parts(fs, place, "pair"):
            for year, new in _parts(fs, p, "year"):
                _, target = _folder(spark, f"{root}/pair={pair}/year={year}")
                fs.mkdirs(target.getParent())
                _, old = _folder(spark, f"{staged}/old-{pair}-{year}")
                if fs.exists(target):
                    fs.rename(target, old)
                if not fs.rename(new, target):
                    fs.rename(old, target)
                    raise OSError(f"{pair} {year} could not take its place")
                done.append((pair, int(year)))
        return done
    finally:
        fs.delete(place, True)


def download(spark: SparkSession, source: str, root: str, pairs: list[str], first: int, now: datetime, force: bool = False, **options: object) -> list[tuple[str, int]]:
    """Fetch the years of pairs that aren't there, and the current one, from a ``yearly_prices`` source; the years written.

    Years to come are left out, and the current one ends now.  spread is ask less bid, null without an ask.  A run that was cut
    short goes on with what is missing.
    """
    wanted = spark.range(first, now.year + 1).select(F.col("id").cast("int").alias("year")).crossJoin(F.broadcast(spark.createDataFrame([(p,) for p in pairs], "pair string")))  # a row for each year and pair
    todo = sorted((r["pair"], r["year"]) for r in missing_years(wanted.select("pair", "year"), years_present(spark, root), now.year, force).collect())
    if not todo:
        return []
    chosen = ",".join(f"{p}:{y}" for p, y in todo)
    rows = spark.read.format("yearly_prices").options(path=source, years=chosen, **options).load().where(F.col("ts") <= F.lit(now))
    return write_years(rows.select("*", (F.col("ask") - F.col("bid")).alias("spread"), F.year("ts").alias("year")), root)


AUDIT = "kind string, seq long, ticket long, ts timestamp_ntz, price double, reason string"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events from JSON lines; lines that don't parse go."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_checkpoint(rows: DataFrame, path: str) -> None:
    """One JSON document per row, nested as the schema is."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def read_checkpoint(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("x")).select("x.*")


def best_runs(candidates: DataFrame) -> DataFrame:
    """The best candidate that wasn't eliminated of each run."""
    return candidates.where("not eliminated").groupBy("run").agg(F.max_by("candidate", F.struct("composite", F.negative("candidate"))).alias("candidate"), F.max("composite").alias("composite"))
