"""Candles and deals of a broker, and yearly chunks that are written whole or not at all."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quantloom.operators import verification as VE
from quantloom.sources import broker, store, ticks

HEAD = "ts,open,high,low,close,volume,spread_points\n"
DEALS = "symbol,position_id,deal_id,ts,type,price,volume,profit,commission,swap,comment,magic\n"


@pytest.fixture()
def folder(tmp_path):
    for symbol in ("EURUSD", "GBPUSD"):
        rows = [f"2024-{m:02d}-{d:02d}T{h:02d}:00:00,1,2,0.5,1.5,{h},3" for m in range(1, 7) for d in (1, 15, 28) for h in (0, 12, 23)]
        (tmp_path / f"candles_{symbol}_H1.csv").write_text(HEAD + "\n".join(rows) + "\n")
    (tmp_path / "deals.csv").write_text(DEALS + "\n".join([
        "EURUSD,7,1,2024-03-01T10:00:00,0,1.1,0.5,0,-1,0,,9", "EURUSD,0,2,2024-03-01T10:05:00,0,1.1,0.5,0,0,0,,9", "EURUSD,8,3,2024-03-01T11:00:00,1,1.2,0.1,0,0,0,,9",
        "EURUSD,7,4,2024-03-01T12:00:00,1,1.104,0.5,200,-1,-0.5,[tp 1.104],9", "GBPUSD,9,5,2024-07-01T12:00:00,1,1.3,1,0,0,0,,9",
    ]) + "\n")
    return tmp_path


def test_candles_are_asked_for_by_symbol_and_time(spark, folder):
    broker.register(spark)
    df = spark.read.format("broker_candles").options(path=str(folder), symbols="EURUSD,GBPUSD", tf="H1", slice_days=10).load()
    assert df.count() == 2 * 54
    few = df.where((F.col("symbol") == "EURUSD") & (F.col("ts") >= "2024-03-01") & (F.col("ts") < "2024-03-29"))
    assert few.rdd.getNumPartitions() == 3  # 28 days in slices of 10, one symbol
    got = [r["ts"] for r in few.orderBy("ts").collect()]
    zone = lambda month: 2 if month < 4 else 3
    want = sorted(datetime(2024, m, d, h) for m in range(1, 7) for d in (1, 15, 28) for h in (0, 12, 23))
    assert len(got) == 8 and got == [x for x in (w.replace(hour=0) + (w - w.replace(hour=0)) - __import__("datetime").timedelta(hours=zone(w.month)) for w in want) if datetime(2024, 3, 1) <= x < datetime(2024, 3, 29)]
    assert df.where("symbol = 'GBPUSD' and ts >= '2024-06-28 09:00:00' and ts <= '2024-06-28 09:00:00'").count() == 1
    assert df.where("symbol = 'XAUUSD' and ts > '2024-06-01' and ts < '2024-05-01'").count() == 0
    newest = spark.read.format("broker_candles").options(path=str(folder), symbols="EURUSD,NONE", tf="H1", latest=4).load()
    assert newest.rdd.getNumPartitions() == 2 and [r["volume"] for r in newest.orderBy("ts").collect()] == [23, 0, 12, 23]


def test_deals_as_table_and_stream(spark, folder):
    broker.register(spark)
    deals = spark.read.format("broker_deals").options(path=str(folder), slice_deals=2).load()
    assert deals.count() == 5 and deals.rdd.getNumPartitions() == 3
    trade = VE.live_trades(deals, 0.0001).collect()
    assert len(trade) == 1
    t = trade[0]
    assert (t["position_id"], t["direction"], t["exit_reason"], round(t["pnl_pips"], 6), t["commission"], t["swap"], t["profit"]) == (7, 1, "take_profit", 40.0, -2.0, -0.5, 200.0)
    assert t["entry_ts"] == datetime(2024, 3, 1, 8)
    assert VE.trades_from_deals(deals).count() == 1

    def run():
        stream = spark.readStream.format("broker_deals").option("path", str(folder)).load()
        q = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["deal_id"] for r in spark.read.parquet(str(folder / "out")).collect())

    assert run() == [1, 2, 3, 4, 5]
    with (folder / "deals.csv").open("a") as f:
        f.write("EURUSD,8,6,2024-07-02T11:00:00,0,1.1,0.1,5,0,0,sl,9\n")
    assert run() == [1, 2, 3, 4, 5, 6]


def test_reasons_of_deals(spark):
    said = ["[SL 1.1]", "stopped out", "[tp 2]", "profit", "close by hand", "", None]
    got = [r["x"] for r in spark.createDataFrame([(s,) for s in said], "s string").coalesce(1).select(VE.deal_reason(F.col("s")).alias("x")).collect()]
    assert got == ["stop_loss", "stop_loss", "take_profit", "take_profit", "manual", "unknown", "unknown"]


def test_years_are_fetched_once_and_written_whole(spark, tmp_path):
    ticks.register(spark)
    source, root = tmp_path / "csv", str(tmp_path / "bars")
    source.mkdir()
    for pair in ("EURUSD", "GBPUSD"):
        for year in (2022, 2023, 2024):
            (source / f"{pair}_{year}.csv").write_text("ts,bid,ask\n" + "".join(f"{year}-{m:02d}-02T00:00:00,1.1,{1.2 if m % 2 else ''}\n" for m in range(1, 13)))
    now = datetime(2024, 6, 30)
    every = [(p, y) for p in ("EURUSD", "GBPUSD") for y in (2022, 2023, 2024)]
    assert store.download(spark, str(source), root, ["EURUSD", "GBPUSD"], 2022, now) == every
    table = spark.read.parquet(root)
    assert table.count() == 2 * 30 and table.where("year = 2024").count() == 12 and table.where("spread is null").count() == 30
    assert {tuple(r) for r in store.years_present(spark, root).collect()} == set(every)
    assert store.download(spark, str(source), root, ["EURUSD", "GBPUSD"], 2022, now) == [("EURUSD", 2024), ("GBPUSD", 2024)]
    assert store.download(spark, str(source), root, ["EURUSD"], 2022, datetime(2024, 12, 31), force=True) == every[:3]
    assert spark.read.parquet(root).where("pair = 'EURUSD'").count() == 36

    bars = spark.createDataFrame([("EURUSD", 2021, 1.0), ("EURUSD", 2022, 2.0)], "pair string, year int, bid double")
    broken = bars.withColumn("bid", F.when(F.col("year") == 2022, F.raise_error(F.lit("lost"))).otherwise(F.col("bid")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.write_years(broken, root)
    assert ("EURUSD", 2021) not in {tuple(r) for r in store.years_present(spark, root).collect()}
    assert spark.read.parquet(root).where("pair = 'EURUSD'").count() == 36 and not [x for x in (tmp_path / "bars").iterdir() if x.name.startswith("_staged")]
    assert store.write_years(bars, root) == [("EURUSD", 2021), ("EURUSD", 2022)]
    assert spark.read.parquet(root).where("pair = 'EURUSD' and year = 2022").count() == 1
    assert store.years_present(spark, str(tmp_path / "none")).count() == 0
