"""Command line: ``python -m quantloom.cli info|status|build|validate``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quantloom")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("info")
    for name in ("status", "build", "validate"):
        p = sub.add_parser(name)
        p.add_argument("root")
        if name == "build":
            p.add_argument("--timeframes", default="M5,M15,M30,H1,H4,D,W")
        if name == "validate":
            p.add_argument("--timeframe", default="M1")
            p.add_argument("--from-year", type=int, default=2005)
            p.add_argument("--year", type=int, required=True)
    args = parser.parse_args(argv)
    from quantloom import __version__, strategy
    from quantloom.operators import bars, quality
    from quantloom.sources import store

    if args.command == "info":
        print(f"quantloom {__version__}; strategies: {', '.join(strategy.names())}")
        return 0
    spark = SparkSession.builder.getOrCreate()
    table = store.read_bars(spark, args.root)
    if args.command == "status":
        bars.catalogue_status(table, ("pair", "tf")).show(truncate=False)
    elif args.command == "build":
        base = table.where("tf = 'M1'").drop("tf")
        store.write_bars(bars.resample_all(base, args.timeframes.split(",")), args.root, overwrite=True)
    else:
        one = table.where(table["tf"] == args.timeframe)
        quality.report(one, args.timeframe, args.from_year, args.year).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
