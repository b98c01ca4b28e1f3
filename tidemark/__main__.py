"""Command line: load raw files into tables, then run and show the queries.

  python -m tidemark load --rentals DIR --weather DIR --oil FILE --gas FILE --out DIR
         [--encoding UTF-8] [--gas-encoding MS949] [--precip-mode increment|cumulative]
         [--rentals-columns a,b,c ...] [--oil-format yyyyMMdd ...]
  python -m tidemark run --tables DIR [1-A 1-B 2-A 2-B] [--out DIR] [--weather-station 133]
         [--set crude=brent --set horizon_days=30 ...]
  python -m tidemark sql --tables DIR "SELECT count(*) FROM rental"

A load may be repeated, and a further period adds to the tables. ``--set`` gives a
parameter to each named query that takes it.

On a cluster, launch it with spark-submit; the master comes from the launcher.
"""

from __future__ import annotations

import argparse
import inspect
import json
import sys

from tidemark.session import build_session

SOURCES = ("rentals", "weather", "oil", "gas")


def show(df) -> None:
    """Print every row, tab separated, fetched one partition at a time."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("NULL" if v is None else str(v) for v in row))


def _params(items) -> dict:
    """key=value pairs; a value that is JSON (a number, true, null) is read as such."""
    out = {}
    for item in items:
        k, eq, v = item.partition("=")
        if not eq:
            raise SystemExit(f"--set {item}: expected key=value")
        try:
            out[k] = json.loads(v)
        except ValueError:
            out[k] = v
    return out


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="cmd", required=True)
    ld = sub.add_parser("load")
    for a in ("rentals", "weather", "oil", "gas", "out"):
        ld.add_argument(f"--{a}", required=True)
    ld.add_argument("--encoding", default="UTF-8")
    for a in SOURCES:
        ld.add_argument(f"--{a}-encoding")
        ld.add_argument(f"--{a}-columns", help="column names in file order, comma separated")
        ld.add_argument(f"--{a}-format", help="form of its time or date, e.g. 'yyyy-MM-dd HH:mm'")
    ld.add_argument("--timestamp-format", help="for rentals and weather alike")
    ld.add_argument("--feel", default="max", choices=["max", "mean"])
    ld.add_argument("--precip-mode", default="increment", choices=["increment", "cumulative"])
    ld.add_argument("--weather-station")
    ld.add_argument("--expect-published", action="store_true",
                    help="reconcile row counts with the counts the reference publishes")
    rn = sub.add_parser("run")
    rn.add_argument("--tables", required=True)
    rn.add_argument("queries", nargs="*", default=["1-A", "1-B", "2-A", "2-B"])
    rn.add_argument("--out", help="write each result as Parquet under this folder")
    rn.add_argument("--weather-station", help="needed where several stations are stored")
    rn.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", dest="params")
    sq = sub.add_parser("sql")
    sq.add_argument("--tables", required=True)
    sq.add_argument("statement")
    p.add_argument("--master", default=None)
    args = p.parse_args(argv)

    spark = build_session(args.master)
    if args.cmd == "load":
        from tidemark.plans.load import load
        from tidemark.schemas import PUBLISHED_COUNTS

        def per_source(what):
            return {k: getattr(args, f"{k}_{what}") for k in SOURCES if getattr(args, f"{k}_{what}")}

        _, checks = load(spark, args.rentals, args.weather, args.oil, args.gas, args.out,
                         expected=PUBLISHED_COUNTS if args.expect_published else None,
                         encoding=args.encoding, encodings=per_source("encoding"),
                         columns={k: v.split(",") for k, v in per_source("columns").items()},
                         formats=per_source("format"), precip_mode=args.precip_mode,
                         feel=args.feel, weather_station=args.weather_station,
                         timestamp_format=args.timestamp_format)
        for name, df in checks.items():
            print(f"== check {name}")
            show(df)
    elif args.cmd == "sql":
        from tidemark.sources.sinks import ParquetTables
        ParquetTables(spark, args.tables).create_views()
        show(spark.sql(args.statement))
    else:
        from tidemark.plans.runner import QUERIES, run
        from tidemark.sources.sinks import ParquetTables
        t = ParquetTables(spark, args.tables, args.weather_station)
        params = _params(args.params)
        takes = {q: [k for k in params if k in list(inspect.signature(QUERIES[q]).parameters)[2:]]
                 for q in args.queries}
        unused = set(params) - {k for ks in takes.values() for k in ks}
        if unused:
            raise SystemExit(f"no query named takes {', '.join(sorted(unused))}")
        for q in args.queries:
            df = run(spark, q, t, **{k: params[k] for k in takes[q]})
            if args.out:
                path = f"{args.out.rstrip('/')}/{q}"
                df.write.mode("overwrite").parquet(path)
                df = spark.read.parquet(path)
            print(f"== {q}")
            show(df)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
