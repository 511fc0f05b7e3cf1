"""python -m curvemill list | run NAME... --data DIR [--out DIR] [--format parquet|csv|json]: the registered curve queries."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.queries import oracle_sql, queries


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="curvemill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries; * has an SQL form")
    run = commands.add_parser("run", help="run queries over a folder of Parquet tables")
    run.add_argument("names", nargs="+", choices=sorted(queries()), metavar="NAME")
    run.add_argument("--data", required=True)
    run.add_argument("--out", help="a folder that must not hold the results yet; without it the first rows are shown")
    run.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    got = parser.parse_args(args)
    if got.command == "list":
        print("\n".join(f"{name}{' *' if name in oracle_sql() else ''}" for name in sorted(queries())))
        return 0
    spark = SparkSession.builder.appName("curvemill").getOrCreate()
    for name in got.names:
        df = queries()[name](spark, got.data)
        if got.out:
            df.write.mode("errorifexists").format(got.format).options(header=True).save(f"{got.out}/{name}")
        else:
            print(name)
            df.show(20, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
