"""Command line: run named queries, compare two tables, write the category report.

    python -m verisieve list
    python -m verisieve query auroc_by_lang --root DIR --out DIR
    python -m verisieve validate LEFT RIGHT --key pair,method --value auroc [--tolerance 0.0005]
    python -m verisieve categories --root DIR --out DIR [--source NAME ...] [--pairs fr,de]

``validate`` ends with status 1 where the tables differ. Tables are Parquet folders, or CSV where the
path ends in .csv.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, path: str, value: str) -> DataFrame:
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.parquet(path)
    from pyspark.sql import functions as F

    from verisieve.sources.readers import read_csv

    rows = read_csv(spark, path)
    return rows.withColumn(value, F.col(value).try_cast("double"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="verisieve")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    one = commands.add_parser("query")
    one.add_argument("name")
    compare = commands.add_parser("validate")
    compare.add_argument("left")
    compare.add_argument("right")
    compare.add_argument("--key", required=True)
    compare.add_argument("--value", required=True)
    compare.add_argument("--tolerance", type=float, default=5e-4)
    report = commands.add_parser("categories")
    report.add_argument("--source", action="append")
    report.add_argument("--pairs", default="")
    for p in (one, report):
        p.add_argument("--root", required=True)
        p.add_argument("--out", required=True)
    given = parser.parse_args(argv)

    from verisieve.plans import catalogue, registry, report_queries  # noqa: F401
    from verisieve.session import build_session

    if given.command == "list":
        print("\n".join(registry.QUERIES))
        return 0
    if given.command == "query" and given.name not in registry.QUERIES:
        parser.error(f"no query {given.name}")
    spark = SparkSession.getActiveSession() or build_session("verisieve")
    if given.command == "query":
        registry.QUERIES[given.name](spark, given.root).write.mode("overwrite").parquet(given.out)
    elif given.command == "categories":
        from verisieve.operators import reports

        print(reports.category_job(spark, report_queries.SOURCES, given.root, given.out, [p for p in given.pairs.split(",") if p], given.source))
    else:
        from verisieve.operators import relational as rel

        told = rel.compare_tables(*(_table(spark, p, given.value) for p in (given.left, given.right)), given.key.split(","), given.value, given.tolerance)
        verdict = rel.validation(told).first()
        print(f"rows {verdict.n}, differing {verdict.differing}: {'PASS' if verdict.passed else 'FAIL'}")
        return 0 if verdict.passed else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
