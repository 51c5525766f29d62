"""Command line: list the queries, explain one, or run one into a folder.

    python -m voxfield.cli list
    python -m voxfield.cli explain weekly_trend --data /data/sf0.01
    python -m voxfield.cli run weekly_trend --data /data/sf0.01 --out /data/out --format csv
    python -m voxfield.cli doctor --data /data/sf0.01
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from voxfield.plans.registry import ORACLES, QUERIES


def doctor(spark: SparkSession, data: str) -> list[tuple[str, bool, str]]:
    """Whether each table can be read, and how many columns it has."""
    out = []
    for name in ("documents", "embeddings", "events", "pages", "conversations", "labels", "benchmark"):
        try:
            out.append((name, True, f"{len(spark.read.parquet(f'{data}/{name}.parquet').columns)} columns"))
        except Exception as e:  # each table is reported on its own
            out.append((name, False, str(e).splitlines()[0]))
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="voxfield", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["list", "explain", "run", "doctor"])
    parser.add_argument("query", nargs="?")
    parser.add_argument("--data", default=".")
    parser.add_argument("--out")
    parser.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    a = parser.parse_args(args)
    if a.command == "list":
        print("\n".join(f"{n}{' (with SQL)' if n in ORACLES else ''}" for n in sorted(QUERIES)))
        return 0
    spark = spark or SparkSession.builder.appName("voxfield").getOrCreate()
    if a.command == "doctor":
        found = doctor(spark, a.data)
        print("\n".join(f"{'ok  ' if ok else 'FAIL'} {n}: {what}" for n, ok, what in found))
        return int(not all(ok for _, ok, _ in found))
    if a.query not in QUERIES:
        print(f"no query named {a.query}", file=sys.stderr)
        return 2
    rows = QUERIES[a.query](spark, a.data)
    if a.command == "explain":
        rows.explain("formatted")
    elif a.out:
        rows.write.mode("overwrite").option("header", True).format(a.format).save(a.out)
    else:
        rows.show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
