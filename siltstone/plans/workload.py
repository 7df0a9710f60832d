"""Workloads by selectivity and the benchmark command: ``python -m siltstone.plans.workload -p FOLDER ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from siltstone.plans.parser import parse_query
from siltstone.plans.query import run
from siltstone.sources import scan

#: The share of blocks, in per cent, that a named workload's threshold lets through.
WORKLOADS = {"best-case": 0, "real": 1, "quarter": 25, "half": 50, "3-quarter": 75, "worst-case": 99}


def read_thresholds(text: str) -> dict[int, int]:
    """Lines of ``pct threshold``."""
    return {int(a): int(b) for a, b in (line.split() for line in text.splitlines() if line.strip())}


def filter_of(workload: str, column: str, thresholds: dict[int, int]) -> str:
    return f"{column} > {thresholds[WORKLOADS[workload]]}"


def benchmark(spark: SparkSession, folder: str, mode: str, filter: str, select: str = "", aggregates: str = "", limit_files: int | None = None) -> dict:
    """Run one query over a folder's files and report what it took, over the files that were there."""
    source = scan.parquet(spark, folder, limit_files)
    files = len(source.inputFiles())
    out = run(source, parse_query(filter, select, aggregates), mode)
    m = scan.measured(out.aggregates if out.aggregates is not None and out.aggregates.columns else out.rows)
    return {"mode": mode, "filter": filter, "files": files, "seconds": m.seconds, "rows_read": m.rows_read, "bytes_read": m.bytes_read, "mb_per_s": m.bytes_read / 1e6 / m.seconds, "queries_per_s": files / m.seconds}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-p", "--path", required=True)
    p.add_argument("-m", "--mode", choices=("group", "row", "column", "aggr"), default="column")
    p.add_argument("-w", "--workload", choices=sorted(WORKLOADS), default="half")
    p.add_argument("-c", "--count", type=int, default=10_000, help="files at most")
    p.add_argument("--column", required=True)
    p.add_argument("--thresholds", required=True, help="file with lines of 'pct threshold'")
    p.add_argument("--aggregates", default="")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("siltstone").config("spark.hadoop.parquet.hadoop.vectored.io.enabled", "false").getOrCreate()
    with open(a.thresholds) as f:
        chosen = filter_of(a.workload, a.column, read_thresholds(f.read()))
    print(json.dumps(benchmark(spark, a.path, a.mode, chosen, a.column, a.aggregates, a.count)))


if __name__ == "__main__":
    main()
