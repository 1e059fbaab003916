"""Command line: ``python -m graphloom.cli -d GRAPH -q QUERY -t THRESHOLD``."""
from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .deadline import within
from .plans.config import VARIANTS, MatchConfig
from .plans.match import match
from .report import run_match
from .sources.graph_text import read_graph, read_query
from .streaming.progress import reached


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Count or write the mappings of a query graph with at most so many missing edges.")
    p.add_argument("-d", "--data", required=True, help="graph text file")
    p.add_argument("-q", "--query", required=True, help="query graph text file")
    p.add_argument("-t", "--threshold", required=True, type=int, help="edges that may be missing")
    p.add_argument("-a", "--algorithm", default="afe", choices=sorted(VARIANTS), help="variant")
    p.add_argument("--limit", type=int, default=None, help="mappings to stop at")
    p.add_argument("--timeout", type=float, default=None, help="seconds for matching")
    p.add_argument("--load-timeout", type=float, default=None, help="seconds for loading")
    p.add_argument("-o", "--output", default=None, help="write the mappings to this folder as Parquet")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: bad input; 124: out of time.  argparse itself ends with 2 on unknown or missing options."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        if args.threshold < 0:
            raise ValueError("the threshold is negative")
        base = VARIANTS[args.algorithm]
        config = MatchConfig(**{**base.__dict__, "limit": args.limit})
        began = time.perf_counter()
        q, g = within(spark, args.load_timeout, "load", lambda: (read_query(spark, args.query), read_graph(spark, args.data)))
        load_ms = (time.perf_counter() - began) * 1000
        print(f"READY\talgorithm={args.algorithm}\tload_ms={load_ms:.3f}", flush=True)
        report = within(spark, args.timeout, "match", lambda: run_match(g, q, args.threshold, config, args.algorithm, load_ms))
        for c in reached(report.count):
            print(f"CHECKPOINT\tmappings={c}")
        print(report.line())
        if args.output:
            match(g, q, args.threshold, config).write.mode("overwrite").parquet(args.output)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except TimeoutError as e:
        print(f"timeout: {e}", file=sys.stderr)
        return 124
    return 0


if __name__ == "__main__":
    sys.exit(main())
