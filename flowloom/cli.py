"""Command line: join, split, condense, compress, repack, copy and verify stores (SNK-15 to SNK-20, SNK-22, SNK-26)."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from flowloom.operators import etl, quality
from flowloom.sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flowloom", description=__doc__)
    sub = p.add_subparsers(dest="task", required=True)
    a = sub.add_parser("join", help="concatenate measurements in the order of their starts")
    a.add_argument("inputs", nargs="+")
    a.add_argument("-o", "--output", required=True)
    a = sub.add_parser("split", help="split into chunks of consecutive events")
    a.add_argument("path_in")
    a.add_argument("--path_out", default=None)
    a.add_argument("--split-events", type=int, default=10_000)
    a.add_argument("--include-empty-boundary-images", action="store_true")
    a = sub.add_parser("condense", help="keep scalar features only, derived ones included")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--no-ancillary-features", action="store_true")
    a.add_argument("--no-basin-features", action="store_true")
    a = sub.add_parser("compress", help="write anew with zstandard")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--force", action="store_true")
    a = sub.add_parser("repack", help="write anew, optionally without basins or logs")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--strip-basins", action="store_true")
    a.add_argument("--strip-logs", action="store_true")
    a = sub.add_parser("verify", help="report on quality; exit code 0 fine, 1 alerts, 2 violations, 3 both, 4 error")
    a.add_argument("path")
    return p


def job_log(task: str, args: argparse.Namespace) -> list[str]:
    """What was done with which options, as a log of the result."""
    return json.dumps({"task": task, "options": {k: v for k, v in vars(args).items() if k != "task"}}, sort_keys=True, indent=2).splitlines()


def run(spark: SparkSession, argv: Sequence[str]) -> int:
    args = parser().parse_args(list(argv))
    log = job_log(args.task, args)
    if args.task == "join":
        out = etl.concatenate([store.read_store(spark, p) for p in args.inputs])
        store.write_store(replace(out, logs=out.logs | {"flowloom-join": log}), args.output, gated=False)
    elif args.task == "split":
        f = store.read_store(spark, args.path_in)
        df = f.df
        if not args.include_empty_boundary_images and "image" in df.columns:
            from flowloom.operators.gates import drop_empty_boundary_images

            df = drop_empty_boundary_images(df)
        parts = etl.split(df, args.split_events)
        n = (parts.agg(F.max("part")).first()[0] or 0) + 1
        target = args.path_out or args.path_in.rstrip("/") + "_split"
        sample = f.meta.get("experiment", "sample", "measurement")
        for k in range(n):
            one = parts.where(F.col("part") == k).drop("part", "event_idx").withColumnRenamed("part_idx", "event_idx")
            meta = f.meta.copy().set("experiment", "sample", f"{sample} {k + 1}/{n}")
            store.write_store(replace(f, df=one, meta=meta, logs=f.logs | {"flowloom-split": log}), f"{target}/{k + 1:04d}", gated=False)
    elif args.task == "condense":
        f = etl.condense(store.read_store(spark, args.input), not args.no_ancillary_features, not args.no_basin_features)
        store.write_store(replace(f, logs=f.logs | {"flowloom-condense": log}), args.output, gated=False)
    elif args.task == "compress":
        store.copy_store(spark, args.input, args.output)
    elif args.task == "repack":
        store.copy_store(spark, args.input, args.output, logs=not args.strip_logs, basins=not args.strip_basins)
    else:
        try:
            f = store.read_store(spark, args.path)
            cues = quality.check(f.df, f.meta, f.logs)
            for r in cues.orderBy("level", "category", "msg").collect():
                print(f"{r.level}: {r.category}: {r.msg}")
            return quality.exit_code(cues)
        except Exception as e:  # the exit code tells callers that nothing could be checked
            print(f"error: {e}", file=sys.stderr)
            return 4
    return 0


def main() -> int:
    return run(SparkSession.builder.appName("flowloom").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
