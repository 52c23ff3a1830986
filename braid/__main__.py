"""``python -m braid``: run, look at, export and recheck searches over a generated or a stored table."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("braid").getOrCreate()


def _table(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, list[str]]:
    """(row_id, fold, y, inputs): the named Parquet table, or a generated one."""
    from .operators.ordered import random_folds
    from .sources import readers

    if args.table:
        df = spark.read.parquet(args.table)
        inputs = args.inputs.split(",")
        key = args.key
    else:
        df = readers.load(spark, {"adapter": "synthetic-tabular", "n_samples": args.rows, "n_features": 6, "seed": args.seed})
        inputs, key = [f"x{i}" for i in range(6)], "row_id"
    return random_folds(df.withColumnRenamed(args.target, "y") if args.table else df, key, args.folds, args.seed), inputs


def _score(args: argparse.Namespace):
    from .plans.evaluate import evaluate

    df, inputs = _table(_session(), args)
    df = df.select("y", F.col("fold").cast("int").alias("fold"), *inputs).persist()
    return lambda g: evaluate(g, df, {"x": inputs}, "y", "fold", metric=args.metric, most=args.configurations).score


def main(argv: list[str] | None = None) -> int:
    from .plans import evolve as V
    from .plans.graph import tabular_seed
    from .plans.maintain import BUILT_IN

    parser = argparse.ArgumentParser(prog="braid", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("demo", "evolve", "inspect", "export-best", "recheck"):
        p = commands.add_parser(name)
        p.add_argument("--folder", required=name != "demo")
        if name == "export-best":
            p.add_argument("--to", required=True)
        if name in ("demo", "evolve", "recheck"):
            p.add_argument("--table")
            p.add_argument("--inputs", default="")
            p.add_argument("--target", default="y")
            p.add_argument("--key", default="row_id")
            p.add_argument("--rows", type=int, default=200)
            p.add_argument("--folds", type=int, default=3)
            p.add_argument("--seed", type=int, default=0)
            p.add_argument("--metric", default="variance_explained")
            p.add_argument("--configurations", type=int, default=8)
        if name in ("demo", "evolve"):
            p.add_argument("--steps", type=int, default=2)
            p.add_argument("--seconds", type=float)
            p.add_argument("--strict", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "inspect":
        found = V.inspect(args.folder)
    elif args.command == "export-best":
        V.export_best(args.folder, args.to)
        found = {"written": args.to}
    elif args.command == "recheck":
        found = V.recheck(args.folder, _score(args))
    else:
        usable = [d for d in BUILT_IN if d["add"][0]["parents"] == ["x"]]
        run = V.evolve(tabular_seed(), _score(args), V.built_in(usable), args.steps, args.folder, strict=args.strict, guard=V.Guard(args.seconds))
        found = {"score": run.score, "steps": run.step, "version": run.version}
    print(json.dumps(found, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
