"""Command line: ``run`` an experiment over CSV splits and ``evaluate`` a file of predictions."""

from __future__ import annotations

import argparse
import dataclasses
import json
import types
import typing

from pyspark.sql import SparkSession

from demosift.operators import metrics, model_calls
from demosift.plans import experiment
from demosift.sources import sinks, tables


def _options(parser: argparse.ArgumentParser) -> None:
    """An option for every setting of a run, of its own type."""
    hints = typing.get_type_hints(experiment.Settings)
    for f in dataclasses.fields(experiment.Settings):
        kind, name = hints[f.name], f"--{f.name}"
        default = f.default_factory() if f.default_factory is not dataclasses.MISSING else f.default
        if typing.get_origin(kind) in (types.UnionType, typing.Union):
            kind = next(k for k in typing.get_args(kind) if k is not type(None))
        if kind is bool:
            parser.add_argument(name, action=argparse.BooleanOptionalAction, default=default)
        elif typing.get_origin(kind) is list:
            parser.add_argument(name, nargs="+", type=typing.get_args(kind)[0], default=default)
        else:
            parser.add_argument(name, type=kind, default=default)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="demosift")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="retrieve, prompt, call and evaluate")
    run.add_argument("--data_dir", required=True)
    run.add_argument("--output_dir", required=True)
    run.add_argument("--base_url", required=True)
    run.add_argument("--vectors", help="a Parquet table text, embedding of the corpus' and the test rows' source texts")
    run.add_argument("--keys", default="", help="keys of the server, between commas")
    _options(run)
    evaluate = commands.add_parser("evaluate", help="metrics of a CSV file of predictions")
    evaluate.add_argument("--predictions", required=True)
    evaluate.add_argument("--summary", required=True)
    return out


def settings(args: argparse.Namespace) -> experiment.Settings:
    names = {f.name for f in dataclasses.fields(experiment.Settings)}
    return experiment.Settings(**{k: v for k, v in vars(args).items() if k in names}).validate()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("demosift").getOrCreate()
    if args.command == "evaluate":
        sinks.write_summary(metrics.evaluate(tables.read_predictions(spark, args.predictions)), args.summary)
        return
    from demosift.functions.text import parse_keys

    s = settings(args)
    train, test = (tables.read_split(spark, args.data_dir, split, s.na_values) for split in ("train", "test"))
    base, keys = args.base_url, parse_keys(args.keys)
    out = experiment.run(spark, train, test, s, args.output_dir, lambda: model_calls.http_pool(base, keys), experiment.text_vectors(spark.read.parquet(args.vectors)) if args.vectors else None)
    print(json.dumps([r.asDict() for r in out["summary"].collect()], ensure_ascii=False))


if __name__ == "__main__":
    main()
