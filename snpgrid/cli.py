"""Command line: ``python -m snpgrid.cli COMMAND --option value ...``; options are the fields of the plans' configurations."""

from __future__ import annotations

import argparse
import sys
import typing
from dataclasses import MISSING, fields

from pyspark.sql import SparkSession

from .plans import workflow

COMMANDS = {
    "create": (workflow.Create, workflow.create), "genotype": (workflow.Genotype, workflow.genotype),
    "benchmark": (workflow.Benchmark, workflow.benchmark), "namer": (workflow.Namer, workflow.namer),
}
VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="snpgrid")
    top.add_argument("-V", "--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command", required=True)
    for name, (config, _) in COMMANDS.items():
        sub = commands.add_parser(name)
        kinds = typing.get_type_hints(config)
        for f in fields(config):
            kind = next((t for t in typing.get_args(kinds[f.name]) if t is not type(None)), kinds[f.name])
            if kind is bool:
                sub.add_argument(f"--{f.name}", action="store_true")
            else:
                sub.add_argument(f"--{f.name}", type=kind, required=f.default is MISSING, default=None if f.default is MISSING else f.default)
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    config, run = COMMANDS[args.pop("command")]
    run(SparkSession.builder.appName("snpgrid").getOrCreate(), config(**args))
    return 0


if __name__ == "__main__":
    sys.exit(main())
