"""python -m lodespark generate|analyze|optimize|benchmark|check|verify|publish ROOT OUTPUT [--option value ...]"""

from __future__ import annotations

import argparse
import shutil
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from .engine import Engine, GateFailed
from .options import Options

COMMANDS = {"generate": "generate", "analyze": "analyze", "optimize": "optimize", "benchmark": "benchmarked", "check": "check", "verify": "verify"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodespark", description="Knowledge analytics over a source-code repository.")
    p.add_argument("command", choices=[*COMMANDS, "publish"])
    p.add_argument("root")
    p.add_argument("output")
    p.add_argument("--to", help="publish: the folder that the output is copied to")
    for f in fields(Options):
        if f.name not in ("root", "output"):
            name = "--" + f.name.replace("_", "-")
            if f.type == "bool":
                p.add_argument(name, action="store_true")
            else:
                p.add_argument(name, default=f.default, type=float if "float" in f.type else int if "int" in f.type else str)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(parser().parse_args(args))
    command, to = given.pop("command"), given.pop("to")
    options = Options(**given)
    if command == "publish":
        if not to:
            print("publish needs --to", file=sys.stderr)
            return 2
        shutil.copytree(options.output, to, dirs_exist_ok=True)
        return 0
    try:
        getattr(Engine(spark or SparkSession.builder.getOrCreate(), options), COMMANDS[command])()
    except GateFailed as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
