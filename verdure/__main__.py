"""Command line: python -m verdure COMMAND --units TABLE --obs TABLE --out FOLDER [options].

``ask REQUEST`` and ``chat`` hand requests in plain language to a model behind a
chat-completions address, which calls the same abilities as tools.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys

from pyspark.sql import SparkSession

from verdure import search
from verdure.agent import Agent
from verdure.backends import make_backend
from verdure.config import Settings
from verdure.plans.runner import Runner
from verdure.store import make_store
from verdure.tools import ToolRunner, console_confirm, public

COMMANDS = ("settings", "areas", "plan", "periodic", "recent", "check", "mosaic", "outputs", "ask", "chat")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verdure", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("request", nargs="?", help="ask: what to do, in plain language")
    p.add_argument("--config", help="JSON file with settings; options come before it")
    p.add_argument("--units", help="parquet table (name, region, planting_month_raw)")
    p.add_argument("--obs", help="parquet table (unit, row, col, ts, ndvi)")
    p.add_argument("--out", default="outputs")
    for name in ("level", "as-of", "kind", "region", "contains"):
        p.add_argument(f"--{name}")
    for name in ("names", "only", "periods"):
        p.add_argument(f"--{name}", nargs="*", default=[])
    p.add_argument("--bbox", nargs=4, type=float, metavar=("W", "S", "E", "N"))
    p.add_argument("--planting-month", type=int)
    p.add_argument("--no-skip-existing", action="store_true")
    p.add_argument("--url", help="ask, chat: the model's address")
    p.add_argument("--backend", choices=["http", "parts"], default="http", help="what the address speaks: chat completions, or turns of parts")
    p.add_argument("--places", help="parquet table (name, w, s, e, n) of small areas")
    p.add_argument("--key-variable", default="VERDURE_MODEL_KEY", help="environment variable that holds its key")
    p.add_argument("--models", nargs="*", default=[], help="models in the order of choice")
    p.add_argument("--yes", action="store_true", help="run without asking")
    for f in dataclasses.fields(Settings):
        if f.type in ("str", "int", "float", "str | None", "int | None") and f.name != "level":
            kind = int if "int" in f.type else float if f.type == "float" else str
            p.add_argument(f"--{f.name.replace('_', '-')}", type=kind)
    return p


def settings(args: argparse.Namespace) -> Settings:
    found = {}
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            found = json.load(f)
    found |= {f.name: v for f in dataclasses.fields(Settings) if (v := getattr(args, f.name, None)) is not None}
    return Settings().updated(**found)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, backend=None) -> int:
    args = parser().parse_args(argv)
    own = settings(args)
    if args.command == "settings":
        print(json.dumps(own.public(), indent=1, default=str))
        return 0
    spark = spark or SparkSession.builder.appName("verdure").getOrCreate()
    table = lambda path: spark.read.parquet(path) if path else None
    runner = Runner(spark, own, table(args.units), table(args.obs), places=table(args.places))
    docs = search.package_docs(spark) if args.command in ("ask", "chat") else None
    tools = ToolRunner(runner, args.out, make_store("local", args.out), docs, (lambda *_: True) if args.yes else console_confirm)
    if docs is not None:
        if not args.models or not (backend or args.url):
            parser().error("ask and chat need --url and --models")
        agent = Agent(backend or make_backend(args.backend, url=args.url, key=os.environ.get(args.key_variable, "")), tools, args.models)
        if args.command == "ask" and args.request:
            print(agent.run(args.request))
        else:
            agent.chat()
        return 0
    area = {k: v for k, v in (("level", args.level), ("names", args.names), ("as_of", args.as_of)) if v}
    name, options = {
        "areas": ("list_areas", {k: v for k, v in (("kind", args.kind), ("region", args.region), ("contains", args.contains)) if v}),
        "plan": ("plan_periodic_run", area),
        "periodic": ("run_periodic", area | ({"only": args.only} if args.only else {}) | ({"skip_existing": False} if args.no_skip_existing else {})),
        "recent": ("run_recent", {k: v for k, v in area.items() if k != "level"} | ({"bbox": args.bbox} if args.bbox else {})),
        "check": ("quick_check", {"bbox": args.bbox or [], "planting_month": args.planting_month}),
        "mosaic": ("mosaic_periodic", area | ({"periods": args.periods} if args.periods else {})),
        "outputs": ("list_outputs", {"kind": args.kind or "", "contains": args.contains or ""}),
    }[args.command]
    reply = tools(name, options)
    print(json.dumps(public(reply), indent=1, default=str))
    return int(isinstance(reply, dict) and "error" in reply)


if __name__ == "__main__":
    sys.exit(main())
