"""Command line of the tools: python -m loomgraph [--graph PATH] COMMAND ... (--help lists the commands)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from loomgraph import sinks
from loomgraph.config import Config
from loomgraph.engine import REPORT_LINES, Engine, render
from loomgraph.sources import projects


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomgraph", description="Code graph tools")
    top.add_argument("--graph", default="graph", help="folder of the saved graph")
    top.add_argument("--root", default=".", help="folder of the sources")
    top.add_argument("--config", default=None, help="settings (TOML)")
    top.add_argument("--json", action="store_true", help="one JSON object a row")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> None:
        sub = commands.add_parser(name)
        for p in positional:
            sub.add_argument(p.rstrip("+"), nargs="+" if p.endswith("+") else None)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if default is False:
                sub.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                sub.add_argument(flag, choices=default, default=default[0])
            else:
                sub.add_argument(flag, type=type(default) if default is not None and not isinstance(default, str) else {"limit": int, "depth": int, "line": int, "head_lines": int, "max_output_tokens": int}.get(option, str), default=default)

    for name in ("health", "status", "index", "examples", "indexers"):
        command(name)
    command("ensure", max_age_hours=24.0)
    command("callers", "name", limit=20)
    command("callees", "name", limit=20)
    command("context", "node_id", brief=False, full=False, depth=1, expand=False, head_lines=None, max_output_tokens=None, callee_budget=2000)
    command("quick", "name", brief=False, full=False)
    command("flow", "name", direction=["forward", "backward"], depth=3, target=None)
    command("path", "start", "end", direction=["forward", "backward"], depth=3)
    command("search", "terms+", limit=10, lang=None, crate=None, symbol_type=None, exclude_tests=False)
    command("structure", "file")
    command("flatten", "class_id")
    command("impls", "method", trait=None)
    command("resolve", "query")
    command("source", "path", line=None)
    command("history", "name", time_range=None, crate=None, limit=10)
    return top


def answer(e: Engine, args: argparse.Namespace) -> DataFrame:
    """The rows of one command."""
    own = {k: v for k, v in vars(args).items() if k not in ("graph", "root", "config", "json", "command")}
    tools = {"health": lambda: e.health(args.graph), "resolve": lambda: e.resolve_id(args.query), "history": lambda: e.commits(args.root, **own)}
    return tools[args.command]() if args.command in tools else getattr(e, args.command)(**own)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "indexers":
        print("\n".join(f"{lang}: {version or 'not found'}" for lang, version in projects.status().items()))
        return 0
    spark = spark or SparkSession.builder.appName("loomgraph").getOrCreate()
    config = Config.load(args.config)
    if args.command == "index":
        Engine.index(spark, args.root, config=config).save(args.graph)
        return 0
    if args.command == "ensure":
        e = Engine.ensure(spark, args.root, args.graph, args.max_age_hours, config=config)
        rows = e.status()
    else:
        from loomgraph.sources import readers

        e = Engine.load(spark, args.graph, config=config)
        if args.command in ("context", "quick", "source"):
            e.files = readers.source_tree(spark, args.root)
        rows = answer(e, args)
    if args.json:
        print("\n".join(r["json"] for r in sinks.as_json(rows).limit(REPORT_LINES.get(args.command, 500)).collect()))
    else:
        print(render(rows, args.command, REPORT_LINES.get(args.command, 500)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
