"""``python -m repolens``: run statistics, detect tools, keep the catalogue."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from . import __version__
from .sources import config


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="repolens")
    out.add_argument("--version", action="version", version=__version__)
    out.add_argument("--root", default=config.ROOT, help="folder of the catalogue")
    cmd = out.add_subparsers(dest="command", required=True)
    run = cmd.add_parser("run", help="statistics of the catalogue")
    run.add_argument("-r", "--repo")
    run.add_argument("-s", "--stat", action="append", default=[])
    run.add_argument("-g", "--granularity")
    run.add_argument("--since")
    run.add_argument("--increments", help="folder of kept sums: only new commits are read")
    one = cmd.add_parser("run-one-off", help="one statistic of a file over a repository")
    one.add_argument("config")
    one.add_argument("repo_path")
    one.add_argument("-o", "--output")
    tools = cmd.add_parser("detect-tools", help="tools of a repository, or of all below a folder")
    tools.add_argument("repo", nargs="?")
    tools.add_argument("-t", "--tools", help="file of rules")
    tools.add_argument("--scan-root")
    tools.add_argument("--max-depth", type=int, default=3)
    tools.add_argument("--json", action="store_true", help="one array instead of a line for each match")
    clone = cmd.add_parser("clone", help="clone or update, and enter in the catalogue")
    clone.add_argument("urls", nargs="+")
    stat = cmd.add_parser("add-stat", help="enter a statistic")
    stat.add_argument("-r", "--repo", required=True)
    stat.add_argument("config")
    conf = cmd.add_parser("config", help="where the catalogue is, or what it holds")
    conf.add_argument("what", choices=["location", "show"])
    return out


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("repolens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    catalog = config.Catalog.load(args.root)
    match args.command:
        case "config":
            print(catalog.location if args.what == "location" else json.dumps({k: asdict(r) for k, r in catalog.repos.items()}, indent=2))
        case "clone":
            print("\n".join(config.ensure_cloned(catalog, *args.urls)))
        case "add-stat":
            catalog.add_stat(args.repo, config.read_stat(args.config))
        case _:
            from .operators import tools
            from .plans.engine import Engine

            engine = Engine(_session(), args.root, increments=getattr(args, "increments", None))
            if args.command == "run":
                print("\n".join(engine.run_many(args.repo, tuple(args.stat), args.granularity, args.since)))
            elif args.command == "run-one-off":
                print(engine.run_config(args.config, args.repo_path, args.output))
            else:
                found = engine.detect_tools(args.repo, args.tools, args.scan_root, args.max_depth)
                rows = tools.as_json_array(found) if args.json else tools.as_lines(found, scan=bool(args.scan_root))
                for r in rows.toLocalIterator():
                    print(r["json"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
