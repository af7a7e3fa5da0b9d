"""Command line: lint, fix, rules, plugins, init. Exit 0 clean, 1 blocking findings, 2 for what can't be loaded."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from itertools import groupby
from pathlib import Path

from pyspark.sql import SparkSession

from . import config as configs
from .plans import engine, render
from .plugins import BUILTIN, loaded
from .rules.loader import LoadErrors, load
from .sources import from_files


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="prosemill")
    top.add_argument("--config")
    top.add_argument("--rule-file", action="append", default=[])
    top.add_argument("--rules-dir", help="folder of built-in packs")
    commands = top.add_subparsers(dest="command", required=True)
    lint = commands.add_parser("lint")
    lint.add_argument("paths", nargs="+")
    lint.add_argument("--format", choices=["human", "json", "github"])
    lint.add_argument("--width", type=int, default=0)
    fix = commands.add_parser("fix")
    fix.add_argument("paths", nargs="+")
    fix.add_argument("--out", help="folder for the rewritten table; without it nothing is written")
    rules = commands.add_parser("rules")
    rules.add_argument("--json", action="store_true")
    commands.add_parser("plugins")
    commands.add_parser("init")
    args = top.parse_args(argv)
    if args.command == "init":
        if Path(configs.NAME).exists():
            print(f"{configs.NAME} exists", file=sys.stderr)
            return 2
        Path(configs.NAME).write_text(configs.TEMPLATE, "utf-8")
        return 0
    if args.command == "plugins":
        print("\n".join(f"[plugin.{p.id}]  # tier {p.tier}, {p.category}; " + ", ".join(f"{k} = {v}" for k, v in p.defaults.items()) for p in BUILTIN.values()))
        return 0
    try:
        config = configs.discover(explicit=args.config)
        root = configs.pack_root(args.rules_dir)
        packs = [configs.builtin_pack(stem, root) for stem in config.builtin]
        packs += [Path(config.folder or ".") / p for p in config.extra_paths] + [Path(p) for p in args.rule_file]
        ruleset = load(packs, embedder=False)
    except LoadErrors as e:
        print(render.load_errors(e.errors), file=sys.stderr)
        return 2
    except configs.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    settings, (plugins, odd) = config.settings(), loaded(config.plugins)
    for w in ruleset.warnings + odd:
        print(f"warning: {w}", file=sys.stderr)
    logging.basicConfig(level=os.environ.get("PROSEMILL_LOG", "WARNING").upper())
    spark = SparkSession.builder.appName("prosemill").getOrCreate()
    if args.command == "rules":
        rows = engine.rule_listing(spark, ruleset, settings, plugins).collect()
        print(json.dumps({"rules": [r.asDict() for r in rows]}, ensure_ascii=False) if args.json else "\n".join(f"{r.id:<40} {r.tier} {r.kind:<12} {r.category:<20} {r.level}" for r in rows))
        return 0
    docs = from_files(spark, *args.paths, globs=config.extra_globs)
    if args.command == "fix":
        settings.max_tier = None
        fixed = engine.fix(docs, ruleset, settings)
        if args.out:
            fixed.select("path", "fixed").write.mode("overwrite").parquet(args.out)
        for r in fixed.where("applied > 0").select("path", "applied").orderBy("path").toLocalIterator():
            print(f"{r.path}: {r.applied} fixed")
        total = engine.fix_summary(fixed).first()
        print(f"{total.applied} fixed in {total.files_changed} files, {total.skipped_overlaps} overlap, {total.unfixable} can't be fixed")
        return int(total.skipped_overlaps + total.unfixable > 0)
    found = engine.scan(docs, ruleset, settings, plugins).cache()
    shape = args.format or config.format
    if shape == "json":
        print("[" + ",\n".join(r.json for r in engine.ordered_lines(render.json_lines(found)).toLocalIterator()) + "]")
    elif shape == "github":
        for r in engine.ordered_lines(render.github_lines(found)).toLocalIterator():
            print(r.annotation)
    else:
        # a document's text comes with its findings, one document at a time
        told = engine.ordered(found.join(docs.select("path", "text"), "path")).toLocalIterator()
        for path, rows in groupby(told, key=lambda r: r.path):
            rows = list(rows)
            print(render.human(rows, {path: rows[0].text}, args.width))
    return int(engine.blocking(found))


if __name__ == "__main__":
    sys.exit(main())
