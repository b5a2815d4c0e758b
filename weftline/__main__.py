"""The command line: ``python -m weftline {context,locate,impact,tree,graph} ROOT [options]``.

Exit codes: 0 success, 1 a run that failed, 2 wrong usage, 4 a change without any context.
"""

from __future__ import annotations

import argparse
import json
import sys

OK, FAILED, USAGE, EMPTY = 0, 1, 2, 4


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline", description="Context of a change, callers and tests, trees and graphs of a folder of files.")
    p.add_argument("mode", choices=("context", "locate", "impact", "tree", "graph"))
    p.add_argument("root", help="folder of files after the change")
    p.add_argument("--diff", help="file with a unified diff, - for standard input")
    p.add_argument("--budget", type=int, help="tokens of the document: none for automatic, -1 for unlimited")
    p.add_argument("--scoring", default="ego", choices=("ego", "ppr", "bm25", "rrf", "pit"))
    p.add_argument("--symbol", help="NAME or PATH:NAME, for impact without a change")
    p.add_argument("--full", action="store_true", help="every fragment of the changed files and nothing else")
    p.add_argument("--no-content", action="store_true")
    p.add_argument("-o", "--output-file", default="-")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code == 0 else USAGE
    if args.mode in ("context", "locate") and args.diff is None or args.mode == "impact" and args.diff is None and not args.symbol:
        print(f"{args.mode} needs --diff", file=sys.stderr)
        return USAGE
    from pyspark.sql import SparkSession

    from weftline import api
    from weftline.sinks import files, graphs
    from weftline.sources import trees

    try:
        spark = SparkSession.builder.appName("weftline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        diff = "" if args.diff is None else sys.stdin.read() if args.diff == "-" else open(args.diff, encoding="utf-8").read()
        corpus = trees.read_tree(spark, args.root).select("path", "content")
        if args.mode == "tree":
            lines = [f"{'  ' * (r['depth'] - 1)}{r['node'].rpartition('/')[2]}{'' if r['is_file'] else '/'}" for r in api.map_directory(spark, args.root).orderBy("node").toLocalIterator()]
        elif args.mode == "graph":
            frags = api.fragments_of(corpus)
            lines = [r["line"] for r in graphs.json_document(frags.select("id", "file", "kind"), api.project_edges(frags)).orderBy("ord", "key").toLocalIterator()]
        elif args.mode == "impact":
            lines = [api.build_impact(corpus, diff, args.root, args.symbol)]
        elif args.mode == "locate":
            lines = [api.build_locate(corpus, diff, args.root, args.budget, args.scoring)]
        else:
            lines = [api.build_context(corpus, diff, args.root, args.budget, args.scoring, args.full, not args.no_content)]
        if args.output_file == "-":
            print("\n".join(lines))
        else:
            files.write_atomically(args.output_file, lines)
    except Exception as e:  # noqa: BLE001
        print(f"weftline: {e}", file=sys.stderr)
        return FAILED
    return EMPTY if args.mode == "context" and not json.loads(lines[0])["fragments"] else OK


if __name__ == "__main__":
    sys.exit(main())
