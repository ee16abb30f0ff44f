"""Command line: run a catalogue query, process a manifest, or list the queries.

Exit code 0 where all is well, 1 where documents failed or a name is unknown.
"""

from __future__ import annotations

import argparse
import sys

from clausemill.plans import catalogue, pipeline
from clausemill.session import build_session, ship
from clausemill.sources import manifests


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="clausemill")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("query")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--output")
    process = sub.add_parser("process")
    process.add_argument("manifest")
    process.add_argument("folder")
    process.add_argument("output")
    args = parser.parse_args(argv)
    names = catalogue.queries()
    if args.command == "list":
        print("\n".join(sorted(names)))
        return 0
    if args.command == "query" and args.name not in names:
        print(f"unknown query {args.name}", file=sys.stderr)
        return 1
    spark = build_session()
    ship(spark)
    if args.command == "query":
        found = names[args.name](spark, args.tables)
        found.write.mode("overwrite").parquet(args.output) if args.output else found.show(50, truncate=80)
        return 0
    made = pipeline.process(spark, manifests.manifest(spark, args.manifest), args.folder)
    for name, frame in made.items():
        frame.write.mode("overwrite").parquet(f"{args.output}/{name}")
    return 1 if made["reports"].filter("status = 'failed'").count() else 0


if __name__ == "__main__":
    sys.exit(main())
