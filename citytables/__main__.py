"""python -m citytables index|get|query|metadata|inspect|validate CATALOG ..."""

from __future__ import annotations

import argparse
import sys

from citytables.session import build_session
from citytables.sources.catalog import Catalog, build


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="citytables")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, extra in (("index", ["dataset"]), ("get", ["id"]), ("query", ["min_x", "min_y", "max_x", "max_y"]), ("metadata", []), ("inspect", ["dataset"]), ("validate", ["dataset"])):
        command = commands.add_parser(name)
        command.add_argument("catalog")
        for argument in extra:
            command.add_argument(argument, type=float if argument[:3] in ("min", "max") else str)
    args = parser.parse_args(argv)
    spark = build_session("citytables")
    catalog = Catalog(spark, args.catalog)
    if args.command == "index":
        build(spark, args.dataset, args.catalog)
    elif args.command == "get":
        found = catalog.get(args.id)
        print(found if found is not None else f"no feature {args.id}")
        return int(found is None)
    elif args.command == "query":
        for row in catalog.query(args.min_x, args.min_y, args.max_x, args.max_y).select("value").toLocalIterator():
            print(row["value"])
    elif args.command == "metadata":
        for row in catalog.metadata().toLocalIterator():
            print(row["metadata"])
    else:
        issues = 0
        for row in catalog.inspect(args.dataset).toLocalIterator():
            issues += 1
            print(f"{row['issue']}: {row['path']}")
        return int(args.command == "validate" and issues > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
