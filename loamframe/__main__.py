"""Command line: list the catalogue's queries, or run one and show or write its rows."""

from __future__ import annotations

import argparse

from loamframe import __version__
from loamframe.plans import catalog
from loamframe.session import get_spark


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loamframe", description=__doc__)
    parser.add_argument("--version", action="version", version=__version__)
    parser.add_argument("query", nargs="?", help="name of a query; without one the names are listed")
    parser.add_argument("tables", nargs="?", help="folder of the Parquet tables")
    parser.add_argument("--out", help="write the rows as Parquet to this path")
    parser.add_argument("--master", help="Spark master, if the session has none")
    parser.add_argument("--rows", type=int, default=20, help="rows to show without --out")
    args = parser.parse_args(argv)
    found, _ = catalog.load()
    if args.query is None:
        print("\n".join(sorted(found)))
        return 0
    if args.query not in found or args.tables is None:
        parser.error("a known query and a folder of tables are needed")
    df = found[args.query](get_spark(master=args.master), args.tables)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
