"""Command line: ``python -m ledgerspark run BOOKS OUT [--strategy S]`` and ``python -m ledgerspark doctor BOOKS``.

Exit codes: 0 done, 1 failed, 2 wrong usage, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.run import run_books, write_all
from .settings import RULES
from .sources.books import load_books


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerspark")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="reconcile the books of a folder and write the reports")
    run.add_argument("books")
    run.add_argument("out")
    run.add_argument("--strategy", choices=sorted(RULES["strategies"]), default="full")
    doctor = commands.add_parser("doctor", help="read the books and count good and rejected rows")
    doctor.add_argument("books")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("ledgerspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "run":
            print(json.dumps(write_all(spark, run_books(spark, args.books, strategy=args.strategy), args.out), default=str))
        else:
            books = load_books(spark, args.books)
            print(json.dumps({"lines": books.bank_lines.count(), "documents": books.docs.count(), "rejected": books.quarantine.count(), "warnings": books.warnings, "as_of": books.as_of}, default=str))
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # the command line reports any failure by its exit code
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
