"""``python -m corpusmill book SOURCE TARGET`` and ``python -m corpusmill verify CORPUS.csv TRACKER.csv``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.gate import GateFailed
from .plans import book, verify


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusmill")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("book", help="extract, check, analyse and export one book")
    one.add_argument("source")
    one.add_argument("target", nargs="?", default="output")
    two = commands.add_parser("verify", help="check a tracker against an exported corpus")
    two.add_argument("corpus")
    two.add_argument("tracker")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    if asked.command == "verify":
        ok, lines = verify.run(spark, asked.corpus, asked.tracker)
        print("\n".join(lines))
        return 0 if ok else 1
    try:
        book.run(spark, book.Config(asked.source, asked.target))
    except (GateFailed, book.Unclassified) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
