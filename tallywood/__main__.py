"""Commands: load statements into a ledger, load a store's files again, export it, link its transfers.

    python -m tallywood load LEDGER FILES [--source ID] [--force] [--vocabulary FOLDER]
    python -m tallywood reprocess LEDGER FILES
    python -m tallywood export LEDGER OUT [--lang it]
    python -m tallywood link-transfers LEDGER [--window 4]

A ledger is a folder of versioned tables (see ``operators.versions``).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import loading
from .operators import query
from .plans import loader, vocabulary
from .session import session
from .sources import statement


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallywood")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("load")
    a.add_argument("ledger"), a.add_argument("files"), a.add_argument("--source"), a.add_argument("--force", action="store_true"), a.add_argument("--vocabulary")
    r = commands.add_parser("reprocess")
    r.add_argument("ledger"), r.add_argument("files"), r.add_argument("--vocabulary")
    b = commands.add_parser("export")
    b.add_argument("ledger"), b.add_argument("out"), b.add_argument("--lang", default="en")
    c = commands.add_parser("link-transfers")
    c.add_argument("ledger"), c.add_argument("--window", type=int, default=vocabulary.TRANSFER_WINDOW)
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or session("tallywood")
    if args.command in ("load", "reprocess"):
        again = args.command == "reprocess"
        words = loader.load(args.vocabulary) if args.vocabulary else None
        got = loading.load(spark, args.ledger, statement.records(spark, args.files), None if again else args.source, again or args.force, words)
        print(f"{got.new} new, {got.enriched} enriched; {got.parsed} files parsed, {got.failed} failed")
        return 0
    if args.command == "export":
        ledger = loading.table(spark, args.ledger, "transactions").read()
        query.export_csv(ledger, args.out, args.lang)
        query.summary(ledger).show(100, False)
    else:
        loading.relink(spark, args.ledger, args.window)
        legs = loading.table(spark, args.ledger, "transactions").read().where("transfer_group IS NOT NULL")
        said = legs.agg(F.countDistinct("transfer_group"), F.sum(F.abs("amount")) / 2, F.sum("amount")).first()
        print(f"{said[0]} pairs, volume {said[1]}, net {said[2]}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
