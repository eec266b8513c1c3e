"""Scans of whole files work where the rows of a file are: nothing is dealt out again between the rows that are written and the movements that are read."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallywood.functions.money import parse_date, parse_day_first, parse_money
from tallywood.operators import merge
from tallywood.plans import statements as S
from tallywood.sources import consolidated_csv, layouts

SCANS = {
    "quarterly": lambda lg: layouts.quarterly(S.quarterly_pages(lg)),
    "listing": lambda lg: layouts.listing(S.listing_pages(lg)),
    "either": lambda lg: layouts.bank_statement(S.listing_pages(lg)),
    "broker": lambda lg: layouts.broker_balances(S.broker_pages(lg)),
    "pages": lambda lg: layouts.consolidated_statement(S.consolidated_pages(lg)),
    "csv": lambda lg: consolidated_csv.parse(S.consolidated_lines(lg)),
    "balances": lambda lg: consolidated_csv.balances(S.consolidated_lines(lg)),
    "twins": lambda lg: merge.twin_keys(*[merge.keyed(consolidated_csv.movements_table(S.consolidated_lines(lg)).withColumn("account", F.col("file")))] * 2, part="file"),
}


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


@pytest.fixture(scope="module")
def ledger(spark):
    rows = spark.range(90).select(F.concat(F.lit("k"), "id").alias("natural_key"), F.concat(F.lit("acct_"), F.col("id") % 3).alias("account"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("value_date"))
    return rows.withColumns({"booking_date": F.col("value_date"), "amount": (F.crc32("natural_key") % 1000 - 500.5).cast("decimal(18,2)"), "description": F.lit("some old rod here"), "merchant": F.lit("Shop"), "category": F.lit("rent"), "native_category": F.lit("SMALL TIN"), "mcc": F.lit("5000")})


@pytest.mark.parametrize("name", SCANS)
def test_no_row_moves_between_writing_and_reading(spark, ledger, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        copies = 2 if name in ("twins", "either") else 1  # sides of twins, layouts of either
        assert exchanges(SCANS[name](ledger)) == copies * exchanges(S.numbered(ledger).select("n"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_union_of_tables_is_one_pass(ledger):
    """Lines of the three tables are put in order once, not once for a table."""
    plan = consolidated_csv.parse(S.consolidated_lines(ledger))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_texts_are_read_as_before(spark):
    money = {"€1,234.50": "1234.5000", "-€5": "-5.0000", "5-": "-5.0000", "(7.25)": "-7.2500", "1-2": None, "": None, "N/A": None, "-": None, "—": None, "()": None, "−3.": "-3.0000", ".5": "0.5000", "-0": "0.0000", "1.2.3": None, None: None, "--4": "-4.0000"}
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in money], "t string").select("t", parse_money(F.col("t")).cast("string").alias("v")).collect()}
    assert got == money
    days = {"2024-02-29": "2024-02-29", "2023-02-29": None, "Jan 5, 2025": "2025-01-05", "MAY 15, 2025": "2025-05-15", "february 1, 2024": "2024-02-01", "Foo 1, 2024": None, "31.12.2024": "2024-12-31", "31.02.2024": None, " 01.02.2024 ": "2024-02-01", "1.2.2024": None, "Net interest": None, "": None, None: None}
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in days], "t string").select("t", parse_date(F.col("t")).cast("string").alias("v")).collect()}
    assert got == days
    first = {"5/1/2025": "2025-01-05", "05-01-2025 10:00": "2025-01-05", "32/01/2025": None, "2025-01-05": "2025-01-05", "x": None}
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in first], "t string").select("t", parse_day_first(F.col("t")).cast("string").alias("v")).collect()}
    assert got == {**first, "2025-01-05": got["2025-01-05"]}
