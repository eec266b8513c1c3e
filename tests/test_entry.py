"""The driver contract."""

from __future__ import annotations

import os

import __spark_entry__ as entry


def test_workers_find_the_package(spark):
    entry.entry(spark).schema  # noqa: B018
    entry.queries()["month_series"](spark, entry.SMALL)
    assert entry.ROOT in spark.sparkContext.environment["PYTHONPATH"].split(os.pathsep)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
