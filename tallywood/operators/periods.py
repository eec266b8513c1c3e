"""Periods relative to the latest month with data, and the figures shown for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import delta
from .views import MONEY


def windows(months: DataFrame, n: int) -> DataFrame:
    """(month, period): the latest n months with data are current, the n before them previous. A row per month, so one task orders them."""
    ranked = months.select("month").distinct().withColumn("r", F.row_number().over(W.orderBy(F.col("month").desc())))
    return ranked.where(F.col("r") <= 2 * n).select("month", F.when(F.col("r") <= n, "current").otherwise("previous").alias("period"))


def kpis(months: DataFrame, n: int) -> DataFrame:
    """Income, expense, net, savings rate and mean monthly expense of both periods, from income_expense_month."""
    g = months.join(windows(months, n), "month").groupBy("period").agg(
        F.sum(F.coalesce("income", F.lit(0))).cast(MONEY).alias("income"), F.sum(F.coalesce("expense", F.lit(0))).cast(MONEY).alias("expense"),
        F.sum(F.coalesce(F.col("net"), F.coalesce("income", F.lit(0)) + F.coalesce("expense", F.lit(0)))).cast(MONEY).alias("net"), F.count(F.lit(1)).alias("n_months"),
    )
    rate = F.when(F.col("income") > 0, F.col("net").cast("double") / F.col("income").cast("double") * 100).otherwise(0.0)
    return g.withColumn("savings_rate", F.round(rate, 6)).withColumn("avg_expense", F.round(F.col("expense").cast("double") / F.col("n_months"), 6))


def kpi_changes(rows: DataFrame) -> DataFrame:
    """One row: current figures with their change from the previous period."""
    pick = lambda c, p: F.max(F.when(F.col("period") == p, F.col(c).cast("double")))
    one = rows.agg(*[pick(c, p).alias(f"{c}_{p}") for c in ("income", "expense", "net", "savings_rate") for p in ("current", "previous")])
    return one.select(*[F.col(f"{c}_current").alias(c) for c in ("income", "expense", "net", "savings_rate")], *[delta(F.col(f"{c}_current"), F.col(f"{c}_previous"), c == "savings_rate").alias(f"{c}_change") for c in ("income", "expense", "net", "savings_rate")])


def category_rank(months: DataFrame, n: int, top: int | None = 8) -> DataFrame:
    """Spending by category in the current period, months with a surplus left out, next to the previous period's; from category_month."""
    spent = months.where("total < 0").join(windows(months, n), "month").groupBy("category").agg(
        F.coalesce(F.sum(F.when(F.col("period") == "current", -F.col("total"))), F.lit(0)).cast(MONEY).alias("spent"), F.coalesce(F.sum(F.when(F.col("period") == "previous", -F.col("total"))), F.lit(0)).cast(MONEY).alias("previous")
    )
    ranked = spent.where("spent > 0")
    return ranked if top is None else ranked.orderBy(F.col("spent").desc(), "category").limit(top)


def category_pivot(months: DataFrame, categories: list[str]) -> DataFrame:
    """Spending by month, a column for each category, 0 where nothing was spent."""
    return months.where("total < 0").groupBy("month").pivot("category", categories).agg(F.sum(-F.col("total")).cast(MONEY)).fillna(0)


def stacked(months: DataFrame, n: int = 6, top: int = 6) -> DataFrame:
    """(month, category, spent) of the last ``n`` months, in the ``top`` categories of them; all others together are 'rest'."""
    now = months.join(F.broadcast(windows(months, n).where("period = 'current'").select("month")), "month").where("total < 0").withColumn("spent", -F.col("total"))  # n months
    best = now.groupBy("category").agg(F.sum("spent").alias("s")).orderBy(F.col("s").desc(), "category").limit(top).select("category", F.lit(True).alias("top"))
    named = now.join(F.broadcast(best), "category", "left")  # a few rows
    return named.groupBy("month", F.when(F.col("top"), F.col("category")).otherwise("rest").alias("category")).agg(F.sum("spent").cast(MONEY).alias("spent"))


def heat(months: DataFrame) -> DataFrame:
    """Each month's spending in a category as a percentage of the largest."""
    s = months.where("total < 0").withColumn("spent", -F.col("total"))
    top = s.agg(F.max("spent").alias("top"))
    return s.crossJoin(F.broadcast(top)).select("month", "category", F.round(F.col("spent") / F.col("top") * 100).cast("int").alias("heat"))  # one row


def merchant_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """A merchant ranking with the previous period's figures, casing aside."""
    return now.join(before.select("k", F.col("total_spent").alias("previous")), "k", "left").withColumn("change", delta(F.col("total_spent").cast("double"), F.col("previous").cast("double")))


def balance_pivot(grid: DataFrame, accounts: list[str]) -> DataFrame:
    """Balances by month, a column for each account, 0 before its first."""
    return grid.groupBy("month").pivot("account", accounts).agg(F.sum("balance").cast(MONEY)).fillna(0)


def stale_accounts(latest: DataFrame, days: int = 45) -> DataFrame:
    """Accounts whose balance is from more than ``days`` before the newest."""
    newest = latest.agg(F.max("as_of").alias("newest"))
    return latest.crossJoin(F.broadcast(newest)).withColumn("stale", F.datediff("newest", "as_of") > days).drop("newest")  # one row


def average_price(holdings: DataFrame) -> DataFrame:
    return holdings.withColumn("avg_price", F.when(F.col("units") != 0, F.col("invested") / F.col("units")))


PRESETS = {"30d": 30, "90d": 90, "6m": 182, "1y": 365}


def preset(name: str, today: str) -> tuple[str, str]:
    """(from, to) of a date preset; "ytd" is the year to date."""
    from datetime import date, timedelta

    end = date.fromisoformat(today)
    start = date(end.year, 1, 1) if name == "ytd" else end - timedelta(days=PRESETS[name])
    return str(start), str(end)


def by_day(page: DataFrame) -> DataFrame:
    """Rows of a page grouped by day, newest first."""
    return page.groupBy("value_date").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast(MONEY).alias("total")).orderBy(F.col("value_date").desc())
