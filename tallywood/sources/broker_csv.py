"""The broker's transaction export: one CSV table with a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import parse_money
from .lines import cells
from .registry import Adapter, register

SOURCE = "trade_republic"
ACCOUNT = "trade_republic"
CURRENCY = "EUR"
COLUMNS = ("date", "type", "currency", "amount", "fee", "tax", "name", "description", "counterparty_name", "category", "mcc_code", "asset_class", "symbol", "shares", "price")


def table(lines: DataFrame) -> DataFrame:
    """(file, line_no, columns by header name); a column that a file lacks is empty."""
    rows = lines.withColumn("row", cells(F.col("line"))).where("trim(line) <> ''")
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("header", F.first("row").over(w)).withColumn("top", F.min("line_no").over(w)).where("line_no > top")
    at = lambda c: F.array_position("header", c)
    value = lambda c: F.when(at(c) > 0, F.coalesce(F.get("row", (at(c) - 1).cast("int")), F.lit(""))).otherwise("")
    return rows.select("file", "line_no", *[value(c).alias(c) for c in COLUMNS])


def _money(c: str) -> Column:
    return F.coalesce(parse_money(F.col(c)), F.lit(0)).cast("decimal(18,4)")


def _counted(lines: DataFrame) -> DataFrame:
    return table(lines).where((F.upper("currency") == CURRENCY) & (F.col("amount") != ""))


def parse(lines: DataFrame) -> DataFrame:
    """Movements: amount with fee and tax; the description is what is known of name, counterparty and text, each once."""
    rows = _counted(lines)
    who = F.coalesce(F.nullif("name", F.lit("")), F.nullif("counterparty_name", F.lit("")))
    parts = F.array_distinct(F.array_compact(F.array(who, F.nullif("description", F.lit("")))))
    text = F.coalesce(F.nullif(F.array_join(parts, " - "), F.lit("")), F.col("type"))
    day = F.col("date").try_cast("date")
    return rows.select(
        "file", "line_no", F.lit(ACCOUNT).alias("account"), day.alias("value_date"), day.alias("booking_date"), text.alias("description"),
        F.round(_money("amount") + _money("fee") + _money("tax"), 2).cast("decimal(18,4)").alias("amount"), F.lit(CURRENCY).alias("currency"), F.lit(SOURCE).alias("source"),
        F.nullif("category", F.lit("")).alias("native_category"), F.nullif("mcc_code", F.lit("")).alias("mcc"),
    )


def trades(lines: DataFrame) -> DataFrame:
    """The instrument side of rows that have one: an asset class and a number of shares. Its sign follows the side."""
    rows = _counted(lines).withColumn("q", F.col("shares").try_cast("decimal(28,10)")).where((F.col("asset_class") != "") & F.col("q").isNotNull())
    sell = F.upper("type").endswith("SELL")
    return rows.select(
        "file", "line_no", F.when(sell, "sell").otherwise("buy").alias("side"), F.nullif("symbol", F.lit("")).alias("isin"), F.nullif("name", F.lit("")).alias("instrument"), F.lower("asset_class").alias("asset_class"),
        F.when(sell, -F.abs("q")).otherwise(F.abs("q")).cast("decimal(28,10)").alias("quantity"), F.col("price").try_cast("decimal(20,10)").alias("unit_price"),
    )


ADAPTER = register(Adapter(SOURCE, parse, (("asset_class", "transaction_id"), ("trade republic",)), trades=trades))
