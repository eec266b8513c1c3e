"""Gold views: spending, accounts, investments, balances and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import vocabulary as V

MONEY = "decimal(38,2)"


def month(day: str) -> Column:
    return F.trunc(day, "MM")


def _sum(x: Column | str, when: Column | None = None) -> Column:
    """An exact sum; null where no row counts."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(F.when(when, x) if when is not None else x).cast(MONEY)


def no_transfers(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("transfer_group").isNull())


def spend(ledger: DataFrame, assets=V.ASSETS) -> DataFrame:
    """What counts as spending or income: no transfer legs, no asset movements; a null category counts as neither."""
    return no_transfers(ledger).where(F.col("category").isNotNull() & ~F.col("category").isin(*assets))


def asset_moves(ledger: DataFrame, assets=V.ASSETS) -> DataFrame:
    return no_transfers(ledger).where(F.col("category").isin(*assets))


def category_month(ledger: DataFrame) -> DataFrame:
    return spend(ledger).groupBy(month("value_date").alias("month"), "category").agg(F.count(F.lit(1)).alias("n_movements"), _sum("amount").alias("total"))


def _sides() -> list[Column]:
    return [_sum("amount", F.col("amount") > 0).alias("income"), _sum("amount", F.col("amount") < 0).alias("expense"), _sum("amount").alias("net")]


def income_expense_month(ledger: DataFrame) -> DataFrame:
    """Income, expense and net of each month; a side is null, not 0, where nothing happened on it."""
    return spend(ledger).groupBy(month("value_date").alias("month")).agg(*_sides())


def category_totals(ledger: DataFrame) -> DataFrame:
    return spend(ledger).groupBy("category").agg(F.count(F.lit(1)).alias("n_movements"), *_sides())


def internal_transfers(ledger: DataFrame) -> DataFrame:
    """One row per transfer group: first day, amount, and the accounts it left and reached."""
    legs = ledger.where(F.col("transfer_group").isNotNull())
    side = lambda c: F.max(F.when(c, F.col("account")))
    return legs.groupBy("transfer_group").agg(
        F.min("value_date").alias("day"), F.max(F.abs("amount")).cast(MONEY).alias("amount"), side(F.col("amount") < 0).alias("from_account"), side(F.col("amount") > 0).alias("to_account"), F.count(F.lit(1)).alias("n_legs")
    )


def accounts_view(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Accounts with metadata, with movements, or both; the user's name for one wins over a composed one."""
    seen = ledger.groupBy(F.col("account").alias("s_id")).agg(
        F.min("source").alias("s_source"), F.count(F.lit(1)).alias("n"), F.min("value_date").alias("first_movement"), F.max("value_date").alias("last_movement")
    )
    both = accounts.join(seen, accounts["account_id"] == seen["s_id"], "full")
    ident = F.coalesce("account_id", "s_id")
    composed = F.concat(
        F.coalesce("bank_name", F.initcap(F.replace(ident, F.lit("_"), F.lit(" ")))), F.coalesce(F.concat(F.lit(" · "), F.col("product")), F.lit("")),
        F.when(F.col("holding_modality") == "joint", " (Joint)").otherwise(""),
    )
    joint = F.when(F.col("holding_modality") == "joint", True).when(F.col("holding_modality") == "individual", False)
    return both.select(
        ident.alias("account_id"), F.coalesce("source", "s_source").alias("source"), "bank_name", "product", "holding_modality", joint.alias("is_joint"),
        F.coalesce("display_name_override", composed).alias("display_name"), F.coalesce("n", F.lit(0)).alias("transactions"), "first_movement", "last_movement",
    )


def single_bank(accounts: DataFrame) -> DataFrame:
    """Sources whose accounts name one bank alone."""
    return accounts.groupBy("source").agg(F.min("bank_name").alias("bank_name"), F.countDistinct("bank_name").alias("n")).where("n = 1").drop("n")


def holdings(trades: DataFrame, ledger: DataFrame) -> DataFrame:
    """Positions by instrument: units, cash paid for buys, and the last price seen (same-day ties by key; a null price never hides an older one)."""
    t = trades.where(F.col("isin").isNotNull()).join(ledger.select("natural_key", "value_date", "amount"), "natural_key")
    order = F.struct("value_date", "natural_key")
    price = F.max_by("unit_price", F.when(F.col("unit_price").isNotNull(), order))
    out = t.groupBy("isin").agg(
        F.min("instrument").alias("instrument"), F.min("asset_class").alias("asset_class"), F.sum("quantity").cast("decimal(28,4)").alias("units"), _sum(-F.col("amount"), F.col("side") == "buy").alias("invested"),
        F.count(F.lit(1)).alias("n_trades"), F.min("value_date").alias("first_trade"), F.max("value_date").alias("last_trade"), price.cast("decimal(18,4)").alias("last_price"),
    )
    # Operands are narrowed before the product, or its scale would be cut.
    return out.withColumn("value_at_last_price", (F.col("units").cast("decimal(18,4)") * F.col("last_price").cast("decimal(18,4)")).cast("decimal(36,6)"))


def investment_month(trades: DataFrame, ledger: DataFrame) -> DataFrame:
    """Money into and out of asset categories by month, split by whether the instrument is known."""
    known = trades.select(F.col("natural_key").alias("k")).distinct()
    t = asset_moves(ledger).join(known, F.col("natural_key") == F.col("k"), "left")
    out, back, has = F.col("amount") < 0, F.col("amount") > 0, F.col("k").isNotNull()
    return t.groupBy(month("value_date").alias("month"), "category").agg(
        _sum(-F.col("amount"), out).alias("contributed"), _sum("amount", back).alias("returned"), _sum(-F.col("amount")).alias("net_invested"),
        _sum(-F.col("amount"), out & has).alias("into_known"), _sum(-F.col("amount"), out & ~has).alias("into_unknown"), F.count(F.lit(1)).alias("n_movements"),
    )


def investment_kinds(months: DataFrame) -> DataFrame:
    """investment_month rolled up by category, nulls as 0."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast(MONEY)
    return months.groupBy("category").agg(
        *[total(c).alias(c) for c in ("contributed", "returned", "net_invested", "into_known", "into_unknown")], F.sum("n_movements").cast("long").alias("n_movements"),
        F.max(F.coalesce(F.col("into_known"), F.lit(0)) != 0).alias("has_instruments"),
    )


def cumulative_invested(months: DataFrame) -> DataFrame:
    """Net invested by month and its running total; there is a row per month, so the unpartitioned window is small."""
    m = months.groupBy("month").agg(F.sum("net_invested").cast(MONEY).alias("net_invested"))
    return m.withColumn("cumulative", F.sum("net_invested").over(W.orderBy("month").rowsBetween(W.unboundedPreceding, 0)).cast(MONEY))


def reconciliation(balances: DataFrame, ledger: DataFrame, mismatched_only: bool = False) -> DataFrame:
    """Between consecutive declared balances of an account: what they say moved, what did, and the difference.

    A balance counts everything up to its day, on its basis. Movements are first
    summed by account and day, on each basis in use; each day's sums then fall into the one
    interval it belongs to, found by its position among the account's anchors,
    so no pair of movement and interval is tried in vain.
    """
    anchors = balances.select("account", "balance_date", F.col("balance").cast(MONEY).alias("balance"), F.coalesce("basis", F.lit("value")).alias("basis"))
    w = W.partitionBy("account").orderBy("balance_date")
    spans = anchors.withColumn("to_date", F.lead("balance_date").over(w)).withColumn("to_balance", F.lead("balance").over(w)).where("to_date IS NOT NULL")
    daily = None
    for basis, day in (("value", "value_date"), ("booking", "booking_date")):
        part = ledger.where(F.col(day).isNotNull()).groupBy("account", F.col(day).alias("day")).agg(F.sum("amount").alias("moved"), F.count("natural_key").alias("n")).withColumn("basis", F.lit(basis))
        daily = part if daily is None else daily.unionByName(part)
    marks = spans.select("account", F.col("balance_date").alias("day"), "basis", F.col("to_date").alias("until"), F.lit(True).alias("mark"))
    # A balance comes after the movements of its day: strictly later days look back to it.
    line = daily.withColumn("until", F.lit(None).cast("date")).withColumn("mark", F.lit(False)).unionByName(marks.withColumn("moved", F.lit(None).cast("decimal(38,2)")).withColumn("n", F.lit(0)), allowMissingColumns=True)
    look = W.partitionBy("account", "basis").orderBy("day", F.col("mark").asc())
    start = F.last(F.when(F.col("mark"), F.struct("day", "until")), ignorenulls=True).over(look)
    found = line.withColumn("span", start).where((~F.col("mark")) & F.col("span").isNotNull()).where("day <= span.until")
    sums = found.groupBy("account", "basis", F.col("span.day").alias("balance_date")).agg(F.sum("moved").cast(MONEY).alias("moved"), F.sum("n").alias("n"))
    out = spans.join(sums, ["account", "basis", "balance_date"], "left")
    expected = (F.col("to_balance") - F.col("balance")).cast(MONEY)
    actual = F.coalesce(F.col("moved"), F.lit(0)).cast(MONEY)
    out = out.select(
        "account", F.col("balance_date").alias("from_date"), "to_date", F.col("balance").alias("from_balance"), "to_balance", expected.alias("expected_delta"),
        actual.alias("actual_delta"), (actual - expected).cast(MONEY).alias("discrepancy"), F.coalesce("n", F.lit(0)).alias("n_movements"),
    )
    return out.where("discrepancy <> 0") if mismatched_only else out


def reconciliation_rollup(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("account").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("discrepancy") != 0).alias("bad"), F.sum("discrepancy").cast(MONEY).alias("net_discrepancy"), F.max_by("to_balance", "to_date").alias("last_balance")
    )


def month_series(balances: DataFrame) -> DataFrame:
    """Every month from the first to the last balance."""
    span = balances.agg(F.trunc(F.min("balance_date"), "MM").alias("a"), F.trunc(F.max("balance_date"), "MM").alias("b"))
    return span.where("a IS NOT NULL").select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))


def balance_month(balances: DataFrame) -> DataFrame:
    """Each account's last declared balance by month end, carried forward; nothing before its first.

    An anchor holds from its month to the one before the next anchor's, so each
    account's anchors are spread over their own months and no cross join is needed.
    """
    last = balances.agg(F.trunc(F.max("balance_date"), "MM").alias("last_month"))
    one = W.partitionBy("account", "currency", "m").orderBy(F.col("balance_date").desc())
    ends = balances.withColumn("m", month("balance_date")).withColumn("rn", F.row_number().over(one)).where("rn = 1")
    until = F.add_months(F.lead("m").over(W.partitionBy("account", "currency").orderBy("m")), -1)
    ends = ends.crossJoin(F.broadcast(last)).withColumn("until", F.coalesce(until, "last_month"))  # one row: the last month
    return ends.select(F.explode(F.expr("sequence(m, until, interval 1 month)")).alias("month"), "account", "currency", F.col("balance").cast(MONEY).alias("balance"), F.col("balance_date").alias("as_of"))


def wealth(grid: DataFrame) -> DataFrame:
    """Latest balance of each account, with the total and the oldest date any of them is from."""
    latest = grid.groupBy("account").agg(F.max_by(F.struct("balance", "as_of", "month"), "month").alias("x")).select("account", "x.balance", "x.as_of")
    total = latest.agg(F.sum("balance").cast(MONEY).alias("total"), F.min("as_of").alias("oldest_as_of"))
    return latest.crossJoin(F.broadcast(total))  # one row


def balance_continuity(rows: DataFrame) -> DataFrame:
    """Rows (account, line_no, amount, balance) whose balance isn't the previous one plus the movement, within a cent."""
    w = W.partitionBy("account").orderBy("line_no")
    return rows.withColumn("before", F.lag("balance").over(w)).where(F.abs(F.col("before") + F.col("amount") - F.col("balance")) > F.lit("0.01").cast("decimal(4,2)"))


def profile_people(files: DataFrame, key: Column) -> DataFrame:
    """Who the files' holders are: one row per person, however their names are written."""
    people = files.where(F.col("holder").isNotNull()).groupBy(key.alias("person")).agg(F.countDistinct("holder").alias("n_variants"), F.count(F.lit(1)).alias("n_files"), F.min("holder").alias("name"))
    return people


def profile(files: DataFrame) -> DataFrame:
    """Files by holder and source, most first, then the newest."""
    return files.groupBy("holder", "source").agg(F.count(F.lit(1)).alias("n_files"), F.max("uploaded_at").alias("newest")).orderBy(F.col("n_files").desc(), F.col("newest").desc())
