"""Questions to the ledger: filters, pages, rankings, one movement in detail, exports."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import label
from ..plans import vocabulary as V
from .views import MONEY, _sides, single_bank

SORTS = {"date": "value_date", "amount": "amount", "abs_amount": "abs(amount)", "description": "description", "category": "category", "confidence": "category_confidence", "merchant": "merchant"}


@dataclass(frozen=True)
class Filters:
    """All given conditions hold; dates are inclusive; ``q`` is a pattern in which % and _ stand for any text."""

    account: str | None = None
    source: str | None = None
    category: str | None = None
    category_source: str | None = None
    sign: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    q: str | None = None
    merchant: str | None = None
    min_amount: str | None = None
    max_amount: str | None = None
    min_confidence: float | None = None
    max_confidence: float | None = None
    include_transfers: bool = True

    def column(self) -> Column:
        if self.sign not in (None, "income", "expense"):
            raise ValueError(f"sign: {self.sign!r}")
        if self.category_source not in (None, "mcc", "model", "rule", "manual", "default"):
            raise ValueError(f"category_source: {self.category_source!r}")
        c = F.lit(True)
        for name in ("account", "source", "category", "category_source"):
            if getattr(self, name) is not None:
                c &= F.col(name) == getattr(self, name)
        if self.sign:
            c &= F.col("amount") > 0 if self.sign == "income" else F.col("amount") < 0
        for name, op in (("date_from", ">="), ("date_to", "<=")):
            if (v := getattr(self, name)) is not None:
                c &= F.col("value_date") >= F.lit(v).cast("date") if op == ">=" else F.col("value_date") <= F.lit(v).cast("date")
        if self.q is not None:
            c &= F.col("description").ilike(f"%{self.q}%")
        if self.merchant is not None:
            c &= F.lower("merchant") == self.merchant.lower()
        if self.min_amount is not None:
            c &= F.col("amount") >= F.lit(str(self.min_amount)).cast("decimal(18,4)")
        if self.max_amount is not None:
            c &= F.col("amount") <= F.lit(str(self.max_amount)).cast("decimal(18,4)")
        if self.min_confidence is not None:
            c &= F.col("category_confidence").cast("double") >= self.min_confidence
        if self.max_confidence is not None:
            c &= F.col("category_confidence").cast("double") <= self.max_confidence
        if not self.include_transfers:
            c &= F.col("transfer_group").isNull()
        return c


def _filters(by: dict) -> Filters:
    if unknown := set(by) - {f.name for f in fields(Filters)}:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    return Filters(**by)


def transactions(ledger: DataFrame, sort: str = "date", order: str = "desc", limit: int = 100, offset: int = 0, **by) -> DataFrame:
    """A page. Nulls are largest, as the first of a descending order; ties go by natural key, descending."""
    if sort not in SORTS or order not in ("asc", "desc"):
        raise ValueError(f"sort: {sort!r} {order!r}")
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError(f"limit or offset: {limit}, {offset}")
    key = F.expr(SORTS[sort])
    key = key.desc_nulls_first() if order == "desc" else key.asc_nulls_last()
    return ledger.where(_filters(by).column()).orderBy(key, F.col("natural_key").desc()).offset(offset).limit(limit)


def totals(ledger: DataFrame, **by) -> DataFrame:
    """Count, income, expense and net over all rows that the same page's filters leave."""
    income, expense, net = _sides()
    return ledger.where(_filters(by).column()).agg(F.count(F.lit(1)).alias("n"), income.alias("sum_income"), expense.alias("sum_expense"), net.alias("sum_net"))


def merchants(ledger: DataFrame, date_from: str | None = None, date_to: str | None = None, limit: int | None = 20) -> DataFrame:
    """Merchants by money spent, whatever their casing; the most frequent casing and category are shown (ties: first in order)."""
    rows = ledger.where(F.col("merchant").isNotNull() & F.col("transfer_group").isNull()).where(Filters(date_from=date_from, date_to=date_to).column())
    g = rows.groupBy(F.lower("merchant").alias("k")).agg(
        F.expr("mode() WITHIN GROUP (ORDER BY merchant)").alias("merchant"), F.count(F.lit(1)).alias("n_movements"), F.sum("amount").alias("s"),
        F.max("value_date").alias("last_date"), F.expr("mode() WITHIN GROUP (ORDER BY category)").alias("category"),
    )
    g = g.where("s < 0").select(
        "k", "merchant", "n_movements", F.round(-F.col("s"), 2).cast(MONEY).alias("total_spent"), F.round(-F.col("s") / F.col("n_movements"), 2).cast(MONEY).alias("avg_spent"), "last_date", "category"
    )
    return g if limit is None else g.orderBy(F.col("total_spent").desc(), "merchant").limit(limit)


def detail(ledger: DataFrame, trades: DataFrame, files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Movements with their file and instrument, and the other leg of a transfer."""
    rows = ledger if keys is None else ledger.join(keys, "natural_key", "left_semi")
    rows = rows.join(files.select(F.col("id").alias("file_id"), "filename"), "file_id", "left").join(trades.select("natural_key", "side", "isin", "quantity"), "natural_key", "left")
    return rows.join(counterparts(ledger), "natural_key", "left")


def counterparts(ledger: DataFrame) -> DataFrame:
    """For each leg of a transfer the first other leg of its group: one look along the group, no self join."""
    legs = ledger.where(F.col("transfer_group").isNotNull())
    w = W.partitionBy("transfer_group").orderBy("natural_key")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, second = F.first(F.struct("natural_key", "account")).over(whole), F.lead(F.struct("natural_key", "account")).over(w)
    other = F.when(F.row_number().over(w) == 1, second).otherwise(first)
    return legs.select("natural_key", other.alias("o")).where("o IS NOT NULL").select("natural_key", F.col("o.natural_key").alias("other_key"), F.col("o.account").alias("other_account"))


def recent_files(files: DataFrame, n: int = 50) -> DataFrame:
    """The newest files and how many of their rows were known already."""
    return files.select("id", "filename", "source", "status", "rows_total", "rows_new", (F.col("rows_total") - F.col("rows_new")).alias("rows_duplicate"), "uploaded_at").orderBy(F.col("uploaded_at").desc(), F.col("id").desc()).limit(n)


def source_labels(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """A name for each source: its one bank, else its id in title case."""
    return ledger.select("source").distinct().join(single_bank(accounts), "source", "left").select("source", F.coalesce("bank_name", F.initcap(F.replace("source", F.lit("_"), F.lit(" ")))).alias("label"))


def scan(spark: SparkSession, sql: str, params: dict | None = None, **tables: DataFrame) -> DataFrame:
    """A query with named parameters (":name") over the given tables ("{name}") and those of the catalog."""
    return spark.sql(sql, args=params or {}, **tables)


def accounts_ordered(accounts: DataFrame) -> DataFrame:
    """The account view, the busiest first."""
    return accounts.orderBy(F.col("transactions").desc(), "account_id")


def holdings_ordered(holdings: DataFrame) -> DataFrame:
    """Positions, the most money first, unknown sums last."""
    return holdings.orderBy(F.col("invested").desc_nulls_last(), "isin")


def balances_view(balances: DataFrame) -> DataFrame:
    return balances.select("account", "balance_date", "balance", "currency", "source", "basis")


def meta() -> dict:
    """The vocabulary, the sources and the limits."""
    from ..sources.registry import adapters

    return {"sources": sorted(adapters()), "categories": V.LABELS, "assets": list(V.ASSETS), "default": V.DEFAULT, "model_threshold": V.MODEL_THRESHOLD, "transfer_window_days": V.TRANSFER_WINDOW, "max_file_mb": 10, "max_files": 50}


def vocabulary_in_use(ledger: DataFrame, lang: str = "en") -> DataFrame:
    """(category, label, asset, n_movements): the codes that a ledger has, with what the vocabulary says of them."""
    n = ledger.groupBy("category").agg(F.count(F.lit(1)).alias("n_movements"))
    return n.select("category", label(F.col("category"), lang).alias("label"), F.coalesce(F.col("category").isin(*V.ASSETS), F.lit(False)).alias("asset"), "n_movements")


def summary(ledger: DataFrame) -> DataFrame:
    """Count and net by category, least net first."""
    return ledger.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast(MONEY).alias("net")).orderBy("net", "category")


def export_rows(ledger: DataFrame, lang: str = "en") -> DataFrame:
    """The unified export: labelled, with empty texts for nulls, in order of day, account and key."""
    return ledger.select(
        "value_date", "booking_date", "description", F.col("amount").cast("decimal(18,2)").alias("amount"), "currency", "account", "source", "category", label(F.col("category"), lang).alias("category_label"),
        F.coalesce("native_category", F.lit("")).alias("native_category"), "natural_key",
    ).orderBy("value_date", "account", "natural_key")


def export_csv(ledger: DataFrame, path: str, lang: str = "en", single: bool = False) -> None:
    """Write the export. Files are in global order; ``single`` makes one file, for tables that fit a task."""
    rows = export_rows(ledger, lang)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, header=True)


def review_queue(ledger: DataFrame, threshold: float = V.MODEL_THRESHOLD, band: float = 0.1, limit: int = 100) -> DataFrame:
    """What deserves a look: unresolved rows and barely confident ones, largest amounts first."""
    weak = (F.col("category_source") == "default") | ((F.col("category_source") == "model") & (F.col("category_confidence").cast("double") <= threshold + band))
    return ledger.where(weak).orderBy(F.abs("amount").desc(), F.col("natural_key").desc()).limit(limit)
