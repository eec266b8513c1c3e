"""The consolidated statement: account blocks of one CSV file, with tables of movements, interest and crypto sales.

What a line belongs to is the last thing said before it, so sections are found
with windows over a file's lines: a title opens one, a blank line or a
separator closes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import account_id, find_iban, parse_date, parse_day_first, parse_money
from .lines import cell, cells
from .registry import Adapter, register

SOURCE = "revolut"
CURRENCY = "EUR"
SEPARATOR = "---------"
MOVEMENTS = ("Date", "Description", "Category", "Money in/out")
INTEREST = ("only interest receipt", ("Date", "Description", "Gross rate"))
SALES = ("only sales", ("Date (of Sale, of Purchase)",))


def _file():
    return W.partitionBy("file").orderBy("line_no")


_CODE = r"\(([A-Z]{3})\)"
FIELDS = {"institution": "bank_name", "bank": "bank_name", "account holding modality": "holding_modality", "holding modality": "holding_modality"}


def _cut(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("row", cells(F.col("line"))).withColumn("first", cell(F.col("row"), 0))
    blank = F.forall("row", lambda c: c == "") | F.col("first").startswith(SEPARATOR)
    return rows.withColumn("closes", blank)


def _is(header: tuple[str, ...]) -> Column:
    return F.slice("row", 1, len(header)) == F.array(*[F.lit(h) for h in header])


_ROW = ("account", "value_date", "description", "category", "amount", "balance", "fee")


def _row(account: Column, day: Column, description: Column, category: Column, amount: Column, balance: Column | None = None, fee: Column | None = None) -> Column:
    none = F.lit(None).cast("decimal(18,4)")
    parts = (account.cast("string"), day, description, category, amount, none if balance is None else balance, none if fee is None else fee)
    return F.struct(*[x.alias(name) for x, name in zip(parts, _ROW, strict=True)])


def _said(counts: Column, row: Column, good) -> Column:
    """The row of a line that counts, if it is good: its cells are read here, once, and of no other line."""
    return F.filter(F.array(F.when(counts, row)), good)


def _movements(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The rows of :func:`_cut` with windows over them, and what each says in an EUR movement table, as an array of one or none.

    A table ends at a blank line, a separator, a new account or a line that
    doesn't start with a date; lines without a readable amount are skipped.
    """
    code = F.regexp_extract("first", _CODE, 1)
    named = F.col("first").contains("(") & ~F.col("closes") & F.col("first").rlike("Account|Savings|Pocket") & (code != "")
    # What a title says of its account is read at the title, not at each of its lines.
    title = F.when(named, F.struct(code.alias("currency"), account_id(F.col("first"), code, SOURCE).alias("account")))
    rows = rows.withColumns({"title": title, "day": parse_date(F.col("first"))})
    # 0: what ends a table, 1: a header; other lines keep the state.
    mark = F.when(F.col("closes") | F.col("title").isNotNull(), 0).when(_is(MOVEMENTS), 1).when(F.col("day").isNull(), 0)
    rows = rows.withColumn("mark", mark)
    row = F.col("row")
    said = _row(F.col("of.account"), F.col("day"), cell(row, 1), cell(row, 2), parse_money(cell(row, 3)), parse_money(cell(row, 4)), F.abs(F.coalesce(parse_money(cell(row, 7)), F.lit(0))).cast("decimal(18,4)"))
    rows = rows.withColumn("of", F.last("title", ignorenulls=True).over(_file()))
    state = F.when((F.col("mark") == 1) & ~F.coalesce(F.col("of.currency") == CURRENCY, F.lit(False)), 0).otherwise(F.col("mark"))
    rows = rows.withColumn("open", F.last(state, ignorenulls=True).over(_file()))
    return rows, _said((F.col("open") == 1) & F.col("mark").isNull(), said, lambda x: x["amount"].isNotNull())


def _section(rows: DataFrame, name: str, title: str, header: tuple[str, ...], said: Column, wanted: Column | None = None) -> tuple[DataFrame, Column]:
    """The rows with windows over them, and ``said`` (an array of one or none) of those in tables under a title, from the header to the next blank line or separator."""
    # 0 closed, 1 armed by the title, 2 at a header: a header counts only if armed.
    event, before, armed = F.col(f"{name}_event"), F.col(f"{name}_before"), f"{name}_open"
    rows = rows.withColumn(f"{name}_event", F.when(F.col("closes"), 0).when(F.col("first").contains(title), 1).when(_is(header), 2))
    rows = rows.withColumn(f"{name}_before", F.last(event, ignorenulls=True).over(_file().rowsBetween(W.unboundedPreceding, -1)))
    at = F.when((event != 2) | (before == 1), event)
    rows = rows.withColumn(armed, F.last(at, ignorenulls=True).over(_file()))
    counts = (F.col(armed) == 2) & event.isNull()
    return rows, _said(counts if wanted is None else counts & wanted, said, lambda x: (x["amount"] != 0) & x["value_date"].isNotNull())


def _interest(rows: DataFrame) -> tuple[DataFrame, Column]:
    row = F.col("row")
    said = _row(F.lit("revolut_savings_eur"), parse_date(F.col("first")), F.coalesce(F.nullif(cell(row, 1), F.lit("")), F.lit("Savings interest")), F.lit("Interest"), parse_money(cell(row, 7)))
    code = F.when(F.col("first").contains("(") & F.col("first").rlike("Account|Savings|Statements"), F.nullif(F.regexp_extract("first", _CODE, 1), F.lit("")))
    rows = rows.withColumn("currency", F.last(code, ignorenulls=True).over(_file()))
    return _section(rows, "earned", *INTEREST, said, F.coalesce(F.col("currency") == CURRENCY, F.lit(True)))


def _sales(rows: DataFrame) -> tuple[DataFrame, Column]:
    row = F.col("row")
    legs = F.split(cell(row, 5), r",\s+(?=[+-])")
    sold = F.try_element_at(F.filter(legs, lambda x: x.contains("+")), F.lit(1))
    said = _row(F.lit("revolut_crypto"), parse_day_first(F.substring_index("first", ",", 1)), F.trim(F.concat(F.lit("Crypto sale "), cell(row, 1))), F.lit("Crypto"), F.when(F.size("row") >= 6, parse_money(sold)))
    return _section(rows, "sold", *SALES, said)


def _tables(lines: DataFrame, *kinds) -> DataFrame:
    """(file, line_no, account, value_date, description, category, amount, balance, fee) of the given kinds of tables, in one pass over the lines."""
    rows, found = _cut(lines), []
    for kind in kinds:
        rows, said = kind(rows)
        found.append(said)
    return rows.select("file", "line_no", F.explode(F.concat(*found)).alias("x")).select("file", "line_no", "x.*")


def movements_table(lines: DataFrame) -> DataFrame:
    """(file, line_no, account, value_date, description, category, amount, balance, fee) of the EUR movement tables."""
    return _tables(lines, _movements)


def interest(lines: DataFrame) -> DataFrame:
    """Savings interest: the net column of EUR sections, zero and blank ones left out."""
    return _tables(lines, _interest).drop("balance", "fee")


def crypto_sales(lines: DataFrame) -> DataFrame:
    """Proceeds of crypto sales: the leg with a plus in "+ €a, - €b", whatever currency was said before."""
    return _tables(lines, _sales).drop("balance", "fee")


def parse(lines: DataFrame) -> DataFrame:
    """All movements of the statement, in the ledger's columns; fees are informational and not movements of their own."""
    rows = _tables(lines, _movements, _interest, _sales)
    return rows.select("file", "line_no", "account", "value_date", F.col("value_date").alias("booking_date"), "description", F.round("amount", 2).cast("decimal(18,4)").alias("amount"), F.lit(CURRENCY).alias("currency"), F.lit(SOURCE).alias("source"), F.nullif("category", F.lit("")).alias("native_category"), F.lit(None).cast("string").alias("mcc"))


def accounts(lines: DataFrame) -> DataFrame:
    """Account metadata from the key and value lines after a title; of each field the first value counts."""
    rows = _cut(lines)
    title = r"^(.*\b(?:Account|Savings|Pocket)\b.*?)\s*\(([A-Z]{3})\)\s*$"
    # The account's id is read at its title; only titles and lines with a known key go on to be put in order.
    parts = [F.regexp_extract("first", title, i) for i in (1, 2)]
    named = F.when(F.col("first").endswith(")") & F.col("first").rlike(title), F.struct(parts[0].alias("product"), parts[1].alias("currency"), account_id(*parts, SOURCE).alias("account_id")))
    label = F.lower("first")
    known = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    what = F.when(label.startswith("iban"), "iban").otherwise(F.try_element_at(known, label))
    rows = rows.where(~F.col("closes") & (F.col("first").endswith(")") | label.startswith("iban") | label.isin(*FIELDS)))
    rows = rows.select("file", "line_no", named.alias("title"), cell(F.col("row"), 1).alias("value"), what.alias("what"))
    rows = rows.withColumn("of", F.last("title", ignorenulls=True).over(_file())).where("of IS NOT NULL").withColumn("account_id", F.col("of.account_id"))
    rows = rows.withColumn("what", F.when(F.col("title").isNull() & (F.col("value") != ""), F.col("what")))
    first = lambda name: F.min_by("value", F.when(F.col("what") == name, F.col("line_no")))
    g = rows.groupBy("account_id").agg(F.min_by("of", "line_no").alias("t"), first("bank_name").alias("bank_name"), first("holding_modality").alias("m"), first("iban").alias("iban"))
    mode = F.when(F.col("m").isNotNull(), F.when(F.lower("m") == "joint", "joint").otherwise("individual"))
    return g.select("account_id", F.lit(SOURCE).alias("source"), "bank_name", F.col("t.product").alias("product"), mode.alias("holding_modality"), F.col("t.currency").alias("currency"), find_iban(F.col("iban")).alias("iban"))


def balances(lines: DataFrame) -> DataFrame:
    """The last balance of each file, account and day, as of value dates."""
    rows = movements_table(lines).where("balance IS NOT NULL")
    g = rows.groupBy("file", "account", F.col("value_date").alias("balance_date")).agg(F.max_by("balance", "line_no").alias("balance"))
    return g.select("file", "account", "balance_date", F.col("balance").cast("decimal(14,2)").alias("balance"), F.lit(CURRENCY).alias("currency"), F.lit(SOURCE).alias("source"), F.lit("value").alias("basis"))


ADAPTER = register(Adapter(SOURCE, parse, (("current accounts summaries",), ("revolut",), ("money in/out", "balance")), accounts=accounts, balances=balances))
