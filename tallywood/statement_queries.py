"""Registered queries that read statements: ledger rows are written as pages, lines and cells, and the scans must find them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators import detect, merge
from .plans import statements as S
from .sources import broker_csv, consolidated_csv, layouts, words, xlsx
from .sources.lines import heads
from .sources.registry import markers


def _rows(columns: str, where: str = "amount <> 0") -> str:
    """The ledger's rows with their places in the statements."""
    return f", r AS (SELECT *, account AS file, row_number() OVER (PARTITION BY account ORDER BY value_date, natural_key, amount) - 1 AS n FROM ledger) SELECT {columns} FROM r WHERE {where}"


_MONEY = "CAST(amount AS DECIMAL(18,4)) AS amount"
_DATES = "value_date, booking_date, description"
_LAST = ", r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY value_date, natural_key, amount) - 1 AS n FROM ledger)"


def register_all(register) -> None:
    """Add the queries by the given ``register(name, tables, sql)``."""
    said = ["file", "value_date", "booking_date", "description", "amount"]
    register("statement_quarterly", "ledger", _rows(f"file, {_DATES}, {_MONEY}"))(lambda lg: layouts.quarterly(S.quarterly_pages(lg)).select(said))
    register("statement_listing", "ledger", _rows(f"file, value_date, value_date AS booking_date, description, {_MONEY}, native_category"))(lambda lg: layouts.listing(S.listing_pages(lg)).select(*said, "native_category"))
    listed = "CAST(substr(account, 6) AS INTEGER) % 2 = 1"
    register("statement_dispatch", "ledger", _rows(f"file, value_date, CASE WHEN {listed} THEN value_date ELSE booking_date END AS booking_date, description, {_MONEY}"))(
        lambda lg: layouts.bank_statement(S.listing_pages(lg.where(listed)).unionByName(S.quarterly_pages(lg.where(f"NOT ({listed})")))).select(said)
    )
    register("statement_broker", "ledger", _rows(f"file, value_date, value_date AS booking_date, description, {_MONEY}"))(lambda lg: layouts.broker_statement(S.broker_pages(lg)).select(said))
    register("broker_balances", "ledger", _LAST + " SELECT account AS file, value_date AS balance_date, CAST(arg_max(CASE WHEN n % 2 = 1 THEN -n ELSE n END, n) AS DECIMAL(14,2)) AS balance, 'value' AS basis FROM r GROUP BY 1, 2")(
        lambda lg: layouts.broker_balances(S.broker_pages(lg)).select("file", "balance_date", "balance", "basis")
    )
    register("statement_pages", "ledger", _rows(f"file, 'revolut_personal_eur' AS account, value_date, description, category AS native_category, {_MONEY}"))(
        lambda lg: layouts.consolidated_statement(S.consolidated_pages(lg)).select("file", "account", "value_date", "description", "native_category", "amount")
    )
    register("statement_csv", "ledger", _rows(f"file, 'revolut_personal_eur' AS account, value_date, description, category, {_MONEY}, CAST(n AS DECIMAL(18,4)) AS balance, CAST(0.10 AS DECIMAL(18,4)) AS fee"))(
        lambda lg: consolidated_csv.movements_table(S.consolidated_lines(lg)).drop("line_no")
    )
    register("statement_interest", "ledger", _rows("file, 'revolut_savings_eur' AS account, value_date, 'Net interest' AS description, 'Interest' AS category, CAST(n % 3 AS DECIMAL(18,4)) AS amount", "n % 3 <> 0"))(
        lambda lg: consolidated_csv.interest(S.consolidated_lines(lg)).drop("line_no")
    )
    register("statement_crypto", "ledger", _rows("file, 'revolut_crypto' AS account, value_date, 'Crypto sale BTC' AS description, 'Crypto' AS category, CAST(n % 5 AS DECIMAL(18,4)) AS amount", "n % 5 <> 0"))(
        lambda lg: consolidated_csv.crypto_sales(S.consolidated_lines(lg)).drop("line_no")
    )
    register("statement_union", "ledger", _LAST + """ SELECT value_date, CAST(amount AS DECIMAL(18,4)) AS amount, category AS native_category FROM r WHERE amount <> 0
      UNION ALL SELECT value_date, CAST(n % 3 AS DECIMAL(18,4)), 'Interest' FROM r WHERE n % 3 <> 0 UNION ALL SELECT value_date, CAST(n % 5 AS DECIMAL(18,4)), 'Crypto' FROM r WHERE n % 5 <> 0""")(
        lambda lg: consolidated_csv.parse(S.consolidated_lines(lg)).select("value_date", "amount", "native_category")
    )
    register("statement_csv_accounts", "ledger", "SELECT DISTINCT * FROM (VALUES ('revolut_personal_eur', 'Some Bank', 'joint', 'IT60X0542811101000000123456'), ('revolut_flexible_savings_eur', NULL, NULL, NULL)) t(account_id, bank_name, holding_modality, iban)")(
        lambda lg: consolidated_csv.accounts(S.consolidated_lines(lg)).select("account_id", "bank_name", "holding_modality", "iban")
    )
    register("statement_csv_balances", "ledger", _LAST + " SELECT account AS file, value_date AS balance_date, CAST(max(n) AS DECIMAL(14,2)) AS balance FROM r WHERE amount <> 0 GROUP BY 1, 2")(
        lambda lg: consolidated_csv.balances(S.consolidated_lines(lg)).select("file", "balance_date", "balance")
    )
    who = "CASE WHEN n % 2 = 0 THEN merchant ELSE native_category END"
    register("statement_broker_csv", "ledger", _rows(f"file, value_date, CASE WHEN n % 5 = 0 OR {who} = description THEN {who} ELSE {who} || ' - ' || description END AS description, CAST(amount - CASE WHEN n % 3 = 0 THEN 1.50 ELSE 0 END AS DECIMAL(18,4)) AS amount, mcc, category AS native_category", "n % 7 <> 6"))(
        lambda lg: broker_csv.parse(S.broker_lines(lg)).select("file", "value_date", "description", "amount", "mcc", "native_category")
    )
    register("statement_broker_trades", "ledger", _rows("file, CASE WHEN n % 8 = 0 THEN 'sell' ELSE 'buy' END AS side, 'IT' || CAST(n AS VARCHAR) AS isin, 'stock' AS asset_class, CAST(CASE WHEN n % 8 = 0 THEN -2.5 ELSE 2.5 END AS DECIMAL(18,4)) AS quantity, CAST(10.25 AS DECIMAL(18,4)) AS unit_price", "n % 4 = 0 AND n % 7 <> 6"))(
        lambda lg: broker_csv.trades(S.broker_lines(lg)).select("file", "side", "isin", "asset_class", F.col("quantity").cast("decimal(18,4)").alias("quantity"), F.col("unit_price").cast("decimal(18,4)").alias("unit_price"))
    )
    register("statement_sheet", "ledger", _rows("file, value_date, merchant || ' ' || native_category AS description, amount", "n % 6 <> 5 AND amount <> 0"))(
        lambda lg: xlsx.movements(S.sheet_cells(lg)).select("file", "value_date", "description", "amount")
    )
    register("declared_balances", "balances ledger", "SELECT account AS file, balance_date, CAST(balance AS DECIMAL(14,2)) AS balance, 'booking' AS basis FROM balances")(lambda b, lg: layouts.bank_balances(_declared(b)).select("file", "balance_date", "balance", "basis"))
    register("bank_accounts", "accounts", "SELECT account_id AS file, coalesce(product, 'IBAN ' || iban) AS product, iban FROM (SELECT account_id, product, 'IT60X0542811101' || lpad(substr(account_id, 6), 12, '0') AS iban FROM accounts)")(lambda a: layouts.bank_accounts(_front(a)).select("file", "product", "iban"))
    register("addressee_scan", "accounts", "SELECT account_id AS file, 'Anna ' || product AS holder FROM accounts WHERE product IS NOT NULL")(lambda a: words.addressee(_front(a)))
    register("bank_identify", "accounts", "SELECT account_id AS file, CASE WHEN bank_name IS NULL THEN 'Bank of codes' END AS bank FROM accounts")(_identified)
    register("head_detection", "ledger", "SELECT DISTINCT account AS file, 'revolut' AS source FROM ledger UNION ALL SELECT DISTINCT account || '.csv', 'trade_republic' FROM ledger")(_heads)
    register("twin_formats", "ledger", "SELECT 0::BIGINT AS only_pages, 0::BIGINT AS only_lines, count(*) AS in_both FROM ledger WHERE amount <> 0")(
        lambda lg: merge.twin_keys(merge.keyed(layouts.consolidated(S.consolidated_pages(lg)).withColumn("account", F.col("file")).withColumn("line_no", F.col("page") * 1000 + F.col("line"))),
                                   merge.keyed(consolidated_csv.movements_table(S.consolidated_lines(lg)).withColumn("account", F.col("file"))), part="file").toDF("only_pages", "only_lines", "in_both")
    )


def _page(rows: DataFrame, cells: list[tuple]) -> DataFrame:
    """Words of page 1 of each row's file: (top, x0, text column)."""
    word = F.array(*[F.struct(F.lit(float(t)).alias("top"), F.lit(float(x)).alias("x0"), F.lit(float(x + 6)).alias("x1"), text.alias("text")) for t, x, text in cells])
    return rows.select("file", F.lit(1).alias("page"), F.explode(word).alias("w")).select("file", "page", "w.*").where("text IS NOT NULL AND text <> ''")


def _declared(balances: DataFrame) -> DataFrame:
    """A statement of each account: its balances, each said twice, the second time by another sum."""
    rows = balances.select(F.col("account").alias("file"), "balance", "balance_date", F.row_number().over(W.partitionBy("account").orderBy("balance_date")).alias("page"))
    signed = F.concat(F.when(F.col("balance") < 0, "-").otherwise("+"), S.italian(F.abs("balance")))
    day = F.date_format("balance_date", "dd.MM.yyyy")
    line = lambda top, value: [(top, 20, F.lit("Saldo")), (top, 60, F.lit("finale")), (top, 100, F.lit("al")), (top, 120, day), (top, 270, F.lit("9,99")), (top, 450, F.concat(value, F.lit("€")))]
    word = F.array(*[F.struct(F.lit(float(t)).alias("top"), F.lit(float(x)).alias("x0"), F.lit(float(x + 6)).alias("x1"), text.alias("text")) for t, x, text in [*line(50, signed), *line(70, F.lit("+1,00"))]])
    return rows.select("file", "page", F.explode(word).alias("w")).select("file", "page", "w.*")


def _front(accounts: DataFrame) -> DataFrame:
    """A front page: product and IBAN on the left, the addressee on the right."""
    rows = accounts.withColumn("file", F.col("account_id"))
    iban = F.concat(F.lit("IT60X0542811101"), F.lpad(F.substring("account_id", 6, 12), 12, "0"))
    words_of = F.split("product", " ")
    said = [(50, 20, F.lit("Tipologia")), (50, 60, F.lit("conto:")), (60, 20, F.col("product")), (70, 20, F.lit("IBAN")), (70, 60, iban), (51, 300, F.when(F.col("product").isNotNull(), "Anna"))]
    said += [(51, 340 + 40 * k, F.get(words_of, F.lit(k))) for k in range(4)]
    return _page(rows, [*said, (61, 300, F.lit("Via")), (71, 300, F.lit("00100")), (71, 340, F.lit("Roma"))])


def _identified(accounts: DataFrame) -> DataFrame:
    banks = accounts.sparkSession.createDataFrame([("5428", "Bank of codes")], "abi string, bank_name string")
    files = accounts.select(F.col("account_id").alias("file"), F.when(F.col("bank_name").isNull(), F.concat(F.lit("conto it60 x054 2811 1010 0000 "), F.lpad(F.substring("account_id", 6, 7), 7, "0"))).otherwise("no number").alias("head"))
    return detect.identify_bank(files, banks).select("file", "bank")


def _heads(ledger: DataFrame) -> DataFrame:
    line = lambda lines: lines.groupBy("file").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("line_no") < 50, F.struct("line_no", "line")))), 1, 50), lambda x: x["line"]), "\n").alias("body"))
    files = line(S.consolidated_lines(ledger)).unionByName(line(S.broker_lines(ledger)).withColumn("file", F.concat("file", F.lit(".csv"))))
    return heads(files).select("file", detect.detect_source(F.col("head"), markers()).alias("source"))
