"""Statements written from ledger rows, for round trips through the scans: words of pages, lines of CSV files and cells of sheets.

A file is an account's; its rows go by day, key and amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_ON_PAGE = 20


def numbered(ledger: DataFrame) -> DataFrame:
    """The ledger with file, row number in it from 0, page and place on the page."""
    # By file, so that what is written from the rows of a file is where the scans of whole files want it: nothing is dealt out anew.
    order = W.partitionBy("file").orderBy("value_date", "natural_key", "amount")
    rows = ledger.withColumn("file", F.col("account")).withColumn("n", F.row_number().over(order) - 1)
    return rows.withColumn("page", F.floor(F.col("n") / ROWS_ON_PAGE).cast("int") + 1).withColumn("k", (F.col("n") % ROWS_ON_PAGE).cast("int"))


def english(amount: Column) -> Column:
    return F.format_number(amount, 2)


def italian(amount: Column) -> Column:
    return F.translate(english(amount), ",.", ".,")


def _word(top, x0, text: Column, x1=None) -> Column:
    as_double = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    x0 = as_double(x0)
    return F.struct(as_double(top).alias("top"), x0.alias("x0"), (x0 + 6 if x1 is None else as_double(x1)).alias("x1"), text.cast("string").alias("text"))


def _said(words: Column, top, x0: float, step: float = 8.0) -> Column:
    return F.transform(words, lambda w, i: _word(top, F.lit(x0) + i * step, w))


def _split(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def _with_head(starts: Column, head: Column, body: Column) -> Column:
    """One row for each element of a row's body, behind those of the head in rows that start a page or file."""
    none = F.slice(head, 1, 0)
    return F.explode(F.concat(F.when(starts, head).otherwise(none), F.coalesce(body, none)))


def _words(rows: DataFrame, per_row: Column, per_page: list[tuple[float, float, float, str]], starts: Column | None = None) -> DataFrame:
    """Words of all rows, and those that each page (or what else ``starts``) begins with."""
    head = F.array(*[_word(t, a, F.lit(text), z) for t, a, z, text in per_page])
    return rows.select("file", "page", _with_head(F.col("k") == 0 if starts is None else starts, head, per_row).alias("w")).select("file", "page", "w.*")


def quarterly_pages(ledger: DataFrame) -> DataFrame:
    """Two lines to a row: the second has the rest of the description."""
    rows = numbered(ledger)
    top, said, debit = 110 + F.col("k") * 24, _split(F.col("description")), F.col("amount") < 0
    day = lambda c: F.date_format(c, "dd.MM.yyyy")
    sums = F.when(debit, _word(top, 390, italian(-F.col("amount")), 440)).otherwise(_word(top, 500, italian(F.col("amount")), 540))
    word = F.concat(F.array(_word(top, 20, day("booking_date")), _word(top, 90, day("value_date")), sums), _said(F.slice(said, 1, 3), top, 160), _said(F.slice(said, 4, 50), top + 12, 160, 2.0))
    return _words(rows, word, [(100.0, 160.0, 200.0, "Descrizione"), (100.0, 400.0, 440.0, "Addebiti"), (100.0, 500.0, 540.0, "Accrediti"), (700.0, 20.0, 40.0, "Pagina")])


def listing_pages(ledger: DataFrame) -> DataFrame:
    """Descriptions around the row's line."""
    rows = numbered(ledger)
    top, said = 100 + F.col("k") * 30, _split(F.col("description"))
    word = F.concat(
        F.array(_word(top, 40, F.date_format("value_date", "dd.MM.yyyy")), _word(top, 500, F.concat(italian(F.col("amount")), F.lit("€")))), _said(_split(F.col("native_category")), top, 400),
        _said(F.slice(said, 1, 2), top - 7, 130), _said(F.slice(said, 3, 2), top, 130), _said(F.slice(said, 5, 50), top + 7, 130, 2.0),
    )
    return _words(rows, word, [(20.0, 40.0, 60.0, "Lista"), (20.0, 70.0, 90.0, "movimenti"), (60.0, 400.0, 440.0, "CATEGORIA"), (60.0, 500.0, 540.0, "IMPORTO")])


def broker_pages(ledger: DataFrame) -> DataFrame:
    """Dates on two lines; the balance is the row's number, below zero for odd ones."""
    rows = numbered(ledger)
    top, said, debit = 100 + F.col("k") * 30, _split(F.col("description")), F.col("amount") < 0
    months = F.array(*[F.lit(m) for m in ("gen", "feb", "mar", "apr", "may", "giu", "jul", "ago", "set", "oct", "nov", "dic")])
    sums = F.when(debit, _word(top, 420, italian(-F.col("amount")), 450)).otherwise(_word(top, 340, italian(F.col("amount")), 370))
    odd = F.col("n") % 2 == 1
    word = F.concat(
        F.array(_word(top - 4, 20, F.dayofmonth("value_date")), _word(top - 4, 40, F.element_at(months, F.month("value_date"))), _word(top + 4, 20, F.year("value_date")), sums),
        F.when(odd, F.array(_word(top, 490, F.lit("-"), 496), _word(top, 498, italian(F.col("n")), 540))).otherwise(F.array(_word(top, 500, italian(F.col("n")), 540))),
        _said(F.slice(said, 1, 3), top, 110), _said(F.slice(said, 4, 50), top + 8, 110, 2.0),
    )
    # The header is on the first page alone; its words are in no column of texts.
    header = [(60.0, 20.0, 40.0, "DATA"), (60.0, 335.0, 336.0, "DESCRIPTION"), (60.0, 340.0, 370.0, "INCOMING"), (60.0, 420.0, 450.0, "OUTGOING"), (60.0, 500.0, 540.0, "BALANCE")]
    return _words(rows, word, header, F.col("n") == 0)


def consolidated_pages(ledger: DataFrame) -> DataFrame:
    rows = numbered(ledger)
    top, said = 110 + F.col("k") * 24, _split(F.col("description"))
    money = F.concat(F.when(F.col("amount") < 0, "-").otherwise(""), F.lit("€"), english(F.abs("amount")))
    word = F.concat(
        _said(F.split(F.date_format("value_date", "MMM d, yyyy"), " "), top, 40), F.array(_word(top, 330, money), _word(top, 390, F.concat(F.lit("€"), english(F.col("n")))), _word(top, 260, F.col("category"))),
        _said(F.slice(said, 1, 3), top, 130), _said(F.slice(said, 4, 50), top + 12, 130, 2.0),
    )
    title = [(90.0, 40.0, 60.0, "Personal"), (90.0, 70.0, 90.0, "Account"), (90.0, 100.0, 120.0, "(EUR)"), (100.0, 40.0, 60.0, "Date"), (100.0, 130.0, 160.0, "Description"), (100.0, 260.0, 290.0, "Category")]
    return _words(rows, word, title)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def consolidated_lines(ledger: DataFrame) -> DataFrame:
    """(file, line_no, line): an account's title and key lines, a table of movements, one of interest and one of crypto sales."""
    rows = numbered(ledger)
    money = F.concat(F.when(F.col("amount") < 0, "-").otherwise(""), F.lit("€"), english(F.abs("amount")))
    day = F.date_format("value_date", "MMM d, yyyy")
    moved = F.concat_ws(",", _quoted(day), _quoted(F.col("description")), F.col("category"), _quoted(money), _quoted(F.concat(F.lit("€"), english(F.col("n")))), F.lit(""), F.lit(""), F.lit("€0.10"))
    earned = F.concat_ws(",", _quoted(day), F.lit("Net interest"), F.lit("2%"), F.lit(""), F.lit(""), F.lit(""), F.lit(""), _quoted(F.concat(F.lit("€"), english(F.col("n") % 3))))
    sold = F.concat_ws(",", _quoted(F.concat(F.date_format("value_date", "dd/MM/yyyy"), F.lit(", 01/01/1990"))), F.lit("BTC"), F.lit("1"), F.lit("2"), F.lit("3"), _quoted(F.concat(F.lit("+ €"), english(F.col("n") % 5), F.lit(", - €9.00"))))
    size = 10_000_000
    at = lambda start, text: F.struct((F.col("n") + start + 10).cast("int").alias("line_no"), text.alias("line"))
    body = F.array(at(0, moved), at(size, earned), at(2 * size, sold))
    said = [
        (0, "Current accounts summaries"), (2, "Personal Account (EUR)"), (3, "Account holding modality,Joint"), (4, "Institution,Some Bank"), (5, "Account holding modality,Individual"), (6, "IBAN,IT60X0542811101000000123456"),
        (7, "Date,Description,Category,Money in/out,Balance,Tax,Other,Fees"), (size, ""), (size + 1, "Flexible Savings (EUR)"), (size + 2, "Statement with only interest receipt"), (size + 3, "Date,Description,Gross rate,A,B,C,D,Net"),
        (2 * size, "---------"), (2 * size + 1, "Statement with only sales"), (2 * size + 2, '"Date (of Sale, of Purchase)",Symbol,A,B,C,Value'),
    ]
    head = F.array(*[F.struct(F.lit(n).alias("line_no"), F.lit(text).alias("line")) for n, text in said])
    return rows.select("file", _with_head(F.col("n") == 0, head, body).alias("x")).select("file", "x.*")


def broker_lines(ledger: DataFrame) -> DataFrame:
    """(file, line_no, line) of the broker's export: fees and taxes with every third row, shares with every fourth, other currencies with every seventh."""
    rows = numbered(ledger)
    none, n = F.lit(""), F.col("n")
    line = F.concat_ws(
        ",", F.date_format("value_date", "yyyy-MM-dd"), F.when(n % 8 == 0, "TRADE_SELL").otherwise("TRADE_BUY"), F.when(n % 7 == 6, "USD").otherwise("eur"), F.col("amount").cast("string"),
        F.when(n % 3 == 0, "-1.00").otherwise(none), F.when(n % 3 == 0, "-0.50").otherwise(none), F.when(n % 2 == 0, _quoted(F.col("merchant"))).otherwise(none), F.when(n % 5 == 0, none).otherwise(_quoted(F.col("description"))),
        _quoted(F.col("native_category")), F.col("category"), F.col("mcc"), F.when(n % 4 == 0, "STOCK").otherwise(none), F.when(n % 4 == 0, F.concat(F.lit("IT"), n.cast("string"))).otherwise(none), F.when(n % 4 == 0, "2.5").otherwise(none), F.when(n % 4 == 0, "10.25").otherwise(none), n.cast("string"),
    )
    head = "date,type,currency,amount,fee,tax,name,description,counterparty_name,category,mcc_code,asset_class,symbol,shares,price,transaction_id"
    at = lambda number, text: F.array(F.struct(number.alias("line_no"), text.alias("line")))
    return rows.select("file", _with_head(n == 0, at(F.lit(0), F.lit(head)), at(n + 1, line)).alias("x")).select("file", "x.*")


def sheet_cells(ledger: DataFrame) -> DataFrame:
    """(file, row_no, cells): amounts as numbers and as text, days as serials and as text, every sixth row in another currency."""
    rows = numbered(ledger)
    n = F.col("n")
    amount = F.when(n % 2 == 0, F.col("amount").cast("string")).otherwise(italian(F.col("amount")))
    day = F.when(n % 3 == 0, F.datediff("value_date", F.lit("1899-12-30").cast("date")).cast("string")).otherwise(F.date_format("value_date", "dd/MM/yyyy"))
    cells = F.create_map(F.lit("A"), day, F.lit("B"), F.col("merchant"), F.lit("C"), F.col("native_category"), F.lit("D"), amount, F.lit("E"), F.when(n % 6 == 5, "USD").otherwise("EUR"))
    head = F.create_map(*[F.lit(x) for kv in (("A", "Data"), ("B", "Operazione"), ("C", "Dettagli"), ("D", "Importo"), ("E", "Valuta")) for x in kv])
    top = rows.select("file").distinct()
    return rows.select("file", (n + 10).cast("long").alias("row_no"), cells.alias("cells")).union(top.select("file", F.lit(5).cast("long"), head)).union(top.select("file", F.lit(1).cast("long"), F.create_map(F.lit("A"), F.lit("Conti e carte"))))
