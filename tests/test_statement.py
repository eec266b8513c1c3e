"""Statement files as a data source and a stream, and loads of mixed folders into a ledger."""

from __future__ import annotations

import json
import zipfile
from datetime import date
from decimal import Decimal

import pytest

from tallywood import loading
from tallywood.plans import statements as S
from tallywood.plans.loader import Vocabulary
from tallywood.sources import statement

BROKER = "date,type,currency,amount,fee,tax,name,description,counterparty_name,category,mcc_code,asset_class,symbol,shares,price,transaction_id\n"


def sheet(path, rows):
    cell = lambda r, c, v: f'<c r="{"ABCDEF"[c]}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


@pytest.fixture
def folder(spark, tmp_path):
    """Lines of two sources, a sheet, the words of pages, and files that are no use."""
    f = tmp_path / "files"
    f.mkdir()
    (f / "t.csv").write_text(BROKER + "2025-01-02,CARD,EUR,-5.00,,,,Pizza place,,FOOD,5812,,,,,1\n2025-01-03,BUY,EUR,-100.00,,,ETF,Plan,,X,,FUND,IE1,2.5,40,2\n2025-01-04,TRANSFER,EUR,-70.00,,,,Bonifico disposto,,X,,,,,,3\n")
    (f / "r.csv").write_text('Current accounts summaries\nPersonal Account (EUR)\nIBAN,IT60 X054 2811 1010 0000 0123 456\nDate,Description,Category,Money in/out,Balance\n"Jan 4, 2025",Top-up by *1234,Top up,€70.00,€170.00\n')
    (f / "s.csv").write_text('Current accounts summaries\nPersonal Account (EUR)\nDate,Description,Category,Money in/out,Balance\n"Jan 4, 2025",Top-up by *1234 once more,Top up,€70.00,€171.00\n')
    sheet(f / "a.xlsx", [["Intesa Sanpaolo - Lista Operazioni"], ["Data", "Operazione", "Dettagli", "Categoria", "Valuta", "Importo"], ["45000", "Pagamento su POS", "BAR 17/031245 x", "Bar", "EUR", "-12.5"], ["17/03/2023", "Stipendio", "", "", "EUR", "1.234,56"]])
    ledger = spark.createDataFrame([("k1", "pages", date(2025, 2, 1), date(2025, 2, 2), Decimal("-30.00"), "Affitto casa", "rent", "x"), ("k2", "pages", date(2025, 2, 5), date(2025, 2, 5), Decimal("200.00"), "Rimborso spese", "x", "x")], "natural_key string, account string, value_date date, booking_date date, amount decimal(18,2), description string, category string, merchant string")
    words = [[r.page, r.top, r.x0, r.x1, r.text] for r in S.quarterly_pages(ledger).collect()] + [[1, 1.0, 10.0, 40.0, "Intesa"], [1, 1.0, 45.0, 90.0, "Sanpaolo"]]
    (f / "q.jsonl").write_text("\n".join(map(json.dumps, words)))
    (f / "odd.txt").write_text("nothing known")
    (f / "empty.csv").write_text("")
    (f / "broken.xlsx").write_bytes(b"no archive")
    (f / "large.csv").write_text("revolut\n" + "x" * 30_000)
    (f / "pages.pdf").write_bytes(b"%PDF")
    return f


def seen(rows):
    plain = lambda r: (r.file.rpartition("/")[2], r.sha256, r.size, r.kind, r.problem, r.head, r.line_no, r.line, str(r.cells), r.page, r.top, r.x0, r.x1, r.text)
    return sorted(map(plain, rows.collect()), key=str)


def test_the_source_reads_every_file(spark, folder):
    statement.register(spark)
    read = lambda **o: spark.read.format("statement").options(**o).load(str(folder))
    got = seen(read(maxBytes=20_000, partitionBytes=500))
    assert got == seen(statement.records(spark, f"file://{folder}", 20_000))
    assert read(partitionBytes=500).rdd.getNumPartitions() > 2 and read().rdd.getNumPartitions() == 1
    files = {r.file.rpartition("/")[2]: r for r in statement.files(read(maxBytes=20_000)).collect()}
    assert len(files) == len(list(folder.iterdir()))
    assert {n: f.kind for n, f in files.items() if f.problem is None} == {"t.csv": "lines", "r.csv": "lines", "s.csv": "lines", "a.xlsx": "cells", "q.jsonl": "words", "odd.txt": "lines", "empty.csv": "lines", "pages.pdf": None}
    assert "larger" in files["large.csv"].problem and "BadZipFile" in files["broken.xlsx"].problem
    assert "intesa sanpaolo" in files["q.jsonl"].head and files["t.csv"].head.startswith("date,type")
    assert spark.read.format("statement").load(f"file://{folder}/t.csv").where("line IS NOT NULL").count() == 5


def test_new_files_are_a_stream(spark, folder, tmp_path):
    statement.register(spark)

    def run():
        rows = statement.files(spark.readStream.format("statement").load(str(folder)))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted(r.file.rpartition("/")[2] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    there = sorted(p.name for p in folder.iterdir())
    assert run() == there and run() == there
    (folder / "new.csv").write_text("revolut")
    assert run() == sorted([*there, "new.csv"])


def test_a_mixed_folder_becomes_a_ledger(spark, folder, tmp_path):
    ledger, words = f"{tmp_path}/ledger", Vocabulary(banks={"05428": "One Bank"})
    rows = statement.records(spark, f"file://{folder}", 20_000)
    got = loading.load(spark, ledger, rows, vocabulary=words)
    assert (got.new, got.enriched, got.parsed, got.failed) == (8, 0, 5, 5)
    read = lambda name: loading.table(spark, ledger, name).read().collect()
    found = {(r.source, r.description, str(r.amount)): r for r in read("transactions")}
    assert set(found) == {
        ("trade_republic", "Pizza place", "-5.0000"), ("trade_republic", "ETF - Plan", "-100.0000"), ("trade_republic", "Bonifico disposto", "-70.0000"), ("revolut", "Top-up by *1234 once more", "70.0000"),
        ("intesa", "Pagamento su POS BAR 17/031245 x", "-12.5000"), ("intesa", "Stipendio", "1234.5600"), ("intesa", "Affitto casa", "-30.0000"), ("intesa", "Rimborso spese", "200.0000"),
    }
    bar = found["intesa", "Pagamento su POS BAR 17/031245 x", "-12.5000"]
    assert (bar.merchant, bar.purchase_time, bar.native_category, str(bar.value_date)) == ("BAR", "12:45", "Bar", "2023-03-15")
    assert found["intesa", "Affitto casa", "-30.0000"].booking_date == date(2025, 2, 2) and all(r.id and r.created_at for r in found.values())
    # Two files of one load have the movement, the second says more: the rest is as if they had come one after the other.
    assert found["trade_republic", "Bonifico disposto", "-70.0000"].transfer_group == found["revolut", "Top-up by *1234 once more", "70.0000"].transfer_group is not None
    assert [(r.side, r.isin, r.quantity) for r in read("trades")] == [("buy", "IE1", Decimal("2.5"))]
    assert {(r.account, str(r.balance)) for r in read("balances")} >= {("revolut_personal_eur", "171.00")}
    assert {r.account_id: r.bank_name for r in read("accounts")}["revolut_personal_eur"] == "One Bank"
    status = {r.filename.rpartition("/")[2]: (r.status, r.rows_total, r.rows_new, r.error) for r in read("raw_files")}
    assert {n: s[:3] for n, s in status.items() if s[0] == "parsed"} == {"t.csv": ("parsed", 3, 3), "r.csv": ("parsed", 1, 1), "s.csv": ("parsed", 1, 0), "a.xlsx": ("parsed", 2, 2), "q.jsonl": ("parsed", 2, 2)}
    assert "larger" in status["large.csv"][3] and "can't be read" in status["broken.xlsx"][3] and all(status[n][3].startswith("Unrecognized") for n in ("odd.txt", "empty.csv", "pages.pdf"))

    # A correction stays through a load by force, which finds nothing new.
    key = found["trade_republic", "Pizza place", "-5.0000"].natural_key
    loading.correct(spark, ledger, spark.createDataFrame([(1, key, "groceries", "me"), (2, key, "leisure", "me")], "id long, natural_key string, category string, corrected_by string"))
    again = loading.load(spark, ledger, rows, force=True, vocabulary=words, link=False)
    assert (again.new, again.enriched, again.parsed) == (0, 0, 5)
    now = {r.natural_key: r for r in read("transactions")}
    assert (now[key].category, now[key].category_source) == ("leisure", "manual") and len(now) == 8
    assert {r.filename.rpartition("/")[2]: r.rows_new for r in read("raw_files")}["t.csv"] == 0
    with pytest.raises(ValueError):
        loading.load(spark, ledger, rows, "nobody")
