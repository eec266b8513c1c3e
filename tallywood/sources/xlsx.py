"""Spreadsheet statements: cells of the first sheet by Arrow batches, the rest as expressions.

A sheet is zipped XML, which no built-in expression opens; a file is one row, of bounded size.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import parse_day_first, parse_money

CELLS = "file string, row_no long, cells map<string,string>"
_TAG = re.compile(r"\{.*?\}")


def _name(e) -> str:
    return _TAG.sub("", e.tag)


def _text(e) -> str:
    return "".join(t.text or "" for t in e.iter() if _name(t) == "t")


def sheet_rows(content: bytes) -> list[tuple[int, list[tuple[str, str]]]]:
    """(row number, [(column letters, text)]) of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))
        out = []
        for row in (e for e in ElementTree.fromstring(z.read(sheet)).iter() if _name(e) == "row"):
            got = []
            for c in row:
                value = next((v.text or "" for v in c if _name(v) == "v"), "")
                kind = c.get("t")
                value = shared[int(value)] if kind == "s" else _text(c) if kind == "inlineStr" else value
                got.append((re.match(r"[A-Z]+", c.get("r"))[0], value.strip()))
            out.append((int(row.get("r")), got))
        return out


def _run(batches):
    for batch in batches:
        rows = [(f, n, c) for f, body in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True) for n, c in sheet_rows(body)]
        kinds = (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "row_no", "cells"])


def read_cells(spark: SparkSession, path: str, most_bytes: int = 10 << 20) -> DataFrame:
    """One row per sheet row. A file over the size is an error; ``statement.records`` reports such files instead."""
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > most_bytes).select("path").take(1)
    if large:
        raise ValueError(f"{large[0].path} is larger than {most_bytes} bytes")
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), "content").mapInArrow(_run, CELLS)


def movements(rows: DataFrame, category: bool = False) -> DataFrame:
    """(file, line_no, value_date, amount, currency, description) below the row that has both Data and Importo, and the native_category if wanted.

    Amounts are numbers or Italian text; dates are day-first text or day serials.
    Other currencies than EUR, zero and unreadable amounts and rows without a date are left out.
    """
    head = F.array_contains(F.map_values("cells"), "Data") & F.array_contains(F.map_values("cells"), "Importo")
    names = F.last(F.when(head, F.map_from_entries(F.transform(F.map_entries(F.map_filter("cells", lambda k, v: v != "")), lambda e: F.struct(e["value"], e["key"])))), True)
    named = rows.withColumn("head", head).withColumn("names", names.over(W.partitionBy("file").orderBy("row_no"))).where("names IS NOT NULL AND NOT head")
    at = lambda n: F.nullif(F.try_element_at("cells", F.try_element_at("names", F.lit(n))), F.lit(""))
    raw, day = at("Importo"), at("Data")
    plain = r"^-?\d+(\.\d+)?([eE]-?\d+)?$"
    amount: Column = F.when(raw.rlike(plain), raw.try_cast("double").cast("decimal(18,4)")).otherwise(parse_money(raw, ".", ","))
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(day.try_cast("double")).cast("int"))
    date = F.when(day.rlike(r"^\d+(\.\d+)?$"), serial).otherwise(parse_day_first(day))
    text = F.concat_ws(" ", at("Operazione"), at("Dettagli"))
    got = named.select("file", F.col("row_no").alias("line_no"), *([at("Categoria").alias("native_category")] if category else []), date.alias("value_date"), F.round(amount, 2).cast("decimal(18,2)").alias("amount"), F.coalesce(at("Valuta"), F.lit("EUR")).alias("currency"), text.alias("description"))
    return got.where("currency = 'EUR' AND amount <> 0 AND value_date IS NOT NULL")


def bank_sheet(rows: DataFrame) -> DataFrame:
    """The bank's list of operations, in the ledger's columns."""
    got = movements(rows, category=True)
    return got.select("file", "line_no", F.lit("intesa").alias("account"), "value_date", F.col("value_date").alias("booking_date"), "description", F.col("amount").cast("decimal(18,4)").alias("amount"), "currency", F.lit("intesa").alias("source"), "native_category")
