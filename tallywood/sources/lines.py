"""Text files as numbered lines, cells of CSV lines, heads, and the file listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 4096


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of all text files under a path. A statement is a small file; a task reads whole ones."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    return number_lines(whole)


def number_lines(files: DataFrame) -> DataFrame:
    """(file, line_no, line) from (file, body)."""
    body = F.regexp_replace("body", "^﻿", "")
    return files.select("file", F.posexplode(F.split(body, "\r\n|\n|\r")).alias("line_no", "line"))


def heads(files: DataFrame) -> DataFrame:
    """(file, head): the first characters of each file's text, in lower case."""
    return files.select("file", F.lower(F.substring("body", 1, HEAD)).alias("head"))


def read_files(spark: SparkSession, path: str, most_bytes: int = 10 << 20) -> DataFrame:
    """(file, sha256, size, body) of files up to a size; larger ones are never read."""
    f = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes)
    return f.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("content").cast("string").alias("body"))


def cells(line: Column) -> Column:
    """The trimmed cells of a CSV line; quoted cells may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]++|"")*"|[^,]*)'), F.lit(1))
    quoted = lambda c: c.startswith('"') & c.endswith('"') & (F.length(c) > 1)
    return F.transform(raw, lambda c: F.trim(F.when(quoted(c), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)))


def cell(row: Column, n: int) -> Column:
    """The n-th cell from 0, '' if there are fewer."""
    return F.coalesce(F.get(row, F.lit(n)), F.lit(""))
