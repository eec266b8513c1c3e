"""Statement files of any kind as rows: ``spark.read.format("statement").load(folder)``.

A file is a row with its head, size and hash, and, below it, its lines, cells
or words, which is what the adapters read. A file that can't be read, or is over
the size, is a row with a ``problem``: none is passed over. ``records`` reads
the same by Spark's own reader, for folders that only Spark can open; the data
source also comes as a stream of new files.

Kinds go by suffix: .csv and .txt are lines, .xlsx cells, .jsonl word tables
(a line [page, top, x0, x1, text] for each word, as a page decoder writes them).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .lines import HEAD
from .xlsx import sheet_rows

MOST_BYTES = 10 << 20
#: Files of one partition of the data source are of so many bytes, or one file.
PARTITION_BYTES = 32 << 20
RECORD = "file string, sha256 string, size long, kind string, problem string, head string, line_no long, line string, cells map<string,string>, page int, top double, x0 double, x1 double, text string"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "map<string,string>": pa.map_(pa.string(), pa.string())}
ARROW = pa.schema([(c.split(" ")[0], _TYPES[c.split(" ")[1]]) for c in RECORD.split(", ")])
KINDS = {"csv": "lines", "txt": "lines", "xlsx": "cells", "jsonl": "words"}
SHEET_HEAD = 26


def too_large(size: int, most_bytes: int) -> str:
    return f"larger than {most_bytes} bytes: {size}"


def decode(file: str, body: bytes) -> Iterator[dict]:
    """The rows of one file, the file's own first."""
    kind = KINDS.get(file.rpartition(".")[2].lower())
    own = {"file": file, "sha256": hashlib.sha256(body).hexdigest(), "size": len(body), "kind": kind}
    try:
        head, parts = _parts(kind, body)
    except Exception as e:  # whatever is wrong with a file is said of that file
        yield own | {"problem": f"can't be read: {type(e).__name__}: {e}"[:500]}
        return
    yield own | {"head": head.lower()}
    for part in parts:
        yield {"file": file, "kind": kind} | part


def _parts(kind: str | None, body: bytes) -> tuple[str, list[dict]]:
    if kind == "cells":
        rows = sheet_rows(body)
        return " ".join(v for _, row in rows[:SHEET_HEAD] for _, v in row if v), [{"line_no": n, "cells": row} for n, row in rows]
    text = body.decode("utf-8", "replace").removeprefix("﻿")
    if kind == "lines":
        return text[:HEAD], [{"line_no": i, "line": line} for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))]
    if kind == "words":
        words = [json.loads(line) for line in text.splitlines() if line.strip()]
        first = sorted((w for w in words if w[0] == 1), key=lambda w: (round(w[1]), w[2]))
        return " ".join(str(w[4]) for w in first), [dict(zip(("page", "top", "x0", "x1", "text"), (int(p), float(t), float(a), float(z), str(x)), strict=True)) for p, t, a, z, x in words]
    return "", []


def _batches(rows: Iterator[dict], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    have = []
    for row in rows:
        have.append(row)
        if len(have) >= most:
            yield pa.RecordBatch.from_pylist(have, ARROW)
            have = []
    if have:
        yield pa.RecordBatch.from_pylist(have, ARROW)


# -------------------------------------------------------------- Spark's reader
def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield from _batches(decode(batch.column("path")[i].as_py(), batch.column("content")[i].as_py()))


def _empty(spark: SparkSession, path: str) -> DataFrame:
    """The rows of files without a byte, which Spark's readers pass over."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    listed = [f for top in found or [] for f in (top.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top.getPath()) if top.isDirectory() else [top])]
    names = [f.getPath().toString() for f in listed if f.isFile() and f.getLen() == 0 and f.getPath().getName()[0] not in "._"]
    return spark.createDataFrame([(n, b"") for n in names], "path string, content binary").mapInArrow(_run, RECORD)


def records(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(RECORD) of the files in a folder, or of a pattern. Files over the size are not read."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= most_bytes).select("path", "content").mapInArrow(_run, RECORD)
    said = F.concat(F.lit(f"larger than {most_bytes} bytes: "), F.col("length").cast("string"))
    large = files.where(F.col("length") > most_bytes).select(F.col("path").alias("file"), F.col("length").alias("size"), said.alias("problem"))
    return small.unionByName(_empty(spark, path)).unionByName(large, allowMissingColumns=True)


# ---------------------------------------------------------------- data source
@dataclass
class Files(InputPartition):
    """(path, size) of the files that one task reads."""

    files: tuple[tuple[str, int], ...]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listing(path: str) -> list[tuple[int, str, int]]:
    """(time of change, path, size) of the files under a folder, the oldest first."""
    from pyarrow import fs

    system, at = _filesystem(path)
    infos = system.get_file_info(fs.FileSelector(at, recursive=True)) if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in infos if f.type == fs.FileType.File and f.base_name[0] not in "._")


def packed(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """Files dealt into partitions of so many bytes, or one file."""
    out, have, size = [], [], 0
    for _, path, n in files:
        if have and size + n > most:
            out.append(Files(tuple(have)))
            have, size = [], 0
        have.append((path, n))
        size += n
    return [*out, Files(tuple(have))] if have else out


class _Reading:
    """What reading and streaming share."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.most_bytes = int(options.get("maxbytes", MOST_BYTES))
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        for path, size in partition.files:
            if size > self.most_bytes:
                yield from _batches(iter([{"file": path, "size": size, "problem": too_large(size, self.most_bytes)}]))
                continue
            with system.open_input_stream(path) as f:
                yield from _batches(decode(path, f.read()))


class StatementReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return packed(listing(self.path), self.partition_bytes) or [Files(())]


class StatementStreamReader(_Reading, DataSourceStreamReader):
    """New files by time of change and path; an offset is the last file that was taken."""

    def initialOffset(self) -> dict:
        return {"time": "0", "path": ""}

    def latestOffset(self) -> dict:
        files = listing(self.path)
        return {"time": str(files[-1][0]), "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((int(o["time"]), o["path"]) for o in (start, end))
        return packed([f for f in listing(self.path) if low < (f[0], f[1]) <= high], self.partition_bytes)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class StatementSource(DataSource):
    """Options: path, maxBytes (files over it are reported, not read), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "statement"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> StatementReader:
        return StatementReader(self.options)

    def streamReader(self, schema) -> StatementStreamReader:
        return StatementStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("statement")`` known to a session."""
    spark.dataSource.register(StatementSource)


# --------------------------------------------------------- what adapters read
def files(rows: DataFrame) -> DataFrame:
    """(file, sha256, size, kind, problem, head), one row per file."""
    return rows.where("size IS NOT NULL").select("file", "sha256", "size", "kind", "problem", "head")


def lines(rows: DataFrame) -> DataFrame:
    return rows.where("line IS NOT NULL").select("file", "line_no", "line")


def cells(rows: DataFrame) -> DataFrame:
    return rows.where("cells IS NOT NULL").select("file", F.col("line_no").alias("row_no"), "cells")


def words(rows: DataFrame) -> DataFrame:
    return rows.where("text IS NOT NULL").select("file", "page", "top", "x0", "x1", "text")
