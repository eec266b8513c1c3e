"""Versioned tables: a manifest of snapshots over buckets of keys.

    TABLE/versions/00000007.json    what version 7 consists of
    TABLE/data/<write>/bucket=3/... Parquet files, written once and never changed

A version names, for each bucket of keys, the write that its files are from. A
change writes new files for the buckets it touches and then puts the next
manifest in place, which either happens or doesn't: readers see a version or the
one before it, and a load that is killed leaves files that no version names. Two
changes from one version are no conflict unless they touch the same buckets; the
later one then starts anew from what the other made.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

BUCKETS = 64
ATTEMPTS = 8


class Conflict(RuntimeError):
    """Another change of the same buckets came first."""


@dataclass(frozen=True)
class Version:
    """One snapshot: its number, the schema, the keys, and the write of each bucket that has rows."""

    number: int
    schema: str
    keys: tuple[str, ...]
    buckets: int
    writes: dict[int, str] = field(default_factory=dict)
    note: str = ""
    at: str = ""


class Table:
    """A table at a path that all machines share. ``keys`` place a row; rows of one bucket of keys are rewritten together.

    More buckets make smaller rewrites: with buckets of some 64 MB a batch of m keys
    rewrites m buckets at most, however large the table is.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------- manifests
    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        """The numbers there are, the newest last."""
        folder = self._at("versions")
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def version(self, number: int | None = None) -> Version | None:
        """A snapshot, the newest by default; None if the table is new. KeyError if there is none of that number."""
        known = self.versions()
        if number is None and not known:
            return None
        if number is not None and number not in known:
            raise KeyError(number)
        stream = self._files.open(self._at("versions", f"{known[-1] if number is None else number:08d}.json"))
        try:
            d = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        return Version(d["number"], d["schema"], tuple(d["keys"]), d["buckets"], {int(k): v for k, v in d["writes"].items()}, d["note"], d["at"])

    def _put(self, v: Version) -> bool:
        """Write a manifest beside its place and move it there; False if the place is taken."""
        folder = self._at("versions")
        self._files.mkdirs(folder)
        temporary = self._at("versions", f".{uuid.uuid4().hex}")
        out = self._files.create(temporary, True)
        try:
            out.write(bytearray(json.dumps(v.__dict__).encode()))
        finally:
            out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._context.rename(temporary, self._at("versions", f"{v.number:08d}.json"), options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self._files.delete(temporary, False)
            return False
        return True

    # ----------------------------------------------------------------- reading
    def _bucket(self, keys: tuple[str, ...], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _rows(self, v: Version, buckets: list[int] | None = None) -> DataFrame:
        chosen = sorted(v.writes if buckets is None else set(buckets) & set(v.writes))
        schema = _parse_datatype_string(v.schema)
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{v.writes[b]}/bucket={b}" for b in chosen])

    def read(self, number: int | None = None) -> DataFrame:
        """A version's rows. What is read stays what it was, whatever is written after."""
        v = self.version(number)
        if v is None:
            raise KeyError(self.path)
        return self._rows(v)

    # ----------------------------------------------------------------- writing
    def create(self, schema: str | StructType, keys: list[str], buckets: int = BUCKETS) -> Version:
        """The table, empty if it isn't there yet."""
        ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        if (v := self.version()) is None:
            self._put(Version(0, ddl, tuple(keys), buckets, {}, "created", _now()))
            v = self.version()
        return v

    def _write(self, rows: DataFrame, v: Version) -> tuple[str, list[int]]:
        """Write rows by bucket; (write, buckets that have rows)."""
        write = uuid.uuid4().hex
        names = [f.name for f in _parse_datatype_string(v.schema).fields]
        dealt = rows.select(*names, self._bucket(v.keys, v.buckets).alias("bucket")).repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/data/{write}")
        found = [f.getPath().getName() for f in self._files.listStatus(self._at("data", write))]
        return write, sorted(int(n.partition("=")[2]) for n in found if n.startswith("bucket="))

    def change(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], note: str = "", attempts: int = ATTEMPTS) -> Version:
        """``merge(rows, batch)`` in place of the rows in the batch's buckets.

        The batch has the table's keys; of the rows, those in buckets of its keys are
        read and written, no others. A row must stay in its bucket.
        """
        for _ in range(attempts):
            base = self.version()
            if base is None:
                raise KeyError(self.path)
            touched = sorted(r[0] for r in batch.select(self._bucket(base.keys, base.buckets)).distinct().collect())  # as many numbers as there are buckets
            if not touched:
                return base
            write, filled = self._write(merge(self._rows(base, touched), batch), base)
            if set(filled) - set(touched):
                raise ValueError("a merge must keep to the keys of its batch")
            try:
                return self._commit(base, touched, {b: write for b in filled}, note)
            except Conflict:
                self._files.delete(self._at("data", write), True)
        raise Conflict(f"{self.path}: {attempts} attempts")

    def overwrite(self, rows: DataFrame, note: str = "") -> Version:
        """All rows anew. ``rows`` may be made of the table's own."""
        base = self.version()
        if base is None:
            raise KeyError(self.path)
        write, filled = self._write(rows, base)
        return self._commit(base, list(range(base.buckets)), {b: write for b in filled}, note)

    def _commit(self, base: Version, touched: list[int], writes: dict[int, str], note: str) -> Version:
        """The next version after the newest, unless a bucket of this change has changed since ``base``."""
        while True:
            newest = self.version()
            if any(newest.writes.get(b) != base.writes.get(b) for b in touched):
                raise Conflict(self.path)
            kept = {b: w for b, w in newest.writes.items() if b not in set(touched)}
            v = Version(newest.number + 1, newest.schema, newest.keys, newest.buckets, kept | writes, note, _now())
            if self._put(v):
                return v

    def restore(self, number: int) -> Version:
        """The newest version, made of what version ``number`` was."""
        old, base = self.version(number), self.version()
        return self._commit(base, list(range(base.buckets)), old.writes, f"restored {number}")

    def expire(self, keep: int = 10) -> list[str]:
        """Delete all but the newest versions, and the writes that none of those has; returns the writes. Not for use beside a change that is under way."""
        known = self.versions()
        for n in known[:-keep]:
            self._files.delete(self._at("versions", f"{n:08d}.json"), False)
        used = {w for n in known[-keep:] for w in self.version(n).writes.values()}
        data = self._at("data")
        there = [f.getPath().getName() for f in self._files.listStatus(data)] if self._files.exists(data) else []
        gone = [w for w in there if w not in used]
        for w in gone:
            self._files.delete(self._at("data", w), True)
        return gone


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")
