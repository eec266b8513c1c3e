"""Pages of a sorted table by seeking instead of skipping.

A table is written once in order, dealt by ranges into files of bounded size. Of
each file the rows before it and its first and last row are known, so a page
reads the files that hold it, one or two, however deep it lies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (column, descending, nulls first)
Order = list[tuple[str, bool, bool]]


def ordering(order: Order) -> list[Column]:
    """Sort expressions."""
    name = {(False, True): "asc_nulls_first", (False, False): "asc_nulls_last", (True, True): "desc_nulls_first", (True, False): "desc_nulls_last"}
    return [getattr(F.col(c), name[down, first])() for c, down, first in order]


def follows(values: list[Column], last: list[Column], order: Order) -> Column:
    """Whether a row with these values comes after ``last`` in the order."""

    def beyond(v: Column, x: Column, down: bool, nulls_first: bool) -> Column:
        plain = v < x if down else v > x
        return F.when(v.isNull() & x.isNull(), False).when(v.isNull(), not nulls_first).when(x.isNull(), nulls_first).otherwise(plain)

    out = F.lit(False)
    for v, x, (_, down, first) in reversed(list(zip(values, last, order, strict=True))):
        out = F.coalesce(beyond(v, x, down, first), F.lit(False)) | (v.eqNullSafe(x) & out)
    return out


class SortedPages:
    """A table in order at a path. The order should tell all rows apart, or pages by key can't."""

    def __init__(self, spark: SparkSession, path: str, order: Order) -> None:
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    def write(self, rows: DataFrame, files: int) -> SortedPages:
        """Write the table into some ``files`` by ranges, and what is known of each."""
        keys = ordering(self.order)
        rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.parquet(f"{self.path}/rows")
        # Ranges go by the number of the part, rows by their place in the file.
        key, at = F.struct(*[c for c, _, _ in self.order]), F.col("_metadata.row_index")
        told = self.spark.read.parquet(f"{self.path}/rows").select(F.col("_metadata.file_name").alias("file"), at.alias("at"), key.alias("key"))
        told = told.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))
        before = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each file
        told.withColumn("before", before).write.parquet(f"{self.path}/bounds")
        return self

    def _bounds(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/bounds")

    def _rows(self, files: list) -> DataFrame:
        """The rows of some files with their place in the whole table."""
        read = self.spark.read.parquet(f"{self.path}/rows")
        if not files:
            return read.limit(0).withColumn("_place", F.lit(0).cast("long"))
        some = self.spark.read.schema(read.schema).parquet(*[f"{self.path}/rows/{f.file}" for f in files])
        start = reduce(lambda c, f: c.when(F.col("_metadata.file_name") == f.file, f.before), files[1:], F.when(F.col("_metadata.file_name") == files[0].file, files[0].before))
        return some.withColumn("_place", start + F.col("_metadata.row_index"))

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset, offset + 1 ... of the order."""
        held = self._bounds().where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).select("file", "before").orderBy("file").collect()  # files that hold the page
        found = self._rows(held).where((F.col("_place") >= offset) & (F.col("_place") < offset + limit))
        return found.orderBy("_place").drop("_place")

    def after(self, last: tuple | None, limit: int) -> DataFrame:
        """The page behind a row, given by its values in the order; the first page for None."""
        if last is None:
            return self.page(0, limit)
        types = {f.name: f.dataType for f in self.spark.read.parquet(f"{self.path}/rows").schema.fields}
        given = [F.lit(v).cast(types[c]) for v, (c, _, _) in zip(last, self.order, strict=True)]
        bounds = self._bounds().where(follows([F.col(f"last.{c}") for c, _, _ in self.order], given, self.order)).select("file", "before", "n")
        first = bounds.orderBy("file").first()
        if first is None:
            return self._rows([]).drop("_place")
        # The first of these may have but one row behind ``last``; with the files that the next rows are in there are enough.
        held = bounds.where(F.col("before") < first.before + first.n + limit).orderBy("file").collect()
        found = self._rows(held).where(follows([F.col(c) for c, _, _ in self.order], given, self.order))
        return found.orderBy("_place").limit(limit).drop("_place")
