"""A text classifier: hashed character n-grams with learned weights, and the nearest examples.

What is learned from a corpus is one weight for each of ``dims`` hash buckets, from
the number of texts that have it: a distributed count, of which ``dims`` numbers
reach the driver. A text is a unit vector over the buckets; its label is that of
its nearest examples (see ``categorize.knn``).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import vocabulary as V
from .categorize import knn, macro_f1, promote, vote

DIMS, GRAM = 256, 3


def grams(text: Column, n: int = GRAM) -> Column:
    """The character n-grams of a normalised text with a space on either side; none of an empty one."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    many = F.length(padded) - (n - 1)
    return F.when((text != "") & (many > 0), F.transform(F.sequence(F.lit(1), many), lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def buckets(text: Column, dims: int = DIMS, n: int = GRAM) -> Column:
    """The bucket of each n-gram, by the first 32 bits of its MD5, so that any engine agrees."""
    return F.transform(grams(text, n), lambda g: F.pmod(F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int"))


def text_id(text: Column) -> Column:
    """A number for a text: 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


class _Buckets(dict):
    """The bucket of each n-gram met so far; of normalised text there are some 50,000 trigrams."""

    def __init__(self, dims: int) -> None:
        super().__init__()
        self.dims = dims

    def __missing__(self, gram: str) -> int:
        self[gram] = found = int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % self.dims
        return found


@cache
def _known(dims: int) -> _Buckets:
    return _Buckets(dims)


def _counted(texts: list[str | None], dims: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the n-grams of some texts, as :func:`buckets` has them."""
    known, flat, size = _known(dims), [], []
    for text in texts:
        padded = f" {text} " if text else ""
        of = [known[padded[i : i + n]] for i in range(len(padded) - n + 1)]
        flat += of
        size.append(len(of))
    cells, count = np.unique(np.repeat(np.arange(len(size)), size) * dims + np.array(flat, np.int64), return_counts=True)
    return cells // dims, cells % dims, count


def _weighted(texts: list[str | None], idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the unit vectors of some texts."""
    row, bucket, count = _counted(texts, len(idf), n)
    w = count * idf[bucket]
    norm = np.sqrt(np.bincount(row, w * w, len(texts)))
    return row, bucket, w / norm[row]


def dense(texts, idf: np.ndarray, n: int) -> np.ndarray:
    """The unit vectors of some texts as rows of a matrix."""
    row, bucket, w = _weighted(list(texts), idf, n)
    m = np.zeros((len(texts), len(idf)))
    m[row, bucket] = w
    return m


def weights(texts: DataFrame, dims: int = DIMS, n: int = GRAM) -> list[float]:
    """ln((1 + N) / (1 + texts with the bucket)) + 1 for each bucket, from a table of texts."""

    def count(batches):
        seen, total = np.zeros(dims, np.int64), 0
        for batch in batches:
            _, bucket, _ = _counted(batch.column(0).to_pylist(), dims, n)
            seen += np.bincount(bucket, minlength=dims)
            total += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1), pa.int32()), pa.array([*seen, total], pa.int64())], names=["b", "n"])

    got = texts.select("text").mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()  # dims + 1 rows
    with_it = np.zeros(dims + 1)
    with_it[[r.b for r in got]] = [r.n for r in got]
    return (np.log((1 + with_it[dims]) / (1 + with_it[:dims])) + 1).tolist()


def _vectors(idf: list[float], n: int):
    @F.arrow_udf("array<double>")
    def vectors(column: pa.Array) -> pa.Array:
        m = dense(column.to_pylist(), np.array(idf), n)
        return pa.ListArray.from_arrays(np.arange(0, m.size + 1, len(idf), dtype=np.int32), m.ravel())

    return vectors


def _features(idf: list[float], n: int):
    @F.arrow_udf("array<struct<bucket: int, weight: double>>")
    def features(column: pa.Array) -> pa.Array:
        row, bucket, w = _weighted(column.to_pylist(), np.array(idf), n)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)))]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(bucket, pa.int32()), pa.array(w, pa.float64())], ["bucket", "weight"]))

    return features


@dataclass(frozen=True)
class TextModel:
    """Weights and examples (text, category). ``dims`` is the number of weights."""

    idf: list[float]
    examples: DataFrame
    n: int = GRAM
    k: int = V.NEIGHBOURS

    def vectors(self, rows: DataFrame) -> DataFrame:
        """Rows with the unit vector of their text; an empty text has the zero vector."""
        return rows.withColumn("vector", _vectors(self.idf, self.n)(F.col("text")))

    def features(self, rows: DataFrame) -> DataFrame:
        """Rows with what their vector has beside zeros, as an array of (bucket, weight)."""
        return rows.withColumn("features", _features(self.idf, self.n)(F.col("text")))

    def predict(self, texts: DataFrame) -> DataFrame:
        """(text, predicted, confidence) of distinct texts; an empty one, and one without an n-gram in common with any example, has the default category."""
        # Texts travel, and become vectors in the task that compares them.
        asked = texts.select("text").distinct().withColumn("query_id", text_id(F.col("text")))
        known = self.examples.select(F.col("text").alias("vector"), F.col("category").alias("label"), text_id(F.col("text")).alias("vec_id"))
        idf, n = np.array(self.idf), self.n
        near = knn(asked.where("text <> ''").select("query_id", F.col("text").alias("vector")), known, self.k, dense=lambda column: dense(column, idf, n))
        best = vote(near).where("confidence > 0")
        got = asked.select("text", "query_id").join(best, "query_id", "left")
        return got.select("text", F.coalesce("label", F.lit(V.DEFAULT)).alias("predicted"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))

    def score(self, held_out: DataFrame) -> DataFrame:
        """(accuracy, macro_f1, n_labels) on rows (text, category)."""
        return macro_f1(held_out.join(self.predict(held_out), "text").select(F.col("category").alias("actual"), "predicted"))


def fit(rows: DataFrame, dims: int = DIMS, n: int = GRAM, k: int = V.NEIGHBOURS) -> TextModel:
    """A model of rows (text, category), a row for each text."""
    return TextModel(weights(rows.select("text"), dims, n), rows.select("text", "category"), n, k)


def challenge(challenger: TextModel, champion: TextModel | None, held_out: DataFrame) -> tuple[TextModel, float, float | None]:
    """(the model that stays, the challenger's and the champion's macro F1): both are scored on the same held-out rows, and a tie goes to the challenger."""
    new = challenger.score(held_out).first().macro_f1
    old = None if champion is None else champion.score(held_out).first().macro_f1
    return (challenger if promote(new, old) else champion), new, old
