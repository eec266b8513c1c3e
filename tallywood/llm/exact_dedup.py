"""Exact dedup with an extendible-hash index on shared files (DataFrame and SQL functions only).

A key is the 64-bit hash of the text. The directory names a bucket for every
prefix of the key. It starts with one bucket; a bucket with more distinct keys
than ``capacity`` is split by one more bit, and the directory doubles when the
split bucket was as deep as the directory. Texts arrive pre-aggregated; the
directory sends them to the owner of their bucket, which compares them byte by
byte: an entry of the same bytes takes an arrival in, another text goes into its
key's chain. The answer for a document is read from its bucket. A key with one
entry can have no other text, as all were inserted; along a chain, bytes are
compared again. Directory and buckets are Parquet tables in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import partitions, saved

#: Bits by which the directory may double before overfull buckets are counted again.
BITS = 8
#: A directory of up to so many cells (16 bytes each) is sent to all tasks; a larger one is joined by shuffle.
SENT = 1 << 16
#: Arrivals of one text: a text that many rows have reaches its owner in so many rows at most.
ARRIVALS = 16


@dataclass
class HashIndex:
    """The index on shared files: ``cells`` is the directory, ``depth`` its bits, ``entries`` the buckets' contents."""

    cells: DataFrame
    depth: int
    entries: DataFrame

    def route(self, rows: DataFrame, key: str = "key") -> DataFrame:
        """Rows with the bucket, and its local depth, that the directory names for their key."""
        return _route(rows, self.cells, self.depth, key)


def _key(text: Column, bits: int = 64) -> Column:
    """The key: a hash of the text, of which a test may keep the first bits only."""
    if bits == 0:
        return F.lit(0).cast("long")
    return F.xxhash64(text) if bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - bits), 64 - bits)


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def _route(rows: DataFrame, cells: DataFrame, depth: int, key: str = "key") -> DataFrame:
    cells = F.broadcast(cells) if 1 << depth <= SENT else cells
    return rows.withColumn("cell", _prefix(F.col(key), depth)).join(cells, "cell").drop("cell")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(directory, global depth): a row (cell, bucket, depth) for each prefix of as many bits as the directory is deep.

    ``keys`` holds each distinct key once. A pass counts the keys of the buckets
    that are still overfull at the next BITS bits and splits them as far as that
    goes; a bucket is named by its first key prefix, filled up with zeros. Two
    keys differ in some bit, so splitting ends, at 64 bits at the latest.
    """
    spark, closed, full, depth = keys.sparkSession, None, keys.select("key"), 0
    while True:
        deeper = min(depth + BITS, 64)
        counts = full.groupBy(_prefix(F.col("key"), deeper).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        levels = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("cell", deeper - d).alias("prefix") if d else F.lit(0).cast("long").alias("prefix")) for d in range(depth, deeper + 1)]))
        sums = saved(counts.select("n", levels.alias("x")).groupBy("x.depth", "x.prefix").agg(F.sum("n").alias("n")), "splits")
        above = sums.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        halves = above.select("depth", F.explode(F.array(F.shiftleft("above", 1), F.shiftleft("above", 1) + 1)).alias("prefix"))
        if depth == 0:
            halves = halves.union(spark.sql("SELECT 0 AS depth, CAST(0 AS BIGINT) AS prefix"))
        # Both halves of a split bucket are in the directory, an empty one too.
        leaves = halves.join(sums, ["depth", "prefix"], "left").where(f"depth <= {deeper} AND coalesce(n, 0) <= {capacity}").select("depth", "prefix")
        closed = leaves if closed is None else closed.union(leaves)
        over = sums.where(f"depth = {deeper} AND n > {capacity}").select(F.col("prefix").alias("over"))
        if deeper == 64 or over.isEmpty():
            break
        full = saved(full.withColumn("over", _prefix(F.col("key"), deeper)).join(over, "over", "left_semi").select("key"), "overfull")
        depth = deeper
    leaves = saved(closed, "buckets")
    deepest = int(leaves.agg(F.max("depth")).first()[0])
    shift = F.lit(deepest) - F.col("depth")
    first = F.expr(f"shiftleft(prefix, {deepest} - depth)")
    cells = leaves.select(F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {deepest} - depth)") - 1)).alias("cell"), F.expr("shiftleft(prefix, 64 - depth)").alias("bucket"), "depth").where(shift >= 0)
    return saved(cells, "directory"), deepest


def _inserted(arrivals: DataFrame, parts: int, least) -> DataFrame:
    """The buckets' entries (bucket, depth, key, chain, chained, text, digest, length, keep_id, group_size): what owners make of the arrivals.

    A bucket is a range of keys and has one owner. Under a key, entries are told
    apart by their bytes; those of a chain keep their text for the look-up.
    """
    owned = arrivals.repartition(parts, "bucket")
    entries = owned.groupBy("bucket", "depth", "key", "text").agg(least("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    entries = entries.withColumns({"digest": _digest(F.col("text")), "length": F.octet_length("text")})
    same = W.partitionBy("bucket", "key")
    entries = entries.withColumns({"chain": F.row_number().over(same.orderBy("digest", "text")), "chained": F.count(F.lit(1)).over(same) > 1})
    return entries.withColumn("text", F.when(F.col("chained"), F.col("text")))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 4096, keep: str = "max", bits: int = 64) -> HashIndex:
    """Index every distinct text with the row that stays and the number of rows.

    Only the directory's depth reaches the driver.
    """
    least = F.min if keep == "min" else F.max
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", _key(F.col("text"), bits)).withColumn("turn", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    cells, depth = directory(saved(rows.select("key").distinct(), "keys"), capacity)
    # Rows meet before the shuffle: a task sends one for each text and turn it has seen.
    arrivals = rows.groupBy("key", "text", "turn").agg(least("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).drop("turn")
    entries = _inserted(_route(arrivals, cells, depth), partitions(docs), least)
    return HashIndex(cells, depth, saved(entries, "buckets"))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 4096, keep: str = "max", bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and its bucket, depth and chain.

    Of equal texts the row with the largest (``keep="min"``: smallest) doc_id
    stays; a null text is the empty text. Of repeated rows that tie in doc_id all
    are kept, as they are one document. Rows with a null doc_id take part in
    their group and stay only if the group has no id at all. Distinct texts go
    through two shuffles as they are, very long ones too. Other columns,
    whatever their names, are ignored. An empty table gives an empty result.

    A third of all rows may hold one text: its owner gets ARRIVALS rows for it at
    most, and in the look-up the join's large side is split between tasks. Only
    documents under a key with a chain are looked up by their text.
    """
    index = build_index(docs, key, text, capacity, keep, bits)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), _key(body, bits).alias("key"))
    cols = ["doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.col("digest").alias("text_sha256"), "bucket", "depth", "chain"]
    alone, chains = index.entries.where("NOT chained").drop("depth", "length", "text"), index.entries.where("chained").drop("depth", "length")
    found = index.route(rows).join(alone, ["bucket", "key"]).select(cols)
    collided = chains.select("key").distinct()
    if n := collided.count():
        texts = docs.select(F.col(key).alias("doc_id"), _key(body, bits).alias("key"), body.alias("text"))
        texts = texts.join(F.broadcast(collided) if n <= SENT else collided, "key", "left_semi")
        found = found.unionByName(index.route(texts).join(chains, ["bucket", "key", "text"]).select(cols))
    return found
