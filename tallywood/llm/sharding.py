"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks in them and shards in those; a shard has a weight,
an inner node the sum of its shards' weights. A document descends from the
root: at each node every child draws -ln(u)/weight from a hash u of the
document and the child's path, and the least draw wins. A change of one
subtree's weight moves documents only into or out of that subtree. A new shard
opens a region of its own, so all that moves goes into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slots are numbered within bins of a shard. The same for every table, so that the same rows always get the same slots.
BINS = 4096


@dataclass(frozen=True)
class Shard:
    """A leaf: its number, place and weight."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0


def tree(shards: int, racks_in_region: int = 2, shards_in_rack: int = 4) -> list[Shard]:
    """Equal shards 0..n-1, filled into racks and regions in order."""
    return [Shard(i, i // (racks_in_region * shards_in_rack), i // shards_in_rack) for i in range(shards)]


def grown(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own."""
    return [*shards, Shard(max(s.shard for s in shards) + 1, max(s.region for s in shards) + 1, max(s.rack for s in shards) + 1, weight)]


def uniform(key: Column, path: Column) -> Column:
    """A number in (0, 1): 52 bits of the MD5 of the path and the key, so that any engine draws alike."""
    digest = F.md5(F.concat(path, F.lit("|"), key).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _nodes(found: list[tuple[int, str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("id"), F.lit(p).alias("path"), F.lit(float(w)).alias("weight")) for n, p, w in found if w > 0])


def _descend(children: Column, key: Column) -> Column:
    """The child with the least draw; of equal draws the one of the smallest id."""
    drawn = F.transform(children, lambda c: F.struct((-F.log(uniform(key, c["path"])) / c["weight"]).alias("draw"), c["id"].alias("id")))
    return F.array_min(drawn)["id"]


def shard_of(key: Column, shards: list[Shard]) -> Column:
    """The shard of a document, by descent from regions to racks to shards."""
    weight = lambda **at: sum(s.weight for s in shards if all(getattr(s, k) == v for k, v in at.items()))
    regions = sorted({s.region for s in shards})
    racks = {r: sorted({s.rack for s in shards if s.region == r}) for r in regions}
    top = _nodes([(r, f"region{r}", weight(region=r)) for r in regions])
    middle = F.create_map(*[x for r in regions for x in (F.lit(r), _nodes([(a, f"rack{a}", weight(region=r, rack=a)) for a in racks[r]]))])
    leaves = F.create_map(*[x for r in regions for a in racks[r] for x in (F.lit(a), _nodes([(s.shard, f"shard{s.shard}", s.weight) for s in shards if s.rack == a]))])
    rack = _descend(F.element_at(middle, _descend(top, key)), key)
    return _descend(F.element_at(leaves, rack), key).cast("int")


def numbered(rows: DataFrame, group: str, order: list, bins: int, bin_key: Column) -> DataFrame:
    """Adds slot: 0, 1, 2 ... within each group, with no group in one task.

    Rows are ordered within hash bins; a bin starts where the counts of the bins
    before it end. The table of counts has bins x groups rows.
    """
    rows = rows.withColumn("_bin", F.pmod(F.xxhash64(bin_key), F.lit(bins)).cast("int"))
    counts = rows.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(group).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(group, "_bin", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy(group, "_bin").orderBy(*order)) - 1
    out = rows.withColumn("_within", within).join(starts, [group, "_bin"])
    return out.withColumn("slot", F.col("_start") + F.col("_within")).drop("_bin", "_start", "_within")


def shard_documents(docs: DataFrame, shards: list[Shard] | None = None, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the named further columns.

    The law is ``key``: only the doc_id and the tree decide. A null doc_id
    draws as the text "null"; rows with one doc_id go to one shard. Size is the UTF-8 bytes
    of the text plus 1, 1 for a null text, whose CRC is that of no bytes. Slots
    are gapless in each shard and depend on the rows alone; rows that share an id,
    or have none, are told apart by their texts. An empty table gives an empty result. Columns of
    the input that are not named are ignored, so clashing names don't matter.
    """
    shards = shards or tree(16)
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"),
        shard_of(name, shards).alias("shard"), shard_of(name, grown(shards)).alias("grown_shard"), *[F.col(c) for c in columns if c not in ("doc_id", key)],
    )
    placed = numbered(rows, "shard", ["doc_id", "size", "text_crc32"], BINS, F.struct("doc_id", "size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", *[c for c in columns if c not in ("doc_id", key)])
