"""Mixing sources to target weights by capped water-filling.

Every source wants its weight's share of the total. A source is clamped at
``max_epochs`` times its size and the excess is shared again by weight until no
source is above its cap: the fixed point is target = min(cap, level * weight)
for one water level. A source's documents are then repeated whole as often as
they all fit, and a seeded order of the documents decides which get one more
repetition, the last of them a fraction of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, saved

#: The seeded order is cut into 16**BIN_DIGITS bins, so that no source is sorted in one task.
BIN_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """The seeded order of a document: a hex MD5 of its id, or of its text where it has none; the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.coalesce(text, F.lit("")))).cast("binary"))


def water_fill(sources: DataFrame, max_epochs: float = 3.0, total: Column | None = None) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): min(cap, level * weight) with the level that spends the total.

    Sources in order of cap/weight reach their cap in that order. After the first
    k are clamped, the level is (total - their caps) / (the weights of the rest);
    the first source whose own cap/weight is at least the level ends the
    clamping, and that is the largest such level. Sources of weight or size 0 get 0. The table has a row per source.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    rows = sources.withColumn("_cap", F.when(F.col("weight") > 0, cap).otherwise(0.0)).withColumn("_ratio", F.when(F.col("weight") > 0, F.col("_cap") / F.col("weight")).otherwise(0.0))
    everything = W.partitionBy()
    before = W.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_total", (total if total is not None else F.sum("source_size").over(everything)).cast("double"))
    spent = F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("_level", F.when(rest > 0, (F.col("_total") - spent) / rest))
    level = F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(everything)
    target = F.when(F.col("weight") <= 0, 0.0).when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("weight")))
    return rows.withColumn("target", target).drop("_cap", "_ratio", "_total", "_level")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: float = 3.0, seed: int = 17, columns: tuple[str, ...] = (), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, and the named further columns.

    ``taken`` counts words, repetitions included: ``whole`` times the size, plus
    what the fractional round takes of it. A source's taken words sum to its
    rounded target. Sources in code-point order, null last, take ``weights`` in
    turn. A null text or a text without words has size 0 and taken 0. Rows that
    repeat a doc_id are documents of their own; rows without one are ordered by their texts. An empty table gives an empty
    result. Sums per source are integers, so reruns agree.

    A hot source is never sorted as a whole: documents fall into bins of their
    seeded draw, bins are summed, and only within a bin are they ordered.
    """
    extra = [c for c in columns if c not in ("doc_id", "source", "size")]
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw(F.col(key), F.col(text), seed).alias("_draw"))
    sized = saved(sized, "sizes")  # texts are counted once for all the sums
    keyed = lambda d: d.withColumn("_bin", F.substring("_draw", 1, BIN_DIGITS)).withColumn("_src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))  # noqa: E731  a key without nulls
    whole = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw(F.col(key), F.col(text), seed).alias("_draw"), *extra)
    rows = keyed(whole if extra else sized)
    bins = keyed(sized).groupBy("_src", "_bin").agg(F.first("source").alias("source"), F.sum("size").alias("_bin_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = bins.groupBy("_src").agg(F.first("source").alias("source"), F.sum("_bin_size").alias("source_size"))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")))
    sources = water_fill(sources, max_epochs)
    times = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("_whole", times).withColumn("_more", F.round("target").cast("long") - F.col("_whole") * F.col("source_size"))
    start = F.coalesce(F.sum("_bin_size").over(W.partitionBy("_src").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = bins.withColumn("_start", start).select("_src", "_bin", "_start").join(sources.select("_src", "source_size", "target", "_whole", "_more"), "_src")
    # A document gets the fraction of the round that is left when its turn comes in the seeded order.
    before = W.partitionBy("_src", "_bin").orderBy("_draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0))).join(plan, ["_src", "_bin"])
    left = F.col("_more") - F.col("_start") - F.col("_before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("_whole") * F.col("size") + part).cast("long").alias("taken"), *extra)


def repeated(mixed: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is taken whole; where a fraction is left, once more with its first words, joined by one space.

    A document without words, or of which nothing is taken, isn't in the mix. Rows
    that repeat an id are repeated each; an empty table gives an empty mix.
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = mixed.where(F.col("taken") > 0).withColumn("_whole", whole).withColumn("_rest", (F.col("taken") - F.col("_whole") * F.col("size")).cast("int"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_whole") + (F.col("_rest") > 0).cast("int"))))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), F.col("_rest")), " ")
    return rows.withColumn(text, F.when(F.col("_copy") > F.col("_whole"), part).otherwise(F.col(text))).select(*columns)
