"""Which days a source's statements cover, where the holes are, and who is behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import vocabulary as V

C = V.COVERAGE


def covered_days(movements: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct days of a source with a movement or a declared balance on any of its accounts."""
    return movements.select("source", F.col("value_date").alias("day")).union(anchors.select("source", F.col("balance_date").alias("day"))).where("day IS NOT NULL").distinct()


def gaps(days: DataFrame) -> DataFrame:
    """Each day with the next one of its source."""
    return days.withColumn("next_day", F.lead("day").over(W.partitionBy("source").orderBy("day"))).withColumn("gap", F.datediff("next_day", "day"))


def holes(movements: DataFrame, anchors: DataFrame) -> DataFrame:
    """Spacings wider than 45 days and than 1.8 times the source's median; three days make a rhythm."""
    g = gaps(covered_days(movements, anchors))
    rhythm = g.groupBy("source").agg(F.when(F.count(F.lit(1)) >= 3, F.median("gap")).alias("rhythm"))
    limit = F.coalesce(F.greatest(F.lit(float(C["hole_days"])), F.lit(C["hole_factor"]) * F.col("rhythm")), F.lit(float(C["hole_days"])))
    return g.join(rhythm, "source").where(F.col("gap") > limit).select("source", F.col("day").alias("from_date"), F.col("next_day").alias("to_date"), F.col("gap").alias("days"))


def report(movements: DataFrame, anchors: DataFrame, today: str) -> DataFrame:
    """One row per source: counts, span, the rhythm of its balances, staleness, number and width of holes."""
    days = covered_days(movements, anchors)
    span = days.groupBy("source").agg(F.min("day").alias("covered_from"), F.max("day").alias("covered_until"))
    n = movements.groupBy("source").agg(F.count(F.lit(1)).alias("n_movements"))
    a = gaps(anchors.select("source", F.col("balance_date").alias("day")).where("day IS NOT NULL").distinct())
    a = a.groupBy("source").agg(F.count(F.lit(1)).alias("n_anchors"), F.when(F.count(F.lit(1)) >= 3, F.median("gap")).alias("rhythm"))
    h = holes(movements, anchors).groupBy("source").agg(F.count(F.lit(1)).alias("n_holes"), F.max("days").alias("widest_hole"))
    out = span.join(n, "source", "left").join(a, "source", "left").join(h, "source", "left")
    late = F.datediff(F.lit(today).cast("date"), "covered_until")
    limit = F.coalesce(F.greatest(F.lit(float(C["stale_days"])), F.lit(C["stale_factor"]) * F.col("rhythm")), F.lit(float(C["stale_days"])))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "source", zero("n_movements"), zero("n_anchors"), "covered_from", "covered_until", F.bround("rhythm", 0).cast("int").alias("anchor_cadence_days"),
        late.alias("stale_days"), (late > limit).alias("stale"), zero("n_holes"), zero("widest_hole"),
    )


def worst_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("stale").desc(), F.col("widest_hole").desc(), "source")
