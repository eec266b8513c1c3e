"""Which source a file is of, from its head text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import abi, find_iban
from ..plans import vocabulary as V


def candidates(head: Column, markers: dict | None = None) -> Column:
    """The sources with a marker group that is in the head text in full, if several those with the largest such group."""
    text = F.lower(F.coalesce(head, F.lit("")))
    scores = []
    for source, groups in sorted((V.MARKERS if markers is None else markers).items()):
        score = F.lit(0)
        for group in groups:
            inside = F.lit(True)
            for m in group:
                inside &= text.contains(m)
            score = F.greatest(score, F.when(inside, len(group)).otherwise(0))
        scores.append(F.struct(score.alias("score"), F.lit(source).alias("source")))
    found = F.filter(F.array(*scores), lambda s: s["score"] > 0)
    top = F.array_max(F.transform(found, lambda s: s["score"]))
    return F.transform(F.filter(found, lambda s: s["score"] == top), lambda s: s["source"])


def detect_source(head: Column, markers: dict | None = None) -> Column:
    """The one source a head text is of; null if there is none or a tie."""
    found = candidates(head, markers)
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def identify_bank(files: DataFrame, banks: DataFrame) -> DataFrame:
    """Adds iban and bank to files with a ``head``: the name of the bank (abi, bank_name) whose code the first IBAN has."""
    f = files.withColumn("iban", find_iban(F.col("head"))).withColumn("abi", abi(F.col("iban")))
    return f.join(banks.select(F.lpad("abi", 5, "0").alias("abi"), F.col("bank_name").alias("bank")), "abi", "left").drop("abi")
