"""A corpus from raw documents: classify, deduplicate, decontaminate, mix and shard.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.

What holds in every stage: a null text counts as an empty one and passes through
as null; very long texts are read whole; rows that repeat an id, or have none, are
rows of their own unless a stage says otherwise; columns beyond those of
documents are dropped, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.llm._common import saved
from tallywood.llm.decontaminate import decontaminate
from tallywood.llm.mixing import mix_sources, repeated
from tallywood.llm.near_dedup import near_dedup
from tallywood.llm.quality import keep_good, train
from tallywood.llm.sharding import shard_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7 go.

    It learns from labelled rows that aren't held out; without labels of both
    kinds its scores say nothing and lie about 0.5, so nothing much stays. Equal
    texts fare alike, so repeated rows do; ties at 0.7 stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs.select(COLUMNS), train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays.

    Rows that repeat that id all stay, as they are one document. Rows without an
    id, and texts without words, are no one's duplicates and stay.
    """
    kept = near_dedup(docs).where("kept").select("doc_id").distinct()
    known = docs.select(COLUMNS).join(saved(kept, "kept"), "doc_id", "left_semi")
    return known.unionByName(docs.select(COLUMNS).where("doc_id IS NULL"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; an empty benchmark lets all stay."""
    return decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a fraction of one is its first words.

    A document without words (null, empty, blank) has nothing to take and isn't
    in the mix; nor is one whose turn doesn't come in its source's seeded order.
    Null sources are a source. n_chars is of the text as it is now.
    """
    mixed = mix_sources(docs, columns=("text", "lang", "n_chars"))
    return repeated(mixed, COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix with its shard and its slot there.

    Repetitions of a document share its id and so its shard; slots tell them apart.
    A null id has a shard like any other.
    """
    return shard_documents(docs, columns=("lang", "source", "n_chars"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("mixture", mixture), ("shards", shards)]

#: A learned classifier is among the stages, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
