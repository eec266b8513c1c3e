"""Work queues as file streams: at least once, idempotent by key, with a retry budget and a quarantine.

Messages are JSON lines in a landing folder per subject. A batch is handled in
``foreachBatch``; what can't be read goes to quarantine at once, what fails is
tried again with the next batch until its budget is used up.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..shared import saved

log = logging.getLogger(__name__)

SUBJECTS = {
    "ingest.jobs": "key STRING, filename STRING, source STRING, force BOOLEAN",
    "category.feedback": "id BIGINT, natural_key STRING, category STRING, corrected_by STRING",
    "category.recategorize": "requested_at STRING",
}
MAX_DELIVER = 5
#: How late a message may be: for so long keys are remembered.
LATE = "1 day"


def messages(spark: SparkSession, folder: str, subject: str) -> DataFrame:
    """A stream of (message fields, raw); ``malformed`` marks what isn't the subject's JSON."""
    raw = spark.readStream.format("text").load(folder)
    schema = SUBJECTS[subject] + ", _bad STRING"
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return raw.select(parsed.alias("m"), F.col("value").alias("raw")).select("m.*", "raw", (F.col("m._bad").isNotNull() | F.col("m").isNull()).alias("malformed")).drop("_bad")


def encode(rows: DataFrame) -> DataFrame:
    """Messages as JSON lines, decimals as strings."""
    cols = [F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*cols)).alias("value"))


def deliver(handle: Callable[[DataFrame], DataFrame | None], work: DataFrame, key: str = "raw") -> DataFrame:
    """Handle messages as a batch; returns those that the handler fails on, and no others.

    A handler that knows which messages it fails on returns them, and a batch is
    one call, however many fail. One that raises handled none for sure: the halves
    of its batch (by a hash of the key) are tried, down to single messages, so that
    one bad message doesn't hold up the others; of n messages of which k fail, some
    k log n calls are made. Handlers are idempotent, as delivery is at least once.
    """
    failed, todo = None, [(work, 0)]
    while todo:
        part, depth = todo.pop()
        try:
            told = handle(part)
        except Exception:  # any failure of the handler counts against the budget
            if not depth:
                part = saved(part, "work")  # the halves read it, and don't make it anew
            if part.select(key).distinct().limit(2).count() > 1:
                side = F.pmod(F.xxhash64(key, F.lit(depth)), F.lit(2)) == 0
                todo += [(part.where(side), depth + 1), (part.where(~side), depth + 1)]
                continue
            told = part
        if told is not None:
            lost = part.join(told.select(key).distinct(), key, "left_semi").select(*work.columns)
            failed = lost if failed is None else failed.unionByName(lost)
    return work.limit(0) if failed is None else failed


def settle(handle: Callable[[DataFrame], DataFrame | None], batch: DataFrame, pending: DataFrame | None, quarantine: Callable[[DataFrame, str], None], key: str = "raw", gave_up: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Handle a batch and what is still pending (with attempts); returns what is pending after it.

    What can't be read goes to quarantine at once. A message that the handler fails
    on is pending with one more attempt; after MAX_DELIVER of them it goes to
    quarantine, and to the hook ``gave_up``.
    """
    good = batch.where(~F.col("malformed")).drop("malformed").dropDuplicates([key])
    quarantine(batch.where("malformed"), "malformed")
    work = good.withColumn("attempts", F.lit(0))
    if pending is not None:
        work = pending.unionByName(work.join(pending.select(key), key, "left_anti"))
    tried = deliver(lambda rows: handle(rows.drop("attempts")), work, key).withColumn("attempts", F.col("attempts") + 1)
    lost = tried.where(F.col("attempts") >= MAX_DELIVER).drop("attempts")
    quarantine(lost, "gave up")
    if gave_up is not None:
        gave_up(lost)
    return tried.where(F.col("attempts") < MAX_DELIVER)


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run a handler over a stream's batches, from where the checkpoint says it stopped."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def appended(folder: str, handle: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes what ``handle`` makes of a batch to the batch's own folder, so that a batch that comes again replaces itself."""
    return lambda batch, batch_id: handle(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def deduplicated(stream: DataFrame, key: str = "natural_key", time: str | None = None, late: str = LATE) -> DataFrame:
    """A stream with each key once; with a time column, state is kept no longer than ``late``."""
    return stream.dropDuplicates([key]) if time is None else stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def ingest_chain(parse: Callable[[DataFrame], DataFrame], upsert: Callable[[DataFrame], None], relink: Callable[[], None], recategorize: Callable[[], None]) -> Callable[[DataFrame, int], None]:
    """A batch handler: parse and upsert, then link transfers anew, then categorise; a failing link doesn't fail the batch."""

    def run(batch: DataFrame, _id: int) -> None:
        upsert(parse(batch))
        try:
            relink()
        except Exception:  # the movements are in; the next batch links again
            log.exception("relinking failed")
        recategorize()

    return run
