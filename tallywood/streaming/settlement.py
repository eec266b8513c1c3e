"""Settlement of messages one by one, as a stateful stream.

Each message that fails has an entry of state: how often it was tried, when it
was first seen and when it is due. Messages are dealt into buckets, each with a list
of those that wait, which is read and written once a batch, and with timers that
bring back what is due; when its budget of deliveries or its age is used up, a
message goes to quarantine. Messages don't wait for each other, and what succeeds
at once has no state at all.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from .queues import MAX_DELIVER

DELAY_MS = 30_000
MAX_AGE_MS = 7 * 24 * 3600 * 1000
#: Lists of waiting messages. A task holds one list and the ids of one bucket's batch.
BUCKETS = 2048
OUTCOME = "id string, raw string, kind string, attempts int, result string, error string"
#: What an outcome can be; all but the first are quarantine.
HANDLED, MALFORMED, GAVE_UP, EXPIRED = "handled", "malformed", "gave up", "expired"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Settlement(StatefulProcessor):
    """``handle`` gets a message as a dictionary; what it returns is the result, what it raises a failed delivery.

    It runs in tasks and may see a message again when a task is tried again, so it
    has to be idempotent, as with any delivery at least once.
    """

    def __init__(self, handle: Callable[[dict], str | None], delay_ms: int = DELAY_MS, budget: int = MAX_DELIVER, max_age_ms: int = MAX_AGE_MS) -> None:
        self.handle, self.delay_ms, self.budget, self.max_age_ms = handle, delay_ms, budget, max_age_ms

    def init(self, handle: Any) -> None:
        self.tools = handle
        self.waiting = handle.getListState("waiting", "id string, attempts int, first_seen long, due long, raw string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        seen = {w[0] for w in self.waiting.get()}  # what waits already has a timer
        failed = []
        for row in rows:
            if row.id in seen:  # a message that comes several times at once is one
                continue
            seen.add(row.id)
            if row.malformed:
                yield self._outcome(row.id, row.raw, MALFORMED, 0)
            else:
                yield from self._deliver(row.id, 0, now, row.raw, now, failed)
        if failed:
            self.waiting.appendList(failed)
            self.tools.registerTimer(now + self.delay_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        later, failed, tried = [], [], False
        for name, attempts, first_seen, due, raw in list(self.waiting.get()):
            if due > now:
                later.append((name, attempts, first_seen, due, raw))
                continue
            tried = True
            if now - first_seen > self.max_age_ms:
                yield self._outcome(name, raw, EXPIRED, attempts)
            else:
                yield from self._deliver(name, attempts, first_seen, raw, now, failed)
        if tried and later + failed:
            self.waiting.put(later + failed)
        elif tried:
            self.waiting.clear()
        if failed:
            self.tools.registerTimer(now + self.delay_ms)

    def _deliver(self, name: str, attempts: int, first_seen: int, raw: str, now: int, failed: list[tuple]) -> Iterator[Row]:
        """The outcome of one more delivery; a message that waits for the next goes to ``failed`` instead."""
        attempts += 1
        try:
            done = self._outcome(name, raw, HANDLED, attempts, result=self.handle(json.loads(raw)))
        except Exception as e:  # any failure counts against the budget
            if attempts < self.budget:
                failed.append((name, attempts, first_seen, now + self.delay_ms, raw))
                return
            done = self._outcome(name, raw, GAVE_UP, attempts, error=f"{type(e).__name__}: {e}"[:500])
        yield done

    @staticmethod
    def _outcome(name, raw, kind, attempts, result=None, error=None) -> Row:
        return Row(id=name, raw=raw, kind=kind, attempts=attempts, result=result, error=error)


def settled(messages: DataFrame, handle: Callable[[dict], str | None], **limits: int) -> DataFrame:
    """Outcomes of a stream of messages (raw, malformed; see ``queues.messages``). A message is known by its content."""
    keyed = messages.select(F.sha2("raw", 256).alias("id"), "raw", "malformed")
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")
    return keyed.withColumn("bucket", bucket).groupBy("bucket").transformWithState(Settlement(handle, **limits), OUTCOME, "Append", "ProcessingTime")


def settle_into(messages: DataFrame, handle: Callable[[dict], str | None], out: str, checkpoint: str, every: str = "10 seconds", **limits: int) -> StreamingQuery:
    """Start the settlement of a stream; outcomes are Parquet files at ``out``, each message in one row once it is settled.

    What a query did is in its checkpoint, so one that is started again goes on with what waits.
    """
    spark = messages.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # the store that has timers; a query keeps the settings it was started with
    try:
        writer = settled(messages, handle, **limits).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        return writer.trigger(processingTime=every).start(out)
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def drain(query: StreamingQuery, seconds: float = 600, poll: float = 0.2) -> None:
    """Wait until all messages so far are read and none waits, and stop the query. It is an error if for so many ``seconds`` no message is read or tried; a batch that runs longer than that is waited for."""
    changed, idle, seen, left = time.time(), 0, -1, None
    while time.time() - changed < seconds or not idle and query.status["isTriggerActive"]:
        if query.exception() is not None:
            raise query.exception()
        last = query.lastProgress
        # A batch without input after the last one with input; it reports the rows of state that are left.
        if last is not None and last.batchId != seen:
            seen, state = last.batchId, last.stateOperators[0] if last.stateOperators else None
            if not last.numInputRows and state and state.numRowsTotal == 0:
                query.stop()
                return
            if last.numInputRows or state and (state.numRowsTotal != left or state.numRowsUpdated):
                changed, idle = time.time(), 0
            else:
                idle += 1
            left = state.numRowsTotal if state else None
        time.sleep(poll)
    query.stop()
    raise TimeoutError("messages still wait")
