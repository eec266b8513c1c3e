"""Settlement message by message, by batches, and each message once over runs."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tallywood.streaming import queues, settlement

JOB = "ingest.jobs"


def put(folder, name, keys, extra=()):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.writelines(json.dumps({"key": str(k)}) + "\n" for k in keys)
        f.writelines(line + "\n" for line in extra)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def outcomes(spark, out):
    return sorted((r.kind, r.attempts, r.raw) for r in spark.read.schema(settlement.OUTCOME).parquet(out).collect())


def test_a_third_fails(spark, tmp_path):
    """Exactly the messages that fail for good end in quarantine; what fails for a while is handled, and nothing twice, over two runs of the stream."""
    q, out, state = (f"{tmp_path}/{x}" for x in ("queue", "out", "state"))
    mended = f"{tmp_path}/mended"

    def handle(message):
        n = int(message["key"])
        if n % 3 == 0 or n % 7 == 1 and not os.path.exists(mended):
            raise ValueError(n)
        return str(n * 2)

    start = lambda: settlement.settle_into(queues.messages(spark, q, JOB), handle, out, state, every="300 milliseconds", delay_ms=1500)
    put(q, "one", range(300), ['{"key": ', "not JSON"])
    query = start()
    while query.lastProgress is None or query.lastProgress.batchId < 1:  # all were tried once; the failing ones wait
        assert query.exception() is None
        time.sleep(0.1)
    query.stop()
    open(mended, "w").close()
    put(q, "two", [*range(290, 320), 5, 300])  # some of them again; a message that was settled is a new one when it comes again
    query = start()
    settlement.drain(query, 120)
    got = outcomes(spark, out)
    by = {}
    for kind, attempts, raw in got:
        by.setdefault(kind, []).append(raw)
    name = lambda n: json.dumps({"key": str(n)})
    bad = {n for n in range(320) if n % 3 == 0}
    assert {attempts for kind, attempts, _ in got if kind == "gave up"} == {queues.MAX_DELIVER}
    assert sorted(set(by["gave up"])) == sorted(map(name, bad))
    assert sorted(set(by["handled"])) == sorted(name(n) for n in range(320) if n not in bad)
    assert sorted(by["malformed"]) == sorted(['{"key": ', "not JSON"])
    # Whatever came in one run only has one outcome; attempts say that the mended ones waited.
    once = [r for _, _, r in got if r not in {name(n) for n in (*range(290, 300), 5)}]
    assert len(once) == len(set(once))
    assert all(attempts > 1 for kind, attempts, raw in got if kind == "handled" and int(json.loads(raw)["key"]) % 7 == 1 and int(json.loads(raw)["key"]) < 290)


def test_age_ends_waiting(spark, tmp_path):
    q, out, state = (f"{tmp_path}/{x}" for x in ("queue", "out", "state"))

    def handle(message):
        raise ValueError("never")

    put(q, "one", [1])
    query = settlement.settle_into(queues.messages(spark, q, JOB), handle, out, state, every="300 milliseconds", delay_ms=300, max_age_ms=1)
    settlement.drain(query, 60)
    assert outcomes(spark, out) == [("expired", 1, '{"key": "1"}')]


def test_batches_lose_no_good_message(spark):
    """However many fail, only those are returned as failed."""
    rows = spark.createDataFrame([(str(i),) for i in range(24)], "raw string").coalesce(1)
    done = []

    def handle(part):
        got = [r.raw for r in part.collect()]
        if any(int(r) % 3 == 0 for r in got):
            raise ValueError
        done.extend(got)

    failed = sorted(int(r.raw) for r in queues.deliver(handle, rows).collect())
    assert failed == list(range(0, 24, 3)) and sorted(map(int, done)) == [i for i in range(24) if i % 3]


def test_a_failing_link_does_not_fail_the_batch(spark, caplog):
    seen = []

    def relink():
        raise RuntimeError("no")

    queues.ingest_chain(lambda b: b, lambda b: seen.append(b.count()), relink, lambda: seen.append("categories"))(spark.range(3), 0)
    assert seen == [3, "categories"] and "relinking failed" in caplog.text


def test_drain_says_what_waits(spark, tmp_path):
    def handle(message):
        raise ValueError

    put(f"{tmp_path}/queue", "one", [1])
    query = settlement.settle_into(queues.messages(spark, f"{tmp_path}/queue", JOB), handle, f"{tmp_path}/out", f"{tmp_path}/state", every="300 milliseconds", delay_ms=60_000)
    with pytest.raises(TimeoutError):
        settlement.drain(query, 8)
    assert not query.isActive


def test_once_over_runs_with_bounded_state(spark, tmp_path):
    """What comes again, in another run or late, isn't delivered again; keys are forgotten when they can't come any more."""
    from pyspark.sql import functions as F

    rows = spark.range(1000).select(F.col("id").alias("k"), F.timestamp_seconds(F.col("id") * 60 + 1_000_000).alias("ts"))

    def run(name, part):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = queues.deduplicated(stream, "k", "ts", "1 hour").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        last = [p for p in query.recentProgress if p.stateOperators][-1]
        return sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()), last.stateOperators[0].numRowsTotal

    assert run("a", rows.where("k < 600"))[0] == list(range(600))
    # All of the first run again, some of them within the watermark and some long after it, and new ones.
    got, state = run("b", rows.where("k < 900").unionByName(rows.where("k BETWEEN 580 AND 620")))
    assert got == list(range(900)) and state <= 130
    got, state = run("c", rows.where("k >= 890"))
    assert got == list(range(1000)) and state <= 130


def test_a_handler_that_names_its_failures_is_called_once(spark):
    """However many messages fail, a batch is one call where the handler says which."""
    rows = spark.range(500).select(F.col("id").cast("string").alias("raw"), F.lit(2).alias("attempts"))
    calls = []

    def handle(part):
        calls.append(part.count())
        return part.where("cast(raw as long) % 3 = 0").select("raw")

    failed = queues.deliver(handle, rows)
    assert calls == [500] and sorted(int(r.raw) for r in failed.where("attempts = 2").collect()) == list(range(0, 500, 3))


def test_a_long_batch_is_waited_for(spark, tmp_path):
    """Draining gives up where nothing goes on, not where a batch takes longer than its patience."""

    def handle(message):
        time.sleep(6)
        return "done"

    put(f"{tmp_path}/queue", "one", [1])
    query = settlement.settle_into(queues.messages(spark, f"{tmp_path}/queue", JOB), handle, f"{tmp_path}/out", f"{tmp_path}/state", every="300 milliseconds")
    settlement.drain(query, 3)
    assert [kind for kind, _, _ in outcomes(spark, f"{tmp_path}/out")] == ["handled"]
