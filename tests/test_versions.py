"""Versioned tables: what readers see, what a change writes, and who comes first."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallywood.operators.versions import Conflict, Table

DDL = "k long, v string"


def put(rows, batch):
    """The batch's rows instead of those of the same keys."""
    return rows.join(batch.select("k"), "k", "left_anti").unionByName(batch)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), DDL)


def values(frame):
    return {r.k: r.v for r in frame.collect()}


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_versions_and_readers(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    assert t.version() is None
    t.create(DDL, ["k"], 8)
    assert t.create(DDL, ["k"], 8).number == 0 and values(t.read()) == {}
    t.change(rows(spark, *((i, "a") for i in range(50))), put, "load")
    old = t.read()
    v = t.change(rows(spark, (3, "b"), (99, "n")), put)
    assert v.number == 2 and t.versions() == [0, 1, 2]
    assert values(old) == {i: "a" for i in range(50)}
    assert values(t.read()) == {i: "a" for i in range(50)} | {3: "b", 99: "n"}
    assert values(t.read(1)) == values(old)
    # A bucket that loses all its rows goes; an empty batch is no version.
    gone = t.change(rows(spark, *((i, "x") for i in range(50))), lambda have, batch: have.join(batch, "k", "left_anti"))
    assert values(t.read()) == {99: "n"} and len(gone.writes) == 1
    assert t.change(rows(spark), put).number == gone.number
    t.restore(1)
    assert values(t.read()) == {i: "a" for i in range(50)}
    t.overwrite(t.read().withColumn("v", F.upper("v")))
    assert values(t.read()) == {i: "A" for i in range(50)}
    with pytest.raises(KeyError):
        t.read(77)
    assert t.expire(1) and values(t.read()) == {i: "A" for i in range(50)} and t.versions() == [5]


def test_a_killed_change_leaves_the_old_version(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    t.create(DDL, ["k"], 4)
    t.change(rows(spark, (1, "a")), put)

    class Killed(Table):
        def _put(self, v):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Killed(spark, f"file://{tmp_path}/t").change(rows(spark, (1, "b"), (2, "b")), put)
    assert values(t.read()) == {1: "a"} and t.versions() == [0, 1]
    with pytest.raises(Exception, match="boom"):
        t.change(rows(spark, (1, "b")), lambda have, batch: put(have, batch).withColumn("v", F.expr("raise_error('boom')").cast("string")))
    assert values(t.read()) == {1: "a"}
    assert len(t.expire(5)) >= 1 and values(t.read()) == {1: "a"}


def test_what_a_change_writes_grows_with_the_batch(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    t.create(DDL, ["k"], 64)
    t.change(spark.range(40_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")), put)
    before = folder_bytes(tmp_path)
    v = t.change(rows(spark, (5, "new"), (6, "new")), put)
    assert len({w for w in v.writes.values()}) == 2 and sum(w != next(iter(t.version(1).writes.values())) for w in v.writes.values()) <= 2
    assert folder_bytes(tmp_path) - before < before / 16
    assert t.read().count() == 40_000


def test_two_changes_of_one_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    t = Table(spark, path)
    t.create(DDL, ["k"], 8)
    t.change(rows(spark, *((i, "a") for i in range(40))), put)
    bucket = {r.k: r.b for r in t.read().select("k", t._bucket(("k",), 8).alias("b")).collect()}
    other = next(k for k in bucket if bucket[k] != bucket[0])
    seen = []

    def meanwhile(key):
        def merge(have, batch):
            if not seen:  # another load commits between this one's read and its commit
                seen.append(key)
                Table(spark, path).change(rows(spark, (key, "theirs")), put)
            return put(have, batch)

        return merge

    t.change(rows(spark, (0, "mine")), meanwhile(other))
    assert {k: v for k, v in values(t.read()).items() if v != "a"} == {0: "mine", other: "theirs"} and t.versions() == [0, 1, 2, 3]
    seen.clear()
    count = lambda have, batch: put(have, batch.join(have.withColumnRenamed("v", "was"), "k").select("k", F.concat("was", F.lit("+")).alias("v")))
    t.change(rows(spark, (0, "")), lambda have, batch: count(meanwhile(0)(have, batch.limit(0)), batch))
    assert values(t.read())[0] == "theirs+"  # the change that came second saw what the first one wrote
    seen.clear()
    with pytest.raises(Conflict):
        t.change(rows(spark, (0, "late")), meanwhile(0), attempts=1)
    with pytest.raises(ValueError, match="keys"):
        t.change(rows(spark, (0, "z")), lambda have, batch: have.unionByName(rows(spark, (other, "z"))))
