"""Text features, the nearest examples and the champion gate against plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from tallywood.operators import categorize

import hashlib
import math

from tallywood.operators import text_model as T

DDL = "text string, category string"


def plain_buckets(text, dims, n):
    s = f" {text} "
    return [int(hashlib.md5(s[i : i + n].encode()).hexdigest()[:8], 16) % dims for i in range(len(s) - n + 1)] if text else []


def plain_vectors(texts, fitted, dims, n):
    df = {}
    for t in fitted:
        for b in set(plain_buckets(t, dims, n)):
            df[b] = df.get(b, 0) + 1
    out = {}
    for t in texts:
        v = [0.0] * dims
        for b in plain_buckets(t, dims, n):
            v[b] += math.log((1 + len(fitted)) / (1 + df.get(b, 0))) + 1
        norm = math.sqrt(sum(x * x for x in v))
        out[t] = [x / norm if norm else 0.0 for x in v]
    return out


def test_features_predictions_and_the_gate(spark):
    stems = {"rent": "affitto casa via", "food": "pizzeria da", "fuel": "stazione carburante"}
    taught = [(f"{s} {name}", c) for c, s in stems.items() for name in ("roma", "milano", "torino", "bari", "è")] + [("", "rent")]
    asked = [("affitto casa via lecce", "rent"), ("pizzeria da gino", "food"), ("stazione carburante nord", "fuel"), ("", "food"), ("q", "food")]
    rows, held = spark.createDataFrame(taught, DDL), spark.createDataFrame(asked, DDL)
    for dims, n in ((256, 3), (64, 2)):
        m = T.fit(rows, dims, n)
        want = plain_vectors([t for t, _ in asked], [t for t, _ in taught], dims, n)
        got = {r.text: r.vector for r in m.vectors(held).collect()}
        assert all(abs(a - b) < 1e-12 for t in want for a, b in zip(got[t], want[t], strict=True))
        assert {r.text: r.predicted for r in m.predict(held).collect() if r.text not in ("q",)} == {t: c if t else "other" for t, c in asked if t != "q"}
    good, poor = T.fit(rows), T.fit(rows.where("category = 'rent'"))
    assert T.challenge(good, None, held)[0] is good
    assert T.challenge(poor, good, held)[0] is good and T.challenge(good, poor, held)[0] is good
    again = T.fit(rows)
    stays, new, old = T.challenge(again, good, held)
    assert stays is again and new == old  # a tie goes to the challenger
    assert T.fit(rows.where("false")).predict(held).where("predicted <> 'other'").isEmpty()


def test_neighbours_by_float32_are_those_of_float64(spark):
    """Near ties, equal vectors and a query's own row: the k nearest are those of the whole products, whatever the first look rounds away."""
    rng = np.random.default_rng(3)
    base = rng.random((40, 16))
    some = np.concatenate([base, base[:10], base[:10] + 1e-9 * rng.random((10, 16)), np.zeros((3, 16))])
    rows = [(i, some[i].tolist(), i % 3) for i in range(len(some))]
    made = spark.createDataFrame(rows, "vec_id long, vector array<double>, label int")
    for others in (False, True):
        got = categorize.knn(made.withColumnRenamed("vec_id", "query_id"), made, 4, block=25, others=others).collect()
        want = set()
        for q in range(len(some)):
            sims = sorted((-round(float(some[q] @ some[v]), 12), v) for v in range(len(some)) if not (others and v == q))
            want |= {(q, v, rank) for rank, (_, v) in enumerate(sims[:4], 1)}
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


def test_features_are_what_a_vector_holds(spark):
    """Only what isn't zero, by the buckets that expressions find."""
    rows = spark.createDataFrame([("old rod", "a"), ("old old rod 77", "b"), ("", "c"), ("x", "a")], "text string, category string")
    model = T.fit(rows)
    got = model.features(model.vectors(rows)).withColumn("buckets", T.buckets(F.col("text"))).collect()
    for r in got:
        assert {f.bucket: f.weight for f in r.features} == {i: w for i, w in enumerate(r.vector) if w > 0}
        assert {f.bucket for f in r.features} == set(r.buckets)
