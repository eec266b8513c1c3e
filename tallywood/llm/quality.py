"""A byte-level convolutional quality classifier in numpy.

Bytes are embedded; filters of WIDTH bytes, STRIDE apart, run over the whole
document. Its halves of HALF bytes are pooled (largest and mean response of
each filter), two neighbouring halves are a chunk, so that chunks overlap by
half and cover the whole text. A hidden layer looks at each chunk, its units
are max-pooled over the chunks, and their logistic combination is the
probability of label 1. Everything is learned by gradient descent.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import flat, saved, slices

WIDTH, STRIDE, HALF, DIM, FILTERS, HIDDEN = 8, 4, 256, 6, 32, 24
PAD = 256
_AT = HALF // STRIDE


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def padded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all documents in whole halves, and each document's first half (one more at the end). An empty text is one half of padding.

    Texts begin WIDTH - STRIDE symbols into their first half and have as much
    padding after them at least, so no filter sees two documents.
    """
    size = np.diff(off)
    halves = (size + WIDTH - STRIDE + HALF - 1) // HALF
    halves = np.maximum(halves, 1)
    first = np.append(0, np.cumsum(halves))
    out = np.full(int(first[-1]) * HALF + WIDTH, PAD, np.int16)
    if len(raw):
        out[np.arange(len(raw)) + np.repeat(first[:-1] * HALF + WIDTH - STRIDE - off[:-1], size)] = raw
    return out, first


class Net:
    """The parameters, the forward and the backward pass."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *s, fan: (rng.standard_normal(s) * np.sqrt(2 / fan)).astype(np.float32)
        self.p = {
            "E": init(257, DIM, fan=2), "W": init(WIDTH * DIM, FILTERS, fan=WIDTH * DIM), "b": np.zeros(FILTERS, np.float32),
            "V": init(2 * FILTERS, HIDDEN, fan=2 * FILTERS), "c": np.full(HIDDEN, 0.1, np.float32), "u": init(HIDDEN, fan=HIDDEN), "d": np.zeros(1, np.float32),
        }

    def halves(self, symbols: np.ndarray, n: int):
        """Each half's largest and mean responses, and what the backward pass needs."""
        e = self.p["E"][symbols].reshape(-1)
        step = e.strides[0]
        x = np.lib.stride_tricks.as_strided(e, (n * _AT, WIDTH * DIM), (step * STRIDE * DIM, step))
        r = x @ self.p["W"]
        r += self.p["b"]
        np.maximum(r, 0, out=r)
        r = r.reshape(n, _AT, FILTERS)
        return x, r, r.max(1), r.mean(1)

    def rest(self, top: np.ndarray, mean: np.ndarray, first: np.ndarray):
        """From halves to probabilities."""
        last = np.zeros(len(top), bool)
        last[first[1:] - 1] = True
        single = np.diff(first) == 1
        has = ~last  # chunks start at every half but the last of a document, or at its only one
        has[first[:-1][single]] = True
        a = np.flatnonzero(has)
        b = np.where(last[a], a, a + 1)
        f = np.concatenate([np.maximum(top[a], top[b]), (mean[a] + mean[b]) / 2], 1)
        h = np.maximum(f @ self.p["V"] + self.p["c"], 0)
        chunk = np.cumsum(has) - has
        cut = chunk[first[:-1]]
        pooled = np.maximum.reduceat(h, cut)
        z = pooled @ self.p["u"] + self.p["d"]
        return (a, b, f, h, cut, pooled), 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def pools(self, symbols: np.ndarray, n: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Each half's largest and mean responses, a few halves at a time, so that only these numbers are kept of a long text."""
        top, mean = np.empty((n, FILTERS), self.p["W"].dtype), np.empty((n, FILTERS), self.p["W"].dtype)
        for a in range(0, n, step):
            z = min(n, a + step)
            _, _, top[a:z], mean[a:z] = self.halves(symbols[a * HALF : z * HALF + WIDTH], z - a)
        return top, mean

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        symbols, first = padded(raw, off)
        top, mean = self.pools(symbols, int(first[-1]))
        return self.rest(top, mean, first)[1].astype(np.float64)

    def gradients(self, raw: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted sum of the texts' losses.

        A hidden unit's gradient goes to the first chunk that has its largest
        value, so at most HIDDEN chunks of a text, however long, are looked at again.
        """
        symbols, first = padded(raw, off)
        top, mean = self.pools(symbols, int(first[-1]))
        (a, b, f, h, cut, pooled), prob = self.rest(top, mean, first)
        g = ((prob - y) * weight).astype(np.float32)
        out = {"u": pooled.T @ g, "d": g.sum(keepdims=True)}
        dp = np.outer(g, self.p["u"])
        owner = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(h))))
        chunk, unit = np.nonzero((h == pooled[owner]) & (h > 0))
        _, one = np.unique(owner[chunk] * HIDDEN + unit, return_index=True)
        chunk, unit = chunk[one], unit[one]
        won, row = np.unique(chunk, return_inverse=True)
        dh = np.zeros((len(won), HIDDEN), dp.dtype)
        dh[row, unit] = dp[owner[chunk], unit]
        f, a, b = f[won], a[won], b[won]
        out["V"], out["c"] = f.T @ dh, dh.sum(0)
        df = dh @ self.p["V"].T
        seen, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        at_a, at_b = at[: len(a)], at[len(a) :]
        dtop, dmean = np.zeros((len(seen), FILTERS), df.dtype), np.zeros((len(seen), FILTERS), df.dtype)
        higher = top[a] >= top[b]
        np.add.at(dtop, at_a, df[:, :FILTERS] * higher)
        np.add.at(dtop, at_b, df[:, :FILTERS] * ~higher)
        np.add.at(dmean, at_a, df[:, FILTERS:] / 2)
        np.add.at(dmean, at_b, df[:, FILTERS:] / 2)
        own = symbols[(seen * HALF)[:, None] + np.arange(HALF + WIDTH)]
        e = self.p["E"][own]
        x = np.lib.stride_tricks.sliding_window_view(e, (WIDTH, DIM), axis=(1, 2))[:, :HALF:STRIDE, 0].reshape(-1, WIDTH * DIM)
        r = np.maximum(x @ self.p["W"] + self.p["b"], 0).reshape(len(seen), _AT, FILTERS)
        dr = np.broadcast_to(dmean[:, None, :] / _AT, r.shape).copy()
        where = r.argmax(1)
        i, k = np.indices(where.shape)
        dr[i, where, k] += dtop
        dr *= r > 0
        dr = dr.reshape(-1, FILTERS)
        out["W"], out["b"] = x.T @ dr, dr.sum(0)
        dx = (dr @ self.p["W"].T).reshape(len(seen), _AT, WIDTH, DIM)
        de = np.zeros(e.shape, e.dtype)
        for j in range(WIDTH):
            de[:, j : j + HALF : STRIDE] += dx[:, :, j]
        out["E"] = np.stack([np.bincount(own.reshape(-1), de[:, :, k].reshape(-1), 257) for k in range(DIM)], 1).astype(np.float32)
        return out


def _batch(net: Net, texts: list[bytes], y: np.ndarray, weight: np.ndarray, most: int = 1 << 20) -> dict[str, np.ndarray]:
    """The gradients of a batch's mean loss; whole texts, so many bytes at a time."""
    total: dict[str, np.ndarray] = {}
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    for a, z in slices(off, most):
        grads = net.gradients(np.frombuffer(b"".join(texts[a:z]), np.uint8), off[a : z + 1] - off[a], y[a:z], weight[a:z] / weight.sum())
        total = {k: total[k] + g if total else g for k, g in grads.items()}
    return total


def fit_parts(load: Callable[[int], tuple[list[bytes], np.ndarray]], sizes: list[int], share: np.ndarray, epochs: int = 8, batch: int = 24, rate: float = 3e-3, seed: int = 7) -> Net:
    """Adam on the log loss, both labels with equal weight in the loss; at the end the bias returns to the labels' shares.

    ``load`` gives the texts and labels of a part; one part is in memory at a time.
    """
    net, rng = Net(seed), np.random.default_rng(seed)
    share = np.clip(share, 1e-3, 1)
    m, v, t = {k: np.zeros_like(p) for k, p in net.p.items()}, {k: np.zeros_like(p) for k, p in net.p.items()}, 0
    total = epochs * sum(-(-n // batch) for n in sizes)
    for _ in range(epochs):
        for part in range(len(sizes)):
            texts, y = load(part)
            weight, order = (0.5 / share)[y], rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                idx = order[a : a + batch]
                grads, t = _batch(net, [texts[i] for i in idx], y[idx], weight[idx]), t + 1
                step = rate * (1 - t / (total + 1))
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    net.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    net.p["d"] += np.float32(np.log(share[1] / share[0]))
    return net


def fit(texts: list[bytes], y: np.ndarray, **how) -> Net:
    """:func:`fit_parts` on texts in memory."""
    return fit_parts(lambda _: (texts, y), [len(texts)], np.array([np.mean(y == 0), np.mean(y == 1)]), **how)


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1200, memory: int = 1 << 26, seed: int = 7) -> Net:
    """Fit on at most ``per_label`` labelled documents of each label, none of them held out, and on the whole text of each.

    The sample is the labelled rows with the least seeded hash; of rows that share
    an id the least text is learned from. It is saved in the shared folder and
    read in parts of some ``memory`` bytes (or one text), so the driver holds that
    much of it. Labels other than 0 and 1 and null ids are ignored. A null or
    empty text is learned from as an empty one. Without rows of both labels, or
    documents, the untrained network scores 0.5 plus or minus its noise.
    """
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    picked = None
    for label in (0, 1):
        part = rows.where(F.col("quality") == label).select("doc_id", "quality").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_label)
        picked = part if picked is None else picked.union(part)
    share = {int(r[0]): r[1] for r in rows.groupBy("quality").count().collect()}
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    sample = saved(sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "sample")
    size, n, good = sample.agg(F.sum(F.octet_length("text").cast("long")), F.count(F.lit(1)), F.sum("quality")).first()
    if not n or good in (0, n):
        return Net(seed)
    parts = -(-(size + 1) // memory)
    at = sample.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    sizes = [int(r[1]) for r in sorted(at.groupBy("part").count().collect())]
    names = sorted(r[0] for r in at.select("part").distinct().collect())

    @functools.lru_cache(1)
    def load(part: int) -> tuple[list[bytes], np.ndarray]:
        got = sorted((r[0], r[1], r[2]) for r in at.where(F.col("part") == names[part]).select("doc_id", "text", "quality").collect())
        return [r[1].encode() for r in got], np.array([r[2] for r in got], np.int64)

    sampled = np.array([n - good, good]) / n
    net = fit_parts(load, sizes, sampled, seed=seed)
    # From the sample's shares to those of all labelled rows.
    net.p["d"] += np.float32(np.log(share[1] / share[0]) - np.log(sampled[1] / sampled[0]))
    return net


def _scores(net: Net, column) -> np.ndarray:
    raw, off = flat(column)
    out = [net.score(raw[off[a] : off[z]], off[a : z + 1] - off[a]) for a, z in slices(off, 1 << 20)]
    return np.concatenate(out) if out else np.zeros(0)


def score_documents(docs: DataFrame, net: Net, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if the score reaches the threshold).

    The whole text is scored, and only its bytes are. A null text scores as an
    empty one. Equal texts score alike, so repeated rows do. A null doc_id isn't
    held out. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            s = _scores(net, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Net, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold.

    Rows are judged one by one by their whole text, a null one as the empty text;
    ids don't matter, equal texts fare alike, and an empty table stays one.
    """

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(net, batch.column(text)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def crc_rest(doc_id: int) -> int:
    """The same remainder in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4
