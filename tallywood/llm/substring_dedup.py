"""Substring dedup by level-wise doubling over word windows.

Level 1 asks about short runs of words: of the runs inside a window, the one
with the least hash, which equal windows have at the same place. A window whose
run is in one document alone can't be repeated and drops out. A run that is
repeated is extended to twice its length, still inside its window, and asked
about again, until a level is as long as the window or no candidates survive.
Hashes only choose candidates. At the last level the words themselves go to the
bucket of their run, and windows are compared there word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import buckets_of, by_bucket, chunked, flat, gram_codes, gram_hash, group_minmax, member, ranges, spaced, texts, word_codes, word_hash, words
from ._exchange import answer, ask, ask_again, finish, gathered, pack, unpack

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: The first level has runs of so many words at most.
SHORTEST = 4


def levels(window: int) -> list[int]:
    """Lengths of the runs, each at most twice the one before; the last is the window."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Words:
    """The words of a chunk's documents, their windows and the runs that stand for them."""

    def __init__(self, table: pa.Table, window: int):
        table = texts(table)
        self.raw, self.off = flat(table.column("text"))
        ids = table.column("doc_id").combine_chunks()
        self.known = ~np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start, self.end, self.row = words(self.raw, self.off)
        self.window, self.levels, n = window, levels(window), len(self.start)
        whole = np.zeros(n, bool)
        if n >= window:
            whole[: n - window + 1] = self.row[: n - window + 1] == self.row[window - 1 :]
            whole &= self.known[self.row]
        self.at = np.flatnonzero(whole)  # windows by their first word
        self.doc = self.ids[self.row[self.at]]
        self.h = word_hash(self.raw, self.start, self.end, 1)
        least = gram_hash(self.h, self.levels[0])
        low, place = least[self.at], np.zeros(len(self.at), np.int64)
        for j in range(1, window - self.levels[0] + 1):
            now = least[self.at + j]
            less = now < low
            low, place = np.where(less, now, low), np.where(less, j, place)
        self.low, self.place = low, place

    def run(self, level: int) -> np.ndarray:
        """Where in each window its run of this level starts."""
        place = self.place
        for short, long in zip(self.levels[:level], self.levels[1 : level + 1], strict=True):
            place = np.where(place + long <= self.window, place, np.maximum(0, place + short - long))
        return place

    def token(self, level: int) -> np.ndarray:
        if level == 0:
            return self.low
        return gram_hash(self.h, self.levels[level])[self.at + self.run(level)]

    def alive(self, level: int, got: pa.Table) -> np.ndarray:
        """Which windows' runs of this level are in two documents."""
        _, (shared,) = gathered(got, (np.uint64,))
        return member(self.token(level) >> np.uint64(1), np.sort(shared))

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring windows with one and the same run, as ranges of windows."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spot = self.at + self.place
        head = np.flatnonzero(np.append(True, (spot[1:] != spot[:-1]) | (self.at[1:] != self.at[:-1] + 1)))
        return head, np.append(head[1:], len(self.at))

    def copies(self, low: np.ndarray, high: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The words of each stretch, and for each the first stretch of the chunk with the same words."""
        data, to = spaced(self.raw, self.start, self.end, self.row)
        data, last = data.tobytes(), self.at[high - 1] + self.window - 1
        said = [data[a:z] for a, z in zip(to[self.at[low]].tolist(), (to[last] + self.end[last] - self.start[last]).tolist(), strict=True)]
        known: dict[bytes, int] = {}
        return said, np.fromiter((known.setdefault(x, k) for k, x in enumerate(said)), np.int64, len(said))


def _runs(w: _Words, level: int, buckets: int, got: pa.Table | None = None) -> list[tuple[int, bytes]]:
    """Each distinct run of a level, of the windows that survived the one before; the lowest bit says that two documents of the chunk have it."""
    token, doc = w.token(level), w.doc
    if got is not None:
        alive = w.alive(level - 1, got)
        token, doc = token[alive], doc[alive]
    first, low, high = group_minmax([token], doc)
    token = (token[first] >> np.uint64(1) << np.uint64(1)) | (low != high)
    return [(b, pack(token[i])) for b, i in by_bucket((token >> np.uint64(40)) % np.uint64(buckets))]


def _repeated(table: pa.Table) -> list[tuple[int, bytes]]:
    """Which runs are in two documents: two chunks ask, or one asks that has it in two."""
    row, (token,) = gathered(table, (np.uint64,))
    value, several = token >> np.uint64(1), (token & np.uint64(1)).astype(bool)
    order = np.argsort(value, kind="stable")
    s = value[order]
    head = np.append(True, s[1:] != s[:-1])
    group = np.cumsum(head) - 1
    shared = (np.bincount(group) > 1) | (np.bincount(group, several[order]) > 0)
    keep = order[shared[group]]
    chunks = table.column("chunk").to_numpy()
    return [(int(chunks[r]), pack(value[keep][i])) for r, i in by_bucket(row[keep])]


_STRETCHES = (np.uint8, np.uint32, np.uint32, np.int64, np.int64)


def _said(w: _Words, buckets: int, got: pa.Table) -> list[tuple[int, bytes]]:
    """Each distinct stretch with a window that survived: its words, its number in the chunk, and the least and largest doc_id here."""
    low, high = w.stretches()
    if not len(low):
        return []
    alive = np.add.reduceat(w.alive(len(w.levels) - 2, got), low, dtype=np.int64) > 0 if len(w.levels) > 1 else np.ones(len(low), bool)
    said, same = w.copies(low, high)
    asked = np.flatnonzero(alive)
    first, less, more = group_minmax([same[asked]], w.doc[low[asked]])
    number = same[asked][first]
    out = []
    for b, i in by_bucket((w.low[low[number]] >> np.uint64(40)) % np.uint64(buckets)):
        mine = [said[k] for k in number[i].tolist()]
        out.append((b, pack(np.frombuffer(b"".join(mine), np.uint8), np.array([len(x) for x in mine], np.uint32), number[i].astype(np.uint32), less[i], more[i] - less[i])))
    return out


_EARLIER = (np.uint32, np.uint32, np.uint32, np.int64)


def _earliest(table: pa.Table, window: int) -> list[tuple[int, bytes]]:
    """To each chunk, the windows of its stretches that start in an earlier document than one it has them in: stretch, first window, windows, least doc_id."""
    got = [unpack(v.as_py(), _STRETCHES) for v in table.column("payload")]
    raw, size, number, less, more = (np.concatenate([g[i] for g in got]) for i in range(5))
    asker = np.repeat(np.arange(len(got)), [len(g[1]) for g in got])
    start, end, row = words(raw, np.append(0, np.cumsum(size.astype(np.int64))))
    code = gram_codes(word_codes(raw, start, end), window)
    at = np.flatnonzero(row[: len(code)] == row[window - 1 :])
    code, row = np.unique(code[at], return_inverse=True)[1].reshape(-1), row[at]
    least = np.full(int(code.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, code, less[row])
    least = least[code]
    first = np.searchsorted(row, np.arange(len(size)))
    tell = np.flatnonzero(least < (less + more)[row])
    if not len(tell):
        return []
    s, d = row[tell], least[tell]
    head = np.flatnonzero(np.append(True, (tell[1:] != tell[:-1] + 1) | (s[1:] != s[:-1]) | (d[1:] != d[:-1])))
    many = np.diff(np.append(head, len(tell)))
    s, d, place = s[head], d[head], (tell[head] - first[s[head]])
    chunks = table.column("chunk").to_numpy()
    return [(int(chunks[r]), pack(number[s[i]], place[i].astype(np.uint32), many[i].astype(np.uint32), d[i])) for r, i in by_bucket(asker[s])]


def _removed(w: _Words, got: pa.Table) -> np.ndarray:
    """Which words a window covers that starts in an earlier document."""
    _, (number, place, many, least) = gathered(got, _EARLIER)
    n = len(w.start)
    cover = np.zeros(n + 1, np.int64)
    if len(number):
        low, high = w.stretches()
        _, same = w.copies(low, high)
        order = np.argsort(same, kind="stable")
        lo, hi = np.searchsorted(same[order], number, "left"), np.searchsorted(same[order], number, "right")
        stretch, j = order[ranges(lo, hi - lo)], np.repeat(np.arange(len(number)), hi - lo)
        later = least[j] < w.doc[low[stretch]]
        stretch, j = stretch[later], j[later]
        first = w.at[low[stretch]] + place[j]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + many[j].astype(np.int64) + w.window - 1, -1)
    return np.cumsum(cover)[:n] > 0


def _digest(w: _Words, gone: np.ndarray) -> pa.Table:
    n, keep = len(w.ids), ~gone
    data, _ = spaced(w.raw, w.start[keep], w.end[keep], w.row[keep])
    row, size = w.row[keep], (w.end - w.start)[keep]
    gap = np.append(False, row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    off = np.append(0, np.cumsum(np.bincount(row, size + gap, n).astype(np.int64) if len(row) else np.zeros(n, np.int64)))
    data = data.tobytes()
    kept = [data[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    return pa.table({
        "doc_id": pa.array(w.ids, pa.int64(), mask=~w.known),
        "n_words": pa.array(np.bincount(w.row, minlength=n).astype(np.int64)),
        "n_removed": pa.array(np.bincount(w.row[gone], minlength=n).astype(np.int64)),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        "kept_text": pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()),
    })


def substring_dedup(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, unless left out, kept_text.

    A word goes if a window of ``window`` words covers it whose word sequence
    also starts in a document with a smaller doc_id. Windows are judged on the
    input and never cross documents. A null or empty text has no words; a text
    shorter than the window keeps all. Rows that repeat a doc_id are one
    document for this purpose: they don't remove each other's words. A null
    doc_id is neither smaller nor larger than another, so such rows keep all
    words. Extra columns are ignored; an empty table gives an empty result.
    """
    base, buckets = chunked(docs, key, text), buckets_of(docs)
    got = None
    for level in range(len(levels(window)) - 1):
        if got is None:
            asked = ask(base, lambda t: _runs(_Words(t, window), 0, buckets))
        else:
            asked = ask_again(base, got, lambda t, g, level=level: _runs(_Words(t, window), level, buckets, g))
        got = answer(asked, _repeated)
    if got is None:
        full = ask(base, lambda t: _said(_Words(t, window), buckets, t))
    else:
        full = ask_again(base, got, lambda t, g: _said(_Words(t, window), buckets, g))

    def rows(table: pa.Table, got: pa.Table) -> pa.Table:
        w = _Words(table, window)
        out = _digest(w, _removed(w, got))
        return out if with_text else out.drop_columns(["kept_text"])

    return finish(base, answer(full, lambda t: _earliest(t, window)), rows, RESULT + ", kept_text string" * with_text)
