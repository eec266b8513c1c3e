"""Suffix-array dedup of byte strings by linear grouping construction.

Two equal 50-byte strings have the same least 16-byte hash in them, at the same
place. The strings of a document that have it at one spot, all in their first
half or all in their second, lie in one stretch, and the bytes that they have in
common (33 or 34) are its core. A stretch whose core is in one document alone
can't hold a repeated string. The other stretches go, each distinct one once per
chunk of documents, to the bucket that owns the core's hash. There the stretches
of each core form one string, whose suffix array is built by linear grouping
(:mod:`suffix_groups`); neighbours in it that agree in 50 bytes are the same
string, which decides the least doc_id it starts in.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import SPAN, buckets_of, by_bucket, chunked, flat, group_minmax, member, mix, powers, prefix_sums, span_hash, texts
from ._exchange import answer, ask, ask_again, finish, gathered, pack, unpack
from .suffix_groups import suffix_arrays

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: A core that so many chunks ask about is hot: its strings go to buckets one by one, by their own hash.
HOT = 4096
#: Stretches of one core that make one string for the suffix array; more of them are dealt out by more of their bytes.
TOGETHER = 32
#: Symbols that go through the construction together.
BATCH = 1 << 20
#: Bytes of stretches whose windows are looked at together.
SLICE = 2 << 20
#: Starts of windows that are hashed together, few enough for the processor's cache.
BLOCK = 1 << 14


def _spots(total: np.ndarray, window: int, gram: int) -> np.ndarray:
    """How far into each window its (first) least hash of ``gram`` bytes is. ``total``: prefix sums of the bytes."""
    most, n = window - gram + 1, len(total) - window
    inverse, long = powers(1, len(total), True), np.uint64(gram) << np.uint64(48)
    out = np.empty(n, np.uint8 if most < 256 else np.uint16)
    for a in range(0, n, BLOCK):
        z = min(a + BLOCK, n) + most - 1
        h = total[a + gram : z + gram] - total[a:z]
        h *= inverse[a:z]
        h ^= long
        have, at, done = _rank(mix(h)), np.zeros(z - a, out.dtype), 1
        while done < most:
            step = min(done, most - done)
            left, right = have[:-step], have[step:]
            # at[step:] + step where right < left, by masks: several times as fast as where().
            other = at[step:] + out.dtype.type(step)
            other ^= at[:-step]
            other &= np.negative((right < left).astype(out.dtype))
            other ^= at[:-step]
            at, have, done = other, np.minimum(left, right), done + step
        out[a : a + len(at)] = at
    return out


def _rank(h: np.ndarray) -> np.ndarray:
    """What of a hash decides which is the least."""
    return (h >> np.uint64(32)).astype(np.uint32)


class _Bytes:
    """The bytes of a chunk's documents, and the stretches of windows with the same core."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        table = texts(table)
        self.raw, self.off = flat(table.column("text"))
        ids = table.column("doc_id").combine_chunks()
        self.known = ~np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.window, n = window, len(self.raw)
        none = np.zeros(0, np.int64)
        self.low, self.high, self.row, self.core = none, none, none, np.zeros(0, np.uint64)
        self.sums = prefix_sums(self.raw, 1)
        if n < window:
            return
        spot = _spots(self.sums, window, gram)
        long = np.flatnonzero(self.known & (np.diff(self.off) >= window))
        edge = np.zeros(n + 2 - window, np.int8)
        np.add.at(edge, self.off[long], 1)
        np.add.at(edge, self.off[long + 1] - window + 1, -1)
        whole = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        most = window - gram + 1
        rest = most // 2
        late = spot < rest
        head = np.append(True, (spot[1:] + spot.dtype.type(1) != spot[:-1]) | (late[1:] != late[:-1]) | ~whole[:-1])
        head[self.off[long]] = True
        head &= whole
        self.low = np.flatnonzero(head)
        self.high = np.flatnonzero(np.append(head[1:] | ~whole[1:], True) & whole) + window
        self.row = np.searchsorted(self.off, self.low, "right") - 1
        at, late = self.low + spot[self.low], late[self.low]
        # All windows that have the spot in their first half, or in their second, have these bytes.
        first, last = np.where(late, at, at - rest), np.where(late, at - rest + 1 + window, at + gram)
        self.core = span_hash(self.raw, first, last, 1, self.sums)

    def split(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The single windows of some stretches: their starts, rows and stretches."""
        count = self.high[which] - self.low[which] - self.window + 1
        of = np.repeat(which, count)
        start = self.low[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        return start, self.row[of], of


def _token(core: np.ndarray) -> np.ndarray:
    """48 bits of a core's hash, the lowest for a flag: enough to ask by, as stretches with equal tokens are still told apart."""
    return core >> np.uint64(17) << np.uint64(1)


def _tokens(token: np.ndarray) -> bytes:
    return pack((token >> np.uint64(16)).astype(np.uint32), token.astype(np.uint16))


def _told(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a table, and the row of each."""
    row, (upper, lower) = gathered(table, (np.uint32, np.uint16))
    return row, (upper.astype(np.uint64) << np.uint64(16)) | lower


def _mark(core: np.ndarray, lone: np.ndarray) -> np.ndarray:
    """What stretches are grouped and looked up by, from the bits that don't choose the bucket; the lowest bit says that it is one window of a hot core."""
    return (core.astype(np.uint32) >> np.uint32(1) << np.uint32(1)) | lone


def _grams(b: _Bytes, buckets: int) -> list[tuple[int, bytes]]:
    order = np.argsort(b.core, kind="stable")  # rows come by doc_id
    core, row = b.core[order], b.row[order]
    new = core[1:] != core[:-1]
    first, last = np.append(True, new)[: len(core)], np.append(new, True)[: len(core)]
    token = _token(core[first]) | (b.ids[row[first]] != b.ids[row[last]])
    return [(k, _tokens(token[i])) for k, i in by_bucket((core[first] >> np.uint64(40)) % np.uint64(buckets))]


def _repeated(table: pa.Table) -> list[tuple[int, bytes]]:
    """To each chunk its cores that are in two documents; the lowest bit says that they are hot."""
    row, token = _told(table)
    value, several = token >> np.uint64(1), (token & np.uint64(1)).astype(bool)
    order = np.argsort(value, kind="stable")
    s = value[order]
    group = np.cumsum(np.append(True, s[1:] != s[:-1])) - 1
    asked = np.bincount(group)
    shared = (asked > 1) | (np.bincount(group, several[order]) > 0)
    keep = shared[group]
    out = (s[keep] << np.uint64(1)) | (asked > HOT)[group[keep]]
    chunks = table.column("chunk").to_numpy()
    return [(int(chunks[r]), _tokens(out[i])) for r, i in by_bucket(row[order[keep]])]


_STRETCHES = (np.uint8, np.uint16, np.uint32, np.uint32, np.uint32, np.int64)


def _take(raw: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raw[low:low+size] of each, end to end."""
    return raw[np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def _stretches(b: _Bytes, got: pa.Table, buckets: int) -> list[tuple[int, bytes]]:
    """Each distinct stretch with a shared core: its bytes, the core's hash, and the least and largest doc_id here."""
    shared = np.sort(_told(got)[1])
    mine = _token(b.core)
    warm = np.flatnonzero(member(mine, shared[(shared & np.uint64(1)) == 0]))
    hot = np.flatnonzero(member(mine | np.uint64(1), shared[(shared & np.uint64(1)) == 1]))
    start, row, of = b.split(hot)
    low = np.concatenate([b.low[warm], start])
    size = np.concatenate([b.high[warm] - b.low[warm], np.full(len(start), b.window)])
    h1 = span_hash(b.raw, low, low + size, 1, b.sums)
    h2 = span_hash(b.raw, low, low + size, 2)
    core = np.concatenate([b.core[warm], b.core[of]])
    home = np.concatenate([b.core[warm], h1[len(warm) :]]) >> np.uint64(40)
    lone = np.concatenate([np.zeros(len(warm), bool), np.ones(len(start), bool)])
    first, less, more = group_minmax([h1, h2], b.ids[np.concatenate([b.row[warm], row])])
    mark = _mark(core, lone)
    out = []
    for k, i in by_bucket(home[first] % np.uint64(buckets)):
        j = first[i]
        # doc_ids in halves and as a difference: mostly zeros, which pack away.
        half = less[i].view(np.uint64)
        out.append((k, pack(_take(b.raw, low[j], size[j]), size[j].astype(np.uint16), mark[j], half.astype(np.uint32), (half >> np.uint64(32)).astype(np.uint32), more[i] - less[i])))
    return out


_RANGES = (np.uint64, np.uint64, np.uint16, np.uint16, np.int64, np.uint32)


def _first_starts(raw: np.ndarray, off: np.ndarray, key: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """For each window of each distinct stretch, the least doc_id it starts in, over all stretches of the same key.

    Windows are counted stretch by stretch.
    """
    size = np.diff(off)
    count = size - window + 1
    base = np.append(0, np.cumsum(count))
    out = np.repeat(least, count)
    order = np.argsort(key, kind="stable")
    s = key[order]
    cut = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(s))
    # A key with one stretch has nothing to be ordered against: its windows start in that stretch's documents alone.
    several = ends - cut > 1
    # Long keys last, so that strings of like length go through the construction together.
    symbols_in = np.add.reduceat(size[order] + 1, cut) if len(cut) else cut
    cut, ends, symbols_in = cut[several], ends[several], symbols_in[several]
    by_size = np.argsort(symbols_in, kind="stable")
    spent = np.cumsum(symbols_in[by_size]) // BATCH
    for batch in np.split(by_size, np.flatnonzero(np.diff(spent)) + 1) if len(by_size) else []:
        n_of = ends[batch] - cut[batch]
        rows = order[np.repeat(cut[batch] - np.cumsum(n_of) + n_of, n_of) + np.arange(int(n_of.sum()))]
        sz = size[rows]
        # Symbols: 2.. for bytes, 1 after each stretch, but 0 after the last of a key.
        to = np.cumsum(sz + 1) - sz - 1
        text = np.ones(int((sz + 1).sum()), np.uint16)
        fill = np.repeat(to - np.cumsum(sz) + sz, sz) + np.arange(int(sz.sum()))
        data = _take(raw, off[rows], sz)
        text[fill] = data.astype(np.uint16) + 2
        last = np.cumsum(n_of) - 1
        text[to[last] + sz[last]] = 0
        strings = np.append(0, np.cumsum(np.add.reduceat(sz + 1, np.append(0, last[:-1] + 1))))
        suffixes = suffix_arrays(text, strings)
        of = np.repeat(np.arange(len(rows)), sz + 1)
        at = suffixes - to[of[suffixes]]
        keep = at + window <= sz[of[suffixes]]
        suffixes, at = suffixes[keep], at[keep]
        if not len(suffixes):
            continue
        window_no = base[rows[of[suffixes]]] + at
        view = np.lib.stride_tricks.sliding_window_view(text, window)
        same = np.zeros(len(suffixes), bool)
        for a in range(1, len(suffixes), 1 << 16):
            z = min(len(suffixes), a + (1 << 16))
            same[a:z] = (view[suffixes[a:z]] == view[suffixes[a - 1 : z - 1]]).all(axis=1)
        whose = np.searchsorted(strings, suffixes, "right")
        same[1:] &= whose[1:] == whose[:-1]
        first = np.flatnonzero(~same)
        low = np.minimum.reduceat(least[rows[of[suffixes]]], first)
        out[window_no] = np.repeat(low, np.diff(np.append(first, len(suffixes))))
    return out


def _solve(raw: np.ndarray, off: np.ndarray, key: np.ndarray, least: np.ndarray, window: int, gram: int, level: int = 1) -> np.ndarray:
    """For each window of each distinct stretch, stretch by stretch, the least doc_id it starts in. Crowded keys are split first; a core is half a window's way, which is level 1."""
    size = np.diff(off)
    count = size - window + 1
    base = np.append(0, np.cumsum(count))
    out = np.empty(int(base[-1]), np.int64)
    _, inverse, many = np.unique(key, return_inverse=True, return_counts=True)
    crowd = (many[inverse] > TOGETHER) & (level < 6)
    for some, how in ((~crowd, _first_starts), (crowd, lambda *a: _apart(*a, gram, level + 1))):
        u = np.flatnonzero(some)
        if len(u):
            got = how(_take(raw, off[u], size[u]), np.append(0, np.cumsum(size[u])), key[u], least[u], window)
            out[np.repeat(base[u] - np.cumsum(count[u]) + count[u], count[u]) + np.arange(int(count[u].sum()))] = got
    return out


def _apart(raw: np.ndarray, off: np.ndarray, key: np.ndarray, least: np.ndarray, window: int, gram: int, level: int) -> np.ndarray:
    """Crowded keys: stretches are cut where the least hash has moved through a part of the window, and what all windows of a piece have in common is the new key.

    Where a window has its (first) least hash depends on its bytes alone, so
    equal windows are in pieces of one key. At the last level a piece is one
    window and its key is all of it.
    """
    size = np.diff(off)
    count = size - window + 1
    n = len(raw)
    h = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    at = np.arange(n - gram + 1)
    item = np.repeat(np.arange(len(size)), size)
    at = at[at + gram <= off[item[at] + 1]]
    h[at] = _rank(span_hash(raw, at, at + gram, 1))
    spots = np.flatnonzero(h == np.minimum.reduceat(h, off[:-1])[item])
    of = np.repeat(np.arange(len(size)), count)
    start = off[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    spot = spots[np.searchsorted(spots, start)]
    most = window - gram + 1
    width = max(1, -(-most // (1 << level)))
    part = (start - spot + most - 1) // width
    head = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (part[1:] != part[:-1]) | (spot[1:] != spot[:-1])))
    windows = np.diff(np.append(head, len(of)))
    low, bits = start[head], windows + window - 1
    first = spot[head] - most + 1 + part[head] * width
    core = span_hash(raw, first + width - 1, first + window, 3) if width > 1 else span_hash(raw, low, low + window, 3)
    new = core ^ (part[head].astype(np.uint64) << np.uint64(32))
    # Equal pieces once, with their least doc_id.
    h1, h2 = span_hash(raw, low, low + bits, 1), span_hash(raw, low, low + bits, 2)
    keys = [new, h1, h2]
    one, less, _ = group_minmax(keys, least[of[head]])
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(order), bool)
    same[1:] = (new[order][1:] == new[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(~same) - 1
    got = _solve(_take(raw, low[one], bits[one]), np.append(0, np.cumsum(bits[one])), new[one], less, window, gram, level)
    at = np.append(0, np.cumsum(windows[one]))[which]
    return got[np.repeat(at - np.cumsum(windows) + windows, windows) + np.arange(len(of))]


def _runs(raw: np.ndarray, off: np.ndarray, key: np.ndarray, least: np.ndarray, part: np.ndarray, window: int, gram: int):
    """For some of the stretches, all of their keys: runs of windows with one least doc_id as (stretch, first window, windows, doc_id)."""
    size = np.diff(off)[part]
    count = size - window + 1
    base = np.append(0, np.cumsum(count))
    starts = _solve(_take(raw, off[part], size), np.append(0, np.cumsum(size)), key[part], least[part], window, gram)
    of = np.repeat(np.arange(len(part)), count)
    head = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (starts[1:] != starts[:-1])))
    return part[of[head]], head - base[of[head]], np.diff(np.append(head, len(of))), starts[head]


def _earliest(table: pa.Table, window: int, gram: int) -> list[tuple[int, bytes]]:
    """To each chunk, the parts of its stretches that start in an earlier document elsewhere."""
    got = [unpack(v.as_py(), _STRETCHES) for v in table.column("payload")]
    raw, size, mark, less, upper, more = (np.concatenate([g[i] for g in got]) for i in range(6))
    low = ((upper.astype(np.uint64) << np.uint64(32)) | less).view(np.int64)
    high = low + more
    row = np.repeat(np.arange(len(got)), [len(g[1]) for g in got])
    size = size.astype(np.int64)
    off = np.append(0, np.cumsum(size))
    data, known = raw.tobytes(), {}
    which = np.fromiter((known.setdefault(data[a:b], len(known)) for a, b in zip(off[:-1], off[1:], strict=True)), np.int64, len(size))
    _, first = np.unique(which, return_index=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, low)
    uoff = np.append(0, np.cumsum(size[first]))
    uraw, key = _take(raw, off[first], size[first]), mark[first]
    del got, raw, data, known
    # Keys in slices, so that what is kept for each window is kept for a few MB of stretches at a time.
    order = np.argsort(key, kind="stable")
    edge = np.append(True, key[order][1:] != key[order][:-1])
    place = (np.cumsum(size[first][order]) // SLICE)[np.flatnonzero(edge)][np.cumsum(edge) - 1]
    runs = [_runs(uraw, uoff, key, least, part, window, gram) for part in np.split(order, np.flatnonzero(np.diff(place)) + 1)]
    run_of, run_at, run_len, run_id = (np.concatenate([r[i] for r in runs]) for i in range(4))
    by_stretch = np.argsort(run_of, kind="stable")
    run_of, run_at, run_len, run_id = run_of[by_stretch], run_at[by_stretch], run_len[by_stretch], run_id[by_stretch]
    run_base = np.searchsorted(run_of, np.arange(len(first) + 1))
    # Each asking chunk hears of the runs that concern its later documents.
    n = run_base[which + 1] - run_base[which]
    q = np.repeat(np.arange(len(which)), n)
    r = run_base[which[q]] + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
    tell = run_id[r] < high[q]
    q, r = q[tell], r[tell]
    uh1, uh2 = (span_hash(uraw, uoff[:-1], uoff[1:], w) for w in (1, 2))
    chunks = table.column("chunk").to_numpy()
    return [
        (int(chunks[c]), pack(uh1[which[q[i]]], uh2[which[q[i]]], run_at[r[i]].astype(np.uint16), run_len[r[i]].astype(np.uint16), run_id[r[i]], mark[q[i]]))
        for c, i in by_bucket(row[q])
    ]


def _removed(b: _Bytes, got: pa.Table) -> np.ndarray:
    """Which bytes a string covers that starts in an earlier document."""
    _, (g1, g2, at, length, least, mark) = gathered(got, _RANGES)
    n = len(b.raw)
    cover = np.zeros(n + 1, np.int64)
    if not len(g1) or not len(b.low):
        return cover[:n] > 0
    order = np.argsort(g1, kind="stable")
    g1, g2, at, length, least = g1[order], g2[order], at[order].astype(np.int64), length[order].astype(np.int64), least[order]
    told = np.unique(mark)
    warm = np.flatnonzero(member(_mark(b.core, False), told))
    start, row, _ = b.split(np.flatnonzero(member(_mark(b.core, True), told[(told & np.uint32(1)) == 1])))
    low = np.concatenate([b.low[warm], start])
    size = np.concatenate([b.high[warm] - b.low[warm], np.full(len(start), b.window)])
    doc = b.ids[np.concatenate([b.row[warm], row])]
    h1 = span_hash(b.raw, low, low + size, 1, b.sums)
    lo, hi = np.searchsorted(g1, h1, "left"), np.searchsorted(g1, h1, "right")
    many = hi - lo
    i = np.repeat(np.arange(len(low)), many)
    j = np.repeat(lo, many) + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    near = least[j] < doc[i]
    i, j = i[near], j[near]
    sure = span_hash(b.raw, low, low + size, 2)[i] == g2[j]
    i, j = i[sure], j[sure]
    np.add.at(cover, low[i] + at[j], 1)
    np.add.at(cover, low[i] + at[j] + length[j] + b.window - 1, -1)
    return np.cumsum(cover)[:n] > 0


def _digest(b: _Bytes, gone: np.ndarray) -> pa.Table:
    n = len(b.ids)
    row = np.repeat(np.arange(n), np.diff(b.off))
    head = gone & np.append(True, ~gone[:-1] | (row[1:] != row[:-1]))[: len(gone)] if len(gone) else gone
    left = np.bincount(row[~gone], minlength=n).astype(np.int64)
    data, off = b.raw[~gone].tobytes(), np.append(0, np.cumsum(left))
    kept = [data[x:y] for x, y in zip(off[:-1], off[1:], strict=True)]
    return pa.table({
        "doc_id": pa.array(b.ids, pa.int64(), mask=~b.known),
        "n_bytes": pa.array(np.diff(b.off)),
        "n_removed": pa.array(np.diff(b.off) - left),
        "n_spans": pa.array(np.bincount(row[head], minlength=n).astype(np.int64)),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        "kept": pa.array(kept, pa.binary()),
    })


def suffix_dedup(docs: DataFrame, window: int = 50, gram: int = 16, key: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless left out, kept (the remaining bytes).

    A byte goes if a ``window``-byte string covers it that also starts in a
    document with a smaller doc_id; strings are judged on the input and never
    cross documents. A null text is empty; a shorter text keeps all. Rows that
    repeat a doc_id are one document for this purpose. Rows with a null doc_id
    keep all bytes. Extra columns are ignored; an empty table gives an empty
    result.
    """
    if 2 * window > SPAN:
        raise ValueError(f"windows have at most {SPAN // 2} bytes")
    base, buckets = chunked(docs, key, text), buckets_of(docs)
    wide = 2 * buckets  # stretches are longer than hashes
    grams = answer(ask(base, lambda t: _grams(_Bytes(t, window, gram), buckets)), _repeated)
    parts = ask_again(base, grams, lambda t, got: _stretches(_Bytes(t, window, gram), got, wide))
    ranges = answer(parts, lambda t: _earliest(t, window, gram))

    def rows(table: pa.Table, got: pa.Table) -> pa.Table:
        b = _Bytes(table, window, gram)
        out = _digest(b, _removed(b, got))
        return out if with_bytes else out.drop_columns(["kept"])

    return finish(base, ranges, rows, RESULT + ", kept binary" * with_bytes)
