"""Benchmark decontamination by spaced-seed hashing.

A mask picks 5 words of a few consecutive ones; the hash of the picked words is
the seed of that position, so a seed survives substitutions at the positions its
mask ignores. The four masks lose nothing: every stretch with 10 matching words,
75 % or more of its words, has a seed (of longer stretches, one half counts as
well; all shorter ones are gone through in the tests). Seeds of the documents
are joined with those of the benchmark, and the two texts are compared word by
word along the whole of each diagonal that has a hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import flat, mix, ranges, slices, word_hash, words
from .near_dedup import lowered

#: These find every overlap of LEAST matching words or more, PERCENT or more of its words.
MASKS = ("11111", "110111", "100001111", "1101000011")
LEAST, PERCENT = 10, 75
#: Benchmark items, and bytes of them (or one item), that are looked for in one pass over the documents.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
#: Hits, or words along their diagonals, that are held at a time.
HELD = 1 << 20
RESULT = "doc_id long, item_id long, n_matched long, n_overlap long, doc_start long, item_start long"


def _seeds(h: np.ndarray, at: np.ndarray, mask: str) -> np.ndarray:
    out = np.full(len(at), int(mask, 2), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out += h[at + j] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & (2**64 - 1))
    return mix(out)


def masks_for(least: int, percent: int) -> tuple[str, ...]:
    """Masks that find every overlap of ``least`` matching words, ``percent`` of its words: below the usual ones, the run of matches that can't be avoided."""
    if least >= LEAST and percent >= PERCENT:
        return MASKS
    # m matches lie in one run more than there are mismatches; the average is least where a mismatch was just allowed.
    return ("1" * min(-(-m // (m * (100 - percent) // percent + 1)) for m in range(least, least + 101)),)


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes add up to HELD at most (or of one entry)."""
    total, i = np.append(0, np.cumsum(sizes)), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + HELD, "right")) - 1)
        yield i, j
        i = j


def overlap(same: np.ndarray, percent: int) -> tuple[int, int, int]:
    """(matched, length, start) of the stretch with the most matches of which at least ``percent`` of the words match; the shortest, then the first, of several."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    score = np.append(0, np.cumsum(np.where(same, 100 - percent, -percent)))
    count = np.append(0, np.cumsum(same))
    # The furthest start for each end is where the score first was no higher than at the end.
    start = np.searchsorted(-np.minimum.accumulate(score), -score[at + 1], "left")
    matched = count[at + 1] - count[start]
    most = int(matched.max())
    last = np.flatnonzero(matched == most)
    length = at[last] - at[last - most + 1] + 1
    one = int(np.argmin(length))
    return most, int(length[one]), int(at[last[one] - most + 1])


class Benchmark:
    """The seeds of some benchmark items, ready for look-up."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS):
        data = pa.array([(t or "").encode() for _, t in items], pa.binary())
        raw, off = flat(data)
        raw = lowered(raw)
        start, end, row = words(raw, off)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.raw, self.start, self.end = raw, start, end
        self.h = word_hash(raw, start, end, 1)
        self.first = np.searchsorted(row, np.arange(len(items) + 1))
        size = np.diff(self.first)
        seeds, where = [], []
        # Items shorter than all masks have one seed, of all their words.
        shortest = min(map(len, masks))
        self.masks = [*masks, *["1" * n for n in sorted({int(n) for n in size if 0 < n < shortest})]]
        for k, mask in enumerate(self.masks):
            n = len(mask)
            if k < len(masks):
                at = np.flatnonzero(np.arange(len(row)) + n <= self.first[row + 1]) if len(row) else np.zeros(0, np.int64)
            else:
                at = self.first[:-1][size == n]
            seeds.append(_seeds(self.h, at, mask))
            where.append(at)
        seed, where = np.concatenate(seeds), np.concatenate(where)
        order = np.argsort(seed, kind="stable")
        self.seed, self.where, self.row = seed[order], where[order], row
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.seed >> np.uint64(42)).astype(np.int64)] = True

    def diagonals(self, h: np.ndarray, row: np.ndarray) -> Iterator[np.ndarray]:
        """(document row, item, document word - item word) of each diagonal with a hit; one may come again in a later part."""
        hit, lo, many = [], [], []
        n = len(h)
        for mask in self.masks:
            if n < len(mask):
                continue
            at = np.flatnonzero(row[: n - len(mask) + 1] == row[len(mask) - 1 :])
            seed = _seeds(h, at, mask)
            some = self.sieve[(seed >> np.uint64(42)).astype(np.int64)]
            at, seed = at[some], seed[some]
            left, right = np.searchsorted(self.seed, seed, "left"), np.searchsorted(self.seed, seed, "right")
            some = right > left
            hit.append(at[some])
            lo.append(left[some])
            many.append((right - left)[some])
        if not hit:
            return
        hit, lo, many = np.concatenate(hit), np.concatenate(lo), np.concatenate(many)
        order = np.argsort(hit, kind="stable")
        hit, lo, many = hit[order], lo[order], many[order]
        for a, z in _parts(many):
            p, q = np.repeat(hit[a:z], many[a:z]), self.where[ranges(lo[a:z], many[a:z])]
            # Along a diagonal the difference stays, so that it tells diagonals of one document and item apart.
            width = n + len(self.row)
            key = np.unique((row[p] * len(self.ids) + self.row[q]) * width + p - q + len(self.row))
            pair, diagonal = key // width, key % width - len(self.row)
            yield np.stack([pair // len(self.ids), pair % len(self.ids), diagonal], 1)


def _found(bench: Benchmark, raw: np.ndarray, off: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document row, item, matched, length, document word, item word): for each document and item the best overlap that counts."""
    start, end, row = words(raw, off)
    h = word_hash(raw, start, end, 1)
    first = np.searchsorted(row, np.arange(len(off)))
    best: dict[tuple[int, int], tuple] = {}
    for found in bench.diagonals(h, row):
        d, item, diagonal = found.T
        enough = np.minimum(least, bench.first[item + 1] - bench.first[item])
        q = np.maximum(bench.first[item], first[d] - diagonal)
        size = np.minimum(bench.first[item + 1], first[d + 1] - diagonal) - q
        for a, z in _parts(size):
            at = ranges(q[a:z], size[a:z])
            same = h[at + np.repeat(diagonal[a:z], size[a:z])] == bench.h[at]
            head = np.cumsum(size[a:z]) - size[a:z]
            for k in np.flatnonzero(np.add.reduceat(same, head, dtype=np.int64) >= enough[a:z]).tolist():
                matched, length, skip = overlap(same[head[k] : head[k] + size[a + k]], percent)
                if matched >= enough[a + k]:
                    # What the hashes say is looked at word by word.
                    mine = slice(head[k], head[k] + size[a + k])
                    real = same[mine].copy()
                    for j in np.flatnonzero(real).tolist():
                        x, y = int(at[head[k] + j] + diagonal[a + k]), int(at[head[k] + j])
                        real[j] = raw[start[x] : end[x]].tobytes() == bench.raw[bench.start[y] : bench.end[y]].tobytes()
                    if not np.array_equal(real, same[mine]):
                        matched, length, skip = overlap(real, percent)
                if matched >= enough[a + k]:
                    i = a + k
                    pair, word = (int(d[i]), int(item[i])), int(q[i]) + skip
                    got = (matched, -length, -(word + int(diagonal[i])), -word)
                    best[pair] = max(best.get(pair, got), got)
    return [(d, int(bench.ids[i]), m, -n, int(-p - first[d]), int(-q - bench.first[i])) for (d, i), (m, n, p, q) in sorted(best.items())]


def _blocks(benchmark: DataFrame, item: str, text: str, masks: tuple[str, ...]) -> Iterator[Benchmark]:
    """The benchmark in blocks of a bounded number of items and bytes; each is small enough to be sent to all tasks."""
    rows = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    blocks = max(-(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES), min(count, 1))
    while blocks > 1:  # until no block is far above the bound, but for single items
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        over = rows.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size"), F.count_distinct("item_id", "text").alias("kinds"))
        if over.where(f"kinds > 1 AND (n > {2 * BLOCK_ITEMS} OR size > {2 * BLOCK_BYTES})").isEmpty():
            break
        blocks *= 2
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Benchmark(sorted((r[0], r[1]) for r in part.collect()), masks)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 10, percent: int = 75, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """One row per document and benchmark item that it overlaps: doc_id, item_id, n_matched, n_overlap, doc_start, item_start.

    An overlap counts if it has ``least`` matching words, or all words of a
    shorter item, and at least ``percent`` of its words match; words are compared
    with A-Z in lower case. Of several overlaps with an item the one with the
    most matches is reported, then the shortest, then the first. A null or empty text, or item, overlaps with
    nothing. Repeated rows are reported for each; a null doc_id is reported as
    null. An empty table on either side gives an empty result. Extra columns are
    ignored. Documents are never shuffled, so hot sources don't matter.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for bench in _blocks(benchmark, item, "text", masks_for(least, percent)):

        def run(batches, bench=bench):
            for batch in batches:
                raw, off = flat(batch.column("text"))
                raw, ids = lowered(raw), batch.column("doc_id")
                for a, z in slices(off):
                    got = _found(bench, raw[off[a] : off[z]], off[a : z + 1] - off[a], least, percent)
                    cols = list(zip(*got, strict=True)) if got else [()] * 6
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([a + d for d in cols[0]], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                        names=["doc_id", "item_id", "n_matched", "n_overlap", "doc_start", "item_start"],
                    )

        part = rows.mapInArrow(run, RESULT)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 10, percent: int = 75, text: str = "text") -> DataFrame:
    """The documents, with all their columns, that overlap with no benchmark item; see :func:`contaminated`.

    A null or empty text, and any document when the benchmark is empty, stays.
    Rows that repeat, or have no id, are judged one by one.
    """
    for bench in _blocks(benchmark, "item_id", "text", masks_for(least, percent)):

        def run(batches, bench=bench):
            for batch in batches:
                raw, off = flat(batch.column(text))
                raw, clean = lowered(raw), np.ones(batch.num_rows, bool)
                for a, z in slices(off):
                    for got in _found(bench, raw[off[a] : off[z]], off[a : z + 1] - off[a], least, percent):
                        clean[a + got[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
