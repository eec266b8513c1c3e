"""Exact, substring, suffix and near dedup against brute force, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywood.llm import suffix_dedup as S
from tallywood.llm._common import gram_codes, gram_hash, word_codes, word_hash, words
from tallywood.llm.decontaminate import contaminated
from tallywood.llm.exact_dedup import build_index, directory, exact_dedup
from tallywood.llm.near_dedup import EMPTY, near_dedup, needed, signatures
from tallywood.llm.substring_dedup import levels, substring_dedup
from tallywood.llm.suffix_dedup import suffix_dedup
from tallywood.llm.suffix_groups import suffix_arrays

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, h1 string, chunk int, bucket long"  # extra columns with clashing names


def corpus(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base = say(30), say(80)
    rows = []
    for i in range(n):
        kind = i % 6
        text = say(rng.randint(0, 120))
        if kind == 1:
            text = base
        elif kind == 2:
            w = base.split()
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        elif kind == 3:
            text = say(10) + "\n\t" + passage + "  " + say(rng.randint(0, 20))
        elif kind == 4:
            text = (say(1) + " ") * rng.randint(1, 90)
        rows.append((i, text, "x", 1, 2))
    rows += [(100, None, "x", 1, 2), (101, "", "x", 1, 2), (102, " \n ", "x", 1, 2), (None, base, "x", 1, 2), (103, "Ab c", "y", 1, 2), (104, "aB c", "y", 1, 2), (105, " ".join([base] * 40), "z", 1, 2)]
    rows += [rows[1], rows[7]]  # repeated rows
    return rows


@pytest.fixture(params=[1, 2])
def rows(request):
    return corpus(request.param)


def cells_of(keys: list[int], capacity: int) -> dict[int, tuple[int, int]]:
    """The buckets by brute force: (prefix at 64 bits, depth) of each, by splitting one bit at a time."""
    todo, done = [(0, 0, keys)], {}
    while todo:
        prefix, depth, mine = todo.pop()
        if len(mine) > capacity and depth < 64:
            for bit in (0, 1):
                todo.append((2 * prefix + bit, depth + 1, [k for k in mine if k >> (63 - depth) == 2 * prefix + bit]))
        else:
            done[prefix << (64 - depth) if depth else 0] = depth
    return done


@pytest.mark.parametrize("capacity,crowd", [(4, 0), (1, 0), (4, 30), (1000, 0)])
def test_directory_doubles_where_buckets_overflow(spark, capacity, crowd):
    """A crowd of keys that agree in their first 40 bits splits far deeper than the rest."""
    rng = random.Random(capacity)
    keys = sorted({rng.getrandbits(64) for _ in range(60)} | {(5 << 60) + i for i in range(crowd)}) if not crowd else sorted({(5 << 60) + (i << 46) for i in range(crowd)} | {rng.getrandbits(64) for _ in range(20)})
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    cells, depth = directory(spark.createDataFrame([(signed(k),) for k in keys], "key long"), capacity)
    got = cells.collect()
    want = cells_of(keys, capacity)
    assert depth == max(want.values()) and sorted(r.cell for r in got) == list(range(1 << depth))
    assert {(r.bucket, r.depth) for r in got} == {(signed(b), d) for b, d in want.items()}
    assert all((r.cell >> (depth - r.depth)) << (64 - r.depth) == r.bucket % (1 << 64) for r in got if r.depth)


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_exact(spark, rows, bits):
    """With 3 or 0 bits of the hash, different texts collide and are chained in one bucket."""
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), capacity=4, bits=bits).collect()
    assert len(got) == len(rows)
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    expected = sorted(((i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    chains: dict = {}
    for r in got:
        chains.setdefault(r.bucket, {})[r.text_sha256] = r.chain
    if bits == 0:
        assert len(chains) == 1 and sorted(chains[0].values()) == list(range(1, len(groups) + 1))
    else:
        assert len(chains) > 1 and (bits == 64) == all(c == 1 for x in chains.values() for c in x.values())


def test_the_answer_is_read_from_the_buckets(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    index = build_index(table, capacity=4)
    assert index.entries.groupBy("bucket").agg(F.countDistinct("key").alias("n")).where("n > 4").isEmpty()
    assert index.entries.join(index.cells, ["bucket", "depth"], "left_anti").isEmpty()
    assert index.entries.agg(F.sum("group_size")).first()[0] == len(rows)


def brute_words(rows, w=13):
    first: dict[tuple, int] = {}
    docs = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, words in docs:
        for k in range(len(words) - w + 1):
            if i is not None:
                key = tuple(words[k : k + w])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in docs:
        gone = set()
        for k in range(len(words) - w + 1):
            if i is not None and first[tuple(words[k : k + w])] < i:
                gone.update(range(k, k + w))
        kept = " ".join(x for j, x in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring(spark, rows):
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute_words(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def brute_bytes(rows, w=50):
    first: dict[bytes, int] = {}
    docs = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in docs:
        for k in range(len(b) - w + 1):
            if i is not None:
                first[b[k : k + w]] = min(first.get(b[k : k + w], i), i)
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - w + 1):
            if i is not None and first[b[k : k + w]] < i:
                gone[k : k + w] = b"\1" * w
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("together,hot", [(32, 4096), (1, 4096), (32, 0)])
def test_suffix(spark, rows, monkeypatch, together, hot):
    """The same result whether keys are crowded or hot."""
    if together == 32 and hot == 4096:
        got = suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
        assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute_bytes(rows)
        return
    # The stages by hand, as a worker process wouldn't see the patched limits.
    import pyarrow as pa

    from tallywood.llm._common import _packed

    monkeypatch.setattr(S, "TOGETHER", together)
    monkeypatch.setattr(S, "HOT", hot)
    chunks = [rows[k::3] for k in range(3)]
    tables = [pa.Table.from_batches(list(_packed([pa.RecordBatch.from_pydict({"chunk": [k] * len(c), "doc_id": pa.array([r[0] for r in c], pa.int64()), "text": pa.array([r[1] or "" for r in c])})]))) for k, c in enumerate(chunks)]
    b = [S._Bytes(t, 50, 16) for t in tables]

    def exchange(asked, answers):
        told = {k: [] for k in range(3)}
        for bucket in range(2):
            got = [(k, p) for k in range(3) for q, p in asked[k] if q == bucket]
            if got:
                for k, p in answers(pa.table({"bucket": [bucket] * len(got), "chunk": [k for k, _ in got], "payload": pa.array([p for _, p in got], pa.binary())})):
                    told[k].append(p)
        return [pa.table({"chunk": pa.array([k] * len(told[k]), pa.int64()), "payload": pa.array(told[k], pa.binary())}) for k in range(3)]

    one = exchange([S._grams(x, 2) for x in b], S._repeated)
    two = exchange([S._stretches(x, g, 2) for x, g in zip(b, one, strict=True)], lambda t: S._earliest(t, 50, 16))
    out = [r for x, g in zip(b, two, strict=True) for r in S._digest(x, S._removed(x, g)).drop_columns(["kept"]).to_pylist()]
    assert sorted((tuple(r.values()) for r in out), key=repr) == brute_bytes(rows)


def packed_chunk(chunk: int, docs: list[tuple]):
    import pyarrow as pa

    from tallywood.llm._common import _packed

    return pa.Table.from_batches(list(_packed([pa.RecordBatch.from_pydict({"chunk": [chunk] * len(docs), "doc_id": pa.array([r[0] for r in docs], pa.int64()), "text": pa.array([r[1] for r in docs])})])))


def test_suffix_asks_by_core():
    """Phrases of 30 bytes in different surroundings hold no 50-byte string: no stretch is sent for them. One of 50 bytes is."""
    import pyarrow as pa

    rng = random.Random(5)
    noise = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))

    def sent(width: int) -> list:
        phrases = [noise(width) for _ in range(20)]
        b = [S._Bytes(packed_chunk(k, [(k, "".join(noise(60) + p for p in phrases) + noise(60))]), 50, 16) for k in range(2)]
        asked = [(k, p) for k in range(2) for _, p in S._grams(b[k], 1)]
        told = S._repeated(pa.table({"chunk": [k for k, _ in asked], "payload": pa.array([p for _, p in asked], pa.binary())}))
        return [q for k in range(2) for q in S._stretches(b[k], pa.table({"payload": pa.array([p for c, p in told if c == k], pa.binary())}), 1)]

    assert sent(30) == []
    assert len(sent(50)) == 2


@pytest.mark.parametrize("window,gram", [(50, 16), (7, 7), (256, 1), (9, 2)])
def test_spots(window, gram):
    """The first least hash of each window, over blocks and where grams recur."""
    raw = np.frombuffer(("ab" * 9000 + "".join(random.Random(2).choice("abc") for _ in range(2000)) + "a" * 500).encode(), np.uint8)
    at = np.arange(len(raw) - gram + 1)
    rank = S._rank(S.span_hash(raw, at, at + gram, 1))
    expected = [int(np.argmin(rank[k : k + window - gram + 1])) for k in range(len(raw) - window + 1)]
    assert S._spots(S.prefix_sums(raw, 1), window, gram).tolist() == expected


@pytest.mark.parametrize("window,gram", [(20, 20), (21, 4), (40, 7)])
def test_suffix_windows(spark, window, gram):
    rows = corpus(3, 24)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), window, gram, with_bytes=False).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_bytes(rows, window)


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for _ in range(200):
        strings = []
        for _ in range(rng.integers(1, 6)):
            s = rng.integers(2, 3 + rng.integers(1, 4), rng.integers(0, 30)).tolist()
            strings.append((s * rng.integers(1, 4)) + [0])
        off = np.append(0, np.cumsum([len(s) for s in strings]))
        expected = [o + i for s, o in zip(strings, off[:-1], strict=True) for i in sorted(range(len(s)), key=lambda i, s=s: s[i:])]
        assert suffix_arrays(np.concatenate([np.array(s) for s in strings]), off).tolist() == expected


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sorted(((i, len(sets[i]), label.get(i), i is None or label[i] == i) for i, *_ in rows), key=repr)


def test_near(spark, rows):
    got = near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute_components(rows)


@pytest.mark.parametrize("op", [exact_dedup, substring_dedup, suffix_dedup, near_dedup])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text(spark):
    long = " ".join(f"w{i % 9973}x{i}" for i in range(60_000))
    rows = [(1, long, "x", 1, 2), (2, "start " + long, "x", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.n_removed for r in substring_dedup(df).orderBy("doc_id").collect()] == [0, 60_000]
    assert [r.n_removed for r in suffix_dedup(df).orderBy("doc_id").collect()] == [0, len(long)]
    assert [r.component_id for r in near_dedup(df).orderBy("doc_id").collect()] == [1, 1]


def morse(n: int, a: str = "a", b: str = "b") -> str:
    """A pattern that polynomial hashes modulo 2**64 don't tell from the one with a and b exchanged."""
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_in_polynomials(spark, n):
    one, two, rest = morse(n), morse(n, "b", "a"), " ".join(f"w{i}" for i in range(12))
    table = spark.createDataFrame([(1, f"{one} {rest}", "x", 1, 2), (2, f"{two} {rest}", "x", 1, 2), (3, one, "x", 1, 2), (4, two, "x", 1, 2)], SCHEMA)
    assert {r.doc_id: r.n_removed for r in substring_dedup(table).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    short = spark.createDataFrame([(1, f"{one} c d e f", "x", 1, 2), (2, f"{two} c d e f", "x", 1, 2), (3, one, "x", 1, 2), (4, two, "x", 1, 2)], SCHEMA)
    assert {r.doc_id: r.component_id for r in near_dedup(short).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    bench = spark.createDataFrame([(7, f"{one} {rest}")], "item_id long, text string")
    assert {r.doc_id: r.n_matched for r in contaminated(table, bench).collect()} == {1: 13, 2: 12}


def test_word_codes_and_hashes():
    rng = random.Random(6)
    said = [rng.choice(["a", "b", "ab", "abcdefgh", "abcdefghi", "x" * 40]) for _ in range(400)]
    raw = np.frombuffer(" ".join(said).encode(), np.uint8)
    start, end, _ = words(raw, np.array([0, len(raw)]))
    for which in (1, 2):
        assert len(set(zip(word_hash(raw, start, end, which).tolist(), said, strict=True))) == len(set(said))
    code, h = word_codes(raw, start, end), word_hash(raw, start, end, 1)
    for n in (1, 2, 3, 5, 7, 13):
        runs = [tuple(said[i : i + n]) for i in range(len(said) - n + 1)]
        for got in (gram_codes(code, n).tolist(), gram_hash(h, n).tolist()):
            assert len(got) == len(runs) and len(set(zip(got, runs, strict=True))) == len(set(got)) == len(set(runs))


def test_levels_double_up_to_the_window():
    assert levels(13) == [4, 7, 13] and levels(50) == [4, 7, 13, 25, 50] and levels(3) == [3]
    assert all(b <= 2 * a for w in range(1, 60) for a, b in zip(levels(w), levels(w)[1:], strict=False))


@pytest.mark.parametrize("window", [1, 3, 5, 30])
def test_other_windows(spark, window):
    rows = corpus(4)
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute_words(rows, window)


def test_match_threshold_keeps_pairs_at_75_percent():
    """Pairs with exactly 75 % of their union in common: the share that agrees in enough coordinates."""
    rng, lost, n = np.random.default_rng(8), 0, 0
    for d in (1, 2, 3, 5, 10, 40):
        pairs = 60_000 // (8 * d)
        h = rng.integers(0, 1 << 63, (pairs, 8 * d), dtype=np.int64).view(np.uint64)  # 6 d in common, d more in either
        row = np.repeat(np.arange(pairs), 7 * d)
        a, b = (signatures(np.concatenate([h[:, : 6 * d], more], 1).reshape(-1), row, pairs) for more in (h[:, 6 * d : 7 * d], h[:, 7 * d :]))
        full = a != EMPTY
        lost += int((((a == b) & full).sum(1) < needed(np.maximum(full.sum(1), (b != EMPTY).sum(1)))).sum())
        n += pairs
    assert lost <= n / 1000


def test_a_family_costs_as_many_links_as_it_has_members(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 900)}" for _ in range(150)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w), "x", 1, 2))
    got = near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(r.n_links for r in got) <= 2 * 4 * len(rows)
