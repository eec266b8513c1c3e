"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, through operators and pipeline stages."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallywood.llm.exact_dedup import exact_dedup
from tallywood.llm.html_extract import extract_text
from tallywood.llm.mixing import mix_sources
from tallywood.llm.quality import keep_good, score_documents, train
from tallywood.llm.sharding import shard_documents

LONG = " ".join(f"w{i % 7919}" for i in range(200_000))
#: Columns beyond those of documents have names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, digest string, slot int, _draw string, chunk int, bucket int, part int"
ROWS = [
    (1, LONG, "a"), (2, "tail " + LONG, None), (3, None, "b"), (4, "", None), (5, " \n\t ", "c"), (6, "one two three", "a"), (6, "one two three", "a"), (7, "One two three", "b"),
    (None, "no id here", "a"), (None, None, None), (8, "same text of two", "a"), (9, "same text of two", "b"), (9, "another text of nine", "b"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None, s, None, 1, "d", 2, "e", 3, 4, 5) for i, t, s in rows], SCHEMA)


def test_exact(spark):
    got = exact_dedup(table(spark)).collect()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    want = Counter((i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want


def test_mix(spark):
    got = mix_sources(table(spark)).collect()
    assert len(got) == len(ROWS) and Counter(map(repr, got)) == Counter(map(repr, mix_sources(table(spark).repartition(5)).collect()))
    size = {s: sum(len((t or "").split()) for _, t, x in ROWS if x == s) for s in ("a", "b", "c", None)}
    assert all(r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size for r in got)


def test_shards(spark):
    got = shard_documents(table(spark)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t, _ in ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(map(repr, got)) == Counter(map(repr, shard_documents(table(spark).repartition(7)).collect()))


def test_quality(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)], "doc_id long, quality int, toxic int")
    net = train(table(spark), labels, per_label=5)
    got = score_documents(table(spark), net).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert keep_good(table(spark), net, 0.0).count() == len(ROWS) and keep_good(table(spark), net, 1.01).count() == 0
    # Read in several parts, one text at a time, it learns as well.
    again = train(table(spark), labels, per_label=5, memory=1 << 19)
    assert all(0 <= r.score <= 1 for r in score_documents(table(spark), again).collect())


def test_pages(spark):
    long = "<html><body>" + "".join(f"<p>word {i}</p>" for i in range(60_000)) + "</body></html>"
    rows = [(1, "http://x.example/1", long, "h"), (1, "http://x.example/1", long, "h"), (None, None, "<p>a", "h"), (2, "not a url", None, "h"), (3, "", "<p>b</p>" + "<div>" * 5000, "h")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    want = "\n\n".join(f"word {i}" for i in range(60_000))
    assert Counter((r.page_id, hashlib.md5(r.text.encode()).hexdigest(), r.n_chars) for r in got) == Counter({(i, hashlib.md5(t.encode()).hexdigest(), len(t)): n for i, t, n in [(1, want, 2), (None, "a", 1), (2, "", 1), (3, "b", 1)]})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame([(i, 1 - (i == 7), 0) for i in range(1, 10)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30))), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("n", range(5))
def test_stages(spark, folder, n):
    """Each stage by itself takes the awkward table, with further columns, and an empty one."""
    import corpus_pipeline as P

    name, stage = P.STAGES[n]
    out = stage(spark, table(spark), folder)
    rows = Counter((r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) if "text" in out.columns else r.doc_id for r in out.collect())
    given = Counter((i, hashlib.md5((t or "").encode()).hexdigest()) for i, t, _ in ROWS)
    if n < 4:
        assert out.columns == P.COLUMNS
    if name == "near_duplicates":  # 2 goes with 1, 7 with 6, 9 stays with neither of its texts as 8 has one of them
        assert {i for i, _ in rows} == {1, 3, 4, 5, 6, 8, None} and sum(rows.values()) == 9
    elif name == "benchmark_free":
        assert rows == given
    elif name == "shards":
        assert rows == Counter(i for i, _, _ in ROWS)
    elif name == "mixture":
        assert {i for i, _ in rows} <= {1, 2, 6, 7, 8, 9, None}
    else:
        assert all(rows[k] <= given[k] for k in rows)
    assert stage(spark, table(spark).limit(0), folder).where(F.lit(True)).collect() == []
