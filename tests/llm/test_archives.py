"""Fill-in-middle, centroids and WARC against brute force, by awkward rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywood.llm import centroids, fill_in_middle as fim, warc

DOCS = "doc_id long, text string"


# ------------------------------------------------------------ fill in middle
def plain_fim(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in fim.MARKERS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    some = "ab<PSM> é߿ࠀ￿𝄞\U0010ffff\n"
    rows = [(None, None), (None, "no id"), (1, ""), (2, None), (3, "x"), (3, "x"), (4, "<P"), (5, "a<P>b"), (6, "<<S>"), (7, "<M"), (8, "𝄞" * 3000), (9, "<" * 2000 + "P>")]
    rows += [(i, "".join(rng.choice(some) for _ in range(rng.choice([1, 5, 40, 900, 5000])))) for i in range(20, 140)]
    rows += [(i, "wört " * rng.randrange(2000)) for i in range(200, 230)]
    return rows + [(500, "ä" * 70001), (500, "ä" * 70001), (501, "b" * 66000 + "<S" + ">" + "c" * 9), (None, "€" * 50000)]


@pytest.mark.parametrize("piece", [fim.PIECE, 700])
def test_fim_is_that_of_whole_texts(spark, piece):
    """With small pieces most texts are giants, whose pieces are scanned apart."""
    rows = texts()
    docs = spark.createDataFrame([(*r, "n", 7) for r in rows], DOCS + ", output string, n int").repartition(5)
    got = fim.fill_in_middle(docs, piece=piece).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[:6]) for r in got), key=order) == sorted((plain_fim(*r) for r in rows), key=order)
    assert sorted(r.again for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_of_nothing(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []


def test_automaton_composes():
    """Entry states of stretches cut anywhere, inside code points and markers, equal those of one pass."""
    auto, rng = fim.code_points(), np.random.default_rng(3)
    text = "".join(rng.choice(list("a<P>SMé€𝄞"), 4000))
    raw = np.frombuffer(text.encode(), np.uint8)
    cut = np.unique(np.append(0, rng.integers(1, len(raw), 300)))
    size = np.diff(np.append(cut, len(raw)))
    to, units, marks = fim.composed(*fim.functions(auto, raw, cut, size), np.arange(len(cut)) == 0)
    state, n, found, ends = 0, 0, 0, []
    for i, b in enumerate(raw):
        n, found, state = n + int(auto.units[state, b]), found + int(auto.marks[state, b]), int(auto.step[state, b])
        if i + 1 in set((cut + size).tolist()):
            ends.append((state, n, found))
    assert ends == list(zip(to[:, 0], units[:, 0], marks[:, 0], strict=True))
    assert (n, found) == (len(text), sum(text.count(m) for m in fim.MARKERS))


# ---------------------------------------------------------------- centroids
def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(float(x) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c[j]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, o in found if o == j) for j in range(len(c))}
    return [(i, o, d, inertia[o], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, d, o in found]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, distance int, cluster string")


def test_clusters_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 64).tolist()) for i in range(150)]
    rows += [(200 + i, [round(x * 4) / 4 for x in rng.normal(0, 0.3, 64)]) for i in range(60)]  # ties
    rows += [(300, rows[0][1]), (300, rows[0][1]), (301, rows[0][1]), (None, rows[1][1]), (None, [0.0] * 64)]  # repeated rows, no id
    rows += [(400, None), (401, []), (402, [0.1] * 63), (403, [0.1] * 65), (404, [None] + [0.0] * 63), (405, [float("nan")] * 64), (406, [float("inf")] + [0.0] * 63), (407, [30000.0] + [-1e-9] * 63)]
    got = centroids.cluster_vectors(vectors(spark, rows).repartition(5)).collect()
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(plain_clusters(rows), key=order)


def test_clusters_of_few_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [-0.5] * 64), (3, [0.5] * 64)]
    assert sorted(map(tuple, centroids.cluster_vectors(vectors(spark, rows)).collect())) == sorted(plain_clusters(rows))
    assert centroids.cluster_vectors(vectors(spark, [(1, None)])).collect() == []
    assert centroids.cluster_vectors(vectors(spark, []).where("false")).collect() == []
    with pytest.raises(Exception, match="long"):
        centroids.cluster_vectors(vectors(spark, [(1, [1e9] * 64)]))


def test_screening_leaves_ties_to_integers():
    """Vectors halfway between centroids, and larger than float32 holds, are recomputed; distinct ones are not."""
    rng = np.random.default_rng(2)
    c = rng.integers(-(1 << 26), 1 << 26, (40, 64))
    c[7] = c[3]
    x = np.vstack([c, (c[:20] + c[20:]) // 2, c[[3, 7]] + 1, rng.integers(-(1 << 26), 1 << 26, (200, 64))])
    near = centroids.Nearest(c)
    which, far = near(x)
    want = [min((sum((int(p) - int(q)) ** 2 for p, q in zip(v, u, strict=True)), j) for j, u in enumerate(c)) for v in x]
    assert list(zip(far.tolist(), which.tolist(), strict=True)) == want
    assert 0 < near.undecided < len(x) / 2


# --------------------------------------------------------------------- WARC
def test_pages_through_archives(spark):
    long = "x" * 1500
    rows = [(1, "http://a/ b", "é" * 700), (2, None, "é" * 700), (3, "", long), (4, "http://c", None), (5, "http://d", ""), (6, "http://e", "short"), (7, "http://f", "short"), (9, "u", "WARC/1.1\r\n\r\n" + long), (10, "u", "http://a 1 2 3 4\n" * 99), (11, "v", "http://a 1 2 3 4\n" * 99)]
    rows += [(20 + i, "hot", long) for i in range(40)] + [(8, "same", "é" * 700), (8, "same", "é" * 700), (None, "n", "y" * 1000), (None, "n", "y" * 1000), (12, "o", "z" * 999), (13, "o", "z" * 999)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, payload_bytes int").repartition(6)
    got = [tuple(r) for r in warc.archive_pages(pages).collect()]
    size, sha = (lambda h: len((h or "").encode())), (lambda h: hashlib.sha1((h or "").encode()).hexdigest())
    last = {}
    for i, _, h in rows:
        if size(h) >= 1000:
            last[h] = max(last.get(h, -1), -1 if i is None else i)
    want, stays = [], set()
    for i, _, h in rows:
        first = size(h) < 1000 or (-1 if i is None else i) == last[h] and h not in stays
        stays |= {h} if first and size(h) >= 1000 else set()
        want.append((i, size(h), sha(h), "response" if first else "revisit", None if first or last[h] < 0 else last[h], True))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((*r[:5], True) if r[3] == "revisit" else r for r in got), key=order) == sorted(want, key=order)
    assert warc.archive_pages(pages.limit(0)).collect() == []


def member(*lines, document=b"", tail=b"\n"):
    return gzip.compress("".join(x + "\n" for x in lines).encode() + document + tail)


def test_versions_lengths_and_damage():
    v1, v2 = (warc.FIELDS[v] for v in (1, 2))
    http = b"HTTP/1.0 200 OK\nContent-Type: a/b\n\nbody\nof it"
    block = f"1 0 x\n{v1}\n"
    one = member(f"filedesc://x.arc 0 19960923142103 text/plain {len(block)}", document=block.encode(), tail=b"\n") + member(f"http://a/with space 1.2.3.4 19961104142103 text/html {len(http)}", document=http)
    one += member(f"dns:a 1.2.3.4 19961104142103 text/dns {5}", document=b"1\n2\n3") + member("http://cut 1.2.3.4 1996 text/html 99", document=b"only this", tail=b"")
    got = list(warc.arc_documents(one))
    assert [(r["version"], r["url"], r["captured"], r["mime"], r["document"], r["problem"]) for r in got] == [
        (1, "http://a/with space", "19961104142103", "text/html", http, None), (1, "dns:a", "19961104142103", "text/dns", b"1\n2\n3", None), (1, "http://cut", "1996", "text/html", b"only this", "truncated"),
    ]
    block = f"2 0 x\n{v2}\n"
    two = f"filedesc://x.arc 0 19960923142103 text/plain 200 - - 0 x.arc {len(block)}\n{block}\nhttp://b 1.1.1.1 20010101000000 text/html 404 ck loc 17 x.arc 3\nabc\nno header at all\nrest".encode()
    got = list(warc.arc_documents(two))
    assert [(r["version"], r["url"], r["status"], r["document"], r["problem"]) for r in got] == [(2, "http://b", 404, b"abc", None), (2, None, None, b"no header at all\nrest", "header")]
    assert list(warc.arc_documents(b"")) == []


def test_converted_records(spark, tmp_path):
    """An archive of the old kind becomes records with identifiers, dates, types and digests, damaged ones too."""
    http = b"HTTP/1.0 200 OK\r\n\r\n" + b"q" * 1200
    block = f"1 0 x\n{warc.FIELDS[1]}\n"
    (tmp_path / "in").mkdir()
    whole = member(f"filedesc://x.arc 0 1996 text/plain {len(block)}", document=block.encode())
    for day in (11, 12):
        whole += member(f"http://a 9.9.9.9 199611{day} text/html {len(http)}", document=http)
    whole += member("dns:a 9.9.9.9 19961104142103 text/dns 3", document=b"1.2") + member("http://cut 1.2.3.4 bad text/html 99", document=b"only", tail=b"") + gzip.compress(b"")
    (tmp_path / "in" / "x.arc.gz").write_bytes(whole)
    (tmp_path / "in" / "y.arc").write_bytes(b"broken\nthings")
    out = warc.convert(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    got = {(r.url, r.record_type, r.date[:10], r.payload_bytes, r.intact) for r in warc.warc_records(spark, out).collect()}
    assert {(u, t, d, n) for u, t, d, n, _ in got if u.startswith(("http", "dns"))} == {("http://a", "revisit", "1996-11-11", None), ("http://a", "response", "1996-11-12", 1200), ("dns:a", "resource", "1996-11-04", 3), ("http://cut", "resource", "1970-01-01", 4)}
    assert [n for u, t, d, n, _ in got if u.startswith("urn:arc:")] == [len(b"broken\nthings")]
    assert all(i for _, t, _, _, i in got if t != "revisit")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("*.gz"))
    digest = base64.b32encode(hashlib.sha1(b"q" * 1200).digest())
    records = list(warc.warc_documents(raw))
    assert raw.count(b"sha1:" + digest) == 2 and len(records) == len(got) + sum(f["warc-type"] == "warcinfo" for f, _ in records)
    ids = [f["warc-record-id"] for f, _ in records if f["warc-type"] != "warcinfo"]
    refers = [f["warc-refers-to"] for f, _ in records if "warc-refers-to" in f]
    assert len(set(ids)) == len(ids) and set(refers) < set(ids)
