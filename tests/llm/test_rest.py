"""Classifier, chat formatting, HTML extraction, mixing, decontamination, sharding and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywood.llm.chat_format import CLOSE, OPEN, preference_pairs
from tallywood.llm.decontaminate import MASKS, Benchmark, _found, contaminated, decontaminate, masks_for
from tallywood.llm.html_extract import _walk, entropy, extract_text, main_text, parse, style_tree, styles
from tallywood.llm.mixing import mix_sources, repeated
from tallywood.llm.quality import Net, crc_rest, fit, keep_good, padded, score_documents, train
from tallywood.llm.sharding import Shard, grown, shard_documents, shard_of, tree

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 8) for i, t, s in rows], DOCS)


# ------------------------------------------------------------------ quality
def test_repeated_rows_are_learned_from_once(spark):
    ids = [i for i in range(40) if crc_rest(i) != 2]
    rows = [(i, f"{'good clear prose' if i % 2 else 'buy now click'} {i}", "a") for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    once, thrice = train(docs(spark, rows), labels), train(docs(spark, rows * 3), labels)
    assert all(np.array_equal(once.p[k], thrice.p[k]) for k in once.p)


def test_gradients():
    net = Net(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [b"abc" * 300, b"", b"hello world " * 9]
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    raw, y, w = np.frombuffer(b"".join(texts), np.uint8), np.array([1, 0, 1]), np.ones(3)

    def loss():
        symbols, first = padded(raw, off)
        _, _, top, mean = net.halves(symbols, int(first[-1]))
        p = net.rest(top, mean, first)[1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net.gradients(raw, off, y, w / 3)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        down = loss()
        net.p[k][at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_classifier_learns_and_scores_whole_texts(spark):
    rng = random.Random(1)
    good = lambda n: " ".join(rng.choice(["the", "river", "stone", "walks", "under", "light"]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["BUY!!", "$$$", "NOW%%", "CLICK##"]) for _ in range(n))
    rows = [(i, good(rng.randint(5, 200)) if i % 3 else bad(rng.randint(5, 200)), "s") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _, _ in rows] + [(None, 1, 0), (999, None, 0)], "doc_id long, quality int, toxic int")
    extra = [(900, None, None), (901, "", "s"), (None, good(50), "s"), (902, good(4000) + " " + bad(400), "s"), (0, rows[0][1], "s")]
    table = docs(spark, rows + extra)
    net = train(table, labels, per_label=60)
    got = {r.doc_id: r for r in score_documents(table, net).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(got[i].held_out == (crc_rest(i) == 2) for i, _, _ in rows)
    assert got[900].score == got[901].score and not got[None].held_out
    held = [i for i, _, _ in rows if crc_rest(i) == 2]
    assert np.mean([got[i].predicted == int(i % 3 > 0) for i in held]) >= 0.9
    assert got[902].score < got[None].score  # what is bad comes after 20,000 good bytes
    kept = keep_good(table, net)
    assert kept.columns == table.columns and kept.count() == score_documents(table, net).where("predicted = 1").count()
    assert score_documents(table.limit(0), net).collect() == []
    assert len(fit([b"a"], np.array([1]), epochs=1).p) == 7
    assert 0 < score_documents(table, train(table, labels.limit(0))).first().score < 1


# ------------------------------------------------------------------ chat
def test_preference_pairs(spark):
    rows = [
        (0, 0, "system", "s"), (0, 1, "user", "hi"), (0, 2, "assistant", "good"), (1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "bad"), (1, 3, "user", "why"), (1, 4, "assistant", "so"),
        (2, 0, "user", "a"), (3, 0, "user", "b"), (4, 0, "user", None), (5, 0, "user", ""), (5, 0, "user", ""), (6, 0, None, "alone"), (None, 0, "user", "lost"), (8, 1, "user", "x"), (8, None, "user", "w"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pair_id int")
    got = {r.pair_id: r for r in preference_pairs(df).collect()}
    r = got[0]
    one = lambda role, text: f"{OPEN}{role}\n{text}{CLOSE}"
    assert (r.chosen_id, r.rejected_id, r.n_prompt_turns) == (0, 1, 2)
    assert r.prompt == one("system", "s") + one("user", "hi")
    assert r.chosen == one("assistant", "good")
    assert [r.rejected[m.start : m.stop] for m in r.rejected_mask] == ["bad", "so"]
    assert [r.chosen[m.start : m.stop] for m in r.chosen_mask] == ["good"]
    assert got[1].n_prompt_turns == 0 and got[1].prompt == "" and got[1].chosen_mask == []
    assert got[2].n_prompt_turns == 1 and got[2].chosen == got[2].rejected == ""
    assert got[3].rejected_id is None and got[3].chosen == one("", "alone") and got[3].rejected == ""
    assert got[4].chosen.index("w") < got[4].chosen.index("x")
    assert preference_pairs(df.limit(0)).collect() == []


def test_preference_pairs_match_sql(spark, tmp_path):
    """Pairs that share 0 to 7 turns, up to all, against the registered SQL; some have very long texts, nulls and repeated turns."""
    import duckdb

    from tallywood.llm import queries as Q

    rng = random.Random(7)
    say = lambda: rng.choice([None, "", "ok", "é漢🙂", "why?", "because " * rng.randint(1, 30), "long " * 40_000 if rng.random() < 0.02 else "so"])
    rows = []
    for pair in range(80):
        turns = [(rng.choice(["system", "user", "assistant", None]), say()) for _ in range(rng.randint(1, 8))]
        for side in (0, 1):
            if side and pair % 11 == 0:
                continue
            mine = turns[: rng.randint(0, len(turns))] + [(rng.choice(["user", "assistant"]), say()) for _ in range(rng.randint(0, 4))]
            rows += [(2 * pair + side, k, *t, 1) for k, t in enumerate(mine or turns)]
            rows += rows[-1:] if pair % 7 == 0 else []
    spark.createDataFrame([*rows, (None, 0, "user", "lost", 1)], "conv_id long, turn long, role string, text string, a int").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = Q.QUERIES["op2_preference_pairs"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = db.execute(Q.SQL["op2_preference_pairs"])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == want
    assert len({r[names.index("n_prompt_turns")] for r in want}) > 4


# ------------------------------------------------------------------ html
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><aside>side</aside><div id="cookie-notice">ok?</div>
<article><header><h1>Title &amp; more</h1></header><p><b>First
 line.<br><p>Second&nbsp;&eacute; <i>it</i>.</p><form>mail</form><section class="comments"><p>me too</p></section><ul><li>one<li>two</ul></article><footer>&copy; x</footer>"""


def test_main_text():
    assert main_text(parse(PAGE)) == "Title & more\n\nFirst line.\n\nSecond é it.\n\none\n\ntwo"
    assert main_text(parse("")) == "" and main_text(parse("plain < text")) == "plain < text"
    assert main_text(parse("<div>a<div>b</div>c</div>")) == "a\n\nb\n\nc"
    assert main_text(parse("<p>open <b>bold")) == "open bold"


def test_articles_are_evidence_only():
    text = "The text of the page goes on for some time. " * 4
    teasers = "<article><a href='/a'>Other post</a></article><article><p>Next one</p></article>"
    assert main_text(parse(f"<div><p>{text}</p></div>{teasers}")) == text.strip()
    assert main_text(parse(f"<div><p>{text}</p></div><aside>{teasers}</aside>")) == text.strip()
    assert main_text(parse(f"<div>by line</div><article><p>{text}</p>{teasers}</article>{teasers}")) == text.strip()
    assert main_text(parse(f"<main><h1>Title</h1><article><p>{text}</p></article><article><p>{text}</p></article></main>")) == f"Title\n\n{text.strip()}\n\n{text.strip()}"
    assert main_text(parse("<div>by line</div><article><p>Short</p></article>")) == "Short"


def test_style_tree_judges_articles(spark):
    page = lambda i: f"<html><body><article><p><b>Note</b> text {i}</p><div class='box'><p>Read our terms</p></div></article></body></html>"
    same = "<html><body><article><p>one text</p></article><div>shown</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(9)] + [(20 + i, f"http://copies.example/{i}", same) for i in range(9)] + [(40 + i, f"http://few.example/{i}", page(i)) for i in range(3)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Note text {i}" for i in range(9)} | {20 + i: "one text" for i in range(9)} | {40 + i: f"Note text {i}\n\nRead our terms" for i in range(3)}


def test_names_are_read_as_wholes():
    text = lambda part, where="": main_text(parse(f"<body>{where}<article>{part}<p>Story</p></article></body>"))
    assert text('<div class="entry-header"><h1>Title</h1></div>') == "Title\n\nStory"
    assert text('<div class="social-history"><p>How it began</p></div>') == "How it began\n\nStory"
    assert text('<div class="x" hidden>gone</div><div hidden>too</div><p title="not hidden here">Shown</p>') == "Shown\n\nStory"
    for name in ("site-header", "post-comments", "related-posts", "share-buttons", "google-ads", "cookie-notice", "main-nav"):
        assert text(f'<div class="{name}">gone</div>') == "Story", name
    assert text("", '<div class="left-sidebar">side</div><div id="page-footer">foot</div>') == "Story"


def test_deep_and_broken_pages_take_one_pass():
    deep = parse("<div>" * 3000 + "<p>deep</p>")
    paths = [node.path for node in _walk(deep)]
    assert len(set(paths)) == len(paths) and max(map(len, paths)) < 1000 and main_text(deep) == "deep"
    for page in ("<a " * 60_000, "<div>" * 20_000 + "</span>" * 60_000, "<b>" * 20_000 + "<hr>" * 60_000, "<a \"'>" * 60_001, "<!--" * 60_000, "<p><b>" * 20_000):
        began = time.time()
        main_text(parse(page))
        assert time.time() - began < 5, page[:20]
    assert main_text(parse("<p>kept</p><a href='cut")) == "kept" and main_text(parse('<p class="x>one</p><p>two</p>')) == "one\n\ntwo"
    places = styles(parse("".join(f"<div class='{' '.join('abcdefgh'[:k])}'>t{k}</div>" for k in range(1, 9))))
    assert len(places) == 8


def test_formulas_and_anchors_are_text():
    page = """<article><h2 id="newsletter-archives">Archives</h2><p id="advertising-history">How adverts began.</p>
      <p>So E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation encoding="application/x-tex">mc^2</annotation></math> holds.</p>
      <h3 id="related-links">Related</h3><p class="advertising-unit">Buy!</p><p id="ad">Buy more!</p></article>"""
    assert main_text(parse(page)) == "Archives\n\nHow adverts began.\n\nSo E = mc2 holds."


def test_gold_pages(spark):
    """Pages of a host whose template has no telling tags or names: the tree alone takes it away, and with no tree it stays."""
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(["river", "stone", "walks", "under", "light", "moon", "sand", "tree"]) for _ in range(n))
    rows, gold = [], {}
    for i in range(24):
        paragraphs = [f"{say(rng.randint(5, 40))} {i}" for _ in range(rng.randint(1, 5))]
        top = '<div class="alpha"><p>Our house style</p><ul><li>Start</li><li>People</li></ul></div>'
        body = f'<div class="beta"><h1>Head {i}</h1>{"".join(f"<p>{p}</p>" for p in paragraphs)}</div>'
        rows.append((i, f"https://{'a' if i % 2 else 'b'}.example/{i}", f'<html><body>{top}{body}<div class="gamma">Made by hand<br>in one town</div></body></html>'))
        gold[i] = "\n\n".join([f"Head {i}", *paragraphs])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(pages).collect()} == gold
    assert all(r.text == f"Our house style\n\nStart\n\nPeople\n\n{gold[r.page_id]}\n\nMade by hand in one town" for r in extract_text(pages, least_importance=0.0).collect())


def test_style_tree_importance(spark):
    body = lambda i: f"<html><body><div><p>same on all</p></div><div class='x{i % 1}'><span>text {i}</span></div></body></html>"
    rows = [(i, f"http://h.example/{i}", body(i)) for i in range(9)] + [(50, None, None), (51, "http://h.example/e", ""), (0, "http://h.example/0", body(0))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    tree = {(r.host, r.path): r for r in style_tree(df).collect()}
    assert tree["h.example", "/html/body/div/p"].content == pytest.approx(entropy([10])) == 0.1
    assert tree["h.example", "/html/body/div.x/span"].content == pytest.approx(entropy([2] + [1] * 8))
    got = {(r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()}
    assert got == {(i, f"text {i}", 6) for i in range(9)} | {(50, "", 0), (51, "", 0)}
    assert extract_text(df).count() == len(rows)
    assert extract_text(df.limit(0)).collect() == []


# ------------------------------------------------------------------ mixing
def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), ["a", "b", "c", None][min(3, rng.randint(0, 9) // 2)]) for i in range(300)]
    rows += [(1000 + i, "x " * 5, "d") for i in range(3)] + [(2000, None, "a"), (2001, "", "e"), (5, rows[5][1], rows[5][2]), (None, "u v", "a")]
    table = docs(spark, rows)
    got = mix_sources(table).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mix_sources(table.repartition(7)).collect()))
    size = lambda t: len((t or "").split())
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(x for x in total if x is not None) + [None]
    weight, cap = {s: i % 3 + 1 for i, s in enumerate(names)}, {s: 3 * total[s] for s in names}
    target, left, live = {}, float(sum(total.values())), set(names)
    while True:  # clamp whoever is over the cap and share again
        level = left / sum(weight[s] for s in live)
        over = {s for s in live if level * weight[s] > cap[s]}
        if not over:
            break
        for s in over:
            target[s] = float(cap[s])
            left -= cap[s]
        live -= over
    target |= {s: level * weight[s] for s in live}
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == total[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    mixed = repeated(mix_sources(table, columns=("text", "lang", "n_chars")), ["doc_id", "text", "lang", "source", "n_chars"])
    assert sum(size(r.text) for r in mixed.collect()) == sum(taken.values())
    assert mix_sources(table.limit(0)).collect() == []
    assert {r.target for r in mix_sources(docs(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0.0}


# ------------------------------------------------------------------ decontamination
def test_contaminated(spark):
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(4000)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = {i: say(rng.randint(14, 50)) for i in range(30)}
    items[30], items[31], items[32] = say(5), [], say(400)
    rows, expected = [], set()
    for i in range(120):
        w = say(rng.randint(0, 200))
        if i % 4 == 0 and i // 4 < 31:
            part = list(items[i // 4])
            for k in range(9, len(part), 10):
                part[k] = "other"  # one word in ten is another
            at = rng.randint(0, len(w))
            w = w[:at] + [x.upper() for x in part] + w[at:]
            expected.add((i, i // 4))
        rows.append((i, " ".join(w), "s"))
    rows += [(200, None, "s"), (201, "", "s"), (202, " ".join(say(20_000)), "s"), (None, " ".join(items[3]), "s"), (0, rows[0][1], "s")]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(77, None), (None, "a b")], "item_id long, text string")
    table = docs(spark, rows)
    got = contaminated(table, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == expected | {(None, 3)}
    assert got.where("doc_id = 0").count() == 2
    assert all(r.n_matched * 100 >= 75 * r.n_overlap for r in got.collect())
    bad = {d for d, _ in expected} | {None}
    clean = decontaminate(table, bench)
    assert clean.columns == table.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _, _ in rows if i not in bad)
    assert contaminated(table, bench.limit(0)).collect() == [] and contaminated(table.limit(0), bench).collect() == []
    assert decontaminate(table, bench.limit(0)).count() == len(rows)


# ------------------------------------------------------------------ sharding
def brute_overlaps(doc: list[str], item: list[str], least: int = 10, percent: int = 75):
    """(matched, -length, -document word, -item word) of the best of all stretches of all diagonals that counts."""
    best = None
    for shift in range(-len(item) + 1, len(doc)):
        p, q = max(shift, 0), max(-shift, 0)
        same = [a == b for a, b in zip(doc[p:], item[q:], strict=False)]
        for i in range(len(same)):
            m = 0
            for j in range(i, len(same)):
                m += same[j]
                if m >= min(least, len(item)) and 100 * m >= percent * (j - i + 1):
                    got = (m, i - j - 1, -p - i, -q - i)
                    best = max(best or got, got)
    return best


def overlaps(doc: list[str], item: list[str], least: int = 10, percent: int = 75):
    raw = " ".join(doc).encode()
    got = _found(Benchmark([(5, " ".join(item))], masks_for(least, percent)), np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), least, percent)
    return None if not got else (got[0][2], -got[0][3], -got[0][4], -got[0][5])


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    from tallywood.llm import decontaminate as D

    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    rows = [(i, f"{'word ' * (i % 7)}item{i}") for i in range(60)] + [(99, "long " * 300), (5, "word item5")]
    blocks = list(D._blocks(spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text", MASKS))
    assert sorted(i for b in blocks for i in b.ids.tolist()) == sorted(i for i, _ in rows)
    assert all(len(b.raw) <= 400 or len(b.ids) == 1 for b in blocks) and len(blocks) > 4


def test_all_of_a_diagonal_is_looked_at():
    put = lambda part, *at: [f"x{i}" if i in at else w for i, w in enumerate(part)]
    # A weak stretch first, then a strong one, on one diagonal.
    long = [f"w{i}" for i in range(92)]
    weak = put(long, 2, 5, 7, 10, *range(12, 32))
    assert overlaps(weak, long) == brute_overlaps(weak, long) == (63, -84, -8, -8)
    for gone in (8, 9):
        assert overlaps(put(long[:12], gone), long[:12]) == (11, -12, 0, 0)


def test_masks_find_every_overlap():
    """All stretches with 10 matches and 75 % have a seed. One of 26 words or more has a half that counts too."""
    for n in range(10, 26):
        for k in range(min(n // 4, n - 10) + 1):
            for gone in itertools.combinations(range(1, n - 1), k):
                # A part that counts by itself was gone through as a shorter stretch.
                if n > 13 and any(4 * sum(g < x for g in gone) <= x and x - sum(g < x for g in gone) >= 10 for x in range(10, n)):
                    continue
                s = "".join("0" if i in gone else "1" for i in range(n))
                assert any(all(c == "0" or s[i + j] == "1" for j, c in enumerate(m)) for m in MASKS for i in range(n - len(m) + 1)), s


def test_overlaps_match_brute_force():
    item = [f"w{i}" for i in range(60)]
    put = lambda part, *at: [f"x{i}" if i in at else w for i, w in enumerate(part)]
    assert overlaps(item[20:30], item) == overlaps(item[20:30], item[:40]) == (10, -10, 0, -20)
    for size, gone in ((12, 0), (12, 11), (12, 8), (12, 9), (11, 5), (11, 2)):
        assert overlaps(put(item[:size], gone), item[:size])[0] == size - 1 and overlaps(put(item[:size], gone), item[:size]) == brute_overlaps(put(item[:size], gone), item[:size])
    assert overlaps(put(item, *range(3, 60, 4)), item)[0] == 45
    assert overlaps(item[:9] + ["x"] * 4 + item[13:22], item[:22])[:2] == (18, -22)
    rng = random.Random(4)
    found = 0
    for k in range(400):
        item = [f"w{rng.randint(0, rng.choice((3, 400)))}" for _ in range(rng.randint(1, 34))]
        a = rng.randint(0, len(item) - 1)
        part = item[a : rng.randint(a + 1, len(item))] if rng.random() < 0.5 else item
        part = put(part, *rng.sample(range(len(part)), rng.randint(0, len(part) // 4)))
        doc = [f"y{rng.randint(0, 9)}" for _ in range(rng.randint(0, 9))] + part + [f"y{i}" for i in range(rng.randint(0, 9))]
        least, percent = (6, 60) if k % 3 == 2 else (10, 75)
        want = brute_overlaps(doc, item, least, percent)
        assert overlaps(doc, item, least, percent) == want
        found += want is not None
    assert found > 150


def brute_shard(name: str, shards: list[Shard]) -> int:
    u = lambda path: (int(hashlib.md5(f"{path}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    draw = lambda path, w: -math.log(u(path)) / w
    w = lambda f: sum(s.weight for s in shards if f(s))
    region = min({s.region for s in shards}, key=lambda r: (draw(f"region{r}", w(lambda s: s.region == r)), r))
    rack = min({s.rack for s in shards if s.region == region}, key=lambda a: (draw(f"rack{a}", w(lambda s: s.rack == a)), a))
    return min((s for s in shards if s.rack == rack), key=lambda s: (draw(f"shard{s.shard}", s.weight), s.shard)).shard


def test_shards(spark):
    rows = [(i, "é" * (i % 50), "s") for i in range(800)] + [(900, None, "s"), (901, "", None), (5, "again", "s"), (5, "again", "s"), (None, "n", "s")]
    got = shard_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        name = "null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == brute_shard(name, tree(16)) and r.grown_shard == brute_shard(name, grown(tree(16))) and r.grown_shard in (r.shard, 16)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    body = Counter((i, (t or "").encode()) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law) for r in got) == Counter({(i, len(b) + 1, zlib.crc32(b), "key"): n for (i, b), n in body.items()})
    assert shard_documents(docs(spark, rows).limit(0)).collect() == []


def test_weights_move_only_their_subtree(spark):
    base = [Shard(s.shard, s.region, s.rack, 1.0 + s.shard % 3) for s in tree(16)]
    more = [Shard(s.shard, s.region, s.rack, s.weight * (2 if s.shard == 5 else 1)) for s in base]
    ids = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    moved = ids.select(shard_of(F.col("k"), base).alias("a"), shard_of(F.col("k"), more).alias("b")).where("a <> b").collect()
    assert moved and all(r.b // 8 == 0 for r in moved)  # into region 0, where shard 5 is


# ------------------------------------------------------------------ pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["the", "river", "stone", "walks", "under", "light", "moon", "sand", "tree", "wind"]) for _ in range(n))
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(i, say(60) if i % 5 else " ".join(["BUY!!", "$$$"] * 40), f"s{i % 3}") for i in range(150)]
    rows[7] = (7, rows[6][1], "s0")
    rows[8] = (8, rows[8][1] + " " + item, "s0")
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in P.STAGES:
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in d.select("doc_id").collect()}
        if name != P.STAGES[-1][0]:
            assert d.columns == P.COLUMNS
    assert not any(i % 5 == 0 for i in seen["quality"]) and len(seen["quality"]) >= 110
    assert seen["quality"] - seen["near_duplicates"] == {7}
    assert seen["near_duplicates"] - seen["benchmark_free"] == {8}
    assert seen["mixture"] == seen["shards"] <= seen["benchmark_free"]
    words = lambda df: sum(len(re.findall(r"\S+", r.text)) for r in df.collect())
    assert words(spark.read.parquet(str(tmp_path / "mixture"))) == words(spark.read.parquet(str(tmp_path / "benchmark_free")))
    assert P.run(spark, str(tmp_path)).count() == d.count()
