"""Vocabulary files, the object store, settlement, models and the commands."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallywood import __main__ as commands
from tallywood import loading
from tallywood.operators import categorize as C
from tallywood.operators import merge, query
from tallywood.plans import loader, schema
from tallywood.plans import vocabulary as V
from tallywood.shared import place
from tallywood.sources import store
from tallywood.streaming import queues


def test_vocabulary_files(spark, tmp_path):
    put = lambda name, data: (tmp_path / name).write_text(json.dumps(data))
    assert loader.load(str(tmp_path)).labels == V.LABELS
    put("categories.json", {"categories": {"food": {"it": "Cibo", "en": "Food"}, "fun": {"it": "Svago"}}, "rules": [{"pattern": r"\bpane\b", "category": "food"}, ["cinema", "fun"]], "assets": [], "default": "other"})
    put("mcc.json", {"mcc": {"742": "food", "5000-5500": "fun"}})
    put("banks.json", {"abi": {"3069": "One Bank"}})
    put("settings.json", {"categorization": {"model_threshold": 0.8}})
    v = loader.load(str(tmp_path))
    assert v.mcc == {"0742": "food", "5000-5500": "fun"} and v.rules[1] == ("cinema", "fun") and v.setting("categorization.model_threshold") == 0.8 and v.setting("a.b", 3) == 3
    assert [tuple(r) for r in v.bank_table(spark).collect()] == [("03069", "One Bank")]
    rows = spark.createDataFrame([("0742",), ("5001",), ("9999",), (None,)], "mcc string").select(C.mcc_category(F.col("mcc"), v.mcc).alias("c")).collect()
    assert [r.c for r in rows] == ["food", "fun", None, None]
    for bad in ({"mcc": {"12345": "food"}}, {"mcc": {"5000": "unknown"}}, {"mcc": {"5500-5000": "food"}}):
        put("mcc.json", bad)
        with pytest.raises(ValueError):
            loader.load(str(tmp_path))


def test_store(spark, tmp_path):
    at = f"file://{tmp_path}/objects"
    assert store.listing(spark, at).collect() == []
    store.put(spark, at, "a/b.csv", b"one")
    store.put(spark, at, "a/b.csv", b"two")
    store.put(spark, at, "c.pdf", b"\x00\xff")
    assert store.fetch(spark, at, "a/b.csv") == b"two" and store.fetch(spark, at, "c.pdf") == b"\x00\xff"
    with pytest.raises(KeyError):
        store.fetch(spark, at, "none")
    assert {(r.key, r.size) for r in store.listing(spark, at).collect()} == {("b.csv", 3), ("c.pdf", 2)}
    assert store.clear(spark, at) == 2 and store.listing(spark, at).count() == 0


def test_many_objects(spark, tmp_path):
    at = f"file://{tmp_path}/many objects"
    assert store.keys(spark, at).collect() == [] and [tuple(r) for r in store.fetch_all(spark.createDataFrame([("a",)], "key string"), at).collect()] == [("a", None)]
    rows = [("a b/c%20d/\u00e9+x.csv", b"one"), ("a b/n", None), ("x", b"\x00\xff"), (None, b"lost"), ("twice", b"a"), ("twice", b"b"), ("empty", b"")] + [(f"n/{i % 7}/{i}", b"%d" % i * 999) for i in range(60)]
    want = {k: c or b"" for k, c in rows if k}
    frame = spark.createDataFrame(rows, "key string, content binary").repartition(5)
    for _ in range(2):  # a second time over what is there
        assert {r.key: (r.size, r.sha256) for r in store.put_all(frame, at).collect()} == {k: (len(c), hashlib.sha256(c).hexdigest()) for k, c in want.items()}
    assert sorted(r.key for r in store.keys(spark, at).collect()) == sorted(want)
    got = store.fetch_all(spark.createDataFrame([(k,) for k in [*want, "none", None]], "key string"), at).collect()
    assert len(got) == len(want) + 2 and all((bytes(r.content) if r.content is not None else None) == want.get(r.key) for r in got)
    assert store.fetch(spark, at, "a b/c%20d/\u00e9+x.csv") == b"one" and store.clear(spark, at) == len(want)
    assert store.put_all(frame.limit(0), at).count() == 0


def test_settlement(spark, tmp_path):
    """A bad message doesn't hold up the others, is tried five times, then set aside and told."""
    batch = spark.createDataFrame([(f"m{i}", False) for i in range(9)] + [("m1", False), ("?", True)], "raw string, malformed boolean")
    done, aside, told, calls = [], [], [], []

    def handle(rows):
        got = sorted(r.raw for r in rows.collect())
        calls.append(got)
        if "m3" in got:
            raise ValueError("m3")
        done.extend(got)

    pending = None
    for n in range(queues.MAX_DELIVER):
        left = queues.settle(handle, batch if n == 0 else batch.limit(0), pending, lambda rows, why: aside.extend((r.raw, why) for r in rows.collect()), gave_up=lambda rows: told.extend(r.raw for r in rows.collect()))
        pending = spark.createDataFrame(left.collect(), left.schema)
        assert [(r.raw, r.attempts) for r in pending.collect()] == ([("m3", n + 1)] if n < queues.MAX_DELIVER - 1 else [])
    assert sorted(done) == [f"m{i}" for i in range(9) if i != 3]
    assert aside == [("?", "malformed"), ("m3", "gave up")] and told == ["m3"]
    files = spark.createDataFrame([("m3", "pending", None), ("m4", "parsed", None)], "filename string, status string, error string")
    lost = spark.createDataFrame([("m3", "x" * 900), ("m4", "x")], "filename string, why string")
    assert {(r.filename, r.status, len(r.error or "")) for r in merge.give_up(files, lost).collect()} == {("m3", "failed", 523), ("m4", "parsed", 0)}


def test_batches_replace_themselves(spark, tmp_path):
    write = queues.appended(str(tmp_path / "out"), lambda b: b)
    for _ in range(2):
        write(spark.range(3), 0)
    write(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_failure_reasons(spark):
    rows = spark.createDataFrame([("a", ["y", "x"], None), ("b", [], "Some Bank"), ("c", [], None), ("d", ["x"], "Some Bank")], "sha256 string, candidates array<string>, bank string")
    got = {r.sha256: (r.status, r.error) for r in merge.file_status(rows, spark.createDataFrame([("d",)], "sha256 string")).collect()}
    assert got["d"] == ("parsed", None) and "x and y" in got["a"][1] and "from Some Bank," in got["b"][1] and got["c"][1].startswith("Unrecognized")
    known = spark.createDataFrame([("a", "old", "first", "failed", "e")], "sha256 string, filename string, source string, status string, error string")
    new = spark.createDataFrame([("a", "new", "second", "parsed", None), ("b", "n", "s", "failed", "e2")], known.schema)
    assert {r.sha256: (r.filename, r.source, r.status) for r in merge.record_files(known, new).collect()} == {"a": ("new", "first", "parsed"), "b": ("n", "s", "failed")}


def test_models(spark):
    class Shares:
        classes_ = ("rent", "food")

        def predict_proba(self, texts):
            if texts == ["bad"]:
                raise ValueError
            return [[0.25, 0.75]]

    class Batch:
        def predict_batch(self, texts):
            return [("rent", len(t) / 10) if t else None for t in texts]

    rows = spark.createDataFrame([("one", 1), ("bad", 2), (None, 3)], "text string, predicted int")
    assert [(r.predicted, r.confidence) for r in C.with_model(rows, Shares()).collect()] == [("food", 0.75), (None, None), ("food", 0.75)]
    assert [(r.predicted, r.confidence) for r in C.with_model(rows, Batch()).collect()] == [("rent", 0.3), ("rent", 0.3), (None, None)]
    assert "groceries" in C.prompt(examples=(("x", "rent"),)) and "x = rent" in C.prompt(examples=(("x", "rent"),))


CSV = "date,type,currency,amount,fee,tax,name,description,counterparty_name,category,mcc_code,asset_class,symbol,shares,price,transaction_id\n"


def test_commands(spark, tmp_path, capsys):
    ledger, files = f"{tmp_path}/ledger", tmp_path / "files"
    files.mkdir()
    (files / "t.csv").write_text(CSV + "2025-01-02,CARD,EUR,-5.00,,,,Pizza place,,FOOD,5812,,,,,1\n2025-01-03,TRANSFER,EUR,-100.00,,,,Bonifico disposto,,X,,,,,,2\n")
    (files / "r.csv").write_text('Current accounts summaries\nPersonal Account (EUR)\nDate,Description,Category,Money in/out,Balance\n"Jan 4, 2025",Top-up by *1234,Top up,€100.00,€100.00\n')
    (files / "odd.txt").write_text("nothing known")
    assert commands.main(["load", ledger, str(files)]) == 0 and "3 new, 0 enriched" in capsys.readouterr().out
    rows = {r.description: r for r in loading.table(spark, ledger, "transactions").read().collect()}
    assert rows["Pizza place"].category == "dining" and rows["Pizza place"].category_source == "mcc" and str(rows["Pizza place"].amount) == "-5.0000"
    status = {r.filename.split("/")[-1]: r.status for r in loading.table(spark, ledger, "raw_files").read().collect()}
    assert status == {"t.csv": "parsed", "r.csv": "parsed", "odd.txt": "failed"}
    assert commands.main(["load", ledger, str(files)]) == 0 and "0 new" in capsys.readouterr().out
    assert commands.main(["load", ledger, str(files), "--force"]) == 0 and "0 new" in capsys.readouterr().out
    assert commands.main(["link-transfers", ledger]) == 0 and "1 pairs, volume 100" in capsys.readouterr().out
    assert commands.main(["export", ledger, f"{tmp_path}/out", "--lang", "it"]) == 0
    assert spark.read.csv(f"{tmp_path}/out", header=True).where("category_label = 'Ristorazione'").count() == 1


def test_scan_takes_parameters(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert query.scan(spark, "SELECT k FROM {t} WHERE n > :least", {"least": 1}, t=t).first().k == "b"
    assert place(spark, "x") != place(spark, "x") and "raw_files" not in schema.RAW_FILES
