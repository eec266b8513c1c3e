"""Functions and operators of the ledger, by cases."""

from __future__ import annotations

import itertools
import random
import statistics
import unicodedata
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywood import queries
from tallywood.functions import money as M
from tallywood.functions import text as X
from tallywood.operators import categorize as C
from tallywood.operators import coverage, detect, merge, query, recurrence, transfers, views
from tallywood.plans import adapters as A
from tallywood.plans import vocabulary as V
from tallywood.sources import broker_csv, consolidated_csv, registry
from tallywood.sources.lines import number_lines


def one(spark, column_of, *values, ddl="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], ddl).select(column_of(F.col("x"))).collect()]


def test_money(spark):
    cases = {
        "€1,281.64": "1281.64", "€-5.00": "-5", "(€1,281.64)": "-1281.64", "€(5.00)": "-5", "5.00-": "-5", "−5.00": "-5", "EUR 7": "7", "5-0": None, "N/A": None, "-": None, "—": None, "": None, None: None, "x": None, "1.2.3": None,
    }
    got = one(spark, M.parse_money, *cases)
    assert got == [None if v is None else Decimal(v) for v in cases.values()]
    assert one(spark, lambda c: M.parse_money(c, ".", ","), "1.281,64", "−5,00") == [Decimal("1281.64"), Decimal("-5")]


def test_dates(spark):
    assert one(spark, M.parse_date, "Jan 5, 2025", "2025-01-05", "05.01.2025", "tomorrow", None) == [date(2025, 1, 5)] * 3 + [None, None]


def test_normalize(spark):
    def python(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).lower()
        return " ".join("".join(c if c.isascii() and (c.isalnum()) else " " for c in s).split())

    texts = [None, "", "Caffè  è-PIÙ!", "ﬁne ½ ①", "ÀÉÎõü ßtraße ĳ K", "Ωmega 東京 x²", "".join(chr(c) for c in range(0xA0, 0x250)), " ".join(chr(c) for c in range(0x2000, 0x2200))]
    assert one(spark, X.normalize_desc, *texts) == [python(t) for t in texts]


def test_recurrence_key(spark):
    assert one(spark, X.recurrence_key, "Saldo cedolino giugno ACME S.P.A. 12", "ACME SPA maggio", "a b 1 c d", "x yz") == ["saldo cedolino acme spa", "acme spa", "abcd", "x yz"]


def test_merchants(spark):
    cases = [
        ("intesa", "Pagamento su POS EDICOLA SOLE 07/031245 Carta n.8", "EDICOLA SOLE", "12:45"), ("intesa", "OPERAZIONE PRESSO X ALLE ORE 9999", "X ALLE ORE 9999", None), ("intesa", "Bonifico PRESSO X ALLE ORE 03:14", None, "03:14"),
        ("intesa", "Addebito diretto disposto a favore di LUCE S P A MANDATO 1", "LUCE S P A", None), ("revolut", "Hotelweb", "Hotelweb", None), ("revolut", "Transfer to me", None, None), ("revolut", "Wallet Top-Up by *9876", None, None),
        ("trade_republic", "FORNO SRL - TR Card Transaction", "FORNO SRL", None), ("other", "Hotelweb", None, None), ("revolut", None, None, None), ("revolut", "WEBPAY *MUSICA 99887766001", "WEBPAY *MUSICA", None),
    ]
    df = spark.createDataFrame([(s, d) for s, d, *_ in cases], "s string, d string").select(X.extract_merchant(F.col("s"), F.col("d")).alias("m")).select("m.*")
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("EDICOLA SOLE", "12:45") and got[2:] == [(m, t) for _, _, m, t in cases[2:]]
    assert got[1][1] is None


def test_rules_and_codes(spark):
    assert one(spark, X.rule_category, "cedola btp", "cedolino", "fondo pensione", "polizza vita", "barca", "bar") == ["investments", None, "pension_fund", "insurance", None, "dining"]
    table = {"5411": "dining", "5000-5999": "groceries"}
    assert one(spark, lambda c: C.mcc_category(c, table), "5411", "5412", "9999", None, "abc") == ["dining", "groceries", None, None, None]


def test_resolver(spark):
    rows = [("5411", None, "bar", "rent", 0.99), (None, "Shop", "bar", "rent", 0.8), (None, None, "bar", "rent", 0.99), (None, None, "zzz", "rent", 0.8), (None, None, "zzz", "rent", 0.7), (None, "Shop", "bar", "rent", 0.1)]
    df = spark.createDataFrame(rows, "mcc string, merchant string, norm string, p string, c double")
    got = [tuple(r[0]) for r in df.select(C.resolve(F.col("mcc"), F.col("merchant"), F.col("norm"), F.col("p"), F.col("c"), table={"5411": "groceries"})).collect()]
    assert got == [("groceries", 1.0, "mcc"), ("rent", 0.8, "model"), ("dining", 0.9, "rule"), ("rent", 0.8, "model"), ("other", 0.0, "default"), ("dining", 0.9, "rule")]


def test_detection(spark):
    heads = ["REVOLUT", "money in/out and balance, intesa sanpaolo", "trade republic intesa sanpaolo", "nothing", None]
    assert one(spark, detect.detect_source, *heads) == ["revolut", "revolut", None, None, None]
    assert registry.markers() == V.MARKERS


def test_detection_reads_the_whole_head(spark, tmp_path):
    pages = [(4, "x" * 300 + " Revolut"), (9, "x" * 4089 + "revolut"), (14, "x" * 4090 + "revolut"), (19, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.source for r in queries.QUERIES["detect_source"](spark, str(tmp_path)).collect()}
    assert got == {4: "revolut", 9: "revolut", 14: None, 19: None}


def legs(spark, rows):
    return spark.createDataFrame([(k, a, date(2025, 1, d), Decimal(x), t) for k, a, d, x, t in rows], "natural_key string, account string, value_date date, amount decimal(18,2), description string")


def test_transfers_in_any_order(spark):
    rows = [("a", "x", 1, "-10", "Bonifico"), ("b", "y", 1, "10", "in"), ("c", "z", 2, "10", "in"), ("d", "x", 3, "-10", "giroconto")]
    seen = {tuple(sorted((r.out_key, r.in_key) for r in transfers.find_pairs(legs(spark, p)).collect())) for p in list(itertools.permutations(rows))[::6]}
    assert seen == {(("a", "b"), ("d", "c"))}
    assert transfers.find_pairs(legs(spark, [("a", "x", 1, "-10", "card"), ("b", "y", 3, "10", "card")])).count() == 0
    assert transfers.find_pairs(legs(spark, [("a", "x", 1, "-10", "card"), ("b", "y", 3, "10", "sepa")])).count() == 1


def plain_pairs(rows, window=4, require_hint=True):
    """The pairing by the whole list of candidates, in order."""
    hinted = lambda t: any(w in t.lower() for w in ("bonific", "giroconto", "sepa"))
    ins = {}
    for k, a, d, x, t in rows:
        if x > 0:
            ins.setdefault(x, []).append((k, a, d, t))
    found = []
    for k, a, d, x, t in rows:
        for k2, a2, d2, t2 in ins.get(-x, []) if x < 0 else []:
            gap = abs((d2 - d).days)
            if a != a2 and gap <= window and (gap == 0 or not require_hint or hinted(t) or hinted(t2)):
                found.append((gap, x, k, k2))
    used, pairs = set(), []
    for gap, _, o, i in sorted(found):
        if o not in used and i not in used:
            used |= {o, i}
            pairs.append((o, i, gap))
    return pairs


def test_pairs_are_those_of_a_plain_loop(spark):
    """5,000 legs, 1,000 of them of one amount and day on two accounts, and long runs of days."""
    rng = random.Random(4)
    start = date(2025, 1, 1)
    text = lambda: rng.choice(["Bonifico", "card", "card", "shop", "SEPA x"])
    rows = [(f"h{rng.randrange(10**9):09d}-{i}", f"a{rng.randrange(2)}", start, Decimal(rng.choice([-10, 10])), text()) for i in range(1000)]
    rows += [(f"d{rng.randrange(10**9):09d}-{i}", f"a{rng.randrange(6)}", start + timedelta(days=rng.randrange(400)), Decimal(rng.choice([-10, 10])), text()) for i in range(1500)]
    rows += [(f"r{rng.randrange(10**9):09d}-{i}", f"a{rng.randrange(6)}", start + timedelta(days=rng.randrange(3000)), Decimal(rng.choice([-1, 1]) * rng.randrange(0, 12)), text()) for i in range(2500)]
    frame = spark.createDataFrame(rows, "natural_key string, account string, value_date date, amount decimal(18,2), description string").repartition(5)
    for window, hint in ((4, True), (2, False)):
        got = transfers.find_pairs(frame, window, hint).collect()
        assert sorted((r.out_key, r.in_key, r.gap) for r in got) == sorted(plain_pairs(rows, window, hint))
    assert transfers.sides(frame, 4).count() <= len(rows)
    # Owners keep to themselves.
    two = frame.withColumn("who", F.when(F.crc32("natural_key") % 2 == 0, "x").otherwise("y"))
    got = {(r.out_key, r.in_key, r.gap) for r in transfers.find_pairs(two, owner=("who",)).collect()}
    whose = {r.natural_key: r.who for r in two.collect()}
    assert got == {p for who in "xy" for p in plain_pairs([r for r in rows if whose[r[0]] == who])}


def test_no_legs(spark):
    assert transfers.find_pairs(legs(spark, [])).collect() == []
    assert transfers.find_pairs(legs(spark, [("a", "x", 1, "0", "sepa"), ("b", "y", 1, "0", "sepa"), ("c", "y", 1, "5", None)])).collect() == []


def series(spark, rows):
    return spark.createDataFrame([(f"k{i}", d, Decimal(a), t, "acc", c, None) for i, (d, a, t, c) in enumerate(rows)], "natural_key string, value_date date, amount decimal(18,2), description string, account string, category string, transfer_group string")


def test_recurring(spark):
    start = date(2024, 1, 5)
    month = [start + timedelta(days=30 * i) for i in range(12)]
    rows = [(d, "-9.99", "NETFLIX 123", "subscriptions") for d in month] + [(d, str(1400 + (i % 2) * 50), "Stipendio gennaio", "salary") for i, d in enumerate(month)]
    rows += [(d, "-50", "Alpha SPA" if i < 6 else "Beta gym", "leisure") for i, d in enumerate(month)] + [(start, "-1", "once", None), (start + timedelta(days=3), "-900", "once", None), (start + timedelta(days=200), "-3", "once", None)]
    got = {r.key: r for r in recurrence.detect(series(spark, rows)).collect()}
    assert set(got) == {"netflix", "stipendio", "alpha spa"}
    assert got["netflix"].cadence == "monthly" and got["netflix"].monthly_equivalent == Decimal("-10.14") and got["netflix"].active
    assert got["alpha spa"].n_occurrences == 12 and got["stipendio"].amount == Decimal("1425.00")
    assert recurrence.summary(recurrence.groups(series(spark, rows))).first().n_active == 3
    late = {r.key: r for r in recurrence.groups(series(spark, rows), "2026-01-01").collect()}
    assert not late["netflix"].active and late["netflix"].next_expected is None


def plain_qualify(rows, horizon):
    """One group of (day, amount, category, natural_key, account) as (cadence, amount, monthly, active, category, first, last), or nothing."""
    days = {}
    for r in rows:
        days[r.value_date] = days.get(r.value_date, Decimal(0)) + r.amount
    order = sorted(days)
    if len(order) < 3:
        return None
    gaps = [(b - a).days for a, b in itertools.pairwise(order)]
    mid = statistics.median(gaps)
    hit = next((c for c in V.CADENCES if c[1] <= mid <= c[2]), None)
    regular = hit and sum(hit[1] <= g <= hit[2] for g in gaps) / len(gaps)
    amount = statistics.median([days[d] for d in order]).quantize(Decimal("0.01"))
    if hit is None or regular < 0.7 or amount == 0:
        return None
    sizes = [(min(abs(days[a]), abs(days[b])), max(abs(days[a]), abs(days[b]))) for a, b in itertools.pairwise(order)]
    if sum(lo > 0 and hi / lo <= Decimal("1.5") for lo, hi in sizes) / len(sizes) < 0.7 and regular < 0.9:
        return None
    active = (horizon - order[-1] - timedelta(days=round(mid))).days <= max(21, 0.35 * mid)
    latest = max(rows, key=lambda r: (r.value_date, r.natural_key))
    return hit[0], amount, (amount * Decimal("30.44") / Decimal(str(mid))).quantize(Decimal("0.01")), active, latest.category, order[0], order[-1]


def plain_detect(rows, horizon, merge=True):
    """The law of the merge by a plain search: series in order of first day and key, anew after each merge. [key, qualities, rows] of what is left."""
    groups = {}
    for r in rows:
        groups.setdefault((r.key, r.amount < 0), []).append(r)
    live = [[k, q, m] for k, m in groups.items() if (q := plain_qualify(m, horizon))]
    live.sort(key=lambda s: (s[1][5], s[0]))
    again = merge
    while again:
        again = False
        for a, b in itertools.combinations(live, 2):
            x, y = a[1], b[1]
            hi, lo = max(abs(x[1]), abs(y[1])), min(abs(x[1]), abs(y[1]))
            if (x[1] < 0) != (y[1] < 0) or x[0] != y[0] or not (x[6] < y[5] or y[6] < x[5]) or hi / lo > Decimal("1.25"):
                continue
            both = plain_qualify(a[2] + b[2], horizon)
            if both and both[0] == x[0]:
                a[1], a[2], again = both, a[2] + b[2], True
                live.remove(b)
                break
    return live


def plain_summary(found):
    own = [q for q in found if q[3] and q[4] not in V.ASSETS]
    return sum(q[3] for q in found), sum((q[2] for q in own if q[1] > 0), Decimal(0)), sum((q[2] for q in own if q[1] < 0), Decimal(0))


def test_recurring_summary_is_of_merged_series(spark, tmp_path):
    """The registered query, over the renamed series of its adapter."""
    spark.range(1, 61).selectExpr("id AS c_custkey", "concat('Customer#', lpad(id, 9, '0')) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(25).selectExpr("id AS n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    rows = A.frame(spark, str(tmp_path), "series").withColumn("key", X.recurrence_key(F.col("description"))).collect()
    got = queries.QUERIES["recurring_summary"](spark, str(tmp_path)).first()
    want = plain_summary([q for _, q, _ in plain_detect(rows, date(2026, 1, 1))])
    assert tuple(got) == want != plain_summary([q for _, q, _ in plain_detect(rows, date(2026, 1, 1), merge=False)])


def test_merge_is_that_of_a_plain_search(spark):
    """Chains of three and more, crossing pairs, renamed back, amounts that drift past the ratio, rows in any order."""
    rng = random.Random(11)
    rows, n = [], 0
    for cluster in range(40):
        step, base, start = rng.choice([7, 30, 61]), rng.choice([5, 9, 14, 40, 41]) * (1 + cluster % 4), date(2020, 1, 1) + timedelta(days=rng.randrange(40))
        sign = -1 if cluster % 3 else 1
        for part in range(rng.randrange(1, 6)):
            long = rng.randrange(3, 8)
            name = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 12)))
            amount = Decimal(sign) * (Decimal(base) * Decimal(rng.choice(["1", "1.1", "1.24", "0.9"]))).quantize(Decimal("0.01"))
            for i in range(long):
                off = rng.choice([0, 0, 0, 1, 2]) + (rng.choice([0, 0, 0, 40]) if step == 30 else 0)
                for _ in range(rng.choice([1, 1, 1, 2])):
                    rows.append((f"n{n:05d}", start + timedelta(days=step * i + off), amount + Decimal(rng.choice(["0", "0.5", "-0.25"])), f"{name} {rng.randrange(99)}{'!' * rng.randrange(3)}", f"acct{rng.randrange(3)}", rng.choice(["rent", "bills", None]), None))
                    n += 1
            # The next part begins after the end of this one, or crosses it.
            start += timedelta(days=step * rng.choice([long, long, long, long + 1, long // 2, 2 * long]))
    rng.shuffle(rows)
    ledger = spark.createDataFrame(rows, "natural_key string, value_date date, amount decimal(18,2), description string, account string, category string, transfer_group string").repartition(7)
    known = recurrence.keyed(ledger).collect()
    horizon = date(2023, 1, 1)
    plain = plain_detect(known, horizon)
    assert len(plain_detect(known, horizon, merge=False)) > len(plain) + 10
    got = recurrence.detect(ledger, str(horizon)).collect()

    def richest(members):  # of the parts in their order, the first with the longest text; within a part the largest key among equals
        best = None
        for _, part in itertools.groupby(members, key=lambda r: r.key):
            mine = max(part, key=lambda r: (len(r.description), r.natural_key))
            best = mine if best is None or len(mine.description) > len(best.description) else best
        return best

    want = [(richest(m).key, q[0], q[1], q[2], q[3], q[4], q[5], q[6], richest(m).description, sorted({r.account for r in m})) for _, q, m in plain]
    have = [(r.key, r.cadence, r.amount, r.monthly_equivalent, r.active, r.category, r.first_date, r.last_date, r.description, r.accounts) for r in got]
    key = lambda r: (r[0], r[2], r[6])
    assert sorted(have, key=key) == sorted(want, key=key)
    # Two owners of the same movements have each the same series.
    twice = ledger.withColumn("who", F.lit("a")).unionByName(ledger.withColumn("who", F.lit("b")))
    by_owner = recurrence.detect(twice, str(horizon), ("who",)).groupBy("who").count().collect()
    assert {r.who: r["count"] for r in by_owner} == {"a": len(got), "b": len(got)}


def test_merge_of_no_series(spark):
    assert recurrence.detect(series(spark, []), "2024-01-01").collect() == []


def test_coverage(spark):
    day = lambda n: date(2026, 1, 1) + timedelta(days=n)
    mov = spark.createDataFrame([("a", day(i)) for i in range(0, 30, 3)] + [("a", day(120)), ("b", day(0))], "source string, value_date date")
    anc = spark.createDataFrame([("a", day(200))], "source string, balance_date date")
    got = {r.source: r for r in coverage.report(mov, anc, str(day(210))).collect()}
    assert (got["a"].stale, got["a"].n_holes, got["a"].widest_hole, got["a"].n_anchors) == (False, 2, 93, 1)
    assert got["b"].stale and got["b"].n_holes == 0


def test_upsert_converges(spark):
    ddl = "natural_key string, seq long, description string, merchant string, mcc string, purchase_time string, category string, category_source string, value_date date, booking_date date"
    d0, d1 = date(2025, 1, 1), date(2025, 1, 3)
    old = spark.createDataFrame([("a", 0, "abc", "m0", "1", None, "rent", "rule", d0, d0), ("m", 0, "x", "m0", None, None, "fees", "manual", d0, d0)], ddl).drop("seq")
    new = spark.createDataFrame([("a", 1, "xyz", "m1", "2", "10:00", "bills", "rule", d0, d1), ("a", 2, "longer", "m2", None, "11:00", "cash", "mcc", d0, d0), ("m", 1, "longer", "m9", None, None, "cash", "rule", d0, d0), ("n", 1, "new", None, None, None, "other", "default", d0, d0)], ddl)
    got = {r.natural_key: r for r in merge.ledger_upsert(old, new).collect()}
    assert (got["a"].description, got["a"].merchant, got["a"].mcc, got["a"].purchase_time, got["a"].category, got["a"].booking_date) == ("longer", "m2", "1", "11:00", "cash", d1)
    assert (got["m"].description, got["m"].category, got["m"].category_source) == ("longer", "fees", "manual")
    assert got["n"].fresh and not got["a"].fresh and got["a"].enriched and not got["n"].enriched
    again = merge.ledger_upsert(old, new.unionByName(new.withColumn("seq", F.col("seq") + 10)))
    assert {r.natural_key: r.description for r in again.collect()} == {k: r.description for k, r in got.items()}


CSV = """Current accounts summaries
Joint Account (EUR)
Account holding modality,Joint
Institution,"Bank, Inc"
IBAN,IT60 X054 2811 1010 0000 0123 456

Date,Description,Category,Money in/out,Balance,Tax,Other,Fees
"Jan 5, 2025",Shop,General,€-5.00,"€1,095.00",,,€0.50
"Jan 5, 2025",Bad,General,N/A,,,,
"Jan 6, 2025",Pay,Top up,"€1,000.00","€2,095.00",,,
---------
Personal Account (USD)
Date,Description,Category,Money in/out,Balance
"Jan 7, 2025",Dollar,General,$1.00,$1.00

Savings (EUR) only interest receipt
Date,Description,Gross rate,a,b,c,d,Net
"Jan 8, 2025",Interest,1%,,,,,€0.12

Statements only sales
"Date (of Sale, of Purchase)",Symbol,Quantity,Price,Fees,Value
"08/01/2025, 01/01/2024",BTC,1,,,"+ €1,150.00, - €1,000.00"
"""


def test_consolidated_csv(spark):
    lines = number_lines(spark.createDataFrame([("f.csv", CSV)], "file string, body string"))
    got = {(r.account, str(r.value_date), r.description, r.amount) for r in consolidated_csv.parse(lines).collect()}
    assert got == {
        ("revolut_joint_eur", "2025-01-05", "Shop", Decimal("-5.0000")), ("revolut_joint_eur", "2025-01-06", "Pay", Decimal("1000.0000")),
        ("revolut_savings_eur", "2025-01-08", "Interest", Decimal("0.1200")), ("revolut_crypto", "2025-01-08", "Crypto sale BTC", Decimal("1150.0000")),
    }
    acc = {r.account_id: r for r in consolidated_csv.accounts(lines).collect()}
    assert (acc["revolut_joint_eur"].holding_modality, acc["revolut_joint_eur"].bank_name, acc["revolut_joint_eur"].iban) == ("joint", "Bank, Inc", "IT60X0542811101000000123456")
    assert {(str(r.balance_date), r.balance) for r in consolidated_csv.balances(lines).collect()} == {("2025-01-05", Decimal("1095.00")), ("2025-01-06", Decimal("2095.00"))}


def test_broker_csv(spark):
    body = "date,type,currency,amount,fee,tax,name,description,counterparty_name,category,mcc_code,asset_class,symbol,shares,price\n2025-01-02,BUY,EUR,-100.00,-1.00,,ETF,Savings plan,,TRADING,,FUND,IE1,2.5,40\n2025-01-03,SELL,EUR,50,,-1,ETF,ETF,,TRADING,,FUND,IE1,1,\n2025-01-04,CARD,EUR,-3,,,,,Bar,CASH,5812,,,,\n2025-01-05,X,USD,1,,,,,,,,,,,\n"
    lines = number_lines(spark.createDataFrame([("t.csv", body)], "file string, body string"))
    got = [(str(r.value_date), r.description, r.amount, r.mcc) for r in broker_csv.parse(lines).orderBy("line_no").collect()]
    assert got == [("2025-01-02", "ETF - Savings plan", Decimal("-101.0000"), None), ("2025-01-03", "ETF", Decimal("49.0000"), None), ("2025-01-04", "Bar", Decimal("-3.0000"), "5812")]
    assert [(r.side, r.quantity, r.isin) for r in broker_csv.trades(lines).orderBy("line_no").collect()] == [("buy", Decimal("2.5"), "IE1"), ("sell", Decimal("-1"), "IE1")]


def test_page_guards(spark):
    with pytest.raises(ValueError):
        query.transactions(spark.range(1), sort="id; drop")
    with pytest.raises(ValueError):
        query.transactions(spark.range(1), limit=501)
    with pytest.raises(ValueError):
        query.Filters(sign="both").column()
    with pytest.raises(ValueError):
        query.totals(spark.range(1), nope=1)


def test_reconciliation(spark):
    d = lambda n: date(2025, 1, n)
    bal = spark.createDataFrame([("a", d(1), Decimal(10), "EUR", "s", "value"), ("a", d(5), Decimal(13), "EUR", "s", "value"), ("a", d(9), Decimal(13), "EUR", "s", "value")], "account string, balance_date date, balance decimal(14,2), currency string, source string, basis string")
    led = spark.createDataFrame([("k1", "a", d(1), d(1), Decimal(99)), ("k2", "a", d(2), d(2), Decimal(1)), ("k3", "a", d(5), d(6), Decimal(2)), ("k4", "a", d(10), d(10), Decimal(7))], "natural_key string, account string, value_date date, booking_date date, amount decimal(18,2)")
    got = [(r.actual_delta, r.discrepancy, r.n_movements) for r in views.reconciliation(bal, led).orderBy("from_date").collect()]
    assert got == [(Decimal(3), Decimal(0), 2), (Decimal(0), Decimal(0), 0)]
