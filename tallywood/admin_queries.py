"""Registered queries of what keeps the ledger: file outcomes, upserts, labels, settlement, orderings and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import money as M
from .functions import text as X
from .operators import categorize as C
from .operators import coverage, merge, periods, query, transfers, versions, views
from .plans import vocabulary as V
from .shared import place
from .sources import store
from .streaming import queues, settlement

_FILES = "(SELECT cast(id as varchar(20)) AS sha256, filename, source, CASE id % 4 WHEN 0 THEN 'pending' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN 'old' END AS error FROM {files})"
_ERROR = "CASE id % 5 WHEN 1 THEN 'Ambiguous statement: it matches bank_a and bank_b equally well; name its source.' WHEN 2 THEN 'Unrecognized statement format.' WHEN 3 THEN 'Statement appears to be from ' || source || ', which has no adapter yet.' WHEN 4 THEN 'no movements found' END"
# Every arrival of each key, in order. Of every seventh key none is in the ledger yet; the others' first is, and a manual category there stays.
_HISTORY = """(SELECT natural_key, seq, new, description, merchant, mcc, cast(NULL as varchar(5)) AS purchase_time, category, CASE WHEN seq = 0 AND NOT new AND category = 'rent' THEN 'manual' WHEN category_source = 'manual' THEN 'rule' ELSE category_source END AS category_source,
  coalesce(category_confidence, 0.5) AS category_confidence, value_date, value_date AS booking_date, amount, account, source, native_category
  FROM (SELECT *, cast(file_id % 700 as varchar(20)) AS key, file_id % 7 = 0 AS new, row_number() OVER (PARTITION BY file_id % 700 ORDER BY natural_key, amount, description) - 1 AS seq FROM {ledger}) r) h"""
_HISTORY = _HISTORY.replace("SELECT natural_key, seq", "SELECT key AS natural_key, seq")
_KEEPS = "length(h.description) > length(f.description)"
_MOVES = f"{_KEEPS} AND f.category_source <> 'manual'"
_LEDGER_FOLD = f""", h AS (SELECT * FROM {_HISTORY.format(ledger='ledger')}), n AS (SELECT natural_key, max(seq) AS last FROM h GROUP BY 1),
f AS (SELECT natural_key, seq, description, merchant, category, category_source, category_confidence, amount, account, source, native_category, new AS fresh, false AS enriched FROM h WHERE seq = 0
  UNION ALL SELECT f.natural_key, h.seq, CASE WHEN {_KEEPS} THEN h.description ELSE f.description END, CASE WHEN {_KEEPS} THEN h.merchant ELSE f.merchant END, CASE WHEN {_MOVES} THEN h.category ELSE f.category END,
    CASE WHEN {_MOVES} THEN h.category_source ELSE f.category_source END, CASE WHEN {_MOVES} THEN h.category_confidence ELSE f.category_confidence END, f.amount, f.account, f.source, f.native_category, f.fresh, f.enriched OR {_KEEPS}
  FROM f JOIN h ON h.natural_key = f.natural_key AND h.seq = f.seq + 1)
SELECT f.natural_key, description, merchant, category, category_source, round(category_confidence, 6) AS category_confidence, amount, account, source, native_category, fresh, enriched FROM f JOIN n ON n.natural_key = f.natural_key AND n.last = f.seq"""


def register_all(register, months: str) -> None:
    """Add the queries by ``register(name, tables, sql)``; ``months`` is the SQL of spending by month and category."""
    sql = lambda frame, text, **t: frame.sparkSession.sql(f"SELECT * FROM {text}", **t)

    # ------------------------------------------------------------- files
    register("file_outcomes", "files", f"SELECT CAST(id AS VARCHAR) AS sha256, CASE WHEN id % 5 = 0 THEN 2 ELSE 0 END::BIGINT AS rows_total, CASE WHEN id % 5 = 0 THEN 'parsed' ELSE 'failed' END AS status, {_ERROR} AS error FROM files")(_outcomes)
    register("file_record", "files", f", k AS (SELECT * FROM {_FILES.format(files='files')}) SELECT sha256, filename || CASE WHEN CAST(sha256 AS BIGINT) % 2 = 0 THEN '!' ELSE '' END AS filename, source, CASE WHEN CAST(sha256 AS BIGINT) % 2 = 0 THEN 'failed' ELSE status END AS status FROM k")(
        lambda f: merge.record_files(k := sql(f, _FILES, files=f), k.where("cast(sha256 as long) % 2 = 0").withColumns({"filename": F.concat("filename", F.lit("!")), "source": F.lit("other"), "status": F.lit("failed")})).drop("error")
    )
    register("file_give_up", "files", f", k AS (SELECT * FROM {_FILES.format(files='files')}) SELECT sha256, CASE WHEN status = 'pending' AND CAST(sha256 AS BIGINT) % 8 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'pending' AND CAST(sha256 AS BIGINT) % 8 = 0 THEN 'gave up after retries: broken' ELSE error END AS error FROM k")(
        lambda f: merge.give_up(sql(f, _FILES, files=f).withColumn("filename", F.col("sha256")), f.where("id % 8 = 0 OR id % 3 = 0 AND id % 4 <> 0").select(F.col("id").cast("string").alias("filename"), F.lit("broken").alias("why"))).select("sha256", "status", "error")
    )
    register("file_register", "files", f", k AS (SELECT * FROM {_FILES.format(files='files')}) SELECT sha256, false AS forced FROM k WHERE status <> 'parsed' UNION ALL SELECT sha256, true FROM k")(
        lambda f: merge.register_files(sql(f, _FILES, files=f), k := sql(f, _FILES, files=f).select("sha256")).withColumn("forced", F.lit(False)).unionByName(merge.register_files(sql(f, _FILES, files=f), k, True).withColumn("forced", F.lit(True)))
    )
    register("object_store", "nation", "SELECT n_name || '.csv' AS key, CAST(octet_length(encode(n_name)) AS BIGINT) AS size, sha256(n_name) AS sha256 FROM nation")(_stored)

    register("object_fetch", "supplier", """WITH o AS (SELECT 'of/' || s_nationkey || '/' || s_name || '.txt' AS key, s_name, s_name || chr(10) || s_suppkey AS content FROM supplier)
      SELECT key, CAST(octet_length(encode(content)) AS BIGINT) AS size, sha256(content) AS sha256 FROM o UNION ALL SELECT 'none/' || s_name, NULL, NULL FROM o""")(_fetched)

    # ------------------------------------------------------------- upserts
    register("ledger_fold", "ledger", _LEDGER_FOLD)(_folded)
    register("trade_upsert", "trades", "SELECT natural_key, any_value(side) AS side, CAST(max(unit_price) + 1 AS DECIMAL(18,2)) AS unit_price FROM trades GROUP BY natural_key")(
        lambda t: merge.replace_upsert(k := t.groupBy("natural_key").agg(F.first("side").alias("side"), F.max("unit_price").alias("unit_price")), k.withColumns({"unit_price": (F.col("unit_price") + 1).cast("decimal(18,2)"), "seq": F.lit(1)}), ["natural_key"])
    )
    register("feedback_apply", "ledger", "SELECT natural_key, amount, CASE WHEN file_id % 3 = 0 THEN 'fees' ELSE category END AS category, CASE WHEN file_id % 3 = 0 THEN 'manual' ELSE category_source END AS category_source, CASE WHEN file_id % 3 = 0 THEN 1.0 ELSE round(category_confidence, 6) END AS category_confidence FROM ledger")(
        lambda lg: merge.apply_feedback(lg, lg.where("file_id % 3 = 0").select("natural_key", F.lit("fees").alias("category"), F.lit(1).alias("id"))).select("natural_key", "amount", "category", "category_source", F.round("category_confidence", 6).alias("category_confidence"))
    )
    register("feedback_some", "ledger", "SELECT natural_key, 'fees' AS category FROM ledger WHERE file_id % 3 = 0 AND file_id % 2 = 0 AND (category <> 'fees' OR category_source <> 'manual')")(
        lambda lg: merge.reapply_feedback(lg, lg.where("file_id % 3 = 0").select("natural_key", F.lit("fees").alias("category"), F.lit(1).alias("id")), lg.where("file_id % 2 = 0").select("natural_key").distinct())
    )
    register("label_upsert", "ledger", """, l AS (SELECT merchant AS text_norm, CASE WHEN file_id % 2 = 0 THEN 'llm' ELSE 'manual' END AS source, max(category) AS category FROM ledger WHERE file_id % 3 = 0 GROUP BY 1, 2), n AS (SELECT merchant AS text_norm, 'llm' AS source, min(category) AS category FROM ledger GROUP BY 1)
      SELECT coalesce(l.text_norm, n.text_norm) AS text_norm, coalesce(l.source, n.source) AS source, coalesce(n.category, l.category) AS category, CASE WHEN l.source IS NULL THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence FROM l FULL OUTER JOIN n ON n.text_norm = l.text_norm AND n.source = l.source""")(
        lambda lg: merge.label_upsert(lg.where("file_id % 3 = 0").groupBy(F.col("merchant").alias("text_norm"), F.when(F.col("file_id") % 2 == 0, "llm").otherwise("manual").alias("source")).agg(F.max("category").alias("category"), F.lit(0.5).alias("confidence")), lg.groupBy(F.col("merchant").alias("text_norm")).agg(F.min("category").alias("category")))
    )
    register("account_rename", "accounts", "SELECT account_id, CASE WHEN account_id = 'acct_3' THEN 'Holiday' WHEN account_id = 'acct_11' THEN NULL ELSE display_name_override END AS display_name_override FROM accounts")(
        lambda a: merge.rename_account(merge.rename_account(a, "acct_3", "Holiday"), "acct_11", None).select("account_id", "display_name_override")
    )
    register("reset_scope", "ledger accounts", "SELECT 0::BIGINT AS transactions, 0::BIGINT AS accounts, (SELECT count(*) FROM accounts) AS feedback")(
        lambda lg, a: (t := merge.reset({"transactions": lg, "accounts": a, "feedback": a}, "data", "RESET"))["transactions"].agg(F.count(F.lit(1)).alias("transactions")).crossJoin(t["accounts"].agg(F.count(F.lit(1)).alias("accounts"))).crossJoin(t["feedback"].agg(F.count(F.lit(1)).alias("feedback")))
    )
    register("unresolved_shares", "ledger", "SELECT round(avg(CASE WHEN category = 'other' THEN 1.0 ELSE 0.0 END), 9) AS before, round(avg(CASE WHEN category = 'other' AND amount < 0 THEN 1.0 ELSE 0.0 END), 9) AS after FROM ledger")(
        lambda lg: merge.unresolved_shares(lg, lg.withColumn("category", F.when(F.col("amount") > 0, "salary").otherwise(F.col("category")))).select(F.round("before", 9).alias("before"), F.round("after", 9).alias("after"))
    )

    # ------------------------------------------------------------- transfers
    register("transfer_groups", "legs", "SELECT count(*) AS legs, 0::BIGINT AS odd_groups, 0::BIGINT AS far_apart, 0.00::DECIMAL(38,2) AS net, 0::BIGINT AS left_over FROM legs")(_relinked)

    # ------------------------------------------------------------- orders and projections
    first = lambda rows, *cols: rows.limit(40).select(*cols)
    register("holdings_ordered", "trades ledger", "SELECT isin, invested FROM (SELECT isin, CAST(sum(-amount) FILTER (WHERE side = 'buy') AS DECIMAL(38,2)) AS invested FROM trades t JOIN ledger l ON t.natural_key = l.natural_key WHERE isin IS NOT NULL GROUP BY 1) ORDER BY invested DESC NULLS LAST, isin LIMIT 40")(lambda t, lg: first(query.holdings_ordered(views.holdings(t, lg)), "isin", "invested"))
    register("accounts_ordered", "accounts ledger", "SELECT account_id, transactions FROM (SELECT coalesce(account_id, account) AS account_id, coalesce(n, 0) AS transactions FROM accounts FULL OUTER JOIN (SELECT account, count(*) AS n FROM ledger GROUP BY 1) s ON account_id = account) ORDER BY transactions DESC, account_id LIMIT 40")(lambda a, lg: first(query.accounts_ordered(views.accounts_view(a, lg)), "account_id", "transactions"))
    register("balances_view", "balances ledger", "SELECT account, balance_date, balance, currency, source, basis FROM balances")(lambda b, lg: query.balances_view(b))
    register("coverage_worst", "ledger balances", """, d AS (SELECT DISTINCT source, day FROM (SELECT source, value_date AS day FROM ledger UNION ALL SELECT source, balance_date FROM balances)), g AS (SELECT *, lead(day) OVER (PARTITION BY source ORDER BY day) - day AS gap FROM d),
      w AS (SELECT g.source, max(gap) AS widest FROM g JOIN (SELECT source, CASE WHEN count(*) >= 3 THEN median(gap) END AS r FROM g GROUP BY 1) r ON r.source = g.source WHERE gap > coalesce(greatest(45.0, 1.8 * r), 45.0) GROUP BY 1)
      SELECT s.source, coalesce(widest, 0) AS widest_hole FROM (SELECT DISTINCT source FROM d) s LEFT JOIN w ON w.source = s.source ORDER BY widest_hole DESC, s.source LIMIT 1""")(lambda lg, b: coverage.worst_first(coverage.report(lg, b, "1998-01-01")).limit(1).select("source", F.col("widest_hole").cast("long").alias("widest_hole")))
    register("stacked_months", "ledger", f""", c AS (SELECT m.month, category, -total AS spent FROM {months} m JOIN (SELECT month FROM (SELECT DISTINCT month FROM {months}) ORDER BY month DESC LIMIT 6) w ON w.month = m.month WHERE total < 0), t AS (SELECT category FROM c GROUP BY 1 ORDER BY sum(spent) DESC, category LIMIT 3)
      SELECT month, CASE WHEN category IN (SELECT category FROM t) THEN category ELSE 'rest' END AS category, CAST(sum(spent) AS DECIMAL(38,2)) AS spent FROM c GROUP BY 1, 2""")(lambda lg: periods.stacked(views.category_month(lg), 6, 3))
    register("sql_scan", "ledger", "SELECT natural_key, amount FROM ledger WHERE source = 'bank_a' AND amount < -50000")(lambda lg: query.scan(lg.sparkSession, "SELECT natural_key, amount FROM {lg} WHERE source = :source AND amount < :most", {"source": "bank_a", "most": -50000}, lg=lg))
    named = " ".join(f"WHEN '{c}' THEN '{V.label(c, 'it')}'" for c in ("groceries", "dining", "transport", "bills", "investments", "crypto", "rent"))
    register("meta_vocabulary", "ledger", f"SELECT category, CASE category {named} ELSE 'Altro' END AS label, category IN ('investments', 'crypto') AS asset, count(*) AS n_movements FROM ledger GROUP BY 1")(lambda lg: query.vocabulary_in_use(lg, "it"))
    register("ledger_versions", "ledger", """, l AS (SELECT natural_key, any_value(category) AS category, sum(amount) AS amount FROM ledger GROUP BY 1), v AS (SELECT *, CAST(split_part(natural_key, '-', 2) AS INTEGER) AS n FROM l)
      SELECT 1 AS version, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM v WHERE n <= 3 UNION ALL SELECT 2, count(*), CAST(sum(CASE WHEN n = 2 THEN amount + 1 ELSE amount END) AS DECIMAL(38,2)) FROM v
      UNION ALL SELECT 3, count(*), CAST(sum(CASE WHEN n = 2 THEN amount + 1 ELSE amount END) AS DECIMAL(38,2)) FROM v WHERE n <> 1""")(_versioned)

    # ------------------------------------------------------------- functions
    register("merchant_strategies", "ledger", "SELECT natural_key, CASE file_id % 4 WHEN 0 THEN merchant WHEN 2 THEN merchant WHEN 3 THEN merchant END AS merchant, CASE WHEN file_id % 4 = 2 THEN true ELSE false END AS hint FROM ledger")(
        lambda lg: lg.select("natural_key", (s := F.when(F.col("file_id") % 4 < 2, "revolut").otherwise("trade_republic")).alias("s"), F.when(F.col("file_id") % 4 == 0, F.col("merchant")).when(F.col("file_id") % 4 == 1, F.concat(F.lit("To "), "merchant")).when(F.col("file_id") % 4 == 2, F.concat(F.lit("Sepa Direct Debit transfer to "), "merchant")).otherwise(F.concat("merchant", F.lit(" - TR Card Transaction"))).alias("d"))
        .select("natural_key", X.extract_merchant(F.col("s"), F.col("d"))["merchant"].alias("merchant"), X.has_hint(F.col("d")).alias("hint"))
    )
    register("holder_names", "files", "SELECT id, CASE WHEN holder = 'ROSSI MARIO' THEN 'Rossi Mario' ELSE holder END AS shown, split_part(holder, ' ', 1) AS given, split_part(holder, ' ', 2) AS given_last FROM files WHERE holder IS NOT NULL")(
        lambda f: f.where("holder IS NOT NULL").select("id", X.format_holder(F.col("holder")).alias("shown"), X.given_name(F.col("holder")).alias("given"), X.given_name(F.col("holder"), "family_first").alias("given_last"))
    )
    register("iban_parts", "accounts", "SELECT account_id, CASE WHEN CAST(substr(account_id, 6) AS INTEGER) % 3 < 2 THEN 'IT60X0542811101' || lpad(substr(account_id, 6), 12, '0') END AS iban, CASE WHEN CAST(substr(account_id, 6) AS INTEGER) % 3 < 2 THEN '05428' END AS abi FROM accounts")(_ibans)
    register("account_slugs", "accounts", "SELECT account_id, 'revolut_' || lower(account_id) || '_' || lower(currency) AS slug FROM (SELECT account_id, currency FROM accounts)")(
        lambda a: a.select("account_id", M.account_id(F.concat(F.replace("account_id", F.lit("_"), F.lit(" ")), F.lit(" Account (EUR)")), F.col("currency"), "revolut").alias("slug"))
    )
    register("day_first", "orders", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")(
        lambda o: o.select("o_orderkey", M.parse_day_first(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d-M-yyyy")).otherwise("31/31/2000")).alias("day"))
    )
    register("model_needed", "ledger", "SELECT count(*) AS n FROM ledger WHERE CAST(mcc AS INTEGER) > 5500 AND (file_id % 2 = 0 OR file_id % 3 <> 0)")(
        lambda lg: C.needs_model(lg.withColumns({"norm": F.when(F.col("file_id") % 3 == 0, "bonifico").otherwise("nothing"), "merchant": F.when(F.col("file_id") % 2 == 0, F.col("merchant"))}), {"5000-5500": "shopping"}).agg(F.count(F.lit(1)).alias("n"))
    )
    register("model_predictions", "ledger", "SELECT natural_key, CASE WHEN file_id % 2 = 0 THEN 'bills' END AS predicted, CASE WHEN file_id % 2 = 0 THEN 0.5 END::DOUBLE AS confidence FROM ledger")(
        lambda lg: C.with_model(lg.select("natural_key", F.when(F.col("file_id") % 2 == 0, "gas").otherwise("none").alias("text")), _Model()).select("natural_key", "predicted", "confidence")
    )
    register("machine_labels", "ledger", "SELECT DISTINCT merchant AS text_norm, 'bills' AS category FROM ledger WHERE merchant LIKE '%1'")(lambda lg: C.labelled_by(lg.select(F.col("merchant").alias("text_norm")), _answer))

    # ------------------------------------------------------------- settlement
    register("stream_settle", "events", "SELECT kind, CAST(count(DISTINCT key) AS BIGINT) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN user_id % 100 = 7 THEN 'gave up' ELSE 'handled' END AS kind FROM events UNION ALL SELECT CAST(user_id AS VARCHAR), 'malformed' FROM events WHERE user_id % 50 = 3) GROUP BY 1")(_settled)

    register("stream_settlement", "events", "SELECT CASE WHEN event_id % 50 = 3 THEN 'malformed' WHEN event_id % 3 = 0 THEN 'gave up' ELSE 'handled' END AS kind, CASE WHEN event_id % 50 = 3 THEN 0 WHEN event_id % 3 = 0 THEN 5 ELSE 1 END AS attempts, count(*) AS messages, count(DISTINCT event_id) AS events, count(DISTINCT CASE WHEN event_id % 50 <> 3 AND event_id % 3 <> 0 THEN event_type END) AS results FROM events GROUP BY 1, 2")(_by_message)

    register("stream_once", "events", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")(_once)


def _outcomes(files: DataFrame) -> DataFrame:
    names = F.when(F.col("id") % 5 == 1, F.array(F.lit("bank_b"), F.lit("bank_a"))).when(F.col("id") % 5 < 1, F.array("source")).when(F.col("id") % 5 == 4, F.array("source")).otherwise(F.array().cast("array<string>"))
    rows = files.select(F.col("id").cast("string").alias("sha256"), names.alias("candidates"), F.when(F.col("id") % 5 == 3, F.col("source")).alias("bank"))
    parsed = files.where("id % 5 = 0").select(F.col("id").cast("string").alias("sha256"), F.explode(F.array(F.lit(1), F.lit(2))).alias("row"))
    return merge.file_status(rows, parsed).withColumn("rows_total", F.col("rows_total").cast("long"))


def _stored(nation: DataFrame) -> DataFrame:
    """An object for each row, written by the tasks; the same in an extra folder, which is cleared; and what is listed then."""
    spark, at = nation.sparkSession, place(nation.sparkSession, "objects")
    objects = nation.select(F.concat("n_name", F.lit(".csv")).alias("key"), F.col("n_name").alias("content"))
    written = [store.put_all(objects, to).count() for to in (at, f"{at}-gone")]
    if store.clear(spark, f"{at}-gone") != written[1] or store.listing(spark, f"{at}-gone").count():
        raise AssertionError("clear")
    return store.listing(spark, at)


def _fetched(supplier: DataFrame) -> DataFrame:
    """Objects in folders, asked for together with keys that aren't there."""
    spark, at = supplier.sparkSession, place(supplier.sparkSession, "objects")
    key = F.concat(F.lit("of/"), "s_nationkey", F.lit("/"), "s_name", F.lit(".txt"))
    store.put_all(supplier.select(key.alias("key"), F.concat_ws("\n", "s_name", F.col("s_suppkey").cast("string")).alias("content")), at).write.format("noop").mode("overwrite").save()
    asked = supplier.select(F.explode(F.array(key, F.concat(F.lit("none/"), "s_name"))).alias("key"))
    return store.fetch_all(asked, at).select("key", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def _folded(ledger: DataFrame) -> DataFrame:
    h = ledger.sparkSession.sql(f"SELECT * FROM {_HISTORY}", ledger=ledger)
    known = (F.col("seq") == 0) & ~F.col("new")
    out = merge.ledger_upsert(h.where(known), h.where(~known))
    return out.select("natural_key", "description", "merchant", "category", "category_source", F.round("category_confidence", 6).alias("category_confidence"), "amount", "account", "source", "native_category", "fresh", "enriched")


def _relinked(legs: DataFrame) -> DataFrame:
    """What holds of any relinking: two legs to a group, opposite, near each other, and no candidate left between two legs without a group."""
    linked = transfers.relink(legs.withColumn("transfer_group", F.lit(None).cast("string")))
    groups = linked.where("transfer_group IS NOT NULL").groupBy("transfer_group").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("net"), F.datediff(F.max("value_date"), F.min("value_date")).alias("apart"), F.countDistinct("account").alias("accounts"))
    said = groups.agg(F.count_if(F.expr("n <> 2 OR accounts <> 2")).alias("odd_groups"), F.count_if(F.expr("apart > 4")).alias("far_apart"), F.sum("net").cast("decimal(38,2)").alias("net"))
    rest = transfers.candidates(linked.where("transfer_group IS NULL").drop("transfer_group")).agg(F.count(F.lit(1)).alias("left_over"))
    return linked.agg(F.count(F.lit(1)).alias("legs")).crossJoin(said).crossJoin(rest)  # one row each


def _ibans(accounts: DataFrame) -> DataFrame:
    digits = F.substring("account_id", 6, 12)
    n = digits.cast("int") % 3
    tail = F.lpad(digits, 12, "0")
    said = F.when(n == 0, F.concat(F.lit("conto it60 X054 2811 101"), F.substring(tail, 1, 4), F.lit(" "), F.substring(tail, 5, 8), F.lit(" fine"))).when(n == 1, F.concat(F.lit("IBAN: IT60X0542811101"), tail)).otherwise(F.lit("IT60X05428 too short"))
    iban = M.find_iban(said)
    return accounts.select("account_id", iban.alias("iban"), M.abi(iban).alias("abi"))


class _Model:
    """A model for the round trip: it knows one text."""

    classes_ = ("bills", "other")

    def predict_one(self, text: str):
        return ("bills", 0.5) if text == "gas" else None


def _answer(text: str) -> str:
    return '{"category": "bills"}' if text.endswith("1") else '{"category": "nonsense"}' if text.endswith("2") else "not JSON"


def _settled(events: DataFrame) -> DataFrame:
    """Jobs of which some can't be read and some always fail, settled over as many batches as the budget has tries."""
    spark, at = events.sparkSession, place(events.sparkSession, "settle")
    keys = events.select(F.col("user_id").cast("string").alias("raw")).distinct()
    bad = keys.where("cast(raw as long) % 50 = 3").select(F.concat(F.lit("?"), "raw").alias("raw"), F.lit(True).alias("malformed"))
    batch = keys.withColumn("malformed", F.lit(False)).unionByName(bad)

    def handle(rows: DataFrame) -> DataFrame:
        fails = F.expr("cast(raw as long) % 100 = 7")
        rows.where(~fails).select("raw", F.lit("handled").alias("kind")).write.mode("append").parquet(f"{at}/done")
        return rows.where(fails)

    def put_aside(rows: DataFrame, why: str) -> None:
        rows.select("raw", F.lit(why).alias("kind")).write.mode("append").parquet(f"{at}/done")

    pending = None
    for n in range(queues.MAX_DELIVER):
        left = queues.settle(handle, batch if n == 0 else batch.limit(0), pending, put_aside)
        left.write.parquet(f"{at}/pending{n}")
        pending = spark.read.schema(left.schema).parquet(f"{at}/pending{n}")
    return spark.read.parquet(f"{at}/done").groupBy("kind").agg(F.countDistinct("raw").alias("n"))


def _by_type(message: dict) -> str:
    """A handler that fails for good on every third event."""
    if int(message["key"]) % 3 == 0:
        raise ValueError(message["key"])
    return message["source"]


def _by_message(events: DataFrame) -> DataFrame:
    """Every event as a job in a queue that a stream settles; some lines are cut off and can't be read. Outcomes are counted with what they say."""
    spark, at = events.sparkSession, place(events.sparkSession, "settlement")
    jobs = queues.encode(events.select(F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("source")))
    key = F.get_json_object("value", "$.key")
    jobs.withColumn("value", F.when(key.cast("long") % 50 == 3, F.concat(F.lit('{"key": '), key)).otherwise(F.col("value"))).write.text(f"{at}/queue")
    query = settlement.settle_into(queues.messages(spark, f"{at}/queue", "ingest.jobs"), _by_type, f"{at}/out", f"{at}/state", every="1 second", delay_ms=500)
    settlement.drain(query)
    return spark.read.parquet(f"{at}/out").groupBy("kind", "attempts").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("raw").alias("events"), F.countDistinct("result").alias("results"))


def _versioned(ledger: DataFrame) -> DataFrame:
    """A ledger that is loaded, changed and cut, each in a version of its own; what each version holds at the end."""
    spark = ledger.sparkSession
    rows = ledger.groupBy("natural_key").agg(F.max("category").alias("category"), F.sum("amount").cast("decimal(28,2)").alias("amount")).withColumn("n", F.split_part("natural_key", F.lit("-"), F.lit(2)).cast("int"))
    t = versions.Table(spark, place(spark, "versioned"))
    t.create(rows.schema, ["natural_key"], 16)
    put = lambda have, batch: merge.replace_upsert(have, batch.withColumn("seq", F.lit(1)), ["natural_key"])
    t.change(rows.where("n <= 3"), put, "first")
    t.change(rows.where("n = 2 OR n > 3").withColumn("amount", F.when(F.col("n") == 2, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(28,2)")), put, "second")
    t.change(rows.where("n = 1"), lambda have, batch: have.join(batch, "natural_key", "left_anti"), "third")
    said = None
    for number in (1, 2, 3):
        one = t.read(number).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total")).select(F.lit(number).alias("version"), "n", "total")
        said = one if said is None else said.unionByName(one)
    return said


def _once(events: DataFrame) -> DataFrame:
    """Events in two runs of a stream from one checkpoint: the earlier half, then all of them. Each is delivered once; the keys that are remembered are those within the watermark."""
    spark, at = events.sparkSession, place(events.sparkSession, "once")
    rows = events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    middle = rows.agg(F.expr("percentile_approx(ts, 0.5)").alias("m")).first().m
    for name, part in (("first", rows.where(F.col("ts") <= F.lit(middle))), ("second", rows)):
        part.coalesce(1).write.parquet(f"{at}/in/{name}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        queues.deduplicated(stream, "event_id", "ts", queues.LATE).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
