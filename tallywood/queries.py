"""The registered queries of the ledger operators, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import admin_queries, statement_queries
from .functions import money as M
from .functions import text as X
from .operators import categorize as C
from .operators import text_model as T
from .operators import coverage, detect, merge, pages, periods, query, recurrence, search, transfers, views
from .plans import adapters as A
from .shared import place, saved
from .sources.lines import HEAD
from .streaming import queues

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _with(names: str, body: str) -> str:
    """A DuckDB statement over adapter texts."""
    parts = [f"{n} AS ({A.text(n)})" for n in names.split()]
    return f"WITH {', '.join(parts)} {body}" if parts else body.removeprefix(", ")


def register(name: str, tables: str, sql: str | None = None):
    """Register a function of DataFrames, one for each table named; adapters and plain tables alike."""

    def add(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[A.frame(spark, sf_dir, t) if t in A.TEXTS else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()])

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = _with(" ".join(t for t in tables.split() if t in A.TEXTS), sql)
        return f

    return add


_SPEND = "transfer_group IS NULL AND category NOT IN ('investments','crypto','pension_fund','deposits','insurance_savings')"
_ASSET = "transfer_group IS NULL AND category IN ('investments','crypto','pension_fund','deposits','insurance_savings')"
_MONTH = "CAST(date_trunc('month', value_date) AS DATE)"


def _d(x: str, when: str = "") -> str:
    return f"CAST(sum({x}){f' FILTER (WHERE {when})' if when else ''} AS DECIMAL(38,2))"


_SIDES = f"{_d('amount', 'amount > 0')} AS income, {_d('amount', 'amount < 0')} AS expense, {_d('amount')} AS net"
_INCOME = f"(SELECT {_MONTH} AS month, {_SIDES} FROM ledger WHERE {_SPEND} GROUP BY 1)"
_CATMONTH = f"(SELECT {_MONTH} AS month, category, count(*) AS n_movements, {_d('amount')} AS total FROM ledger WHERE {_SPEND} GROUP BY 1, 2)"

# ---------------------------------------------------------------- aggregates
register("category_month", "ledger", f"SELECT * FROM {_CATMONTH}")(views.category_month)
register("income_expense_month", "ledger", f"SELECT * FROM {_INCOME}")(views.income_expense_month)
register("category_totals", "ledger", f"SELECT category, count(*) AS n_movements, {_SIDES} FROM ledger WHERE {_SPEND} GROUP BY 1")(views.category_totals)

_BY = {"sign": "expense", "date_from": "1995-01-01", "date_to": "1996-12-31", "source": "bank_b", "min_amount": "-40000", "max_amount": "-100.5", "include_transfers": False}
_BY_SQL = "amount < 0 AND value_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND source = 'bank_b' AND amount >= -40000 AND amount <= -100.5 AND transfer_group IS NULL"
register("filtered_totals", "ledger", f"SELECT count(*) AS n, {_d('amount', 'amount > 0')} AS sum_income, {_d('amount', 'amount < 0')} AS sum_expense, {_d('amount')} AS sum_net FROM ledger WHERE {_BY_SQL}")(
    lambda ledger: query.totals(ledger, **_BY)
)
_MERCHANTS = f"""SELECT lower(merchant) AS k, mode() WITHIN GROUP (ORDER BY merchant) AS merchant, count(*) AS n_movements, CAST(-sum(amount) AS DECIMAL(38,2)) AS total_spent,
  CAST(round(CAST(-sum(amount) AS DECIMAL(28,8)) / count(*), 2) AS DECIMAL(38,2)) AS avg_spent, max(value_date) AS last_date, mode() WITHIN GROUP (ORDER BY category) AS category
  FROM ledger WHERE merchant IS NOT NULL AND transfer_group IS NULL GROUP BY 1 HAVING sum(amount) < 0"""
register("merchants_top", "ledger", f"SELECT * FROM ({_MERCHANTS}) ORDER BY total_spent DESC, merchant LIMIT 20")(query.merchants)
register("merchants_count", "ledger", f"SELECT count(*) AS n FROM ({_MERCHANTS})")(lambda ledger: query.merchants(ledger, limit=None).agg(F.count(F.lit(1)).alias("n")))

_PAGE = ["natural_key", "value_date", "amount", "category_confidence"]
register("transactions_page", "ledger", f"SELECT {', '.join(_PAGE)} FROM ledger ORDER BY value_date DESC, natural_key DESC LIMIT 100 OFFSET 50")(lambda ledger: query.transactions(ledger, offset=50).select(_PAGE))


@register("page_deep", "ledger", f"SELECT {', '.join(_PAGE)} FROM (SELECT *, row_number() OVER (ORDER BY value_date DESC, natural_key DESC) AS r, count(*) OVER () AS n FROM ledger) WHERE r > n // 2 AND r <= n // 2 + 100")
def _deep(ledger: DataFrame) -> DataFrame:
    """The hundred movements in the middle of the list, by their place in a table that is written in order."""
    t = pages.SortedPages(ledger.sparkSession, place(ledger.sparkSession, "pages"), [("value_date", True, False), ("natural_key", True, False)]).write(ledger.select(_PAGE), 32)
    return t.page(ledger.count() // 2, 100)


register("page_by_abs_amount", "ledger", f"SELECT {', '.join(_PAGE)} FROM ledger WHERE amount > 0 ORDER BY abs(amount), natural_key DESC LIMIT 100")(lambda ledger: query.transactions(ledger, "abs_amount", "asc", sign="income").select(_PAGE))
register("page_confidence_nulls", "ledger", f"SELECT {', '.join(_PAGE)} FROM ledger ORDER BY category_confidence DESC NULLS FIRST, natural_key DESC LIMIT 200")(lambda ledger: query.transactions(ledger, "confidence", limit=200).select(_PAGE))
register("text_search_ilike", "ledger", "SELECT natural_key, description FROM ledger WHERE description ILIKE '%SMALL%SUPPLIER%1_%'")(lambda ledger: ledger.where(query.Filters(q="SMALL%SUPPLIER%1_").column()).select("natural_key", "description"))


@register("text_search_index", "ledger", "SELECT 'rod' AS q, natural_key, description FROM ledger WHERE description ILIKE '%OLD rod%00_1%' UNION ALL SELECT '77', natural_key, description FROM ledger WHERE description ILIKE '%#%77%'")
def _searched(ledger: DataFrame) -> DataFrame:
    """Two searches in an index of the whole ledger: one with trigrams, one whose pattern has none."""
    t = search.TextIndex(ledger.sparkSession, place(ledger.sparkSession, "search")).add(ledger.select("natural_key", "description"), 32)
    one, two = (t.search(q).select(F.lit(name).alias("q"), "natural_key", "description") for name, q in (("rod", "OLD rod%00_1"), ("77", "#%77")))
    return one.unionByName(two)


register("merchant_filter", "ledger", "SELECT natural_key, merchant FROM ledger WHERE lower(merchant) = 'supplier#000000001' AND category_confidence >= 0.2 AND category_source = 'model'")(
    lambda ledger: ledger.where(query.Filters(merchant="SUPPLIER#000000001", min_confidence=0.2, category_source="model").column()).select("natural_key", "merchant")
)
register("category_summary", "ledger", f"SELECT category, count(*) AS n, {_d('amount')} AS net FROM ledger GROUP BY 1")(query.summary)
register("review_queue", "ledger", "SELECT natural_key, amount FROM ledger WHERE category_source = 'default' OR (category_source = 'model' AND category_confidence <= 0.85) ORDER BY abs(amount) DESC, natural_key DESC LIMIT 100")(
    lambda ledger: query.review_queue(ledger).select("natural_key", "amount")
)
_SRC = ["account_id", "source", "is_joint", "display_name", "transactions", "first_movement", "last_movement"]
register("accounts_view", "accounts ledger", """, seen AS (SELECT account, min(source) AS source, count(*) AS n, min(value_date) AS a, max(value_date) AS b FROM ledger GROUP BY 1)
  SELECT coalesce(account_id, account) AS account_id, coalesce(x.source, s.source) AS source, CASE holding_modality WHEN 'joint' THEN true WHEN 'individual' THEN false END AS is_joint,
    coalesce(display_name_override, coalesce(bank_name, upper(left(replace(coalesce(account_id, account), '_', ' '), 1)) || substr(replace(coalesce(account_id, account), '_', ' '), 2)) || coalesce(' · ' || product, '') || CASE WHEN holding_modality = 'joint' THEN ' (Joint)' ELSE '' END) AS display_name,
    coalesce(n, 0) AS transactions, a AS first_movement, b AS last_movement FROM accounts x FULL OUTER JOIN seen s ON account_id = account""")(lambda accounts, ledger: views.accounts_view(accounts, ledger).select(_SRC))
register("source_single_bank", "accounts", "SELECT source, min(bank_name) AS bank_name FROM accounts GROUP BY 1 HAVING count(DISTINCT bank_name) = 1")(views.single_bank)
register("source_labels", "ledger accounts", "SELECT DISTINCT source, 'B' || substr(replace(source, '_', ' '), 2, 4) || upper(right(source, 1)) AS label FROM ledger")(query.source_labels)
_DETAIL = ["natural_key", "amount", "filename", "side", "isin", "quantity", "other_key", "other_account"]
register("transaction_detail", "ledger trades files", """, o AS (SELECT natural_key, transfer_group, account FROM ledger WHERE transfer_group IS NOT NULL),
  c AS (SELECT a.natural_key, min(b.natural_key) AS other_key FROM o a JOIN o b ON a.transfer_group = b.transfer_group AND a.natural_key <> b.natural_key GROUP BY 1)
  SELECT l.natural_key, amount, filename, side, isin, quantity, other_key, o.account AS other_account FROM ledger l LEFT JOIN files f ON l.file_id = f.id LEFT JOIN trades t ON t.natural_key = l.natural_key
  LEFT JOIN c ON c.natural_key = l.natural_key LEFT JOIN o ON o.natural_key = c.other_key""")(lambda ledger, trades, files: query.detail(ledger, trades, files).select(_DETAIL))
register("counterpart_leg", "ledger", """, o AS (SELECT natural_key, transfer_group, account FROM ledger WHERE transfer_group IS NOT NULL),
  c AS (SELECT a.natural_key, min(b.natural_key) AS other_key FROM o a JOIN o b ON a.transfer_group = b.transfer_group AND a.natural_key <> b.natural_key GROUP BY 1)
  SELECT c.natural_key, other_key, o.account AS other_account FROM c JOIN o ON o.natural_key = other_key""")(query.counterparts)
register("transfer_list", "ledger", "SELECT transfer_group, min(value_date) AS day, CAST(max(abs(amount)) AS DECIMAL(38,2)) AS amount, max(account) FILTER (WHERE amount < 0) AS from_account, max(account) FILTER (WHERE amount > 0) AS to_account, count(*) AS n_legs FROM ledger WHERE transfer_group IS NOT NULL GROUP BY 1")(views.internal_transfers)
register("files_recent", "files", "SELECT id, filename, source, status, rows_total, rows_new, rows_total - rows_new AS rows_duplicate, uploaded_at FROM files ORDER BY uploaded_at DESC, id DESC LIMIT 50")(query.recent_files)
register("profile_files", "files", "SELECT holder, source, count(*) AS n_files, max(uploaded_at) AS newest FROM files GROUP BY 1, 2")(views.profile)
register("profile_people", "files", "SELECT CASE WHEN lower(holder) LIKE '%rossi%' THEN 'mario rossi' ELSE 'anna bianchi' END AS person, count(DISTINCT holder) AS n_variants, count(*) AS n_files, min(holder) AS name FROM files WHERE holder IS NOT NULL GROUP BY 1")(
    lambda files: views.profile_people(files, X.person_key(F.col("holder")))
)

# ---------------------------------------------------------------- investments
register("holdings", "trades ledger", f"""SELECT isin, min(instrument) AS instrument, min(asset_class) AS asset_class, CAST(sum(quantity) AS DECIMAL(28,4)) AS units, {_d('-amount', "side = 'buy'")} AS invested, count(*) AS n_trades,
  min(value_date) AS first_trade, max(value_date) AS last_trade, CAST(arg_max(unit_price, {{'d': value_date, 'k': l.natural_key}}) FILTER (WHERE unit_price IS NOT NULL) AS DECIMAL(18,4)) AS last_price,
  CAST(CAST(sum(quantity) AS DECIMAL(18,4)) * CAST(arg_max(unit_price, {{'d': value_date, 'k': l.natural_key}}) FILTER (WHERE unit_price IS NOT NULL) AS DECIMAL(18,4)) AS DECIMAL(36,6)) AS value_at_last_price
  FROM trades t JOIN ledger l ON t.natural_key = l.natural_key WHERE isin IS NOT NULL GROUP BY 1""")(views.holdings)
_INVEST = f"""(SELECT {_MONTH} AS month, category, {_d('-amount', 'amount < 0')} AS contributed, {_d('amount', 'amount > 0')} AS returned, {_d('-amount')} AS net_invested,
  {_d('-amount', 'amount < 0 AND t.natural_key IS NOT NULL')} AS into_known, {_d('-amount', 'amount < 0 AND t.natural_key IS NULL')} AS into_unknown, count(*) AS n_movements
  FROM ledger l LEFT JOIN trades t ON t.natural_key = l.natural_key WHERE {_ASSET} GROUP BY 1, 2)"""
register("investment_month", "trades ledger", f"SELECT * FROM {_INVEST}")(views.investment_month)
_KINDS = ", ".join(f"CAST(sum(coalesce({c}, 0)) AS DECIMAL(38,2)) AS {c}" for c in ("contributed", "returned", "net_invested", "into_known", "into_unknown"))
register("investment_kinds", "trades ledger", f"SELECT category, {_KINDS}, CAST(sum(n_movements) AS BIGINT) AS n_movements, max(coalesce(into_known, 0) <> 0) AS has_instruments FROM {_INVEST} GROUP BY 1")(lambda t, lg: views.investment_kinds(views.investment_month(t, lg)))
register("cumulative_invested", "trades ledger", f"SELECT month, net_invested, CAST(sum(net_invested) OVER (ORDER BY month) AS DECIMAL(38,2)) AS cumulative FROM (SELECT month, {_d('net_invested')} AS net_invested FROM {_INVEST} GROUP BY 1)")(lambda t, lg: views.cumulative_invested(views.investment_month(t, lg)))
register("average_price", "trades ledger", f"SELECT isin, round(CAST({_d('-amount', chr(115) + 'ide = ' + chr(39) + 'buy' + chr(39))} AS DOUBLE) / nullif(CAST(sum(quantity) AS DOUBLE), 0), 4) AS avg_price FROM trades t JOIN ledger l ON t.natural_key = l.natural_key WHERE isin IS NOT NULL GROUP BY 1")(
    lambda t, lg: periods.average_price(views.holdings(t, lg)).select("isin", F.round(F.when(F.col("units") != 0, F.col("invested").cast("double") / F.col("units").cast("double")), 4).alias("avg_price"))
)

# ---------------------------------------------------------------- balances
_RECON = f"""(SELECT a.account, a.balance_date AS from_date, a.next_date AS to_date, a.balance AS from_balance, a.next_balance AS to_balance, CAST(a.next_balance - a.balance AS DECIMAL(38,2)) AS expected_delta,
  CAST(coalesce(sum(t.amount), 0) AS DECIMAL(38,2)) AS actual_delta, CAST(coalesce(sum(t.amount), 0) - (a.next_balance - a.balance) AS DECIMAL(38,2)) AS discrepancy, count(t.natural_key) AS n_movements
  FROM (SELECT *, lead(balance_date) OVER w AS next_date, lead(balance) OVER w AS next_balance FROM balances WINDOW w AS (PARTITION BY account ORDER BY balance_date)) a
  LEFT JOIN ledger t ON t.account = a.account AND (CASE WHEN a.basis = 'booking' THEN t.booking_date ELSE t.value_date END) > a.balance_date AND (CASE WHEN a.basis = 'booking' THEN t.booking_date ELSE t.value_date END) <= a.next_date
  WHERE a.next_date IS NOT NULL GROUP BY a.account, a.balance_date, a.next_date, a.balance, a.next_balance)"""
register("reconciliation", "balances ledger", f"SELECT * FROM {_RECON}")(views.reconciliation)
register("reconciliation_mismatched", "balances ledger", f"SELECT * FROM {_RECON} WHERE discrepancy <> 0")(lambda b, lg: views.reconciliation(b, lg, True))
register("reconciliation_rollup", "balances ledger", f"SELECT account, count(*) AS n, count(*) FILTER (WHERE discrepancy <> 0) AS bad, {_d('discrepancy')} AS net_discrepancy, arg_max(to_balance, to_date) AS last_balance FROM {_RECON} GROUP BY 1")(lambda b, lg: views.reconciliation_rollup(views.reconciliation(b, lg)))
_MONTHS = "(SELECT CAST(unnest(generate_series(date_trunc('month', min(balance_date)), date_trunc('month', max(balance_date)), INTERVAL 1 MONTH)) AS DATE) AS month FROM balances)"
_GRID = f"(SELECT m.month, a.account, a.currency, b.balance, b.balance_date AS as_of FROM {_MONTHS} m CROSS JOIN (SELECT DISTINCT account, currency FROM balances) a ASOF JOIN balances b ON a.account = b.account AND CAST(m.month + INTERVAL 1 MONTH AS DATE) > b.balance_date)"
register("month_series", "balances", f"SELECT * FROM {_MONTHS}")(views.month_series)
register("balance_month", "balances", f"SELECT * FROM {_GRID}")(views.balance_month)
register("wealth_latest", "balances", f"SELECT account, balance, as_of, CAST(sum(balance) OVER () AS DECIMAL(38,2)) AS total, min(as_of) OVER () AS oldest_as_of FROM (SELECT account, arg_max(balance, month) AS balance, arg_max(as_of, month) AS as_of FROM {_GRID} GROUP BY 1)")(lambda b: views.wealth(views.balance_month(b)))
register("stale_accounts", "balances", f"SELECT account, max(as_of) < (SELECT max(as_of) FROM {_GRID}) - 45 AS stale FROM {_GRID} GROUP BY 1")(lambda b: periods.stale_accounts(views.wealth(views.balance_month(b)).select("account", "as_of")).select("account", "stale"))
_ACCOUNTS = [f"acct_{n}" for n in range(20)]
register("balance_pivot", "balances", f"SELECT month, {', '.join(f'CAST(coalesce(sum(balance) FILTER (WHERE account = {chr(39)}{a}{chr(39)}), 0) AS DECIMAL(38,2)) AS {a}' for a in _ACCOUNTS)} FROM {_GRID} GROUP BY 1")(lambda b: periods.balance_pivot(views.balance_month(b), _ACCOUNTS))
_LINES = "(SELECT account, amount, row_number() OVER (PARTITION BY account ORDER BY value_date, natural_key) AS line_no, sum(amount) OVER (PARTITION BY account ORDER BY value_date, natural_key ROWS UNBOUNDED PRECEDING) + CASE WHEN file_id % 97 = 0 THEN 5 ELSE 0 END AS balance FROM {ledger})"


@register("balance_continuity", "ledger", f"SELECT account, line_no FROM (SELECT *, lag(balance) OVER (PARTITION BY account ORDER BY line_no) AS before FROM {_LINES.format(ledger='ledger')}) WHERE abs(before + amount - balance) > 0.01")
def _continuity(ledger: DataFrame) -> DataFrame:
    return views.balance_continuity(ledger.sparkSession.sql(f"SELECT * FROM {_LINES}", ledger=ledger)).select("account", "line_no")


# ---------------------------------------------------------------- identity and upserts
_OCC = "row_number() OVER (PARTITION BY file, account, value_date, amount ORDER BY line_no)"
_ROWS = "(SELECT cast(file_id % 7 as varchar(20)) AS file, natural_key AS line_no, account, value_date, cast(round(amount / 1000) * 1000 as decimal(18,2)) AS amount, description FROM {ledger})"
_KEYED = f"(SELECT *, {_OCC} AS occurrence, sha256(concat_ws('|', account, strftime(value_date, '%Y-%m-%d'), CAST(amount AS VARCHAR), CAST({_OCC} AS VARCHAR))) AS natural_key FROM {_ROWS.format(ledger='ledger')})"


def _rows(ledger: DataFrame) -> DataFrame:
    return ledger.sparkSession.sql(f"SELECT * FROM {_ROWS}", ledger=ledger)


register("occurrence_index", "ledger", f"SELECT file, line_no, {_OCC} AS occurrence FROM {_ROWS.format(ledger='ledger')}")(lambda lg: merge.occurrences(_rows(lg)).select("file", "line_no", "occurrence"))
register("natural_key", "ledger", f"SELECT line_no, natural_key FROM {_KEYED}")(lambda lg: merge.keyed(_rows(lg)).select("line_no", "natural_key"))
register("cross_file_dedup", "ledger", f"SELECT natural_key, arg_min(line_no, {{'a': length(description) * -1, 'b': line_no}}) AS line_no FROM {_KEYED} GROUP BY 1")(
    lambda lg: merge.dedup(merge.keyed(_rows(lg)), [F.length("description").desc(), F.col("line_no")]).select("natural_key", "line_no")
)
_HIST = """(SELECT cast(file_id % 500 as varchar(20)) AS natural_key, row_number() OVER (PARTITION BY file_id % 500 ORDER BY natural_key) - 1 AS seq, substr(description, 1, cast(8 + cast(floor(abs(amount)) as bigint) % 30 as int)) AS description, merchant,
  CASE WHEN file_id % 3 = 0 THEN mcc END AS mcc, CASE WHEN file_id % 5 = 0 THEN '10:30' END AS purchase_time, category, CASE WHEN file_id % 500 < 20 AND category = 'rent' THEN 'manual' ELSE 'rule' END AS category_source,
  min(value_date) OVER (PARTITION BY file_id % 500) AS value_date, CASE WHEN file_id % 3 < 2 THEN booking_date ELSE min(value_date) OVER (PARTITION BY file_id % 500) END AS booking_date FROM {ledger})"""
_FOLD = f"""WITH RECURSIVE ledger AS ({A.text('ledger')}), h AS (SELECT * FROM {_HIST.format(ledger='ledger')}), n AS (SELECT natural_key, max(seq) AS last FROM h GROUP BY 1),
f AS (SELECT natural_key, seq, description, merchant, mcc, purchase_time, category, category_source, value_date, booking_date, false AS enriched FROM h WHERE seq = 0
  UNION ALL
  SELECT h.natural_key, h.seq, CASE WHEN length(h.description) > length(f.description) THEN h.description ELSE f.description END, CASE WHEN length(h.description) > length(f.description) THEN h.merchant ELSE f.merchant END,
    CASE WHEN length(h.description) > length(f.description) THEN coalesce(h.mcc, f.mcc) ELSE f.mcc END, CASE WHEN length(h.description) > length(f.description) THEN coalesce(h.purchase_time, f.purchase_time) ELSE f.purchase_time END,
    CASE WHEN length(h.description) > length(f.description) AND NOT (f.category_source = 'manual' AND f.keep) THEN h.category ELSE f.category END,
    CASE WHEN length(h.description) > length(f.description) AND NOT (f.category_source = 'manual' AND f.keep) THEN h.category_source ELSE f.category_source END,
    f.value_date, CASE WHEN h.booking_date <> f.value_date THEN h.booking_date ELSE f.booking_date END, f.enriched OR length(h.description) > length(f.description)
  FROM (SELECT *, true AS keep FROM f) f JOIN h ON h.natural_key = f.natural_key AND h.seq = f.seq + 1)
SELECT f.natural_key, value_date, booking_date, description, merchant, mcc, purchase_time, category, category_source, enriched FROM f JOIN n ON n.natural_key = f.natural_key AND n.last = f.seq"""


@register("ledger_upsert", "ledger")
def _upsert(ledger: DataFrame) -> DataFrame:
    h = ledger.sparkSession.sql(f"SELECT * FROM {_HIST}", ledger=ledger)
    first = h.where("seq = 0")
    return merge.ledger_upsert(first.drop("seq"), h.where("seq > 0").withColumn("category_source", F.lit("rule"))).drop("fresh")


SQL["ledger_upsert"] = _FOLD.replace("h AS (SELECT * FROM", "h AS (SELECT * REPLACE (CASE WHEN seq = 0 THEN category_source ELSE 'rule' END AS category_source) FROM")



@register("account_upsert", "accounts", "SELECT account_id, coalesce(max(CASE WHEN product <> 'BUILDING' THEN product END), max(product)) AS product, max(bank_name) AS bank_name FROM (SELECT account_id, product, NULL AS bank_name FROM accounts UNION ALL SELECT account_id, NULL, bank_name FROM accounts) GROUP BY 1")
def _accounts(accounts: DataFrame) -> DataFrame:
    old = accounts.select("account_id", "product", F.lit(None).cast("string").alias("bank_name"))
    return merge.coalesce_upsert(old, accounts.select("account_id", F.lit(None).cast("string").alias("product"), "bank_name"), ["account_id"])


@register("balance_upsert", "balances ledger", "SELECT account, balance_date, CASE WHEN account = 'acct_1' THEN balance + 1 ELSE balance END AS balance FROM balances")
def _balances(balances: DataFrame, ledger: DataFrame) -> DataFrame:
    old = balances.select("account", "balance_date", "balance")
    again = old.where("account = 'acct_1'").withColumn("balance", (F.col("balance") + 1).cast("decimal(38,2)"))
    twice = again.withColumn("balance", F.lit(0).cast("decimal(38,2)")).withColumn("seq", F.lit(0)).unionByName(again.withColumn("seq", F.lit(1)))
    return merge.replace_upsert(old, twice, ["account", "balance_date"])


_FEEDBACK = "(SELECT cast(conv_id as varchar(20)) AS natural_key, role AS category, turn AS id FROM conversations)"
register("feedback_latest", "conversations", f"SELECT natural_key, arg_max(category, id) AS category FROM {_FEEDBACK} GROUP BY 1")(
    lambda c: merge.latest(c.select(F.col("conv_id").cast("string").alias("natural_key"), F.col("role").alias("category"), F.col("turn").alias("id")), "natural_key", "category", "id")
)
_FIX = "(SELECT natural_key, CASE file_id % 3 WHEN 0 THEN 'rent' WHEN 1 THEN 'dining' ELSE category END AS category, file_id AS id FROM {ledger} WHERE amount > 0 UNION ALL SELECT natural_key, 'fees' AS category, -1 AS id FROM {ledger})"
register("feedback_reapply", "ledger", f", f AS (SELECT natural_key, arg_max(category, id) AS corrected FROM {_FIX.format(ledger='ledger')} GROUP BY 1) SELECT l.natural_key, corrected AS category FROM ledger l JOIN f ON f.natural_key = l.natural_key WHERE l.category IS DISTINCT FROM corrected OR l.category_source IS DISTINCT FROM 'manual'")(
    lambda lg: merge.reapply_feedback(lg, lg.sparkSession.sql(f"SELECT * FROM {_FIX}", ledger=lg))
)
register("recategorize_guarded", "ledger", "SELECT natural_key, CASE WHEN category_source IN ('rule','default') AND amount > 0 THEN 'salary' ELSE category END AS category, CASE WHEN category_source IN ('rule','default') AND amount > 0 THEN 'model' ELSE category_source END AS category_source FROM ledger")(
    lambda lg: merge.recategorize(lg, lg.where("amount > 0").select("natural_key", F.lit("salary").alias("new_category"), F.lit("model").alias("new_source")))
)

# ---------------------------------------------------------------- transfers
_CAND = """(SELECT -o.amount AS size, o.natural_key AS out_key, i.natural_key AS in_key, abs(i.value_date - o.value_date) AS gap FROM legs o JOIN legs i ON i.amount = -o.amount AND i.account <> o.account AND abs(i.value_date - o.value_date) <= 4
  WHERE o.amount < 0 AND (i.value_date = o.value_date OR o.description IN ('Bonifico disposto','Giroconto') OR i.description = 'TOP-UP'))"""
register("transfer_candidates", "legs", f"SELECT CAST(size AS DECIMAL(38,2)) AS size, out_key, in_key, gap FROM {_CAND}")(lambda legs: transfers.candidates(legs).withColumn("size", F.col("size").cast("decimal(38,2)")))
# Pairs that come first for both their legs, again and again with the rest: as the order is total, these are the greedy ones.
_ORDER = "ORDER BY gap, size DESC, out_key, in_key"
_GREEDY = f"""r AS (SELECT size, out_key, in_key, gap, false AS paired FROM {_CAND} UNION ALL
  (WITH o AS (SELECT *, row_number() OVER (PARTITION BY out_key {_ORDER}) = 1 AND row_number() OVER (PARTITION BY in_key {_ORDER}) = 1 AS best FROM r WHERE NOT paired),
    m AS (SELECT *, bool_or(best) OVER (PARTITION BY out_key) OR bool_or(best) OVER (PARTITION BY in_key) AS gone FROM o) SELECT size, out_key, in_key, gap, best FROM m WHERE best OR NOT gone))"""
register("transfer_pairs", "legs", f", {_GREEDY} SELECT CAST(size AS DECIMAL(38,2)) AS size, out_key, in_key, gap, substr(sha256(least(out_key, in_key) || '|' || greatest(out_key, in_key)), 1, 16) AS transfer_group FROM r WHERE paired")(
    lambda legs: transfers.find_pairs(legs).withColumn("size", F.col("size").cast("decimal(38,2)"))
)
SQL["transfer_pairs"] = SQL["transfer_pairs"].replace("WITH ", "WITH RECURSIVE ", 1)

# ---------------------------------------------------------------- recurrence
register("recurrence_key", "series", "SELECT natural_key, trim(regexp_replace(regexp_replace(replace(lower(description), 's.p.a.', 'spa'), '[^a-z]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM series")(lambda s: s.select("natural_key", X.recurrence_key(F.col("description")).alias("key")))
_WINDOWS = "(VALUES ('weekly',5,10),('monthly',24,38),('bimonthly',50,75),('quarterly',78,110),('semiannual',155,220),('yearly',330,430)) w(cadence, lo, hi)"
_KEYED_SERIES = "r AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(description), 's.p.a.', 'spa'), '[^a-z]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key, amount < 0 AS outgoing FROM series)"
_LIKE = "{0} IS NOT NULL AND {1} IS NOT NULL AND least(abs({0}), abs({1})) > 0 AND greatest(abs({0}), abs({1})) <= 1.5 * least(abs({0}), abs({1}))"
_MED = "CASE WHEN len(ts) % 2 = 1 THEN CAST(ts[(len(ts) + 1) // 2] AS DECIMAL(18,3)) ELSE CAST(CAST(ts[len(ts) // 2] + ts[len(ts) // 2 + 1] AS DECIMAL(18,2)) * 0.5 AS DECIMAL(18,3)) END"


def _series_sql(rows: str) -> str:
    """(key, outgoing, n, first_date, last_date, first_total, last_total, gaps, ts, alike) of rows (key, outgoing, value_date, amount)."""
    return f"""SELECT key, outgoing, count(*) AS n, min(value_date) AS first_date, max(value_date) AS last_date, arg_min(total, value_date) AS first_total, arg_max(total, value_date) AS last_total, list(gap) FILTER (WHERE gap IS NOT NULL) AS gaps,
      list_sort(list(total)) AS ts, count(*) FILTER (WHERE {_LIKE.format('total', 'prev')}) AS alike FROM (SELECT *, value_date - lag(value_date) OVER w AS gap, lag(total) OVER w AS prev
      FROM (SELECT key, outgoing, value_date, sum(amount) AS total FROM {rows} GROUP BY ALL) WINDOW w AS (PARTITION BY key, outgoing ORDER BY value_date)) GROUP BY ALL"""


def _rhythm_sql(found: str) -> str:
    """Those of them that have a rhythm, with mg, cadence, reg and med."""
    return f"""SELECT * FROM (SELECT x.*, w.cadence, list_aggregate(gaps, 'median') AS mg, len(list_filter(gaps, lambda g: g BETWEEN lo AND hi)) / len(gaps) AS reg, CAST(round_even({_MED}, 2) AS DECIMAL(18,2)) AS med
      FROM (SELECT * FROM {found} WHERE n >= 3) x JOIN {_WINDOWS} ON list_aggregate(gaps, 'median') BETWEEN lo AND hi) WHERE reg >= 0.7 AND med <> 0 AND (alike / (n - 1) >= 0.7 OR reg >= 0.9)"""


_SAID = """SELECT g.key, g.outgoing, n AS n_occurrences, first_date, last_date, CAST(med AS DECIMAL(18,2)) AS amount, CAST(ts[1] AS DECIMAL(18,2)) AS amount_min, CAST(ts[len(ts)] AS DECIMAL(18,2)) AS amount_max, cadence, round_even(reg, 3) AS regularity,
  CAST(round_even(CAST(CAST(med AS DECIMAL(18,2)) * 30.44 AS DECIMAL(28,4)) * 10 / CAST(mg * 10 AS BIGINT), 2) AS DECIMAL(18,2)) AS monthly_equivalent,
  (DATE '2026-01-01' - (last_date + CAST(round_even(mg, 0) AS INTEGER))) <= greatest(21, 0.35 * mg) AS active, CASE WHEN (DATE '2026-01-01' - (last_date + CAST(round_even(mg, 0) AS INTEGER))) <= greatest(21, 0.35 * mg) THEN last_date + CAST(round_even(mg, 0) AS INTEGER) END AS next_expected,
  description, category, accounts
FROM ({found}) g JOIN (SELECT key, outgoing, arg_max(description, {{'l': length(description), 'k': natural_key}}) AS description, arg_max(category, {{'d': value_date, 'k': natural_key}}) AS category, array_to_string(list_sort(list(DISTINCT account)), ',') AS accounts FROM {rows} GROUP BY 1, 2) x ON x.key = g.key AND x.outgoing = g.outgoing"""
_GROUPS = f", {_KEYED_SERIES}, s AS ({_series_sql('r')}) {_SAID.format(found=_rhythm_sql('s'), rows='r')}"
# In the table a series is renamed once, so that one round joins each with what follows it.
_TWINS = f"""{_KEYED_SERIES}, s AS ({_series_sql('r')}), q AS ({_rhythm_sql('s')}),
u AS (SELECT a.key, a.outgoing, b.key AS follows, a.cadence AS was, a.first_date AS a0, b.first_date AS b0, a.n + b.n AS n, a.first_date, b.last_date, list_concat(list_concat(a.gaps, [b.first_date - a.last_date]), b.gaps) AS gaps, list_sort(list_concat(a.ts, b.ts)) AS ts,
  a.alike + b.alike + CASE WHEN {_LIKE.format('a.last_total', 'b.first_total')} THEN 1 ELSE 0 END AS alike FROM q a JOIN q b ON a.outgoing = b.outgoing AND a.cadence = b.cadence AND b.first_date > a.last_date AND greatest(abs(a.med), abs(b.med)) <= 1.25 * least(abs(a.med), abs(b.med))),
p AS (SELECT * FROM ({_rhythm_sql('u')}) WHERE cadence = was)"""
_G = ["key", "outgoing", "n_occurrences", "first_date", "last_date", "amount", "amount_min", "amount_max", "cadence", "regularity", "monthly_equivalent", "active", "next_expected", "description", "category", "accounts"]
_said = lambda found: found.withColumn("accounts", F.array_join("accounts", ",")).select(_G)
register("recurring_groups", "series", _GROUPS)(lambda s: _said(recurrence.groups(s, "2026-01-01")))
register("recurring_twins", "series", f", {_TWINS} SELECT outgoing, key, follows, n AS n_occurrences, cadence FROM p")(
    lambda s: recurrence._follow(recurrence.rhythmic(recurrence.series(recurrence.keyed(s), ["key", "outgoing"])).select(*recurrence._ONE)).select("outgoing", "key", F.col("then").alias("follows"), "n_occurrences", "cadence")
)
register("recurring_merged", "series")(lambda s: _said(recurrence.detect(s, "2026-01-01")))
register("recurring_summary", "series")(lambda s: recurrence.summary(recurrence.detect(s, "2026-01-01")))

# ---------------------------------------------------------------- coverage
_COV = """, mov AS (SELECT concat(lower(merchant), native_category) AS source, value_date FROM ledger), days AS (SELECT DISTINCT source, day FROM (SELECT source, value_date AS day FROM mov UNION ALL SELECT source, balance_date FROM balances)),
g AS (SELECT *, lead(day) OVER (PARTITION BY source ORDER BY day) AS next_day, lead(day) OVER (PARTITION BY source ORDER BY day) - day AS gap FROM days),
h AS (SELECT g.source, g.day AS from_date, next_day AS to_date, gap AS days FROM g JOIN (SELECT source, CASE WHEN count(*) >= 3 THEN median(gap) END AS rhythm FROM g GROUP BY 1) r ON r.source = g.source WHERE gap > coalesce(greatest(45.0, 1.8 * rhythm), 45.0)),
an AS (SELECT source, balance_date AS day, lead(balance_date) OVER (PARTITION BY source ORDER BY balance_date) - balance_date AS gap FROM (SELECT DISTINCT source, balance_date FROM balances)),
ra AS (SELECT source, count(*) AS n_anchors, CASE WHEN count(*) >= 3 THEN median(gap) END AS rhythm FROM an GROUP BY 1)"""
_cov = lambda lg: lg.withColumn("source", F.concat(F.lower("merchant"), "native_category"))  # noqa: E731  narrow sources, so that there are holes
register("coverage_holes", "ledger balances", _COV + " SELECT * FROM h")(lambda lg, b: coverage.holes(_cov(lg), b))
register("coverage_report", "ledger balances", _COV + """, s AS (SELECT source, min(day) AS a, max(day) AS b FROM days GROUP BY 1), m AS (SELECT source, count(*) AS n FROM mov GROUP BY 1), w AS (SELECT source, count(*) AS n, max(days) AS d FROM h GROUP BY 1)
  SELECT s.source, coalesce(m.n, 0) AS n_movements, coalesce(n_anchors, 0) AS n_anchors, a AS covered_from, b AS covered_until, CAST(round_even(rhythm, 0) AS INTEGER) AS anchor_cadence_days, DATE '1999-01-01' - b AS stale_days,
  DATE '1999-01-01' - b > coalesce(greatest(45.0, 1.5 * rhythm), 45.0) AS stale, coalesce(w.n, 0) AS n_holes, coalesce(w.d, 0) AS widest_hole FROM s LEFT JOIN m ON m.source = s.source LEFT JOIN ra ON ra.source = s.source LEFT JOIN w ON w.source = s.source""")(
    lambda lg, b: coverage.report(_cov(lg), b, "1999-01-01")
)

# ---------------------------------------------------------------- text and categories
_AMT = "(SELECT page_id, CASE page_id % 6 WHEN 0 THEN '€1,281.64' WHEN 1 THEN concat('(€', cast(page_id as varchar(20)), '.50)') WHEN 2 THEN '5.00-' WHEN 3 THEN concat('€-', cast(page_id as varchar(20)), '.05') WHEN 4 THEN 'N/A' ELSE '5-0' END AS raw FROM {pages})"
register("parse_money", "pages", f"SELECT page_id, CAST(CASE page_id % 6 WHEN 0 THEN 1281.64 WHEN 1 THEN -(page_id + 0.50) WHEN 2 THEN -5.00 WHEN 3 THEN -(page_id + 0.05) END AS DECIMAL(18,4)) AS amount FROM {_AMT.format(pages='pages')}")(
    lambda p: p.sparkSession.sql(f"SELECT * FROM {_AMT}", pages=p).select("page_id", M.parse_money(F.col("raw")).alias("amount"))
)
register("normalize_text", "documents", r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', ' '), '[^a-z0-9]+', ' ', 'g'))) AS norm_sha256 FROM documents")(lambda d: d.select("doc_id", F.sha2(X.normalize_desc(F.col("text")), 256).alias("norm_sha256")))
_PAY = "(SELECT natural_key, CASE file_id % 5 WHEN 0 THEN concat('Pagamento su POS ', merchant, ' 07/031245 Carta n. 8') WHEN 1 THEN concat('PRESSO ', merchant, ' 99887766001') WHEN 2 THEN concat('Bonifico presso ', merchant, ' ALLE ORE 0917') WHEN 3 THEN concat('Pagamento BANCOMAT PAY presso ', merchant, ' data: 02.11 ore: 08:35') ELSE merchant END AS description FROM {ledger})"
register("merchant_extract", "ledger", f"SELECT l.natural_key, CASE file_id % 5 WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE merchant END AS merchant, CASE file_id % 5 WHEN 0 THEN '12:45' WHEN 2 THEN '09:17' WHEN 3 THEN '08:35' END AS purchase_time FROM ledger l")(
    lambda lg: lg.sparkSession.sql(f"SELECT * FROM {_PAY}", ledger=lg).select("natural_key", X.extract_merchant(F.lit("intesa"), F.col("description")).alias("x")).select("natural_key", "x.*")
)
_SAY = "(SELECT natural_key, file_id, mcc, CASE file_id % 9 WHEN 0 THEN 'cedolino stipendio' WHEN 1 THEN 'fondo pensione' WHEN 2 THEN 'booking taxi' WHEN 3 THEN 'eni gas' WHEN 4 THEN 'enigma' WHEN 5 THEN 'bonifico' WHEN 6 THEN 'cedola btp' WHEN 7 THEN 'bar roma' ELSE 'barca' END AS norm, CASE WHEN file_id % 2 = 0 THEN merchant END AS merchant, CASE WHEN file_id % 4 < 3 THEN 'leisure' END AS predicted, cast(file_id % 10 as double) / 10 AS confidence FROM {ledger})"
_RULE = "CASE file_id % 9 WHEN 0 THEN 'salary' WHEN 1 THEN 'pension_fund' WHEN 2 THEN 'travel' WHEN 3 THEN 'bills' WHEN 5 THEN 'transfers' WHEN 6 THEN 'investments' WHEN 7 THEN 'dining' END"
_say = lambda lg: lg.sparkSession.sql(f"SELECT * FROM {_SAY}", ledger=lg)
register("rule_category", "ledger", f"SELECT natural_key, {_RULE} AS category FROM ledger")(lambda lg: _say(lg).select("natural_key", X.rule_category(F.col("norm")).alias("category")))
_TABLE = {"5111": "groceries", "5000-5500": "shopping", "5501-6000": "bills"}
_MCC = "CASE WHEN mcc = '5111' THEN 'groceries' WHEN CAST(mcc AS INTEGER) BETWEEN 5000 AND 5500 THEN 'shopping' WHEN CAST(mcc AS INTEGER) BETWEEN 5501 AND 6000 THEN 'bills' END"
register("mcc_category", "ledger", f"SELECT natural_key, {_MCC} AS category FROM ledger")(lambda lg: lg.select("natural_key", C.mcc_category(F.col("mcc"), _TABLE).alias("category")))
register("resolver_chain", "ledger", f", s AS (SELECT *, {_RULE} AS rule, CASE WHEN file_id % 7 = 0 THEN {_MCC} END AS code, predicted IS NOT NULL AND confidence >= 0.75 AS sure FROM {_SAY.format(ledger='ledger')}) SELECT natural_key, CASE WHEN code IS NOT NULL THEN code WHEN merchant IS NOT NULL AND sure THEN predicted WHEN rule IS NOT NULL THEN rule WHEN sure THEN predicted ELSE 'other' END AS code, CASE WHEN code IS NOT NULL THEN 1.0 WHEN merchant IS NOT NULL AND sure THEN confidence WHEN rule IS NOT NULL THEN 0.9 WHEN sure THEN confidence ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN code IS NOT NULL THEN 'mcc' WHEN merchant IS NOT NULL AND sure THEN 'model' WHEN rule IS NOT NULL THEN 'rule' WHEN sure THEN 'model' ELSE 'default' END AS source FROM s")(
    lambda lg: _say(lg).withColumn("mcc", F.when(F.col("file_id") % 7 == 0, F.col("mcc"))).select("natural_key", C.resolve(F.col("mcc"), F.col("merchant"), F.col("norm"), F.col("predicted"), F.col("confidence"), table=_TABLE).alias("x")).select("natural_key", "x.*")
)
register("category_labels", "ledger", "SELECT DISTINCT category, CASE category WHEN 'groceries' THEN 'Spesa' WHEN 'dining' THEN 'Ristorazione' WHEN 'transport' THEN 'Trasporti' WHEN 'bills' THEN 'Bollette' WHEN 'investments' THEN 'Investimenti' WHEN 'crypto' THEN 'Crypto' WHEN 'rent' THEN 'Affitti' ELSE 'Altro' END AS label FROM ledger")(
    lambda lg: lg.select("category").distinct().select("category", X.label(F.col("category"), "it").alias("label"))
)
# Pages with a source's words somewhere in the head, or just behind it, in four of five; the fifth is as it is.
_HEAD = f"(SELECT page_id, substr(concat(substr(coalesce(html, ''), 1, cast(page_id % 5000 as int)), CASE page_id % 5 WHEN 0 THEN ' Revolut ' WHEN 1 THEN ' money in/out, balance, intesa sanpaolo ' WHEN 2 THEN ' Trade Republic, intesa sanpaolo ' WHEN 3 THEN ' asset_class;transaction_id ' ELSE '' END, substr(coalesce(html, ''), cast(page_id % 5000 as int) + 1)), 1, {HEAD}) AS head FROM {{pages}})"
_SCORES = ", ".join(f"CASE {' '.join(f'WHEN {g} THEN {n}' for g, n in groups)} ELSE 0 END AS {s}" for s, groups in {
    "r": [("contains(h, 'money in/out') AND contains(h, 'balance')", 2), ("contains(h, 'revolut') OR contains(h, 'current accounts summaries')", 1)],
    "t": [("contains(h, 'asset_class') AND contains(h, 'transaction_id')", 2), ("contains(h, 'trade republic')", 1)], "i": [("contains(h, 'intesa sanpaolo') OR contains(h, 'conti e carte')", 1)],
}.items())
register("detect_source", "pages", f"SELECT page_id, CASE WHEN r > t AND r > i THEN 'revolut' WHEN t > r AND t > i THEN 'trade_republic' WHEN i > r AND i > t THEN 'intesa' END AS source FROM (SELECT page_id, {_SCORES} FROM (SELECT page_id, lower(head) AS h FROM {_HEAD.format(pages='pages')}))")(
    lambda p: p.sparkSession.sql(f"SELECT * FROM {_HEAD}", pages=p).select("page_id", detect.detect_source(F.col("head")).alias("source"))
)

# ---------------------------------------------------------------- neighbours and training
# Every vector whose id is divisible by 50 asks all vectors; for a prediction its own row doesn't count.
_DOT = "SELECT q.vec_id AS query_id, l.vec_id, l.label, list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(l.vector AS DOUBLE[])) AS sim FROM vectors q JOIN vectors l ON q.vec_id % 50 = 0"
_top = lambda dot: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id) AS rank FROM ({dot})) WHERE rank <= 5)"
_KNN = _top(_DOT + " AND q.vec_id <> l.vec_id")
_asked = lambda v: v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
_knn = lambda v: C.knn(_asked(v), v, others=True)
register("knn_topk", "vectors", f"SELECT query_id, vec_id, label, rank, round(sim, 4) AS sim FROM {_top(_DOT)}")(lambda v: C.knn(_asked(v), v).withColumn("sim", F.round("sim", 4)))
_VOTE = f"(SELECT query_id, arg_max({{'l': label, 's': score, 'c': confidence}}, {{'s': round(score, 12), 'f': -f}}) AS x FROM (SELECT query_id, label, sum(sim) AS score, max(sim) AS confidence, min(rank) AS f FROM {_KNN} GROUP BY 1, 2) GROUP BY 1)"
register("knn_predict", "vectors", f"SELECT query_id, x.l AS label, round(x.s, 4) AS score, round(x.c, 4) AS confidence FROM {_VOTE}")(lambda v: C.vote(_knn(v)).withColumns({"score": F.round("score", 4), "confidence": F.round("confidence", 4)}))
_PRED = f"(SELECT v.label AS actual, x.l AS predicted FROM {_VOTE} p JOIN vectors v ON v.vec_id = p.query_id)"
register("macro_f1", "vectors", f", p AS (SELECT * FROM {_PRED}), l AS (SELECT actual AS label FROM p UNION SELECT predicted FROM p), f AS (SELECT label, (SELECT count(*) FROM p WHERE actual = label AND predicted = label) AS tp, (SELECT count(*) FROM p WHERE actual = label) AS a, (SELECT count(*) FROM p WHERE predicted = label) AS q FROM l) SELECT round(sum(tp) / sum(a), 9) AS accuracy, round(avg(2 * tp / (a + q)), 9) AS macro_f1, count(*) AS n_labels FROM f")(
    lambda v: C.macro_f1(C.vote(_knn(v)).join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("actual")), "query_id").select("actual", F.col("label").alias("predicted"))).withColumns({"accuracy": F.round("accuracy", 9), "macro_f1": F.round("macro_f1", 9)})
)

# Descriptions as hashed n-grams, and the noun of a description learned from them.
_NORM = r"trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g'))"
_TEXTS = f"t AS (SELECT text, max(category) AS category FROM (SELECT {_NORM} AS text, split_part(description, ' ', 2) AS category FROM ledger) GROUP BY 1)"
_HASH = "CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % 256"
_GRAMS = "SELECT text, {0} AS b FROM (SELECT text, unnest(list_transform(range(1, length(text) + 1), lambda i: substr(' ' || text || ' ', i, 3))) AS g FROM {1} WHERE text <> '')".replace("{0}", _HASH)


def _features_sql(fitted: str, texts: str) -> str:
    """(text, b, w): the features of ``texts`` with the weights of ``fitted``."""
    return f"""SELECT text, b, tf * idf / sqrt(sum(tf * tf * idf * idf) OVER (PARTITION BY text)) AS w FROM (SELECT text, g.b, count(*) AS tf, any_value(coalesce(idf, (SELECT ln(1 + count(*)) + 1 FROM {fitted}))) AS idf
      FROM ({_GRAMS.format('', texts)}) g LEFT JOIN (SELECT b, ln((1 + (SELECT count(*) FROM {fitted})) / (1 + count(DISTINCT text))) + 1 AS idf FROM ({_GRAMS.format('', fitted)}) GROUP BY 1) i ON i.b = g.b GROUP BY 1, 2)"""


def _described(ledger: DataFrame) -> DataFrame:
    """(text, category): the normalised descriptions, each with the second word as its category."""
    said = ledger.select("description").distinct()  # each is normalised once
    return said.select(X.normalize_desc(F.col("description")).alias("text"), F.split_part("description", F.lit(" "), F.lit(2)).alias("category")).groupBy("text").agg(F.max("category").alias("category"))


@register("text_features", "ledger", f", {_TEXTS} SELECT text, CAST(b AS INTEGER) AS bucket, round(w, 6) AS weight FROM ({_features_sql('t', 't')})")
def _features(ledger: DataFrame) -> DataFrame:
    rows = saved(_described(ledger), "texts")  # read by the fit and by what it makes
    return T.fit(rows).features(rows).select("text", F.inline("features")).withColumn("weight", F.round("weight", 6))


@register("text_champion", "ledger", f""", {_TEXTS}, h AS (SELECT text, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || text), text) <= round(count(*) OVER (PARTITION BY category) * 0.2) AS held FROM t), a AS (SELECT * FROM h WHERE NOT held), q AS (SELECT * FROM h WHERE held),
  v AS (SELECT x.text AS asked, y.text, sum(x.w * y.w) AS sim FROM ({_features_sql('a', 'q')}) x JOIN ({_features_sql('a', 'a')}) y ON x.b = y.b GROUP BY 1, 2),
  n AS (SELECT * FROM (SELECT asked, category AS label, sim, row_number() OVER (PARTITION BY asked ORDER BY round(sim, 12) DESC, CAST('0x' || substr(md5(v.text), 1, 15) AS BIGINT)) AS rank FROM v JOIN a ON a.text = v.text) WHERE rank <= 5),
  p AS (SELECT category AS actual, predicted FROM q JOIN (SELECT asked, arg_max(label, {{'s': round(score, 12), 'f': -f}}) AS predicted FROM (SELECT asked, label, sum(sim) AS score, min(rank) AS f FROM n GROUP BY 1, 2) GROUP BY 1) ON asked = text),
  l AS (SELECT actual AS label FROM p UNION SELECT predicted FROM p), f AS (SELECT label, (SELECT count(*) FROM p WHERE actual = label AND predicted = label) AS tp, (SELECT count(*) FROM p WHERE actual = label) AS a, (SELECT count(*) FROM p WHERE predicted = label) AS q FROM l)
  SELECT round(avg(2 * tp / (a + q)), 9) AS macro_f1, round(avg(2 * tp / (a + q)), 9) AS champion_f1, true AS promoted FROM f""")
def _champion(ledger: DataFrame) -> DataFrame:
    """A model fitted anew against the one before, on the same held-out rows: they tie, so the new one takes over."""
    rows = saved(C.split(_described(ledger)), "texts")  # read by both fits and both scores
    taught, held = rows.where("NOT holdout").select("text", "category"), rows.where("holdout").select("text", "category")
    champion, challenger = T.fit(taught), T.fit(taught)
    stays, new, old = T.challenge(challenger, champion, held)
    return ledger.sparkSession.createDataFrame([(round(new, 9), round(old, 9), stays is challenger)], "macro_f1 double, champion_f1 double, promoted boolean")


@register("training_set", "ledger labels")
def _training(ledger: DataFrame, labels: DataFrame) -> DataFrame:
    t = ledger.select(F.col("file_id").alias("id"), "natural_key", F.col("merchant").alias("text"), "category", "category_source")
    lab = labels.select(F.col("doc_id").alias("id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("doc_id") % 50).cast("string"), 9, "0")).alias("text_norm"), F.when(F.col("quality") == 1, "salary").otherwise("other").alias("category"), F.when(F.col("toxic") == 1, "manual").otherwise("llm").alias("source"))
    fix = ledger.where("amount > 90000").select(F.col("file_id").alias("id"), "natural_key").withColumn("category", F.lit("fees"))
    return C.training_set(t.groupBy("text").agg(F.max_by("id", F.struct("id", "natural_key")).alias("id"), F.max_by("natural_key", F.struct("id", "natural_key")).alias("natural_key"), F.max_by("category", F.struct("id", "natural_key")).alias("category"), F.max_by("category_source", F.struct("id", "natural_key")).alias("category_source")), lab, fix)


SQL["training_set"] = _with("ledger", """, t AS (SELECT merchant AS text, max(k) AS m FROM (SELECT merchant, {'i': file_id, 'n': natural_key, 'c': category, 's': category_source} AS k FROM ledger) GROUP BY 1),
u AS (SELECT text, m.i AS id, m.n AS natural_key, m.c AS category, m.s AS category_source FROM t),
l AS (SELECT doc_id AS id, 'Supplier#' || lpad(CAST(doc_id % 50 AS VARCHAR), 9, '0') AS text, CASE WHEN quality = 1 THEN 'salary' ELSE 'other' END AS category, CASE WHEN toxic = 1 THEN 2 ELSE 1 END AS level FROM labels),
f AS (SELECT natural_key, max(file_id) AS id FROM ledger WHERE amount > 90000 GROUP BY 1),
r AS (SELECT text, category, 0 AS level, id FROM u WHERE category_source IN ('rule', 'mcc') UNION ALL SELECT text, category, level, id FROM l UNION ALL SELECT u.text, 'fees', 3, f.id FROM f JOIN u ON u.natural_key = f.natural_key)
SELECT * FROM (SELECT text, arg_max(category, {'l': level, 'i': id}) AS category FROM r WHERE text <> '' GROUP BY 1) WHERE category <> 'other'""")
register("class_filter", "documents", "SELECT doc_id, source AS category FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 45)")(lambda d: C.class_filter(d.select("doc_id", F.col("source").alias("category")), 45))
register("holdout_split", "documents", "SELECT text, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || text), text) <= round(count(*) OVER (PARTITION BY category) * 0.2) AS holdout FROM (SELECT CAST(doc_id AS VARCHAR) AS text, source AS category FROM documents)")(lambda d: C.split(d.select(F.col("doc_id").cast("string").alias("text"), F.col("source").alias("category"))))
register("trust_breakdown", "ledger", "SELECT category_source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(category_confidence), 6) AS avg_confidence FROM ledger GROUP BY 1")(C.trust)
register("labelling_queue", "ledger", "SELECT DISTINCT description FROM ledger WHERE category_source = 'default' AND description <> '' ORDER BY 1 LIMIT 1000")(C.labelling_queue)

# ---------------------------------------------------------------- periods
_WIN = f"(SELECT month, CASE WHEN r <= 6 THEN 'current' ELSE 'previous' END AS period FROM (SELECT month, row_number() OVER (ORDER BY month DESC) AS r FROM {_INCOME}) WHERE r <= 12)"
register("period_windows", "ledger", f"SELECT * FROM {_WIN}")(lambda lg: periods.windows(views.income_expense_month(lg), 6))
_KPI = f"(SELECT period, {_d('coalesce(income, 0)')} AS income, {_d('coalesce(expense, 0)')} AS expense, {_d('net')} AS net, count(*) AS n_months FROM {_INCOME} i JOIN {_WIN} w ON w.month = i.month GROUP BY 1)"
register("kpi_compare", "ledger", f"SELECT *, CASE WHEN income > 0 THEN round(CAST(net AS DOUBLE) / CAST(income AS DOUBLE) * 100, 6) ELSE 0.0 END AS savings_rate, round(CAST(expense AS DOUBLE) / n_months, 6) AS avg_expense FROM {_KPI}")(lambda lg: periods.kpis(views.income_expense_month(lg), 6))
_PICK = lambda c, p: f"max(CAST({c} AS DOUBLE)) FILTER (WHERE period = '{p}')"
_MOVED = lambda c: f"{_PICK(c, 'current')} AS {c}, " + (f"round({_PICK(c, 'current')} - {_PICK(c, 'previous')}, 1)" if c == "savings_rate" else f"CASE WHEN {_PICK(c, 'previous')} <> 0 THEN round(({_PICK(c, 'current')} - {_PICK(c, 'previous')}) / abs({_PICK(c, 'previous')}) * 100, 1) END") + f" AS {c}_change"
register("kpi_changes", "ledger", f"SELECT {', '.join(map(_MOVED, ('income', 'expense', 'net', 'savings_rate')))} FROM (SELECT *, CASE WHEN income > 0 THEN round(CAST(net AS DOUBLE) / CAST(income AS DOUBLE) * 100, 6) ELSE 0.0 END AS savings_rate FROM {_KPI})")(lambda lg: periods.kpi_changes(periods.kpis(views.income_expense_month(lg), 6)))
register("category_rank_prev", "ledger", f"SELECT * FROM (SELECT category, CAST(coalesce(sum(-total) FILTER (WHERE period = 'current'), 0) AS DECIMAL(38,2)) AS spent, CAST(coalesce(sum(-total) FILTER (WHERE period = 'previous'), 0) AS DECIMAL(38,2)) AS previous FROM {_CATMONTH} c JOIN {_WIN} w ON w.month = c.month WHERE total < 0 GROUP BY 1) WHERE spent > 0 ORDER BY spent DESC, category LIMIT 8")(
    lambda lg: periods.category_rank(views.category_month(lg), 6)
)
_CATS = ["groceries", "dining", "transport", "bills", "rent", "other"]
register("category_pivot", "ledger", f"SELECT month, {', '.join(f'CAST(coalesce(sum(-total) FILTER (WHERE category = {chr(39)}{c}{chr(39)}), 0) AS DECIMAL(38,2)) AS {c}' for c in _CATS)} FROM {_CATMONTH} WHERE total < 0 GROUP BY 1")(lambda lg: periods.category_pivot(views.category_month(lg), _CATS))
register("category_heat", "ledger", f"SELECT month, category, CAST(round(-CAST(total AS DOUBLE) / max(-CAST(total AS DOUBLE)) OVER () * 100) AS INTEGER) AS heat FROM {_CATMONTH} WHERE total < 0")(lambda lg: periods.heat(views.category_month(lg)))
register("movements_by_day", "ledger", f"SELECT value_date, count(*) AS n, {_d('amount')} AS total FROM ledger GROUP BY 1")(periods.by_day)
_YEAR = lambda y: "(" + _MERCHANTS.replace("merchant IS NOT NULL", f"merchant IS NOT NULL AND year(value_date) = {y}") + ")"
register("merchant_changes", "ledger", f"SELECT c.*, p.total_spent AS previous, CASE WHEN p.total_spent <> 0 THEN round((CAST(c.total_spent AS DOUBLE) - CAST(p.total_spent AS DOUBLE)) / abs(CAST(p.total_spent AS DOUBLE)) * 100, 1) END AS change FROM {_YEAR(1996)} c LEFT JOIN {_YEAR(1995)} p ON p.k = c.k")(lambda lg: periods.merchant_changes(query.merchants(lg, "1996-01-01", "1996-12-31", None), query.merchants(lg, "1995-01-01", "1995-12-31", None)))

# ---------------------------------------------------------------- sinks and streams


@register("export_csv", "ledger", "SELECT natural_key, value_date, CAST(amount AS DECIMAL(18,2)) AS amount, category, CASE category WHEN 'bills' THEN 'Bills & utilities' ELSE upper(left(category, 1)) || substr(category, 2) END AS category_label FROM ledger")
def _export(ledger: DataFrame) -> DataFrame:
    """Write the export and read it back."""
    path = place(ledger.sparkSession)
    query.export_csv(ledger, path)
    rows = ledger.sparkSession.read.csv(path, header=True, schema=query.export_rows(ledger).schema)
    return rows.select("natural_key", "value_date", "amount", "category", "category_label")


def _streamed(rows: DataFrame, subject: str, handle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows through a queue of JSON messages: written to its folder, consumed to the end, handled by micro-batch."""
    spark, at = rows.sparkSession, place(rows.sparkSession)
    queues.encode(rows).write.text(f"{at}/queue")
    queues.consume(queues.messages(spark, f"{at}/queue", subject), queues.appended(f"{at}/out", handle), f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


@register("stream_dedup", "events", "SELECT DISTINCT cast(user_id as varchar(20)) AS key FROM events")
def _stream_dedup(events: DataFrame) -> DataFrame:
    """Job messages, each key once over all batches."""
    out = _streamed(events.select(F.col("user_id").cast("string").alias("key"), F.lit("f").alias("filename")), "ingest.jobs", lambda b: b.where("NOT malformed").select("key").dropDuplicates(["key"]))
    return out.dropDuplicates(["key"])


@register("stream_feedback", "conversations", f"SELECT natural_key, arg_max(category, id) AS category FROM {_FEEDBACK} GROUP BY 1")
def _stream_feedback(conversations: DataFrame) -> DataFrame:
    """Corrections appended from the stream; the latest of each key counts."""
    rows = conversations.select(F.col("turn").alias("id"), F.col("conv_id").cast("string").alias("natural_key"), F.col("role").alias("category"))
    return merge.latest(_streamed(rows, "category.feedback", lambda b: b.where("NOT malformed").select("id", "natural_key", "category")), "natural_key", "category", "id")


statement_queries.register_all(register)
admin_queries.register_all(register, _CATMONTH)
SQL["ledger_fold"] = SQL["ledger_fold"].replace("WITH ", "WITH RECURSIVE ", 1)
