"""Ledger-shaped tables made from a star schema of orders, as SQL text that more than one engine runs unchanged.

Names in braces are source tables; the texts build on each other.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TEXTS = {
    "ledger": """
SELECT concat(cast(l_orderkey as varchar(20)),'-',cast(l_linenumber as varchar(20)),'-',cast(l_partkey as varchar(20)),'-',cast(l_suppkey as varchar(20))) AS natural_key,
       concat('acct_', cast(o_custkey % 20 as varchar(20))) AS account,
       CASE o_custkey % 3 WHEN 0 THEN 'bank_a' WHEN 1 THEN 'bank_b' ELSE 'bank_c' END AS source,
       cast(o_orderdate as date) AS value_date,
       CASE WHEN l_linestatus='O' THEN cast(l_shipdate as date) ELSE cast(o_orderdate as date) END AS booking_date,
       cast(CASE WHEN l_returnflag='R' THEN l_extendedprice ELSE -l_extendedprice END as decimal(18,2)) AS amount,
       'EUR' AS currency, concat(p_name,' ',s_name) AS description,
       CASE WHEN l_linenumber = 3 THEN upper(s_name) ELSE s_name END AS merchant,
       CASE p_size % 8 WHEN 0 THEN 'groceries' WHEN 1 THEN 'dining' WHEN 2 THEN 'transport' WHEN 3 THEN 'bills' WHEN 4 THEN 'investments' WHEN 5 THEN 'crypto' WHEN 6 THEN 'rent' ELSE 'other' END AS category,
       CASE l_linenumber % 5 WHEN 0 THEN 'mcc' WHEN 1 THEN 'model' WHEN 2 THEN 'rule' WHEN 3 THEN 'default' ELSE 'manual' END AS category_source,
       CASE l_linenumber % 5 WHEN 0 THEN 1.0e0 WHEN 1 THEN l_quantity / 64 WHEN 2 THEN 0.9e0 WHEN 3 THEN NULL ELSE 1.0e0 END AS category_confidence,
       cast(5000 + p_size * 37 as varchar(20)) AS mcc, p_type AS native_category, l_orderkey AS file_id,
       CASE WHEN o_orderkey % 40 = 0 AND l_linenumber <= 2 THEN concat('t', cast(o_orderkey as varchar(20))) END AS transfer_group
FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey JOIN {part} ON l_partkey=p_partkey JOIN {supplier} ON l_suppkey=s_suppkey""",
    "balances": """
SELECT account, mx AS balance_date, cast(cum + CASE WHEN qn % 17 = 0 THEN 1.00 ELSE 0.00 END AS decimal(38,2)) AS balance, 'EUR' AS currency, 'bank_a' AS source,
       CASE WHEN account IN ('acct_3','acct_7') THEN 'booking' ELSE 'value' END AS basis
FROM (SELECT account, mx, sum(q) OVER (PARTITION BY account ORDER BY mx) AS cum, row_number() OVER (PARTITION BY account ORDER BY mx) AS qn
      FROM (SELECT account, max(value_date) AS mx, sum(amount) AS q FROM ({ledger}) x GROUP BY account, year(value_date), quarter(value_date)) a) b""",
    "trades": """
SELECT concat(cast(l_orderkey as varchar(20)),'-',cast(l_linenumber as varchar(20)),'-',cast(l_partkey as varchar(20)),'-',cast(l_suppkey as varchar(20))) AS natural_key,
       CASE WHEN l_returnflag='R' THEN 'sell' ELSE 'buy' END AS side, CASE WHEN p_size = 50 THEN NULL ELSE p_type END AS isin, p_name AS instrument, p_brand AS asset_class,
       cast(CASE WHEN l_returnflag='R' THEN -l_quantity ELSE l_quantity END as decimal(18,4)) AS quantity,
       CASE WHEN l_linenumber = 2 THEN NULL ELSE cast(p_retailprice as decimal(18,2)) END AS unit_price
FROM {lineitem} JOIN {part} ON l_partkey=p_partkey WHERE l_linenumber <= 2""",
    "accounts": """
SELECT concat('acct_', cast(c_custkey as varchar(20))) AS account_id, concat('source_', cast(c_nationkey as varchar(20))) AS source,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE n_name END AS bank_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS product,
       CASE c_custkey % 3 WHEN 0 THEN 'joint' WHEN 1 THEN 'individual' END AS holding_modality, 'EUR' AS currency, cast(NULL as varchar(40)) AS iban,
       CASE WHEN c_custkey % 11 = 0 THEN 'My own' END AS display_name_override
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "legs": """
SELECT concat('o', cast(o_orderkey as varchar(20))) AS natural_key, concat('acct_', cast(o_custkey % 20 as varchar(20))) AS account, cast(o_orderdate as date) AS value_date,
       cast(-floor(o_totalprice / 1000) * 1000 - 1 as decimal(18,2)) AS amount,
       CASE o_orderkey % 3 WHEN 0 THEN 'Bonifico disposto' WHEN 1 THEN 'Giroconto' ELSE 'Card payment' END AS description FROM {orders}
UNION ALL
SELECT concat('i', cast(o_orderkey as varchar(20))), concat('acct_', cast((o_custkey + 7) % 20 as varchar(20))), cast(o_orderdate as date) + cast(o_orderkey % 7 as int),
       cast(floor(o_totalprice / 1000) * 1000 + 1 as decimal(18,2)), CASE WHEN o_orderkey % 4 = 0 THEN 'TOP-UP' ELSE 'Accredito' END FROM {orders} WHERE o_orderkey % 5 = 0""",
    "series": """
SELECT concat('s', cast(c_custkey as varchar(20)), '-', cast(n_nationkey as varchar(20))) AS natural_key,
       date '2022-01-01' + cast(n_nationkey * (CASE c_custkey % 6 WHEN 0 THEN 7 WHEN 1 THEN 30 WHEN 2 THEN 61 WHEN 3 THEN 91 WHEN 4 THEN 182 ELSE 365 END) + (n_nationkey * c_custkey) % 4 as int) AS value_date,
       cast(CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE -1 END * (10 + c_custkey % 90 + (n_nationkey % 3) * (c_custkey % 5)) as decimal(18,2)) AS amount,
       concat(CASE WHEN n_nationkey < 12 THEN 'Shop ' ELSE 'SHOP S.P.A. ' END, translate(c_name, '0123456789', 'abcdefghij'), ' ', cast(n_nationkey as varchar(20))) AS description,
       concat('acct_', cast(c_custkey % 20 as varchar(20))) AS account,
       CASE c_custkey % 4 WHEN 0 THEN 'subscriptions' WHEN 1 THEN 'salary' WHEN 2 THEN 'investments' ELSE 'rent' END AS category, cast(NULL as varchar(20)) AS transfer_group
FROM {customer} CROSS JOIN {nation}""",
    "files": """
SELECT page_id AS id, url AS filename, CASE page_id % 3 WHEN 0 THEN 'bank_a' WHEN 1 THEN 'bank_b' ELSE 'bank_c' END AS source, CASE page_id % 10 WHEN 0 THEN 'failed' ELSE 'parsed' END AS status,
       cast(length(html) % 100 as bigint) AS rows_total, cast(floor((length(html) % 100) / 2.0) as bigint) AS rows_new,
       CASE page_id % 4 WHEN 0 THEN 'Mario Rossi' WHEN 1 THEN 'ROSSI MARIO' WHEN 2 THEN 'Anna Bianchi' END AS holder,
       TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' HOUR AS uploaded_at
FROM {pages}""",
    "vectors": "SELECT vec_id, embedding AS vector, label FROM {embeddings}",
}


def text(name: str, tables: dict[str, str] | None = None) -> str:
    """A text with the names in braces replaced: source tables by themselves or as given, others by their own text."""
    return re.sub(r"\{(\w+)\}", lambda m: text(m[1], tables) if m[1] in TEXTS else (tables or {}).get(m[1], m[1]), TEXTS[name])


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A ledger-shaped table over the Parquet tables of a folder."""
    body = text(name)
    used = sorted(set(re.findall(r"(?:FROM|JOIN) (\w+)", body)))
    named = text(name, {t: f"{{{t}}}" for t in used})
    return spark.sql(named, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
