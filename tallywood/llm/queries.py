"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster_vectors
from .chat_format import preference_pairs
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .fill_in_middle import fill_in_middle, restored
from .html_extract import extract_text
from .mixing import mix_sources
from .near_dedup import near_dedup
from .quality import score_documents, train
from .sharding import shard_documents
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, _table(spark, sf_dir, "labels")))


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as text, start-stop by start-stop."""
    pairs = preference_pairs(_table(spark, sf_dir, "conversations"))
    said = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws("-", m["start"].cast("string"), m["stop"].cast("string"))), ",")
    return pairs.withColumns({c: said(c) for c in ("chosen_mask", "rejected_mask")})


def op3_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), with_bytes=False)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_preference_pairs": op2_preference_pairs,
    "op3_extract_text": op3_extract_text,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_shard": op10_shard,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_centroids": op12_centroids,
    "op13_warc": op13_warc,
}

_W = r"[^\x20\x09-\x0D]+"

def _centroid_sql(rounds: int = 10) -> str:
    """The rounds of op12 one after the other, each with the centroids of the one before."""
    near = "SELECT vec_id, v, arg_min(c, {{'d': list_sum(list_transform(list_zip(v, x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c}}) AS c, CAST(min(list_sum(list_transform(list_zip(v, x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS BIGINT) AS d FROM k, {0} GROUP BY vec_id, v"
    parts = ["""k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS x FROM k ORDER BY sha256('3:' || vec_id) LIMIT 8)"]
    for n in range(rounds):
        parts += [f"a{n} AS MATERIALIZED ({near.format(f'c{n}')})",
                  f"s{n} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS x FROM (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT c, i, sum(CAST(e AS HUGEINT)) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS e, unnest(range(64)) AS i FROM a{n}) GROUP BY c, i)) GROUP BY c)",
                  f"c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(s.x, o.x) AS x FROM c{n} o LEFT JOIN s{n} s ON s.c = o.c)"]
    return f"""WITH {", ".join(parts)}, z AS ({near.format(f"c{rounds}")})
SELECT vec_id, CAST(z.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM z JOIN c{rounds} f ON f.c = z.c"""


SQL = {
    "op2_preference_pairs": """
WITH t AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS good, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS said FROM t),
p AS (SELECT a.pair_id, a.k FROM n a JOIN n b ON a.pair_id = b.pair_id AND a.k = b.k AND a.good AND NOT b.good AND a.role = b.role AND a.text = b.text),
c AS (SELECT pair_id, count(*) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY k) AS r FROM p) WHERE r = k GROUP BY pair_id),
f AS (SELECT n.*, coalesce(shared, 0) AS shared FROM n LEFT JOIN c ON c.pair_id = n.pair_id),
g AS (SELECT *, coalesce(sum(length(said)) FILTER (WHERE k > shared) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length('<|im_start|>') + length(role) + 1 AS b FROM f),
m AS (SELECT *, CAST(CAST(b AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(b + length(text) AS BIGINT) AS VARCHAR) AS span, k > shared AS own FROM g)
SELECT pair_id, max(conv_id) FILTER (WHERE good) AS chosen_id, max(conv_id) FILTER (WHERE NOT good) AS rejected_id, CAST(max(shared) AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(said, '' ORDER BY k) FILTER (WHERE good AND NOT own), '') AS prompt,
       coalesce(string_agg(said, '' ORDER BY k) FILTER (WHERE good AND own), '') AS chosen, coalesce(string_agg(said, '' ORDER BY k) FILTER (WHERE NOT good AND own), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY k) FILTER (WHERE good AND own AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(span, ',' ORDER BY k) FILTER (WHERE NOT good AND own AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY pair_id""",
    "op4_substring_dedup": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_W}'), []) AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM v) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM m),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT p.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY p.p) AS kept
      FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op5_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_W}')), 0) AS BIGINT) AS size,
                  md5('17|' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS dr FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS t FROM s),
l AS (SELECT *, (t - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev FROM r
      WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT max(lev) AS lev FROM (SELECT l.lev, any_value(l.t) AS t, sum(least(r.cap, l.lev * r.w)) AS spent FROM l, r GROUP BY l.lev) WHERE abs(spent - t) <= 1e-6 * t),
g AS (SELECT source, source_size, least(cap, w * (SELECT lev FROM v)) AS target FROM l),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS k FROM g),
c AS (SELECT d.doc_id, d.size, h.source_size, h.target, h.k, CAST(round(h.target) AS BIGINT) - h.k * h.source_size AS more,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY dr, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, d.source
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, CAST(k * size + greatest(0, least(size, more - before)) AS BIGINT) AS taken, source FROM c""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op9_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
u AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, least(a, b) AS p, greatest(a, b) AS q, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, q - p) AS middle, substr(t, q + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM x""",
    "op12_centroids": _centroid_sql(),
    "op13_warc": """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY html) AS last, octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY html) AS again FROM pages)""",
}
