"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import contamination, packing, pii, secrets, topn
from heddle.session import table

TOP = 5
#: Prefixes of tokens that the platforms of the given data issue, and no public one does.
HOUSE_PREFIXES = ("qm-pat-", "tgk_live_", "tgk_test_", "hv.")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, sf, "server_scores"), "server_id", "score", ["computed_at", "id"], "id",
        TOP).select("server_id", "id")


def p1_top_scores(spark: SparkSession, sf: str) -> DataFrame:
    top = topn.top_n_per_group(table(spark, sf, "server_scores"), "server_id", "score", ["computed_at", "id"], "id", TOP)
    return top.select("server_id", "id", "score", F.unix_micros("computed_at").alias("computed_us"), "rank")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.cases(secrets.scan_configs(table(spark, sf, "server_configs"), prefixes=HOUSE_PREFIXES))


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan_configs(table(spark, sf, "server_configs"), prefixes=HOUSE_PREFIXES).select("config_id", "env", "command", "raw",
        "found")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_containers(table(spark, sf, "documents"), table(spark, sf, "context_windows"))


def p7_summary(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_summary(p7_containers(spark, sf), table(spark, sf, "context_windows"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    docs, items, names = (table(spark, sf, t) for t in ("documents", "eval_items", "given_names"))
    return contamination.leaked_items(contamination.template_matches(docs, items, names))


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    docs, items, names = (table(spark, sf, t) for t in ("documents", "eval_items", "given_names"))
    return contamination.reparameterised(docs, items, names)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.cases(pii.scan_texts(table(spark, sf, "documents"), table(spark, sf, "given_names")))


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.scan_texts(table(spark, sf, "documents"), table(spark, sf, "given_names")).select("doc_id", "redacted")


QUERIES = {
    "p1_found": p1_found,
    "p1_top_scores": p1_top_scores,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p7_containers": p7_containers,
    "p7_summary": p7_summary,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

ORACLE_SQL = {
    "p1_found": """
SELECT server_id, id FROM (
  SELECT server_id, id, row_number() OVER (PARTITION BY server_id ORDER BY score DESC, computed_at DESC, id DESC) AS r
  FROM (SELECT DISTINCT server_id, id, computed_at, score FROM server_scores WHERE score IS NOT NULL)
) WHERE r <= 5""",
    "p1_top_scores": """
SELECT server_id, id, score, epoch_us(computed_at) AS computed_us, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY score DESC, computed_at DESC, id DESC) AS r
  FROM (SELECT DISTINCT server_id, id, computed_at, score FROM server_scores WHERE score IS NOT NULL)
) WHERE r <= 5""",
    "p8_found": """
WITH dw AS (SELECT doc_id, array_to_string(ws[i:i + 12], ' ') AS k FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL))),
 iw AS (SELECT item_id, array_to_string(ws[i:i + 12], ' ') AS k FROM (
  SELECT item_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL)))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (k)""",
    "p8_leaks": r"""
WITH slot AS (SELECT lower(given_name) AS n FROM given_names WHERE given_name IS NOT NULL GROUP BY 1),
 texts AS (SELECT 'd' AS side, doc_id AS key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL
   UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items WHERE text IS NOT NULL),
 vocabulary AS (SELECT w, CASE WHEN regexp_full_match(w, '\p{N}+') THEN '<num>' WHEN list_contains(%UNITS%, w) THEN '<unit>' WHEN n IS NOT NULL THEN '<name>' ELSE w END AS t
   FROM (SELECT DISTINCT unnest(ws) AS w FROM texts) LEFT JOIN slot ON n = w),
 placed AS (SELECT side, key, i, ws[i] AS w FROM (SELECT side, key, ws, unnest(range(1, len(ws) + 1)) AS i FROM texts)),
 canon AS (SELECT side, key, list(w ORDER BY i) AS ws, list(t ORDER BY i) AS ts FROM placed JOIN vocabulary USING (w) GROUP BY side, key),
 wins AS (SELECT side, key, p, ws[p:p + 12] AS x, array_to_string(ts[p:p + 12], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS p FROM canon)),
 pairs AS (SELECT d.key AS doc_id, i.key AS item_id, d.x = i.x AS same, len(list_distinct(list_transform(list_zip(i.x, d.x), lambda z: z[1] || ' ' || z[2]))) AS n, len(list_distinct(i.x)) AS a, len(list_distinct(d.x)) AS b
   FROM wins d JOIN wins i ON d.k = i.k AND d.side = 'd' AND i.side = 'i')
SELECT doc_id, item_id, count(*) AS windows, count(*) FILTER (same) AS verbatim_windows, CASE WHEN bool_or(same) THEN 'verbatim' ELSE 'reparameterised' END AS kind
FROM pairs WHERE n = a AND n = b GROUP BY 1, 2""".replace("%UNITS%", str(list(contamination.UNITS))),
}
