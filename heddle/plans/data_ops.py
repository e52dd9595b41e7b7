"""Queries of the general data-processing operators (problems 2, 4, 5 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import drift, history, nested, snapshot_diff
from heddle.session import table

def _record_key():
    """The member that identifies a record in the two kinds of feeds."""
    return F.when(F.col("feed").endswith("/packages"), "identifier").otherwise("name")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf, "export_lines"), _record_key()).select(
        "feed", "file_id", "change_kind", "field_before", "field_after"
    )


def p2_schema_log(spark: SparkSession, sf: str) -> DataFrame:
    log = drift.schema_changes(table(spark, sf, "export_lines"), _record_key())
    return log.withColumn("exported_at", F.unix_micros("exported_at")).withColumnRenamed("exported_at", "exported_us")


def _one_table(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """A kind's lines as one table; a field that mirrors call by several names is one column."""
    lines = table(spark, sf, "export_lines").where(F.col("feed").endswith("/" + kind))
    out = drift.unified_table(lines, drift.rename_map(lines, _record_key()))
    return out.withColumn("exported_at", F.unix_micros("exported_at")).withColumnRenamed("exported_at", "exported_us")


def p2_packages_table(spark: SparkSession, sf: str) -> DataFrame:
    return _one_table(spark, sf, "packages")


def p2_index_table(spark: SparkSession, sf: str) -> DataFrame:
    return _one_table(spark, sf, "index")


def _score_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.version_history(table(spark, sf, "server_scores"), "server_id", "computed_at", F.col("score"), "id").drop("order_key")


def _hash_history(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.nullif(F.lower("sha256"), F.lit(""))
    return history.version_history(table(spark, sf, "hashes"), "version_id", "observed_at", digest, "id").drop("order_key")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    cols = ("entity_id", "valid_from_us")
    score = _score_history(spark, sf).select(F.lit("score").alias("entity"), *cols)
    return score.unionByName(_hash_history(spark, sf).select(F.lit("hash").alias("entity"), *cols))


def p4_score_history(spark: SparkSession, sf: str) -> DataFrame:
    return _score_history(spark, sf)


def p4_hash_history(spark: SparkSession, sf: str) -> DataFrame:
    return _hash_history(spark, sf)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    snaps = table(spark, sf, "server_snapshots")
    state = [F.unix_micros("delisted_at"), snapshot_diff.canonical_json(F.col("raw_json"))]
    return snapshot_diff.snapshot_changes(snapshot_diff.row_digests(snaps, "snapshot_no", "name", "row_no", state))


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    entries = nested.flatten(table(spark, sf, "registry_entries"), "registry_entries", "entry_id", "raw_json")
    return entries.unionByName(nested.flatten(table(spark, sf, "versions"), "versions", "id", "environment_variables"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).select("origin", "record_id", "relation", "parent_pos", "item_key").distinct()


def _whole(spark: SparkSession, sf: str, relation: str) -> DataFrame:
    """The relation's rows of entries and versions; what a version has besides its environment
    is in its raw_json, which is one package or one remote."""
    if relation in ("env", "choices"):
        return _flat(spark, sf)
    entries = nested.flatten(table(spark, sf, "registry_entries"), "registry_entries", "entry_id", "raw_json")
    remote = F.col("registry_type").eqNullSafe("remote")
    of_remotes = relation in ("remotes", "headers")
    versions = table(spark, sf, "versions").where(remote if of_remotes else ~remote)
    return entries.unionByName(nested.flatten(versions, "versions", "id", "raw_json", "remote" if of_remotes else "package"))


def _p6(relation: str):
    return lambda spark, sf: nested.relation_table(_whole(spark, sf, relation), relation)


QUERIES = {
    "p2_found": p2_found,
    "p2_schema_log": p2_schema_log,
    "p2_packages_table": p2_packages_table,
    "p2_index_table": p2_index_table,
    "p4_found": p4_found,
    "p4_score_history": p4_score_history,
    "p4_hash_history": p4_hash_history,
    "p5_found": p5_found,
    "p6_found": p6_found,
    **{f"p6_{r}": _p6(r) for r in ("packages", "remotes", "runtime_args", "package_args", "env", "choices", "headers")},
}

_PERIODS = """SELECT entity_id, valid_from_us, lead(valid_from_us) OVER (PARTITION BY entity_id ORDER BY valid_from_us) AS valid_to_us, value FROM (
  SELECT *, lag(value) OVER w AS before, row_number() OVER w AS r FROM (
    SELECT {e} AS entity_id, epoch_us({t}) AS valid_from_us, arg_max({v}, id) AS value FROM {table} WHERE {where} GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY entity_id ORDER BY valid_from_us)) WHERE r = 1 OR value <> before"""
_SCORES = _PERIODS.format(e="server_id", t="computed_at", v="score", table="server_scores", where="score IS NOT NULL")
_HASHES = _PERIODS.format(e="version_id", t="observed_at", v="lower(sha256)", table="hashes", where="sha256 <> ''")
_P6_WITH = """WITH decoded AS (
  SELECT entry_id AS id, CASE WHEN json_type(raw_json) = 'VARCHAR' THEN raw_json ->> '$' ELSE raw_json END AS d FROM registry_entries WHERE json_valid(raw_json)),
 ok AS (SELECT id, d FROM decoded WHERE json_valid(d)),
 lists AS (SELECT id, 'packages' AS relation, json_extract(d, '$.server.packages') AS l FROM ok UNION ALL SELECT id, 'remotes', json_extract(d, '$.server.remotes') FROM ok),
 tops AS (SELECT id, relation, i, json_extract(l, '$[' || i || ']') AS x FROM (SELECT id, relation, l, unnest(range(json_array_length(l)::BIGINT)) AS i FROM lists WHERE json_type(l) = 'ARRAY')),
 top AS (SELECT * FROM tops WHERE json_type(x) <> 'NULL'),
 arg_lists AS (SELECT id, i, 'runtime_args' AS relation, json_extract(x, '$.runtimeArguments') AS l FROM top WHERE relation = 'packages' UNION ALL SELECT id, i, 'package_args', json_extract(x, '$.packageArguments') FROM top WHERE relation = 'packages'),
 args AS (SELECT id, i, relation, j, json_extract(l, '$[' || j || ']') AS a FROM (SELECT *, unnest(range(json_array_length(l)::BIGINT)) AS j FROM arg_lists WHERE json_type(l) = 'ARRAY')),
 decoded_v AS (SELECT id, CASE WHEN json_type(environment_variables) = 'VARCHAR' THEN environment_variables ->> '$' ELSE environment_variables END AS d FROM versions WHERE json_valid(environment_variables)),
 named AS (SELECT 'registry_entries' AS origin, 'env' AS relation, id, i AS pos, json_extract(x, '$.environmentVariables') AS l FROM top WHERE relation = 'packages'
   UNION ALL SELECT 'registry_entries', 'headers', id, i, json_extract(x, '$.headers') FROM top WHERE relation = 'remotes'
   UNION ALL SELECT 'versions', 'env', id, -1, json_extract(d, '$') FROM decoded_v WHERE json_valid(d)),
 maps AS (SELECT origin, relation, id, pos, unnest(json_keys(l)) AS k FROM named WHERE json_type(l) = 'OBJECT'),
 items AS (SELECT origin, relation, id, pos, json_extract(l, '$[' || j || ']') AS o FROM (SELECT *, unnest(range(json_array_length(l)::BIGINT)) AS j FROM named WHERE json_type(l) = 'ARRAY')),
 objs AS (SELECT *, o ->> '$.name' AS n, json_extract(o, '$.choices') AS c FROM items WHERE json_type(o) = 'OBJECT' AND json_type(o, '$.name') = 'VARCHAR' AND o ->> '$.name' <> ''),
 picks AS (SELECT origin, id, pos, n, q, json_extract(c, '$[' || q || ']') AS z FROM (SELECT *, unnest(range(json_array_length(c)::BIGINT)) AS q FROM objs WHERE relation = 'env' AND json_type(c) = 'ARRAY'))"""
_P6 = _P6_WITH + """
SELECT DISTINCT origin, record_id, relation, CAST(parent_pos AS BIGINT) AS parent_pos, item_key FROM (
 SELECT 'registry_entries' AS origin, id AS record_id, relation, -1 AS parent_pos, CAST(i AS VARCHAR) AS item_key FROM top
 UNION ALL SELECT 'registry_entries', id, relation, i, CAST(j AS VARCHAR) FROM args WHERE json_type(a) = 'VARCHAR' OR (json_type(a) = 'OBJECT' AND (coalesce(a ->> '$.name', '') <> '' OR a ->> '$.value' IS NOT NULL))
 UNION ALL SELECT origin, id, relation, pos, k FROM maps
 UNION ALL SELECT origin, id, relation, pos, n FROM objs
 UNION ALL SELECT origin, id, 'choices', pos, n || '/' || q FROM picks WHERE json_type(z) <> 'NULL')"""


# The relations' tables also hold what a version's own raw_json is: one package or one remote, in no list.
_P6_WHOLE = """WITH decoded AS (
  SELECT 'registry_entries' AS origin, entry_id AS id, NULL AS alone, CASE WHEN json_type(raw_json) = 'VARCHAR' THEN raw_json ->> '$' ELSE raw_json END AS d FROM registry_entries WHERE json_valid(raw_json)
  UNION ALL SELECT 'versions', id, CASE WHEN registry_type = 'remote' THEN 'remotes' ELSE 'packages' END, CASE WHEN json_type(raw_json) = 'VARCHAR' THEN raw_json ->> '$' ELSE raw_json END FROM versions WHERE json_valid(raw_json)),
 ok AS (SELECT * FROM decoded WHERE json_valid(d)),
 lists AS (SELECT origin, id, 'packages' AS relation, json_extract(d, '$.server.packages') AS l FROM ok WHERE alone IS NULL UNION ALL SELECT origin, id, 'remotes', json_extract(d, '$.server.remotes') FROM ok WHERE alone IS NULL),
 tops AS (SELECT origin, id, relation, i, json_extract(l, '$[' || i || ']') AS x FROM (SELECT origin, id, relation, l, unnest(range(json_array_length(l)::BIGINT)) AS i FROM lists WHERE json_type(l) = 'ARRAY')
   UNION ALL SELECT origin, id, alone, -1, json_extract(d, '$') FROM ok WHERE alone IS NOT NULL AND json_type(d) = 'OBJECT'),
 top AS (SELECT * FROM tops WHERE json_type(x) <> 'NULL'),
 arg_lists AS (SELECT origin, id, i, 'runtime_args' AS relation, json_extract(x, '$.runtimeArguments') AS l FROM top WHERE relation = 'packages' UNION ALL SELECT origin, id, i, 'package_args', json_extract(x, '$.packageArguments') FROM top WHERE relation = 'packages'),
 args AS (SELECT origin, id, i, relation, j, json_extract(l, '$[' || j || ']') AS a FROM (SELECT *, unnest(range(json_array_length(l)::BIGINT)) AS j FROM arg_lists WHERE json_type(l) = 'ARRAY')),
 named AS (SELECT origin, 'headers' AS relation, id, i AS pos, json_extract(x, '$.headers') AS l FROM top WHERE relation = 'remotes'),
 maps AS (SELECT origin, relation, id, pos, unnest(json_keys(l)) AS k FROM named WHERE json_type(l) = 'OBJECT'),
 items AS (SELECT origin, relation, id, pos, json_extract(l, '$[' || j || ']') AS o FROM (SELECT *, unnest(range(json_array_length(l)::BIGINT)) AS j FROM named WHERE json_type(l) = 'ARRAY')),
 objs AS (SELECT *, o ->> '$.name' AS n FROM items WHERE json_type(o) = 'OBJECT' AND json_type(o, '$.name') = 'VARCHAR' AND o ->> '$.name' <> '')"""


def _p6_sql(source: str, where: str, origin: str, pos: str, key: str, x: str, members: tuple[str, ...], ctes: str = _P6_WHOLE) -> str:
    """One relation as a flat table; a value that is no object stands in scalar."""
    cols = ", ".join(f"CASE WHEN json_type({x}) = 'OBJECT' THEN {x} ->> '$.{m}' END AS \"{m + '_' if m == 'value' else m}\"" for m in members)
    return f"{ctes} SELECT {origin} AS origin, id AS record_id, CAST({pos} AS BIGINT) AS parent_pos, {key} AS item_key, {cols}, CASE WHEN json_type({x}) <> 'OBJECT' THEN {x} ->> '$' END AS scalar FROM {source} WHERE {where}"


_TEXT_I, _TEXT_J = "CAST(i AS VARCHAR)", "CAST(j AS VARCHAR)"
_ARG = "relation = '{r}' AND (json_type(a) = 'VARCHAR' OR (json_type(a) = 'OBJECT' AND (coalesce(a ->> '$.name', '') <> '' OR a ->> '$.value' IS NOT NULL)))"
_MAPPED = "(SELECT m.origin, m.relation, m.id, m.pos, m.k AS n, json_extract(d.l, '$.\"' || m.k || '\"') AS o FROM maps m JOIN named d ON d.origin = m.origin AND d.relation = m.relation AND d.id = m.id AND d.pos = m.pos UNION ALL SELECT origin, relation, id, pos, n, o FROM objs)"

_P2 = """WITH objs AS (SELECT feed, file_id, exported_at, line_no, payload AS p, payload ->> CASE WHEN feed LIKE '%/packages' THEN '$.identifier' ELSE '$.name' END AS rec FROM export_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
 mem AS (SELECT o.feed, o.file_id, o.line_no, o.rec, e.key AS field, CASE e.type WHEN 'VARCHAR' THEN 8 WHEN 'BOOLEAN' THEN 1 WHEN 'DOUBLE' THEN 4 WHEN 'ARRAY' THEN 16 WHEN 'OBJECT' THEN 32 WHEN 'NULL' THEN 0 ELSE 2 END AS bit, e.value AS value FROM objs o, json_each(o.p) e),
 fields AS (SELECT feed, file_id, field, bit_or(bit) AS bits FROM mem GROUP BY 1, 2, 3),
 files AS (SELECT feed, file_id, lag(file_id) OVER (PARTITION BY feed ORDER BY at_, file_id) AS prev FROM (SELECT feed, file_id, max(exported_at) AS at_ FROM export_lines GROUP BY 1, 2)),
 steps AS (SELECT * FROM files WHERE prev IS NOT NULL),
 a AS (SELECT s.feed, s.file_id, f.field, f.bits FROM steps s JOIN fields f ON f.feed = s.feed AND f.file_id = s.prev),
 b AS (SELECT s.feed, s.file_id, f.field, f.bits FROM steps s JOIN fields f ON f.feed = s.feed AND f.file_id = s.file_id),
 gone AS (SELECT feed, file_id, field FROM a ANTI JOIN b USING (feed, file_id, field)), came AS (SELECT feed, file_id, field FROM b ANTI JOIN a USING (feed, file_id, field)),
 vals AS (SELECT m.feed, m.file_id, m.rec, m.field, arg_max(m.bit || ' ' || (SELECT string_agg(t.fullkey || coalesce(CAST(t.atom AS VARCHAR), t.type), chr(10) ORDER BY t.fullkey) FROM json_tree(m.value) t), m.line_no) AS v
   FROM mem m WHERE m.bit > 0 AND m.rec IS NOT NULL GROUP BY 1, 2, 3, 4),
 fits AS (SELECT g.feed, g.file_id, g.field AS x, c.field AS y FROM gone g JOIN steps s USING (feed, file_id) JOIN came c USING (feed, file_id)
   JOIN vals va ON va.feed = g.feed AND va.file_id = s.prev AND va.field = g.field JOIN vals vb ON vb.feed = g.feed AND vb.file_id = s.file_id AND vb.field = c.field AND vb.rec = va.rec
   GROUP BY 1, 2, 3, 4 HAVING bool_and(va.v = vb.v)),
 ren AS (SELECT * FROM fits)
SELECT feed, file_id, 'renamed' AS change_kind, x AS field_before, y AS field_after FROM ren
UNION ALL SELECT feed, file_id, 'removed', field, '' FROM gone g WHERE NOT EXISTS (FROM ren r WHERE r.feed = g.feed AND r.file_id = g.file_id AND r.x = g.field)
UNION ALL SELECT feed, file_id, 'added', '', field FROM came c WHERE NOT EXISTS (FROM ren r WHERE r.feed = c.feed AND r.file_id = c.file_id AND r.y = c.field)
UNION ALL SELECT feed, file_id, 'retyped', field, field FROM a JOIN b USING (feed, file_id, field) WHERE a.bits <> b.bits"""
_TYPES = "array_to_string(list_filter([{}], lambda t: t IS NOT NULL), '|')".format(", ".join(f"CASE WHEN ({{b}} & {1 << i}) <> 0 THEN '{t}' END" for i, t in enumerate(("boolean", "integer", "decimal", "string", "array", "object"))))
_P2_LOG = f"""SELECT c.feed, epoch_us(t.at_) AS exported_us, c.file_id, change_kind, field_before, field_after, coalesce({_TYPES.format(b="f.bits")}, '') AS type_before, coalesce({_TYPES.format(b="g.bits")}, '') AS type_after
FROM ({_P2}) c JOIN (SELECT feed, file_id, max(exported_at) AS at_ FROM export_lines GROUP BY 1, 2) t USING (feed, file_id)
LEFT JOIN (WITH {{fields}} SELECT feed, file_id, field, bits FROM fields) g ON g.feed = c.feed AND g.file_id = c.file_id AND g.field = c.field_after
LEFT JOIN (WITH {{fields}} SELECT s.feed, s.file_id, f.field, f.bits FROM (SELECT feed, file_id, lag(file_id) OVER (PARTITION BY feed ORDER BY at_, file_id) AS prev FROM (SELECT feed, file_id, max(exported_at) AS at_ FROM export_lines GROUP BY 1, 2)) s
  JOIN fields f ON f.feed = s.feed AND f.file_id = s.prev) f ON f.feed = c.feed AND f.file_id = c.file_id AND f.field = c.field_before""".replace("{fields}", _P2[len("WITH ") : _P2.index(",\n files AS")])
# The columns the two tables have at the scale the SQL is run at, with the names that mirrors give a field.
_COLUMNS = {
    "packages": {
        "deprecated": ("deprecated",), "downloads": ("downloads", "download_count"), "environmentVariables": ("environmentVariables",),
        "fileSha256": ("fileSha256",), "identifier": ("identifier",), "license": ("license",),
        "publishedAt": ("publishedAt", "published_at", "released"), "registryType": ("registryType",),
        "runtimeArguments": ("runtimeArguments", "runtime_arguments"), "signer": ("signer",), "sizeBytes": ("sizeBytes",),
        "transport": ("transport", "channel"), "version": ("version", "packageVersion"),
    },
    "index": {
        "badge": ("badge",), "contact": ("contact",), "finding_count": ("finding_count", "findings"),
        "last_scanned_at": ("last_scanned_at", "lastScan", "scanned_at"), "name": ("name",), "score": ("score", "points", "risk_score"),
        "slug": ("slug",),
    },
}


def _p2_table(kind: str) -> str:
    """Objects' members in name order and no spacing, as values of one type are compared."""
    flat = "(SELECT '{' || string_agg(to_json(k.key) || ':' || k.value, ',' ORDER BY k.key) || '}' FROM json_each(%s) k)"
    text = f"CASE e.type WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN {flat % 'e.value'} WHEN 'ARRAY' THEN '[' || coalesce((SELECT string_agg(CASE a.type WHEN 'OBJECT' THEN {flat % 'a.value'} ELSE CAST(a.value AS VARCHAR) END, ',' ORDER BY TRY_CAST(a.key AS BIGINT)) FROM json_each(e.value) a), '') || ']' ELSE e.value ->> '$' END"
    one = lambda source: f"max(v) FILTER (key = '{source}')"
    cols = ", ".join(
        ("CAST({} AS BOOLEAN)" if name == "deprecated" else "{}").format("coalesce(" + ", ".join(map(one,
        sources)) + ")") + f' AS "{name}"' for name, sources in _COLUMNS[kind].items()
    )
    return f"""WITH o AS (SELECT row_number() OVER () AS r, feed, file_id, epoch_us(exported_at) AS exported_us, line_no, payload AS p FROM export_lines WHERE feed LIKE '%/{kind}' AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
 cells AS (SELECT o.r, e.key, {text} AS v FROM o, json_each(o.p) e), wide AS (SELECT r, {cols} FROM cells GROUP BY r)
SELECT feed, file_id, exported_us, line_no, wide.* EXCLUDE (r) FROM o LEFT JOIN wide USING (r)"""


_P5 = """WITH held AS (SELECT snapshot_no AS s, name, row_no, delisted_at, raw_json FROM server_snapshots QUALIFY row_number() OVER (PARTITION BY snapshot_no, name ORDER BY row_no DESC) = 1),
 leaves AS (SELECT h.s, h.name, string_agg(t.fullkey || ' ' || t.type || ' ' || coalesce(CAST(t.atom AS VARCHAR), ''), chr(10) ORDER BY t.fullkey) AS v FROM held h, json_tree(h.raw_json) t WHERE json_valid(h.raw_json) GROUP BY 1, 2),
 state AS (SELECT h.s, h.name, h.delisted_at, CASE WHEN h.raw_json IS NULL THEN NULL ELSE coalesce(l.v, 'text ' || h.raw_json) END AS v FROM held h LEFT JOIN leaves l ON l.s = h.s AND l.name = h.name),
 steps AS (SELECT s AS cur, lag(s) OVER (ORDER BY s) AS prev FROM (SELECT DISTINCT s FROM held)),
 a AS (SELECT st.cur, x.* FROM steps st JOIN state x ON x.s = st.prev), b AS (SELECT st.cur, x.* FROM steps st JOIN state x ON x.s = st.cur WHERE st.prev IS NOT NULL)
SELECT coalesce(a.cur, b.cur) AS snapshot_no, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.cur = b.cur AND a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.delisted_at IS DISTINCT FROM b.delisted_at OR a.v IS DISTINCT FROM b.v"""

ORACLE_SQL = {
    "p2_found": _P2,
    "p2_schema_log": _P2_LOG,
    "p2_packages_table": _p2_table("packages"),
    "p2_index_table": _p2_table("index"),
    "p5_found": _P5,
    "p4_found": f"SELECT 'score' AS entity, entity_id, valid_from_us FROM ({_SCORES}) UNION ALL SELECT 'hash', entity_id, valid_from_us FROM ({_HASHES})",
    "p4_score_history": _SCORES,
    "p4_hash_history": _HASHES,
    "p6_found": _P6,
    "p6_packages": _p6_sql("top", "relation = 'packages'", "origin", "-1", _TEXT_I, "x",
    ("registryType", "identifier", "version", "fileSha256")),
    "p6_remotes": _p6_sql("top", "relation = 'remotes'", "origin", "-1", _TEXT_I, "x", ("url", "type")),
    "p6_runtime_args": _p6_sql("args", _ARG.format(r="runtime_args"), "origin", "i", _TEXT_J, "a", ("type", "name", "value")),
    "p6_package_args": _p6_sql("args", _ARG.format(r="package_args"), "origin", "i", _TEXT_J, "a", ("type", "name", "value")),
    "p6_env": _p6_sql(_MAPPED, "relation = 'env'", "origin", "pos", "n", "o", ("description", "isRequired", "value"), _P6_WITH),
    "p6_headers": _p6_sql(_MAPPED, "relation = 'headers'", "origin", "pos", "n", "o", ("value", "isRequired")),
    "p6_choices": _p6_sql("picks", "json_type(z) <> 'NULL'", "origin", "pos", "n || '/' || q", "z", ("label", "value"), _P6_WITH),
}
