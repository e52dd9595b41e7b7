"""The registry queries restated in DuckDB SQL, independent of the expressions they check."""

from __future__ import annotations

from heddle.plans.registry import BLOCKED, LAUNCHES, NOW, SEARCH, SITE

_NOW_US = f"epoch_us(TIMESTAMP '{NOW}')"
_L = "launches AS (" + LAUNCHES.format(part="part") + ")"
_ENV_TEXT = "coalesce(array_to_string(list_sort(list_transform(map_entries(env), lambda e: e.key || '=' || coalesce(e.value, ''))), chr(10)), '')"
_KNOWN = ("@modelcontextprotocol/server-filesystem", "@modelcontextprotocol/server-postgres", "@modelcontextprotocol/server-everything",
    "@modelcontextprotocol/server-sqlite", "@upstash/context7-mcp", "@playwright/mcp", "@google/mcp-server", "mcp-server-sqlite")
_LIST = "[" + ", ".join(f"'{k}'" for k in _KNOWN) + "]"
# ---- fixed values: what a finding says of its rule ----
_RULES = """rules(rule_id, title, severity, confidence, owasp, recommendation) AS (VALUES
 ('MCP-STATIC-001', 'Literal secret in a server''s environment', 'high', 'high', 'LLM02', 'Refer to a variable or secret store, and revoke the value that was written here.'),
 ('MCP-STATIC-002', 'Download piped into a shell at launch', 'critical', 'high', 'AST04', 'Install a released package of a fixed version; read a script before it runs.'),
 ('MCP-STATIC-003', 'Host-wide permissions at launch', 'high', 'medium', 'LLM08', 'Grant single folders and ports; leave the host''s network, devices and sandbox alone.'),
 ('MCP-STATIC-004', 'Package version not pinned at launch', 'medium', 'medium', 'AST04', 'Name the exact version or digest and raise it on purpose.'),
 ('MCP-STATIC-005', 'Injection markers in the entry', 'critical', 'medium', 'LLM01', 'Take hidden characters, comments and orders to the reader out of the entry.'),
 ('MCP-STATIC-006', 'Package name close to a known one', 'high', 'medium', 'AST04', 'Compare the name letter by letter with the project''s own page before installing.'),
 ('MCP-STATIC-007', 'Package without a source repository', 'medium', 'low', 'AST04', 'Prefer packages whose source can be read; maintainers should declare the repository.'),
 ('MCP-STATIC-008', 'Install script pipes a download into a shell', 'high', 'medium', 'AST04', 'Read what the package runs on installation, or take one that runs nothing.'),
 ('MCP-STATIC-009', 'Package published very recently', 'low', 'low', 'AST04', 'Wait, or look closely at who publishes it and since when.'))"""
# ---- end of fixed values ----
_P001 = "(?im)(api[_-]?key|secret|token|password)\\s*[=:]\\s*[\"'']?(sk-[a-z0-9]{12,}|xox[baprs]-[a-z0-9-]{10,}|gh[pousr]_[A-Za-z0-9]{20,}|[A-Za-z0-9]{32,})"
_P002 = "(?i)(curl|wget)\\s+[^|]+\\|\\s*(sh|bash|zsh)"
_P003 = "(?im)(--privileged\\b|--network[=\\s]+host\\b|--cap-add[=\\s]+all\\b|-v\\s+/:/|--no-sandbox\\b|(?:^|\\s)/(?:\\s|$))"
_RUNNER = "(?:npx|uvx|uv\\s+run)\\s+(?:-y\\s+|--from\\s+|--with\\s+)?"
_P005 = "(?i)([\\x{200b}\\x{200c}\\x{200d}\\x{feff}\\x{2060}]|<!--[\\s\\S]*?-->|ignore\\s+(?:all\\s+)?previous\\s+instructions|do\\s+not\\s+tell\\s+the\\s+user|without\\s+(?:informing|telling)\\s+the\\s+user|send\\s+(?:this|it|the\\s+\\w+)\\s+to\\s+)"


def _hits(src: str) -> str:
    """Findings (key, rule_id, detail) of the local rules over ``src``: key, cmd, env_t, raw_t, pkg, ref."""
    return f"""walk AS (SELECT key, env_t AS t, 1::BIGINT AS pos, NULL::VARCHAR AS hit, false AS done FROM {src}
   UNION ALL SELECT key, t, at_ + length(m), CASE WHEN m <> '' AND NOT contains(substr(t, greatest(at_ - 60, 1), length(m) + 60 + least(60, at_ - 1)), '${{') THEN m END,
     m = '' OR NOT contains(substr(t, greatest(at_ - 60, 1), length(m) + 60 + least(60, at_ - 1)), '${{')
   FROM (SELECT key, t, m, pos + strpos(substr(t, pos), m) - 1 AS at_ FROM (SELECT key, t, pos, regexp_extract(substr(t, pos), '{_P001}') AS m FROM walk WHERE NOT done))),
 loose AS (SELECT *, regexp_extract(list_filter(regexp_extract_all(cmd, '(?i)\\b{_RUNNER}@?\\w\\S*', 0), lambda y: NOT regexp_matches(regexp_replace(y, '^.*\\s@?', ''), '@\\d'))[1], '(?i)^{_RUNNER}@?\\w[\\w./-]*') AS spec_hit,
   split_part(ref, '/', -1) AS seg FROM {src}),
 near AS (SELECT l.key, l.pkg, k.known, levenshtein(l.pkg, k.known) AS d, k.o FROM {src} l, (SELECT unnest({_LIST}) AS known, unnest(range({len(_KNOWN)})) AS o) k WHERE l.pkg <> '' AND NOT list_contains({_LIST}, l.pkg)),
 hits AS (
  SELECT key, 'MCP-STATIC-001' AS rule_id, hit AS detail FROM walk WHERE hit IS NOT NULL
  UNION ALL SELECT key, 'MCP-STATIC-002', regexp_extract(cmd, '{_P002}') FROM {src} WHERE regexp_matches(cmd, '{_P002}')
  UNION ALL SELECT key, 'MCP-STATIC-003', regexp_extract(cmd, '{_P003}') FROM {src} WHERE regexp_matches(cmd, '{_P003}')
  UNION ALL SELECT key, 'MCP-STATIC-004', spec_hit FROM loose WHERE spec_hit <> ''
  UNION ALL SELECT key, 'MCP-STATIC-004', CASE WHEN contains(seg, ':') THEN 'image "' || ref || '" has the moving tag "' || split_part(seg, ':', -1) || '"' ELSE 'image "' || ref || '" names no tag, so whatever is latest runs' END
    FROM loose WHERE coalesce(spec_hit, '') = '' AND ref <> '' AND NOT contains(ref, '@sha256:') AND NOT regexp_matches(seg, ':v?\\d+(\\.\\d+){{0,2}}$')
  UNION ALL SELECT key, 'MCP-STATIC-005', regexp_extract(raw_t, '{_P005}') FROM {src} WHERE regexp_matches(raw_t, '{_P005}')
  UNION ALL SELECT key, 'MCP-STATIC-006', 'package "' || pkg || '" is ' || d || ' edit(s) from "' || known || '"' FROM near WHERE d <= 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, o) = 1)"""


# Findings of the launches.
_F = f"""{_L}, {_RULES},
 parsed AS (SELECT *, nullif(regexp_extract(cmd, '^(?:npx|uvx) (?:-\\S+ )*(\\S+)', 1), '') AS spec, regexp_extract(cmd, '^docker run (?:(?:-e|-v) \\S+ |-\\S+ )*(\\S+)', 1) AS ref FROM launches),
 named AS (SELECT *, coalesce(regexp_extract(spec, '^(@[^/]*$|@[^/]*/[^@]*|[^@]*)', 1), '') AS pkg FROM parsed),
 launch_src AS (SELECT server_id AS key, cmd, coalesce('API_TOKEN=' || token, '') AS env_t, raw AS raw_t, pkg, ref FROM named),
 {_hits('launch_src')},
 findings AS (SELECT h.key AS server_id, n.name, n.brand, h.rule_id, left(h.detail, 160) AS detail, r.title, r.severity, r.confidence, r.owasp, r.recommendation FROM hits h JOIN named n ON n.server_id = h.key JOIN rules r USING (rule_id)),
 weighed AS (SELECT *, 1.0::DOUBLE - CASE severity WHEN 'critical' THEN 0.55::DOUBLE WHEN 'high' THEN 0.35::DOUBLE ELSE 0.15::DOUBLE END * CASE confidence WHEN 'high' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS m FROM findings)"""
_ID = """ids AS (
  SELECT config_id, name, source, command, coalesce(url, '') AS url, transport, list_position(list_transform(command, lambda x: x IN ('npx', 'uvx')), true) AS li, array_to_string(command, ' ') AS cmd FROM server_configs),
 specs AS (SELECT *, CASE WHEN li > 0 THEN list_filter(command[li + 1:], lambda x: NOT starts_with(x, '-'))[1] END AS spec,
  nullif(regexp_extract(cmd, '(?:^| )docker run (?:-\\S+ )*([^-\\s]\\S*)', 1), '') AS image_ref FROM ids),
 named AS (SELECT *, nullif(regexp_extract(spec, '^(@[^/]*$|@[^/]*/[^@]*|[^@]*)', 1), '') AS package,
  CASE WHEN contains(image_ref, '@sha256:') THEN split_part(image_ref, '@sha256:', 1) ELSE regexp_replace(image_ref, ':[^/:]*$', '') END AS image,
  CASE WHEN contains(image_ref, '@sha256:') THEN 'sha256:' || split_part(image_ref, '@sha256:', 2) END AS resolved_digest FROM specs),
 servers_ AS (SELECT *, nullif(substr(spec, length(package) + 2), '') AS resolved_version,
  coalesce(package, image, CASE WHEN transport = 'http' THEN nullif(lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)), '') END, nullif(name, ''), source) AS identity FROM named)"""
_ALLOW = """allow AS (SELECT identity AS name, CASE WHEN max(resolved_digest) IS NULL THEN max(resolved_version) END AS version, max(resolved_digest) AS digest
  FROM servers_ WHERE {where} GROUP BY identity)"""
_LISTED = "starts_with(source, 'registry:')"
_ENTRY = """decoded AS (SELECT entry_id, CASE WHEN json_type(raw_json) = 'VARCHAR' THEN raw_json ->> '$' ELSE raw_json END AS d FROM registry_entries WHERE json_valid(raw_json)),
 ok AS (SELECT * FROM decoded WHERE json_valid(d)),
 head AS (SELECT entry_id, d, d ->> '$.server.name' AS name, d ->> '$.server.version' AS version, CAST(d ->> '$._meta."io.modelcontextprotocol.registry/official".isLatest' AS BOOLEAN) AS is_latest,
   d ->> '$._meta."io.modelcontextprotocol.registry/official".status' AS status,
   epoch_us(CAST(d ->> '$._meta."io.modelcontextprotocol.registry/official".publishedAt' AS TIMESTAMPTZ)) AS published_us FROM ok),
 packs AS (SELECT *, unnest(range(coalesce(json_array_length(d, '$.server.packages'), 0)::BIGINT)) AS i FROM head),
 rems AS (SELECT *, unnest(range(coalesce(json_array_length(d, '$.server.remotes'), 0)::BIGINT)) AS i FROM head),
 p AS (SELECT *, json_extract(d, '$.server.packages[' || i || ']') AS x FROM packs),
 r AS (SELECT *, json_extract(d, '$.server.remotes[' || i || ']') AS x FROM rems),
 targets AS (
  SELECT entry_id, 'package' AS kind, CAST(i AS INTEGER) AS pos, name, version, x ->> '$.registryType' AS registry_type, x ->> '$.identifier' AS identifier,
    coalesce(x ->> '$.transport.type', CASE WHEN json_type(x, '$.transport') = 'VARCHAR' THEN x ->> '$.transport' END) AS transport, CAST(NULL AS VARCHAR) AS url, x ->> '$.fileSha256' AS sha256, is_latest, status, published_us FROM p WHERE json_type(x) <> 'NULL'
  UNION ALL
  SELECT entry_id, 'remote', CAST(i AS INTEGER), name, version, 'remote', x ->> '$.url', coalesce(x ->> '$.type', x ->> '$.transport'), x ->> '$.url', NULL, is_latest, status, published_us FROM r WHERE json_type(x) <> 'NULL')"""
_TOKENS = "coalesce(flatten(list_transform(json_extract({c}, '$[*]'), lambda a: CASE WHEN json_type(a) = 'VARCHAR' THEN [a ->> '$'] WHEN json_type(a) = 'OBJECT' THEN list_filter([nullif(a ->> '$.name', ''), a ->> '$.value'], lambda w: w IS NOT NULL) ELSE [] END)), [])"
_SCORED = """last AS (SELECT server_id, score, finding_count, computed_at FROM server_scores WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY server_id ORDER BY computed_at DESC, id DESC) = 1),
 scored AS (SELECT s.id AS server_id, s.name, l.score, l.finding_count, l.computed_at FROM servers s JOIN last l ON l.server_id = s.id)"""
_INDEX = _SCORED + """,
 based AS (SELECT *, regexp_replace(replace(name, '/', '__'), '[^A-Za-z0-9_.@-]', '_', 'g') AS b FROM scored),
 idx AS (SELECT server_id, name, CASE WHEN row_number() OVER (PARTITION BY lower(b) ORDER BY name) = 1 THEN b ELSE b || '-' || left(sha1(name), 8) END AS slug, score, finding_count, computed_at FROM based)"""
_PAIRS = """ranked AS (SELECT server_id, score, finding_count, computed_at, row_number() OVER w AS r, lead(score) OVER w AS previous_score
  FROM (SELECT DISTINCT server_id, id, computed_at, score, finding_count FROM server_scores WHERE score IS NOT NULL) WINDOW w AS (PARTITION BY server_id ORDER BY computed_at DESC, id DESC)),
 pairs AS (SELECT server_id, score, previous_score, finding_count, computed_at FROM ranked WHERE r = 1)"""
_FLAGGED = f"""{_INDEX}, {_PAIRS}, flagged AS (SELECT row_number() OVER (ORDER BY p.computed_at DESC, i.name) AS ordinal, i.name, i.slug, p.score, p.previous_score, p.finding_count, p.computed_at
  FROM pairs p JOIN idx i USING (server_id) WHERE p.score < 100 AND (p.previous_score IS NULL OR p.previous_score >= 100)),
 told AS (SELECT *, CASE WHEN previous_score IS NULL THEN 'First score' ELSE 'Score fell from ' || previous_score || ' to' END || ' ' || score || ', findings: ' || finding_count AS story,
  '{SITE}/servers/' || name AS url, strftime(computed_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, strftime(computed_at AT TIME ZONE 'UTC', '%a, %d %b %Y %H:%M:%S GMT') AS day FROM flagged)"""
# Every snapshot after the first is a poll at its own time; what a name is at a poll follows from
# the polls that list it: unlisted since the last of them, from the one after it on.
_UPSERT = """held AS (SELECT snapshot_no AS s, name, row_no, snapshot_at, delisted_at FROM server_snapshots WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_no, name ORDER BY row_no DESC, delisted_at DESC NULLS LAST) = 1),
 times AS (SELECT snapshot_no AS s, epoch_us(max(snapshot_at)) AS us, row_number() OVER (ORDER BY snapshot_no) AS k FROM server_snapshots WHERE snapshot_no IS NOT NULL GROUP BY 1),
 listed AS (SELECT h.name, h.row_no, t.k, CASE WHEN t.k = 1 THEN epoch_us(h.snapshot_at) ELSE t.us END AS us, CASE WHEN t.k = 1 THEN epoch_us(h.delisted_at) END AS gone FROM held h JOIN times t USING (s)),
 names AS (SELECT name, min(k) AS first_k, arg_min(us, k) AS first_us FROM listed GROUP BY 1),
 cells AS (SELECT t.s, t.k, t.us AS at_us, n.name, n.first_us, l.k IS NOT NULL AS here, l.row_no, b.k AS before_k, b.row_no AS before_row, b.us AS before_us, b.gone AS before_gone
   FROM times t JOIN names n ON n.first_k <= t.k LEFT JOIN listed l ON l.name = n.name AND l.k = t.k ASOF LEFT JOIN listed b ON b.name = n.name AND t.k > b.k WHERE t.k > 1),
 up AS (SELECT s AS snapshot_no, name, CASE WHEN here THEN row_no ELSE before_row END AS row_no,
   CASE WHEN here AND before_k IS NULL THEN 'new' WHEN here AND (before_k < k - 1 OR before_gone IS NOT NULL) THEN 'relisted' WHEN here THEN 'updated' WHEN before_k = k - 1 AND before_gone IS NULL THEN 'delisted' ELSE 'absent' END AS change,
   first_us, CASE WHEN here THEN at_us ELSE before_us END AS last_us,
   CASE WHEN NOT here THEN coalesce(before_gone, (SELECT us FROM times x WHERE x.k = before_k + 1)) END AS delisted_us FROM cells)"""
_SLUG = """base AS (SELECT DISTINCT name, regexp_replace(replace(name, '/', '__'), '[^A-Za-z0-9_.@-]', '_', 'g') AS b FROM {names} WHERE name IS NOT NULL)
SELECT name, CASE WHEN row_number() OVER (PARTITION BY lower(b) ORDER BY name) = 1 THEN b ELSE b || '-' || left(sha1(name), 8) END AS slug FROM base"""
_RULE_IDS = ", ".join(f"('rule', '{SITE}/rules/MCP-STATIC-00{i}')" for i in range(1, 10))
_COLOR = "CASE WHEN score >= 90 THEN '#4c1' WHEN score >= 70 THEN '#dfb317' ELSE '#e05d44' END"

_PLAN = """fp AS (SELECT rules_fingerprint AS f FROM server_scores ORDER BY computed_at DESC, id DESC LIMIT 1), sc AS (SELECT server_id, max(computed_at) AS a FROM server_scores, fp WHERE rules_fingerprint = f GROUP BY 1),
 h AS (SELECT version_id, max(observed_at) AS b FROM hashes GROUP BY 1),
 plan AS (SELECT v.id AS version_id, epoch_us(a) AS scanned_us, epoch_us(b) AS hash_us, a IS NULL OR coalesce(b > a, false) AS stale FROM versions v LEFT JOIN sc USING (server_id) LEFT JOIN h ON h.version_id = v.id WHERE v.is_latest AND v.delisted_at IS NULL)"""
_COMMAND = f"""CASE WHEN registry_type = 'remote' THEN '' ELSE array_to_string(list_concat(
        CASE registry_type WHEN 'npm' THEN ['npx', '-y'] WHEN 'pypi' THEN ['uvx'] WHEN 'oci' THEN ['docker', 'run'] WHEN 'cargo' THEN ['cargo', 'run', '--'] WHEN 'nuget' THEN ['dotnet', 'tool', 'run'] ELSE [] END,
        [CASE WHEN registry_type IN ('npm', 'pypi') AND version <> '' THEN identifier || '@' || version ELSE identifier END], {_TOKENS.format(c='runtime_arguments')}, {_TOKENS.format(c='package_arguments')}), ' ') END"""
# A run over all listed latest versions, with what the registry knows of their packages.
_SCAN = f"""{_RULES},
 vlaunch AS (SELECT id AS version_id, server_id, registry_type, identifier, raw_json, CASE WHEN registry_type = 'remote' OR identifier IS NOT NULL THEN {_COMMAND} END AS cmd,
   CASE json_type(environment_variables) WHEN 'OBJECT' THEN array_to_string(list_transform(json_keys(environment_variables), lambda k: k || '=' || coalesce(environment_variables ->> ('$."' || k || '"'), '')), chr(10))
     WHEN 'ARRAY' THEN array_to_string(list_transform(list_filter(json_extract(environment_variables, '$[*]'), lambda a: a ->> '$.name' <> ''), lambda a: (a ->> '$.name') || '=' || coalesce(a ->> '$.value', '')), chr(10)) END AS env_t
   FROM versions WHERE is_latest AND delisted_at IS NULL),
 scan_src AS (SELECT version_id AS key, cmd, coalesce(env_t, '') AS env_t, coalesce(raw_json, '') AS raw_t, coalesce(regexp_extract(regexp_extract(cmd, '^(?:npx|uvx) (?:-\\S+ )*(\\S+)', 1), '^(@[^/]*$|@[^/]*/[^@]*|[^@]*)', 1), '') AS pkg,
   coalesce(regexp_extract(cmd, '^docker run (?:-\\S+ )*([^-\\s]\\S*)', 1), '') AS ref FROM vlaunch WHERE cmd IS NOT NULL),
 {_hits('scan_src')},
 meta AS (SELECT v.registry_type, v.identifier, max(s.repository_url) AS repo, min(v.published_at) AS created FROM versions v JOIN servers s ON s.id = v.server_id WHERE v.registry_type IN ('npm', 'pypi') GROUP BY 1, 2),
 asked AS (SELECT v.version_id, v.registry_type AS eco, v.identifier AS pkg, m.repo, floor(({_NOW_US} - epoch_us(m.created)) / 86400000000)::BIGINT AS days FROM vlaunch v JOIN meta m USING (registry_type, identifier)),
 all_hits AS (SELECT * FROM hits
  UNION ALL SELECT version_id, 'MCP-STATIC-007', CASE WHEN eco = 'pypi' THEN 'PyPI lists no source repository for "' || pkg || '"' ELSE 'npm package "' || pkg || '" declares no repository' END FROM asked WHERE coalesce(repo, '') = ''
  UNION ALL SELECT version_id, 'MCP-STATIC-009', '"' || pkg || '" appeared ' || days || ' day(s) ago' FROM asked WHERE days <= 30),
 found AS (SELECT h.key AS version_id, v.server_id, r.rule_id, r.title, r.severity, r.confidence, r.owasp, r.recommendation, left(h.detail, 160) AS detail,
   CASE r.severity WHEN 'critical' THEN 0.55::DOUBLE WHEN 'high' THEN 0.35::DOUBLE WHEN 'medium' THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END * CASE r.confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS w
   FROM all_hits h JOIN rules r USING (rule_id) JOIN vlaunch v ON v.version_id = h.key)"""

_DOCUMENTS = f"""WITH RECURSIVE {_INDEX}, {_SCAN}, one AS (SELECT DISTINCT ON (server_id, rule_id) * FROM found ORDER BY server_id, rule_id, w DESC, version_id),
      lists AS (SELECT server_id, '[' || string_agg(CAST(json_object('rule_id', rule_id, 'title', title, 'severity', severity, 'confidence', confidence, 'owasp', owasp, 'detail', detail, 'recommendation', recommendation) AS VARCHAR), ',' ORDER BY rule_id) || ']' AS l FROM one GROUP BY 1)
      SELECT name, slug, '{{"name":"' || name || '","score":' || score || ',"finding_count":' || finding_count || ',"computed_at":"' || strftime(computed_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","findings":' || coalesce(l, '[]') || '}}' AS document
      FROM idx LEFT JOIN lists USING (server_id)"""

ORACLE_SQL = {
    "config_normalise": f"SELECT config_id, transport, array_to_string(command, chr(31)) AS command, coalesce(url, '') AS url, {_ENV_TEXT} AS env FROM server_configs",
    "registry_targets": f"WITH {_ENTRY} SELECT * FROM targets",
    "registry_type_union": f"WITH {_ENTRY} SELECT registry_type, kind, count(*) AS targets, count(DISTINCT entry_id) AS entries FROM targets GROUP BY 1, 2",
    "version_launch": f"""SELECT id AS version_id, CASE WHEN registry_type = 'remote' OR transport IN ('http', 'sse', 'streamable-http') THEN 'http' ELSE 'stdio' END AS transport,
      CASE WHEN registry_type = 'remote' THEN '' ELSE array_to_string(list_concat(
        CASE registry_type WHEN 'npm' THEN ['npx', '-y'] WHEN 'pypi' THEN ['uvx'] WHEN 'oci' THEN ['docker', 'run'] WHEN 'cargo' THEN ['cargo', 'run', '--'] WHEN 'nuget' THEN ['dotnet', 'tool', 'run'] ELSE [] END,
        [CASE WHEN registry_type IN ('npm', 'pypi') AND version <> '' THEN identifier || '@' || version ELSE identifier END], {_TOKENS.format(c='runtime_arguments')}, {_TOKENS.format(c='package_arguments')}), ' ') END AS command,
      CASE WHEN registry_type = 'remote' THEN identifier ELSE '' END AS url,
      CAST(CASE json_type(environment_variables) WHEN 'OBJECT' THEN len(json_keys(environment_variables))
        WHEN 'ARRAY' THEN len(list_distinct(list_filter(list_transform(json_extract(environment_variables, '$[*]'), lambda a: a ->> '$.name'), lambda n: n <> ''))) ELSE 0 END AS INTEGER) AS env_count FROM versions""",
    "env_lines": f"SELECT config_id, {_ENV_TEXT} AS env_text FROM server_configs",
    "launch_identity": f"WITH {_ID} SELECT config_id, package, resolved_version, image_ref, image, resolved_digest, identity FROM servers_",
    "rule_findings": f"WITH RECURSIVE {_F} SELECT server_id, rule_id, severity, confidence, owasp FROM findings",
    "rule_details": f"WITH RECURSIVE {_F} SELECT server_id, rule_id, title, 'parts :: ' || name AS location, detail, recommendation FROM findings",
    "rule_totals": f"WITH RECURSIVE {_F} SELECT rule_id, severity, count(*) AS findings, count(DISTINCT server_id) AS configs FROM findings GROUP BY 1, 2",
    "secret_rule_env": f"""WITH RECURSIVE texts AS (SELECT config_id, {_ENV_TEXT} AS t FROM server_configs),
      walk AS (SELECT config_id, t, 1::BIGINT AS pos, NULL::VARCHAR AS hit, false AS done FROM texts
       UNION ALL SELECT config_id, t, at_ + length(m), CASE WHEN m <> '' AND NOT contains(substr(t, greatest(at_ - 60, 1), length(m) + 60 + least(60, at_ - 1)), '${{') THEN m END,
         m = '' OR NOT contains(substr(t, greatest(at_ - 60, 1), length(m) + 60 + least(60, at_ - 1)), '${{')
       FROM (SELECT config_id, t, m, pos + strpos(substr(t, pos), m) - 1 AS at_ FROM (SELECT config_id, t, pos, regexp_extract(substr(t, pos),
         '(?im)(api[_-]?key|secret|token|password)\\s*[=:]\\s*["'']?(sk-[a-z0-9]{{12,}}|xox[baprs]-[a-z0-9-]{{10,}}|gh[pousr]_[A-Za-z0-9]{{20,}}|[A-Za-z0-9]{{32,}})') AS m FROM walk WHERE NOT done)))
      SELECT config_id, hit FROM walk WHERE hit IS NOT NULL""",
    "launch_score_board": f"""WITH RECURSIVE {_F}, s AS (SELECT server_id, 100.0::DOUBLE * product(m) AS p, count(*) AS n FROM weighed GROUP BY 1)
      SELECT l.server_id, l.name, CAST(round_even(CAST(coalesce(s.p, 100.0) AS DOUBLE), 0) AS INTEGER) AS score, CAST(coalesce(s.n, 0) AS INTEGER) AS finding_count FROM launches l LEFT JOIN s ON l.server_id = s.server_id""",
    "brand_scores": f"""WITH RECURSIVE {_F}, one AS (SELECT brand, rule_id, max(1 - m) AS d FROM weighed GROUP BY 1, 2), s AS (SELECT brand, 100.0::DOUBLE * product(1 - d) AS p, count(*) AS n FROM one GROUP BY 1)
      SELECT b.brand, CAST(round_even(CAST(coalesce(s.p, 100.0) AS DOUBLE), 0) AS INTEGER) AS score, CAST(coalesce(s.n, 0) AS INTEGER) AS finding_count FROM (SELECT DISTINCT brand FROM launches) b LEFT JOIN s ON b.brand = s.brand""",
    "score_cascade": f"""WITH RECURSIVE {_F}, o AS (SELECT *, row_number() OVER w AS step, 100.0::DOUBLE * product(m) OVER w AS after_ FROM weighed
       WINDOW w AS (PARTITION BY server_id ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 3 END, CASE confidence WHEN 'high' THEN 1 ELSE 2 END, rule_id ROWS UNBOUNDED PRECEDING))
      SELECT server_id, CAST(step AS INTEGER) AS step, rule_id, round(m, 6) AS multiplier, round(after_ / m, 6) AS before, round(after_, 6) AS after FROM o""",
    "dedupe_max_severity": f"WITH RECURSIVE {_F} SELECT brand, rule_id, min(severity) AS severity, min(confidence) AS confidence, min(server_id) AS server_id FROM findings GROUP BY brand, rule_id",
    "severity_rollup": f"WITH RECURSIVE {_F} SELECT severity, owasp, count(*) AS findings FROM findings GROUP BY ROLLUP (severity, owasp)",
    "package_age": f"SELECT id, CAST(floor(({_NOW_US} - epoch_us(published_at)) / 86400000000) AS BIGINT) AS age_days FROM versions WHERE published_at IS NOT NULL AND floor(({_NOW_US} - epoch_us(published_at)) / 86400000000) <= 30",
    "provenance_findings": f"""WITH meta AS (SELECT v.registry_type, v.identifier, max(s.repository_url) AS repo, min(v.published_at) AS created FROM versions v JOIN servers s ON s.id = v.server_id WHERE v.registry_type IN ('npm', 'pypi') GROUP BY 1, 2),
      j AS (SELECT v.id, m.repo, m.created FROM versions v JOIN meta m ON m.registry_type = v.registry_type AND m.identifier = v.identifier)
      SELECT id AS version_id, 'MCP-STATIC-007' AS rule_id, 'medium' AS severity FROM j WHERE coalesce(repo, '') = ''
      UNION ALL SELECT id, 'MCP-STATIC-009', 'low' FROM j WHERE floor(({_NOW_US} - epoch_us(created)) / 86400000000) <= 30""",
    "typosquat_nearest": f"""WITH RECURSIVE {_F}, n AS (SELECT DISTINCT pkg AS identifier FROM named WHERE pkg <> ''), k AS (SELECT unnest({_LIST}) AS known, unnest(range({len(_KNOWN)})) AS o)
      SELECT identifier, known, CAST(levenshtein(identifier, known) AS INTEGER) AS distance FROM n, k WHERE identifier NOT IN (SELECT known FROM k) AND levenshtein(identifier, known) BETWEEN 1 AND 2
      QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY levenshtein(identifier, known), o) = 1""",
    "typosquat_clusters": f"""WITH RECURSIVE {_F}, k AS (SELECT unnest({_LIST}) AS known), slugged AS (SELECT name, regexp_replace(replace(name, '/', '__'), '[^A-Za-z0-9_.@-]', '_', 'g') AS b FROM launches),
      uniq AS (SELECT name, CASE WHEN row_number() OVER (PARTITION BY lower(b) ORDER BY name) = 1 THEN b ELSE b || '-' || left(sha1(name), 8) END AS slug FROM slugged),
      n AS (SELECT k.known, x.pkg AS identifier, CAST(levenshtein(x.pkg, k.known) AS INTEGER) AS distance, x.name AS server_name FROM k JOIN named x ON x.pkg <> '' AND levenshtein(x.pkg, k.known) BETWEEN 1 AND 2)
      SELECT k.known AS known_name, regexp_replace(replace(k.known, '/', '__'), '[^A-Za-z0-9_.@-]', '_', 'g') AS known_slug,
        CASE WHEN n.known IS NOT NULL THEN row_number() OVER (PARTITION BY k.known ORDER BY distance, identifier, server_name) END AS position, identifier, distance, server_name, u.slug AS server_slug
      FROM k LEFT JOIN n USING (known) LEFT JOIN uniq u ON u.name = n.server_name""",
    "clusters_with_neighbours": f"WITH RECURSIVE {_F} SELECT known AS known_name, count(*) AS neighbours FROM (SELECT unnest({_LIST}) AS known) k JOIN named x ON x.pkg <> '' AND levenshtein(x.pkg, known) BETWEEN 1 AND 2 GROUP BY 1",
    "lookalike_pairs": """WITH n AS (SELECT DISTINCT identifier FROM versions WHERE registry_type <> 'remote')
      SELECT x.identifier AS a, y.identifier AS b, CAST(levenshtein(x.identifier, y.identifier) AS INTEGER) AS distance FROM n x JOIN n y ON x.identifier < y.identifier AND abs(length(x.identifier) - length(y.identifier)) <= 2 AND levenshtein(x.identifier, y.identifier) <= 2""",
    "lookalike_edits": """WITH n AS (SELECT DISTINCT identifier FROM versions WHERE registry_type <> 'remote')
      SELECT x.identifier AS a, y.identifier AS b, CAST(levenshtein(x.identifier, y.identifier) AS INTEGER) AS edits, a AS before, b AS after FROM n x JOIN n y ON x.identifier < y.identifier AND abs(length(x.identifier) - length(y.identifier)) <= 2 AND levenshtein(x.identifier, y.identifier) <= 2""",
    "jsonc_roundtrip": "SELECT config_id, regexp_replace(raw, '\\s*\\}\\s*$', '}') AS text FROM server_configs WHERE starts_with(raw, '{')",
    "version_upsert": f"""WITH {_ENTRY}, polled AS (SELECT name, version, registry_type, identifier, max(transport) AS transport FROM targets WHERE name IS NOT NULL AND version IS NOT NULL AND registry_type IS NOT NULL AND identifier IS NOT NULL GROUP BY 1, 2, 3, 4),
      o AS (SELECT s.name, v.version, v.registry_type, v.identifier, v.transport, v.first_seen_at, v.delisted_at FROM versions v JOIN servers s ON s.id = v.server_id WHERE v.version IS NOT NULL AND v.registry_type IS NOT NULL AND v.identifier IS NOT NULL)
      SELECT coalesce(p.name, o.name) AS name, coalesce(p.version, o.version) AS version, coalesce(p.registry_type, o.registry_type) AS registry_type, coalesce(p.identifier, o.identifier) AS identifier, CASE WHEN p.name IS NULL THEN o.transport ELSE p.transport END AS transport,
        CASE WHEN o.name IS NULL THEN 'new' WHEN p.name IS NULL AND o.delisted_at IS NULL THEN 'delisted' WHEN p.name IS NULL THEN 'absent' WHEN o.delisted_at IS NULL THEN 'updated' ELSE 'relisted' END AS change,
        coalesce(epoch_us(o.first_seen_at), {_NOW_US}) AS first_us, CASE WHEN p.name IS NULL THEN coalesce(epoch_us(o.delisted_at), {_NOW_US}) END AS delisted_us
      FROM o FULL JOIN polled p ON o.name = p.name AND o.version = p.version AND o.registry_type = p.registry_type AND o.identifier = p.identifier""",
    "latest_hash": "SELECT version_id, sha256, epoch_us(observed_at) AS observed_us FROM hashes QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY observed_at DESC, id DESC) = 1",
    "latest_score": "SELECT server_id, score, finding_count, id FROM server_scores QUALIFY row_number() OVER (PARTITION BY server_id ORDER BY computed_at DESC, id DESC) = 1",
    "hash_change_ledger": """SELECT version_id, id, sha256 FROM (SELECT *, lag(sha256) OVER w AS b, row_number() OVER w AS r FROM (SELECT DISTINCT version_id, id, sha256, observed_at FROM hashes WHERE sha256 IS NOT NULL)
      WINDOW w AS (PARTITION BY version_id ORDER BY observed_at, id)) WHERE r = 1 OR b IS DISTINCT FROM sha256""",
    "latest_event_per_user": "SELECT user_id, event_id, event_type, value FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "latest_ok_scan": "SELECT user_id, event_id, event_type FROM events WHERE user_id IS NOT NULL AND event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "event_change_ledger": """SELECT user_id, event_id, sha FROM (SELECT *, lag(sha) OVER w AS b, row_number() OVER w AS r FROM (SELECT user_id, event_id, ts, 'h' || (CAST(props ->> '$.k' AS BIGINT) % 3) AS sha FROM events WHERE props ->> '$.k' IS NOT NULL)
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR b <> sha""",
    "scan_plan": f"WITH {_PLAN} SELECT * FROM plan",
    "needs_rescan": f"WITH {_PLAN} SELECT version_id FROM plan WHERE stale",
    "scan_findings": f"WITH RECURSIVE {_SCAN} SELECT version_id, rule_id, severity, confidence, owasp, detail FROM found",
    "scan_counts": f"""WITH RECURSIVE {_SCAN} SELECT (SELECT count(*) FROM vlaunch) AS versions_seen, 0::BIGINT AS versions_skipped, (SELECT count(*) FROM vlaunch WHERE cmd IS NOT NULL) AS versions_scanned,
      (SELECT count(*) FROM vlaunch WHERE cmd IS NULL) AS versions_errored, (SELECT count(*) FROM found) AS findings_written""",
    "server_score": f"""WITH RECURSIVE {_SCAN}, one AS (SELECT server_id, rule_id, max(w) AS w FROM found GROUP BY 1, 2), s AS (SELECT server_id, 100.0::DOUBLE * product(1 - w) AS p, count(*) AS n FROM one GROUP BY 1)
      SELECT v.server_id, CAST(round_even(coalesce(s.p, 100.0::DOUBLE), 0) AS INTEGER) AS score, CAST(coalesce(s.n, 0) AS INTEGER) AS finding_count FROM (SELECT DISTINCT server_id FROM vlaunch) v LEFT JOIN s USING (server_id)""",
    "server_documents": _DOCUMENTS,
    "server_check": _DOCUMENTS + " WHERE name = (SELECT min(name) FROM servers)",
    "metadata_findings": f"""WITH RECURSIVE {_F}, asked AS (SELECT *, CASE WHEN starts_with(cmd, 'uvx') THEN 'pypi' ELSE 'npm' END AS eco FROM named WHERE pkg <> ''),
      known AS (SELECT eco, pkg, min(server_id) AS k FROM asked GROUP BY 1, 2), j AS (SELECT a.server_id, a.eco, a.pkg, k FROM asked a JOIN known USING (eco, pkg))
      SELECT server_id, 'MCP-STATIC-007' AS rule_id, 'medium' AS severity, CASE WHEN eco = 'pypi' THEN 'PyPI lists no source repository for "' || pkg || '"' WHEN k % 11 = 0 THEN '"' || pkg || '" is no longer on npm' ELSE 'npm package "' || pkg || '" declares no repository' END AS detail
        FROM j WHERE (eco = 'pypi' AND k % 2 = 1) OR (eco = 'npm' AND (k % 11 = 0 OR k % 5 <= 1))
      UNION ALL SELECT server_id, 'MCP-STATIC-008', 'high', 'npm package "' || pkg || '" pipes a download into a shell on postinstall' FROM j WHERE eco = 'npm' AND k % 7 = 0
      UNION ALL SELECT server_id, 'MCP-STATIC-009', 'low', '"' || pkg || '" appeared ' || k % 90 || ' day(s) ago' FROM j WHERE k % 90 <= 30""",
    "config_findings": f"""WITH RECURSIVE {_ID}, config_src AS (SELECT s.config_id AS key, coalesce(s.cmd, '') AS cmd, coalesce(array_to_string(list_transform(map_entries(c.env), lambda e: e.key || '=' || coalesce(e.value, '')), chr(10)), '') AS env_t,
        coalesce(c.raw, '') AS raw_t, coalesce(s.package, '') AS pkg, coalesce(s.image_ref, '') AS ref FROM servers_ s JOIN server_configs c USING (config_id)), {_hits('config_src')}
      SELECT key AS config_id, rule_id, left(detail, 160) AS detail FROM hits""",
    "artifact_index": f"WITH {_INDEX} SELECT name, slug, score, finding_count, strftime(computed_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS last_scanned_at FROM idx",
    "score_totals": f"WITH {_INDEX} SELECT count(*) AS servers, count(*) FILTER (score < 100) AS flagged, count(*) FILTER (score >= 100) AS clean FROM idx",
    "review_packet": f"""WITH RECURSIVE {_F}, s AS (SELECT server_id, 100.0::DOUBLE * product(m) AS p, count(*) AS n FROM weighed GROUP BY 1), l AS (SELECT server_id, list_sort(list(rule_id)) AS ids FROM findings GROUP BY 1),
      r AS (SELECT n.name, CAST(round_even(coalesce(s.p, 100.0::DOUBLE), 0) AS INTEGER) AS score, CAST(coalesce(s.n, 0) AS INTEGER) AS finding_count, coalesce(array_to_string(ids, ', '), '') AS rules,
        CASE WHEN list_has_any(ids, ['MCP-STATIC-003', 'MCP-STATIC-004']) THEN 'rare-rule' WHEN s.n > 0 THEN 'flagged' ELSE 'clean' END AS stratum FROM launches n LEFT JOIN s USING (server_id) LEFT JOIN l USING (server_id)),
      q AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('16:' || name), name) AS k FROM r)
      SELECT row_number() OVER (ORDER BY finding_count DESC, name) AS ordinal, name, score, finding_count, stratum, rules, NULL::VARCHAR AS link FROM q WHERE stratum = 'rare-rule' OR k <= CASE stratum WHEN 'flagged' THEN 31 ELSE 15 END""",
    "sarif": f"""WITH RECURSIVE {_F}, f AS (SELECT *, row_number() OVER (ORDER BY 'parts :: ' || name, rule_id, detail) AS k FROM findings), u AS (SELECT rule_id, min(title) AS title, min(severity) AS severity, min(owasp) AS owasp, row_number() OVER (ORDER BY rule_id) AS k FROM findings GROUP BY 1),
      c AS (SELECT (SELECT count(*) FROM u) AS nu, (SELECT count(*) FROM f) AS nf)
      SELECT 1::BIGINT AS line_no, '{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"heddle","informationUri":"{SITE}","rules":[' AS line
      UNION ALL SELECT 1 + k, CAST(json_object('id', rule_id, 'name', title, 'shortDescription', json_object('text', title), 'properties', json_object('security-severity', CASE severity WHEN 'critical' THEN '9.5' WHEN 'high' THEN '7.5' WHEN 'medium' THEN '5.5' ELSE '2.5' END, 'owasp', owasp)) AS VARCHAR) || CASE WHEN k < nu THEN ',' ELSE '' END FROM u, c
      UNION ALL SELECT 2 + nu, ']}}}},"results":[' FROM c
      UNION ALL SELECT 2 + nu + k, CAST(json_object('ruleId', rule_id, 'level', CASE severity WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'error' END, 'message', json_object('text', title || ' (' || name || ') — ' || detail),
        'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', 'parts'))))) AS VARCHAR) || CASE WHEN k < nf THEN ',' ELSE '' END FROM f, c
      UNION ALL SELECT 3 + nu + nf, ']}}]}}' FROM c""",
    "policy_report": f"""WITH RECURSIVE {_F.replace(_L, _L + ', ' + _ID.replace(' named AS (', ' named_ids AS (').replace('FROM named)', 'FROM named_ids)') + ', ' + _ALLOW.format(where=_LISTED))}, v AS (
      SELECT 0 AS part, 'high' AS severity, 'unlisted_server' AS kind, identity AS server, identity || ' is not on the allowlist' AS detail FROM servers_ WHERE identity NOT IN (SELECT name FROM allow)
      UNION ALL SELECT 0, 'high', 'version_drift', identity, identity || ' is pinned to ' || pinned || ' but resolves to ' || coalesce(found, 'nothing')
        FROM (SELECT identity, coalesce(digest, version) AS pinned, CASE WHEN digest IS NOT NULL THEN resolved_digest ELSE resolved_version END AS found FROM servers_ s JOIN allow a ON a.name = s.identity) WHERE pinned IS NOT NULL AND found IS DISTINCT FROM pinned
      UNION ALL SELECT 1, 'critical', 'blocked_registry', identity, 'uses blocked registry ' || list_filter({BLOCKED!r}, lambda b: contains(coalesce(cmd, ''), b) OR contains(url, b))[1] FROM servers_ WHERE len(list_filter({BLOCKED!r}, lambda b: contains(coalesce(cmd, ''), b) OR contains(url, b))) > 0
      UNION ALL SELECT 2, severity, 'finding', name, detail FROM findings WHERE severity IN ('high', 'critical')),
      n AS (SELECT *, row_number() OVER (ORDER BY part, CASE severity WHEN 'critical' THEN 0 ELSE 1 END, server, detail) AS k FROM v)
      SELECT 4 + k AS line_no, '| ' || severity || ' | ' || kind || ' | ' || replace(server, '|', '\\|') || ' | ' || replace(detail, '|', '\\|') || ' |' AS line FROM n
      UNION ALL SELECT 1, (SELECT count(*) FROM v) || ' violation(s)' UNION ALL SELECT 2, '' UNION ALL SELECT 3, '| severity | kind | server | detail |' UNION ALL SELECT 4, '|---|---|---|---|'""",
    "score_history_pairs": f"WITH {_PAIRS} SELECT server_id, score, previous_score, finding_count FROM pairs",
    "newly_flagged": f"WITH {_FLAGGED} SELECT ordinal, name, slug, score, previous_score, finding_count, epoch_us(computed_at) AS computed_us FROM flagged",
    "snapshot_upsert": f"WITH {_UPSERT} SELECT * FROM up",
    "poll_summary": f"""WITH {_UPSERT} SELECT snapshot_no, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'relisted') AS relisted,
      count(*) FILTER (change = 'delisted') AS delisted, count(*) FILTER (change = 'absent') AS absent, count(*) FILTER (delisted_us IS NULL) AS listed FROM up GROUP BY 1""",
    "flagged_leaderboard": f"WITH {_SCORED} SELECT name, score, finding_count, row_number() OVER (ORDER BY score, name) AS ordinal FROM scored WHERE score < 100",
    "browse_pages": f"WITH {_SCORED} SELECT name, score, row_number() OVER (ORDER BY name) AS ordinal, CAST((row_number() OVER (ORDER BY name) - 1) // 100 + 1 AS INTEGER) AS page FROM scored",
    "search_top20": f"SELECT name, CAST(strpos(lower(name), '{SEARCH}') AS INTEGER) AS position FROM servers WHERE contains(lower(name), '{SEARCH}') ORDER BY 2, 1 LIMIT 20",
    "server_slugs": "WITH " + _SLUG.format(names="servers"),
    "slug_collisions": "WITH clash AS (SELECT name FROM servers UNION ALL SELECT upper(name) FROM servers UNION ALL SELECT replace(name, '/', '__') FROM servers), " + _SLUG.format(names="clash"),
    "fnv_shards": """SELECT name, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 64 AS INTEGER) AS shard FROM (SELECT name,
      list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, x: (xor(a, x) * 16777619) & 4294967295) AS h FROM servers)""",
    "feed_json": f"""WITH {_FLAGGED}, n AS (SELECT count(*) AS n FROM told)
      SELECT 1::BIGINT AS line_no, '{{"version":"https://jsonfeed.org/version/1.1","title":"Newly flagged servers","home_page_url":"{SITE}/","feed_url":"{SITE}/feed.json","description":"Servers whose score has just fallen below 100.","items":[' AS line
      UNION ALL SELECT 1 + ordinal, CAST(json_object('id', url, 'url', url, 'title', name, 'content_text', story, 'date_published', iso) AS VARCHAR) || CASE WHEN ordinal < n THEN ',' ELSE '' END FROM told, n UNION ALL SELECT 2 + n, ']}}' FROM n""",
    "feed_rss": f"""WITH {_FLAGGED}, n AS (SELECT count(*) AS n FROM told)
      SELECT unnest(range(1, 9)) AS line_no, unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom">', '<channel>', '<title>Newly flagged servers</title>', '<link>{SITE}/</link>',
        '<description>Servers whose score has just fallen below 100.</description>', '<language>en</language>', '<atom:link href="{SITE}/feed.xml" rel="self" type="application/rss+xml"/>']) AS line
      UNION ALL SELECT 8 + ordinal, '<item><title>' || name || '</title><link>' || url || '</link><guid isPermaLink="true">' || url || '</guid><pubDate>' || day || '</pubDate><description>' || story || '</description></item>' FROM told
      UNION ALL SELECT 9 + n, '</channel>' FROM n UNION ALL SELECT 10 + n, '</rss>' FROM n""",
    "text_report": f"WITH RECURSIVE {_F} SELECT '[' || rpad(upper(severity), 8, ' ') || '] ' || rule_id || '  ' || CASE WHEN length(name) < 30 THEN rpad(name, 30, ' ') ELSE name END || '  ' || title AS line FROM findings",
    "search_index": f"WITH {_SCORED} SELECT name, score FROM scored",
    "sitemap": f"""WITH {_INDEX}, p AS (SELECT greatest(1, CAST(ceil(count(*) / 100.0) AS BIGINT)) AS n FROM idx), u AS (
      SELECT 0 AS g, 1::BIGINT AS k, '{SITE}/' AS url, NULL::BIGINT AS modified_us, 'daily' AS change_frequency, 1.0::DOUBLE AS priority UNION ALL SELECT 0, 2, '{SITE}/typosquats', NULL, 'daily', 0.7
      UNION ALL SELECT 1, i, '{SITE}/browse/' || i, NULL, 'daily', CASE WHEN i = 1 THEN 0.8 ELSE 0.5 END FROM (SELECT unnest(range(1, n + 1)) AS i FROM p)
      UNION ALL SELECT 2, o, '{SITE}/typosquats/' || known, NULL, 'weekly', 0.4 FROM (SELECT unnest({_LIST}) AS known, unnest(range({len(_KNOWN)})) AS o)
      UNION ALL SELECT 3, row_number() OVER (ORDER BY name), '{SITE}/servers/' || name, epoch_us(computed_at), 'daily', CASE WHEN score < 100 THEN 0.6 ELSE 0.3 END FROM idx)
      SELECT row_number() OVER (ORDER BY g, k) AS ordinal, url, modified_us, change_frequency, priority FROM u QUALIFY row_number() OVER (ORDER BY g, k) <= 49000""",
    "badges": f"""WITH {_SCORED} SELECT name, score, {_COLOR} AS color, '<svg xmlns="http://www.w3.org/2000/svg" width="96" height="20" role="img" aria-label="score: ' || score || '"><rect width="62" height="20" fill="#555"/><rect x="62" width="34" height="20" fill="'
      || {_COLOR} || '"/><text x="31" y="14">score</text><text x="79" y="14">' || score || '</text></svg>' AS svg FROM scored""",
    "stratified_review": f"""WITH {_SCORED}, st AS (SELECT server_id, CASE WHEN score < 40 THEN 'rare' WHEN score < 100 THEN 'flagged' ELSE 'clean' END AS stratum, md5('16:' || server_id) AS mixed FROM scored)
      SELECT server_id, stratum FROM st QUALIFY stratum = 'rare' OR row_number() OVER (PARTITION BY stratum ORDER BY mixed, server_id) <= 25""",
    "allowlist_init": f"WITH {_ID}, {_ALLOW.format(where='true')} SELECT * FROM allow",
    "allowlist_unlisted": f"WITH {_ID}, {_ALLOW.format(where=_LISTED)} SELECT identity AS server, count(*) AS configs FROM servers_ WHERE identity NOT IN (SELECT name FROM allow) GROUP BY 1",
    "version_drift": f"""WITH {_ID}, {_ALLOW.format(where=_LISTED)}, d AS (SELECT identity, coalesce(digest, version) AS pinned, CASE WHEN digest IS NOT NULL THEN resolved_digest ELSE resolved_version END AS found FROM servers_ s JOIN allow a ON a.name = s.identity)
      SELECT identity AS server, identity || ' is pinned to ' || pinned || ' but resolves to ' || coalesce(found, 'nothing') AS detail, count(*) AS configs FROM d WHERE pinned IS NOT NULL AND found IS DISTINCT FROM pinned GROUP BY 1, 2""",
    "blocked_registry": f"""WITH t AS (SELECT list_filter({BLOCKED!r}, lambda b: contains(coalesce(array_to_string(command, ' '), ''), b) OR contains(coalesce(url, ''), b)) AS hits FROM server_configs)
      SELECT 'uses blocked registry ' || hits[1] AS detail, count(*) AS configs FROM t WHERE len(hits) > 0 GROUP BY 1""",
    "baseline_new_findings": f"WITH RECURSIVE {_F} SELECT name AS server, rule_id, severity FROM findings WHERE severity IN ('high', 'critical') AND rule_id = 'MCP-STATIC-006'",
}
