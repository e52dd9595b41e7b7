"""Publication: slugs, ordinals and pages, search, feeds, reports and exported artifacts."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import launch
from heddle.operators import typosquat
from heddle.operators.rules import SEVERITY_RANK, rank
from heddle.session import materialise, with_ordinal

# ---- fixed values ----
PAGE_ROWS = 100
SEARCH_ROWS = 20
SITEMAP_ROWS = 49_000
#: Change frequency and priority of the sitemap's pages: start pages, browse pages (first, others),
#: look-alike pages, servers (flagged, clean).
SITEMAP_START = (("/", "daily", 1.0), ("/typosquats", "daily", 0.7))
SITEMAP_BROWSE = ("daily", 0.8, 0.5)
SITEMAP_ALIKE = ("weekly", 0.4)
SITEMAP_SERVER = ("daily", 0.6, 0.3)
RARE_RULES = ("MCP-STATIC-003", "MCP-STATIC-004")
SARIF_LEVEL = {"low": "note", "medium": "warning", "high": "error", "critical": "error"}
SECURITY_SEVERITY = {"low": "2.5", "medium": "5.5", "high": "7.5", "critical": "9.5"}
# ---- end of fixed values ----


def slugs(names: DataFrame) -> DataFrame:
    """(name, slug): file-safe and unique without case; later names of a clash, in name order,
    get a hash suffix. Ranked within each clash, so the work stays parallel."""
    base = launch.slug_base(F.col("name"))
    w = Window.partitionBy("folded").orderBy("name")
    return (
        names.select("name").where("name IS NOT NULL").distinct().withColumn("base", base).withColumn("folded", F.lower("base"))
        .withColumn("r", F.row_number().over(w))
        .select("name", F.when(F.col("r") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"),
            F.left(F.sha1("name"), F.lit(8)))).alias("slug"))
    )


def leaderboard(scored: DataFrame) -> DataFrame:
    """Flagged servers (score below 100) numbered by score, then name."""
    return with_ordinal(scored.where("score < 100").select("name", "score", "finding_count"), [F.col("score"), F.col("name")])


def pages(scored: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    """All servers by name with their page of ``rows``."""
    return with_ordinal(scored.select("name", "score"), [F.col("name")]).withColumn("page", ((F.col("ordinal") - 1) / rows).cast("int") + 1)


def search(names: DataFrame, query: str, rows: int = SEARCH_ROWS) -> DataFrame:
    """The first ``rows`` names that hold the trimmed query, by place of the match, then name."""
    q = query.strip().lower()
    hit = names.select("name", F.instr(F.lower("name"), q).alias("position")).where(F.col("position") > 0)
    return hit.orderBy("position", "name").limit(rows)


def stratified_sample(df: DataFrame, key: str, stratum: Column, sizes: dict[str, int], seed: int) -> DataFrame:
    """A seeded sample of so many rows per stratum, the same in any plan; -1 keeps all.

    Rows are ranked by a seeded hash of the key, of any type, within each stratum (the
    partial limit of ranked windows keeps few rows per task before the shuffle). Rows with a
    null key are sampled last.
    """
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    w = Window.partitionBy("stratum").orderBy(F.asc_nulls_last("mixed"), key)
    limit = F.coalesce(*[F.when(F.col("stratum") == k, F.lit(v if v >= 0 else 2**31 - 1)) for k, v in sizes.items()], F.lit(0))
    most = max([v for v in sizes.values() if v >= 0], default=0)
    rows = df.withColumn("stratum", stratum).withColumn("mixed", mixed)
    all_of = [k for k, v in sizes.items() if v < 0]
    ranked = rows.where(~F.col("stratum").isin(all_of) if all_of else F.lit(True)).withColumn("r",
        F.row_number().over(w)).where(F.col("r") <= most).where(F.col("r") <= limit).drop("r")
    return (ranked.unionByName(rows.where(F.col("stratum").isin(all_of))) if all_of else ranked).drop("mixed")


def utc(at: Column, pattern: str) -> Column:
    """An instant's text in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), pattern)


def iso(at: Column) -> Column:
    return F.concat(utc(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def as_document(spark: SparkSession, *parts: list[str] | DataFrame) -> DataFrame:
    """(line_no, line): one document out of fixed lines and rows.

    A part is a list of lines or a table of (ordinal, line) numbered from one, whose lines but
    the last get a comma if they are JSON. The rows stay distributed; the document is the
    lines in order, however it is written.
    """
    out, at = [], 0
    for part in parts:
        if isinstance(part, list):
            out.append(spark.createDataFrame([(at + i, x) for i, x in enumerate(part, 1)], "line_no long, line string"))
            at += len(part)
        else:
            rows = part.agg(F.max("ordinal")).first()[0] or 0
            comma = F.when(F.startswith("line", F.lit("{")) & (F.col("ordinal") < rows), ",").otherwise("")
            out.append(part.select((F.col("ordinal") + at).alias("line_no"), F.concat("line", comma).alias("line")))
            at += rows
    return reduce(DataFrame.unionByName, out)


def index(servers: DataFrame, scores: DataFrame) -> DataFrame:
    """(server_id, name, slug, score, finding_count, computed_at): every server that has a score,
    with its latest one. ``scores``: server_id, score, finding_count, computed_at."""
    rows = servers.select(F.col("id").alias("server_id"), "name").where("name IS NOT NULL").join(scores, "server_id")
    return rows.join(slugs(rows), "name").select("server_id", "name", "slug", "score", "finding_count", "computed_at")


def totals(scored: DataFrame) -> DataFrame:
    """One row: servers in all, flagged (score below 100) and clean."""
    return scored.agg(F.count("*").alias("servers"), F.count_if(F.col("score") < 100).alias("flagged"),
        F.count_if(F.col("score") >= 100).alias("clean"))


def flagged_entries(pairs: DataFrame, index_: DataFrame) -> DataFrame:
    """(ordinal, name, slug, score, previous_score, finding_count, computed_at): what
    ``state.newly_flagged`` gives, latest first, then by name; servers the index lacks are left out."""
    rows = pairs.join(index_.select("server_id", "name", "slug"), "server_id")
    rows = rows.select("name", "slug", "score", "previous_score", "finding_count", "computed_at")
    return with_ordinal(rows, [F.desc("computed_at"), F.col("name")])


def _story(before: Column, score: Column, findings: Column) -> Column:
    fell = F.when(before.isNull(), "First score").otherwise(F.concat(F.lit("Score fell from "), before.cast("string"), F.lit(" to")))
    return F.concat(fell, F.lit(" "), score.cast("string"), F.lit(", findings: "), findings.cast("string"))


def json_feed(flagged: DataFrame, site: str) -> DataFrame:
    """(line_no, line) of a JSON Feed 1.1 of newly flagged servers."""
    url = F.concat(F.lit(site), launch.href("/servers/", F.col("name")))
    item = F.struct(
        url.alias("id"), url.alias("url"), F.col("name").alias("title"), _story(F.col("previous_score"), F.col("score"),
            F.col("finding_count")).alias("content_text"), iso(F.col("computed_at")).alias("date_published")
    )
    head = f'{{"version":"https://jsonfeed.org/version/1.1","title":"Newly flagged servers","home_page_url":"{site}/","feed_url":"{site}/feed.json","description":"Servers whose score has just fallen below 100.","items":['
    return as_document(flagged.sparkSession, [head], flagged.select("ordinal", F.to_json(item).alias("line")), ["]}"])


def rss(flagged: DataFrame, site: str) -> DataFrame:
    """(line_no, line) of an RSS 2.0 feed of newly flagged servers."""
    url = launch.xml_escape(F.concat(F.lit(site), launch.href("/servers/", F.col("name"))))
    item = F.format_string(
        '<item><title>%s</title><link>%s</link><guid isPermaLink="true">%s</guid><pubDate>%s</pubDate><description>%s</description></item>',
        launch.xml_escape(F.col("name")), url, url, utc(F.col("computed_at"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
            launch.xml_escape(_story(F.col("previous_score"), F.col("score"), F.col("finding_count"))),
    )
    head = [
        '<?xml version="1.0" encoding="UTF-8"?>', '<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom">', "<channel>",
        "<title>Newly flagged servers</title>", f"<link>{site}/</link>",
        "<description>Servers whose score has just fallen below 100.</description>", "<language>en</language>",
        f'<atom:link href="{site}/feed.xml" rel="self" type="application/rss+xml"/>',
    ]
    return as_document(flagged.sparkSession, head, flagged.select("ordinal", item.alias("line")), ["</channel>", "</rss>"])


def clusters(candidates: DataFrame, index_: DataFrame, known: list[str], max_distance: int = typosquat.MAX_DISTANCE) -> DataFrame:
    """(known_name, known_slug, position, identifier, distance, server_name, server_slug).

    Servers whose package is near a known name, numbered by distance, package and server; every
    known name has a row, with nulls where nothing is near. ``candidates``: server_name,
    identifier. A server that is not in the index has no slug. One row per server, however
    many share a package.
    """
    near = typosquat.known_neighbours(candidates, known, max_distance).where("identifier IS NOT NULL")
    rows = near.join(candidates.select("server_name", "identifier").distinct(),
        "identifier").join(index_.select(F.col("name").alias("server_name"), F.col("slug").alias("server_slug")), "server_name", "left")
    numbered = with_ordinal(rows, [F.col(c) for c in ("known_name", "distance", "identifier", "server_name")])
    first = numbered.groupBy("known_name").agg((F.min("ordinal") - 1).alias("shift"))
    placed = numbered.join(first, "known_name").withColumn("position", F.col("ordinal") - F.col("shift")).drop("ordinal", "shift")
    all_known = candidates.sparkSession.createDataFrame([(k,) for k in known], "known_name string")
    return all_known.join(placed, "known_name", "left").select(
        "known_name", launch.slug_base(F.col("known_name")).alias("known_slug"), "position", "identifier", "distance", "server_name",
        "server_slug"
    )


def with_neighbours(clustered: DataFrame) -> DataFrame:
    """(known_name, neighbours): only known names that have any."""
    return clustered.where("identifier IS NOT NULL").groupBy("known_name").agg(F.count("*").alias("neighbours"))


def sitemap(index_: DataFrame, known: list[str], site: str, rows: int = SITEMAP_ROWS, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(ordinal, url, last_modified, change_frequency, priority): the first ``rows`` (the format's
    limit) of the start pages, browse pages, look-alike pages and servers by name."""
    spark = index_.sparkSession
    entry = "grp int, pos long, url string, last_modified timestamp, change_frequency string, priority double"
    start = [(0, i, site + path, None, often, weight) for i, (path, often, weight) in enumerate(SITEMAP_START, 1)]
    pages_ = max(1, -(-index_.count() // page_rows))
    often, first, other = SITEMAP_BROWSE
    browse = spark.range(1, pages_ + 1).select(
        F.lit(1).alias("grp"), F.col("id").alias("pos"), F.concat(F.lit(f"{site}/browse/"), F.col("id").cast("string")).alias("url"),
        F.lit(None).cast("timestamp").alias("last_modified"), F.lit(often).alias("change_frequency"),
        F.when(F.col("id") == 1, first).otherwise(other).alias("priority"),
    )
    names = spark.createDataFrame([(i, k) for i, k in enumerate(known, 1)], "pos long, name string")
    often, weight = SITEMAP_ALIKE
    alike = names.select(
        F.lit(2).alias("grp"), "pos", F.concat(F.lit(site), launch.href("/typosquats/", F.col("name"))).alias("url"),
        F.lit(None).cast("timestamp").alias("last_modified"), F.lit(often).alias("change_frequency"), F.lit(weight).alias("priority"),
    )
    often, flagged, clean = SITEMAP_SERVER
    servers = with_ordinal(index_.select("name", "score", "computed_at"), [F.col("name")]).select(
        F.lit(3).alias("grp"), F.col("ordinal").alias("pos"), F.concat(F.lit(site), launch.href("/servers/", F.col("name"))).alias("url"),
        F.col("computed_at").alias("last_modified"), F.lit(often).alias("change_frequency"),
        F.when(F.col("score") < 100, flagged).otherwise(clean).alias("priority"),
    )
    whole = reduce(DataFrame.unionByName, [spark.createDataFrame(start, entry), browse, alike, servers])
    shift = F.coalesce(*[F.when(F.col("grp") == g, F.lit(n)) for g, n in ((0, 0), (1, 2), (2, 2 + pages_), (3, 2 + pages_ + len(known)))])
    return whole.withColumn("ordinal", (F.col("pos") + shift).cast("long")).where(F.col("ordinal") <= rows).select("ordinal", "url",
        "last_modified", "change_frequency", "priority")


def server_documents(index_: DataFrame, findings: DataFrame, key: str = "server_id") -> DataFrame:
    """(name, slug, document): a server's page as JSON, with one finding per rule."""
    fields = ("rule_id", "title", "severity", "confidence", "owasp", "detail", "recommendation")
    listed = findings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("findings"))
    none = F.array().cast(dict(listed.dtypes)["findings"])
    document = F.struct("name", "score", "finding_count", iso(F.col("computed_at")).alias("computed_at"),
        F.coalesce("findings", none).alias("findings"))
    return index_.join(listed, key, "left").select("name", "slug", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def badge_svg(score: Column, label: str = "score") -> Column:
    text = '<svg xmlns="http://www.w3.org/2000/svg" width="96" height="20" role="img" aria-label="%s: %d"><rect width="62" height="20" fill="#555"/><rect x="62" width="34" height="20" fill="%s"/><text x="31" y="14">%s</text><text x="79" y="14">%d</text></svg>'
    return F.format_string(text, F.lit(label), score, launch.badge_color(score), F.lit(label), score)


def sarif_results(findings: DataFrame) -> DataFrame:
    """(ordinal, line): one SARIF result per finding, by place, rule and detail."""
    level = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in SARIF_LEVEL.items()], F.lit("warning"))
    where = F.substring_index("location", " :: ", 1)
    uri = F.replace(F.when(where == "", F.lit("config")).otherwise(where), F.lit("\\"), F.lit("/"))
    server = F.substring_index("location", " :: ", -1)
    message = F.struct(F.format_string("%s (%s) — %s", F.col("title"), server, F.col("detail")).alias("text"))
    place = F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    result = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), message.alias("message"), place.alias("locations")))
    rows = findings.select("location", "rule_id", "detail", F.monotonically_increasing_id().alias("tie"), result.alias("line"))
    return with_ordinal(rows, [F.col(c) for c in ("location", "rule_id", "detail", "tie")]).select("ordinal", "line")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(ordinal, line): each rule that has findings once, by id."""
    sev = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in SECURITY_SEVERITY.items()], F.lit("5.5"))
    one = findings.groupBy("rule_id").agg(F.min(F.struct("title", "severity", "owasp")).alias("r")).select("rule_id", "r.*")
    props = F.map_from_arrays(F.array(F.lit("security-severity"), F.lit("owasp")), F.array(sev, F.coalesce("owasp", F.lit(""))))
    rule = F.to_json(F.struct(F.col("rule_id").alias("id"), F.col("title").alias("name"),
        F.struct(F.col("title").alias("text")).alias("shortDescription"), props.alias("properties")))
    return with_ordinal(one.select("rule_id", rule.alias("line")), [F.col("rule_id")]).select("ordinal", "line")


def sarif(findings: DataFrame, tool: str, information: str) -> DataFrame:
    """(line_no, line) of one SARIF 2.1.0 document; the findings are written once before."""
    findings = materialise(findings.select("rule_id", "title", "severity", "owasp", "location", "detail"))
    head = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","informationUri":"{information}","rules":['
    return as_document(findings.sparkSession, [head], sarif_rules(findings), [']}},"results":['], sarif_results(findings), ["]}]}"])


def json_result(targets: list[str], configs: DataFrame, findings: DataFrame) -> DataFrame:
    """(line_no, line) of a scan's result as one JSON object: targets, servers and findings."""
    spark, null = configs.sparkSession, {"ignoreNullFields": "false"}
    raw = F.try_parse_json(F.col("raw"))
    servers = configs.select("source", "name", F.to_json(F.struct("name", "transport", "command", "url", "env", "source",
        raw.alias("raw")), null).alias("line"), F.monotonically_increasing_id().alias("tie"))
    server = F.substring_index("location", " :: ", -1)
    rows = findings.select("location", "rule_id", F.to_json(F.struct("rule_id", "title", "severity", "confidence", "owasp", "phase",
        server.alias("server"), "location", "detail", "recommendation"), null).alias("line"), F.monotonically_increasing_id().alias("tie"))
    by = lambda df, *cols: with_ordinal(df, [F.col(c) for c in (*cols, "tie")]).select("ordinal", "line")
    head = '{"targets":' + json.dumps(targets) + ',"servers":['
    return as_document(spark, [head], by(servers, "source", "name"), ['],"findings":['], by(rows, "location", "rule_id"), ["]}"])


def review_packet(index_: DataFrame, findings: DataFrame, flagged: int, clean: int, seed: int, rare: tuple[str, ...] = RARE_RULES,
    key: str = "server_id") -> DataFrame:
    """(ordinal, name, score, finding_count, stratum, rules, link): servers to check by hand.

    All with a rare rule, a seeded sample of the other flagged ones and of the clean ones; most
    findings first, then by name. The link is the forge account a name stands for, else the
    package a finding names, else null.
    """
    per = findings.groupBy(key).agg(F.array_sort(F.collect_set("rule_id")).alias("ids"),
        F.min(F.nullif(F.regexp_extract("detail", 'npm package "([^"]+)"', 1), F.lit(""))).alias("package"))
    rows = index_.select(key, "name", "score", "finding_count").join(per, key, "left")
    stratum = F.when(F.arrays_overlap("ids", F.array(*map(F.lit, rare))), "rare-rule").when(F.col("finding_count") > 0,
        "flagged").otherwise("clean")
    picked = stratified_sample(rows, "name", stratum, {"rare-rule": -1, "flagged": flagged, "clean": clean}, seed)
    forge = F.regexp_extract("name", r"^io\.github\.([^/]+)/(.+)$", 1)
    link = F.when(forge != "", F.concat(F.lit("https://github.com/"), forge, F.lit("/"),
        F.regexp_extract("name", r"^io\.github\.([^/]+)/(.+)$", 2))).otherwise(F.concat(F.lit("https://www.npmjs.com/package/"),
        F.col("package")))
    out = picked.select("name", "score", "finding_count", "stratum", F.coalesce(F.array_join("ids", ", "), F.lit("")).alias("rules"),
        link.alias("link"))
    return with_ordinal(out, [F.desc("finding_count"), F.col("name")])


def review_lines(packet: DataFrame, title: str) -> DataFrame:
    """(line_no, line) of the packet as Markdown with a verdict to fill in."""
    cell = lambda c, none: F.replace(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none)), F.lit("|"), F.lit("\\|"))
    line = F.concat_ws(" | ", F.concat(F.lit("| "), F.col("ordinal").cast("string")), cell("name", ""), F.col("score").cast("string"),
        F.col("stratum"), cell("rules", "-"), cell("link", "-"), F.lit("open |"))
    head = [f"# {title}", "", "| # | server | score | stratum | rules | link | verdict |", "|---|---|---|---|---|---|---|"]
    return as_document(packet.sparkSession, head, packet.select("ordinal", line.alias("line")))


def text_lines(findings: DataFrame) -> DataFrame:
    """(line): one line per finding; names are padded to a column and never cut."""
    server = F.substring_index("location", " :: ", -1)
    padded = F.rpad(server, F.greatest(F.lit(30), F.length(server)), " ")
    return findings.select(F.format_string("[%-8s] %s  %s  %s", F.upper("severity"), F.col("rule_id"), padded,
        F.col("title")).alias("line"))


def markdown_report(violations: DataFrame) -> DataFrame:
    """(line_no, line) of violations as a Markdown table under their number, in the order of
    their lists, then worst and by server; bars in texts are escaped."""
    rows = materialise(violations)
    n = rows.count()
    if not n:
        return as_document(rows.sparkSession, ["No violations."])
    cell = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("severity"), F.col("kind"), cell("server"), cell("detail")), F.lit(" |"))
    worst = (-F.coalesce(rank(F.col("severity"), SEVERITY_RANK), F.lit(99))).alias("worst")
    table = rows.select("part", worst, "server", "detail", F.monotonically_increasing_id().alias("tie"), line.alias("line"))
    numbered = with_ordinal(table, [F.col(c) for c in ("part", "worst", "server", "detail", "tie")])
    return as_document(rows.sparkSession, [f"{n} violation(s)", "", "| severity | kind | server | detail |", "|---|---|---|---|"],
        numbered.select("ordinal", "line"))


def write_sharded(documents: DataFrame, name: str, path: str) -> None:
    """Write documents partitioned by the name's shard, one directory each."""
    documents.withColumn("shard", launch.shard(F.col(name))).repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)


def severity_at_least(severity: Column, least: str) -> Column:
    """Gate by rank; an unknown severity fails the gate."""
    return F.coalesce(rank(severity, SEVERITY_RANK), F.lit(99)) >= SEVERITY_RANK[least]
