"""Client configuration files and registry pages as DataFrames of launch configurations."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import launch
from heddle.functions.python_udfs import shell_words
from heddle.session import ship

# ---- fixed values: where clients keep their configuration ----
PROJECT_FILES = (".mcp.json", "opencode.json", "opencode.jsonc")
USER_FILES = (".claude.json", ".mcp.json", ".cursor/mcp.json", ".codeium/windsurf/mcp_config.json", ".gemini/mcp.json",
    ".config/opencode/opencode.json")
MAC_FILE = "Library/Application Support/Claude/claude_desktop_config.json"
WINDOWS_FILE = "Claude/claude_desktop_config.json"
REMOTE_TYPES = ("http", "sse", "remote", "streamable-http")
# ---- end of fixed values ----


def discover(project: str, home: str | None = None, system: str = "", app_data: str = "") -> list[str]:
    """Existing configuration files: the project's, then those in the user's ``home``, if given.

    ``system`` is the platform's name (Darwin, Windows); ``app_data`` the folder of
    applications' data on Windows.
    """
    found = [Path(project) / f for f in PROJECT_FILES]
    if home:
        found += [Path(home) / f for f in USER_FILES]
        if system == "Darwin":
            found.append(Path(home) / MAC_FILE)
        elif system == "Windows" and app_data:
            found.append(Path(app_data) / WINDOWS_FILE)
    return [str(p) for p in found if p.is_file()]


def normalise_entries(entries: DataFrame, raw: str = "raw") -> DataFrame:
    """entries with transport, command, url and env from the entry's JSON in ``raw``.

    command is a list or a shell line, followed by args; env may be called environment and
    its values become strings; entries without a type are remote if they have a url. Entries that are no JSON objects get empty fields.
    """
    ship(entries.sparkSession)
    get = lambda p: F.get_json_object(raw, f"$.{p}")
    strings = lambda c: F.coalesce(F.from_json(F.when(F.ltrim(c).startswith("["), c), "array<string>"),
        F.array().cast("array<string>"))
    line = get("command")
    is_list, quoted = F.ltrim(line).startswith("["), line.rlike(r"""["'\\]""")
    # Only lines with quotes or escapes need the shell's rules.
    hard = entries.withColumn("shell__", F.when(~is_list & quoted, line)).withColumn("shell__", shell_words("shell__"))
    plain = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    words = F.when(line.isNull(), F.array().cast("array<string>")).when(is_list, strings(line)).when(quoted,
        F.col("shell__")).otherwise(plain)
    own = get("env")
    env = F.when(F.regexp_replace(own, r"\s", "") != "{}", own)  # an empty one counts as none
    env = F.coalesce(env, get("environment"), own)
    kind = get("type")
    remote = kind.isin(*REMOTE_TYPES) | (kind.isNull() & (F.coalesce(get("url"), F.lit("")) != ""))
    return hard.select(
        *[c for c in entries.columns],
        F.when(remote, "http").otherwise("stdio").alias("transport"),
        F.concat(words, strings(get("args"))).alias("command"),
        get("url").alias("url"),
        F.coalesce(F.from_json(F.when(F.ltrim(env).startswith("{"), env), "map<string,string>"),
            F.create_map().cast("map<string,string>")).alias("env"),
    )


def load_configs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, name, raw, transport, command, url, env) of every enabled entry of the files.

    ``mcpServers``, else ``mcp``, maps names to entries; comments and trailing commas are
    allowed in .jsonc files. Broken files and entries that are no objects give nothing.
    """
    if not paths:
        empty = spark.createDataFrame([], "source string, name string, raw string")
        return normalise_entries(empty)
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"))
    clean = F.when(F.col("source").endswith(".jsonc"),
        launch.strip_trailing_commas(launch.strip_json_comments(F.col("value")))).otherwise(F.col("value"))
    entries = lambda p: F.from_json(F.get_json_object(clean, p), "map<string,string>")
    first = entries("$.mcpServers")
    chosen = F.when(F.coalesce(F.size(first), F.lit(0)) > 0, first).otherwise(entries("$.mcp"))
    rows = files.select("source", F.explode(chosen).alias("name", "raw"))
    # Only the JSON value false switches an entry off, no text does.
    flag = F.try_variant_get(F.try_parse_json("raw"), "$.enabled", "variant")
    off = F.coalesce((F.schema_of_variant(flag) == "BOOLEAN") & ~F.try_variant_get(flag, "$", "boolean"), F.lit(False))
    return normalise_entries(rows.where(F.ltrim("raw").startswith("{") & ~off))


def registry_targets(entries: DataFrame, key: str = "entry_id", text: str = "raw_json") -> DataFrame:
    """One row per package or remote of a registry page's entries.

    (key, kind, pos, name, version, registry_type, identifier, transport, url, sha256,
    is_latest, status, published_at, runtime_arguments, package_arguments,
    environment_variables, raw_json); the last four are JSON. Entries encoded twice are decoded; broken ones give
    nothing; transports may be strings or objects; a remote's kind is its type, else transport.
    """
    once = F.col(text)
    decoded = F.when(F.ltrim(once).startswith('"'), F.try_variant_get(F.try_parse_json(once), "$", "string")).otherwise(once)
    rows = entries.select(F.col(key), F.try_parse_json(decoded).alias("v")).where("v IS NOT NULL")
    s = lambda p: F.try_variant_get("v", p, "string")
    meta = "$._meta['io.modelcontextprotocol.registry/official']"
    head = rows.select(key, s("$.server.name").alias("name"), s("$.server.version").alias("version"),
        s(meta + ".isLatest").cast("boolean").alias("is_latest"),
        s(meta + ".status").alias("status"), F.try_to_timestamp(s(meta + ".publishedAt")).alias("published_at"),
        F.try_variant_get("v", "$.server.packages", "array<variant>").alias("packages"),
            F.try_variant_get("v", "$.server.remotes", "array<variant>").alias("remotes"))
    shared = (key, "name", "version", "is_latest", "status", "published_at")
    g = lambda p: F.try_variant_get("x", p, "string")
    transport = lambda: F.coalesce(g("$.transport.type"), _plain(g("$.transport")))
    null = F.lit(None).cast("string")
    part = lambda p: F.to_json(F.try_variant_get("x", p, "variant"))
    own = lambda remote: [F.when(~F.lit(remote), part(f"$.{p}")).alias(n) for n,
        p in (("runtime_arguments", "runtimeArguments"), ("package_arguments", "packageArguments"),
        ("environment_variables", "environmentVariables"))] + [F.to_json("x").alias("raw_json")]
    some = F.col("x").isNotNull() & ~F.is_variant_null("x")
    packages = head.select(*shared, F.posexplode("packages").alias("pos", "x")).where(some).select(
        *shared, F.lit("package").alias("kind"), "pos", g("$.registryType").alias("registry_type"), g("$.identifier").alias("identifier"),
            transport().alias("transport"), null.alias("url"), g("$.fileSha256").alias("sha256"), *own(False)
    )
    remotes = head.select(*shared, F.posexplode("remotes").alias("pos", "x")).where(some).select(
        *shared, F.lit("remote").alias("kind"), "pos", F.lit("remote").alias("registry_type"), g("$.url").alias("identifier"),
            F.coalesce(g("$.type"), _plain(g("$.transport"))).alias("transport"), g("$.url").alias("url"), null.alias("sha256"), *own(True)
    )
    return packages.unionByName(remotes)


def registry_servers(entries: DataFrame, text: str = "raw_json") -> DataFrame:
    """(name, title, description, website_url, repository_url, raw_json) of a page's entries."""
    once = F.col(text)
    decoded = F.when(F.ltrim(once).startswith('"'), F.try_variant_get(F.try_parse_json(once), "$", "string")).otherwise(once)
    rows = entries.select(F.try_parse_json(decoded).alias("v")).where("v IS NOT NULL")
    s = lambda p: F.try_variant_get("v", f"$.server.{p}", "string")
    return rows.select(
        s("name").alias("name"), s("title").alias("title"), s("description").alias("description"), s("websiteUrl").alias("website_url"),
            s("repository.url").alias("repository_url"), F.to_json("v").alias("raw_json")
    )


def _plain(c: Column) -> Column:
    """A string member; an object's text is none."""
    return F.when(~c.startswith("{"), c)


def version_configs(versions: DataFrame) -> DataFrame:
    """Launch configurations of registry versions: (version_id, version, transport, command, url, env, raw)."""
    remote = F.coalesce(F.col("registry_type"), F.lit("")) == "remote"
    c = F.col
    return versions.select(
        c("id").alias("version_id"),
        c("version"),
        F.when(remote | c("transport").isin(*launch.HTTP_TRANSPORTS), "http").otherwise("stdio").alias("transport"),
        launch.launch_command(c("registry_type"), c("identifier"), c("version"), c("runtime_arguments"),
            c("package_arguments")).alias("command"),
        F.when(remote, c("identifier")).alias("url"),
        launch.environment_map(c("environment_variables")).alias("env"),
        c("raw_json").alias("raw"),
    )
