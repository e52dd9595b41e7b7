"""Column builders over launch configurations and names; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: launchers, flags that take a value, shards ----
LAUNCHERS = {"npm": ["npx", "-y"], "pypi": ["uvx"], "oci": ["docker", "run"], "cargo": ["cargo", "run", "--"],
    "nuget": ["dotnet", "tool", "run"], "mcpb": []}
PINNED_TYPES = ("npm", "pypi")
HTTP_TRANSPORTS = ("http", "sse", "streamable-http")
OCI_VALUE_FLAGS = (
    "-e", "--env", "--env-file", "-p", "--publish", "-v", "--volume", "--name", "-w", "--workdir", "--network", "--entrypoint",
    "-u", "--user", "--mount", "-l", "--label", "--hostname", "-m", "--memory", "--cpus", "--restart", "--platform",
)
SHARDS = 64
#: Badge colours from a score on; below, the last one.
BADGE_COLORS = ((90, "#4c1"), (70, "#dfb317"))
BADGE_LOW = "#e05d44"
# ---- end of fixed values ----

_EMPTY = "array<string>"


def command_text(command: Column) -> Column:
    return F.coalesce(F.array_join(command, " "), F.lit(""))


def env_text(env: Column) -> Column:
    """``NAME=value`` lines in the map's order; null values are empty."""
    lines = F.transform(F.map_entries(env), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def raw_text(raw: Column) -> Column:
    """JSON with its members sorted; other texts as they are."""
    return F.coalesce(F.to_json(F.try_parse_json(raw)), raw, F.lit(""))


def package_spec(command: Column) -> Column:
    """First word after the first npx/uvx that is no flag; null without one."""
    at = F.array_position(F.transform(command, lambda x: x.isin("npx", "uvx")), True)
    tail = F.slice(command, (at + 1).cast("int"), F.size(command))
    return F.when(at > 0, F.get(F.filter(tail, lambda x: ~x.startswith("-")), F.lit(0)))


def package_name_of(spec: Column) -> Column:
    """The spec without its version; a leading scope's @ is part of the name."""
    return F.nullif(F.regexp_extract(spec, r"^(@[^/]*$|@[^/]*/[^@]*|[^@]*)", 1), F.lit(""))


def package_name(command: Column) -> Column:
    return package_name_of(package_spec(command))


def package_version_of(spec: Column, name: Column) -> Column:
    return F.nullif(F.substr(spec, F.length(name) + 2), F.lit(""))


def oci_image_ref(command: Column) -> Column:
    """First word after the first ``docker run`` that is no flag nor a flag's value."""
    n = F.size(command)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (F.get(command, i - 1) == "docker") & (F.get(command,
        i) == "run"))
    at = F.array_position(pairs, True)
    tail = F.slice(command, (at + 2).cast("int"), F.greatest(n, F.lit(0)))
    start = F.struct(F.lit(False).alias("skip"), F.lit(None).cast("string").alias("ref"))
    step = lambda s, t: (
        F.when(s["ref"].isNotNull(), s)
        .when(s["skip"], F.struct(F.lit(False).alias("skip"), s["ref"].alias("ref")))
        .when(t.startswith("-"), F.struct(t.isin(*OCI_VALUE_FLAGS).alias("skip"), s["ref"].alias("ref")))
        .otherwise(F.struct(F.lit(False).alias("skip"), t.alias("ref")))
    )
    return F.when(at > 0, F.aggregate(tail, start, step)["ref"])


def oci_tag(ref: Column) -> Column:
    """Tag in the last path segment; null without one (a host's port is none)."""
    last = F.substring_index(ref, "/", -1)
    return F.when(F.instr(last, ":") > 0, F.substring_index(last, ":", -1))


def oci_image_name(ref: Column) -> Column:
    return F.when(F.contains(ref, F.lit("@sha256:")), F.substring_index(ref, "@sha256:", 1)).when(
        oci_tag(ref).isNotNull(), F.left(ref, F.length(ref) - F.length(oci_tag(ref)) - 1)
    ).otherwise(ref)


def oci_digest(ref: Column) -> Column:
    return F.when(F.contains(ref, F.lit("@sha256:")), F.concat(F.lit("sha256:"), F.substr(ref, F.instr(ref, "@sha256:") + 8)))


def identity_of(package: Column, image: Column, name: Column, transport: Column, url: Column, source: Column) -> Column:
    """Package, else image, else an http server's host, else the name, else the source."""
    host = F.when(transport == "http", F.lower(F.try_parse_url(url, F.lit("HOST"))))
    empty = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(package, oci_image_name(image), empty(host), empty(name), source)


def argument_tokens(text: Column) -> Column:
    """Words of an argument list in JSON: strings, or objects' non-empty name and non-null value."""
    items = F.from_json(F.when(F.ltrim(text).startswith("["), text), "array<string>")
    words = lambda a: F.when(
        a.startswith("{"),
        F.filter(F.array(F.nullif(F.get_json_object(a, "$.name"), F.lit("")), F.get_json_object(a, "$.value")), lambda x: x.isNotNull()),
    ).otherwise(F.array(a))
    return F.coalesce(F.flatten(F.transform(F.filter(items, lambda x: x.isNotNull()), words)), F.array().cast(_EMPTY))


def environment_map(text: Column) -> Column:
    """Variables of a map or of a list of {name, value} in JSON; of repeated names the last holds."""
    as_map = F.map_entries(F.from_json(F.when(F.ltrim(text).startswith("{"), text), "map<string,string>"))
    pairs = F.filter(F.from_json(F.when(F.ltrim(text).startswith("["), text), "array<string>"),
        lambda x: F.get_json_object(x, "$.name") != "")
    listed = F.transform(pairs, lambda x: F.struct(F.get_json_object(x, "$.name").alias("key"),
        F.coalesce(F.get_json_object(x, "$.value"), F.lit("")).alias("value")))
    entries = F.coalesce(as_map, listed, F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]))


def launch_command(registry_type: Column, identifier: Column, version: Column, runtime_args: Column, package_args: Column) -> Column:
    """Command that starts a registry package: launcher, runtime words, the package, its words.

    Remotes have no command; an unknown type has no launcher.
    """
    none = F.array().cast(_EMPTY)
    launcher = F.coalesce(*[F.when(registry_type == k, F.array(*map(F.lit, v)).cast(_EMPTY)) for k, v in LAUNCHERS.items()], none)
    pinned = F.when(registry_type.isin(*PINNED_TYPES) & (F.coalesce(version, F.lit("")) != ""),
        F.concat(identifier, F.lit("@"), version)).otherwise(identifier)
    return F.when(registry_type.eqNullSafe("remote"), none).otherwise(F.concat(launcher, F.array(pinned), argument_tokens(runtime_args),
        argument_tokens(package_args)))


def slug_base(name: Column) -> Column:
    return F.regexp_replace(F.replace(name, F.lit("/"), F.lit("__")), r"[^A-Za-z0-9_.@-]", "_")


def shard(name: Column, shards: int = SHARDS) -> Column:
    """FNV-1a over UTF-16 units, as a signed 32-bit number's absolute value modulo the shards.

    Units beyond the basic plane are those of the character's surrogate pair.
    """
    codes = F.transform(F.split(name, ""), lambda ch: F.ascii(ch))
    # A character beyond U+FFFF counts as its two surrogate units.
    units = F.flatten(F.transform(codes, lambda u: F.when(u > 0xFFFF, F.array(((u - 0x10000) / 1024).cast("int") + 0xD800,
        (u - 0x10000) % 1024 + 0xDC00)).otherwise(F.array(u))))
    h = F.aggregate(F.filter(units, lambda u: u > 0), F.lit(2166136261).cast("long"), lambda a,
        u: (a.bitwiseXOR(u.cast("long")) * 16777619).bitwiseAND(4294967295))
    signed = F.when(h >= 2147483648, h - 4294967296).otherwise(h)
    return (F.abs(signed) % shards).cast("int")


def href(prefix: str, name: Column) -> Column:
    """Path segments percent-encoded, with @ kept."""
    segments = F.transform(F.split(name, "/"), lambda s: F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%40"),
        F.lit("@")))
    return F.concat(F.lit(prefix), F.array_join(segments, "/"))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def badge_color(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= least, color) for least, color in BADGE_COLORS], F.lit(BADGE_LOW))


# Comments and trailing commas outside string literals: the literal comes first and stays.
_LITERAL = r'("(?:[^"\\]++|\\.)*+")'


def strip_json_comments(text: Column) -> Column:
    return F.regexp_replace(text, _LITERAL + r"|//[^\n]*|/\*[\s\S]*?\*/", "$1")


def strip_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, _LITERAL + r"|,(?=\s*[}\]])", "$1")
