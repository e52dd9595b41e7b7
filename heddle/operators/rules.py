"""Detection rules over launch configurations, compiled to one fused projection.

A rule is data: an id, its texts and either a pattern over a target or a named check. All
rules run in one pass over the rows; hits come out as an array that is exploded once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import launch
from heddle.operators import typosquat
from heddle.session import spread


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    owasp: str
    severity: str
    confidence: str
    target: str = "command"
    pattern: str = ""
    allow_if: str = ""
    check: str = ""
    also: str = ""
    network: bool = False
    phase: str = "static"
    recommendation: str = ""
    max_distance: int = 2
    max_age_days: int = 30
    known: tuple[str, ...] = ()


# ---- fixed values: the rule set ----
DOWNLOAD_PIPE = r"(curl|wget)\s+[^|]+\|\s*(sh|bash|zsh)"
RULES = (
    Rule("MCP-STATIC-001", "Literal secret in a server's environment", "LLM02", "high", "high", "env",
         r"""(api[_-]?key|secret|token|password)\s*[=:]\s*["']?(sk-[a-z0-9]{12,}|xox[baprs]-[a-z0-9-]{10,}|gh[pousr]_[A-Za-z0-9]{20,}|[A-Za-z0-9]{32,})""", allow_if="${",
         recommendation="Refer to a variable or secret store, and revoke the value that was written here."),
    Rule("MCP-STATIC-002", "Download piped into a shell at launch", "AST04", "critical", "high", "command", DOWNLOAD_PIPE,
         recommendation="Install a released package of a fixed version; read a script before it runs."),
    Rule("MCP-STATIC-003", "Host-wide permissions at launch", "LLM08", "high", "medium", "command",
         r"(--privileged\b|--network[=\s]+host\b|--cap-add[=\s]+all\b|-v\s+/:/|--no-sandbox\b|(?:^|\s)/(?:\s|$))",
         recommendation="Grant single folders and ports; leave the host's network, devices and sandbox alone."),
    Rule("MCP-STATIC-004", "Package version not pinned at launch", "AST04", "medium", "medium", "command",
         r"\b(?:npx|uvx|uv\s+run)\s+(?:-y\s+|--from\s+|--with\s+)?(?<pkg>@?[\w][\w./-]*)(?!\S*@\d)", also="oci_pin",
         recommendation="Name the exact version or digest and raise it on purpose."),
    Rule("MCP-STATIC-005", "Injection markers in the entry", "LLM01", "critical", "medium", "raw",
         r"([\u200b\u200c\u200d\ufeff\u2060]|<!--[\s\S]*?-->|ignore\s+(?:all\s+)?previous\s+instructions|do\s+not\s+tell\s+the\s+user|without\s+(?:informing|telling)\s+the\s+user|send\s+(?:this|it|the\s+\w+)\s+to\s+)",
         recommendation="Take hidden characters, comments and orders to the reader out of the entry."),
    Rule("MCP-STATIC-006", "Package name close to a known one", "AST04", "high", "medium", check="typosquat",
         recommendation="Compare the name letter by letter with the project's own page before installing."),
    Rule("MCP-STATIC-007", "Package without a source repository", "AST04", "medium", "low", check="provenance", network=True,
         recommendation="Prefer packages whose source can be read; maintainers should declare the repository."),
    Rule("MCP-STATIC-008", "Install script pipes a download into a shell", "AST04", "high", "medium", check="install_script", network=True,
         recommendation="Read what the package runs on installation, or take one that runs nothing."),
    Rule("MCP-STATIC-009", "Package published very recently", "AST04", "low", "low", check="registry_age", network=True,
         recommendation="Wait, or look closely at who publishes it and since when."),
)
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}
SEMVER_TAG = r"^v?\d+(\.\d+){0,2}$"
ALLOW_WINDOW = 60
DETAIL_CHARS = 160
INSTALL_SCRIPTS = ("preinstall", "install", "postinstall")
SOURCE_LABELS = ("source", "repository", "code", "github", "gitlab", "codeberg")
SOURCE_HOSTS = ("github.com", "gitlab.com", "codeberg.org", "bitbucket.org", "sourcehut.org")
# ---- end of fixed values ----
NO_TAG = 'image "%s" names no tag, so whatever is latest runs'
FLOATING_TAG = 'image "%s" has the moving tag "%s"'


def rank(c: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in ranks.items()])


def rules_fingerprint(rules: tuple[Rule, ...] = RULES) -> str:
    """Changes with any rule's content, not with their order."""
    text = json.dumps(sorted((r.__dict__ for r in rules), key=lambda r: r["id"]), sort_keys=True)
    return "rules-" + sha256(text.encode()).hexdigest()[:16]


def first_allowed_match(text: Column, pattern: str, allow_if: str = "") -> Column:
    """First match of ``pattern`` whose surroundings don't hold ``allow_if``; null if none.

    Matching ignores case, anchors hold at line ends and classes are Unicode's.
    """
    flagged = "(?imU)" + pattern
    if not allow_if:
        return F.nullif(F.regexp_extract(text, flagged, 0), F.lit(""))
    start = F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("hit"))

    # Matches come in order; each is found again from the end of the one before.
    found = F.regexp_extract_all(text, F.lit(flagged), F.lit(0))
    step = lambda s, m: _advance(s, m, text, allow_if)
    return F.aggregate(found, start, step)["hit"]


def _advance(state: Column, match: Column, text: Column, allow_if: str) -> Column:
    at = F.call_function("locate", match, text, state["at"])
    window = F.substring(text, F.greatest(at - ALLOW_WINDOW, F.lit(1)), F.length(match) + ALLOW_WINDOW + F.least(F.lit(ALLOW_WINDOW),
        at - 1))
    ok = state["hit"].isNull() & (F.instr(window, allow_if) == 0)
    return F.struct((at + F.length(match)).cast("int").alias("at"), F.when(ok, match).otherwise(state["hit"]).alias("hit"))


def oci_pin(ref: Column) -> Column:
    """Detail of an image that is neither pinned by digest nor by a version tag; else null."""
    tag = launch.oci_tag(ref)
    return F.when(
        ref.isNotNull() & ~F.contains(ref, F.lit("@sha256:")),
        F.when(tag.isNull(), F.format_string(NO_TAG, ref)).when(
            ~tag.rlike(SEMVER_TAG), F.format_string(FLOATING_TAG, ref, tag)
        ),
    )


def _hit(rule: Rule) -> Column:
    if rule.check == "typosquat":
        near = F.col(_near(rule))
        return F.when(near.isNotNull(), F.format_string('package "%s" is %d edit(s) from "%s"', F.col("t__package"), near["distance"],
            near["known"]))
    hit = first_allowed_match(F.col(f"t__{rule.target}"), rule.pattern, rule.allow_if)
    return F.coalesce(hit, oci_pin(F.col("t__image"))) if rule.also == "oci_pin" else hit


def _near(rule: Rule) -> str:
    return f"t__near_{rule.id}"


def with_hits(configs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` and hits: an array of a finding per local rule, with a null detail where it is silent.

    Texts, package and image are columns of a projection below, so that each is computed
    once per row however many rules read it. A CPU-bound stage without any exchange.
    """
    local = [r for r in rules if not r.network and r.phase == "static"]
    c = F.col
    base = spread(configs).select(
        *keep, launch.command_text(c("command")).alias("t__command"), F.coalesce("url", F.lit("")).alias("t__url"),
            launch.env_text(c("env")).alias("t__env"), launch.raw_text(c("raw")).alias("t__raw"),
        launch.package_name(c("command")).alias("t__package"), launch.oci_image_ref(c("command")).alias("t__image"),
    )
    near = {_near(r): typosquat.nearest_known(c("t__package"), list(r.known) or typosquat.KNOWN_SERVERS,
        r.max_distance) for r in local if r.check == "typosquat"}
    each = F.array(*[_finding(r, _hit(r)) for r in local]) if local else F.array().cast(FINDINGS)
    return base.withColumns(near).select(*keep, each.alias("hits"))


def fired(hits: Column) -> Column:
    return F.filter(hits, lambda h: h["detail"].isNotNull())


def evaluate(configs: DataFrame, key: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (key, rule_id, title, severity, confidence, owasp, phase, location, detail,
    recommendation).

    One row per rule that hits a configuration; rules needing metadata are left to
    ``evaluate_metadata``. Null fields have nothing to match. Extra columns are ignored.
    """
    at = F.concat(F.coalesce("source", F.lit("")), F.lit(" :: "), F.coalesce("name", F.lit("")))
    found = with_hits(configs.withColumn("t__at", at), [key, "t__at"], rules)
    # Exploding a plain column would add a filter on its size that runs all rules once more.
    return _rows(found.select(key, F.col("t__at").alias("location"), F.inline(fired(F.col("hits")))), key)


def _rows(found: DataFrame, key: str) -> DataFrame:
    detail = F.substring("detail", 1, DETAIL_CHARS).alias("detail")
    return found.select(key, "rule_id", "title", "severity", "confidence", "owasp", "phase", "location", detail, "recommendation")


FINDINGS = "array<struct<rule_id:string,title:string,severity:string,confidence:string,owasp:string,phase:string,detail:string,recommendation:string>>"


def _finding(r: Rule, hit: Column) -> Column:
    return F.struct(
        F.lit(r.id).alias("rule_id"), F.lit(r.title).alias("title"), F.lit(r.severity).alias("severity"),
            F.lit(r.confidence).alias("confidence"),
        F.lit(r.owasp).alias("owasp"), F.lit(r.phase).alias("phase"), hit.alias("detail"), F.lit(r.recommendation).alias("recommendation"),
    )


def evaluate_metadata(configs: DataFrame, key: str, metadata: DataFrame, now: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of the rules that need a package's registry metadata, as ``evaluate``'s.

    ``metadata``: ecosystem (npm, pypi), package, unpublished boolean, repository string,
    project_urls map, home_page string, scripts map (of the latest version), created_at
    string (ISO). A package without a row, or without a needed value, gives no finding. uvx
    decides the registry for provenance and age, wherever it stands; install scripts are
    npm's, asked for by npx alone.
    """
    asked = [r for r in rules if r.network and r.phase == "static"]
    by_check = lambda r: {"provenance": provenance, "install_script": install, "registry_age": lambda: age(r)}[r.check]()
    command = F.col("command")
    by_uvx, by_npx = F.array_contains(command, "uvx"), F.array_contains(command, "npx")
    ask = lambda eco, main, scripts: F.struct(F.lit(eco).alias("eco"), F.lit(main).alias("main"),
        F.lit(scripts).alias("scripted"))
    asks = F.when(by_uvx & by_npx, F.array(ask("pypi", True, False), ask("npm", False, True))).when(by_uvx,
        F.array(ask("pypi", True, False))).when(by_npx, F.array(ask("npm", True, True)))
    meta = metadata.select(
        F.col("ecosystem").alias("m_ecosystem"), F.col("package").alias("m_package"), "unpublished", "repository", "project_urls",
            "home_page", "scripts", "created_at"
    )
    rows = configs.select(key, "name", "source", launch.package_name(command).alias("pkg"), F.inline(asks)).join(
        meta, (F.col("eco") == F.col("m_ecosystem")) & (F.col("pkg") == F.col("m_package"))
    )
    urls = F.map_entries(F.coalesce("project_urls", F.create_map().cast("map<string,string>")))
    is_source = lambda e: (F.coalesce(e["value"], F.lit("")) != "") & (
        F.lower(e["key"]).rlike("|".join(SOURCE_LABELS)) | F.lower(e["value"]).rlike("|".join(h.replace(".", r"\.") for h in SOURCE_HOSTS))
    )
    home = F.coalesce("home_page", F.lit(""))
    pypi_source = F.exists(urls, is_source) | ((home != "") & ~F.contains(home, F.lit("pypi.org")))

    def provenance() -> Column:
        pypi = F.when(~pypi_source, F.format_string('PyPI lists no source repository for "%s"', "pkg"))
        npm = F.when(F.coalesce("unpublished", F.lit(False)), F.format_string('"%s" is no longer on npm', "pkg")).when(
            F.coalesce("repository", F.lit("")) == "", F.format_string('npm package "%s" declares no repository', "pkg")
        )
        return F.when(F.col("main"), F.when(F.col("eco") == "pypi", pypi).otherwise(npm))

    def install() -> Column:
        bad = lambda k: F.try_element_at("scripts", F.lit(k)).rlike("(?i)" + DOWNLOAD_PIPE)
        return F.when(F.col("scripted"),
            F.coalesce(*[F.when(bad(k), F.format_string('npm package "%s" pipes a download into a shell on %s', F.col("pkg"),
            F.lit(k))) for k in INSTALL_SCRIPTS]))

    def age(rule: Rule) -> Column:
        days = F.floor((F.unix_micros(now) - F.unix_micros(F.try_to_timestamp("created_at"))) / 86_400_000_000)
        return F.when(F.col("main") & (days <= rule.max_age_days), F.format_string('"%s" appeared %d day(s) ago', F.col("pkg"), days))

    found = F.array(*[_finding(r, by_check(r)) for r in asked]) if asked else F.array().cast(FINDINGS)
    at = F.concat(F.coalesce("source", F.lit("")), F.lit(" :: "), F.coalesce("name", F.lit("")))
    return _rows(rows.select(key, at.alias("location"), F.inline(fired(found))), key)


def fingerprint(rule_id: Column, server: Column, location: Column) -> Column:
    return F.concat_ws("::", rule_id, F.coalesce(server, F.lit("None")), location)
