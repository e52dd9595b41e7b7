"""Command line over the same functions: ``python -m heddle.cli COMMAND ...``.

inspect [PATH...]                normalised entries of configuration files
scan [PATH...] [--fail-on S]     findings; exit 1 if any is at or above the severity
feedback RULE [--note TEXT]      a link to report a finding that is none
allowlist-init [PATH...]         a first allowlist as JSON
enforce POLICY [PATH...]         violations of a policy as Markdown; exit 1 if there are any
registry-poll STORE              take a poll of the registry into the store
registry-scan STORE OUT          scan what is stale, score, export
registry-export STORE OUT        export again without scanning

Without paths the project's configuration files are taken, then the user's (not with
--project-only). --dry-run computes and counts a run without changing the store.
"""

from __future__ import annotations

import argparse
import json
import os
import platform
import sys
from pathlib import Path

from pyspark.sql import functions as F

from heddle import api, registry_run
from heddle.operators import policy, publish, rules
from heddle.session import build_session
from heddle.sources import configs, files, pages
from heddle.sources.snapshots import SnapshotStore

SITE = "https://registry.example"


def _entries(spark, a):
    home = None if a.project_only else str(Path.home())
    paths = a.paths or configs.discover(".", home, platform.system(), os.environ.get("APPDATA", ""))
    # Entries of one file are keyed by place; ids only tie findings to entries.
    return paths, configs.load_configs(spark, paths).withColumn("entry", F.xxhash64("source", "name"))


def _print(lines) -> None:
    for r in lines.orderBy("line_no").toLocalIterator():
        print(r["line"])


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="heddle", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    local = {name: sub.add_parser(name) for name in ("inspect", "scan", "allowlist-init", "enforce")}
    local["enforce"].add_argument("policy")
    local["enforce"].add_argument("--baseline")
    local["scan"].add_argument("--fail-on", default=None)
    local["scan"].add_argument("--format", choices=("text", "sarif", "json"), default="text")
    for s in local.values():
        s.add_argument("--rules")
        s.add_argument("--deep", help="Parquet table of package metadata, for the rules that need it")
        s.add_argument("--project-only", action="store_true")
        s.add_argument("paths", nargs="*")
    f = sub.add_parser("feedback")
    f.add_argument("rule")
    f.add_argument("--note", default="")
    for name in ("registry-poll", "registry-scan", "registry-export"):
        s = sub.add_parser(name)
        s.add_argument("store")
        s.add_argument("--at", help="instant of the run (ISO), else now")
        if name == "registry-poll":
            s.add_argument("--config")
            s.add_argument("--pages", help="folder of page files instead of the registry's address")
        else:
            s.add_argument("out")
            s.add_argument("--rules")
        if name == "registry-scan":
            s.add_argument("--metadata", help="Parquet table of package metadata")
        if name != "registry-export":
            s.add_argument("--dry-run", action="store_true")
    return p


def _registry(spark, a) -> int:
    store = SnapshotStore(spark, a.store)
    at = registry_run.by_instant(a.at)
    if a.command == "registry-poll":
        if a.pages:
            entries = pages.landed_pages(spark, a.pages)
        else:
            settings = files.PollSettings.load(a.config)
            spark.dataSource.register(pages.RegistryPages)
            rows = spark.read.format("registry_pages").option("url", settings.base_url).option("limit", str(settings.page_limit)).load()
            entries = rows.where("raw_json IS NOT NULL").select(F.xxhash64("page_no", "position").alias("entry_id"), "raw_json")
        print(json.dumps({"dry_run": a.dry_run, **registry_run.poll(store, entries, at, a.dry_run)}))
        return 0
    loaded = files.load_rules(a.rules)
    known = next((list(r.known) for r in loaded if r.check == "typosquat" and r.known), None)
    counts = {}
    if a.command == "registry-scan":
        metadata = spark.read.parquet(a.metadata) if a.metadata else None
        counts = {"dry_run": a.dry_run, **registry_run.scan(store, at, loaded, metadata, a.dry_run)}
    if not counts.get("dry_run"):
        counts |= registry_run.export(store, a.out, known)
    print(json.dumps(counts))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "feedback":
        rule = next((r for r in rules.RULES if r.id == a.rule), None)
        if rule is None:
            print(f"unknown rule {a.rule}; known: {', '.join(r.id for r in rules.RULES)}", file=sys.stderr)
            return 1
        print(api.feedback_url(SITE, rule.id, rule.title,
            f"Rule: {rule.id}\n\nWhy this is no finding:\n{a.note or '(please say)'}\n\nEntry, without its secrets:\n"))
        return 0
    spark = build_session("heddle")
    spark.sparkContext.setLogLevel("ERROR")
    if a.command.startswith("registry-"):
        return _registry(spark, a)
    paths, entries = _entries(spark, a)
    if a.command == "inspect":
        for r in entries.select(F.to_json(F.struct("source", "name", "transport", "command", "url")).alias("j")).toLocalIterator():
            print(r["j"])
        return 0
    if a.command == "allowlist-init":
        print(json.dumps([r.asDict() for r in policy.allowlist_of(entries).orderBy("name").toLocalIterator()], indent=2))
        return 0
    loaded = files.load_rules(a.rules)
    found = rules.evaluate(entries, "entry", loaded)
    if a.deep:
        found = found.unionByName(rules.evaluate_metadata(entries, "entry", spark.read.parquet(a.deep), F.current_timestamp(), loaded))
    if a.command == "scan":
        if a.format == "text":
            for r in publish.text_lines(found).toLocalIterator():
                print(r["line"])
        else:
            _print(publish.sarif(found, "heddle", SITE) if a.format == "sarif" else publish.json_result(paths, entries, found))
        # An unknown severity asks for no gate.
        return int(a.fail_on in rules.SEVERITY_RANK and bool(found.where(publish.severity_at_least(F.col("severity"), a.fail_on)).take(1)))
    pol = files.load_policy(a.policy)
    allow = spark.createDataFrame([(s.name, s.version, s.digest) for s in pol.servers], "name string, version string, digest string")
    base = None
    if pol.mode == "baseline":
        base = spark.createDataFrame([(f,) for f in files.load_baseline(a.baseline or "baseline.json")], "fingerprint string")
    broken = policy.violations(entries, found, allow, pol.blocked_registries, pol.fail_on, base)
    report = publish.markdown_report(broken)
    _print(report)
    return int(report.count() > 1)


if __name__ == "__main__":
    sys.exit(main())
