import json
from urllib.error import HTTPError, URLError

import pytest
from pyspark.sql import functions as F

from heddle import api, cli
from heddle.operators import rules
from heddle.sources import files, pages


def test_rule_fingerprint_and_pages_of_rules():
    assert rules.rules_fingerprint() == rules.rules_fingerprint(tuple(reversed(rules.RULES)))
    assert rules.rules_fingerprint() != rules.rules_fingerprint(rules.RULES[1:]) and rules.rules_fingerprint().startswith("rules-")
    assert set(files.rule_pages()) == {r.id for r in rules.RULES} and all(r.owasp for r in rules.RULES)


def test_custom_rules_and_policy_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/b.json").write_text(json.dumps({"id": "B", "detect": {"pattern": "(?P<x>a)"}}))
    (tmp_path / "r/a.json").write_text(json.dumps({"id": "A", "severity": "low", "detect": {"target": "url", "pattern": "u"}}))
    (tmp_path / "r/c.json").write_text("[1]")
    assert [(r.id, r.pattern, r.target) for r in files.load_rules(str(tmp_path / "r"))] == [("A", "u", "url"), ("B", "(?<x>a)", "command")]
    (tmp_path / "r/data").mkdir()
    (tmp_path / "r/data/names.json").write_text('["left-pad", "right-pad"]')
    (tmp_path / "r/d.json").write_text(json.dumps({"id": "D", "recommendation": "look", "detect": {"type": "typosquat", "reference_list": "names.json", "max_distance": 1}}))
    (tmp_path / "r/e.json").write_text(json.dumps({"id": "E", "network": True, "detect": {"type": "npm_provenance"}}))
    (tmp_path / "r/f.json").write_text(json.dumps({"id": "F", "network": True, "detect": {"type": "registry_age", "max_age_days": 7}}))
    (tmp_path / "r/g.json").write_text(json.dumps({"id": "G", "network": True, "detect": {"type": "npm_install_script"}}))
    own = {r.id: r for r in files.load_rules(str(tmp_path / "r"))}
    assert own["D"].known == ("left-pad", "right-pad") and own["D"].max_distance == 1 and own["D"].recommendation == "look"
    assert [own[k].check for k in "DEFG"] == ["typosquat", "provenance", "registry_age", "install_script"] and own["F"].max_age_days == 7
    rows = spark.createDataFrame([(1, ["npx", "left-pat@1.0"]), (2, ["npx", "left-pta@1.0"]), (3, ["uvx", "young"])], "i int, command array<string>")
    rows = rows.selectExpr("i", "command", "'s' AS name", "'f' AS source", "'stdio' AS transport", "CAST(NULL AS STRING) AS url", "CAST(NULL AS MAP<STRING, STRING>) AS env", "CAST(NULL AS STRING) AS raw")
    assert {(r["i"], r["rule_id"]) for r in rules.evaluate(rows, "i", (own["D"], own["E"])).collect()} == {(1, "D")}
    meta = spark.sql("SELECT 'pypi' AS ecosystem, 'young' AS package, false AS unpublished, CAST(NULL AS STRING) AS repository, CAST(NULL AS MAP<STRING, STRING>) AS project_urls, 'https://x' AS home_page, CAST(NULL AS MAP<STRING, STRING>) AS scripts, '2025-01-01T00:00:00Z' AS created_at")
    ages = [rules.evaluate_metadata(rows, "i", meta, F.lit(f"2025-01-{d} 00:00:00Z").cast("timestamp"), tuple(own.values())).count() for d in ("08", "09")]
    assert ages == [1, 0]
    good = tmp_path / "p.json"
    good.write_text(json.dumps({"fail_on": "low", "servers": [{"name": "a", "version": "1"}]}))
    assert files.load_policy(str(good)).servers[0].version == "1"
    for bad in ({"servers": {"a": 1}}, {"rules": []}, {"fail_on": "huge"}, {"servers": [{"name": "a", "version": "1", "digest": "d"}]}, {"servers": [{"x": 1}]}, [1]):
        good.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            files.load_policy(str(good))
    assert files.load_baseline(str(tmp_path / "none")) == []
    files.write_baseline(["b", "a", "b"], str(tmp_path / "base"))
    assert files.load_baseline(str(tmp_path / "base")) == ["a", "b"]
    assert files.PollSettings.load(None).page_limit == 100


def test_pages_follow_cursors_and_retry():
    store = {None: {"servers": [{"n": 1}, {"n": 2}], "metadata": {"nextCursor": "x y"}}, "x+y": {"servers": [{"n": 3}], "metadata": {}}}
    calls = []

    def opener(url):
        calls.append(url)
        if len(calls) == 1:
            raise URLError("down")
        if len(calls) == 2:
            raise HTTPError(url, 503, "busy", {}, None)
        return json.dumps(store[url.partition("cursor=")[2] or None])

    assert [(p, c, i, json.loads(r)["n"]) for p, c, i, r in pages.walk("http://h", 2, opener, 0)] == [(1, "x y", 0, 1), (1, "x y", 1, 2), (2, None, 0, 3)]
    assert list(pages.walk("http://h", 2, lambda url: "{}", 0)) == [(1, None, 0, None)]
    assert len(calls) == 4 and all("version=latest" in c for c in calls)

    def refused(url):
        raise HTTPError(url, 404, "no", {}, None)

    with pytest.raises(HTTPError):
        pages.fetch("http://h", refused, 0)


def test_landed_pages_and_lookups(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"servers": [{"server": {"name": "a"}}, {"server": {"name": "b"}}], "metadata": {}}))
    (tmp_path / "p2.json").write_text("{broken")
    assert pages.landed_pages(spark, str(tmp_path)).count() == 2
    df = spark.createDataFrame([("n", "s", 95)], "name string, slug string, score int")
    assert "#4c1" in api.badge(df, "s").first()["svg"] and api.by_name(df, "x").count() == 0 and api.by_slug(df, "s").count() == 1
    assert api.verification_link("io.github.a/b", []) == "https://github.com/a/b" and api.verification_link("x/y", ["z", 'npm package "@p/q" declares no repository']) == "https://www.npmjs.com/package/@p/q" and api.verification_link("x/y", ["z"]) is None
    assert api.feedback_url("https://x", "R", "a/b c", "d e") == "https://x/issues/new?title=%5BR%5D%20a/b%20c&body=d%20e"


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["feedback", "MCP-STATIC-004", "--note", "a b"]) == 0 and "a%20b" in capsys.readouterr().out and cli.main(["feedback", "X"]) == 1
    f = tmp_path / "mcp.json"
    f.write_text(json.dumps({"mcpServers": {"s": {"command": "npx", "args": ["-y", "pkg"]}}}))
    assert cli.main(["scan", "--fail-on", "medium", str(f)]) == 1 and "004" in capsys.readouterr().out
    assert cli.main(["scan", "--fail-on", "critical", str(f)]) == 0 and cli.main(["scan", "--fail-on", "odd", str(f)]) == 0
    capsys.readouterr()
    for kind in ("sarif", "json"):
        assert cli.main(["scan", "--format", kind, str(f)]) == 0
        out = json.loads(capsys.readouterr().out)
        assert (out["runs"][0]["results"][0]["ruleId"] if kind == "sarif" else out["findings"][0]["rule_id"]) == "MCP-STATIC-004"
    assert out["targets"] == [str(f)] and out["servers"][0]["command"] == ["npx", "-y", "pkg"] and out["findings"][0]["server"] == "s"
    assert cli.main(["allowlist-init", str(f)]) == 0 and json.loads(capsys.readouterr().out) == [{"name": "pkg", "version": None, "digest": None}]
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"fail_on": "high", "servers": [{"name": "pkg"}]}))
    assert cli.main(["enforce", str(p), str(f)]) == 0 and "No violations." in capsys.readouterr().out
    p.write_text(json.dumps({"fail_on": "low", "blocked_registries": ["npx"], "servers": []}))
    assert cli.main(["enforce", str(p), str(f)]) == 1
    out = capsys.readouterr().out
    assert "unlisted_server" in out and "blocked_registry" in out and "finding" in out


def test_registry_runs_poll_scan_export(spark, tmp_path, capsys):
    from heddle import registry_run
    from heddle.sources.snapshots import SnapshotStore

    def page(*servers):
        official = {"io.modelcontextprotocol.registry/official": {"isLatest": True, "status": "active"}}
        rows = [{"server": {"name": n, "version": v, "packages": [{"registryType": "npm", "identifier": i, "version": v, "fileSha256": h, "environmentVariables": env}]}, "_meta": official} for n, v, i, h, env in servers]
        folder = tmp_path / f"pages{len(list(tmp_path.glob('pages*')))}"
        folder.mkdir()
        (folder / "p1.json").write_text(json.dumps({"servers": rows, "metadata": {}}))
        return str(folder)

    store, out = str(tmp_path / "store"), str(tmp_path / "out")

    def run(*args):
        assert cli.main([*args]) == 0
        return json.loads(capsys.readouterr().out)

    secret = [{"name": "API_TOKEN", "value": "k" * 40}]
    first = page(("io.a/x", "1.0.0", "@playwright/mpc", "h1", secret), ("io.A/x", "1.0.0", "tool", "h2", []), ("io.b/y", "2.0.0", "safe", None, []))
    assert run("registry-poll", store, "--pages", first, "--at", "2025-01-01T00:00:00+00:00", "--dry-run")["servers_new"] == 3
    assert SnapshotStore(spark, store).version() == 0
    got = run("registry-poll", store, "--pages", first, "--at", "2025-01-01T00:00:00+00:00")
    assert got["versions_new"] == 3 and got["hashes_added"] == 2
    assert run("registry-scan", store, out, "--at", "2025-01-02T00:00:00+00:00", "--dry-run")["versions_scanned"] == 3 and SnapshotStore(spark, store).version() == 1
    got = run("registry-scan", store, out, "--at", "2025-01-02T00:00:00+00:00")
    assert got["findings_written"] == 2 and got["servers_scored"] == 3 and got["clusters"] == 1 and got["newly_flagged"] == 1
    index = {r["name"]: r for r in registry_run.load(spark, out, "index").collect()}
    assert len({r["slug"].lower() for r in index.values()}) == 3 and index["io.a/x"]["score"] == 49 and index["io.b/y"]["score"] == 100
    pages_ = {r["name"]: json.loads(r["document"]) for r in registry_run.load(spark, out, "servers").collect()}
    assert [f["rule_id"] for f in pages_["io.a/x"]["findings"]] == ["MCP-STATIC-001", "MCP-STATIC-006"] and pages_["io.a/x"]["findings"][0]["recommendation"]
    assert registry_run.load(spark, out, "nothing") is None
    # The same poll again changes nothing; nothing is stale then.
    got = run("registry-poll", store, "--pages", first, "--at", "2025-01-03T00:00:00+00:00")
    assert got["hashes_added"] == 0 and got["servers_updated"] == 3
    assert run("registry-scan", store, out, "--at", "2025-01-04T00:00:00+00:00")["versions_skipped"] == 3
    # New content is scanned again, what is gone is delisted and no longer scored.
    second = page(("io.a/x", "1.0.0", "@playwright/mpc", "h9", []), ("io.b/y", "2.0.0", "safe", None, []))
    got = run("registry-poll", store, "--pages", second, "--at", "2025-01-05T00:00:00+00:00")
    assert got["servers_delisted"] == 1 and got["hashes_added"] == 1
    got = run("registry-scan", store, out, "--at", "2025-01-06T00:00:00+00:00")
    assert got["versions_scanned"] == 1 and got["servers_scored"] == 2 and got["newly_flagged"] == 0
    st = SnapshotStore(spark, store)
    assert st.table("scores").count() == 8 and st.table("hashes").count() == 3 and st.table("scans").where("version_id LIKE '%mpc%'").count() == 2
    assert run("registry-export", store, out)["servers"] == 3
