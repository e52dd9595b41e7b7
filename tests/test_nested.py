import json

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.operators.nested import Index, flatten, flatten_batch

SCHEMA = "id long, raw string, record_id long, text string, relation string"


def rows_of(origin, texts):
    out = set()
    for b in flatten_batch(origin, pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())):
        out |= {(r["record_id"], r["relation"], r["parent_pos"], r["item_key"]) for r in b.to_pylist()}
    return out


def env_of(i, e, pos, out):
    if isinstance(e, dict):
        out |= {(i, "env", pos, k) for k in e}
    elif isinstance(e, list):
        for x in e:
            if isinstance(x, dict) and isinstance(x.get("name"), str) and x["name"]:
                out.add((i, "env", pos, x["name"]))
                if isinstance(x.get("choices"), list):
                    out |= {(i, "choices", pos, f"{x['name']}/{k}") for k, c in enumerate(x["choices"]) if c is not None}


def brute_entry(i, o):
    out = set()
    server = o.get("server") if isinstance(o, dict) else None
    if not isinstance(server, dict):
        return out
    for rel in ("packages", "remotes"):
        items = server.get(rel)
        for p, x in enumerate(items if isinstance(items, list) else []):
            if x is None:
                continue
            out.add((i, rel, -1, str(p)))
            if not isinstance(x, dict):
                continue
            if rel == "remotes":
                h = x.get("headers")
                if isinstance(h, dict):
                    out |= {(i, "headers", p, k) for k in h}
                for y in h if isinstance(h, list) else []:
                    if isinstance(y, dict) and isinstance(y.get("name"), str) and y["name"]:
                        out.add((i, "headers", p, y["name"]))
                continue
            for name, key in (("runtime_args", "runtimeArguments"), ("package_args", "packageArguments")):
                args = x.get(key)
                for k, a in enumerate(args if isinstance(args, list) else []):
                    if isinstance(a, str) or (isinstance(a, dict) and ((isinstance(a.get("name"), str) and a["name"]) or a.get("value") is not None)):
                        out.add((i, name, p, str(k)))
            env_of(i, x.get("environmentVariables"), p, out)
    return out


text = st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=8) | st.sampled_from(["", '"', "\\", "\\\\", "}{", "[,]:", "a\nb", "é", "😀"])
leaf = st.none() | st.booleans() | st.integers(-5, 5) | st.floats(allow_nan=False, allow_infinity=False, width=16) | text
named = st.fixed_dictionaries({}, optional={"name": text | st.none(), "value": leaf, "choices": st.none() | st.lists(leaf | st.dictionaries(text, leaf, max_size=2), max_size=3)})
env = st.none() | st.lists(st.none() | text | named, max_size=3) | st.dictionaries(text, leaf, max_size=3)
package = st.none() | st.fixed_dictionaries({}, optional={"runtimeArguments": env, "packageArguments": env, "environmentVariables": env, "z": leaf})
remote = st.none() | st.fixed_dictionaries({}, optional={"headers": env, "url": text})
entry = st.fixed_dictionaries({"server": st.fixed_dictionaries({"name": text}, optional={"packages": st.none() | st.lists(package, max_size=3), "remotes": st.none() | st.lists(remote, max_size=3)}), "_meta": st.dictionaries(text, leaf, max_size=2)})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(entry, st.sampled_from([None, 1]), st.booleans(), st.sampled_from(["", " \n"]), st.booleans()), max_size=5))
def test_random_entries_equal_a_json_parser(cases):
    texts, want = [], set()
    for i, (o, indent, ascii_, space, twice) in enumerate(cases):
        t = space + json.dumps(o, indent=indent, ensure_ascii=ascii_) + space
        texts.append(json.dumps(t) if twice else t)
        want |= brute_entry(i, o)
    assert rows_of("registry_entries", texts) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(env, max_size=5))
def test_random_environments_equal_a_json_parser(cases):
    want: set = set()
    for i, e in enumerate(cases):
        env_of(i, e, -1, want)
    assert rows_of("versions", [json.dumps(e) for e in cases]) == want


def test_cut_off_and_broken_texts_give_nothing_and_spoil_no_neighbour():
    good = json.dumps({"server": {"packages": [{"environmentVariables": {"A": "x"}}]}})
    for k in range(len(good)):
        assert rows_of("registry_entries", [good[:k], good, good[:k]]) == {(1, "packages", -1, "0"), (1, "env", 0, "A")}
    for bad in ("", " ", '{"server": {"packages": [{}]]}', "{}}", "{} {}", '"', '"{\\"server\\"', "\\", '{"a": "\\"}', "x{}", "{}x"):
        assert rows_of("registry_entries", [bad, good, bad])  == {(1, "packages", -1, "0"), (1, "env", 0, "A")}


def test_values_and_positions_of_a_long_text():
    o = {"server": {"packages": [None, {"environmentVariables": [{"name": "N", "value": "v" * 3_000_000}, {"name": "M"}]}]}}
    assert rows_of("registry_entries", [json.dumps(o)]) == {(0, "packages", -1, "1"), (0, "env", 1, "N"), (0, "env", 1, "M")}


def test_index_of_nothing():
    assert len(Index(np.empty(0, np.uint8), np.array([0])).row) == 0


def test_table_with_nulls_extra_columns_and_no_rows(spark):
    rows = [(1, '{"A": 1}', 7, "x", "y"), (2, None, 7, "x", "y"), (None, '{"A": 1}', 7, "x", "y"), (1, '{"A": 1}', 7, "x", "y")]
    got = flatten(spark.createDataFrame(rows, SCHEMA), "versions", "id", "raw").collect()
    assert [(r["record_id"], r["relation"], r["parent_pos"], r["item_key"], r["value"]) for r in got] == [(1, "env", -1, "A", "1")] * 2
    assert flatten(spark.createDataFrame([], SCHEMA), "versions", "id", "raw").count() == 0


def version_rows(walk, texts):
    return {(r["record_id"], r["relation"], r["parent_pos"], r["item_key"]) for b in flatten_batch("versions", pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), walk) for r in b.to_pylist()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(package.map(lambda o: o or {}), remote.map(lambda o: o or {}), st.sampled_from(["", " \n"]), st.booleans()), max_size=5))
def test_random_packages_and_remotes_of_versions_equal_a_json_parser(cases):
    texts, want = {"package": [], "remote": []}, {"package": set(), "remote": set()}
    for i, (p, r, space, twice) in enumerate(cases):
        for walk, o in (("package", p), ("remote", r)):
            t = space + json.dumps(o) + space
            texts[walk].append(json.dumps(t) if twice else t)
            rows = brute_entry(i, {"server": {walk + "s": [o]}})
            want[walk] |= {(i, rel, -1, "-1" if rel == walk + "s" else k) for i, rel, _, k in rows if rel not in ("env", "choices")}
    for walk in texts:
        assert version_rows(walk, texts[walk]) == want[walk]


def test_versions_without_members_lists_and_broken_texts():
    assert version_rows("package", ["{}"]) == {(0, "packages", -1, "-1")} and version_rows("remote", [" {} "]) == {(0, "remotes", -1, "-1")}
    assert version_rows("package", [None, "", "[{}]", '{"runtimeArguments": ["a"', "5", '{"packageArguments": [null, "x"]}']) == {(5, "packages", -1, "-1"), (5, "package_args", -1, "1")}


def test_relation_tables_hold_every_version(spark, sf):
    from heddle.plans import data_ops

    records = [(r["id"], "remotes" if r["registry_type"] == "remote" else "packages", json.loads(r["raw_json"])) for r in spark.read.parquet(f"{sf}/versions.parquet").select("id", "registry_type", "raw_json").collect()]
    want = set()
    for i, rel, o in records:
        rows = brute_entry(i, {"server": {rel: [o]}})
        want |= {(i, r, -1, "-1" if r == rel else k) for i, r, _, k in rows if r not in ("env", "choices")}
    got, ids = set(), {}
    for rel in ("packages", "remotes", "runtime_args", "package_args", "headers"):
        rows = data_ops.QUERIES[f"p6_{rel}"](spark, sf).where("origin = 'versions'").collect()
        got |= {(r["record_id"], rel, r["parent_pos"], r["item_key"]) for r in rows}
        ids |= {(r["record_id"], rel): r for r in rows if rel in ("packages", "remotes")}
    assert got == want and len({r for _, r, *_ in want}) == 5
    for i, rel, o in records:
        r = ids[i, rel]
        assert (r["url"], r["type"]) == (o.get("url"), o.get("type")) if rel == "remotes" else (r["registryType"], r["identifier"], r["version"]) == (o["registryType"], o["identifier"], o["version"])
    assert {r["relation"] for r in data_ops.p6_found(spark, sf).where("origin = 'versions'").select("relation").distinct().collect()} == {"env", "choices"}
