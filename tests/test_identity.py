"""Manifests, differences, releases, membership, delegation, receipts and relation suites on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import ed25519
from lodestrand.functions.canon import address, text_address
from lodestrand.functions.rawjson import list_items, member_text
from lodestrand.operators import contamination, delegation, jsondiff, manifest, membership, receipts, releases, variants
from lodestrand.sources import configs

ARTIFACTS = "config_id string, component string, name string, content string"


def config(config_id, tools=("a", "b"), docs=(("d1", "x"), ("d2", "y")), agent=None, items=("1", "2")):
    agent = {"name": "n", "model": {"id": "m"}, "allowed_operations": ["w", "r"]} if agent is None else agent
    rows = [(config_id, "agent", "agent.json", json.dumps(agent)), (config_id, "prompt", "prompt", "hi\r\n")]
    rows += [(config_id, "tool", "", json.dumps({"name": t, "n": 1.0})) for t in tools] + [(config_id, "corpus", n, t) for n, t in docs] + [(config_id, "eval_item", i, json.dumps({"id": i})) for i in items]
    return rows


def by_id(df):
    return {r["config_id"]: r for r in df.collect()}


def test_manifest_equals_addresses_of_values(spark):
    r = by_id(manifest.manifests(spark.createDataFrame(config("c"), ARTIFACTS)))["c"]
    tools = [{"name": t, "n": 1.0} for t in ("a", "b")]
    docs = [{"name": n, "addr": text_address(t)} for n, t in (("d1", "x"), ("d2", "y"))]
    want = {
        "model": address({"id": "m"}), "prompt": text_address("hi"), "procedure": text_address(""), "tools": address({"tools": tools}), "corpus": address({"scope": "full", "docs": docs}),
        "permissions": address(["r", "w"]), "eval_set": address(sorted(address({"id": i}) for i in ("1", "2"))),
    }
    assert {k: r[k] for k in want} == want and r["violations"] == []
    assert r["configuration_address"] == address({"agent": {"name": "n"}, "components": want})


def test_manifest_order_scope_and_violations(spark):
    rows = config("c") + list(reversed([("d", *x[1:]) for x in config("c")])) + config("twice", tools=("a", "a")) + config("nomodel", agent={"model": {}}) + config("ops", agent={"model": "m", "allowed_operations": {"r": True}})
    got = by_id(manifest.manifests(spark.createDataFrame(rows, ARTIFACTS)))
    assert got["c"]["configuration_address"] == got["d"]["configuration_address"]
    assert all(got[k]["configuration_address"] is None and got[k]["violations"] for k in ("twice", "nomodel", "ops"))
    read = spark.createDataFrame([("c", "d1"), ("e", "d1"), ("f", "gone")], "config_id string, name string")
    rows = config("c") + config("e", docs=(("d1", "x"), ("d2", "y"), ("d3", "z"))) + config("f")
    got = by_id(manifest.manifests(spark.createDataFrame(rows, ARTIFACTS), "strict", read))
    assert got["c"]["corpus"] == got["e"]["corpus"] and got["f"]["violations"]
    a, b = spark.createDataFrame(config("c"), ARTIFACTS), spark.createDataFrame(config("c", tools=("a", "c"), docs=(("d1", "x2"),)), ARTIFACTS)
    assert {r["component"] for r in manifest.component_drift(manifest.manifests(a), manifest.manifests(b)).collect()} == {"tools", "corpus"}
    assert {tuple(r)[1:] for r in manifest.member_drift(manifest.members(a), manifest.members(b)).collect()} == {("tools", "b", "removed"), ("tools", "c", "added"), ("corpus", "d1", "changed"), ("corpus", "d2", "removed")}


def test_configuration_folder(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    for name, text in {"agent.json": '{"model": "m"}', "tools.json": '{"tools": [{"name": "a", "n": 1.50}], "hint": 1}', "eval.jsonl": '{"id": "1"}\n\n  {"id": "2"}\n', "corpus/d.md": "x", "prompt.txt": "p"}.items():
        (tmp_path / name).write_text(text)
    rows = {(r["component"], r["name"], r["content"]) for r in configs.configuration(spark, str(tmp_path), "c").collect()}
    assert ("tool", "", '{"name": "a", "n": 1.50}') in rows and ("eval_item", "2", '{"id": "2"}') in rows and len(rows) == 7
    with pytest.raises(FileNotFoundError):
        configs.configuration(spark, str(tmp_path / "corpus"), "c")


def test_raw_json_parts():
    assert member_text('{"a": {"b": [1.0, "}"]} , "c":null, "a" : 1e2 }', "a") == "1e2" and member_text('{"c":null}', "c") is None
    assert list_items(' [ 1.0 ,{"a":"]"}, [] ] ', "tools") == (["1.0", '{"a":"]"}', "[]"], False) and list_items("{}", "tools") == ([], True)


def test_json_differences(spark):
    d = jsondiff.json_differences
    assert d('{"a":[1,2],"b":1}', '{"b":1,"a":[1,2]}') == []
    assert d('{"a":1,"x":true}', '{"a":1.0,"b":2,"x":1}') == [("/a", "changed", "1", "1.0"), ("/b", "added", None, "2"), ("/x", "changed", "true", "1")]
    assert d('{"a":"1"}', '{"a":1}') == [("/a", "type", "1", "1")] and d("1", None) == [("/", "type", "1", "null")] and d("nope", "1") == [("/", "changed", "nope", "1")]
    pairs = spark.createDataFrame([(1, "[1,2]", "[1]"), (2, None, None), (3, "[1]", None)], "k int, before string, after string")
    assert {tuple(r) for r in jsondiff.field_diffs(pairs, ["k"]).collect()} == {(1, "[1]", "removed", "2", None), (3, "/", "type", "[1]", "null")}
    lines = spark.createDataFrame([("a\nb", "a\nc"), ("a", "a\r\nb"), ("a", "a"), (None, "a")], "x string, y string").select(jsondiff.first_different_line("x", "y").alias("l")).collect()
    assert [tuple(r["l"]) if r["l"] else None for r in lines] == [(2, "b", "c"), (2, None, "b"), None, (1, None, "a")]
    assert "another script" in jsondiff.character_note("pay", "pаy") and jsondiff.character_note("a", "ab") is None


def test_releases(spark):
    t = lambda d, n="a", s="{}": json.dumps([{"name": n, "description": d, "inputSchema": json.loads(s)}])
    rows = [("p", "1.2", t("x"), None, 1), ("p", "1.10", t("xyz"), None, 2), ("p", "1.9", json.dumps(json.loads(t("x")), indent=1), None, 3), ("p", "2", t("xyz", s='{"a":1}'), None, 4), ("p", "3", t("xyz", "b"), None, 5), ("p", "3", "[]", "bad", 6), ("p", "4", t("xyz", "b"), None, 7), ("q", "1", t("x"), None, 8)]
    caps = spark.createDataFrame([(i, p, v, tools, e) for p, v, tools, e, i in rows], "capture_id long, package string, version string, tools string, error string").withColumn("captured_at", F.lit("2025-01-01").cast("timestamp"))
    versions = releases.version_rows(caps)
    got = {r["version_to"]: (r["classification"], r["kind"]) for r in releases.classify_pairs(versions).collect()}
    assert got == {"1.9": ("byte_only", None), "1.10": ("material", "description only"), "2": ("material", "schema only"), "3": ("material", "tool set changed"), "4": ("identical", None)}
    assert [tuple(r) for r in releases.description_rewrites(versions).collect()] == [("p", "1.9", "1.10", "a", 1, 3, 2)]
    s = releases.release_summary(versions).collect()[0]
    assert (s["n_packages"], s["n_pairs"], s["silent"], s["byte_only_rate"]) == (1, 5, 2, 0.2)
    assert releases.release_summary(versions.filter("package = 'q'")).collect()[0]["byte_only_rate"] is None


def test_membership(spark):
    rules = spark.createDataFrame([("c", "model", "pin", ["m"]), ("c", "prompt", "any_of", ["p", "q"]), ("c", "tools", "subset_of", ["a", "b"])], "class_id string, component string, relation string, members array<string>")
    show = lambda i, m, p, t: [("c", i, "model", m, None), ("c", i, "prompt", p, None)] + ([("c", i, "tools", "x", t)] if t != "absent" else [])
    rows = show("in", "m", "q", ["a"]) + show("out", "z", None, ["a", "z"]) + show("none", "m", "p", None) + show("gone", "m", "p", "absent") + show("empty", "m", "p", [])
    got = {r["config_id"]: (r["inside"], r["outside"]) for r in membership.class_decisions(rules, spark.createDataFrame(rows, "class_id string, config_id string, component string, address string, present array<string>")).collect()}
    assert got == {"in": (True, []), "out": (False, ["model", "prompt", "tools"]), "none": (False, ["tools"]), "gone": (False, ["tools"]), "empty": (True, [])}
    bad = spark.createDataFrame([("x", "model", "pin", ["a", "b"]), ("x", "prompt", "subset_of", ["a"]), ("x", "tools", "any", ["a"]), ("x", "corpus", "pin", [])], rules.schema)
    assert {(r["component"], r["problem"]) for r in membership.rule_violations(bad, ["model", "eval_set"]).collect()} == {("model", "a pin has one member"), ("prompt", "subset_of isn't for this component"), ("tools", "unknown relation"), ("corpus", "no members"), ("eval_set", "no rule")}
    seen = spark.createDataFrame([("c", "tools", "a")], "class_id string, component string, member string")
    assert {(r["component"], tuple(r["missing"])) for r in membership.uncovered(rules.filter("component = 'tools'"), seen).collect()} == {("tools", ("b",))}
    wide = rules.withColumn("members", F.when(F.col("component") == "tools", F.array(F.lit("a"), F.lit("z"))).otherwise(F.col("members")))
    assert [(r["component"], r["gained"]) for r in membership.widened(rules, wide).collect()] == [("tools", ["z"])]
    made = membership.rules_from_evaluated(spark.createDataFrame([("c", "1", "model", "m", None), ("c", "2", "model", "m", None), ("c", "1", "tools", "t1", ["a"]), ("c", "2", "tools", "t2", ["b"]), ("c", "1", "prompt", "p", None), ("c", "2", "prompt", "q", None)], "class_id string, config_id string, component string, address string, present array<string>"), ["tools"])
    assert {r["component"]: (r["relation"], r["members"]) for r in made.collect()} == {"model": ("pin", ["m"]), "tools": ("subset_of", ["a", "b"]), "prompt": ("any_of", ["p", "q"])}


def test_envelopes(spark):
    env = spark.createDataFrame([("e", {"net": "off", "clock": "x"}, ["net"], "ok"), ("bad", {"a": "1"}, ["b"], "ok"), ("blank", {}, [], " "), ("loose", {"a": "1"}, [], "ok")], "envelope_id string, conditions map<string,string>, material array<string>, conclusion string")
    assert {r["envelope_id"] for r in membership.envelope_violations(env).collect()} == {"bad", "blank", "loose"}
    seen = spark.createDataFrame([("e", "1", {"net": "off"}), ("e", "2", {"net": "on"}), ("e", "3", {}), ("e", "4", None), ("zzz", "5", {})], "envelope_id string, run_id string, values map<string,string>")
    assert {r["run_id"]: r["admissible"] for r in membership.condition_checks(env, seen).collect()} == {"1": True, "2": False, "3": False, "4": False, "5": False}
    said, saw = spark.createDataFrame([("e", "net", " None"), ("e", "k", "1")], "envelope_id string, condition string, value string"), spark.createDataFrame([("e", "net", "reached"), ("e", "k", "2")], "envelope_id string, condition string, value string")
    assert membership.contradictions(said, saw, spark.createDataFrame([("net", "none")], "condition string, value string")).count() == 2


def test_delegation(spark):
    nodes = spark.createDataFrame([("g", "root", ["r", "w"], ["a"], True), ("g", "a", ["r"], ["b"], False), ("g", "b", ["r", "w"], ["gone", "a"], False), ("h", "root", None, None, True)], "graph_id string, node string, operations array<string>, delegates_to array<string>, is_root boolean")
    wide = lambda s: {(r["graph_id"], r["node"]): r["widened"] for r in delegation.widened_authority(nodes, s).collect()}
    assert wide("root")["g", "b"] == [] and wide("delegator")["g", "b"] == ["w"] and wide("root")["h", "root"] == []
    assert [tuple(r) for r in delegation.undeclared(nodes).collect()] == [("g", "gone")]
    assert {r["node"]: r["depth"] for r in delegation.depths(nodes).filter("graph_id = 'g'").collect()} == {"root": 0, "a": 1, "b": 2, "gone": 3}
    ok = spark.createDataFrame([("g", "root", True), ("g", "a", True)], "graph_id string, node string, permitted boolean")
    assert {r["graph_id"]: (r["admissible"], r["blocked"]) for r in delegation.run_admissible(nodes, ok).collect()} == {"g": (False, ["b"]), "h": (False, ["root"])}


EVIDENCE = "receipt_id string, agent string, profile string, configuration_address string, passed int, failed int, gate_passed boolean, n_eval int, n_corpus int, structural int, scope string, issued_at string"
PRESENTED = "receipt_id string, configuration_address string, components map<string,string>, members map<string,array<string>>, conditions map<string,string>"


def test_receipts(spark):
    secret = bytes(32)
    rows = [
        ("good", "a", "strict", "A", 2, 0, True, 1, 1, 0, "full", "t"), ("empty", "a", "strict", "A", 2, 0, True, 0, 1, 0, "full", "t"), ("leak", "a", "strict", "A", 2, 0, True, 1, 1, 3, "full", "t"), ("failed", "a", "strict", "A", 1, 1, False, 1, 1, 0, "full", "t"), ("unknown", "a", "strict", "A", None, None, None, None, None, None, "full", "t"),
        ("no_outcome", "a", "strict", "A", 0, 0, True, 1, 1, 0, "full", "t"), ("no_failure", "a", "strict", "A", 0, 0, False, 1, 1, 0, "full", "t"), ("no_gate", "a", "strict", "A", 3, 0, None, 1, 1, 0, "full", "t"),
    ]
    evidence = spark.createDataFrame(rows, EVIDENCE)
    issued = receipts.issue(evidence, secret)
    assert {r["receipt_id"] for r in issued.collect() if r["status"] == "APPROVED"} == {"good"} and all(bool(r["reasons"]) == (r["status"] != "APPROVED") for r in issued.collect())
    assert {r["receipt_id"] for r in receipts.lenient_status(evidence).filter("lenient = 'APPROVED'").collect()} == {"good", "unknown", "no_outcome", "no_failure", "no_gate"}
    forged = issued.filter("receipt_id = 'leak'").withColumn("payload", F.regexp_replace("payload", "REFUSED", "APPROVED"))
    every = issued.filter("receipt_id != 'leak'").unionByName(forged)
    shown = spark.createDataFrame([(r[0], "A") for r in rows] + [("good", "B"), ("nowhere", "A"), ("good", None)], "receipt_id string, configuration_address string")
    key = [ed25519.public_key(secret).hex()]
    verified = receipts.verify(every, shown, key)
    got = sorted((r["receipt_id"], r["verdict"]) for r in verified.collect())
    never = "BLOCKED (receipt was never approved)"
    assert got == sorted([("good", "VERIFIED"), ("good", "BLOCKED (configuration drift)"), ("good", "BLOCKED (configuration drift)"), ("leak", "BLOCKED (receipt signature invalid)"), ("nowhere", "BLOCKED (no receipt)"), *[(k, never) for k in ("empty", "failed", "unknown", "no_outcome", "no_failure", "no_gate")]])
    assert {r["verdict"] for r in receipts.verify(every.filter("receipt_id = 'good'"), shown.filter("receipt_id = 'good' and configuration_address = 'A'"), ["00"]).collect()} == {"BLOCKED (signer not trusted)"}
    says = {r["conclusion"]: r["licensed"] for r in receipts.conclusions(verified.filter("verdict = 'VERIFIED'")).collect()}
    assert says["identity"] and says["authority"] and not says["execution"] and not says["effective model"] and not says["membership"]


def enveloped(spark, exercised=("a", "b"), material=("net",), conclusion="ok", model="pin"):
    """Declared envelopes ``e`` over a class in which tools may vary, the rest is pinned."""
    fixed = [("c", k, "pin", [f"{k}-1"]) for k in ("prompt", "procedure", "corpus", "permissions", "eval_set")] + [("c", "model", model, ["model-1"])]
    rules = spark.createDataFrame([*fixed, ("c", "tools", "subset_of", ["b", "a"])], "class_id string, component string, relation string, members array<string>")
    seen = spark.createDataFrame([(c, k, m) for c, k, _, ms in fixed for m in ms] + [("c", "tools", t) for t in exercised], "class_id string, component string, member string")
    env = spark.createDataFrame([("e", "c", {"net": "off", "clock": "noon"}, list(material), conclusion)], "envelope_id string, class_id string, conditions map<string,string>, material array<string>, conclusion string")
    return receipts.declared_envelopes(env, rules, seen)


def test_envelope_receipts(spark):
    secret = bytes(32)
    made = enveloped(spark)
    rows = spark.createDataFrame([("r", "a", "strict", "A", 6, 0, True, 1, 1, 0, "full", "t", "e"), ("gone", "a", "strict", "A", 6, 0, True, 1, 1, 0, "full", "t", "zz"), ("point", "a", "strict", "A", 6, 0, True, 1, 1, 0, "full", "t", None)], EVIDENCE + ", envelope_id string")
    issued = receipts.issue(rows, secret, made).persist()
    assert {r["receipt_id"]: (r["status"], r["payload"] is None) for r in issued.collect()} == {"r": ("APPROVED", False), "gone": ("NOT ISSUED", True), "point": ("APPROVED", False)}
    for bad in (enveloped(spark, exercised=("a",)), enveloped(spark, material=("gone",)), enveloped(spark, conclusion=" "), enveloped(spark, material=()), enveloped(spark, model="subset_of")):
        status = {r["receipt_id"]: (r["status"], len(r["reasons"])) for r in receipts.issue(rows, secret, bad).collect()}
        assert status["r"][0] == "NOT ISSUED" and status["r"][1] >= 1
    parts = {k: f"{k}-1" for k in ("model", "prompt", "procedure", "corpus", "permissions", "eval_set", "tools")}
    on = {"net": "off"}
    cases = [
        ("r", "A", parts, {"tools": ["a"]}, on, []), ("r", "B", parts, {"tools": ["b", "a"]}, {**on, "clock": "two"}, []), ("r", "A", parts, {"tools": ["a", "z"]}, on, ["tools"]), ("r", "A", parts, {"tools": ["a"]}, {"net": "on"}, ["net"]), ("r", "A", parts, {"tools": ["a"]}, None, ["net"]),
        ("r", "A", {**parts, "model": "other"}, {"tools": ["a"]}, on, ["model"]), ("r", "A", parts, None, on, ["tools"]), ("r", "A", None, None, on, sorted(parts)),
    ]
    key = [ed25519.public_key(secret).hex()]
    for *row, outside in cases:
        got = receipts.verify(issued, spark.createDataFrame([tuple(row)], PRESENTED), key).collect()[0]
        assert got["outside"] == outside and got["permitted"] == (not outside) and got["verdict"].startswith("OUTSIDE ENVELOPE" if outside else "ADMISSIBLE (inside envelope "), (row, got)
    inside = spark.createDataFrame([tuple(cases[0][:-1])], PRESENTED)
    assert receipts.verify(issued, inside).collect()[0]["verdict"].endswith("signer not anchored)")
    says = {r["conclusion"]: r["licensed"] for r in receipts.conclusions(receipts.verify(issued, inside, key)).collect()}
    assert says["membership"] and not says["identity"] and not says["evaluation"] and not says["equal behaviour"]
    # a declaration that isn't what was addressed, or covers less than it names, signed all the same
    for change in (("off", "on"), ('"exercised_members":{"corpus":["corpus-1"]', '"exercised_members":{"corpus":[]')):
        text = issued.filter("receipt_id = 'r'").collect()[0]["payload"].replace(*change)
        forged = spark.createDataFrame([("r", text)], "receipt_id string, p string").select("receipt_id", receipts.signed(F.col("p"), secret).alias("s")).select("receipt_id", "s.*")
        assert not receipts.verify(forged, inside, key).collect()[0]["permitted"]


def test_receipt_files(spark, tmp_path):
    secret = receipts.load_or_create_key(str(tmp_path / "key"))
    assert receipts.load_or_create_key(str(tmp_path / "key")) == secret and (tmp_path / "key").stat().st_mode & 0o777 == 0o600
    issued = receipts.issue(spark.createDataFrame([("r", "a", "strict", "A", 6, 0, True, 1, 1, 0, "full", "t")], EVIDENCE), secret)
    receipts.save_receipts(issued, str(tmp_path / "receipts"))
    shown = spark.createDataFrame([("r", "A")], "receipt_id string, configuration_address string")
    assert receipts.verify(receipts.load_receipts(spark, str(tmp_path / "receipts")), shown).collect()[0]["verdict"] == "VERIFIED (signer not anchored)"
    events = receipts.audit_events(receipts.verify(issued, shown), shown, "pay", "me").collect()
    assert [(e["action"], e["allowed"]) for e in events] == [("pay", True)]


def test_ed25519_vector():
    secret = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = ed25519.public_key(secret)
    assert public.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    s = ed25519.sign(secret, b"")
    assert s.hex().startswith("e5564300c360ac729086e2cc806e828a") and ed25519.verify(public, b"", s) and not ed25519.verify(public, b"x", s) and not ed25519.verify(b"", b"", s)


def test_relation_suites(spark):
    s = {r["identity"]: (r["correct"], r["false_blocks"], r["false_accepts"], r["refused"]) for r in variants.relation_scores(variants.compare_relations(spark)).collect()}
    assert s == {"raw_bytes": (5, 4, 0, 0), "naive_canonical": (6, 1, 2, 0), "strict": (8, 1, 0, 0), "eval": (8, 0, 1, 0), "policy": (9, 0, 0, 0), "integral_safe": (7, 0, 1, 1)}
    texts = [(1, json.dumps([{"name": "é\na", "n": 1, "b": 2, "c": 3, "d": 4}])), (2, '{"n": 1.50, "m": {}, "k": [], "é": "x"}'), (3, "nope"), (4, None), (5, '{"name": "z"}'), (6, "[]")]
    rows = variants.conformance(spark.createDataFrame(texts, "record_id int, payload string"))
    assert rows.filter("not ok").count() == 0 and rows.select("record_id").distinct().count() == 4
    of_one = {(r["variant"], r["relation"]): r for r in variants.conformance_summary(rows.filter("record_id = 1")).collect()}
    assert len(of_one) == 24 and sum(r["n_informative"] for r in of_one.values()) == 20 and sum(r["byte_false_alarms"] for (_, rel), r in of_one.items() if rel == "strict") == 3


def test_conformance_is_told_from_parts(spark, monkeypatch):
    tool = {"name": "é\na", "n": 7, "inputSchema": {"type": "object", "properties": {"a": {"maximum": 10**20}, "ü": {"type": ["x", 1.5]}}}}
    deep = '{"a":' * 300 + "1" + "}" * 300
    # keys that are one under a relation, shadowed or respelled members, numbers out of range, names that a variant adds
    odd = ['{"é": 1, "e\u0301": 2}', '{"a b": 1, "a  b": 2}', '{"a": "\\ud800", "a": 1}', '{"a": "x", "a": 2}', '{"x": 1e400}', '{"further": true}', '{"x": {"further": true}}', '{"name" :"\\u0061\\/\x7f"}', '{"a": "\\r\\nb", "-": -0}', '[{"name": 1}]', "[[{}]]", "[]", "{}", "5", '"x"', "9" * 320, deep, f"[{deep}]", json.dumps({f"k{i}": "ü" * 1200 for i in range(80)})]
    plain = [json.dumps(tool), json.dumps(tool, ensure_ascii=False, indent=1), json.dumps([tool, 1])]
    outcomes = variants.Outcomes()
    assert [outcomes.of(t) for t in plain + odd] == [variants.outcome(t) for t in plain + odd]
    assert [outcomes.of(t) for t in (None, "nope", "", '{"a": NaN}', '{"a": "\\ud800"}')] == [None] * 5
    made = variants.conformance(spark.createDataFrame(list(enumerate([*plain, *odd, '{"a": NaN}'])), "record_id int, payload string"))
    assert made.count() == 24 * len(plain + odd) and made.filter("record_id < 3 and not ok").count() == 0
    # members known from other records aren't canonicalized again
    again = []
    monkeypatch.setattr(variants, "canonical_bytes", lambda *a: again.append(a))
    assert outcomes.of(json.dumps({**tool, "inputSchema": {"properties": {"ü": {"maximum": 7}}}})) and not again


def test_private_members_and_classes(spark):
    rows = spark.createDataFrame([('{"_id": "x", "a": 1.50, "b": {"_c": 2}, "_z": [1]}',), ('{"_only": 1}',), ("[1]",), (None,)], "t string")
    assert [r[0] for r in rows.select(variants.payload_column("t")).collect()] == ['{"a": 1.50, "b": {"_c": 2}}', "{}", "[1]", None]
    rules = [("c", "model", "pin", ["m"]), ("c", "tools", "subset_of", ["a", "b"])]
    schema = "class_id string, component string, relation string, members array<string>"
    one = membership.class_addresses(spark.createDataFrame(rules, schema)).collect()[0]
    same = membership.class_addresses(spark.createDataFrame([("c", "tools", "subset_of", ["b", "a"]), rules[0]], schema)).collect()[0]
    assert one["class_address"] == same["class_address"] and "model" in one["declared"]
    shown = spark.createDataFrame([("m", ["a"]), ("m", ["z"]), (None, None)], "m string, t array<string>")
    outside = membership.outside_class([r[1:] for r in rules], {"model": (F.col("m"), None), "tools": (None, F.col("t"))})
    assert [r[0] for r in shown.select(outside).collect()] == [[], ["tools"], ["model", "tools"]]
    pairs = releases.version_pairs(spark.createDataFrame([("p", f"1.{i}") for i in range(12)], "package string, version string"), 4)
    assert {(r["version_from"], r["version_to"]) for r in pairs.collect()} == {(f"1.{i}", f"1.{i + 1}") for i in range(11)}


def test_variants_keep_what_they_do_not_mean_to_change():
    text = '{"a": 1.50, "b": [1, {"c": "x\\u00e9", "name": "n"}], "d": {}, "e": -2e5}'
    for v in variants.VARIANTS:
        json.loads(variants.varied(text, v.name))
    assert variants.varied(text, "key_reorder") == '{"e": -2e5, "d": {}, "b": [1, {"name": "n", "c": "x\\u00e9"}], "a": 1.50}'
    assert variants.varied(text, "int_to_float") == '{"a": 1.50, "b": [1.0, {"c": "x\\u00e9", "name": "n"}], "d": {}, "e": -2e5}'
    assert variants.varied('{"name": "n"}', "field_removed") == '{"name": "n"}' and json.loads(variants.varied('[{"name": "n", "x": 1}]', "field_removed")) == [{"name": "n"}]
    assert json.loads(variants.varied(text, "field_removed")) == {k: v for k, v in json.loads(text).items() if k != "a"}
    assert variants.varied("{}", "element_added") == '{"further": true}' and variants.varied("[1]", "element_added") == '[1, {"name": "further"}]'


def test_contamination_levels(spark):
    items = [(f"e{i}", {"id": f"e{i}", "text": f"the claimant José number {i} reports water in room {i * 7}, invoice {i}", "n": i}) for i in range(10)]
    ev = contamination.addressed(spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in items], "item_id string, payload string").withColumn("raw", F.col("payload")))
    co = contamination.addressed(variants.planted(ev.select("item_id", "payload")).withColumn("raw", F.col("payload")))
    with pytest.raises(ValueError):
        variants.planted(ev.limit(0))
    found = contamination.equal_records(ev, co, "byte_addr", "byte").unionByName(contamination.equal_records(ev, co, "eval_addr", "structural"))
    s = {r["method"]: (r["found"], r["missed"], r["false_positives"]) for r in contamination.method_scores(found, co, ["byte", "structural", "lexical"]).collect()}
    assert s == {"byte": (2, 8, 0), "structural": (8, 2, 0), "lexical": (0, 10, 0)}


def test_scan_report(spark):
    items = spark.createDataFrame([(f"e{i}", json.dumps({"id": f"e{i}", "text": f"please cancel the invoice number {i} of José in room {i * 7}", "n": i})) for i in range(10)], "item_id string, payload string").withColumn("raw", F.col("payload"))
    corpus = variants.planted(items).withColumn("raw", F.col("payload"))
    report = contamination.scan_report(items, corpus)
    relations = {(r["method"], r["relation"]): r["n"] for r in report["by_relation"].collect()}
    assert relations["byte", "exact"] == 2 and relations["structural", "serialization"] == 4 and relations["structural", "structural"] == 2 and ("structural", "paraphrase") not in relations
    missed = {(r["method"], r["relation"]) for r in report["missed"].collect()}
    assert ("structural", "paraphrase") in missed and ("structural", "exact") not in missed and ("byte", "serialization") in missed
    assert report["gain"].collect()[0]["gain"] == 6
    for empty in ((items.limit(0), corpus), (items, corpus.limit(0))):
        with pytest.raises(ValueError):
            contamination.scan_report(*empty)
    twice = spark.createDataFrame([("r", "nothing alike at all"), ("r", "water in the cellar")], "record_id string, flat string")
    assert contamination.lexical_matches(spark.createDataFrame([("i", "water in the cellar")], "item_id string, flat string"), twice, 0.9).count() == 1
    lines = contamination.shared_lines(spark.createDataFrame([("a", "This is a stock sentence. Only the first item says this."), ("b", "This is a stock sentence. The second says another thing.")], "i string, t string"), spark.createDataFrame([(1, "This is a stock sentence. Only the first item says this.")], "r int, t string"), "i", "t", "r", "t")
    assert [tuple(r) for r in lines.collect()] == [("a", 1, 1)]


def test_lexical_against_all_pairs(spark):
    import math
    from collections import Counter

    texts = {"a": "Water in the cellar", "b": "water in  the CELLAR today", "c": "fire upstairs", "d": "", "e": None, "f": "a"}
    grams = {}
    for k, t in texts.items():
        c = Counter()
        for w in (t or "").lower().split():
            p = f" {w} "
            for n in (3, 4, 5):
                if len(p) <= n:
                    c[p] += 1
                    break
                c.update(p[i : i + n] for i in range(len(p) - n + 1))
        grams[k] = c
    n = 2 * len(texts)
    df = Counter(g for c in grams.values() for g in c)
    idf = {g: math.log((1 + n) / (1 + 2 * df[g])) + 1 for g in df}
    vec = {k: {g: x * idf[g] for g, x in c.items()} for k, c in grams.items()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vec.items()}
    want = {(a, b): round(sum(x * vec[b].get(g, 0) for g, x in vec[a].items()) / (norm[a] * norm[b]), 6) for a in vec for b in vec if norm[a] and norm[b]}
    df_ = spark.createDataFrame(list(texts.items()), "id string, flat string")
    got = contamination.lexical_matches(df_.withColumnRenamed("id", "item_id"), df_.withColumnRenamed("id", "record_id"), 0.3)
    assert {(r["item_id"], r["record_id"]): round(r["score"], 6) for r in got.collect()} == {k: v for k, v in want.items() if v >= 0.3}
    with pytest.raises(ValueError):
        contamination.lexical_matches(df_.withColumnRenamed("id", "item_id"), df_.withColumnRenamed("id", "record_id"), 0)


def test_evaluation_and_sampling(spark):
    rows = [("a", True, ["x"]), ("a", True, ["y", "x"]), ("a", True, None), ("a", None, []), ("b", False, None)]
    got = {r["config_id"]: r for r in receipts.evaluation_scores(spark.createDataFrame(rows, "config_id string, ok boolean, used array<string>")).collect()}
    assert (got["a"]["passed"], got["a"]["failed"], got["a"]["gate_passed"], got["a"]["dependencies"]) == (3, 1, True, ["x", "y"]) and not got["b"]["gate_passed"]
    versions = spark.createDataFrame([("p", f"1.{i}") for i in range(11)] + [("q", "1")], "package string, version string")
    kept = sorted((r["version"] for r in releases.evenly_spread(versions, 3).filter("package = 'p'").collect()), key=lambda v: int(v[2:]))
    assert kept == ["1.0", "1.5", "1.10"] and releases.evenly_spread(versions, 3).count() == 4
