"""Field drift between configurations, and the suite of seven checks."""

from __future__ import annotations

import json

from lodestrand.operators import configdiff, suite

ARTIFACTS = "config_id string, component string, name string, content string"


def artifacts(config_id, tools=("a", "b"), docs=(("d1", "x\ny"), ("d2", "z")), items=('{"id": "1", "v": 1}', '{"id": "2", "v": 1}'), prompt="hi\nthere", operations=("r", "w"), model="m", **agent):
    head = {"name": "n", "model": {"id": model}, "allowed_operations": list(operations), **agent}
    rows = [(config_id, "agent", "agent.json", json.dumps(head)), (config_id, "prompt", "prompt.txt", prompt)]
    rows += [(config_id, "tool", "", t if t.startswith("{") else json.dumps({"name": t, "description": "é of " + t})) for t in tools]
    return rows + [(config_id, "corpus", n, t) for n, t in docs] + [(config_id, "eval_item", json.loads(i)["id"], i) for i in items]


def drift(spark, before, after):
    rows = configdiff.field_drift(spark.createDataFrame(before, ARTIFACTS), spark.createDataFrame(after, ARTIFACTS)).collect()
    return sorted((r["config_id"], r["component"], r["path"], r["change"]) for r in rows)


def test_every_component_is_told(spark):
    before, after = artifacts("same"), artifacts("same")
    sides = {
        "tools": ({}, {"tools": ('{"name": "a", "description": "new"}', "c")}), "twice": ({}, {"tools": ("a", "a")}), "prompt": ({}, {"prompt": "hi\nyou"}), "ops": ({}, {"operations": ("w", "x")}), "model": ({}, {"model": "m2"}),
        "docs": ({}, {"docs": (("d1", "x\nq"), ("d3", "z"))}), "items": ({}, {"items": ('{"id": "1", "v": 2}', '{"id": "2", "v": 1}')}), "fewer": ({}, {"items": ('{"id": "1", "v": 1}',)}), "agent": ({}, {"note": "x"}),
    }
    for k, (b, a) in sides.items():
        before, after = before + artifacts(k, **b), after + artifacts(k, **a)
    assert drift(spark, before, after) == sorted([
        ("tools", "tools", "tools/a/description", "changed"), ("tools", "tools", "tools/b", "removed"), ("tools", "tools", "tools/c", "added"), ("twice", "tools", "tools", "ambiguous"), ("prompt", "prompt", "prompt:line 2", "changed"),
        ("ops", "permissions", "permissions", "granted"), ("ops", "permissions", "permissions", "revoked"), ("model", "model", "model/id", "changed"), ("docs", "corpus", "corpus/d1:line 2", "changed"), ("docs", "corpus", "corpus/d2", "removed"), ("docs", "corpus", "corpus/d3", "added"),
        ("items", "eval_set", "eval_set[0]/v", "changed"), ("fewer", "eval_set", "eval_set", "changed"), ("agent", "agent", "agent/note", "added"),
    ])
    assert drift(spark, [], []) == []


def test_suite_of_seven(spark):
    rows = spark.createDataFrame(artifacts("c") + artifacts("failed"), ARTIFACTS)
    read = spark.createDataFrame([("c", "d1"), ("failed", "d1")], "config_id string, name string")
    scores = spark.createDataFrame([("c", 3, 1, True), ("failed", 0, 2, False)], "config_id string, passed int, failed int, gate_passed boolean")
    got = suite.run_suite(rows, read, scores, bytes(32), "t").collect()
    assert sorted(r["n"] for r in got if r["config_id"] == "c") == [1, 2, 3, 4, 5, 6, 7] and all(r["ok"] for r in got if r["config_id"] == "c"), got
    assert {r["actual"] for r in got if r["config_id"] == "failed"} == {"no evidence"}
