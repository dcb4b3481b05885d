"""Schema drift: planted changes must come out, and nothing else."""

from __future__ import annotations

import json

import pytest

from lodestrand.operators import drift

SCHEMA = "capture_id long, package string, version string, tools string, error string, path string, field string"


def capture(i, p, v, tools, e=None):
    return (i, p, v, None if tools is None else json.dumps(tools), e, "clash", "clash")


def tools(n=4, **members):
    out = []
    for i in range(n):
        t = {"name": f"t{i}", "description": "d", "inputSchema": {"type": "object", "properties": {"title": {"title": "x"}}}, "annotations": {"destructiveHint": bool(i % 2)}}
        for k, make in members.items():
            at, keys = t, k.split("__")
            for key in keys[:-1]:
                at = at.setdefault(key, {})
            at[keys[-1]] = make(i)
        out.append(t)
    return out


def name(i):
    return f"Title {i}"


def found(spark, rows):
    return sorted(tuple(r) for r in drift.schema_changes(spark.createDataFrame(rows, SCHEMA)).select("package", "version", "field", "kind").collect())


def test_planted_changes(spark):
    rows = [
        capture(1, "p", "1.2", tools(title=name)), capture(2, "p", "1.10", tools(heading=name, execution__taskSupport=lambda i: "optional" if i % 2 else "required")), capture(3, "p", "1.11", tools(heading=lambda i: [name(i)], runtime__taskSupport=lambda i: "optional" if i % 2 else "required")),
        capture(4, "p", "1.12", None, "down"), capture(5, "p", "2.0", tools(category=lambda i: f"c{i}", runtime__taskSupport=lambda i: ["optional" if i % 2 else "required"])), capture(6, "p", "2.0.1", tools(title=name, annotations__readOnlyHint=lambda i: i % 3 == 0)),
        capture(7, "p", "2.0.2", tools(title=name, annotations__read_only_hint=lambda i: 1 if i % 3 == 0 else 0)), capture(6, "p", "2.0.1", list(reversed(tools(title=name, annotations__readOnlyHint=lambda i: i % 3 == 0)))),
        capture(8, "q", "1.0", tools(outputSchema__type=lambda i: "object")), capture(9, "q", "1.1", tools(outputSchema__kind=lambda i: "object")), capture(10, "q", "1.2", tools(title=lambda i: None, outputSchema__kind=lambda i: ["object", "null"])), capture(11, None, "1", tools()), capture(12, "r", "1", tools(title=name)),
    ]
    assert found(spark, rows) == sorted([
        ("p", "1.10", "title", "renamed"), ("p", "1.10", "execution.taskSupport", "added"), ("p", "1.11", "title", "retyped"), ("p", "1.11", "execution.taskSupport", "renamed"), ("p", "2.0", "title", "removed"), ("p", "2.0", "execution.taskSupport", "retyped"),
        ("p", "2.0.1", "title", "added"), ("p", "2.0.1", "execution.taskSupport", "removed"), ("p", "2.0.1", "annotations.readOnlyHint", "added"), ("p", "2.0.2", "annotations.readOnlyHint", "renamed"), ("p", "2.0.2", "annotations.readOnlyHint", "retyped"),
        ("q", "1.1", "outputSchema.type", "renamed"), ("q", "1.2", "outputSchema.type", "retyped"),
    ])
    wide = drift.consistent_tools(spark.createDataFrame(rows, SCHEMA)).filter("package = 'p' and version = '1.11' and tool = 't1'").collect()[0]
    assert wide["title"] == "Title 1" and wide["execution_taskSupport"] == "optional"


def test_empty_and_unusable(spark):
    assert found(spark, []) == []
    assert found(spark, [capture(1, "p", "1", None), (2, "p", "2", "nope", None, "x", "x"), (3, "p", "3", "[1]", None, "x", "x")]) == []


def test_versions_of_bare_tools_count(spark):
    rows = [
        capture(1, "first", "1", [{"name": "t0", "description": "d", "inputSchema": {}}]), capture(2, "first", "2", tools(title=name)), capture(3, "mid", "1", tools(title=name)), capture(4, "mid", "2", []), capture(5, "mid", "3", tools(title=name)),
        capture(6, "last", "1", tools(title=name)), capture(7, "last", "2", {"tools": [{"name": "t0"}]}), capture(8, "failed", "1", tools(title=name)), capture(9, "failed", "2", [], "down"), (10, "failed", "3", "nope", None, "x", "x"), capture(11, "failed", "4", tools(title=name)),
    ]
    assert found(spark, rows) == [("first", "2", "title", "added"), ("last", "2", "title", "removed"), ("mid", "2", "title", "removed"), ("mid", "3", "title", "added")]


@pytest.mark.parametrize("rows_per_chunk", [500_000, 3])
def test_version_order_of_long_histories(spark, rows_per_chunk):
    versions = ["0.9", "0.10", "1.0", "1.0.1", "1.2", "1.10", "2", "10.0", "10.0.0", "x.1"]
    rows = spark.createDataFrame([("p", v, [(len(v), 3, 1)]) for v in versions], f"package string, version string, paths array<{drift.MEMBER}>")
    pairs = drift.version_pairs(rows, rows_per_chunk).collect()
    want = ["x.1", *versions[:-1]]
    assert {(r["before"], r["version"]) for r in pairs} == set(zip(want, want[1:])) and all(r["p"][0]["h"] == len(r["before"]) and r["c"][0]["h"] == len(r["version"]) for r in pairs)


def test_flooding_prefers_the_fitting_place():
    pairs = [{"old": "execution.taskSupport", "new": n, "old_type": "string", "new_type": t, "agree": 1.0} for n, t in (("runtime", "object"), ("runtime.taskSupport", "string"))]
    assert [(m["old"], m["new"]) for m in drift.select_matches(pairs)] == [("execution.taskSupport", "runtime.taskSupport")]
    pairs = [{"old": "title", "new": n, "old_type": "string", "new_type": t, "agree": a} for n, t, a in (("heading", "object", 1.0), ("heading.default", "string", 1.0), ("category", "string", 0.0))]
    assert [(m["old"], m["new"]) for m in drift.select_matches(pairs)] == [("title", "heading")]
    assert drift.select_matches([]) == []
