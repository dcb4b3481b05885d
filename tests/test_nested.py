"""Flattening by tagged emission against a recursive reading."""

from __future__ import annotations

import json

from lodestrand.operators import nested

SCHEMA = "capture_id long, tools string, error string, tag string, payload string"


def plain(captures):
    out = set()

    def walk(c, no, branch, path, node):
        if not isinstance(node, dict):
            return
        r = node.get("required")
        for e in [r] if isinstance(r, str) else r if isinstance(r, list) else []:
            if e is not None:
                out.add((c, no, branch, path, e if isinstance(e, str) else json.dumps(e, separators=(",", ":"))))
        for k, v in (node.get("properties") or {}).items() if isinstance(node.get("properties"), dict) else []:
            walk(c, no, branch, f"{path}.{k}" if path else k, v)
        walk(c, no, branch, path + "[]", node.get("items"))

    for c, t, e, *_ in captures:
        if t is None or (e or "").strip():
            continue
        try:
            tools = json.loads(t)
        except ValueError:
            continue
        tools = tools.get("tools") if isinstance(tools, dict) else tools
        for no, tool in enumerate(tools if isinstance(tools, list) else []):
            if isinstance(tool, dict):
                walk(c, no, "inputSchema", "", tool.get("inputSchema"))
                walk(c, no, "outputSchema", "", tool.get("outputSchema"))
                h = (tool.get("annotations") or {}).get("destructiveHint")
                if str(h).lower() in ("true", "false"):
                    out.add((c, no, "annotations", "", f"destructiveHint={str(h).lower()}"))
    return out


def deep(n):
    node = {"required": ["end"]}
    for i in range(n):
        node = {"type": "array", "items": node} if i % 2 else {"properties": {f"p{i}": node, "required": {"type": "string"}}, "required": "one"}
    return node


def cases():
    tool = {"name": "t", "inputSchema": deep(9), "outputSchema": {"required": ["a", "a", None, 3, {"x": 1}], "items": {"items": {"required": ["q"]}}, "properties": {"properties": {"required": ["z"]}, "items": {"required": True}}}, "annotations": {"destructiveHint": "True"}}
    plain_ = {"name": "u", "inputSchema": None, "annotations": {"destructiveHint": False}}
    return [
        (1, json.dumps([tool, 5, plain_]), None, "x", "x"), (1, json.dumps([tool, 5, plain_], indent=2), None, "x", "x"), (2, json.dumps({"tools": [plain_, tool]}), " ", "x", "x"), (3, json.dumps([tool]), "down", "x", "x"), (4, None, None, "x", "x"), (5, "nope", None, "x", "x"), (6, "{}", None, "x", "x"),
        (7, '[{"inputSchema":{"required":["a"],"required":["b"]},"annotations":{"destructiveHint":null}}]', None, "x", "x"), (8, "[]", None, "x", "x"), (None, json.dumps([plain_]), None, "x", "x"), (9, "", None, "x", "x"), (10, json.dumps([{"inputSchema": {"required": ["é" * 5000]}}]), None, "x", "x"),
    ]


def test_against_recursion(spark):
    rows = cases()
    got = [tuple(r) for r in nested.required_and_hints(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert nested.required_and_hints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_deep_listing_is_rejected_or_read():
    out = nested.Emitter()
    out.capture(1, json.dumps([{"inputSchema": deep(60)}]))
    assert out.rows["required"] and not out.rows["reject"]
    out = nested.Emitter()
    out.capture(1, "[" * 200_000)
    assert {tag for tag, rows in out.rows.items() if rows} == {"reject"}


def test_links_lead_to_parents(spark):
    tables = nested.flat_tables(spark.createDataFrame(cases(), SCHEMA))
    rows = {tag: t.collect() for tag, t in tables.items()}
    keys = {tag: {r["pk"] for r in found} for tag, found in rows.items()}
    assert all(len(keys[tag]) == len(found) for tag, found in rows.items()) and len(rows["tool"]) == 7 and len(rows["reject"]) == 3
    for tag, above in nested.PARENTS.items():
        assert rows[tag] and all(any(r["parent_pk"] in keys[a] for a in above) for r in rows[tag])
    assert all(r["parent_pk"] == f"c{r['capture_id']}" for r in rows["tool"])
    report = {r["tag"]: (r["n_rows"], r["n_orphans"]) for r in nested.table_report(spark.createDataFrame(cases(), SCHEMA)).collect()}
    assert report == {tag: (len(found), 0) for tag, found in rows.items()}


def test_orphans_are_counted(spark):
    emission = nested.tagged_emission(spark.createDataFrame(cases()[:1], SCHEMA)).filter("not (tag = 'schema' and path = '')")
    split = nested.split_by_tag(emission)
    kept = {r["pk"] for r in split.filter("tag in ('tool', 'schema')").collect()}
    assert any(r["parent_pk"] not in kept for r in split.filter("tag = 'required'").collect())
