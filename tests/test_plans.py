"""Registered queries on small tables: states between the first and the last count, and failed listings are none."""

from __future__ import annotations

import importlib

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import manifest

entry = importlib.import_module("__spark_entry__")

SNAPSHOTS = "snap_no int, delivered_at timestamp_ntz, package string, name string, description string, input_schema string, error string"


@pytest.fixture(scope="module")
def snapshot_dir(spark, tmp_path_factory):
    """p: changed in 2 and back in 3; late: first listed in 2, fails in 12; once: listed in 5 alone."""
    d = tmp_path_factory.mktemp("snapshots")
    told = [(1, "p", "t", "x"), (2, "p", "t", "y"), (3, "p", "t", "x"), (12, "p", "t", "x"), (2, "late", "t", "x"), (3, "late", "t", "x"), (3, "late", "u", "x"), (5, "once", "t", "x")]
    rows = [(n, p, t, x, "{}", None) for n, p, t, x in told] + [(12, "late", None, None, None, "down"), (1, "never", None, None, None, "down")]
    df = spark.createDataFrame(rows, "snap_no int, package string, name string, description string, input_schema string, error string")
    df.withColumn("delivered_at", F.lit("2026-01-01").cast("timestamp_ntz")).select(*[c.split()[0] for c in SNAPSHOTS.split(", ")]).write.parquet(f"{d}/tool_snapshots.parquet")
    docs = [(1, "a", "p"), (2, "b", "p"), (3, "c", "late"), (4, "d", None), (5, None, "p")]
    spark.createDataFrame(docs, "doc_id long, text string, package string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("i", "no such text")], "id string, narrative string").write.parquet(f"{d}/eval_items.parquet")
    return str(d)


def run(spark, name, d):
    return sorted(tuple(r) for r in entry.queries()[name](spark, d).collect())


def test_every_listed_state_has_a_manifest(spark, snapshot_dir):
    got = {r["config_id"]: r for r in entry.queries()["package_manifests"](spark, snapshot_dir).collect()}
    assert set(got) == {"p@1", "p@2", "p@3", "p@12", "late@2", "late@3", "once@5"}
    assert got["p@1"]["configuration_address"] == got["p@3"]["configuration_address"] != got["p@2"]["configuration_address"]
    docs = [("q", "agent", "agent.json", '{"name": "p", "model": {"id": "m-1"}, "allowed_operations": ["read"]}'), ("q", "tool", "t", '{"name": "t", "description": "x", "inputSchema": "{}"}'), ("q", "corpus", "1", "a"), ("q", "corpus", "2", "b")]
    alone = manifest.manifests(spark.createDataFrame(docs, "config_id string, component string, name string, content string")).collect()[0]
    assert all(alone[c] == got["p@1"][c] for c in ("tools", "corpus", "configuration_address"))


def test_drift_and_receipts_over_consecutive_states(spark, snapshot_dir):
    assert run(spark, "package_drift", snapshot_dir) == [("late@3", "tools", False, False), ("p@2", "tools", False, False), ("p@3", "tools", False, False)]
    verdicts = {r["receipt_id"]: r["verdict"] for r in entry.queries()["receipts_verify"](spark, snapshot_dir).collect()}
    drifted = "BLOCKED (configuration drift)"
    assert verdicts == {"p@1": drifted, "p@2": drifted, "p@3": "VERIFIED", "p@12": "NOT PRESENTED", "late@2": drifted, "late@3": "NOT PRESENTED", "once@5": "NOT PRESENTED"}
    assert {r["receipt_id"]: r["status"] for r in entry.queries()["receipts_issue"](spark, snapshot_dir).collect()} == {**dict.fromkeys(("p@1", "p@2", "p@3", "p@12", "late@2", "late@3"), "APPROVED"), "once@5": "REFUSED"}


def test_tool_changes_of_every_step(spark, snapshot_dir):
    assert run(spark, "drift_steps", snapshot_dir) == [("late", "u", 3, "tool", "added"), ("p", "t", 2, "description", "changed"), ("p", "t", 3, "description", "changed")]


def test_tool_changes_between_a_packages_own_ends(spark, snapshot_dir):
    assert run(spark, "drift_fields", snapshot_dir) == [("late", "u", "tool", "added")]


def test_every_line_counts_for_coverage(spark, tmp_path):
    rows = [(1, 1, "1995-01-01"), (1, 2, "1995-06-01"), (1, 1, "1997-01-01"), (2, 3, "1994-01-01"), (3, 3, "1998-01-01")]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, d string").withColumn("l_shipdate", F.col("d").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert run(spark, "class_coverage", str(tmp_path)) == [(1, 1), (2, 1)]
