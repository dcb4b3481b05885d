"""Entry points, the streaming gate and sinks."""

from __future__ import annotations

import importlib
import os

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import ed25519
from lodestrand.operators import receipts
from lodestrand.sources import sinks
from lodestrand.streaming import gate

entry = importlib.import_module("__spark_entry__")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p3_found", "p4_found", "p5_found"} <= set(entry.queries())


def test_found_columns(spark, data_dir):
    want = {
        "p1_found": [("tool_id", "bigint"), ("valid_from", "string"), ("valid_to", "string")], "p2_found": [("doc_id", "bigint"), ("eval_id", "string")], "p3_found": [("package", "string"), ("tool_name", "string"), ("snap_no", "int"), ("kind", "string")],
        "p4_found": [("capture_id", "bigint"), ("tool_no", "bigint"), ("branch", "string"), ("path", "string"), ("entry", "string")], "p5_found": [("package", "string"), ("version", "string"), ("field", "string"), ("kind", "string")], "p8_found": [("doc_id", "bigint")],
    }
    for name, columns in want.items():
        if name in entry.queries():
            assert sorted(entry.queries()[name](spark, data_dir).dtypes) == sorted(columns), name


def test_flagship(spark, data_dir):
    if not os.path.isdir(entry.SMOKE):
        pytest.skip("no smoke tables")
    assert entry.entry(spark).count() >= 0


def test_stream_of_presented_configurations(spark, tmp_path):
    secret = bytes(32)
    fields = "receipt_id string, agent string, profile string, configuration_address string, passed int, failed int, gate_passed boolean, n_eval int, n_corpus int, structural int, scope string, issued_at string"
    issued = receipts.issue(spark.createDataFrame([("r", "a", "strict", "A", 2, 0, True, 1, 1, 0, "full", "t")], fields), secret)
    shown = spark.createDataFrame([("r", "A"), ("r", "B"), ("x", "A")], "receipt_id string, configuration_address string")
    shown.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shown.schema).parquet(str(tmp_path / "in"))
    gate.to_table(gate.decisions(stream, issued, [ed25519.public_key(secret).hex()]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["verdict"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["BLOCKED (configuration drift)", "BLOCKED (no receipt)", "VERIFIED"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", "1"), ("p", "2")], "package string, version string")
    sinks.write_report(df, str(tmp_path / "r"), "json", ["package"])
    sinks.write_report(df, str(tmp_path / "r"), "json", ["package"])
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    sinks.append_events(df, str(tmp_path / "e"))
    sinks.append_events(df, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 4
    assert sinks.new_captures(df, df.filter(F.col("version") == "1")).count() == 1
