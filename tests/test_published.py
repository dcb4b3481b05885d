"""Published figures of the public demo configuration and capture set, where a copy of them is at hand.

DEMO_CONFIG and CAPTURE_FILES name the folders; without them, folders ``demo`` and ``realdata/tools`` beside the repository's
are looked for.
"""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from lodestrand.functions.canon import short
from lodestrand.operators import contamination, manifest, releases, variants
from lodestrand.sources import configs

BESIDE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Fixed values of the published sweep: what its unrelated records are about.
SUBJECTS = ("warranty claim", "address change", "duplicate charge", "late delivery", "plan downgrade", "seat transfer", "tax exemption", "bulk order", "return label", "expired coupon", "payment retry", "account merge")


def place(variable, pattern):
    found = os.environ.get(variable) or next(iter(sorted(glob.glob(os.path.join(BESIDE, pattern)))), None)
    if not found:
        pytest.skip(f"{variable} is not set")
    return found


def test_addresses(spark):
    a = configs.configuration(spark, os.path.dirname(place("DEMO_CONFIG", "*/demo/agent.json")), "demo")
    read = a.filter("component = 'corpus'").select("config_id", "name")
    r = manifest.manifests(a, "strict", read).collect()[0]
    want = {"model": "bb7f8909", "prompt": "3d61c95c", "procedure": "b83f38f6", "tools": "d8c41de2", "corpus": "ac168caf", "permissions": "c7e07b60", "eval_set": "cda66f55"}
    assert {k: short(r[k]) for k in want} == want and short(r["configuration_address"], 12) == "8cabf76750ae"


def test_leakage_rows_and_sweep(spark):
    folder = os.path.dirname(place("DEMO_CONFIG", "*/demo/agent.json"))
    with open(f"{folder}/eval.jsonl") as f:
        lines = [line.strip() for line in f if line.strip()]
    items = spark.createDataFrame([(f"eval-{i:03d}", i, line) for i, line in enumerate(lines)], "item_id string, n int, payload string").withColumn("raw", F.col("payload"))
    corpus = variants.planted(items, ordinal="n", say=lambda _, k: f"Request regarding {SUBJECTS[k % len(SUBJECTS)]}", step=1000).withColumn("raw", F.col("payload"))
    ev, co = contamination.addressed(items).persist(), contamination.addressed(corpus).persist()
    assert (ev.count(), co.count()) == (20, 32)
    lexical = contamination.lexical_matches(ev, co, min(contamination.TAUS)).persist()
    found = contamination.equal_records(ev, co, "byte_addr", "byte").unionByName(contamination.equal_records(ev, co, "eval_addr", "structural")).unionByName(lexical.filter("score >= 0.8"))
    scores = {r["method"]: (r["found"], r["missed"], r["false_positives"], round(r["recall"], 2)) for r in contamination.method_scores(found, co, ["byte", "structural", "lexical"]).collect()}
    assert scores == {"byte": (4, 16, 0, 0.2), "structural": (16, 4, 0, 0.8), "lexical": (17, 3, 0, 0.85)}
    sweep = {r["tau"]: (r["found"], r["false_positives"]) for r in contamination.tau_sweep(lexical, co).collect()}
    assert {t: sweep[t] for t in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)} == {0.5: (20, 16), 0.6: (20, 1), 0.7: (18, 0), 0.8: (17, 0), 0.9: (14, 0), 0.95: (8, 0)}


def test_conformance_of_the_demo_tools(spark):
    folder = os.path.dirname(place("DEMO_CONFIG", "*/demo/agent.json"))
    with open(f"{folder}/tools.json") as f:
        tools = spark.createDataFrame([("demo", f.read())], "id string, t string").select("id", F.get_json_object("t", "$.tools").alias("t"))
    rows = variants.conformance_summary(variants.conformance(tools, "id", "t")).collect()
    assert all(r["n_ok"] == r["n"] for r in rows)
    for relation in ("strict", "eval"):
        assert sum(r["n_informative"] for r in rows if r["relation"] == relation) == 10
    assert sum(r["byte_false_alarms"] for r in rows if r["relation"] == "strict") == 3


def test_published_versions(spark):
    captures = configs.capture_files(spark, place("CAPTURE_FILES", "*/realdata/tools")).withColumns({"captured_at": F.lit(None).cast("timestamp"), "capture_id": F.lit(0)})
    versions = releases.version_rows(captures).persist()
    s = releases.release_summary(versions).collect()[0]
    assert (captures.select("package").distinct().count(), s["n_pairs"], s["identical"], s["byte_only"], s["material"], s["silent"]) == (10, 51, 24, 0, 27, 15)
    rewrites = releases.description_rewrites(versions).collect()
    assert len(rewrites) == 13 and sum(r["delta"] for r in rewrites) == 1538
    sizes = {(r["tool"], r["chars_before"], r["chars_after"]) for r in rewrites}
    assert {("resolve-library-id", 1214, 2006), ("resolve-library-id", 523, 1133), ("read_file", 263, 85)} <= sizes
