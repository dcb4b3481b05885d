"""Seven checks that the gate decides as declared, run on every configuration of a table at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestrand.functions import ed25519
from lodestrand.operators import receipts
from lodestrand.operators.manifest import manifests
from lodestrand.operators.variants import varied
from lodestrand.session import stored

#: Number, name and declared outcome of each check (fixed values: published results are told by them).
CHECKS = (
    (1, "cosmetic drift", "evidence preserved"),
    (2, "material drift", "evidence invalidated"),
    (3, "dependency drift", "evidence invalidated"),
    (4, "irrelevant dependency", "evidence preserved"),
    (5, "relevant dependency", "evidence invalidated"),
    (6, "eval contamination", "evidence not issued"),
    (7, "overclaim attempt", "insufficient evidence"),
)
_JSON = ("agent", "tool", "tools_document", "eval_item")


def _respelled(text: Column, names: tuple[str, ...]) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            for n in names if t is not None else ():
                t = varied(t, n)
            out.append(t)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, StringType())(text)


def respelled(artifacts: DataFrame) -> DataFrame:
    """The same configurations spelled otherwise: order of keys, escapes, white space, composition and line ends."""
    text = F.replace(F.replace(F.col("content"), F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\r\n"))
    is_json = F.col("component").isin(*_JSON)
    json_text = _respelled(F.when(is_json, F.col("content")), ("key_reorder", "unicode_nfd", "escape_form", "json_whitespace"))
    return artifacts.withColumn("content", F.when(is_json, json_text).otherwise(text))


def mutated(artifacts: DataFrame, kind: str, read: DataFrame) -> DataFrame:
    """The configurations with one change: ``prompt``, ``tool`` (the first by name), ``permission``, ``relevant-corpus`` (the first document read) or ``irrelevant-corpus`` (a document added that nothing read)."""
    first = lambda df: df.groupBy("config_id").agg(F.min("name").alias("name"))
    edit = lambda names, component, change: artifacts.join(names.withColumn("__hit", F.lit(True)), ["config_id", "name"], "left").withColumn("content", F.when((F.col("component") == component) & F.col("__hit"), change).otherwise(F.col("content"))).select(artifacts.columns)
    more = F.concat(F.col("content"), F.lit("\nThe rule above no longer holds."))
    if kind == "prompt":
        return artifacts.withColumn("content", F.when(F.col("component") == "prompt", more).otherwise(F.col("content")))
    if kind == "permission":
        grown = F.regexp_replace("content", r'("allowed_operations"\s*:\s*\[)', '$1"one.more", ')
        return artifacts.withColumn("content", F.when(F.col("component") == "agent", grown).otherwise(F.col("content")))
    if kind == "tool":
        # texts of tools stand for their names where files give none
        named = artifacts.withColumn("name", F.when(F.col("component") == "tool", F.sha2("content", 256)).otherwise(F.col("name")))
        one = first(named.filter("component = 'tool'")).withColumn("__hit", F.lit(True))
        hit = named.join(one, ["config_id", "name"], "left")
        return hit.withColumn("content", F.when((F.col("component") == "tool") & F.col("__hit"), _respelled(F.when(F.col("__hit"), F.col("content")), ("text_edited",))).otherwise(F.col("content"))).select(artifacts.columns)
    if kind == "relevant-corpus":
        return edit(first(read.join(artifacts.filter("component = 'corpus'").select("config_id", "name"), ["config_id", "name"], "left_semi")), "corpus", more)
    if kind == "irrelevant-corpus":
        new = artifacts.select("config_id").distinct().select("config_id", F.lit("corpus").alias("component"), F.lit("~never-read").alias("name"), F.lit("Nothing reads this.").alias("content"))
        return artifacts.unionByName(new.select(artifacts.columns))
    raise ValueError(f"unknown change {kind!r}")


def run_suite(artifacts: DataFrame, read: DataFrame, scores: DataFrame, secret: bytes, issued_at: str) -> DataFrame:
    """(config_id, n, name, expected, actual, ok) of seven checks on every configuration.

    ``artifacts``: config_id, component, name, content; ``read``: config_id, name of the documents an evaluation read;
    ``scores``: config_id, passed, failed, gate_passed. A configuration whose own evidence isn't approved has actual
    ``no evidence`` throughout: drift can't be tested from there.
    """
    artifacts = stored(artifacts.select("config_id", "component", "name", "content"), "artifacts")
    sizes = artifacts.groupBy("config_id").agg(F.count_if(F.col("component") == "eval_item").alias("n_eval"), F.count_if(F.col("component") == "corpus").alias("n_corpus"))
    base = stored(manifests(artifacts, "strict", read).select("config_id", "configuration_address"), "manifests")
    rows = base.join(scores, "config_id").join(sizes, "config_id").select(
        F.col("config_id").alias("receipt_id"), F.col("config_id").alias("agent"), F.lit("strict").alias("profile"), "configuration_address", "passed", "failed", "gate_passed", "n_eval", "n_corpus", F.lit(0).alias("structural"), F.lit("resolved").alias("scope"), F.lit(issued_at).alias("issued_at")
    )
    issued = stored(receipts.issue(rows, secret), "receipts")
    key = [ed25519.public_key(secret).hex()]
    shown = base.select("config_id", F.lit(7).alias("n"), "configuration_address")
    for n, made in ((1, respelled(artifacts)), (2, mutated(artifacts, "prompt", read)), (3, mutated(artifacts, "tool", read)), (4, mutated(artifacts, "irrelevant-corpus", read)), (5, mutated(artifacts, "relevant-corpus", read))):
        shown = shown.unionByName(manifests(made, "strict", read).select("config_id", F.lit(n).alias("n"), "configuration_address"))
    pairs = shown.join(issued.select(F.col("receipt_id").alias("config_id"), F.col("status")), "config_id")
    # one verification for each distinct presented address; its id is carried through as the address is not unique to a receipt
    distinct = pairs.select(F.col("config_id").alias("receipt_id"), "configuration_address").distinct()
    told = receipts.verify(issued, distinct, key, keep=["configuration_address"]).select(F.col("receipt_id").alias("config_id"), "configuration_address", "permitted")
    drift = pairs.join(told, ["config_id", "configuration_address"], "left")
    gate = F.when(F.col("permitted"), "evidence preserved").otherwise("evidence invalidated")
    says = F.when(F.col("permitted"), "insufficient evidence").otherwise("evidence invalidated")
    actual = drift.select("config_id", "n", F.when(F.col("n") == 7, says).otherwise(gate).alias("actual"), "status")
    leaked = receipts.issue(rows.withColumn("structural", F.greatest(F.lit(1), F.col("n_eval"))), secret)
    sixth = leaked.join(issued.select("receipt_id", F.col("status").alias("__own")), "receipt_id").select(F.col("receipt_id").alias("config_id"), F.lit(6).alias("n"), F.when(F.col("status") == "APPROVED", "evidence preserved").otherwise("evidence not issued").alias("actual"), F.col("__own").alias("status"))
    every = actual.unionByName(sixth).withColumn("actual", F.when(F.col("status") == "APPROVED", F.col("actual")).otherwise("no evidence")).drop("status")
    declared = artifacts.sparkSession.createDataFrame(CHECKS, "n int, name string, expected string")
    return every.join(declared, "n").select("config_id", "n", "name", "expected", "actual", (F.col("expected") == F.col("actual")).alias("ok"))
