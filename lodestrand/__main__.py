"""Commands over configuration folders, item and corpus files and captures.

``python -m lodestrand COMMAND ...`` prints JSON lines. Exit code 0: done, all checks as declared; 1: a check isn't; 2: blocked, or
wrong usage; 3: the input can't be used.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.canon import DEFAULT_POLICY, RELATIONS, Refused, address, declaration


def _say(df: DataFrame) -> list[dict]:
    """Prints a report's rows; reports are few rows by nature."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    for r in sorted(rows, key=lambda r: json.dumps(r, default=str, sort_keys=True)):
        print(json.dumps(r, default=str, ensure_ascii=False))
    return rows


def _read(artifacts: DataFrame, names: list[str] | None) -> DataFrame:
    """The documents that an evaluation read; all unless names are given."""
    docs = artifacts.filter("component = 'corpus'").select("config_id", "name")
    return docs.filter(F.col("name").isin(names)) if names else docs


def run(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestrand", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *args: str, **options: object) -> None:
        c = sub.add_parser(name, help=about)
        for a in args:
            c.add_argument(a)
        for o, default in options.items():
            kind = {"nargs": "*"} if isinstance(default, list) else {"type": type(default)} if default is not None else {}
            c.add_argument(f"--{o.replace('_', '-')}", default=default, **kind)

    command("relation", "the declared relations and rules by place, and their addresses")
    command("manifest", "addresses of a configuration folder", "folder", relation="strict", read=[])
    command("diff", "what differs between two folders", "before", "after", relation="strict")
    command("issue", "a receipt for a folder from its evaluation (passed, failed)", "folder", "receipts", key="key.hex", passed=0, failed=0, threshold=0.75, items=None, corpus=None, approver="", read=[])
    command("verify", "a folder against receipts", "folder", "receipts", trusted=[], read=[])
    command("mutate", "the gate's verdict on a changed folder", "folder", "kind", passed=1, failed=0, read=[])
    command("respell", "the gate's verdict on a folder spelled otherwise", "folder", passed=1, failed=0, read=[])
    command("suite", "seven checks of the gate", "folder", passed=1, failed=0, read=[])
    command("leakage", "a scan of a corpus of JSON lines for items", "items", "corpus", tau=0.8)
    command("planted", "the scan's levels on planted copies of items", "items", tau=0.8, unrelated=12)
    command("conformance", "declared and observed stability of records (JSON lines)", "records")
    command("bakeoff", "identity functions on standard changes")
    command("releases", "what changes between captured versions", "captures")
    o = p.parse_args(argv)
    if o.command == "relation":
        told = [{"relation": n, "declaration": declaration(n), "address": address(declaration(n))} for n in RELATIONS]
        for r in [*told, {"relation": "by place", "declaration": DEFAULT_POLICY.declared(), "address": address(DEFAULT_POLICY.declared())}]:
            print(json.dumps(r, ensure_ascii=False))
        return 0

    from lodestrand.functions import ed25519
    from lodestrand.operators import configdiff, contamination, manifest, receipts, releases, suite, variants
    from lodestrand.session import local_session, ship
    from lodestrand.sources import configs

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)

    def records(path: str) -> DataFrame:
        lines = configs.json_lines(spark, path)
        return lines.select(F.coalesce(F.get_json_object("content", "$.id"), F.sha2("content", 256)).alias("record_id"), F.col("content").alias("payload"), F.col("content").alias("raw"))

    def folder(path: str) -> DataFrame:
        return configs.configuration(spark, path, "c")

    try:
        if o.command == "manifest":
            a = folder(o.folder)
            return 3 if any(r["violations"] for r in _say(manifest.manifests(a, o.relation, _read(a, o.read) if o.read else None))) else 0
        if o.command == "diff":
            return 1 if _say(configdiff.field_drift(folder(o.before), folder(o.after), RELATIONS[o.relation])) else 0
        if o.command in ("issue", "mutate", "respell", "suite"):
            a = folder(o.folder)
            read = _read(a, o.read)
            threshold = getattr(o, "threshold", 0.75)
            scores = spark.createDataFrame([("c", o.passed, o.failed, o.passed + o.failed > 0 and o.passed >= threshold * (o.passed + o.failed))], "config_id string, passed int, failed int, gate_passed boolean")
            if o.command == "suite":
                return 0 if all(r["ok"] for r in _say(suite.run_suite(a, read, scores, bytes(32), "-"))) else 1
            secret = receipts.load_or_create_key(o.key) if o.command == "issue" else bytes(32)
            scan = {"n_eval": 1, "n_corpus": 1, "structural": 0}
            if o.command == "issue":
                scan = dict.fromkeys(scan)
                if o.items and o.corpus:
                    items, corpus = records(o.items).withColumnRenamed("record_id", "item_id"), records(o.corpus)
                    scan = {"n_eval": items.count(), "n_corpus": corpus.count(), "structural": contamination.scan_report(items, corpus)["detections"].filter("method = 'structural'").count()}
            evidence = manifest.manifests(a, "strict", read).join(scores, "config_id").select(
                F.col("config_id").alias("receipt_id"), F.col("config_id").alias("agent"), F.lit("strict").alias("profile"), "configuration_address", "passed", "failed", "gate_passed", *[F.lit(v).cast("long").alias(k) for k, v in scan.items()],
                F.lit("resolved").alias("scope"), F.lit(dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")).alias("issued_at"), F.lit(getattr(o, "approver", "")).alias("approver"),
            )
            issued = receipts.issue(evidence, secret)
            if o.command == "issue":
                receipts.save_receipts(issued, o.receipts)
                return 0 if all(r["status"] == "APPROVED" for r in _say(issued.select("status", "reasons", "receipt_address", "public_key"))) else 2
            changed = suite.respelled(a) if o.command == "respell" else suite.mutated(a, o.kind, read)
            shown = manifest.manifests(changed, "strict", read).select(F.col("config_id").alias("receipt_id"), "configuration_address")
            verdicts = _say(receipts.verify(issued, shown, [ed25519.public_key(secret).hex()]))
            _say(configdiff.field_drift(a, changed, resolved=read))
            return 0 if all(v["permitted"] for v in verdicts) else 2
        if o.command == "verify":
            a = folder(o.folder)
            shown = manifest.manifests(a, "strict", _read(a, o.read)).select(F.col("config_id").alias("receipt_id"), "configuration_address")
            return 0 if all(v["permitted"] for v in _say(receipts.verify(receipts.load_receipts(spark, o.receipts), shown, o.trusted or None))) else 2
        if o.command in ("leakage", "planted"):
            items = records(o.items).withColumnRenamed("record_id", "item_id")
            corpus = variants.planted(items, o.unrelated).withColumn("raw", F.col("payload")) if o.command == "planted" else records(o.corpus)
            report = contamination.scan_report(items, corpus, o.tau)
            for name in ("scores", "by_relation", "missed") if o.command == "planted" else ("detections",):
                found = _say(report[name])
            return 1 if o.command == "leakage" and any(r["method"] == "structural" for r in found) else 0
        if o.command == "conformance":
            return 0 if all(r["n_ok"] == r["n"] for r in _say(variants.conformance_summary(variants.conformance(records(o.records))))) else 1
        if o.command == "bakeoff":
            _say(variants.relation_scores(variants.compare_relations(spark)))
            return 0
        captures = configs.capture_files(spark, o.captures).withColumns({"captured_at": F.lit(None).cast("timestamp"), "capture_id": F.lit(0)})
        versions = releases.version_rows(captures)
        control = _say(releases.positive_control(versions))
        for df in (releases.failures(captures), releases.release_summary(versions), releases.breakdown(releases.classify_pairs(versions)), releases.largest_rewrites(versions), releases.rewrite_totals(versions)):
            _say(df)
        return 0 if all(r["n"] == r["n_byte_only"] for r in control) else 1
    except (Refused, FileNotFoundError, ValueError, PySparkException) as e:
        print(json.dumps({"error": f"{type(e).__name__}: {str(e)[:300]}"}, ensure_ascii=False), file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(run())
