"""Queries on contamination, releases, receipts and relations over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.canon import EVAL, column_address, column_text_address
from lodestrand.operators import contamination, delegation, manifest, receipts, releases, snapshots, variants
from lodestrand.plans.identity import _NODES, _delegation_nodes
from lodestrand.session import spread, stored, table


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_items").filter("id is not null")
    return rows.select(F.col("id").alias("item_id"), F.to_json(F.struct("id", "claimant", "policy", "loss", "narrative", "expected_decision")).alias("payload")).withColumn("raw", F.col("payload"))


def contamination_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold whole sentences of a narrative."""
    return contamination.shared_lines(table(spark, d, "eval_items"), table(spark, d, "documents"), "id", "narrative", "doc_id", "text")


def lexical_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text is like a narrative: TF-IDF cosine of at least 0.5 over all pairs."""
    items = table(spark, d, "eval_items").select(F.col("id").alias("item_id"), F.col("narrative").alias("flat"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("flat"))
    found = contamination.lexical_matches(items, docs, 0.5)
    return found.select("item_id", "record_id", F.round("score", 4).alias("score"))


def _planted_raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = _items(spark, d)
    return items, stored(variants.planted(items).withColumn("raw", F.col("payload")), "planted")


def planted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision of the three levels on planted copies."""
    scores = contamination.scan_report(*_planted_raw(spark, d))["scores"]
    return scores.select("method", "found", "missed", "false_positives", "unlabelled", F.round("recall", 4).alias("recall"), F.round("precision", 4).alias("precision"))


def planted_by_relation(spark: SparkSession, d: str) -> DataFrame:
    """Detections of each level by how the copy was made."""
    return contamination.scan_report(*_planted_raw(spark, d))["by_relation"]


def planted_missed(spark: SparkSession, d: str) -> DataFrame:
    """Copies that a level doesn't find."""
    return contamination.scan_report(*_planted_raw(spark, d))["missed"]


def planted_tau_sweep(spark: SparkSession, d: str) -> DataFrame:
    items, corpus = (contamination.addressed(x) for x in _planted_raw(spark, d))
    return contamination.tau_sweep(contamination.lexical_matches(items, corpus, min(contamination.TAUS)), corpus)


def narrative_copies(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are an item's narrative whole: by bytes and by folded text."""
    items = table(spark, d, "eval_items").filter("id is not null").select(F.col("id").alias("item_id"), column_address(F.col("narrative"), "bytes").alias("byte_addr"), column_text_address("narrative", EVAL).alias("eval_addr"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), column_address(F.col("text"), "bytes").alias("byte_addr"), column_text_address("text", EVAL).alias("eval_addr"))
    both = contamination.equal_records(items, docs, "byte_addr", "byte").unionByName(contamination.equal_records(items, docs, "eval_addr", "structural"))
    return both.select("method", "item_id", "record_id")


# --- releases ---------------------------------------------------------------------------------


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return releases.version_rows(table(spark, d, "captures"))


def consecutive_pairs(spark: SparkSession, d: str) -> DataFrame:
    return releases.version_pairs(_versions(spark, d))


def release_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each consecutive pair of versions as identical, byte-only or material, with the kind of change."""
    return releases.classify_pairs(_versions(spark, d))


def release_summary(spark: SparkSession, d: str) -> DataFrame:
    return releases.release_summary(_versions(spark, d))


def release_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return releases.breakdown(releases.classify_pairs(_versions(spark, d)))


def rewrite_totals(spark: SparkSession, d: str) -> DataFrame:
    return releases.rewrite_totals(_versions(spark, d))


def respelling_control(spark: SparkSession, d: str) -> DataFrame:
    """Every listing against another spelling of it: all must be told as byte-only."""
    return releases.positive_control(_versions(spark, d))


def description_rewrites(spark: SparkSession, d: str) -> DataFrame:
    return releases.description_rewrites(_versions(spark, d))


def rewrites_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest rewrites: a top-k report."""
    return releases.largest_rewrites(_versions(spark, d), 10)


def capture_counts(spark: SparkSession, d: str) -> DataFrame:
    """Packages, versions, failures and captures with their raw reply."""
    bad = "coalesce(trim(error), '') <> '' or tools is null"
    return table(spark, d, "captures").agg(
        F.count_distinct("package").alias("n_packages"), F.count_distinct("package", "version").alias("n_versions"), F.count_if(F.expr(bad)).alias("n_failed"), F.count("raw").alias("n_raw"), F.count("*").alias("n_rows")
    )


# --- manifests and receipts ---------------------------------------------------------------------


def _states(spark: SparkSession, d: str) -> DataFrame:
    """(package, snap_no, config_id, next_id): a configuration for each snapshot that lists a package without error, and the package's next one."""
    listed = snapshots.listed_snapshots(table(spark, d, "tool_snapshots").filter("package is not null and snap_no is not null"))
    each = listed.select("package", "listed", F.posexplode("listed").alias("at", "snap_no"))
    state = lambda n: F.concat("package", F.lit("@"), n.cast("string"))
    return each.select("package", "snap_no", state(F.col("snap_no")).alias("config_id"), state(F.get("listed", F.col("at") + 1)).alias("next_id"))


def _configurations(spark: SparkSession, d: str, states: DataFrame) -> DataFrame:
    """Artifacts of each state of a package: an agent document and its tools."""
    rows = table(spark, d, "tool_snapshots").filter("name is not null").groupBy("package", "name", "snap_no").agg(F.max(F.struct("delivered_at", "description", "input_schema")).alias("m"))
    rows = rows.join(states, ["package", "snap_no"])
    tools = rows.select("config_id", F.lit("tool").alias("component"), "name", F.to_json(F.struct("name", F.col("m.description").alias("description"), F.col("m.input_schema").alias("inputSchema"))).alias("content"))
    agents = states.select("config_id", F.lit("agent").alias("component"), F.lit("agent.json").alias("name"), F.to_json(F.struct(F.col("package").alias("name"), F.struct(F.lit("m-1").alias("id")).alias("model"), F.array(F.lit("read")).alias("allowed_operations"))).alias("content"))
    return tools.unionByName(agents)


def _state_manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """States and their manifests. A package's documents, alike in all its states, are addressed once."""
    states = stored(_states(spark, d), "states")
    docs = table(spark, d, "documents").filter("package is not null and text is not null").join(states.select("package").distinct(), "package", "left_semi")
    corpora = manifest.corpora(docs.select(F.col("package").alias("config_id"), F.lit("corpus").alias("component"), F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content")))
    shared = states.select("package", "config_id").join(corpora.withColumnRenamed("config_id", "package"), "package").drop("package")
    return states, manifest.manifests(_configurations(spark, d, states), corpora=shared)


def package_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Two-level addresses of each package in every snapshot that lists it."""
    _, every = _state_manifests(spark, d)
    return every.select("config_id", "model", "tools", "corpus", "permissions", "configuration_address", F.size("violations").alias("n_violations"))


def package_drift(spark: SparkSession, d: str) -> DataFrame:
    """Which component of a package moved against the previous snapshot that lists it; config_id is the later state."""
    states, every = _state_manifests(spark, d)
    every, pairs = stored(every, "manifests"), states.filter("next_id is not null")
    before = every.join(pairs.select("config_id", "next_id"), "config_id").drop("config_id").withColumnRenamed("next_id", "config_id")
    after = every.join(pairs.select(F.col("next_id").alias("config_id")), "config_id", "left_semi")
    return manifest.component_drift(before, after).select("config_id", "component", F.col("before").isNull().alias("appeared"), F.col("after").isNull().alias("vanished"))


def _evidence(spark: SparkSession, d: str, states: DataFrame) -> DataFrame:
    """Evidence for every state: each tool is an outcome, failed without a description; the corpus is the package's documents, scanned for whole narratives by folded text."""
    tools = table(spark, d, "tool_snapshots").filter("name is not null").groupBy("package", "name", "snap_no").agg(F.max(F.struct("delivered_at", "description")).alias("m")).join(states, ["package", "snap_no"])
    results = tools.select("config_id", (F.coalesce(F.trim("m.description"), F.lit("")) != "").alias("ok"), F.array("name").alias("used"))
    scores = receipts.evaluation_scores(results).select("config_id", "passed", "failed", "gate_passed")
    items = table(spark, d, "eval_items").filter("id is not null and narrative is not null").select(F.col("id").alias("item_id"), column_text_address("narrative", EVAL).alias("addr"))
    docs = table(spark, d, "documents").filter("package is not null and text is not null").select("package", "doc_id", column_text_address("text", EVAL).alias("addr"))
    n_eval = table(spark, d, "eval_items").filter("id is not null").agg(F.count_distinct("id").alias("n_eval"))
    scans = docs.join(items, "addr", "left").groupBy("package").agg(F.count_distinct("doc_id").alias("n_corpus"), F.count("item_id").alias("structural"))
    n = n_eval.collect()[0][0]
    rows = states.select("package", "config_id").join(scores, "config_id", "left").join(scans, "package", "left")
    return rows.select("config_id", "package", "passed", "failed", "gate_passed", F.lit(n).cast("long").alias("n_eval"), F.coalesce("n_corpus", F.lit(0)).alias("n_corpus"), F.coalesce("structural", F.lit(0)).alias("structural"))


def _issued(spark: SparkSession, d: str, secret: bytes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States, their manifests, and a receipt for each from its evidence."""
    states, every = _state_manifests(spark, d)
    every = stored(every.select("config_id", "configuration_address"), "manifests")
    known = _evidence(spark, d, states).join(every, "config_id")
    rows = known.select(F.col("config_id").alias("receipt_id"), F.col("package").alias("agent"), F.lit("strict").alias("profile"), "configuration_address", "passed", "failed", "gate_passed", "n_eval", "n_corpus", "structural", F.lit("full").alias("scope"), F.lit("2026-01-01T00:00:00Z").alias("issued_at"))
    return states, every, stored(receipts.issue(spread(rows), secret), "receipts")


#: A key for these queries, which sign nothing that anyone should trust.
_SECRET = bytes(range(32))


def receipts_issue(spark: SparkSession, d: str) -> DataFrame:
    """The outcome of issuing a receipt for every state of every package."""
    return _issued(spark, d, _SECRET)[2].select("receipt_id", "status", F.array_join("reasons", "; ").alias("reasons"))


def receipts_verify(spark: SparkSession, d: str) -> DataFrame:
    """Receipts issued for every state, presented with the package's next one: what still holds. After a package's last state nothing is presented."""
    from lodestrand.functions import ed25519

    states, every, issued = _issued(spark, d, _SECRET)
    following = states.filter("next_id is not null").select(F.col("config_id").alias("receipt_id"), F.col("next_id").alias("config_id"))
    presented = following.join(every, "config_id", "left").select("receipt_id", "configuration_address")
    last = states.filter("next_id is null").select(F.col("config_id").alias("receipt_id"), F.lit("NOT PRESENTED").alias("verdict"), F.lit(False).alias("permitted"), F.lit("nothing").alias("licenses"))
    return receipts.verify(issued, presented, [ed25519.public_key(_SECRET).hex()]).drop("outside").unionByName(last)


def gate_decision(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as configurations: lines not returned passed, orders' flags are what was read; the gate is at three quarters."""
    results = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("config_id"), (F.col("l_returnflag") != "R").alias("ok"), F.array("l_linestatus").alias("used"))
    scores = receipts.evaluation_scores(results)
    return scores.select("config_id", "passed", "failed", F.round("score", 6).alias("score"), "gate_passed", F.array_join("dependencies", ",").alias("dependencies"))


def spread_versions(spark: SparkSession, d: str) -> DataFrame:
    """Four versions of each package, evenly spaced: a sampling operator."""
    return releases.evenly_spread(_versions(spark, d), 4)


# --- relations ---------------------------------------------------------------------------------------


def relation_conformance(spark: SparkSession, d: str) -> DataFrame:
    """Declared against observed stability of every distinct tool of the usable captures under twelve variants, for both relations."""
    tools = releases.tool_texts(table(spark, d, "captures")).select("tool").distinct()
    records = tools.select(F.sha2("tool", 256).alias("record_id"), F.col("tool").alias("payload"))
    return variants.conformance_summary(variants.conformance(records))


def relation_bakeoff(spark: SparkSession, d: str) -> DataFrame:
    """Six identity functions on nine standard changes."""
    return variants.relation_scores(variants.compare_relations(spark))


def run_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which delegation graphs may run: suppliers in debt aren't permitted, and widened authority blocks."""
    nodes = _delegation_nodes(spark, d)
    debts = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), (F.col("s_acctbal") >= 0).alias("paid"))
    permitted = nodes.select("graph_id", "node").join(debts, "node", "left").select("graph_id", "node", F.coalesce("paid", F.lit(True)).alias("permitted"))
    return delegation.run_admissible(nodes, permitted).select("graph_id", "admissible", F.size("blocked").alias("n_blocked"))


QUERIES = {
    f.__name__: f
    for f in (
        contamination_lines, lexical_cosine, planted_scores, planted_by_relation, planted_missed, planted_tau_sweep, narrative_copies, consecutive_pairs, release_classes, release_summary, release_breakdown, rewrite_totals, respelling_control, description_rewrites, rewrites_topk, capture_counts,
        package_manifests, package_drift, receipts_issue, receipts_verify, gate_decision, spread_versions, relation_conformance, relation_bakeoff, run_gate,
    )
}

_SENTENCES = "SELECT {0} AS i, unnest(list_distinct(list_transform(string_split(regexp_replace({1}, '([.!?;])\\s+|\\n', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)))) AS line FROM {2}"
_VKEY = "list_transform(string_split(version, '.'), lambda x: coalesce(try_cast(regexp_extract(x, '^\\d{1,18}') AS BIGINT), 0))"
_USABLE = "tools IS NOT NULL AND coalesce(trim(error), '') = '' AND package IS NOT NULL AND version IS NOT NULL"
_RELEASES = f"""
vers AS (
  SELECT package, version, CASE WHEN json_type(tools) = 'ARRAY' THEN json_extract(tools, '$[*]') ELSE json_extract(tools, '$.tools[*]') END AS listing FROM captures WHERE {_USABLE}
  QUALIFY row_number() OVER (PARTITION BY package, version ORDER BY captured_at DESC NULLS LAST, capture_id DESC NULLS LAST, tools DESC) = 1
), pairs AS (
  SELECT package, lag(version) OVER w AS version_from, version AS version_to FROM vers WINDOW w AS (PARTITION BY package ORDER BY {_VKEY}, version)
  QUALIFY lag(version) OVER w IS NOT NULL
), tools AS (
  SELECT package, version, coalesce(json_extract_string(t, '$.name'), '') AS name, coalesce(json_extract_string(t, '$.description'), '') AS description
  FROM (SELECT package, version, unnest(listing) AS t FROM vers)
), rewrites AS (
  SELECT p.package, version_from, version_to, b.name AS tool, length(b.description)::INT AS chars_before, length(a.description)::INT AS chars_after, (length(a.description) - length(b.description))::INT AS delta
  FROM pairs p JOIN tools b ON b.package = p.package AND b.version = version_from JOIN tools a ON a.package = p.package AND a.version = version_to AND a.name = b.name
  WHERE a.description <> b.description
)"""

_PLAIN = "replace(replace(nfc_normalize({0}), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_FOLDED = "regexp_replace(regexp_replace(" + _PLAIN + ", '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g'), '^ | $', '', 'g')"
_STATES = f"""
listed AS (
  SELECT package, snap_no FROM tool_snapshots WHERE package IS NOT NULL AND snap_no IS NOT NULL
  GROUP BY ALL HAVING count(name) > 0 AND NOT bool_or(coalesce(trim(error), '') <> '')
), states AS (
  SELECT package, snap_no, package || '@' || snap_no AS config_id, package || '@' || lead(snap_no) OVER (PARTITION BY package ORDER BY snap_no) AS next_id FROM listed
), latest AS (
  SELECT * FROM tool_snapshots WHERE name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY package, name, snap_no ORDER BY delivered_at DESC, description DESC NULLS LAST, input_schema DESC NULLS LAST) = 1
), sets AS (
  SELECT s.config_id, list_sort(list([{_PLAIN.format("name")}, coalesce({_PLAIN.format("description")}, '<null>'), coalesce({_PLAIN.format("input_schema")}, '<null>')])) AS tools,
    count(*) FILTER (coalesce(trim(description), '') <> '') AS passed, count(*) AS n
  FROM states s JOIN latest l ON l.package = s.package AND l.snap_no = s.snap_no GROUP BY 1
), scans AS (
  SELECT package, count(DISTINCT doc_id) AS n_corpus, count(item_id) AS structural FROM (SELECT package, doc_id, {_FOLDED.format("text")} AS t FROM documents WHERE package IS NOT NULL AND text IS NOT NULL) d
  LEFT JOIN (SELECT id AS item_id, {_FOLDED.format("narrative")} AS t FROM eval_items WHERE id IS NOT NULL AND narrative IS NOT NULL) i USING (t) GROUP BY 1
), outcomes AS (
  SELECT s.config_id, s.next_id, coalesce(t.passed >= 0.75 * t.n, false) AS gate, coalesce(c.n_corpus, 0) AS n_corpus, coalesce(c.structural, 0) AS structural,
    coalesce(t.passed >= 0.75 * t.n, false) AND coalesce(c.n_corpus, 0) > 0 AND coalesce(c.structural, 0) = 0 AND (SELECT count(DISTINCT id) FROM eval_items) > 0 AS approved
  FROM states s LEFT JOIN sets t USING (config_id) LEFT JOIN scans c ON c.package = s.package
)"""

SQL = {
    "contamination_lines": f"""
WITH a AS ({_SENTENCES.format("id", "narrative", "eval_items")}), b AS ({_SENTENCES.format("doc_id", "text", "documents")})
SELECT a.i AS item_id, b.i AS record_id, count(*) AS n_lines FROM (SELECT line, min(i) AS i FROM a GROUP BY 1 HAVING count(DISTINCT i) = 1) a JOIN b USING (line) WHERE length(line) >= 20 GROUP BY ALL""",
    "consecutive_pairs": f"WITH {_RELEASES} SELECT package, version_from, version_to FROM pairs",
    "description_rewrites": f"WITH {_RELEASES} SELECT * FROM rewrites",
    "rewrites_topk": f"WITH {_RELEASES} SELECT * FROM rewrites ORDER BY abs(delta) DESC, package, version_from, tool LIMIT 10",
    "gate_decision": """
SELECT l_suppkey AS config_id, count(*) FILTER (l_returnflag <> 'R') AS passed, count(*) FILTER (l_returnflag = 'R') AS failed, round(avg((l_returnflag <> 'R')::INT), 6) AS score,
  avg((l_returnflag <> 'R')::INT) >= 0.75 AS gate_passed, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS dependencies FROM lineitem GROUP BY 1""",
    "spread_versions": f"""
WITH {_RELEASES}, ranked AS (
  SELECT package, version, row_number() OVER (PARTITION BY package ORDER BY {_VKEY}, version) - 1 AS r, count(*) OVER (PARTITION BY package) AS n FROM vers
)
SELECT package, version FROM ranked WHERE n <= 4 OR r IN (0, round_even((n - 1) / 3, 0), round_even(2 * (n - 1) / 3, 0), n - 1)""",
    "capture_counts": "SELECT count(DISTINCT package) AS n_packages, count(DISTINCT (package, version)) AS n_versions, count(*) FILTER (coalesce(trim(error), '') <> '' OR tools IS NULL) AS n_failed, count(raw) AS n_raw, count(*) AS n_rows FROM captures",
    "package_drift": f"""WITH {_STATES}
SELECT s.next_id AS config_id, 'tools' AS component, false AS appeared, false AS vanished FROM states s JOIN sets b USING (config_id) JOIN sets a ON a.config_id = s.next_id WHERE a.tools <> b.tools""",
    "receipts_issue": f"""WITH {_STATES}
SELECT config_id AS receipt_id, CASE WHEN approved THEN 'APPROVED' ELSE 'REFUSED' END AS status,
  concat_ws('; ', CASE WHEN NOT gate THEN 'the evaluation gate isn''t passed' END, CASE WHEN n_corpus > 0 AND structural > 0 THEN structural || ' structural matches in the corpus' END,
    CASE WHEN n_corpus = 0 THEN 'the evaluation items were not compared with a corpus' END) AS reasons FROM outcomes""",
    "receipts_verify": f"""WITH {_STATES}, told AS (
  SELECT o.config_id AS receipt_id, CASE WHEN o.next_id IS NULL THEN 'NOT PRESENTED' WHEN NOT o.approved THEN 'BLOCKED (receipt was never approved)' WHEN a.tools = b.tools THEN 'VERIFIED' ELSE 'BLOCKED (configuration drift)' END AS verdict
  FROM outcomes o LEFT JOIN sets b ON b.config_id = o.config_id LEFT JOIN sets a ON a.config_id = o.next_id
)
SELECT receipt_id, verdict, verdict = 'VERIFIED' AS permitted, CASE WHEN verdict = 'VERIFIED' THEN 'the evaluated configuration' ELSE 'nothing' END AS licenses FROM told""",
    "run_gate": f"""WITH {_NODES}, judged AS (
  SELECT graph_id, node, len(list_filter(operations, lambda x: NOT list_contains(['1','2','3','4','5'], x))) = 0 AND coalesce(s.s_acctbal >= 0, true) AS ok
  FROM nodes LEFT JOIN supplier s ON node = 's' || s.s_suppkey
)
SELECT graph_id, bool_and(ok) AS admissible, (count(*) FILTER (NOT ok))::INT AS n_blocked FROM judged GROUP BY 1""",
    "narrative_copies": f"""
WITH a AS (SELECT id, narrative, {_FOLDED.format("narrative")} AS t FROM eval_items WHERE id IS NOT NULL), b AS (SELECT doc_id, text, {_FOLDED.format("text")} AS t FROM documents)
SELECT 'byte' AS method, id AS item_id, doc_id AS record_id FROM a JOIN b ON narrative = text UNION ALL SELECT 'structural', id, doc_id FROM a JOIN b ON a.t = b.t""",
    "rewrite_totals": f"WITH {_RELEASES} SELECT count(*) AS n_rewrites, coalesce(sum(delta), 0)::BIGINT AS net_chars, count(*) FILTER (delta > 0) AS n_longer, count(*) FILTER (delta < 0) AS n_shorter FROM rewrites",
    "respelling_control": f"WITH {_RELEASES} SELECT count(*) AS n, count(*) AS n_byte_only FROM vers WHERE listing IS NOT NULL",
}
