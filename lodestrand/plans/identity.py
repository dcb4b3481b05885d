"""Queries on content identity, drift, membership, conditions and delegation over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions.canon import EVAL, STRICT, column_address, column_text_address, json_canonical, set_address
from lodestrand.operators import delegation, jsondiff, membership, snapshots
from lodestrand.session import table

# --- addresses ------------------------------------------------------------------------------------


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source", "package")


def doc_byte_addr(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", column_address(F.col("text"), "bytes").alias("addr"))


def doc_text_addr(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", column_text_address("text", STRICT).alias("addr"))


def doc_eval_addr(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", column_text_address("text", EVAL).alias("addr"))


def doc_identity_groups(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several documents share, by strict text address."""
    groups = doc_text_addr(spark, d).groupBy("addr").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return groups.filter("n_docs > 1")


def structural_gain(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have a twin by bytes, by strict text and by folded text."""
    docs = _documents(spark, d).filter("text is not null")
    each = docs.select(F.explode(F.array(*[F.struct(F.lit(n).alias("method"), a.alias("addr")) for n, a in (("bytes", column_address(F.col("text"), "bytes")), ("strict", column_text_address("text", STRICT)), ("eval", column_text_address("text", EVAL)))])).alias("x"))
    twins = each.select("x.*").groupBy("method", "addr").agg(F.count("*").alias("n")).groupBy("method")
    return twins.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_twins"), F.count_if(F.col("n") > 1).alias("n_groups"))


def set_address_by_source(spark: SparkSession, d: str) -> DataFrame:
    """One address for the multiset of a source's texts."""
    docs = _documents(spark, d).filter("source is not null and text is not null").select("source", column_text_address("text", STRICT).alias("addr"))
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), set_address(F.collect_list("addr")).alias("set_addr"))


def json_canonical_props(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", json_canonical("props").alias("c"))
    return rows.select("event_id", F.col("c.addr").alias("addr"))


def refused_captures(spark: SparkSession, d: str) -> DataFrame:
    """Captures by whether their listing has an identity: refusals are counted, not dropped."""
    rows = table(spark, d, "captures").select(json_canonical("tools").alias("c"))
    outcome = F.when(F.col("c").isNull(), "absent").when(F.col("c.refused").isNotNull(), "refused").otherwise("addressed")
    return rows.select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


# --- manifests of a star schema -------------------------------------------------------------------------


def _order_addr(price: Column) -> Column:
    parts = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.round(price * 100).cast("bigint").cast("string"))
    return column_address(parts, "bytes")


def _customer_manifests(orders: DataFrame, price: Column) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.count("*").alias("n_members"), set_address(F.collect_list(_order_addr(price))).alias("set_addr"))


def manifest_by_customer(spark: SparkSession, d: str) -> DataFrame:
    """Second-level addresses: a customer is the set of their orders' addresses."""
    return _customer_manifests(table(spark, d, "orders"), F.col("o_totalprice"))


def _repriced() -> Column:
    """A second state of the orders, to be compared with the first: urgent orders cost a cent more."""
    return F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice"))


def two_level_drift(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose set address moved, and how many members did: level two finds them, level one is read for those alone."""
    orders = table(spark, d, "orders")
    before, after = _customer_manifests(orders, F.col("o_totalprice")), _customer_manifests(orders, _repriced())
    moved = before.join(after.select("o_custkey", F.col("set_addr").alias("after_addr")), "o_custkey").filter("set_addr != after_addr").select("o_custkey")
    members = orders.join(moved, "o_custkey", "left_semi").filter(_order_addr(F.col("o_totalprice")) != _order_addr(_repriced()))
    return members.groupBy("o_custkey").agg(F.count("*").alias("n_changed"))


# --- differences ----------------------------------------------------------------------------------


def _latest_tools(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tool_snapshots").filter("name is not null").groupBy("package", "name", "snap_no").agg(F.max(F.struct("delivered_at", "description", "input_schema")).alias("m"))


def _tool_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, change) between two sides of (keys, m)."""
    side = lambda df, p: df.select(*keys, F.lit(True).alias(p), F.col("m.description").alias(f"{p}_description"), F.col("m.input_schema").alias(f"{p}_schema"))
    both = side(before, "b").join(side(after, "a"), keys, "full_outer")
    changes = F.when(F.col("b").isNull(), F.array(F.struct(F.lit("tool").alias("field"), F.lit("added").alias("change")))).when(F.col("a").isNull(), F.array(F.struct(F.lit("tool").alias("field"), F.lit("removed").alias("change")))).otherwise(
        F.array_compact(F.array(*[F.when(~F.col(f"b_{f}").eqNullSafe(F.col(f"a_{f}")), F.struct(F.lit(f).alias("field"), F.lit("changed").alias("change"))) for f in ("description", "schema")]))
    )
    return both.select(*keys, F.explode(changes).alias("c")).select(*keys, "c.*")


def drift_fields(spark: SparkSession, d: str) -> DataFrame:
    """The tools field by field between the first and the last snapshot that lists their package without error."""
    rows = _latest_tools(spark, d)
    listed = snapshots.listed_snapshots(table(spark, d, "tool_snapshots").filter("package is not null and snap_no is not null")).filter("size(listed) > 1")
    at = lambda i: rows.join(listed.select("package", F.element_at("listed", i).alias("snap_no")), ["package", "snap_no"])
    return _tool_changes(at(1), at(-1), ["package", "name"])


def drift_steps(spark: SparkSession, d: str) -> DataFrame:
    """The tools field by field between consecutive snapshots that list their package without error; snap_no is the later one."""
    rows = _latest_tools(spark, d)
    listed = snapshots.listed_snapshots(table(spark, d, "tool_snapshots").filter("package is not null and snap_no is not null"))
    each = listed.select("package", "listed", F.posexplode("listed").alias("at", "snap_no"))
    steps = each.filter("at > 0").select("package", "snap_no", F.get("listed", F.col("at") - 1).alias("prev"))
    before = rows.withColumnRenamed("snap_no", "prev").join(steps, ["package", "prev"])
    after = rows.join(steps, ["package", "snap_no"])
    return _tool_changes(before, after, ["package", "name", "snap_no"])


def json_field_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Differences inside the input schemas between consecutive snapshots, as paths."""
    rows = table(spark, d, "tool_snapshots").filter("name is not null").groupBy("package", "name", "snap_no").agg(F.max(F.struct("delivered_at", "input_schema")).alias("m")).select("package", "name", "snap_no", F.col("m.input_schema").alias("after"))
    w = Window.partitionBy("package", "name").orderBy("snap_no")
    pairs = rows.withColumns({"before": F.lag("after").over(w), "prev": F.lag("snap_no").over(w)}).filter("prev is not null")
    return jsondiff.field_diffs(pairs, ["package", "name", "snap_no"])


def description_notes(spark: SparkSession, d: str) -> DataFrame:
    """Where a description changed: the first line that differs and what a reader can't see."""
    rows = table(spark, d, "tool_snapshots").filter("name is not null").groupBy("package", "name", "snap_no").agg(F.max(F.struct("delivered_at", "description")).alias("m")).select("package", "name", "snap_no", F.col("m.description").alias("after"))
    w = Window.partitionBy("package", "name").orderBy("snap_no")
    pairs = rows.withColumn("before", F.lag("after").over(w)).filter("before != after")
    return pairs.select("package", "name", "snap_no", jsondiff.first_different_line("before", "after").alias("l"), jsondiff.character_note_column("before", "after").alias("note")).select("package", "name", "snap_no", "l.line_no", "note")


def _parts_by_supplier(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), F.col("l_partkey").cast("string").alias("part"))
    sets = rows.groupBy("l_suppkey").agg(F.collect_set(F.when(F.col("y") < 1996, F.col("part"))).alias("approved"), F.collect_set(F.when(F.col("y") >= 1996, F.col("part"))).alias("running"))
    return sets


def granted_revoked(spark: SparkSession, d: str) -> DataFrame:
    """Permissions (parts shipped) of a later period against an earlier one, each way."""
    granted, revoked = jsondiff.added_removed("approved", "running")
    return _parts_by_supplier(spark, d).select("l_suppkey", F.size(granted).alias("n_granted"), F.size(revoked).alias("n_revoked"))


# --- membership and conditions ----------------------------------------------------------------------


#: A class of orders: (class, component, relation, members).
_FLAG_RULES = (("closed", "status", "pin", ["F"]), ("closed", "priority", "any_of", ["1-URGENT", "2-HIGH"]), ("closed", "tools", "subset_of", ["AIR", "A-R", "N-O", "R-F", "A-F"]))


def class_membership(spark: SparkSession, d: str) -> DataFrame:
    """Orders against a class: pinned status, one of two priorities, flags of their lines within a set."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat_ws("-", "l_returnflag", "l_linestatus")).alias("flags"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    shown = {"status": (F.col("o_orderstatus"), None), "priority": (F.col("o_orderpriority"), None), "tools": (None, F.col("flags"))}
    outside = membership.outside_class([tuple(r)[1:] for r in _FLAG_RULES], shown)
    return orders.select(F.col("o_orderkey").alias("config_id"), outside.alias("o")).select("config_id", (F.size("o") == 0).alias("inside"), F.array_join("o", ",").alias("outside"))


def class_coverage(spark: SparkSession, d: str) -> DataFrame:
    """For each supplier, the parts it shipped before 1996 (the class as declared) that no later line exercised."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("class_id"), F.lit("tools").alias("component"), F.col("l_partkey").cast("string").alias("member"), (F.year("l_shipdate") < 1996).alias("early"))
    missing = membership.uncovered_members(lines.filter("early").drop("early"), lines.filter("not early").drop("early"))
    return missing.groupBy("class_id").agg(F.count("*").alias("n_missing"))


def class_widening(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose later class admits parts that the earlier one didn't."""
    sets = _parts_by_supplier(spark, d)
    rules = lambda c: sets.filter(F.size(c) > 0).select(F.col("l_suppkey").alias("class_id"), F.lit("tools").alias("component"), F.col(c).alias("members"))
    return membership.widened(rules("approved"), rules("running")).select("class_id", F.size("gained").alias("n_gained"))


def envelope_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Users whose event types meet the envelope's material condition; an unobserved one fails."""
    envelope = spark.createDataFrame([("calm", {"worst": "7", "kind": "click"}, ["worst"], "runs stay small")], "envelope_id string, conditions map<string,string>, material array<string>, conclusion string")
    k = F.get_json_object("props", "$.k").cast("int")
    seen = table(spark, d, "events").groupBy("user_id").agg(F.max(k % 8).alias("worst"))
    observed = seen.select(F.lit("calm").alias("envelope_id"), F.col("user_id").alias("run_id"), F.create_map(F.lit("worst"), F.col("worst").cast("string")).alias("values"))
    return membership.condition_checks(envelope, observed).select("run_id", "admissible")


def _delegation_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A graph per region: the region delegates to its nations, these to their suppliers; operations are part sizes they deal with."""
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber").groupBy("l_suppkey").agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("operations"))
    leaves = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    none = F.array().cast("array<string>")
    low = leaves.select(F.col("n_regionkey").alias("graph_id"), F.concat(F.lit("s"), "s_suppkey").alias("node"), "operations", none.alias("delegates_to"), F.lit(False).alias("is_root"))
    mid = leaves.groupBy("n_regionkey", "n_nationkey").agg(F.collect_set(F.concat(F.lit("s"), "s_suppkey")).alias("delegates_to"))
    mid = mid.select(F.col("n_regionkey").alias("graph_id"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.array(*[F.lit(str(i)) for i in range(1, 7)]).alias("operations"), "delegates_to", F.lit(False).alias("is_root"))
    top = nation.groupBy("n_regionkey").agg(F.collect_set(F.concat(F.lit("n"), "n_nationkey")).alias("delegates_to")).select(F.col("n_regionkey").alias("graph_id"), F.concat(F.lit("r"), "n_regionkey").alias("node"), F.array(*[F.lit(str(i)) for i in range(1, 6)]).alias("operations"), "delegates_to", F.lit(True).alias("is_root"))
    return top.unionByName(mid).unionByName(low)


def authority_root(spark: SparkSession, d: str) -> DataFrame:
    return delegation.widened_authority(_delegation_nodes(spark, d), "root").select("graph_id", "node", F.array_join("widened", ",").alias("widened"))


def authority_delegator(spark: SparkSession, d: str) -> DataFrame:
    return delegation.widened_authority(_delegation_nodes(spark, d), "delegator").select("graph_id", "node", F.array_join("widened", ",").alias("widened"))


def delegation_depths(spark: SparkSession, d: str) -> DataFrame:
    return delegation.depths(_delegation_nodes(spark, d)).groupBy("graph_id", "depth").agg(F.count("*").alias("n_nodes"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_byte_addr, doc_text_addr, doc_eval_addr, doc_identity_groups, structural_gain, set_address_by_source, json_canonical_props, refused_captures, manifest_by_customer, two_level_drift,
        drift_fields, drift_steps, json_field_diffs, description_notes, granted_revoked, class_membership, class_coverage, class_widening, envelope_conditions, authority_root, authority_delegator, delegation_depths,
    )
}

# --- SQL -------------------------------------------------------------------------------------------

_LF = "replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_BYTES = "'es1:bytes:sha256:' || sha256(text)"
_STRICT = f"'es1:strict:sha256:' || sha256(regexp_replace({_LF}, '[\\n \\t]+$', '') || chr(10))"
_EVAL = f"'es1:eval:sha256:' || sha256(regexp_replace(regexp_replace({_LF}, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g'), '^ | $', '', 'g'))"
_SET = """'es1:strict:sha256:' || sha256('["' || string_agg({0}, '","' ORDER BY {0}) || '"]')"""


def _order_sql(price: str) -> str:
    return f"'es1:bytes:sha256:' || sha256(o_orderkey::VARCHAR || '|' || o_orderstatus || '|' || round({price} * 100)::BIGINT::VARCHAR)"


_NEW_PRICE = "(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 0.01 ELSE o_totalprice END)"
_SUPPLIER_PARTS = "SELECT l_suppkey, list(DISTINCT l_partkey) FILTER (year(l_shipdate) < 1996) AS approved, list(DISTINCT l_partkey) FILTER (year(l_shipdate) >= 1996) AS running FROM lineitem GROUP BY 1"
_LATEST = "SELECT * FROM tool_snapshots WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY package, name, snap_no ORDER BY delivered_at DESC, description DESC NULLS LAST, input_schema DESC NULLS LAST) = 1"
_NODES = """
ops AS (SELECT l_suppkey, list(DISTINCT l_linenumber::VARCHAR) AS operations FROM lineitem GROUP BY 1),
nodes AS (
  SELECT n_regionkey AS graph_id, 'r' || n_regionkey AS node, ['1','2','3','4','5'] AS operations, NULL AS parent FROM nation GROUP BY n_regionkey
  UNION ALL SELECT n_regionkey, 'n' || n_nationkey, ['1','2','3','4','5','6'], 'r' || n_regionkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
  UNION ALL SELECT n_regionkey, 's' || s_suppkey, coalesce(operations, []), 'n' || n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN ops ON l_suppkey = s_suppkey
)"""
_EXTRA = "array_to_string(list_sort(list_filter(operations, lambda x: NOT list_contains({0}, x))), ',')"

SQL = {
    "doc_byte_addr": f"SELECT doc_id, {_BYTES} AS addr FROM documents",
    "doc_text_addr": f"SELECT doc_id, {_STRICT} AS addr FROM documents",
    "doc_eval_addr": f"SELECT doc_id, {_EVAL} AS addr FROM documents",
    "doc_identity_groups": f"SELECT {_STRICT} AS addr, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "structural_gain": f"""
SELECT method, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_twins, count(*) FILTER (n > 1) AS n_groups FROM (
  SELECT method, addr, count(*) AS n FROM (
    SELECT 'bytes' AS method, {_BYTES} AS addr FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT 'strict', {_STRICT} FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT 'eval', {_EVAL} FROM documents WHERE text IS NOT NULL
  ) GROUP BY ALL
) GROUP BY method""",
    "set_address_by_source": f"SELECT source, count(*) AS n_docs, {_SET.format('addr')} AS set_addr FROM (SELECT source, {_STRICT} AS addr FROM documents WHERE source IS NOT NULL AND text IS NOT NULL) GROUP BY 1",
    "json_canonical_props": "SELECT event_id, 'es1:strict:sha256:' || sha256(replace(props, ' ', '')) AS addr FROM events",
    "refused_captures": "SELECT CASE WHEN tools IS NULL THEN 'absent' WHEN json_valid(tools) THEN 'addressed' ELSE 'refused' END AS outcome, count(*) AS n FROM captures GROUP BY 1",
    "manifest_by_customer": f"SELECT o_custkey, count(*) AS n_members, {_SET.format('a')} AS set_addr FROM (SELECT o_custkey, {_order_sql('o_totalprice')} AS a FROM orders) GROUP BY 1",
    "two_level_drift": f"SELECT o_custkey, count(*) AS n_changed FROM orders WHERE {_order_sql('o_totalprice')} <> {_order_sql(_NEW_PRICE)} GROUP BY 1",
    "drift_fields": f"""
WITH latest AS ({_LATEST}), listed AS (
  SELECT package, snap_no FROM tool_snapshots WHERE package IS NOT NULL AND snap_no IS NOT NULL
  GROUP BY ALL HAVING count(name) > 0 AND NOT bool_or(coalesce(trim(error), '') <> '')
), ends AS (SELECT package, min(snap_no) AS lo, max(snap_no) AS hi FROM listed GROUP BY 1 HAVING min(snap_no) < max(snap_no)), pairs AS (
  SELECT coalesce(b.package, a.package) AS package, coalesce(b.name, a.name) AS name, b.name IS NULL AS is_new, a.name IS NULL AS is_gone,
    b.description IS DISTINCT FROM a.description AS d, b.input_schema IS DISTINCT FROM a.input_schema AS s
  FROM (SELECT l.* FROM latest l JOIN ends e ON e.package = l.package AND e.lo = l.snap_no) b
  FULL JOIN (SELECT l.* FROM latest l JOIN ends e ON e.package = l.package AND e.hi = l.snap_no) a ON a.package = b.package AND a.name = b.name
)
SELECT package, name, 'tool' AS field, CASE WHEN is_new THEN 'added' ELSE 'removed' END AS change FROM pairs WHERE is_new OR is_gone
UNION ALL SELECT package, name, 'description', 'changed' FROM pairs WHERE NOT is_new AND NOT is_gone AND d
UNION ALL SELECT package, name, 'schema', 'changed' FROM pairs WHERE NOT is_new AND NOT is_gone AND s""",
    "drift_steps": f"""
WITH latest AS ({_LATEST}), listed AS (
  SELECT package, snap_no FROM tool_snapshots WHERE package IS NOT NULL AND snap_no IS NOT NULL
  GROUP BY ALL HAVING count(name) > 0 AND NOT bool_or(coalesce(trim(error), '') <> '')
), steps AS (
  SELECT package, snap_no, lag(snap_no) OVER (PARTITION BY package ORDER BY snap_no) AS prev FROM listed QUALIFY prev IS NOT NULL
), b AS (
  SELECT s.package, s.snap_no, l.name, l.description, l.input_schema FROM latest l JOIN steps s ON s.package = l.package AND s.prev = l.snap_no
), a AS (
  SELECT s.package, s.snap_no, l.name, l.description, l.input_schema FROM latest l JOIN steps s ON s.package = l.package AND s.snap_no = l.snap_no
), pairs AS (
  SELECT coalesce(b.package, a.package) AS package, coalesce(b.name, a.name) AS name, coalesce(b.snap_no, a.snap_no) AS snap_no, b.name IS NULL AS is_new, a.name IS NULL AS is_gone,
    b.description IS DISTINCT FROM a.description AS d, b.input_schema IS DISTINCT FROM a.input_schema AS s
  FROM b FULL JOIN a ON a.package = b.package AND a.name = b.name AND a.snap_no = b.snap_no
)
SELECT package, name, snap_no, 'tool' AS field, CASE WHEN is_new THEN 'added' ELSE 'removed' END AS change FROM pairs WHERE is_new OR is_gone
UNION ALL SELECT package, name, snap_no, 'description', 'changed' FROM pairs WHERE NOT is_new AND NOT is_gone AND d
UNION ALL SELECT package, name, snap_no, 'schema', 'changed' FROM pairs WHERE NOT is_new AND NOT is_gone AND s""",
    "granted_revoked": f"""
WITH p AS ({_SUPPLIER_PARTS})
SELECT l_suppkey, len(list_filter(coalesce(running, []), lambda x: NOT list_contains(coalesce(approved, []), x)))::INT AS n_granted,
  len(list_filter(coalesce(approved, []), lambda x: NOT list_contains(coalesce(running, []), x)))::INT AS n_revoked FROM p""",
    "class_membership": """
WITH flags AS (SELECT l_orderkey, bool_and(l_returnflag || '-' || l_linestatus IN ('A-R', 'N-O', 'R-F', 'A-F')) AS fine FROM lineitem GROUP BY 1), tests AS (
  SELECT o_orderkey, coalesce(o_orderstatus = 'F', false) AS s, coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false) AS p, coalesce(fine, false) AS t
  FROM orders LEFT JOIN flags ON l_orderkey = o_orderkey
)
SELECT o_orderkey AS config_id, s AND p AND t AS inside,
  concat_ws(',', CASE WHEN NOT p THEN 'priority' END, CASE WHEN NOT s THEN 'status' END, CASE WHEN NOT t THEN 'tools' END) AS outside FROM tests""",
    "class_coverage": """
WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) < 1996), r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) >= 1996)
SELECT l_suppkey AS class_id, count(*) AS n_missing FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.l_suppkey = e.l_suppkey AND r.l_partkey = e.l_partkey) GROUP BY 1""",
    "class_widening": f"""
WITH p AS ({_SUPPLIER_PARTS}), g AS (SELECT l_suppkey, len(list_filter(coalesce(running, []), lambda x: NOT list_contains(coalesce(approved, []), x)))::INT AS n, approved, running FROM p)
SELECT l_suppkey AS class_id, n AS n_gained FROM g WHERE n > 0 OR approved IS NULL OR running IS NULL""",
    "envelope_conditions": "SELECT user_id AS run_id, coalesce(max(json_extract_string(props, '$.k')::INT % 8) = 7, false) AS admissible FROM events GROUP BY 1",
    "authority_root": f"WITH {_NODES} SELECT graph_id, node, {_EXTRA.format("['1','2','3','4','5']")} AS widened FROM nodes",
    "authority_delegator": f"WITH {_NODES} SELECT c.graph_id, c.node, {_EXTRA.replace('operations', 'c.operations').format('coalesce(p.operations, c.operations)')} AS widened FROM nodes c LEFT JOIN nodes p ON p.graph_id = c.graph_id AND p.node = c.parent",
    "delegation_depths": f"WITH {_NODES} SELECT graph_id, CASE left(node, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS depth, count(*) AS n_nodes FROM nodes GROUP BY ALL",
}
