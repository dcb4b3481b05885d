"""Queries of the general problems 1, 3, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import drift, history, nested, snapshots
from lodestrand.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.version_periods(table(spark, d, "tool_updates"))


def p1_satellite_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each satellite; attributes are split by change rate."""
    return history.satellite_sizes(table(spark, d, "tool_updates"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "tool_snapshots"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.required_and_hints(table(spark, d, "captures"))


def p4_tools(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of tools, linked to their capture."""
    split = nested.split_by_tag(nested.tagged_emission(table(spark, d, "captures")))
    return nested.flat_table(split, "tool", ["capture_id", "tool_no", "name", "description"])


def p4_schemas(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of schemas, each linked to the tool or schema that holds it."""
    split = nested.split_by_tag(nested.tagged_emission(table(spark, d, "captures")))
    return nested.flat_table(split, "schema", ["pk", "parent_pk", "capture_id", "tool_no", "branch", "path", "type"])


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows and orphans of all five tables of one pass."""
    return nested.table_report(table(spark, d, "captures"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "captures"))


def p5_tools(spark: SparkSession, d: str) -> DataFrame:
    """One consistent table of tools over all versions."""
    return drift.consistent_tools(table(spark, d, "captures"))


QUERIES = {
    "p1_found": p1_found,
    "p1_satellite_sizes": p1_satellite_sizes,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_tools": p4_tools,
    "p4_schemas": p4_schemas,
    "p4_tables": p4_tables,
    "p5_found": p5_found,
    "p5_tools": p5_tools,
}

SAME_TEXT = r"regexp_replace(replace(replace(nfc_normalize({0}), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"

_P1 = f"""
WITH settled AS (
  SELECT * FROM tool_updates WHERE tool_id IS NOT NULL AND effective_at IS NOT NULL AND lower(trim(op)) IN ('upsert', 'retire')
  QUALIFY row_number() OVER (PARTITION BY tool_id, effective_at ORDER BY received_at DESC NULLS LAST, update_id DESC NULLS LAST) = 1
), texts AS (
  SELECT tool_id, effective_at, lower(trim(op)) AS op,
    CASE WHEN lower(trim(op)) = 'upsert' THEN {SAME_TEXT.format("name")} END AS name,
    CASE WHEN lower(trim(op)) = 'upsert' THEN {SAME_TEXT.format("description")} END AS description
  FROM settled
), filled AS (
  SELECT tool_id, effective_at, op, last_value(name IGNORE NULLS) OVER w AS name, last_value(description IGNORE NULLS) OVER w AS description
  FROM texts WINDOW w AS (PARTITION BY tool_id ORDER BY effective_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), marked AS (
  SELECT *, lag(op) OVER w AS was, lag(name) OVER w AS was_name, lag(description) OVER w AS was_description, op = 'upsert' AND count(*) FILTER (op = 'upsert') OVER (w ROWS UNBOUNDED PRECEDING) = 1 AS first_upsert
  FROM filled WINDOW w AS (PARTITION BY tool_id ORDER BY effective_at)
), events AS (
  SELECT * FROM marked WHERE CASE WHEN op = 'retire' THEN coalesce(was = 'upsert', false)
    ELSE was IS NULL OR was = 'retire' OR name IS DISTINCT FROM was_name OR description IS DISTINCT FROM was_description END
), ends AS (
  SELECT *, lead(effective_at) OVER (PARTITION BY tool_id ORDER BY effective_at) AS next_at FROM events
)
"""

_P4 = """
WITH RECURSIVE listings AS (
  SELECT DISTINCT capture_id, CASE WHEN json_type(tools) = 'ARRAY' THEN json_extract(tools, '$[*]') ELSE json_extract(tools, '$.tools[*]') END AS listing
  FROM captures WHERE tools IS NOT NULL AND coalesce(trim(error), '') = ''
), tools AS (
  SELECT capture_id, unnest(listing) AS tool, generate_subscripts(listing, 1) - 1 AS tool_no FROM listings
), walk AS (
  SELECT capture_id, tool_no, branch, '' AS path, json_extract(tool, '$.' || branch) AS node, 'c' || capture_id || '/t' || tool_no AS parent_pk
  FROM tools, (VALUES ('inputSchema'), ('outputSchema')) b(branch)
  UNION ALL
  SELECT capture_id, tool_no, branch, c.path, c.node, 'c' || capture_id || '/t' || tool_no || '/' || branch || ':' || walk.path FROM walk, LATERAL (
    SELECT CASE WHEN walk.path = '' THEN k ELSE walk.path || '.' || k END AS path,
      json_extract(json_extract(walk.node, '$.properties'), '$."' || k || '"') AS node
    FROM (SELECT unnest(json_keys(json_extract(walk.node, '$.properties'))) AS k)
    UNION ALL
    SELECT walk.path || '[]', json_extract(walk.node, '$.items') WHERE json_type(json_extract(walk.node, '$.items')) = 'OBJECT'
  ) c WHERE json_type(walk.node) = 'OBJECT'
), lists AS (
  SELECT capture_id, tool_no, branch, path, json_extract(node, '$.required') AS r FROM walk WHERE json_type(node) = 'OBJECT'
), entries AS (
  SELECT capture_id, tool_no, branch, path, unnest(from_json(r, '["VARCHAR"]')) AS entry FROM lists WHERE json_type(r) = 'ARRAY'
  UNION ALL
  SELECT capture_id, tool_no, branch, path, json_extract_string(r, '$') FROM lists WHERE json_type(r) = 'VARCHAR'
  UNION ALL
  SELECT capture_id, tool_no, 'annotations', '', 'destructiveHint=' || lower(json_extract_string(tool, '$.annotations.destructiveHint'))
  FROM tools WHERE lower(json_extract_string(tool, '$.annotations.destructiveHint')) IN ('true', 'false')
)
"""

SQL = {
    "p1_found": _P1
    + """SELECT tool_id, strftime(effective_at, '%Y-%m-%d %H:%M:%S') AS valid_from,
  coalesce(strftime(next_at, '%Y-%m-%d %H:%M:%S'), 'open') AS valid_to FROM ends WHERE op = 'upsert'""",
    "p1_satellite_sizes": _P1
    + """SELECT 'sat_name' AS satellite, count(*) AS n_rows FROM marked WHERE op = 'upsert' AND (first_upsert OR name IS DISTINCT FROM was_name)
UNION ALL SELECT 'sat_description', count(*) FROM marked WHERE op = 'upsert' AND (first_upsert OR description IS DISTINCT FROM was_description)
UNION ALL SELECT 'sat_status', count(*) FROM marked WHERE (op = 'upsert' AND coalesce(was = 'retire', true)) OR (op = 'retire' AND was = 'upsert')""",
    "p3_found": f"""
WITH latest AS (
  SELECT package, name, snap_no, {SAME_TEXT.format("description")} AS description,
    list_sort(list_distinct(coalesce(from_json(json_extract(input_schema, '$.required'), '["VARCHAR"]'), []))) AS required
  FROM tool_snapshots WHERE name IS NOT NULL AND coalesce(trim(error), '') = ''
  QUALIFY row_number() OVER (PARTITION BY package, name, snap_no ORDER BY delivered_at DESC NULLS LAST) = 1
), listed AS (
  SELECT package, snap_no, lag(snap_no) OVER (PARTITION BY package ORDER BY snap_no) AS prev_no, lead(snap_no) OVER (PARTITION BY package ORDER BY snap_no) AS next_no
  FROM (SELECT package, snap_no FROM tool_snapshots GROUP BY ALL HAVING bool_and(coalesce(trim(error), '') = '') AND count(name) > 0)
), fine AS (SELECT l.*, s.prev_no, s.next_no FROM latest l JOIN listed s USING (package, snap_no))
SELECT c.package, c.name AS tool_name, c.snap_no, CASE WHEN p.name IS NULL THEN 'added' ELSE 'changed' END AS kind
FROM fine c LEFT JOIN fine p ON p.package = c.package AND p.name = c.name AND p.snap_no = c.prev_no
WHERE c.prev_no IS NOT NULL AND (p.name IS NULL OR p.description IS DISTINCT FROM c.description OR p.required IS DISTINCT FROM c.required)
UNION ALL
SELECT p.package, p.name, p.next_no, 'removed'
FROM fine p LEFT JOIN fine c ON p.package = c.package AND p.name = c.name AND c.snap_no = p.next_no
WHERE p.next_no IS NOT NULL AND c.name IS NULL""",
    "p4_tools": """
SELECT DISTINCT capture_id, i AS tool_no, json_extract_string(tool, '$.name') AS name, json_extract_string(tool, '$.description') AS description
FROM (
  SELECT capture_id, unnest(listing) AS tool, generate_subscripts(listing, 1) - 1 AS i
  FROM (
    SELECT capture_id, CASE WHEN json_type(tools) = 'ARRAY' THEN json_extract(tools, '$[*]') ELSE json_extract(tools, '$.tools[*]') END AS listing
    FROM captures WHERE tools IS NOT NULL AND coalesce(trim(error), '') = ''
  )
)
WHERE json_type(tool) = 'OBJECT'""",
    "p4_found": _P4
    + "SELECT DISTINCT capture_id, tool_no, branch, path, entry FROM entries WHERE entry IS NOT NULL",
    "p4_schemas": _P4
    + """SELECT DISTINCT 'c' || capture_id || '/t' || tool_no || '/' || branch || ':' || path AS pk, parent_pk, capture_id, tool_no, branch, path, json_extract_string(node, '$.type') AS type
FROM walk WHERE json_type(node) = 'OBJECT'""",
    "p4_tables": _P4
    + """SELECT 'tool' AS tag, count(DISTINCT (capture_id, tool_no)) AS n_rows, 0::BIGINT AS n_orphans FROM tools WHERE json_type(tool) = 'OBJECT'
UNION ALL SELECT 'schema', count(DISTINCT (capture_id, tool_no, branch, path)), 0 FROM walk WHERE json_type(node) = 'OBJECT'
UNION ALL SELECT CASE branch WHEN 'annotations' THEN 'hint' ELSE 'required' END, count(DISTINCT (capture_id, tool_no, branch, path, entry)), 0 FROM entries WHERE entry IS NOT NULL GROUP BY 1
UNION ALL SELECT 'reject', count(DISTINCT capture_id), 0 FROM captures WHERE tools IS NOT NULL AND coalesce(trim(error), '') = '' AND NOT json_valid(tools)""",
}
