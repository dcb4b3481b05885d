"""Problem 4: deeply nested records as related flat tables, by one pass of tagged emission.

A depth-first visitor goes over each record once and emits (tag, pk, parent_pk, payload) for every
object that belongs into a table: all five tables come out of the same pass. The emission is written
once, partitioned by tag; a table is its partition with the tag's schema applied. The payload
is a typed column for each member that any table has, of which a tag fills its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestrand.session import spread, stored

KEYS = ("pk", "parent_pk", "capture_id")
#: Payload columns of each table.
TABLES = {
    "tool": ("tool_no", "name", "description", "title"),
    "schema": ("tool_no", "branch", "path", "type"),
    "required": ("tool_no", "branch", "path", "entry"),
    "hint": ("tool_no", "branch", "path", "entry"),
    "reject": ("reason",),
}
#: What a table's parent_pk leads to; tools and rejects hang on their capture, a schema on a tool or a schema.
PARENTS = {"schema": ("tool", "schema"), "required": ("schema",), "hint": ("tool",)}
BRANCHES = ("inputSchema", "outputSchema")
_LONG = ("capture_id", "tool_no")
_COLUMNS = ["tag", *KEYS, *dict.fromkeys(c for columns in TABLES.values() for c in columns)]
EMISSION = ", ".join(f"{c} {'long' if c in _LONG else 'string'}" for c in _COLUMNS)


def text_of(value: object) -> str | None:
    """A string as it is, null as null, anything else as compact JSON."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def tools_of(text: str) -> list:
    """The tools of a listing: a bare list or the member ``tools`` of an object."""
    listing = json.loads(text)
    if isinstance(listing, dict):
        listing = listing.get("tools")
    if not isinstance(listing, list):
        raise ValueError("no list of tools")
    return listing


class Emitter:
    """The visitor: rows of each tag, in the order KEYS and the tag's payload columns."""

    def __init__(self) -> None:
        self.rows: dict[str, list[tuple]] = {tag: [] for tag in TABLES}
        self.size = 0

    def capture(self, capture_id: int | None, text: str) -> None:
        """Emits the rows of one listing; one that can't be read gives a single ``reject``."""
        top = f"c{capture_id}"
        try:
            listing = tools_of(text)
        except (ValueError, RecursionError) as e:
            self.rows["reject"].append((top, None, capture_id, type(e).__name__))
            self.size += 1
            return
        for no, tool in enumerate(listing):
            if not isinstance(tool, dict):
                continue
            pk = f"{top}/t{no}"
            self.rows["tool"].append((pk, top, capture_id, no, text_of(tool.get("name")), text_of(tool.get("description")), text_of(tool.get("title"))))
            self.size += 1
            for branch in BRANCHES:
                if branch in tool:
                    self.schema(tool[branch], branch, pk, capture_id, no)
            notes = tool.get("annotations")
            hint = notes.get("destructiveHint") if isinstance(notes, dict) else None
            if isinstance(hint, (bool, str)) and (word := str(hint).strip().lower()) in ("true", "false"):
                self.rows["hint"].append((f"{pk}/annotations", pk, capture_id, no, "annotations", "", f"destructiveHint={word}"))
                self.size += 1

    def schema(self, schema: object, branch: str, tool: str, capture_id: int | None, no: int) -> None:
        """Emits a schema, its ``required`` entries and, depth first, the schemas under ``properties`` and ``items``.

        An explicit stack: depth is bounded by memory, not by Python's call depth.
        """
        schemas, entries, top = self.rows["schema"], self.rows["required"], f"{tool}/{branch}:"
        stack = [("", schema, tool)]
        while stack:
            path, node, above = stack.pop()
            if not isinstance(node, dict):
                continue
            pk = top + path
            schemas.append((pk, above, capture_id, no, branch, path, text_of(node.get("type"))))
            self.size += 1
            listed = node.get("required")
            if listed:
                listed = [listed] if isinstance(listed, str) else listed if isinstance(listed, list) else []
                for entry in dict.fromkeys(text_of(e) for e in listed if e is not None):
                    entries.append((f"{pk}!{entry}", pk, capture_id, no, branch, path, entry))
                    self.size += 1
            below = []
            members = node.get("properties")
            if isinstance(members, dict):
                below = [(f"{path}.{name}" if path else name, child, pk) for name, child in members.items()]
            if "items" in node:
                below.append((path + "[]", node["items"], pk))
            stack.extend(reversed(below))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What has been emitted, a batch for each tag."""
        for tag, rows in self.rows.items():
            if rows:
                filled = dict(zip((*KEYS, *TABLES[tag]), zip(*rows)), tag=(tag,) * len(rows))
                kinds = [pa.int64() if c in _LONG else pa.string() for c in _COLUMNS]
                yield pa.RecordBatch.from_arrays([pa.array(filled[c], k) if c in filled else pa.nulls(len(rows), k) for c, k in zip(_COLUMNS, kinds)], _COLUMNS)
                self.rows[tag] = []
        self.size = 0


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Emitter()
    for batch in batches:
        for capture_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out.capture(capture_id, text)
            if out.size >= 50_000:
                yield from out.batches()
    yield from out.batches()


def usable(captures: DataFrame) -> DataFrame:
    return captures.filter("tools is not null and coalesce(trim(error), '') = ''")


def tagged_emission(captures: DataFrame) -> DataFrame:
    """(tag, pk, parent_pk, payload columns) of all usable captures. Repeated rows repeat their emission under the same keys."""
    return spread(usable(captures).select(F.col("capture_id").cast(LongType()), "tools")).mapInArrow(_emit, EMISSION)


def split_by_tag(emission: DataFrame) -> DataFrame:
    """The emission written once to the shared folder, partitioned by tag."""
    return stored(emission.select(*_COLUMNS[1:], "tag"), "emission", ["tag"])


def flat_table(split: DataFrame, tag: str, columns: list[str] | None = None) -> DataFrame:
    """One table, or distinct ``columns`` of it; only the tag's partition is read. Repeats of a key are one row."""
    return split.filter(F.col("tag") == tag).select(*(columns or [*KEYS, *TABLES[tag]])).distinct()


def flat_tables(captures: DataFrame) -> dict[str, DataFrame]:
    """All five tables of one pass."""
    split = split_by_tag(tagged_emission(captures))
    return {tag: flat_table(split, tag) for tag in TABLES}


def table_report(captures: DataFrame) -> DataFrame:
    """(tag, n_rows, n_orphans): rows of each table, and those whose parent_pk no row of a parent table has."""
    split = split_by_tag(tagged_emission(captures))
    parts = []
    for tag in TABLES:
        rows = flat_table(split, tag, ["pk", "parent_pk"])
        if tag in PARENTS:
            parents = split.filter(F.col("tag").isin(*PARENTS[tag])).select(F.col("pk").alias("parent_pk"), F.lit(0).alias("orphan")).distinct()
            rows = rows.join(parents, "parent_pk", "left")
        else:
            rows = rows.withColumn("orphan", F.lit(0))
        parts.append(rows.agg(F.lit(tag).alias("tag"), F.count("*").alias("n_rows"), F.count_if(F.col("orphan").isNull()).alias("n_orphans")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def required_and_hints(captures: DataFrame) -> DataFrame:
    """(capture_id, tool_no, branch, path, entry); see TESTDATA problem 4.

    Captures that aren't usable or aren't JSON give no row here (the latter are in the table
    ``reject``). A non-string entry counts by its JSON text, a null entry not at all.
    """
    split = split_by_tag(tagged_emission(captures))
    columns = ["capture_id", "tool_no", "branch", "path", "entry"]
    return split.filter(F.col("tag").isin("required", "hint")).select(columns).distinct()
