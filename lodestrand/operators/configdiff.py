"""What differs between two configurations, component by component and down to the field, for many pairs at once."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.canon import STRICT, Relation
from lodestrand.operators.jsondiff import diff_column, first_different_line
from lodestrand.operators.manifest import component_drift, manifests

_OUT = ("component", "path", "change", "before", "after")


def _rows(df: DataFrame, component: str, *columns: Column) -> DataFrame:
    return df.select("config_id", F.lit(component).alias("component"), *[c.cast("string").alias(n) for c, n in zip(columns, _OUT[1:])])


def _of(artifacts: DataFrame, component: str) -> DataFrame:
    return artifacts.filter(F.col("component") == component).select("config_id", "name", "content")


def _both(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on keys: b and a are the contents, nb and na tell which side has the row."""
    side = lambda df, c: df.select(*keys, F.col("content").alias(c), F.lit(True).alias(f"n{c}"))
    return side(before, "b").join(side(after, "a"), keys, "full_outer")


def _change(differs: Column) -> Column:
    return F.when(F.col("nb").isNull(), "added").when(F.col("na").isNull(), "removed").when(differs, "changed")


def _json_fields(pairs: DataFrame, component: str, prefix: Column, relation: Relation) -> DataFrame:
    each = pairs.filter(~F.col("b").eqNullSafe(F.col("a"))).withColumn("p", prefix).select("config_id", "p", F.explode(diff_column("b", "a", relation)).alias("d"))
    return _rows(each, component, F.concat("p", F.when(F.col("d.path") == "/", "").otherwise(F.col("d.path"))), F.col("d.change"), F.col("d.before"), F.col("d.after"))


def _lines(pairs: DataFrame, component: str, label: Column) -> DataFrame:
    """The first line that differs of each pair of texts."""
    each = pairs.withColumn("l", first_different_line("b", "a")).filter("l is not null")
    change = F.when(F.col("l.before").isNull(), "added").when(F.col("l.after").isNull(), "removed").otherwise("changed")
    return _rows(each, component, F.concat(label, F.lit(":line "), F.col("l.line_no").cast("string")), change, F.col("l.before"), F.col("l.after"))


def _named(before: DataFrame, after: DataFrame, name: Column) -> tuple[DataFrame, DataFrame]:
    return tuple(df.withColumn("name", name) for df in (before, after))


def _tools(before: DataFrame, after: DataFrame, relation: Relation) -> DataFrame:
    """Tools by name; of a configuration with a repeated name on either side only that it can't be told."""
    name = F.coalesce(F.get_json_object("content", "$.name"), F.lit(""))
    b, a = _named(_of(before, "tool"), _of(after, "tool"), name)
    count = lambda df, s: df.groupBy("config_id").agg(F.count("*").alias(f"n{s}"), F.count_distinct("name").alias(f"d{s}"))
    counts = count(b, "b").join(count(a, "a"), "config_id", "full_outer").na.fill(0)
    unclear = counts.filter("nb != db or na != da")
    say = lambda s: F.concat(F.col(f"n{s}").cast("string"), F.lit(" tools, "), F.col(f"d{s}").cast("string"), F.lit(" names"))
    clear = lambda df: df.join(unclear, "config_id", "left_anti")
    pairs = _both(clear(b), clear(a), ["config_id", "name"])
    path = F.concat(F.lit("tools/"), F.col("name"))
    alone = _rows(pairs.filter("nb is null or na is null"), "tools", path, _change(F.lit(False)), F.when(F.col("nb"), "<tool>"), F.when(F.col("na"), "<tool>"))
    inside = _json_fields(pairs.filter("nb and na"), "tools", path, relation)
    rest = _both(_of(before, "tools_document"), _of(after, "tools_document"), ["config_id"])
    around = _json_fields(rest.select("config_id", _without_tools("b").alias("b"), _without_tools("a").alias("a")), "tools", F.lit("tools_document"), relation)
    return _rows(unclear, "tools", F.lit("tools"), F.lit("ambiguous"), say("b"), say("a")).unionByName(alone).unionByName(inside).unionByName(around)


def _without_tools(col: str) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            doc = json.loads(t) if t else {}
            out.append(json.dumps({k: v for k, v in doc.items() if k != "tools"}, ensure_ascii=False) if isinstance(doc, dict) else "{}")
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(col)


def _permissions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Operations as sets: granted or revoked."""
    operations = lambda df: _of(df, "agent").select("config_id", F.explode(F.from_json(F.get_json_object("content", "$.allowed_operations"), "array<string>")).alias("name"), F.lit("").alias("content")).distinct()
    pairs = _both(operations(before), operations(after), ["config_id", "name"]).filter("nb is null or na is null")
    return _rows(pairs, "permissions", F.lit("permissions"), F.when(F.col("nb").isNull(), "granted").otherwise("revoked"), F.when(F.col("nb"), F.col("name")), F.when(F.col("na"), F.col("name")))


def _eval_set(before: DataFrame, after: DataFrame, relation: Relation) -> DataFrame:
    """Items by position (of their ids, as they have no other order here); other counts, or the same items in another order, say so instead."""
    at = Window.partitionBy("config_id").orderBy("name", "content")
    b, a = (_of(df, "eval_item").withColumn("n", F.row_number().over(at) - 1) for df in (before, after))
    count = lambda df, s: df.groupBy("config_id").agg(F.count("*").alias(f"n{s}"))
    sizes = count(b, "b").join(count(a, "a"), "config_id", "full_outer").na.fill(0)
    say = lambda s: F.concat(F.col(f"n{s}").cast("string"), F.lit(" items"))
    counted = _rows(sizes.filter("nb != na"), "eval_set", F.lit("eval_set"), F.lit("changed"), say("b"), say("a"))
    alike = sizes.filter("nb = na").select("config_id")
    pairs = _both(b, a, ["config_id", "n"]).join(alike, "config_id", "left_semi")
    return counted.unionByName(_json_fields(pairs, "eval_set", F.concat(F.lit("eval_set["), F.col("n").cast("string"), F.lit("]")), relation))


def field_drift(before: DataFrame, after: DataFrame, relation: Relation = STRICT, resolved: DataFrame | None = None) -> DataFrame:
    """(config_id, component, path, change, before, after) of two sides of configurations with the same ids, as artifacts.

    Only configurations and components whose address moved are looked into; the agent's other fields are component
    ``agent``. A component whose address moved and whose parts show no difference by themselves is ``reordered``. Equal
    sides and empty tables give no row.
    """
    moved = component_drift(manifests(before, relation, resolved), manifests(after, relation, resolved)).select("config_id", "component")
    known = before.select("config_id").distinct().join(after.select("config_id").distinct(), "config_id", "left_semi")
    moved = moved.join(known, "config_id", "left_semi")
    texts = lambda c: _both(_of(before, c).drop("name"), _of(after, c).drop("name"), ["config_id"])
    agent = texts("agent")
    found = _tools(before, after, relation)
    for component in ("prompt", "procedure"):
        found = found.unionByName(_lines(texts(component), component, F.lit(component)))
    found = found.unionByName(_permissions(before, after)).unionByName(_eval_set(before, after, relation))
    part = lambda c: F.get_json_object(c, "$.model")
    model = agent.select("config_id", *[F.when(part(c).startswith("{"), part(c)).otherwise(F.to_json(F.struct(part(c).alias("id")))).alias(c) for c in ("b", "a")])
    found = found.unionByName(_json_fields(model, "model", F.lit("model"), relation))
    corpus = _both(_of(before, "corpus"), _of(after, "corpus"), ["config_id", "name"])
    path = F.concat(F.lit("corpus/"), F.col("name"))
    found = found.unionByName(_rows(corpus.filter("nb is null or na is null"), "corpus", path, _change(F.lit(False)), F.when(F.col("nb"), "<doc>"), F.when(F.col("na"), "<doc>")))
    found = found.unionByName(_lines(corpus.filter("nb and na and not b <=> a"), "corpus", path))
    told = found.join(moved, ["config_id", "component"], "left_semi").select("config_id", *_OUT)
    silent = moved.join(told.select("config_id", "component").distinct(), ["config_id", "component"], "left_anti")
    null = F.lit(None).cast("string")
    reordered = silent.select("config_id", "component", F.col("component").alias("path"), F.lit("reordered").alias("change"), null.alias("before"), null.alias("after"))
    rest = _json_fields(agent, "agent", F.lit("agent"), relation).filter("not startswith(path, 'agent/model') and not startswith(path, 'agent/allowed_operations')")
    return told.unionByName(reordered).unionByName(rest.join(known, "config_id", "left_semi").select("config_id", *_OUT))
