"""What changes between consecutive published versions: identical, byte-only or material, and rewritten descriptions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestrand.functions.canon import column_address, json_canonical
from lodestrand.functions.rawjson import list_items
from lodestrand.operators.drift import version_order, version_position
from lodestrand.operators.nested import usable
from lodestrand.operators.segmented import cut_hot_keys, previous
from lodestrand.operators.variants import varied
from lodestrand.session import spread


def version_rows(captures: DataFrame) -> DataFrame:
    """One usable capture per (package, version): the latest, ties by the greater id and text."""
    rows = usable(captures).filter("package is not null and version is not null")
    best = rows.groupBy("package", "version").agg(F.max(F.struct("captured_at", "capture_id", "tools")).alias("m"))
    return best.select("package", "version", F.col("m.tools").alias("tools"))


def listing(tools: Column) -> Column:
    """The JSON array of a listing that is a bare list or an object with ``tools``."""
    return F.when(F.ltrim(tools).startswith("["), tools).otherwise(F.get_json_object(tools, "$.tools"))


def tool_texts(captures: DataFrame) -> DataFrame:
    """(package, version, tool): every tool of the usable captures as it is spelled."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for package, version, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    json.loads(text)
                    out += [(package, version, t) for t in list_items(text, "tools")[0]]
                except (ValueError, RecursionError):
                    continue
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["package", "version", "tool"])

    return spread(usable(captures).select("package", "version", "tools")).mapInArrow(split, "package string, version string, tool string")


def tool_rows(versions: DataFrame) -> DataFrame:
    """(package, version, name, addr, description, schema_addr) of each tool; of one name the first in text order counts."""
    items = F.from_json(listing(F.col("tools")), "array<string>")
    tools = versions.select("package", "version", F.explode(items).alias("t"))
    rows = tools.select("package", "version", F.coalesce(F.get_json_object("t", "$.name"), F.lit("")).alias("name"), json_canonical("t").alias("c"), F.coalesce(F.get_json_object("t", "$.description"), F.lit("")).alias("description"), json_canonical(F.get_json_object("t", "$.inputSchema")).alias("s"))
    best = rows.groupBy("package", "version", "name").agg(F.min(F.struct(F.col("c.addr").alias("addr"), "description", F.col("s.addr").alias("schema_addr"))).alias("m"))
    return best.select("package", "version", "name", "m.*")


def version_pairs(versions: DataFrame, rows_per_chunk: int = 500_000) -> DataFrame:
    """(package, version_from, version_to): consecutive versions in version order; a package of very many is cut into chunks of its order."""
    named = versions.select("package", "version").distinct().withColumn("__order", F.struct(version_order(F.col("version")).alias("o"), F.col("version").alias("v")))
    named, seg = cut_hot_keys(named, "package", "__order", version_position(F.col("__order.o")), rows_per_chunk)
    return previous(named, seg, "version", "version_from").filter("version_from is not null").select("package", "version_from", F.col("version").alias("version_to"))


def paired_tools(tools: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tools of both versions of each pair, full outer by name: columns b_* and a_* are null on the side that lacks it."""
    side = lambda p, v: tools.select("package", F.col("version").alias(v), "name", *[F.col(c).alias(f"{p}_{c}") for c in ("addr", "description", "schema_addr")])
    before = pairs.join(side("b", "version_from"), ["package", "version_from"])
    after = pairs.join(side("a", "version_to"), ["package", "version_to"])
    return before.join(after, ["package", "version_from", "version_to", "name"], "full_outer")


def classify_pairs(versions: DataFrame) -> DataFrame:
    """(package, version_from, version_to, classification, kind, n_added, n_removed, n_changed).

    identical: the listing's bytes are the same; byte_only: the tools' addresses are, the bytes not; material otherwise.
    """
    pairs = version_pairs(versions)
    raw = versions.select("package", "version", F.sha2(listing(F.col("tools")).cast("binary"), 256).alias("bytes"))
    differ = paired_tools(tool_rows(versions), pairs).groupBy("package", "version_from", "version_to").agg(
        F.count_if(F.col("b_addr").isNull()).alias("n_added"),
        F.count_if(F.col("a_addr").isNull()).alias("n_removed"),
        F.count_if(F.col("a_addr") != F.col("b_addr")).alias("n_changed"),
        F.count_if(F.col("a_description") != F.col("b_description")).alias("__d"),
        F.count_if(~F.col("a_schema_addr").eqNullSafe(F.col("b_schema_addr")) & F.col("a_addr").isNotNull() & F.col("b_addr").isNotNull()).alias("__s"),
    )
    both = pairs.join(differ, ["package", "version_from", "version_to"], "left").na.fill(0)
    for side in ("from", "to"):
        both = both.join(raw.select("package", F.col("version").alias(f"version_{side}"), F.col("bytes").alias(f"__{side}")), ["package", f"version_{side}"])
    same = (F.col("n_added") == 0) & (F.col("n_removed") == 0) & (F.col("n_changed") == 0)
    classification = F.when(~same, "material").when(F.col("__from") == F.col("__to"), "identical").otherwise("byte_only")
    kind = (
        F.when(same, F.lit(None))
        .when((F.col("n_added") > 0) | (F.col("n_removed") > 0), "tool set changed")
        .when((F.col("__d") > 0) & (F.col("__s") == 0), "description only")
        .when((F.col("__d") == 0) & (F.col("__s") > 0), "schema only")
        .when((F.col("__d") > 0) & (F.col("__s") > 0), "description and schema")
        .otherwise("other")
    )
    return both.select("package", "version_from", "version_to", classification.alias("classification"), kind.alias("kind"), "n_added", "n_removed", "n_changed")


def description_rewrites(versions: DataFrame) -> DataFrame:
    """(package, version_from, version_to, tool, chars_before, chars_after, delta) of tools whose description changed under an unchanged name."""
    both = paired_tools(tool_rows(versions), version_pairs(versions)).filter("b_description is not null and a_description is not null and b_description != a_description")
    sized = both.select("package", "version_from", "version_to", F.col("name").alias("tool"), F.char_length("b_description").alias("chars_before"), F.char_length("a_description").alias("chars_after"))
    return sized.withColumn("delta", F.col("chars_after") - F.col("chars_before"))


def largest_rewrites(versions: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` rewrites of greatest absolute change."""
    return description_rewrites(versions).orderBy(F.abs("delta").desc(), "package", "version_from", "tool").limit(k)


def release_summary(versions: DataFrame) -> DataFrame:
    """One row: packages, pairs, counts of each class, silent redefinitions and the rate of byte-only pairs (4 places, null without pairs)."""
    is_ = lambda c: F.count_if(F.col("classification") == c)
    summary = classify_pairs(versions).agg(
        F.count_distinct("package").alias("n_packages"), F.count("*").alias("n_pairs"), is_("identical").alias("identical"), is_("byte_only").alias("byte_only"), is_("material").alias("material"),
        F.count_if((F.col("classification") == "material") & (F.col("n_added") == 0) & (F.col("n_removed") == 0)).alias("silent"),
    )
    return summary.withColumn("byte_only_rate", F.bround(F.col("byte_only") / F.nullif("n_pairs", F.lit(0)), 4))


def listing_address(tools: Column) -> Column:
    """Address of a listing's bytes from its tools on."""
    return column_address(listing(tools), "bytes")


def evenly_spread(versions: DataFrame, k: int) -> DataFrame:
    """At most ``k`` >= 2 versions of each package, evenly spaced in version order, the first and the newest among them."""
    w = Window.partitionBy("package")
    ranked = versions.select("package", "version").distinct().withColumn("o", version_order(F.col("version")))
    ranked = ranked.withColumns({"r": F.row_number().over(w.orderBy("o", "version")) - 1, "n": F.count("*").over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(k - 1)).cast("int"))
    return ranked.filter((F.col("n") <= k) | F.array_contains(wanted, F.col("r"))).select("package", "version")


def breakdown(pairs: DataFrame) -> DataFrame:
    """(kind, n) of material pairs by the kind of change, the commonest first."""
    return pairs.filter("classification = 'material'").groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "kind")


def rewrite_totals(versions: DataFrame) -> DataFrame:
    """(n_rewrites, net_chars, n_longer, n_shorter): all rewritten descriptions together."""
    return description_rewrites(versions).agg(F.count("*").alias("n_rewrites"), F.coalesce(F.sum("delta"), F.lit(0)).alias("net_chars"), F.count_if(F.col("delta") > 0).alias("n_longer"), F.count_if(F.col("delta") < 0).alias("n_shorter"))


def failures(captures: DataFrame) -> DataFrame:
    """(package, version, error) of captures that failed."""
    return captures.filter("coalesce(trim(error), '') <> '' or tools is null").select("package", "version", "error").distinct()


def positive_control(versions: DataFrame) -> DataFrame:
    """(n, n_byte_only): of all listings, those for which another spelling is told as byte-only. A comparison that finds no byte-only change means something only if this finds them all."""

    def other(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else varied(varied(varied(t, "key_reorder"), "escape_form"), "json_whitespace") for t in texts.to_pylist()], pa.string())

    both = versions.select(listing(F.col("tools")).alias("b")).filter("b is not null").withColumn("a", F.arrow_udf(other, StringType())("b"))
    bytes_differ = F.sha2(F.col("b").cast("binary"), 256) != F.sha2(F.col("a").cast("binary"), 256)
    told = both.select((bytes_differ & (json_canonical("b")["addr"] == json_canonical("a")["addr"])).alias("ok"))
    return told.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_byte_only"))
