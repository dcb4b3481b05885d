"""Whether authority narrows along delegation, and whether a whole run is admissible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import stored


def widened_authority(nodes: DataFrame, scope: str = "root") -> DataFrame:
    """(graph_id, node, widened) of every node: operations that its superior lacks.

    ``nodes``: graph_id, node, operations, delegates_to, is_root. Scope ``root`` compares with the
    graph's root, ``delegator`` with each node that delegates to it; without a superior nothing is
    widened. Null operations are none.
    """
    empty = F.array().cast("array<string>")
    own = nodes.select("graph_id", "node", F.coalesce("operations", empty).alias("operations"))
    if scope == "root":
        above = nodes.filter("is_root").select("graph_id", F.coalesce("operations", empty).alias("above"))
        both = own.join(above, "graph_id", "left")
    elif scope == "delegator":
        above = nodes.select("graph_id", F.explode("delegates_to").alias("node"), F.coalesce("operations", empty).alias("above"))
        both = own.join(above, ["graph_id", "node"], "left")
    else:
        raise ValueError("scope is root or delegator")
    extra = F.array_except("operations", F.coalesce("above", F.col("operations")))
    return both.select("graph_id", "node", extra.alias("extra")).groupBy("graph_id", "node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("extra")))).alias("widened"))


def undeclared(nodes: DataFrame) -> DataFrame:
    """(graph_id, node): delegates that no row declares."""
    return nodes.select("graph_id", F.explode("delegates_to").alias("node")).distinct().join(nodes.select("graph_id", "node"), ["graph_id", "node"], "left_anti")


def depths(nodes: DataFrame) -> DataFrame:
    """(graph_id, node, depth): least number of delegations from the root, of nodes it reaches at any depth.

    A frontier moves on from nodes not seen before, so a shared delegate is met once and a cycle ends.
    """
    edges = stored(nodes.select("graph_id", "node", F.explode("delegates_to").alias("child")).distinct(), "edges")
    frontier = stored(nodes.filter("is_root").select("graph_id", "node").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = frontier
    while not frontier.isEmpty():
        onward = frontier.join(edges, ["graph_id", "node"]).select("graph_id", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = stored(onward.join(seen.select("graph_id", "node"), ["graph_id", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def run_admissible(nodes: DataFrame, permitted: DataFrame, scope: str = "root") -> DataFrame:
    """(graph_id, admissible, blocked): a run is admissible if every node is permitted and widens nothing.

    ``permitted``: graph_id, node, permitted. A node without a decision is blocked.
    """
    wide = widened_authority(nodes, scope).join(permitted, ["graph_id", "node"], "left")
    ok = F.coalesce("permitted", F.lit(False)) & (F.size("widened") == 0)
    return wide.withColumn("ok", ok).groupBy("graph_id").agg(F.bool_and("ok").alias("admissible"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("node")))).alias("blocked"))
