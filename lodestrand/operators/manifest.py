"""Two-level addresses of many configurations at once.

A configuration is given as artifacts (config_id, component, name, content) with the components
agent, prompt, procedure, tool, tools_document, corpus and eval_item. Canonical JSON is composed of
the canonical forms of its parts, so parts are canonicalized row by row and put together in the JVM.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestrand.functions.canon import STRICT, Refused, Relation, address, canonical, column_address, column_text_address, json_canonical, json_value, relation, set_address

COMPONENTS = ("model", "prompt", "procedure", "tools", "corpus", "permissions", "eval_set")

_AGENT = StructType([*[StructField(c, StringType()) for c in ("model", "permissions", "rest", "refused")], StructField("operations", ArrayType(StringType()))])


def agent_parts(col: Column | str, rel: str | Relation = STRICT) -> Column:
    """struct<model, permissions: addresses, rest: canonical JSON, refused, operations> of an agent document."""
    rel = relation(rel)

    def one(text: str | None) -> dict:
        row = dict.fromkeys(_AGENT.names)
        try:
            agent = json_value(text or "{}")
            if not isinstance(agent, dict):
                raise Refused("the agent document isn't an object")
            model = agent.get("model", {})
            if isinstance(model, str):
                model = {"id": model, "identity_kind": "provider-string"}
            if not isinstance(model, dict) or not str(model.get("id", "")).strip():
                raise Refused("agent.model has no id")
            operations = agent.get("allowed_operations", [])
            if not isinstance(operations, list) or not all(isinstance(o, str) for o in operations):
                raise Refused("allowed_operations isn't a list of strings")
            if len(set(operations)) != len(operations):
                raise Refused("allowed_operations has repeats")
            rest = {k: v for k, v in agent.items() if k not in ("model", "allowed_operations")}
            row.update(model=address(model, rel), permissions=address(sorted(operations), rel), rest=canonical(rest, rel), operations=sorted(operations))
        except Refused as e:
            row["refused"] = str(e)
        return row

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.struct([*[(c, pa.string()) for c in _AGENT.names[:-1]], ("operations", pa.list_(pa.string()))]))

    return F.arrow_udf(run, _AGENT)(col)


def _document_rest(col: Column, rel: Relation) -> Column:
    """Canonical JSON of what stands beside ``tools`` in a tools document; null if there is nothing."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        doc = json.loads(text)
        rest = {k: v for k, v in doc.items() if k != "tools"} if isinstance(doc, dict) else {}
        return canonical(rest, rel) if rest else None

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())(col)


def members(artifacts: DataFrame, rel: str | Relation = STRICT) -> DataFrame:
    """(config_id, component, member, member_addr, canon, refused): every tool, corpus document, eval item."""
    rel = relation(rel)
    # canonicalized where they are: to find repeated texts first would shuffle every text twice
    tools = artifacts.filter("component = 'tool'").withColumn("c", json_canonical("content", rel))
    tools = tools.select("config_id", F.lit("tools").alias("component"), F.coalesce(F.get_json_object("content", "$.name"), F.lit("")).alias("member"), F.col("c.addr").alias("member_addr"), "c.canon", "c.refused")
    docs = artifacts.filter("component = 'corpus'").select("config_id", F.lit("corpus").alias("component"), F.col("name").alias("member"), column_text_address("content", rel).alias("member_addr"))
    docs = docs.withColumn("c", json_canonical(F.to_json(F.struct(F.col("member").alias("name"), F.col("member_addr").alias("addr"))), rel))
    docs = docs.select("config_id", "component", "member", "member_addr", "c.canon", "c.refused")
    items = artifacts.filter("component = 'eval_item'").withColumn("c", json_canonical("content", rel))
    items = items.select("config_id", F.lit("eval_set").alias("component"), "name", "c.*").select("config_id", "component", F.col("name").alias("member"), F.col("addr").alias("member_addr"), "canon", "refused")
    return tools.unionByName(docs).unionByName(items)


def _corpus_address(docs: Column, scope: str, rel: Relation) -> Column:
    return column_address(F.concat(F.lit('{"docs":['), F.array_join(docs, ","), F.lit(f'],"scope":"{scope}"}}')), rel.name)


def corpora(artifacts: DataFrame, rel: str | Relation = STRICT) -> DataFrame:
    """(config_id, corpus, corpus_refused): the address of each corpus in full scope, for configurations that share it."""
    rel = relation(rel)
    docs = members(artifacts, rel).filter("component = 'corpus'").groupBy("config_id")
    docs = docs.agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "member_addr", "canon"))), lambda d: d["canon"]).alias("docs"), F.collect_set("refused").alias("corpus_refused"))
    return docs.select("config_id", _corpus_address(F.col("docs"), "full", rel).alias("corpus"), "corpus_refused")


def manifests(artifacts: DataFrame, rel: str | Relation = STRICT, resolved: DataFrame | None = None, corpora: DataFrame | None = None) -> DataFrame:
    """(config_id, <address of each component>, configuration_address, violations) of each configuration.

    ``resolved`` (config_id, name) scopes the corpus to the documents an evaluation read. ``corpora``
    (of the function ``corpora``) gives whole corpora in place of corpus artifacts. A
    configuration with violations has no configuration address. The address of a set is the hash of its
    sorted members' addresses, so one configuration's addresses are gathered in one row.
    """
    if resolved is not None and corpora is not None:
        raise ValueError("whole corpora can't be scoped to resolved documents")
    rel = relation(rel)
    rows = artifacts.select("config_id", "component", "name", "content")
    single = lambda c: F.max(F.when(F.col("component") == c, F.col("content")))
    heads = rows.filter(F.col("component").isin("agent", "prompt", "procedure", "tools_document")).groupBy("config_id").agg(
        single("agent").alias("agent"), F.coalesce(single("prompt"), F.lit("")).alias("prompt"), F.coalesce(single("procedure"), F.lit("")).alias("procedure"), single("tools_document").alias("document")
    )
    heads = heads.select("config_id", agent_parts("agent", rel).alias("a"), column_text_address("prompt", rel).alias("prompt"), column_text_address("procedure", rel).alias("procedure"), _document_rest(F.col("document"), rel).alias("document"))

    every = members(rows, rel)
    scope = "full"
    missing = None
    if resolved is not None:
        scope = "resolved"
        wanted = resolved.select("config_id", F.col("name").alias("member")).distinct().withColumn("component", F.lit("corpus"))
        others = every.filter("component != 'corpus'")
        missing = wanted.join(every.filter("component = 'corpus'"), ["config_id", "component", "member"], "left_anti").groupBy("config_id").agg(F.array_sort(F.collect_set("member")).alias("missing"))
        every = others.unionByName(every.join(wanted, ["config_id", "component", "member"], "left_semi").select(others.columns))
    of = lambda c, x: F.collect_list(F.when(F.col("component") == c, x))
    sets = every.groupBy("config_id").agg(
        F.transform(F.array_sort(of("tools", F.struct("member", "canon"))), lambda t: t["canon"]).alias("tool_canon"),
        of("tools", F.col("member")).alias("tool_names"),
        F.transform(F.array_sort(of("corpus", F.struct("member", "member_addr", "canon"))), lambda d: d["canon"]).alias("doc_canon"),
        of("eval_set", F.col("member_addr")).alias("item_addrs"),
        F.collect_set("refused").alias("refused"),
    )
    all_ = heads.join(sets, "config_id", "full_outer")
    if missing is not None:
        all_ = all_.join(missing, "config_id", "left")
    empty = F.array().cast("array<string>")
    if corpora is not None:
        all_ = all_.join(corpora.select("config_id", "corpus", "corpus_refused"), "config_id", "left")
        all_ = all_.withColumn("refused", F.array_union(F.coalesce("refused", empty), F.coalesce("corpus_refused", empty)))
    all_ = all_.withColumns({c: F.coalesce(c, empty) for c in ("tool_canon", "tool_names", "doc_canon", "item_addrs", "refused")})
    tools = F.concat(
        F.lit("{"), F.coalesce(F.concat(F.lit('"document":'), F.col("document"), F.lit(",")), F.lit("")), F.lit('"tools":['), F.array_join("tool_canon", ","), F.lit("]}")
    )
    corpus = _corpus_address(F.col("doc_canon"), scope, rel)
    if corpora is not None:
        corpus = F.coalesce("corpus", corpus)
    repeated = F.size("tool_names") != F.size(F.array_distinct("tool_names"))
    checks = [
        F.col("a.refused"),
        F.when(F.col("a").isNull(), "no agent document"),
        F.when(repeated, "repeated tool names"),
        F.when(F.size("refused") > 0, F.concat(F.lit("refused member: "), F.array_join(F.array_sort("refused"), "; "))),
    ]
    if missing is not None:
        checks.append(F.when(F.size(F.coalesce("missing", empty)) > 0, F.concat(F.lit("dependencies not in the corpus: "), F.array_join("missing", ", "))))
    named = all_.select(
        "config_id",
        F.col("a.model").alias("model"), "prompt", "procedure",
        column_address(tools, rel.name).alias("tools"), corpus.alias("corpus"),
        F.col("a.permissions").alias("permissions"), set_address(F.col("item_addrs"), rel.name).alias("eval_set"),
        F.col("a.rest").alias("rest"), F.array_compact(F.array(*checks)).alias("violations"),
    )
    addresses = F.concat_ws(",", *[F.concat(F.lit(f'"{c}":"'), F.col(c), F.lit('"')) for c in sorted(COMPONENTS)])
    body = F.concat(F.lit('{"agent":'), F.col("rest"), F.lit(',"components":{'), addresses, F.lit("}}"))
    return named.withColumn("configuration_address", F.when(F.size("violations") == 0, column_address(body, rel.name))).drop("rest")


def component_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(config_id, component, before, after) of the components whose addresses differ between two sets of manifests."""
    long = lambda df, name: df.select("config_id", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in COMPONENTS]), F.array(*COMPONENTS))).alias("component", name))
    both = long(before, "before").join(long(after, "after"), ["config_id", "component"], "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def member_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(config_id, component, member, change) between two sets of members: added, removed or changed."""
    keys = ["config_id", "component", "member"]
    both = before.select(*keys, F.col("member_addr").alias("b")).join(after.select(*keys, F.col("member_addr").alias("a")), keys, "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(*keys, change.alias("change")).filter("change is not null")
