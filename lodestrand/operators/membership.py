"""Classes of configurations, and conditions of an evidence envelope, as set algebra. Unknown fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.canon import json_canonical

RELATIONS = ("pin", "any_of", "subset_of")
#: Components whose members may vary within a set (fixed values).
SUBSET_COMPONENTS = ("tools", "corpus", "permissions")

_EMPTY = "array()"


def _members(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def rule_violations(rules: DataFrame, components: list[str]) -> DataFrame:
    """(class_id, component, problem) of rules that declare nothing checkable.

    ``rules``: class_id, component, relation, members. Every component needs a rule; members may
    not be empty, a pin has one, and subset_of is for tools, corpus and permissions.
    """
    n = F.size(_members("members"))
    problem = (
        F.when(~F.col("relation").isin(*RELATIONS) | F.col("relation").isNull(), "unknown relation")
        .when(n == 0, "no members")
        .when((F.col("relation") == "pin") & (n != 1), "a pin has one member")
        .when((F.col("relation") == "subset_of") & ~F.col("component").isin(*SUBSET_COMPONENTS), "subset_of isn't for this component")
    )
    wrong = rules.select("class_id", "component", problem.alias("problem")).filter("problem is not null")
    absent = rules.groupBy("class_id").agg(F.collect_set("component").alias("have")).select("class_id", F.explode(F.array_except(F.array(*[F.lit(c) for c in components]), F.col("have"))).alias("component"))
    return wrong.unionByName(absent.withColumn("problem", F.lit("no rule")))


def satisfied(relation: Column, members: Column, address: Column, present: Column) -> Column:
    """Whether a component meets its rule; never null: what is unknown isn't met."""
    pin = F.get(members, F.lit(0)) == address
    any_of = F.array_contains(members, address)
    subset = F.size(F.array_except(present, members)) == 0
    return F.coalesce(F.when(relation == "pin", pin).when(relation == "any_of", any_of).when(relation == "subset_of", subset & present.isNotNull()), F.lit(False))


def class_decisions(rules: DataFrame, presented: DataFrame) -> DataFrame:
    """(class_id, config_id, inside, outside): of configurations against the classes they claim.

    ``presented``: class_id, config_id, component, address, present (members). ``outside`` names
    the components that fail, one without a presented value included.
    """
    shown = presented.groupBy("class_id", "config_id").agg(F.collect_list(F.struct("component", "address", "present")).alias("shown"))
    wanted = rules.groupBy("class_id").agg(F.collect_list(F.struct("component", "relation", _members("members").alias("members"))).alias("rules"))
    both = shown.join(wanted, "class_id", "left")

    def fails(rule: Column) -> Column:
        of = F.get(F.filter("shown", lambda s: s["component"] == rule["component"]), F.lit(0))
        return ~satisfied(rule["relation"], rule["members"], of["address"], of["present"])

    failed = F.transform(F.filter("rules", fails), lambda r: r["component"])
    outside = F.coalesce(F.array_sort(failed), F.array().cast("array<string>"))
    return both.select("class_id", "config_id", F.col("rules").isNotNull().alias("known"), outside.alias("outside")).select(
        "class_id", "config_id", (F.col("known") & (F.size("outside") == 0)).alias("inside"), "outside"
    )


def outside_class(rules: list[tuple[str, str, list[str]]], shown: dict[str, tuple[Column | None, Column | None]]) -> Column:
    """Sorted array of the components outside one class, as an expression over columns: no row is spread out or gathered.

    ``rules``: (component, relation, members); ``shown``: by component the columns of its address and of its members.
    """
    null = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    fails = []
    for component, relation, members in rules:
        address, present = (given if given is not None else none for given, none in zip(shown.get(component, (None, None)), null))
        fails.append(F.when(~satisfied(F.lit(relation), F.array(*map(F.lit, members)), address, present), F.lit(component)))
    return F.array_sort(F.array_compact(F.array(*fails)))


def uncovered_members(declared: DataFrame, exercised: DataFrame) -> DataFrame:
    """(class_id, component, member): members of rules, a row each, that no evaluated configuration exercised; nothing is gathered by class."""
    keys = ["class_id", "component", "member"]
    return declared.select(keys).distinct().join(exercised.select(keys).distinct(), keys, "left_anti")


def class_addresses(rules: DataFrame) -> DataFrame:
    """(class_id, declared, class_address): the canonical declaration of each class and its address; the order of rules and members doesn't matter."""
    per = rules.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("component", "relation", F.array_sort(_members("members")).alias("members")))).alias("rules"))
    c = json_canonical(F.to_json(F.struct(F.col("class_id").alias("name"), "rules")))
    return per.select("class_id", c.alias("c")).select("class_id", F.col("c.canon").alias("declared"), F.col("c.addr").alias("class_address"))


def uncovered(rules: DataFrame, exercised: DataFrame) -> DataFrame:
    """(class_id, component, missing): members of rules that no evaluated configuration exercised."""
    seen = exercised.groupBy("class_id", "component").agg(F.collect_set("member").alias("seen"))
    both = rules.join(seen, ["class_id", "component"], "left").withColumn("missing", F.array_sort(F.array_except(_members("members"), _members("seen"))))
    return both.filter(F.size("missing") > 0).select("class_id", "component", "missing")


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """(class_id, component, gained): components where the new rules admit members the old don't, or that one side lacks."""
    keys = ["class_id", "component"]
    both = old.select(*keys, F.col("members").alias("o")).join(new.select(*keys, F.col("members").alias("n")), keys, "full_outer")
    gained = F.array_sort(F.array_except(_members("n"), _members("o")))
    return both.withColumn("gained", gained).filter(F.col("o").isNull() | F.col("n").isNull() | (F.size("gained") > 0)).select(*keys, "gained")


def rules_from_evaluated(evaluated: DataFrame, vary: list[str]) -> DataFrame:
    """(class_id, component, relation, members) that admit just what was evaluated.

    ``evaluated``: class_id, config_id, component, address, present. Components in ``vary`` become
    subset_of the union of their members (pin of the address if there are none), others any_of their
    addresses, or a pin if there is one.
    """
    per = evaluated.groupBy("class_id", "component").agg(F.array_sort(F.collect_set("address")).alias("addresses"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(_members("present"))))).alias("union"))
    subset = F.col("component").isin(*vary) & (F.size("union") > 0)
    relation = F.when(subset, "subset_of").when(F.size("addresses") == 1, "pin").otherwise("any_of")
    return per.select("class_id", "component", relation.alias("relation"), F.when(subset, F.col("union")).otherwise(F.col("addresses")).alias("members"))


# --- envelopes -----------------------------------------------------------------------------------


def envelope_violations(envelopes: DataFrame) -> DataFrame:
    """(envelope_id, problem). ``envelopes``: envelope_id, conditions map, material array, conclusion."""
    empty = F.array().cast("array<string>")
    material, names = F.coalesce("material", empty), F.coalesce(F.map_keys("conditions"), empty)
    problem = (
        F.when(F.coalesce(F.trim("conclusion"), F.lit("")) == "", "no conclusion is licensed")
        .when(F.size(F.array_except(material, names)) > 0, "a material condition isn't declared")
        .when((F.size(names) > 0) & (F.size(material) == 0), "conditions without a material one")
    )
    return envelopes.select("envelope_id", problem.alias("problem")).filter("problem is not null")


def condition_checks(envelopes: DataFrame, observed: DataFrame) -> DataFrame:
    """(envelope_id, run_id, admissible, failed): every material condition must be observed with its declared value.

    ``observed``: envelope_id, run_id, values map. A condition that wasn't observed fails.
    """
    wanted = envelopes.select("envelope_id", F.coalesce("material", F.array().cast("array<string>")).alias("material"), "conditions")
    both = observed.join(wanted, "envelope_id", "left")
    failed = F.filter("material", lambda m: ~F.coalesce(F.element_at("conditions", m) == F.element_at("values", m), F.lit(False)))
    failed = F.when(F.col("material").isNull(), F.array(F.lit("unknown envelope"))).otherwise(F.array_sort(failed))
    return both.select("envelope_id", "run_id", failed.alias("failed")).select("envelope_id", "run_id", (F.size("failed") == 0).alias("admissible"), "failed")


def contradictions(declared: DataFrame, observed: DataFrame, absence: DataFrame) -> DataFrame:
    """(envelope_id, condition, declared, observed): declared conditions that observations contradict.

    ``declared`` and ``observed``: envelope_id, condition, value; ``absence``: condition, value pairs, trimmed
    and in lower case, that deny what an observation of that condition shows to be there.
    """
    norm = lambda c: F.lower(F.trim(c))
    both = declared.select("envelope_id", "condition", F.col("value").alias("declared")).join(observed.select("envelope_id", "condition", F.col("value").alias("observed")), ["envelope_id", "condition"])
    denied = absence.select("condition", norm(F.col("value")).alias("__v"), F.lit(True).alias("__denied")).distinct()
    both = both.withColumn("__v", norm(F.col("declared"))).join(denied, ["condition", "__v"], "left")
    contradicts = F.when(F.coalesce("__denied", F.lit(False)), ~norm(F.col("observed")).eqNullSafe(F.col("__v"))).otherwise(~F.col("declared").eqNullSafe(F.col("observed")))
    return both.filter(contradicts).select("envelope_id", "condition", "declared", "observed")
