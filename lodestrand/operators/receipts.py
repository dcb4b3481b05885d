"""Signed receipts of evidence for a configuration, and whether they still hold for what is presented.

A receipt's payload is canonical JSON signed by Ed25519. A point receipt licenses one address. An envelope
receipt carries the declaration of a class of configurations and of conditions, and licenses members
of the class that meet the material conditions; its verdict says so. What isn't known isn't approved,
and what was presented without a receipt is blocked.
"""

from __future__ import annotations

import json
import os
import secrets

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from lodestrand.functions import ed25519
from lodestrand.functions.canon import STRICT, Refused, address, canonical_bytes, declaration, json_canonical, json_value
from lodestrand.operators.manifest import COMPONENTS
from lodestrand.operators.membership import envelope_violations, rule_violations, satisfied, uncovered

VERSION = "lodestrand/receipt/2"
SIGNED = StructType([StructField(c, StringType()) for c in ("payload", "signature", "public_key", "receipt_address")])


def status(evaluation: Column, n_eval: Column, n_corpus: Column, structural: Column) -> Column:
    """APPROVED if the evaluation passed its gate and a scan that saw both sides found no structural copy; unknown isn't approved."""
    clean = (structural == 0) & (n_eval > 0) & (n_corpus > 0)
    return F.when(F.coalesce(evaluation & clean, F.lit(False)), "APPROVED").otherwise("REFUSED")


def integrity(n_eval: Column, n_corpus: Column, structural: Column) -> Column:
    """NOT CHECKED if either side was empty or unknown, never CLEAN."""
    unseen = F.coalesce((n_eval <= 0) | (n_corpus <= 0) | structural.isNull(), F.lit(True))
    return F.when(unseen, "NOT CHECKED").when(structural == 0, "CLEAN").otherwise("CONTAMINATED")


def evaluation_scores(results: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(config_id, passed, failed, score, gate_passed, dependencies) of evaluation results.

    ``results``: config_id, ok, used (names of documents read). The gate is inclusive; a null outcome failed;
    dependencies are the union of what was read.
    """
    ok = F.coalesce("ok", F.lit(False))
    used = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("used", F.array().cast("array<string>"))))))
    per = results.groupBy("config_id").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), used.alias("dependencies"))
    score = F.col("passed") / (F.col("passed") + F.col("failed"))
    return per.select("config_id", "passed", "failed", score.alias("score"), (score >= threshold).alias("gate_passed"), "dependencies")


def signed(payload: Column, secret: bytes) -> Column:
    """struct<payload, signature, public_key, receipt_address> of JSON text, in hex; what can't be canonicalized has a null signature."""
    public = ed25519.public_key(secret).hex()

    def one(text: str | None) -> dict | None:
        if text is None:
            return None
        try:
            value = json_value(text)
            content = canonical_bytes(value)
            return {"payload": content.decode(), "signature": ed25519.sign(secret, content).hex(), "public_key": public, "receipt_address": address(value)}
        except Refused:
            return {"payload": text, "signature": None, "public_key": public, "receipt_address": None}

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.struct([(c, pa.string()) for c in SIGNED.names]))

    return F.arrow_udf(run, SIGNED)(payload)


def signature_valid(payload: Column | str, signature: Column | str, public_key: Column | str) -> Column:
    """Whether the signature is the key's over the payload's canonical form; malformed parts make it false."""

    def one(p: str | None, s: str | None, k: str | None) -> bool:
        try:
            return ed25519.verify(bytes.fromhex(k), canonical_bytes(json.loads(p)), bytes.fromhex(s))
        except (TypeError, ValueError, RecursionError):
            return False

    def run(p: pa.Array, s: pa.Array, k: pa.Array) -> pa.Array:
        return pa.array([one(*x) for x in zip(p.to_pylist(), s.to_pylist(), k.to_pylist())], pa.bool_())

    return F.arrow_udf(run, BooleanType())(payload, signature, public_key)


# --- envelopes --------------------------------------------------------------------------------------

#: A declared envelope as it stands in a payload.
DECLARATION = (
    "struct<name: string, configuration_class: struct<name: string, rules: array<struct<component: string, relation: string, members: array<string>>>>, "
    "conditions: map<string, string>, material_conditions: array<string>, licensed_conclusion: string>"
)


def declared_envelopes(envelopes: DataFrame, rules: DataFrame, exercised: DataFrame) -> DataFrame:
    """(envelope_id, declared, envelope_address, exercised, problems) of envelopes over classes.

    ``envelopes``: envelope_id, class_id, conditions map, material array, conclusion; ``rules``: class_id, component,
    relation, members; ``exercised``: class_id, component, member of what was evaluated. ``problems`` names every
    rule or condition that is ill-formed and every member that no evaluation exercised; only an envelope without any may be issued.
    """
    classes = rules.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("component", "relation", F.array_sort("members").alias("members")))).alias("rules"))
    seen = exercised.groupBy("class_id", "component").agg(F.array_sort(F.collect_set("member")).alias("members")).groupBy("class_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "members")))).alias("exercised"))
    ill = rule_violations(rules, list(COMPONENTS)).select("class_id", F.concat_ws(": ", "component", "problem").alias("p"))
    bare = uncovered(rules, exercised).select("class_id", F.concat(F.col("component"), F.lit(": not exercised: "), F.array_join("missing", ", ")).alias("p"))
    of_class = ill.unionByName(bare).groupBy("class_id").agg(F.collect_set("p").alias("of_class"))
    own = envelope_violations(envelopes.select("envelope_id", "conditions", "material", "conclusion")).groupBy("envelope_id").agg(F.collect_set("problem").alias("own"))
    none = F.array().cast("array<string>")
    joined = envelopes.join(classes, "class_id", "left").join(seen, "class_id", "left").join(of_class, "class_id", "left").join(own, "envelope_id", "left")
    conditions = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("conditions", F.create_map().cast("map<string,string>")))))
    declared = F.to_json(
        F.struct(
            F.col("envelope_id").alias("name"), F.struct(F.col("class_id").alias("name"), F.coalesce("rules", F.array().cast("array<struct<component:string,relation:string,members:array<string>>>")).alias("rules")).alias("configuration_class"),
            conditions.alias("conditions"), F.array_sort(F.coalesce("material", none)).alias("material_conditions"), F.col("conclusion").alias("licensed_conclusion"),
        )
    )
    problems = F.array_sort(F.array_union(F.array_union(F.coalesce("of_class", none), F.coalesce("own", none)), F.when(F.col("rules").isNull(), F.array(F.lit("the class has no rules"))).otherwise(none)))
    rows = joined.select("envelope_id", json_canonical(declared, STRICT).alias("c"), F.coalesce("exercised", F.create_map().cast("map<string,array<string>>")).alias("exercised"), problems.alias("problems"))
    return rows.select("envelope_id", F.col("c.canon").alias("declared"), F.col("c.addr").alias("envelope_address"), "exercised", "problems")


def outside_envelope(declared: Column, exercised: Column, components: Column, members: Column, conditions: Column) -> Column:
    """Sorted array of what keeps a presented run outside a declared envelope (of type DECLARATION); empty if it is inside.

    Components whose rule it doesn't meet, material conditions it doesn't present as declared, ``evidence`` if a member of
    the class wasn't exercised, ``declaration`` if that is ill-formed. What is unknown isn't met.
    """
    none = F.array().cast("array<string>")
    rules = declared["configuration_class"]["rules"]
    at = lambda m, k: F.try_element_at(m, k)
    wrong = F.transform(F.filter(rules, lambda r: ~satisfied(r["relation"], r["members"], at(components, r["component"]), at(members, r["component"]))), lambda r: r["component"])
    unmet = F.filter(declared["material_conditions"], lambda m: ~F.coalesce(at(declared["conditions"], m) == at(conditions, m), F.lit(False)))
    bare = F.exists(rules, lambda r: F.size(F.array_except(r["members"], F.coalesce(at(exercised, r["component"]), none))) != 0)
    sound = (
        (F.size(F.array_except(F.array(*[F.lit(c) for c in COMPONENTS]), F.transform(rules, lambda r: r["component"]))) == 0)
        & F.forall(rules, lambda r: F.size(r["members"]) > 0)
        & (F.trim(declared["licensed_conclusion"]) != "")
        & (F.size(F.array_except(declared["material_conditions"], F.map_keys(declared["conditions"]))) == 0)
    )
    flags = F.array_compact(F.array(F.when(F.coalesce(bare, F.lit(True)), "evidence"), F.when(~F.coalesce(sound, F.lit(False)), "declaration")))
    return F.array_sort(F.array_union(F.array_union(F.coalesce(wrong, none), F.coalesce(unmet, none)), flags))


# --- issuing and verifying ------------------------------------------------------------------------------

#: Optional columns of evidence and of what is presented, null where absent.
_MAY = {"approver": "string", "label": "string", "components": "map<string,string>", "byte": "long", "lexical": "long", "tau": "double", "envelope_id": "string"}
_MAY_PRESENT = {"components": "map<string,string>", "members": "map<string,array<string>>", "conditions": "map<string,string>"}


def _with_all(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def lenient_status(evidence: DataFrame) -> DataFrame:
    """``evidence`` with ``lenient``: the outcome where no failure is success and an absent scan clears, kept beside to compare."""
    passed = F.coalesce(F.col("gate_passed"), F.lit(False)) | (F.coalesce("failed", F.lit(0)) == 0)
    scanned = F.col("n_eval").isNotNull()
    clean = F.when(scanned, (F.coalesce("structural", F.lit(0)) == 0) & (F.col("n_eval") > 0) & (F.coalesce("n_corpus", F.lit(0)) > 0)).otherwise(F.lit(True))
    return evidence.withColumn("lenient", F.when(passed & clean, "APPROVED").otherwise("REFUSED"))


def issue(evidence: DataFrame, secret: bytes, envelopes: DataFrame | None = None) -> DataFrame:
    """(receipt_id, status, reasons, payload, signature, public_key, receipt_address).

    ``evidence``: receipt_id, agent, profile, configuration_address, passed, failed, gate_passed,
    n_eval, n_corpus, structural, scope, issued_at (text; the caller's clock, so that issuing is repeatable), and
    optionally approver, label, components (addresses by name), byte, lexical, tau, envelope_id. The gate must be
    passed by at least one outcome. ``envelopes`` are those of ``declared_envelopes``; a receipt whose envelope is unknown or has
    problems is NOT ISSUED: it has reasons and nothing signed.
    """
    rows = _with_all(evidence, _MAY)
    if envelopes is None:
        envelopes = rows.sparkSession.createDataFrame([], "envelope_id string, declared string, envelope_address string, exercised map<string,array<string>>, problems array<string>")
    rows = rows.join(envelopes, "envelope_id", "left")
    gate = F.coalesce(F.col("gate_passed") & (F.col("passed") + F.col("failed") > 0), F.lit(False))
    outcome = status(gate, F.col("n_eval"), F.col("n_corpus"), F.col("structural"))
    result = integrity(F.col("n_eval"), F.col("n_corpus"), F.col("structural"))
    wide = F.col("envelope_id").isNotNull()
    refused = F.when(wide & F.col("declared").isNull(), F.array(F.lit("unknown envelope"))).when(wide, F.col("problems"))
    reasons = F.array_compact(F.array(F.when(~gate, "the evaluation gate isn't passed"), F.when(result == "CONTAMINATED", F.concat(F.col("structural").cast("string"), F.lit(" structural matches in the corpus"))), F.when(result == "NOT CHECKED", "the evaluation items were not compared with a corpus")))
    profiles = F.create_map(*[F.lit(x) for n in ("strict", "eval", "integral_safe") for x in (n, json.dumps(declaration(n)))])
    envelope = F.when(
        wide,
        F.struct(F.from_json("declared", DECLARATION).alias("declaration"), F.col("envelope_address").alias("address"), F.col("exercised").alias("exercised_members"), F.lit("members of the class under the material conditions; not that members behave alike").alias("licenses")),
    )
    payload = F.to_json(
        F.struct(
            F.lit(VERSION).alias("version"), "agent", "profile", F.try_element_at(profiles, F.col("profile")).alias("profile_declaration"), F.col("configuration_address").alias("configuration"), "components",
            F.struct("passed", "failed", "gate_passed").alias("evaluation"), F.struct("n_eval", "n_corpus", "byte", "structural", "lexical", "tau", result.alias("result")).alias("eval_integrity"),
            "scope", F.struct("issued_at", "approver", "label").alias("release"), outcome.alias("status"), reasons.alias("reasons"), envelope.alias("envelope"),
        ),
        {"ignoreNullFields": "false"},
    )
    stop = F.size(F.coalesce(refused, F.array().cast("array<string>"))) > 0
    told = rows.select("receipt_id", F.when(stop, "NOT ISSUED").otherwise(outcome).alias("status"), F.when(stop, refused).otherwise(reasons).alias("reasons"), signed(F.when(~stop, payload), secret).alias("s"))
    return told.select("receipt_id", "status", "reasons", "s.*")


def verify(receipts: DataFrame, presented: DataFrame, trusted: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(receipt_id, *keep, verdict, permitted, licenses, outside) of every presented configuration, one without a receipt among them.

    ``presented``: receipt_id, configuration_address, and for envelopes components (addresses by name), members (arrays
    by component) and conditions. Only what the payload says counts, and only if its signature holds; with
    ``trusted`` keys the signer must be one of them. An envelope's declaration must have the address beside
    it, and its coverage is checked again.
    """
    said = receipts.filter("payload is not null").select("receipt_id", "payload", "signature", "public_key").distinct()
    said = said.withColumns({
        "__ok": signature_valid("payload", "signature", "public_key"), "__status": F.get_json_object("payload", "$.status"), "__address": F.get_json_object("payload", "$.configuration"),
        "__declared": F.get_json_object("payload", "$.envelope.declaration"), "__recorded": F.get_json_object("payload", "$.envelope.address"), "__seen": F.from_json(F.get_json_object("payload", "$.envelope.exercised_members"), "map<string,array<string>>"),
    })
    said = said.withColumn("__self", F.when(F.col("__declared").isNotNull(), F.coalesce(json_canonical("__declared", STRICT)["addr"] == F.col("__recorded"), F.lit(False))))
    both = _with_all(presented, _MAY_PRESENT).join(said, "receipt_id", "left")
    point = F.col("__declared").isNull()
    outside = outside_envelope(F.from_json("__declared", DECLARATION), F.col("__seen"), F.col("components"), F.col("members"), F.col("conditions"))
    outside = F.when(point, F.array().cast("array<string>")).when(F.col("__self"), outside).otherwise(F.array_union(F.array(F.lit("address")), outside))
    both = both.withColumn("outside", outside)
    known, ok, approved = F.col("payload").isNotNull(), F.coalesce("__ok", F.lit(False)), F.coalesce(F.col("__status") == "APPROVED", F.lit(False))
    anchored = F.coalesce(F.col("public_key").isin(trusted), F.lit(False)) if trusted else F.lit(False)
    match = F.coalesce(F.col("__address") == F.col("configuration_address"), F.lit(False))
    holds = F.when(point, match).otherwise(F.size("outside") == 0)
    # the tail of an address of an envelope tells it from others
    name = F.substring(F.substring_index("__recorded", ":", -1), 1, 12)
    verdict = (
        F.when(~known, "BLOCKED (no receipt)")
        .when(~ok, "BLOCKED (receipt signature invalid)")
        .when(F.lit(bool(trusted)) & ~anchored, "BLOCKED (signer not trusted)")
        .when(~approved, "BLOCKED (receipt was never approved)")
        .when(~holds & point, "BLOCKED (configuration drift)")
        .when(~holds, F.concat(F.lit("OUTSIDE ENVELOPE ("), F.array_join("outside", ", "), F.lit(")")))
        .when(~point, F.concat(F.lit("ADMISSIBLE (inside envelope "), name, F.when(anchored, ")").otherwise(", signer not anchored)")))
        .when(anchored, "VERIFIED")
        .otherwise("VERIFIED (signer not anchored)")
    )
    permitted = known & ok & approved & holds & (anchored if trusted else F.lit(True))
    licenses = F.when(~permitted, "nothing").when(point, "the evaluated configuration").otherwise("a member of the evaluated class under its declared conditions")
    return both.select("receipt_id", *(keep or []), verdict.alias("verdict"), permitted.alias("permitted"), licenses.alias("licenses"), "outside")


#: What a verification can and can't support, whatever its verdict; the last three are never supported by it.
CONCLUSIONS = ("integrity", "authority", "identity", "membership", "evaluation", "execution", "effective model", "equal behaviour")


def conclusions(verified: DataFrame) -> DataFrame:
    """(receipt_id, conclusion, licensed) for each verdict: an envelope licenses membership, never identity; nothing licenses execution."""
    v = F.col("verdict")
    inside = v.startswith("ADMISSIBLE")
    whole = ~v.startswith("BLOCKED (no receipt") & ~v.startswith("BLOCKED (receipt signature")
    says = {"integrity": whole, "authority": F.col("permitted") & ~v.contains("not anchored"), "identity": F.col("permitted") & ~inside, "membership": F.col("permitted") & inside, "evaluation": F.col("permitted") & ~inside}
    each = F.array(*[F.struct(F.lit(c).alias("conclusion"), says.get(c, F.lit(False)).alias("licensed")) for c in CONCLUSIONS])
    return verified.select("receipt_id", F.explode(each).alias("c")).select("receipt_id", "c.*")


def audit_events(verified: DataFrame, presented: DataFrame, action: str, principal: str) -> DataFrame:
    """(receipt_id, configuration_address, action, principal, verdict, allowed) for a log of decisions."""
    return verified.join(presented.select("receipt_id", "configuration_address"), "receipt_id").select(
        "receipt_id", "configuration_address", F.lit(action).alias("action"), F.lit(principal).alias("principal"), "verdict", F.col("permitted").alias("allowed")
    )


# --- files --------------------------------------------------------------------------------------------

SAVED = "receipt_id string, payload string, signature string, public_key string"


def save_receipts(receipts: DataFrame, path: str) -> None:
    """Receipts as JSON lines, the payload as the text that was signed; those not issued are left out."""
    receipts.filter("payload is not null").select(*[c.split()[0] for c in SAVED.split(", ")]).write.mode("errorifexists").json(path)


def load_receipts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAVED).json(path)


def load_or_create_key(path: str) -> bytes:
    """The secret of a key file (32 bytes in hex), made if there is none, for its owner's eyes alone."""
    try:
        fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    except FileExistsError:
        with open(path) as f:
            secret = bytes.fromhex(f.read().strip())
        if len(secret) != 32:
            raise ValueError(f"{path} holds no key of 32 bytes") from None
        return secret
    secret = secrets.token_bytes(32)
    with os.fdopen(fd, "w") as f:
        f.write(secret.hex() + "\n")
    return secret
