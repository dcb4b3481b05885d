"""Problem 5: schemas that drift between versions, by similarity flooding.

Every version of a package has a schema graph: member paths of its tools, at any depth, with key,
JSON type and nesting. Names of parameters (members of ``properties``) are data, not schema, and stand as
``*``, items of lists as ``[]``. Where paths vanish and others appear between consecutive versions,
match scores of (old path, new path) start from how often both carry the same value and from key
likeness, and are propagated along nesting and type edges until they settle (after Melnik, Garcia-Molina
and Rahm, ICDE 2002). Of the settled scores those over a threshold are selected one to one, the best
first. Chained from the first spelling of a field, the correspondences tell which key carries it
in each version; values are then cast and united into one table, and every change is listed.

A first pass over the captures takes each version's paths and types; a second one reads the values
of vanished and new paths, of versions that have both. All is joined and counted by Spark; the flooding
itself sees one version pair's vanished and new paths, whose number is that of schema members, never that
of rows or tools.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.nested import tools_of, usable
from lodestrand.operators.segmented import cut_hot_keys, previous
from lodestrand.session import spread, stored

FIELDS = ("title", "execution.taskSupport", "outputSchema.type", "annotations.readOnlyHint")

#: Share of a score that comes from its neighbours in the graph, and the settled score from which a pair corresponds.
FLOW = 0.3
LEAST_SCORE = 0.55
#: Share of the evidence that key likeness may add to; values alone give the rest.
LIKENESS = 0.2
#: Share of versions (of packages) in which a path stands beside a field's own spelling and so is another member.
MOST_TOGETHER = 0.3

TYPES = ("null", "boolean", "number", "string", "array", "object")
_TYPES = {bool: 1, int: 2, float: 2, str: 3, list: 4, dict: 5}
#: A path of a version: hash of the path, place in TYPES, number of tools.
MEMBER = "struct<h: bigint, t: int, n: bigint>"


def path_hash(path: str) -> int:
    return xxhash.xxh64(path.encode("utf-8", "surrogatepass"), seed=42).intdigest() - (1 << 63)


def core_text(value: object) -> str | None:
    """The value in one spelling whatever its JSON type: a single member is unwrapped, true, "true" and 1 are alike.

    Null for what holds further objects or lists: its members stand for it.
    """
    while isinstance(value, (list, dict)) and len(value) == 1:
        value = value[0] if isinstance(value, list) else next(iter(value.values()))
    if isinstance(value, str):
        plain = value.strip()
        return plain.lower() if plain.lower() in ("true", "false") else plain
    if isinstance(value, (bool, int, float)) and value in (0, 1):
        return "true" if value else "false"
    if isinstance(value, list):
        if len(value) == 2 and "null" in value and all(isinstance(x, str) for x in value):
            return next((x for x in value if x != "null"), "null")
        if any(isinstance(x, (list, dict)) for x in value):
            return None
    elif isinstance(value, dict) and any(isinstance(x, (list, dict)) for x in value.values()):
        return None
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


class Place:
    """A path in the tree of all paths met; so a path is spelled and hashed once, not once a tool."""

    __slots__ = ("path", "hash", "named", "below")

    def __init__(self, path: str = "", named: bool = False) -> None:
        self.path, self.hash, self.named = path, path_hash(path), named
        self.below: dict[str, Place] = {}

    def at(self, key: str) -> Place:
        """The place of a member; of a ``properties`` any one is ``*``."""
        key = "*" if self.named else key
        place = self.below.get(key)
        if place is None:
            place = self.below[key] = Place(f"{self.path}.{key}" if self.path else key, key == "properties" and not self.named)
        return place

    def items(self) -> Place:
        place = self.below.get("[]")
        if place is None:
            place = self.below["[]"] = Place(f"{self.path}[]")
        return place


def walk(tool: dict, root: Place) -> Iterator[tuple[Place, object]]:
    """(place, value) of the tool's members that aren't null, at any depth."""
    stack: list[tuple[Place, object]] = [(root, tool)]
    while stack:
        place, node = stack.pop()
        if type(node) is list:
            inner = place.items()
            stack.extend((inner, x) for x in node if type(x) is dict or type(x) is list)
            continue
        for key, value in node.items():
            if value is not None:
                child = place.at(key)
                yield child, value
                if type(value) is dict or type(value) is list:
                    stack.append((child, value))


def _kinds(tool: dict, root: Place) -> set[tuple[Place, type]]:
    """``walk`` without the values: each place with the kinds of value it has in the tool."""
    seen: set[tuple[Place, type]] = set()
    stack: list[tuple[Place, object]] = [(root, tool)]
    while stack:
        place, node = stack.pop()
        if type(node) is list:
            inner = place.items()
            stack.extend([(inner, x) for x in node if type(x) is dict or type(x) is list])
            continue
        below, named = place.below, place.named
        for key, value in node.items():
            if value is not None:
                child = below.get("*" if named else key) or place.at(key)
                kind = type(value)
                seen.add((child, kind))
                if kind is dict or kind is list:
                    stack.append((child, value))
    return seen


def members(tool: dict, wanted: set[int] | None = None, root: Place | None = None) -> dict[str, str | None]:
    """Values of the tool's paths (with a hash in ``wanted``); null where a path with ``*`` or ``[]`` has several."""
    out: dict[str, str | None] = {}
    for place, value in walk(tool, root or Place()):
        if wanted is None or place.hash in wanted:
            text = core_text(value)
            out[place.path] = text if out.get(place.path, text) == text else None
    return out


def _tool_names(text: str) -> list[tuple[str, dict]]:
    """(name, tool) of a listing; null for one that can't be read."""
    return [(t["name"] if isinstance(t.get("name"), str) else f"#{no}", t) for no, t in enumerate(tools_of(text)) if isinstance(t, dict)]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(package, version, paths) of each capture; a path of several types has that of the most tools."""
    root = Place()
    names = ("h", "t", "n")
    for batch in batches:
        heads: list[tuple] = []
        flat: tuple[list, list, list] = ([], [], [])
        offsets = [0]
        for package, version, text in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                tools = _tool_names(text)
            except (ValueError, RecursionError):
                continue
            counts: Counter = Counter()
            for _, tool in tools:
                counts.update(_kinds(tool, root))
            best: dict[int, tuple[int, int]] = {}
            for (place, kind), n in counts.items():
                best[place.hash] = max(best.get(place.hash, (0, 0)), (n, _TYPES.get(kind, 0)))
            heads.append((package, version))
            for h in sorted(best):
                n, t = best[h]
                flat[0].append(h), flat[1].append(t), flat[2].append(n)
            offsets.append(len(flat[0]))
        package, version = zip(*heads) if heads else ((), ())
        kinds = (pa.int64(), pa.int32(), pa.int64())
        entries = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds)], fields=[pa.field(c, k) for c, k in zip(names, kinds)])
        yield pa.RecordBatch.from_arrays([pa.array(package, pa.string()), pa.array(version, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)], ["package", "version", "paths"])


def listings(captures: DataFrame) -> DataFrame:
    return usable(captures).filter("package is not null and version is not null").select("package", "version", "tools")


def version_paths(captures: DataFrame) -> DataFrame:
    """(package, version, paths) of every usable version, paths ascending by hash.

    Captures without package or version, or that aren't JSON, give no row. Captures of one version
    that show the same paths fold before the shuffle; of others, rare as they are, the paths are united by path.
    """
    each = spread(listings(captures)).mapInArrow(_shapes, f"package string, version string, paths array<{MEMBER}>").groupBy("package", "version", "paths").agg(F.lit(1).alias("__one"))
    each = stored(each.drop("__one"), "shapes")
    several = each.groupBy("package", "version").agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    if several.isEmpty():
        return each
    alone = each.join(several, ["package", "version"], "left_anti")
    apart = each.join(several, ["package", "version"]).select("package", "version", F.explode_outer("paths").alias("x")).groupBy("package", "version", "x.h").agg(F.max(F.struct("x.n", "x.t")).alias("m"))
    united = apart.groupBy("package", "version").agg(F.array_sort(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("h", F.col("m.t").alias("t"), F.col("m.n").alias("n"))))).alias("paths"))
    return alone.unionByName(united)


def version_order(version: Column) -> Column:
    """Versions compare by their numbers part by part; a part without a number counts as 0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(F.try_to_number(F.regexp_extract(p, r"^(\d{1,18})", 1), F.lit("9" * 18)).cast("bigint"), F.lit(0).cast("bigint")))


def version_position(order: Column) -> Column:
    """A number that never falls as the version rises, for cutting long histories."""
    part = lambda i: F.least(F.coalesce(F.get(order, F.lit(i)), F.lit(0).cast("bigint")), F.lit(999_999).cast("bigint")).cast("double")
    first = F.coalesce(F.get(order, F.lit(0)), F.lit(0).cast("bigint")).cast("double")
    return first * 1e6 + part(1)


def version_pairs(paths: DataFrame, rows_per_chunk: int = 500_000) -> DataFrame:
    """(package, version, before, p, c, gone_h, come_h) of each version but a package's first: the version before it, the paths of both, hashes of vanished and new ones.

    Spellings of one version order by text.
    """
    every = paths.withColumn("__order", F.struct(version_order(F.col("version")).alias("o"), F.col("version").alias("v")))
    every, seg = cut_hot_keys(every, "package", "__order", version_position(F.col("__order.o")), rows_per_chunk)
    every = previous(every.withColumn("__own", F.struct("version", "paths")), seg, "__own", "__was", ignore_nulls=False)
    return every.filter("__was is not null").select("package", "version", F.col("__was.version").alias("before"), F.col("__was.paths").alias("p"), F.col("paths").alias("c"), F.array_except("__was.paths.h", "paths.h").alias("gone_h"), F.array_except("paths.h", "__was.paths.h").alias("come_h"))


# --- similarity flooding over one pair of versions -------------------------------------------------


def _trigrams(key: str) -> set[str]:
    text = f"  {''.join(c for c in key.lower() if c.isalnum())} "
    return {text[i : i + 3] for i in range(len(text) - 2)}


def key_likeness(a: str, b: str) -> float:
    """Dice coefficient of the trigrams of the last keys, letter case and punctuation aside."""
    x, y = _trigrams(a.rpartition(".")[2]), _trigrams(b.rpartition(".")[2])
    return 2 * len(x & y) / (len(x) + len(y))


def _above(path: str) -> str:
    return path[:-2] if path.endswith("[]") else path.rpartition(".")[0]


def flood(pairs: list[dict], epsilon: float = 1e-6, rounds: int = 1_000) -> dict[tuple[str, str], float]:
    """Settled scores, 0 to 1, of (old path, new path). ``pairs``: old, new, old_type, new_type, agree (0..1).

    The pairwise connectivity graph has a node per path pair, per pair of their parents and of
    theirs in turn, and per pair of types; edges join a node with its parents' (nesting) and its
    types' pair. Each round a node keeps 1 - FLOW of its initial score and takes FLOW of the mean
    over the kinds of edges of its neighbours' mean score, a contraction, so that scores converge.
    """
    start: dict[tuple, float] = {}
    edges: dict[tuple, dict[str, list[tuple]]] = {}

    def link(x: tuple, y: tuple, kind: str) -> None:
        for a, b, k in ((x, y, kind), (y, x, f"{kind} of")):
            if b not in (known := edges.setdefault(a, {}).setdefault(k, [])):
                known.append(b)

    for p in pairs:
        node = ("path", p["old"], p["new"])
        start[node] = p["agree"] * (1 - LIKENESS + LIKENESS * key_likeness(p["old"], p["new"]))
        kinds = ("type", p["old_type"], p["new_type"])
        start[kinds] = 1.0 if kinds[1] == kinds[2] else 0.2
        link(node, kinds, "type")
    for p in pairs:
        below, old, new = ("path", p["old"], p["new"]), _above(p["old"]), _above(p["new"])
        while True:
            up = ("path", old, new)
            start.setdefault(up, 1.0 if old == new else 0.5 * key_likeness(old, new) if old and new else 0.0)
            link(below, up, "member")
            if not (old and new):
                break
            below, old, new = up, _above(old), _above(new)
    score = dict(start)
    for _ in range(rounds):
        moved = {n: (1 - FLOW) * start[n] + FLOW * sum(sum(score[m] for m in ms) / len(ms) for ms in edges[n].values()) / len(edges[n]) for n in score}
        change = max((abs(moved[n] - score[n]) for n in score), default=0.0)
        score = moved
        if change < epsilon:
            break
    return {(p["old"], p["new"]): score["path", p["old"], p["new"]] for p in pairs}


def select_matches(pairs: list[dict], least: float = LEAST_SCORE) -> list[dict]:
    """A consistent one-to-one selection of pairs with a settled score of ``least`` or more, the best first: no two
    paths that are left would both score better with each other than with what they got."""
    scores = flood(pairs)
    old, new, kept = set(), set(), []
    for (a, b), score in sorted(scores.items(), key=lambda s: (-round(s[1], 6), s[0])):
        if score >= least and a not in old and b not in new:
            old.add(a)
            new.add(b)
            kept.append({"old": a, "new": b, "score": score})
    return kept


# --- correspondences, aliases and changes -------------------------------------------------------------

_LINK = "package string, pair string, old string, new string, score double, sure boolean"


def _candidates(facts: list[dict], types: dict[int, str]) -> tuple[list[dict], list[dict]]:
    """Candidates of one pair of versions with their agreement: those that tools support, and others by values alone."""
    n = {(f["kind"], f["old"], f["new"]): f["n"] for f in facts}

    def pair(old: str, new: str, agree: float) -> dict:
        return {"old": old, "new": new, "old_type": types[path_hash(old)], "new_type": types[path_hash(new)], "agree": agree}

    by_tool = [pair(old, new, 2 * k / (n["held", old, None] + n["held", None, new])) for (kind, old, new), k in n.items() if kind == "hit"]
    by_value = [pair(old, new, k / n["seen", None, new]) for (kind, old, new), k in n.items() if kind == "value" and ("both", old, new) not in n]
    return by_tool, by_value


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for package, pair, facts, gone, come in zip(*(c.to_pylist() for c in batch.columns)):
            by_tool, by_value = _candidates(facts, {x["h"]: TYPES[x["t"]] for x in gone + come})
            sure = select_matches(by_tool)
            taken = {m["old"] for m in sure}, {m["new"] for m in sure}
            others = select_matches([f for f in by_value if f["old"] not in taken[0] and f["new"] not in taken[1]])
            out += [(package, pair, m["old"], m["new"], m["score"], at) for at, ms in ((True, sure), (False, others)) for m in ms]
        columns = list(zip(*out)) or [()] * 6
        kinds = [pa.string()] * 4 + [pa.float64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _LINK.split(", ")])


_PICKED = "package string, version string, tool string, members array<struct<path string, value string, h bigint>>"


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members with a wanted hash of each tool, ascending by path."""
    root = Place()
    fields = [pa.field("path", pa.string()), pa.field("value", pa.string()), pa.field("h", pa.int64())]
    for batch in batches:
        heads: list[tuple] = []
        flat: tuple[list, list, list] = ([], [], [])
        offsets = [0]
        for package, version, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                tools = _tool_names(text)
            except (ValueError, RecursionError):
                continue
            wanted = set(wanted)
            for name, tool in tools:
                found = members(tool, wanted, root)
                heads.append((package, version, name))
                for path in sorted(found):
                    flat[0].append(path), flat[1].append(found[path]), flat[2].append(path_hash(path))
                offsets.append(len(flat[0]))
        columns = zip(*heads) if heads else [()] * 3
        entries = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, fields)], fields=fields)
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)], ["package", "version", "tool", "members"])


def picked_members(captures: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """(package, version, tool, members) of the captures that ``wanted`` (*on, hashes) names: the second pass over their text."""
    return spread(listings(captures).join(wanted, on).select("package", "version", "tools", "hashes")).mapInArrow(_picked, _PICKED)


def correspondences(captures: DataFrame, pairs: DataFrame) -> DataFrame:
    """(package, pair, old, new, score, sure): paths under which the previous version's values go on.

    Where tools of both versions have the two paths, agreement is counted tool by tool. Where no
    tool has both, values alone say little: such a link counts only if tools of another pair of
    versions, of any package, confirm the same two paths. Counts are folded before every
    shuffle; a tool's members, never a version's, meet in one row.
    """
    key = ["package", "pair"]
    hashes = pairs.filter("size(gone_h) > 0 and size(come_h) > 0")
    part = lambda side, h: F.expr(f"filter({side}, x -> array_contains({h}, x.h))")
    moved = stored(hashes.select("package", F.col("version").alias("pair"), "before", part("p", "gone_h").alias("gone"), part("c", "come_h").alias("come")), "moved")
    ends = F.array(F.struct(F.col("before").alias("version"), F.lit("prev").alias("side"), F.col("gone.h").alias("hashes")), F.struct(F.col("pair").alias("version"), F.lit("cur").alias("side"), F.col("come.h").alias("hashes")))
    sides = moved.select("package", "pair", F.explode(ends).alias("e")).select("package", "pair", "e.*")
    wanted = sides.groupBy("package", "version").agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes"))
    tools = picked_members(captures, wanted, ["package", "version"])
    told = tools.join(sides, ["package", "version"]).select(*key, "tool", "side", F.expr("filter(members, m -> m.value is not null and array_contains(hashes, m.h))").alias("m"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("m")))
    both = told.groupBy(*key, "tool").agg(side("prev").alias("was"), side("cur").alias("now")).filter("coalesce(size(was), 0) + coalesce(size(now), 0) > 0")

    # facts on old and new paths: tools that have both or either, with the same value in both; values whatever the tool
    fact = lambda kind, old, new, value="null": f"named_struct('kind', '{kind}', 'old', {old}, 'new', {new}, 'value', {value})"
    here, text = "was is not null and now is not null", "cast(null AS string)"
    facts = F.expr(f"""concat(
        if({here}, flatten(transform(was, a -> transform(now, b -> {fact("both", "a.path", "b.path", text)}))), array()),
        if({here}, flatten(transform(was, a -> transform(filter(now, b -> b.value = a.value), b -> {fact("hit", "a.path", "b.path", text)}))), array()),
        if({here}, transform(was, a -> {fact("held", "a.path", text, text)}), array()), if({here}, transform(now, b -> {fact("held", text, "b.path", text)}), array()),
        transform(coalesce(was, array()), a -> {fact("told", "a.path", text, "a.value")}), transform(coalesce(now, array()), b -> {fact("told", text, "b.path", "b.value")}),
        transform(coalesce(now, array()), b -> {fact("seen", text, "b.path", text)}))""")
    counted = stored(both.select(*key, F.explode(facts).alias("x")).groupBy(*key, "x").agg(F.count("*").alias("n")).select(*key, "x.*", "n"), "facts")
    told = counted.filter("kind = 'told'")
    values = told.filter("new is null").select(*key, "value", "old").join(told.filter("old is null").select(*key, "value", "new", "n"), [*key, "value"])
    values = values.groupBy(*key, "old", "new").agg(F.sum("n").alias("n")).withColumn("kind", F.lit("value"))
    named = counted.filter("kind != 'told'").select(*key, "kind", "old", "new", "n").unionByName(values)
    per = named.groupBy(*key).agg(F.collect_list(F.struct("kind", "old", "new", "n")).alias("facts")).join(moved, key)
    links = stored(per.select(*key, "facts", "gone", "come").mapInArrow(_linked, _LINK), "links")
    confirmed = links.filter("sure").select("old", "new", F.lit(True).alias("__told")).distinct()
    return links.join(confirmed, ["old", "new"], "left").filter("sure or __told").select("package", "pair", "old", "new", "score", "sure")


def aliases(paths: DataFrame, links: DataFrame, fields: tuple[str, ...] = FIELDS, most_together: float = MOST_TOGETHER) -> DataFrame:
    """(package, path, field): other keys that carry a field in a package, by links chained from its own spelling.

    A path that stands beside the field's own spelling in more than ``most_together`` of the package's versions
    that have it is another member. So is one that does so in that share of all packages that have it,
    unless tools confirmed the link in this package.
    """
    edges = links.groupBy("package", "old", "new").agg(F.bool_or("sure").alias("sure"))
    hashed = F.arrow_udf(lambda a: pa.array([path_hash(x) for x in a.to_pylist()], pa.int64()), "bigint")
    wanted = stored(edges.select(F.col("new"), hashed("new").alias("h")).distinct(), "wanted")
    flags = paths.select("package", "version", "paths.h", *[F.array_contains("paths.h", F.lit(path_hash(f)).cast("bigint")).alias(f"f{i}") for i, f in enumerate(fields)])
    have = flags.select("package", F.explode("h").alias("h"), *[f"f{i}" for i in range(len(fields))])
    within = have.join(wanted, "h").groupBy("package", "new").agg(*[F.avg(F.col(f"f{i}").cast("double")).alias(f"s{i}") for i in range(len(fields))])
    across = within.groupBy("new").agg(*[F.avg((F.col(f"s{i}") > most_together).cast("double")).alias(f"a{i}") for i in range(len(fields))])
    barred = [F.when((F.col(f"s{i}") > most_together) | (~F.col("sure") & (F.col(f"a{i}") > most_together)), F.lit(f)) for i, f in enumerate(fields)]
    steps = edges.join(within, ["package", "new"]).join(across, "new").select("package", "old", "new", F.array_compact(F.array(*barred)).alias("not_of"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every field's known keys followed along the links, until nothing new is reached."""
        for batch in batches:
            out = []
            for package, found in zip(*(c.to_pylist() for c in batch.columns)):
                onward: dict[str, list[dict]] = {}
                for e in found:
                    onward.setdefault(e["old"], []).append(e)
                for field in fields:
                    at, todo = {field}, [field]
                    while todo:
                        for e in onward.get(todo.pop(), []):
                            if e["new"] not in at and e["new"] not in fields and field not in e["not_of"]:
                                at.add(e["new"])
                                todo.append(e["new"])
                    out += [(package, path, field) for path in sorted(at - {field})]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["package", "path", "field"])

    # a package's distinct links: pairs of schema members, however many rows or versions there are
    per = steps.groupBy("package").agg(F.collect_list(F.struct("old", "new", "not_of")).alias("found"))
    return per.mapInArrow(chained, "package string, path string, field string")


def field_keys(others: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(package, keys, hashes): the keys that carry fields in a package, beside their own spellings."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("h", pa.int64()), ("path", pa.string()), ("field", pa.string())]))
        for batch in batches:
            keys = [[{"h": path_hash(k["path"]), **k} for k in found] for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(keys, kind)], ["package", "keys"])

    per = others.groupBy("package").agg(F.collect_set(F.struct("path", "field")).alias("found"))
    return per.mapInArrow(gathered, "package string, keys array<struct<h bigint, path string, field string>>")


def field_changes(pairs: DataFrame, others: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(package, version, field, kind) against the previous version; a field can be renamed and retyped at once.

    Should a version hold a field under several keys or types, its own spelling counts, then the most tools.
    """
    own = F.array(*[F.struct(F.lit(path_hash(f)).cast("bigint").alias("h"), F.lit(f).alias("path"), F.lit(f).alias("field")) for f in fields])
    rows = pairs.join(field_keys(others, fields), "package", "left").withColumn("keys", F.concat(own, F.coalesce("keys", F.array().cast("array<struct<h bigint, path string, field string>>"))))
    found = lambda side: f"element_at({side}, cast(array_position({side}.h, k.h) AS int))"
    hold = lambda side: f"array_max(transform(filter(keys, k -> k.field = f and array_contains({side}.h, k.h)), k -> named_struct('own', k.path = f, 'n', {found(side)}.n, 'path', k.path, 'type', {found(side)}.t)))"
    held = F.expr(f"transform(array({', '.join(repr(f) for f in fields)}), f -> named_struct('field', f, 'p', {hold('p')}, 'c', {hold('c')}))")
    both = rows.select("package", "version", F.explode(held).alias("x")).select("package", "version", "x.*").filter("p is not null or c is not null")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("p").isNull(), "added"),
            F.when(F.col("c").isNull(), "removed"),
            F.when(F.col("p.path") != F.col("c.path"), "renamed"),
            F.when(F.col("p.type") != F.col("c.type"), "retyped"),
        )
    )
    return both.select("package", "version", "field", F.explode(kinds).alias("kind"))


def resolved(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbouring versions with their paths, and aliases, each written once, as later steps read them again."""
    paths = version_paths(captures)
    pairs = stored(version_pairs(paths), "pairs")
    return pairs, stored(aliases(paths, correspondences(captures, pairs)), "aliases")


def schema_changes(captures: DataFrame) -> DataFrame:
    """(package, version, field, kind) for captures; see TESTDATA problem 5. An empty table gives no row."""
    pairs, others = resolved(captures)
    return field_changes(pairs, others)


def consistent_tools(captures: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per (package, version, tool) with each field under one name, its values as text in one spelling."""
    _, others = resolved(captures)
    own = F.array(*[F.lit(path_hash(f)).cast("bigint") for f in fields])
    packages = listings(captures).select("package").distinct().join(field_keys(others, fields), "package", "left")
    wanted = stored(packages.select("package", "keys", F.array_distinct(F.concat(own, F.coalesce("keys.h", F.array().cast("array<bigint>")))).alias("hashes")), "keys")
    rows = picked_members(captures, wanted.drop("keys"), ["package"]).join(wanted.drop("hashes"), "package")
    value = lambda f: F.expr(f"array_min(transform(filter(members, m -> m.path = '{f}' or exists(keys, k -> k.path = m.path and k.field = '{f}')), m -> m.value))")
    named = rows.select("package", "version", "tool", *[value(f).alias(f.replace(".", "_")) for f in fields])
    return named.groupBy("package", "version", "tool").agg(*[F.min(f.replace(".", "_")).alias(f.replace(".", "_")) for f in fields])
