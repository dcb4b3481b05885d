"""Problem 6: items into containers of fixed capacity, by bulk-synchronous best fit.

All profiles advance together in rounds; nothing but a few totals of each profile reaches the driver.

1. Documents are range-sorted by size: items of one size are interchangeable, so their order is kept
   as counts by size, and an item is (size, rank in its size). Gaps (the room left in containers)
   are sorted likewise. If no gap holds the smallest item left, as many containers are opened as the
   tokens left fill at least.
2. A gap that holds several of the largest item left offers as many slots, any other one slot.
3. A sweep of every profile from large to small matches sizes with their successors, the smallest slots that
   hold them and that no larger item took: counts of slots go on a stack, items take from the top. A sweep
   sees counts by size, at most twice the capacity of them, however many documents there are.
4. Conflicts are resolved by rank: where the sweep gives n slots of a value to n items of a size, slots and
   items meet by their ranks, each on the cluster.
5. Gaps and counts are updated, written to the shared folder, and the next round begins.

In the end every document learns its rank in its size, in salted parts, and joins its container.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.tokens import VOCABULARY, token_counts
from lodestrand.session import stored

#: Items or slots of one size ranked in one task at most.
RANKED_ROWS = 500_000
#: Units of a run spelled out from one row.
UNITS = 1 << 16


def profiles_of(limits: DataFrame, profile: str = "profile", capacity: str = "capacity_tokens") -> list[tuple[str, int]]:
    """Distinct profiles with a positive capacity, the least of each; others get no containers."""
    rows = limits.filter(F.col(profile).isNotNull() & (F.col(capacity) > 0)).groupBy(profile).agg(F.min(capacity)).collect()
    return sorted((r[0], int(r[1])) for r in rows)


def ranked(rows: DataFrame, group: list[str], ids: list[str], out: str, most: int, total: int | None = None) -> DataFrame:
    """``rows`` with their rank (from 1) in their group, by hash of ``ids``.

    A group of more than ``most`` rows is ranked in parts, ranges of the hash, so that the rank is the same in
    however many parts. With a ``total`` of all rows that is no more, none is cut.
    """
    rows = rows.withColumn("__h", F.xxhash64(*ids))
    if total is not None and total <= most:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy("__h", *ids)).cast("long")).drop("__h")
    parts = rows.groupBy(*group).agg(F.ceil(F.count("*") / most).cast("int").alias("__parts")).filter("__parts > 1")
    # the hash's place among all signed longs, by its upper half
    upper = F.shiftright("__h", 32) + F.lit(1 << 31)
    rows = rows.join(parts, group, "left").withColumn("__part", F.coalesce(F.floor(upper * F.col("__parts") / F.lit(1 << 32)).cast("int"), F.lit(0)))
    counts = rows.groupBy(*group, "__part").agg(F.count("*").alias("__k"))
    before = counts.withColumn("__before", F.sum("__k").over(Window.partitionBy(*group).orderBy("__part")) - F.col("__k")).drop("__k").filter("__before > 0")
    own = F.row_number().over(Window.partitionBy(*group, "__part").orderBy("__h", *ids)).cast("long")
    numbered = rows.withColumn("__own", own).join(before, [*group, "__part"], "left")
    return numbered.withColumn(out, F.col("__own") + F.coalesce("__before", F.lit(0))).drop("__own", "__before", "__part", "__parts", "__h")


_SWEEP = "p int, kind string, slot long, r long, v long, k long, n long"


def _sweep(counts: pd.DataFrame) -> pd.DataFrame:
    """One profile's sweep: rows ``match`` (slots r+1..r+n of value ``slot`` go to items k+1..k+n of size v) and ``left`` (n items of size v, k before them placed)."""
    stack: list[list[int]] = []
    out: list[tuple] = []
    p = int(counts["p"].iloc[0])
    for v, n, used, ns in sorted(zip(counts["v"].tolist(), counts["n"].tolist(), counts["used"].tolist(), counts["ns"].tolist()), reverse=True):
        if ns:
            stack.append([v, ns])
        while n and stack:
            top = stack[-1]
            take = min(n, top[1])
            top[1] -= take
            out.append((p, "match", top[0], top[1], v, used, take))
            n, used = n - take, used + take
            if not top[1]:
                stack.pop()
        if n:
            out.append((p, "left", 0, 0, v, used, n))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _SWEEP.split(", ")])


def swept(left: DataFrame, slots: DataFrame) -> DataFrame:
    """The sweeps of all profiles. ``left``: p, v, n, used; ``slots``: p, v, ns."""
    both = left.join(slots, ["p", "v"], "full_outer").na.fill(0, ["n", "used", "ns"])
    return both.groupBy("p").applyInPandas(_sweep, _SWEEP)


def slots_of(gaps: DataFrame, state: DataFrame) -> DataFrame:
    """(p, container, slot, v): what each container offers. ``state``: p, largest, smallest, left, n_gaps.

    A gap is cut into as many slots as it holds items of the largest size, but not into many more than there are items for.
    """
    fits = gaps.join(state, "p").filter("gap >= smallest")
    most = F.expr("2 * ceil(left / n_gaps)")
    many = fits.withColumn("m", F.greatest(F.lit(1), F.least(F.expr("gap div largest"), most)).cast("int"))
    return many.select("p", "container", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("slot"), F.expr("gap div m").alias("v"))


def units(matches: DataFrame) -> DataFrame:
    """(p, slot, r, v, k): every slot of the matches, by value and rank, with the item it gets; long runs are spread before they are spelled out."""
    chunks = matches.select("p", "slot", "r", "v", "k", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {UNITS}"))).alias("c"))
    inside = F.sequence(F.col("c") * UNITS + 1, F.least("n", (F.col("c") + 1) * UNITS))
    each = chunks.repartition("p", "slot", "r", "c").select("p", "slot", "r", "v", "k", F.explode(inside).alias("i"))
    return each.select("p", "slot", (F.col("r") + F.col("i")).alias("r"), "v", (F.col("k") + F.col("i")).alias("k"))


def best_fit(items: DataFrame, capacities: list[int], most: int = RANKED_ROWS) -> DataFrame:
    """(p, v, k, container): where the k-th item (from 1) of size v > 0 goes. ``items``: p (place in ``capacities``), v, n."""
    spark = items.sparkSession
    left = stored(items.select("p", "v", "n", F.lit(0).cast("long").alias("used")), "sizes")
    gaps = spark.createDataFrame([], "p int, container long, gap long")
    opened = [0] * len(capacities)
    placed: list[DataFrame] = []
    while True:
        totals = left.groupBy("p").agg(F.max("v").alias("largest"), F.min("v").alias("smallest"), F.sum("n").alias("left"), F.sum(F.col("n") * F.col("v")).alias("tokens"))
        fit = gaps.join(totals.select("p", "smallest"), "p").filter("gap >= smallest").groupBy("p").agg(F.count("*").alias("n_gaps"))
        state = totals.join(fit, "p", "left").collect()
        if not state:
            break
        rows = []
        for r in state:
            p, n_gaps = r["p"], r["n_gaps"]
            if not n_gaps:
                n_gaps = -(-r["tokens"] // capacities[p])
                gaps = gaps.unionByName(spark.range(opened[p], opened[p] + n_gaps).select(F.lit(p).alias("p"), F.col("id").alias("container"), F.lit(capacities[p]).cast("long").alias("gap")))
                opened[p] += n_gaps
            rows.append((p, r["largest"], r["smallest"], r["left"], n_gaps))
        slots = slots_of(gaps, spark.createDataFrame(rows, "p int, largest long, smallest long, left long, n_gaps long"))
        sweep = stored(swept(left, slots.groupBy("p", "v").agg(F.count("*").alias("ns"))), "sweep")
        numbered = ranked(slots.withColumnRenamed("v", "at"), ["p", "at"], ["container", "slot"], "r", most, sum(2 * r[3] + r[4] for r in rows)).select("p", F.col("at").alias("slot"), "r", "container")
        pairs = stored(numbered.join(units(sweep.filter("kind = 'match'")), ["p", "slot", "r"]).select("p", "v", "k", "container"), "placed")
        placed.append(pairs)
        filled = pairs.groupBy("p", "container").agg(F.sum("v").alias("__t"))
        # full containers have nothing to offer any more
        gaps = stored(gaps.join(filled, ["p", "container"], "left").select("p", "container", (F.col("gap") - F.coalesce("__t", F.lit(0))).alias("gap")).filter("gap > 0"), "gaps")
        left = sweep.filter("kind = 'left'").select("p", "v", "n", F.col("k").alias("used"))
    out = spark.createDataFrame([], "p int, v long, k long, container long")
    for pairs in placed:
        out = out.unionByName(pairs)
    return out


def pack(documents: DataFrame, limits: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """(profile, container, doc_id, piece_no, first_token, n_tokens) for every document and profile.

    A document of more tokens than the capacity fills containers of its own, named
    ``d<doc_id>.<piece>``, and its rest is packed as an item; no other is split. Null and blank
    texts are items of 0 tokens in the first container. An empty table gives no row.
    """
    spark = documents.sparkSession
    profiles = profiles_of(limits)
    sizes = stored(token_counts(documents, [doc_id], text, vocabulary).withColumnRenamed(doc_id, "doc_id"), "tokens")
    columns = "profile string, container string, doc_id {}, piece_no long, first_token long, n_tokens long".format(sizes.schema["doc_id"].dataType.simpleString())
    if not profiles:
        return spark.createDataFrame([], columns)
    choices = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(c).cast("long").alias("cap")) for i, (_, c) in enumerate(profiles)])
    items = sizes.select("doc_id", F.col("n_tokens").alias("n"), F.explode(choices).alias("c")).select("doc_id", "n", "c.p", "c.cap")
    items = items.withColumns({"full": F.expr("CASE WHEN n > cap THEN n DIV cap ELSE 0L END"), "v": F.expr("CASE WHEN n > cap THEN n % cap ELSE n END")})

    counts = items.filter("v > 0").groupBy("p", "v").agg(F.count("*").alias("n"))
    places = best_fit(counts, [c for _, c in profiles], ranked_rows)
    numbered = ranked(items.filter("v > 0").drop("n"), ["p", "v"], ["doc_id", "full"], "k", ranked_rows).join(places, ["p", "v", "k"])
    # texts without tokens need no room
    empty = items.filter("full = 0 and v = 0").select("p", "doc_id", "full", "cap", "v", F.lit(0).cast("long").alias("container"))
    placed = numbered.select("p", "doc_id", "full", "cap", "v", "container").unionByName(empty)
    name = F.element_at(F.array(*[F.lit(n) for n, _ in profiles]), F.col("p") + 1).alias("profile")
    packed = placed.select(name, F.concat(F.lit("c"), F.col("container").cast("string")).alias("container"), "doc_id", F.col("full").alias("piece_no"), (F.col("full") * F.col("cap")).alias("first_token"), F.col("v").alias("n_tokens"))
    whole = items.filter("full > 0").select("p", "doc_id", "cap", F.explode(F.expr("sequence(0L, full - 1)")).alias("k"))
    filled = whole.select(
        name, F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("."), F.col("k").cast("string")).alias("container"), "doc_id", F.col("k").alias("piece_no"), (F.col("k") * F.col("cap")).alias("first_token"), F.col("cap").alias("n_tokens")
    )
    return packed.unionByName(filled)


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(profile, n_containers, n_tokens, unused_share) of a packing."""
    per = packed.groupBy("profile", "container").agg(F.sum("n_tokens").alias("t")).groupBy("profile").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"))
    caps = limits.groupBy("profile").agg(F.min("capacity_tokens").alias("cap"))
    return per.join(caps, "profile").select("profile", "n_containers", "n_tokens", (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("cap"))).alias("unused_share"))
