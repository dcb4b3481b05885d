"""Problem 7: documents drawn so that each source has its share of tokens, by hash-threshold histograms.

A document's place in its source is a hash of its id. Tokens are summed by source and hash bucket;
the bucket in which a source's budget ends is found and it alone is refined, level by level, until
the threshold is exact. Documents under the threshold are drawn once more than the source's whole
passes. Nothing is sorted, and a larger budget only adds documents: budgets are nested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.sources import source_name
from lodestrand.llm.tokens import VOCABULARY, token_counts
from lodestrand.session import stored

BITS, LEVELS = 12, 5
#: Sources with a target at most; it bounds the histograms that are gathered: this many times 2^12 sums.
MOST_TARGETS = 1_000


@dataclass
class Target:
    source: str
    share: float
    repeats: int


def targets_of(targets: DataFrame) -> list[Target]:
    """One target per source: shares of its rows add up, the least number of repeats holds (null: 1)."""
    rows = targets.select(source_name(F.col("source")).alias("s"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("r"))
    found = rows.groupBy("s").agg(F.sum("share"), F.min("r")).limit(MOST_TARGETS + 1).collect()
    if len(found) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return sorted((Target(r[0], max(0.0, float(r[1])), max(0, int(r[2]))) for r in found), key=lambda t: t.source)


def place(doc_id: Column, seed: int) -> Column:
    """A document's place: 60 bits, never negative."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 4)


def reachable_total(targets: list[Target], supply: dict[str, int]) -> float:
    """The largest total at which every source that has tokens can meet its share."""
    return min((supply[t.source] * t.repeats / t.share for t in targets if t.share > 0 and t.repeats > 0 and supply.get(t.source, 0) > 0), default=0.0)


def _histogram(sized: DataFrame, prefixes: dict[str, int] | None, level: int) -> dict[str, dict[int, tuple[int, int]]]:
    """Tokens and documents by source and bucket of this level, of each source's boundary bucket alone."""
    down = BITS * (LEVELS - level - 1)
    rows = sized
    if prefixes is not None:
        spark = sized.sparkSession
        edge = F.broadcast(spark.createDataFrame(list(prefixes.items()), "source string, edge long"))
        rows = rows.join(edge, "source").filter(F.shiftright("place", down + BITS) == F.col("edge"))
    bucket = F.shiftright("place", down).bitwiseAND(F.lit((1 << BITS) - 1)).alias("bucket")
    out: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows.groupBy("source", bucket).agg(F.sum("n_tokens"), F.count("*")).collect():
        out.setdefault(r[0], {})[r[1]] = (int(r[2]), int(r[3]))
    return out


def thresholds(sized: DataFrame, first: dict[str, dict[int, tuple[int, int]]], budgets: dict[str, float]) -> dict[str, int]:
    """For each source the place below which the tokens come nearest to its budget."""
    done: dict[str, int] = {}
    open_: dict[str, tuple[int, float]] = {s: (0, b) for s, b in budgets.items()}
    histogram = first
    for level in range(LEVELS):
        down = BITS * (LEVELS - level - 1)
        refine: dict[str, tuple[int, float]] = {}
        for source, (prefix, left) in open_.items():
            buckets = histogram.get(source, {})
            for bucket in sorted(buckets):
                tokens, n = buckets[bucket]
                if tokens <= left:
                    left -= tokens
                    continue
                here = (prefix << BITS) | bucket
                if n == 1 or level == LEVELS - 1:
                    done[source] = (here + (tokens - left < left)) << down
                else:
                    refine[source] = (here, left)
                break
            else:
                done[source] = (prefix + 1) << (down + BITS)
        open_ = refine
        if not open_:
            break
        histogram = _histogram(sized, {s: p for s, (p, _) in open_.items()}, level + 1)
    return done


def sized_documents(documents: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, place) of documents with any token, written once."""
    named = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    counts = token_counts(named, ["doc_id", "source"], vocabulary=vocabulary).filter("n_tokens > 0")
    return stored(counts.withColumn("place", place(F.col("doc_id"), seed)), "sized")


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the documents drawn.

    ``total`` tokens are wanted over all sources; by default the largest total at which every
    source that has tokens can meet its share. A source without tokens, or short of its budget at
    ``max_repeats`` times each document, falls short of its share and the others keep their budgets.
    Documents without tokens or without a source in ``targets`` are not drawn.
    """
    sized = sized_documents(documents, seed, vocabulary)
    return draw(sized, targets_of(targets), total)


def draw(sized: DataFrame, wanted: list[Target], total: float | None = None) -> DataFrame:
    spark = sized.sparkSession
    known = F.broadcast(spark.createDataFrame([(t.source,) for t in wanted], "source string"))
    drawn = sized.join(known, "source", "left_semi")
    first = _histogram(drawn, None, 0)
    supply = {s: sum(t for t, _ in b.values()) for s, b in first.items()}
    total = reachable_total(wanted, supply) if total is None else total
    passes: dict[str, int] = {}
    budgets: dict[str, float] = {}
    for t in wanted:
        have, want = supply.get(t.source, 0), t.share * total
        if have and t.repeats and want > 0:
            passes[t.source] = min(t.repeats, int(want / have + 1e-9))
            budgets[t.source] = max(0.0, want - passes[t.source] * have) if passes[t.source] < t.repeats else 0.0
    below = thresholds(drawn, first, budgets)
    rule = F.broadcast(spark.createDataFrame([(s, passes[s], below.get(s, 0)) for s in passes], "source string, passes int, below long"))
    repeats = F.col("passes") + F.when(F.col("place") < F.col("below"), 1).otherwise(0)
    return drawn.join(rule, "source").withColumn("repeats", repeats).filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def share_report(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, target_share, supply_tokens, drawn_tokens, actual_share) of every target."""
    sized, wanted = sized_documents(documents, seed, vocabulary), targets_of(targets)
    spark = sized.sparkSession
    supply = sized.groupBy("source").agg(F.sum("n_tokens").alias("supply_tokens"))
    drawn = draw(sized, wanted, total).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"))
    all_drawn = drawn.agg(F.sum("drawn_tokens")).collect()[0][0] or 0
    rows = F.broadcast(spark.createDataFrame([(t.source, t.share) for t in wanted], "source string, target_share double"))
    both = rows.join(supply, "source", "left").join(drawn, "source", "left")
    return both.select("source", "target_share", F.coalesce("supply_tokens", F.lit(0)).alias("supply_tokens"), F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), (F.coalesce("drawn_tokens", F.lit(0)) / F.lit(max(all_drawn, 1))).alias("actual_share"))
