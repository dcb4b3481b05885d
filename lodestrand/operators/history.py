"""Problem 1: history of changing attributes as insert-only satellites.

Attributes whose measured change rates are alike share a satellite, to which a row is appended only
when the digest of its attributes differs from the entity's row before it. Rows are never updated or
deleted: the end of a row's period is derived by ``lead`` in a view, and a row that a later
correction takes back is voided by a row of that later load. A status satellite holds the spans in
which the entity exists. Versions come from the satellites' views: at each start, the rows in
force of all satellites, joined in time with the status in force.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import digest, same_text
from lodestrand.operators.segmented import Segments, cut_hot_keys, following, previous
from lodestrand.session import scratch_dir, stored

NAME_AND_DESCRIPTION = ("name", "description")
STATUS = "sat_status"
#: Attributes that change at most this many times as often as one another share a satellite.
LIKE_RATES = 2.0


def seconds(col: str) -> Column:
    """Seconds of a zone-less timestamp; never falls as the timestamp rises, whatever the session's zone."""
    c = F.col(col)
    return F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def settled(updates: DataFrame, key: str, at: str, received: str, op: str, attributes: Sequence[str], tie: str | None = None) -> DataFrame:
    """One row per (key, at): the one received last. Repeats and corrected rows fold in the map-side aggregate.

    Rows without key or time state no period and are left out, as are operations other than
    upsert and retire. Equal ``received``: the larger ``tie``, then the larger values; a null
    ``received`` loses. A retire carries no attributes.
    """
    o = F.lower(F.trim(F.col(op)))
    last = [received, *([tie] if tie else [])]
    rows = updates.select(
        F.col(key), F.col(at), *[F.col(c) for c in last], o.alias("__op"),
        *[F.when(o == "upsert", F.col(a)).alias(a) for a in attributes],
    ).filter(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col("__op").isin("upsert", "retire"))
    best = rows.groupBy(key, at).agg(F.max(F.struct(*last, "__op", *attributes)).alias("__m"))
    return best.select(key, at, F.col("__m.__op").alias("op"), *[F.col(f"__m.{a}").alias(a) for a in attributes])


def attribute_changes(
    updates: DataFrame,
    key: str = "tool_id",
    at: str = "effective_at",
    received: str = "received_at",
    op: str = "op",
    tie: str | None = "update_id",
    attributes: Sequence[str] = NAME_AND_DESCRIPTION,
    rows_per_chunk: int = 2_000_000,
) -> DataFrame:
    """(key, at, op, attributes as the same text, changed, status) of the rows at which anything changes.

    ``changed`` names the attributes whose digest differs from that before; ``status`` tells
    whether existence changes; the first upsert changes all. A null attribute in an upsert means the value before; none before: null.
    """
    rows = settled(updates, key, at, received, op, attributes, tie).withColumns({a: same_text(a) for a in attributes})
    rows, seg = cut_hot_keys(rows, key, at, seconds(at), rows_per_chunk, sizes=updates)
    for a in attributes:
        rows = previous(rows, seg, a, f"__was_{a}")
    rows = rows.withColumns({a: F.coalesce(a, f"__was_{a}") for a in attributes})
    up = F.col("op") == "upsert"
    rows = rows.withColumn("__digests", F.when(up, F.struct(*[digest(F.col(a)).alias(a) for a in attributes])))
    rows = previous(previous(rows, seg, "__digests", "__before"), seg, "op", "__was")
    differs = [F.when(up & (F.col("__before").isNull() | (F.col(f"__digests.{a}") != F.col(f"__before.{a}"))), F.lit(a)) for a in attributes]
    rows = rows.withColumns({"changed": F.array_compact(F.array(*differs)), "status": up != F.coalesce(F.col("__was") == "upsert", F.lit(False))})
    return rows.filter("size(changed) > 0 or status").select(key, at, "op", *attributes, "changed", "status")


def split_by_rate(changes: Mapping[str, int], factor: float = LIKE_RATES) -> dict[str, tuple[str, ...]]:
    """Satellites by name: attributes in order of their number of changes, cut where it falls by more than ``factor``."""
    groups: list[list[str]] = []
    for a in sorted(changes, key=lambda a: (-changes[a], a)):
        if groups and changes[groups[-1][0]] <= factor * changes[a]:
            groups[-1].append(a)
        else:
            groups.append([a])
    return {f"sat_{'_'.join(sorted(g))}": tuple(sorted(g)) for g in groups}


@dataclass
class Satellites:
    """Satellites in a folder, as one table partitioned by satellite: (key, at, op, hash_diff, attributes, load_no, void, satellite)."""

    spark: SparkSession
    path: str
    groups: Mapping[str, Sequence[str]]
    key: str = "tool_id"
    at: str = "effective_at"
    schema: str = ""

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _wanted(self, changes: DataFrame) -> DataFrame:
        """What every satellite takes of ``changes``."""
        takes = [F.when(F.arrays_overlap("changed", F.array(*map(F.lit, group))), F.struct(F.lit(s).alias("satellite"), digest(*map(F.col, group)).alias("hash_diff"))) for s, group in self.groups.items()]
        takes.append(F.when(F.col("status"), F.struct(F.lit(STATUS).alias("satellite"), digest(F.col("op")).alias("hash_diff"))))
        rows = changes.select("*", F.explode(F.array_compact(F.array(*takes))).alias("__s")).select("*", "__s.*")
        own = {a: F.when(F.col("satellite") == s, F.col(a)) for s, group in self.groups.items() for a in group}
        return rows.select(self.key, self.at, F.when(F.col("satellite") == STATUS, F.col("op")).alias("op"), "hash_diff", *[c.alias(a) for a, c in own.items()], "satellite")

    def load(self, changes: DataFrame, load_no: int) -> None:
        """Appends what ``changes``, all that is known now of the keys it has, says anew; nothing stored is touched.

        A stored row of these keys that no longer holds, since a correction came late, is followed
        by one of the same key and time with ``void``.
        """
        new = self._wanted(changes).withColumns({"load_no": F.lit(load_no), "void": F.lit(False)})
        self.schema = self.schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema if f.name != "satellite") + ", satellite string"
        if load_no:
            same = ["satellite", self.key, self.at, "hash_diff"]
            held = self.current().join(changes.select(self.key).distinct(), self.key, "left_semi")
            kept = held.select(*same)
            gone = held.join(new.select("satellite", self.key, self.at), ["satellite", self.key, self.at], "left_anti").withColumns({"load_no": F.lit(load_no), "void": F.lit(True)})
            new = new.join(kept, same, "left_anti").unionByName(gone.select(new.columns))
        new.write.mode("append").partitionBy("satellite").parquet(self.path)

    def current(self) -> DataFrame:
        """The rows that hold: of each (satellite, key, at) the last load's, unless it is void."""
        last = self.rows().groupBy("satellite", self.key, self.at).agg(F.max_by(F.struct("op", "hash_diff", *[a for g in self.groups.values() for a in g], "void"), "load_no").alias("__m"))
        return last.select("satellite", self.key, self.at, "__m.*").filter("not void")

    def view(self, loads: int = 1, rows_per_chunk: int = 2_000_000) -> tuple[DataFrame, Segments]:
        """All satellites with ``valid_to``, the start of the entity's next row in the satellite (null: open), cut into chunks of keys.

        Corrections may leave equal neighbours; periods meet all the same.
        """
        held = self.rows() if loads == 1 else self.current()
        rows, seg = cut_hot_keys(held, self.key, self.at, seconds(self.at), rows_per_chunk, sizes=self.rows())
        rows = rows.repartition(self.key, seg.chunk)
        return following(rows, Segments((self.key, "satellite"), seg.chunk, self.at, seg.hot), self.at, "valid_to"), seg


def versions(view: DataFrame, seg: Segments, groups: Mapping[str, Sequence[str]], at: str = "effective_at") -> DataFrame:
    """One row per version with valid_from and valid_to (null: open), from the satellites' views.

    A version starts where a satellite has a row while the entity exists. It lasts as long as
    all rows in force there do, the status among them, so it ends with the first of their periods.
    """
    names = [*groups, STATUS]
    per = view.groupBy(seg.key, seg.chunk, at).agg(*[F.max(F.when(F.col("satellite") == s, F.struct(F.lit(True).alias("has"), "valid_to", "op"))).alias(s) for s in names])
    for s in names:
        per = previous(per, seg, s, f"__was_{s}").withColumn(s, F.coalesce(s, f"__was_{s}")).drop(f"__was_{s}")
    ends = F.least(*[F.col(f"{s}.valid_to") for s in names])
    return per.filter(F.col(f"{STATUS}.op") == "upsert").select(seg.key, F.col(at).alias("valid_from"), ends.alias("valid_to"))


def as_text(c: str) -> Column:
    return F.substring(F.col(c).cast("string"), 1, 19)


def satellites(updates: DataFrame, rows_per_chunk: int = 2_000_000, attributes: Sequence[str] = NAME_AND_DESCRIPTION) -> Satellites:
    """Satellites of all updates in a new folder, split by the change rates these show."""
    changes = stored(attribute_changes(updates, attributes=attributes, rows_per_chunk=rows_per_chunk), "changes")
    counts = changes.agg(*[F.count_if(F.array_contains("changed", a)).alias(a) for a in attributes]).collect()[0].asDict()
    spark = updates.sparkSession
    made = Satellites(spark, os.path.join(scratch_dir(spark), f"satellites-{uuid.uuid4().hex}"), split_by_rate(counts))
    made.load(changes, 0)
    return made


def version_periods(updates: DataFrame, rows_per_chunk: int = 2_000_000) -> DataFrame:
    """(tool_id, valid_from, valid_to) of every version; see TESTDATA problem 1. An empty table gives no row."""
    made = satellites(updates, rows_per_chunk)
    found = versions(*made.view(rows_per_chunk=rows_per_chunk), made.groups)
    return found.select("tool_id", as_text("valid_from").alias("valid_from"), F.coalesce(as_text("valid_to"), F.lit("open")).alias("valid_to"))


def satellite_sizes(updates: DataFrame) -> DataFrame:
    """(satellite, n_rows) of the satellites as stored."""
    return satellites(updates).rows().groupBy("satellite").agg(F.count("*").alias("n_rows"))
