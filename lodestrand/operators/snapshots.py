"""Problem 3: what changed between full snapshots, by bitmaps over persistent ordinals.

Keys of a group (here: tools of a package) get ordinals that stay theirs for good, held in a dictionary
that is written and, given a folder, extended by later runs. The members of a snapshot are a
compressed bitmap over the ordinals: words of 64 bits held in ``bigint``, words without a bit are
not stored. ``cur & ~prev`` gives additions, ``prev & ~cur`` removals, and for ``cur & prev`` the value
vectors, digests in ordinal order of the set bits, are compared position by position. Names are
looked up in the dictionary at the end, for the cases alone.

A group of any size is spread over buckets; ordinals are (bucket, position), as the high and low
parts of a roaring bitmap's keys. Every array below holds at most 64 entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import joined, same_text
from lodestrand.session import stored

WORD = 64


def latest_rows(rows: DataFrame, keys: list[str], by: str, values: list[str]) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``by`` (null loses; ties: the greater values)."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(by, *values)).alias("__m"))
    return best.select(*keys, *[F.col(f"__m.{v}").alias(v) for v in values])


def listed_snapshots(rows: DataFrame, group: str = "package", snap: str = "snap_no", error: str = "error") -> DataFrame:
    """(group, listed): the ascending numbers of the snapshots in which the group was listed without error."""
    fine = rows.groupBy(group, snap).agg(F.max(F.coalesce(F.trim(error) != "", F.lit(False))).alias("__bad"), F.max(F.col("name").isNotNull()).alias("__any"))
    return fine.filter("not __bad and __any").groupBy(group).agg(F.array_sort(F.collect_set(snap)).alias("listed"))


def assign_ordinals(keys: DataFrame, group: str, name: str, first: str, known: DataFrame | None = None, bucket_rows: int = 200_000) -> DataFrame:
    """(group, name, n_buckets, bucket, position) of ``keys`` that ``known`` lacks: rows to add to the dictionary.

    The bucket of a key depends on its name and the room its group needs when the key is first
    met; positions run by first appearance. Keys of ``known`` keep their ordinals: new ones follow
    in their buckets, or in further buckets once those would hold more than ``bucket_rows``.
    """
    sizes = keys.groupBy(group).agg(F.count("*").alias("__size"))
    need = F.ceil(F.col("__size") / F.lit(bucket_rows)).cast("int")
    if known is None:
        fresh = keys.join(sizes.select(group, F.lit(0).alias("__base"), need.alias("n_buckets")), group).withColumn("__from", F.lit(0))
    else:
        had = known.groupBy(group).agg(F.max("n_buckets").alias("__had"))
        room = sizes.join(had, group, "left").select(group, F.coalesce("__had", F.lit(0)).alias("__had"), need.alias("__need"))
        room = room.select(group, F.when(F.col("__need") > F.col("__had"), F.col("__had")).otherwise(0).alias("__base"), F.greatest("__need", "__had").alias("n_buckets"))
        fresh = keys.join(known.select(group, name), [group, name], "left_anti").join(room, group)
    fresh = fresh.withColumn("bucket", (F.col("__base") + F.pmod(F.xxhash64(name), F.col("n_buckets") - F.col("__base"))).cast("int"))
    if known is not None:
        high = known.groupBy(group, "bucket").agg((F.max("position") + 1).alias("__from"))
        fresh = fresh.join(high, [group, "bucket"], "left").withColumn("__from", F.coalesce("__from", F.lit(0)))
    at = Window.partitionBy(group, "bucket").orderBy(first, name)
    return fresh.select(group, name, "n_buckets", "bucket", (F.row_number().over(at) - 1 + F.col("__from")).cast("bigint").alias("position"))


def dictionary_of(keys: DataFrame, group: str, name: str, first: str, folder: str | None = None, bucket_rows: int = 200_000) -> DataFrame:
    """The ordinals of all ``keys``, written before they are used. With ``folder``, those found there hold and new ones are appended."""
    if folder is None:
        return stored(assign_ordinals(keys, group, name, first, bucket_rows=bucket_rows), "ordinals")
    spark = keys.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = spark.read.parquet(folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
    assign_ordinals(keys, group, name, first, known, bucket_rows).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def words_of(cells: DataFrame, group: str, snap: str, value: str) -> DataFrame:
    """One row per (group, bucket, word, snapshot): ``bits``, and ``vector``, the values of the set bits in order.

    ``cells`` has a row per member of a snapshot with bucket and position. Rows of a word stay together, for the comparison.
    """
    located = cells.select(group, "bucket", F.floor(F.col("position") / WORD).alias("word"), F.pmod("position", F.lit(WORD)).cast("int").alias("__bit"), snap, F.col(value).alias("v"))
    return (
        located.repartition(group, "bucket", "word")
        .groupBy(group, "bucket", "word", snap)
        .agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("bits"), F.array_sort(F.collect_list(F.struct("__bit", "v"))).alias("__sorted"))
        .withColumn("vector", F.col("__sorted.v"))
        .drop("__sorted")
    )


def neighbours(listed: DataFrame, group: str, snap: str) -> DataFrame:
    """(group, snap, prev, next) of listed snapshots."""
    at = F.posexplode("listed").alias("__i", snap)
    return listed.select(group, "listed", at).select(group, snap, F.when(F.col("__i") > 0, F.get("listed", F.col("__i") - 1)).alias("prev"), F.get("listed", F.col("__i") + 1).alias("next"))


def compare_words(words: DataFrame, listed: DataFrame, group: str, snap: str) -> DataFrame:
    """(group, bucket, position, snap, kind) for each consecutive pair of listed snapshots.

    A word absent from a listed snapshot is a word of zeros. Each word meets the one before it in
    a window over the snapshots of that word.
    """
    in_time = Window.partitionBy(group, "bucket", "word").orderBy(snap)
    rows = words.join(neighbours(listed, group, snap), [group, snap]).withColumns({"p": F.lag(F.struct(snap, "bits", "vector")).over(in_time), "__after": F.lead(snap).over(in_time)})
    rows = rows.withColumn("p", F.when(F.col(f"p.{snap}") == F.col("prev"), F.col("p"))).withColumn("__was", F.expr("coalesce(p.bits, 0L)"))
    set_bits = lambda mask: f"filter(sequence(0, {WORD - 1}), b -> (({mask}) & shiftleft(1L, b)) != 0)"
    value = lambda side, bits: f"element_at({side}, cast(bit_count({bits} & ~shiftleft(-1L, b)) + 1 AS int))"
    told = lambda mask, kind, at: f"transform({set_bits(mask)}, b -> struct(b AS bit, '{kind}' AS kind, {at} AS at))"
    none = "array()"
    steps = [
        f"if(prev is null or (bits & ~__was) = 0, {none}, {told('bits & ~__was', 'added', snap)})",
        f"if(prev is null or (__was & ~bits) = 0, {none}, {told('__was & ~bits', 'removed', snap)})",
        f"if(prev is null or (bits & __was) = 0 or vector <=> p.vector and bits = __was, {none}, transform(filter({set_bits('bits & __was')}, b -> {value('vector', 'bits')} != {value('p.vector', '__was')}), b -> struct(b AS bit, 'changed' AS kind, {snap} AS at)))",
        f"if(next is null or __after <=> next, {none}, {told('bits', 'removed', 'next')})",
    ]
    return rows.select(group, "bucket", "word", F.explode(F.concat(*map(F.expr, steps))).alias("c")).select(group, "bucket", (F.col("word") * WORD + F.col("c.bit")).alias("position"), F.col("c.at").alias(snap), "c.kind")


def required_names(schema: Column) -> Column:
    """The sorted set of names in the top-level ``required`` as text; absent, null, empty and unreadable are alike."""
    text = F.get_json_object(schema, "$.required")
    alone = F.when(text.isNotNull() & ~F.ltrim(text).startswith("["), F.array(text))
    names = F.coalesce(alone, F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return F.to_json(F.array_sort(F.array_distinct(F.array_compact(names))))


def snapshot_changes(snapshots: DataFrame, bucket_rows: int = 200_000, dictionary: str | None = None) -> DataFrame:
    """(package, tool_name, snap_no, kind) for tool_snapshots; see TESTDATA problem 3.

    Rows without package or snapshot number are left out; a null description is a value of its
    own. A package's first listing and its end give no row, an empty table none at all.
    ``dictionary`` is a folder in which ordinals are kept between runs.
    """
    rows = snapshots.filter("package is not null and snap_no is not null")
    tools = rows.filter("name is not null and coalesce(trim(error), '') = ''").select(
        "package", "name", "snap_no", "delivered_at",
        F.unhex(F.md5(joined(same_text(F.col("description")), required_names(F.col("input_schema"))))).alias("__v"),
    )
    members = stored(latest_rows(tools, ["package", "name", "snap_no"], "delivered_at", ["__v"]), "members")
    ordinals = dictionary_of(members.groupBy("package", "name").agg(F.min("snap_no").alias("__first")), "package", "name", "__first", dictionary, bucket_rows)
    cells = members.join(ordinals.select("package", "name", "bucket", "position"), ["package", "name"])
    cases = compare_words(words_of(cells, "package", "snap_no", "__v"), listed_snapshots(rows), "package", "snap_no")
    named = cases.join(ordinals.select("package", "bucket", "position", F.col("name").alias("tool_name")), ["package", "bucket", "position"])
    return named.select("package", "tool_name", "snap_no", "kind")
