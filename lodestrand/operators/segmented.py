"""Ordered scans over keys of any size.

``Window.partitionBy(key)`` puts a key in one task. Where a key may hold a third of all rows, its
timeline is cut into chunks of bounded size; a window runs in each chunk and the little that
crosses a chunk's edge is carried by a table of one row per chunk, whose size is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHUNKS = 10_000


@dataclass(frozen=True)
class Segments:
    """Key and chunk columns of a chunked frame; ``hot`` tells whether any key has more than one chunk."""

    key: str | tuple[str, ...]
    chunk: str
    order: str
    hot: bool

    @property
    def keys(self) -> list[str]:
        return [self.key] if isinstance(self.key, str) else list(self.key)

    def window(self):
        return Window.partitionBy(*self.keys, self.chunk).orderBy(self.order)


def cut_hot_keys(df: DataFrame, key: str, order: str, position: Column, rows_per_chunk: int = 2_000_000, sizes: DataFrame | None = None, chunk: str = "__chunk") -> tuple[DataFrame, Segments]:
    """Adds ``chunk``: 0 for ordinary keys, 0..n along ``position`` for keys of more than ``rows_per_chunk`` rows.

    ``position`` is a number that never falls as ``order`` rises; ``sizes`` is a frame with at
    least as many rows of each key that is cheaper to count (the scan under ``df``). The limit is raised to a
    1/MAX_CHUNKS share of all rows, so there are at most MAX_CHUNKS hot keys and 2 * MAX_CHUNKS
    chunks whatever the input's size: that bounds what is gathered and broadcast here.
    """
    sizes = df if sizes is None else sizes
    n_rows = sizes.count()
    limit = max(rows_per_chunk, -(-n_rows // MAX_CHUNKS))
    if n_rows <= limit:
        return df.withColumn(chunk, F.lit(0)), Segments(key, chunk, order, False)
    hot = [(r[0], r[1]) for r in sizes.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > limit).collect()]
    if not hot:
        return df.withColumn(chunk, F.lit(0)), Segments(key, chunk, order, False)
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    keys = F.broadcast(spark.createDataFrame([(k, [i / (n // limit + 1) for i in range(1, n // limit + 1)]) for k, n in hot], f"`{key}` {kind}, __cuts array<double>"))
    widest = max(n // limit for _, n in hot)
    bounds = (
        df.join(F.broadcast(keys.select(key)), key)
        .groupBy(key)
        .agg(F.percentile_approx(position.cast("double"), [i / (widest + 1) for i in range(1, widest + 1)], 100 * (widest + 1)).alias("__bounds"))
        .collect()
    )
    table = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in bounds], f"`{key}` {kind}, __bounds array<double>"))
    at = F.when(F.col("__bounds").isNull(), F.lit(0)).otherwise(F.size(F.filter("__bounds", lambda b: b < position.cast("double"))))
    return df.join(table, key, "left").withColumn(chunk, at).drop("__bounds"), Segments(key, chunk, order, True)


def previous(df: DataFrame, seg: Segments, value: str, out: str, ignore_nulls: bool = True) -> DataFrame:
    """``out``: the last (non-null) ``value`` before each row of its key, null if there is none.

    With ``ignore_nulls`` False ``value`` must not hold nulls (wrap it in a struct).
    """
    before = F.last(value, ignorenulls=True).over(seg.window().rowsBetween(Window.unboundedPreceding, -1)) if ignore_nulls else F.lag(value).over(seg.window())
    df = df.withColumn(out, before)
    if not seg.hot:
        return df
    ends = df.filter(F.col(value).isNotNull()).groupBy(*seg.keys, seg.chunk).agg(F.max_by(value, seg.order).alias("__v"))
    return _carried(df, seg, ends, df.select(*seg.keys, seg.chunk).distinct(), out, backwards=False)


def following(df: DataFrame, seg: Segments, value: str, out: str) -> DataFrame:
    """``out``: the non-null ``value`` of the next row of the key, null at its end."""
    df = df.withColumn(out, F.lead(value).over(seg.window()))
    if not seg.hot:
        return df
    starts = df.groupBy(*seg.keys, seg.chunk).agg(F.min_by(value, seg.order).alias("__v"))
    return _carried(df, seg, starts, df.select(*seg.keys, seg.chunk).distinct(), out, backwards=True)


def _carried(df: DataFrame, seg: Segments, edges: DataFrame, chunks: DataFrame, out: str, backwards: bool) -> DataFrame:
    """Fills ``out`` from the nearest other chunk; the carry table holds only chunks of keys with several."""
    order = F.col(seg.chunk).desc() if backwards else F.col(seg.chunk).asc()
    on = [*seg.keys, seg.chunk]
    w = Window.partitionBy(*seg.keys).orderBy(order)
    carry = (
        chunks.join(edges, on, "left")
        .withColumn("__n", F.max(seg.chunk).over(Window.partitionBy(*seg.keys)))
        .filter("__n > 0")
        .withColumn("__in", F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .filter("__in is not null")
        .select(*on, "__in")
    )
    # both sides are spread by chunk, so that no size is presumed; Spark broadcasts the table if it finds it small
    return df.join(carry, on, "left").withColumn(out, F.coalesce(out, "__in")).drop("__in")
