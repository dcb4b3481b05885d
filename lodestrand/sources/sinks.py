"""Writing results: tables as Parquet or JSON, and captures that are fetched once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """One report as a folder of files; an existing one is replaced."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def new_captures(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched captures whose (package, version) isn't stored yet."""
    return fetched.join(stored.select("package", "version").distinct(), ["package", "version"], "left_anti")
