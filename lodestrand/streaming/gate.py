"""Decisions on a stream of presented configurations against stored receipts: a stateless stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestrand.operators import receipts


def decisions(presented: DataFrame, issued: DataFrame, trusted: list[str] | None = None) -> DataFrame:
    """(receipt_id, verdict, permitted, licenses, outside) for each row of the stream ``presented``."""
    return receipts.verify(issued, presented, trusted)


def settled_updates(updates: DataFrame, key: str = "tool_id", at: str = "effective_at", delay: str = "1 day") -> DataFrame:
    """A stream of updates without repeats of the same (key, time, receipt) that arrive within ``delay`` of the latest event."""
    return updates.withWatermark(at, delay).dropDuplicatesWithinWatermark([key, at, "received_at", "op", "name", "description"])


def to_table(decided: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends decisions to Parquet files, each once, and stops when the present input is used up."""
    return decided.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
