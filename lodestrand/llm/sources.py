"""Names of document sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_name(source: Column) -> Column:
    """Spellings of a source as one; null and blank are ``unknown``."""
    s = F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")
    return F.when(s.isNull() | (s == ""), "unknown").otherwise(s)
