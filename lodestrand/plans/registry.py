"""All core queries by name; each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.plans import changes, evidence, identity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**changes.QUERIES, **identity.QUERIES, **evidence.QUERIES}
