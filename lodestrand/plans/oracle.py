"""SQL for DuckDB that gives each core query's result on the same tables."""

from __future__ import annotations

from lodestrand.plans import changes, evidence, identity


def sql() -> dict[str, str]:
    return {**changes.SQL, **identity.SQL, **evidence.SQL}
