"""Query registry: one entry per operator of the inventory.

Each entry holds a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where the result is SQL-expressible, the DuckDB text of the same query
over the pre-registered tables.  Column names are aliased identically on
both sides; doubles are rounded to 6 decimals where summation order or
libm may differ.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from punctual.sources.fixture import dirty_trips_sql, scored_trips_sql, trips_sql, with_duplicates_sql

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    ids: list[str] = field(default_factory=list)
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, ids: list[str], sql: str | None = None, doc: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ids, doc or (fn.__doc__ or "").strip())
        return fn
    return deco


def with_trips(body: str, **ctes: str) -> str:
    """Wrap ``body`` in CTEs: ``trips`` first, then companions and extras in order."""
    parts = [f"trips AS ({trips_sql()})"]
    for name, sql in ctes.items():
        parts.append(f"{name} AS ({sql})")
    return "WITH " + ",\n".join(parts) + "\n" + body


# Companion CTE texts, ready to pass to ``with_trips``.
DIRTY = dirty_trips_sql()
DUPS = with_duplicates_sql()
SCORED = scored_trips_sql()


def load_all() -> dict[str, Query]:
    """Import every query module (registration happens at import)."""
    from punctual.plans import q_prep, q_agg, q_metrics, q_build, q_split, q_models, q_io  # noqa: F401
    return REGISTRY
