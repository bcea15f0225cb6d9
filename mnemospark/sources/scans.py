"""Lists of stored rows, checkpoints of connectors, and the store's own versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import SnapshotStore


def scan(rows: DataFrame, equal: dict[str, Any] | None = None, one_of: dict[str, Sequence[Any]] | None = None, where: Column | None = None, order: Sequence[str | Column] = (), limit: int | None = None) -> DataFrame:
    """Rows that fit, ordered, the first ``limit`` of them. A filter of None isn't set."""
    if limit is not None and limit <= 0:
        raise ValueError("a limit must be greater than zero")
    for name, value in (equal or {}).items():
        rows = rows if value is None else rows.where(F.col(name) == F.lit(value))
    for name, values in (one_of or {}).items():
        rows = rows if values is None else rows.where(F.col(name).isin(list(values)))
    rows = rows if where is None else rows.where(where)
    rows = rows.orderBy(*order) if order else rows
    return rows if limit is None else rows.limit(limit)


def lookup(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among ``keys``."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi").select(rows.columns)


def revisions_of(revisions: DataFrame, memories: DataFrame, valid: Column | None = None, limit: int | None = None, **equal: Any) -> DataFrame:
    """Revisions with the subject of their memory, valid ones if asked, by memory and number; the limit comes last."""
    named = revisions.join(memories.select("memory_key", *(c for c in memories.columns if c not in revisions.columns)), "memory_key")
    return scan(named, equal, where=valid, order=["memory_key", "revision_number"], limit=limit)


class Checkpoints:
    """The last position of each (tenant, connector)."""

    def __init__(self, store: SnapshotStore) -> None:
        self.store = store

    def get(self, tenant: str, connector: str) -> tuple[Any, str] | None:
        table = self.store.read("checkpoints")
        row = None if table is None else table.where((F.col("tenant_id") == tenant) & (F.col("connector") == connector)).first()
        return None if row is None else (row["at"], row["last_id"])

    def set(self, tenant: str, connector: str, at: Any, last_id: str) -> None:
        new = self.store.spark.createDataFrame([(tenant, connector, at, last_id)], "tenant_id string, connector string, at timestamp, last_id string")
        table = self.store.read("checkpoints")
        self.store.write("checkpoints", new if table is None else table.where(~((F.col("tenant_id") == tenant) & (F.col("connector") == connector))).unionByName(new))


def migrate(store: SnapshotStore, steps: Sequence[tuple[str, Callable[[SnapshotStore], None]]]) -> list[str]:
    """Run the named steps that the store hasn't had yet, in order; the names of those run."""
    had = store.read("migrations")
    done = set() if had is None else {r[0] for r in had.select("name").collect()}
    ran = []
    for name, step in steps:
        if name not in done:
            step(store)
            new = store.spark.createDataFrame([(name,)], "name string")
            had = store.read("migrations")
            store.write("migrations", new if had is None else had.unionByName(new))
            ran.append(name)
    return ran


def legacy_backfill(semantics: DataFrame, revisions: DataFrame | None = None) -> DataFrame:
    """A first revision ``legacy:<id>`` for each memory (id, memory_key, status, valid_from, valid_until, ...) that has none."""
    rest = [c for c in semantics.columns if c not in ("id", "memory_key")]
    bare = semantics if revisions is None else semantics.join(revisions.select("memory_key").distinct(), "memory_key", "left_anti")
    return bare.select("memory_key", F.concat(F.lit("legacy:"), F.col("id").cast("string")).alias("revision_key"), F.lit(1).alias("revision_number"), *rest)
