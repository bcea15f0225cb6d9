"""Keyed tables as snapshots: classification of a batch, upserts, and history.

Plain Parquet has no MERGE, so an upsert is a join of the batch with the
current snapshot and a new one is written beside it; readers follow a pointer
that changes last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def revision_history(batch: DataFrame, key: list[str], order: list[str], version: str, content: str, deleted: str) -> DataFrame:
    """The revisions that an ordered batch makes: revision_number and change_type, unchanged rows left out."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    first = F.row_number().over(w) == 1
    same = before(version).eqNullSafe(F.col(version)) & before(content).eqNullSafe(F.col(content)) & before(deleted).eqNullSafe(F.col(deleted))
    change = F.when(first, "created").when(same, "unchanged").when(before(deleted) & ~F.col(deleted), "restored").when(~before(deleted) & F.col(deleted), "deleted").otherwise("updated")
    rows = batch.withColumn("change_type", change).where("change_type <> 'unchanged'")
    return rows.withColumn("revision_number", F.row_number().over(w))


def classify(current: DataFrame, batch: DataFrame, key: list[str], version: str, content: str, deleted: str) -> DataFrame:
    """Each row of the batch with ``status``: created, unchanged, restored, deleted or updated."""
    old = current.select(*(F.col(k).alias(f"o_{k}") for k in key), F.col(version).alias("o_version"), F.col(content).alias("o_content"), F.col(deleted).alias("o_deleted"), F.lit(True).alias("o_there"))
    on = F.lit(True)
    for k in key:
        on = on & (F.col(k) == F.col(f"o_{k}"))
    same = F.col("o_version").eqNullSafe(F.col(version)) & F.col("o_content").eqNullSafe(F.col(content)) & F.col("o_deleted").eqNullSafe(F.col(deleted))
    status = F.when(F.col("o_there").isNull(), "created").when(same, "unchanged").when(F.col("o_deleted") & ~F.col(deleted), "restored").when(~F.col("o_deleted") & F.col(deleted), "deleted").otherwise("updated")
    return batch.join(old, on, "left").select(*batch.columns, status.alias("status"))


def ingest_counts(classified: DataFrame) -> DataFrame:
    kinds = ("created", "updated", "deleted", "unchanged", "restored", "rejected", "failed")
    return classified.agg(F.count(F.lit(1)).alias("discovered"), *(F.count_if(F.col("status") == k).alias(k) for k in kinds))


def keyed_upsert(current: DataFrame, batch: DataFrame, key: list[str], fingerprint: str) -> DataFrame:
    """The new snapshot: rows of the batch replace those of their key unless the fingerprint is equal.

    ``status`` says created, updated, unchanged (of this batch) or kept.
    """
    rest = [c for c in current.columns if c not in key]
    new = batch.select(*key, F.struct(*rest).alias("__new"))
    old = current.select(*key, F.struct(*rest).alias("__old"))
    both = old.join(new, key, "full")
    same = F.col(f"__old.{fingerprint}").eqNullSafe(F.col(f"__new.{fingerprint}"))
    status = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "created").when(same, "unchanged").otherwise("updated")
    take_new = status.isin("created", "updated")
    return both.select(*key, status.alias("status"), *(F.when(take_new, F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) for c in rest))


def deactivate_missing(current: DataFrame, active: DataFrame, key: list[str], flag: str = "is_active") -> DataFrame:
    """``current`` with the flag cleared where the key isn't among ``active``."""
    there = active.select(*key).distinct().withColumn("__there", F.lit(True))
    return current.join(there, key, "left").withColumn(flag, F.col(flag) & F.col("__there").isNotNull()).drop("__there")


def append_references(log: DataFrame, batch: DataFrame, key: list[str], request: str = "request_id") -> DataFrame:
    """``log`` with the batch's rows, a request's row of a key once; rows without a request always."""
    named = batch.where(F.col(request).isNotNull()).dropDuplicates([request, *key])
    fresh = named.join(log.where(F.col(request).isNotNull()).select(request, *key), [request, *key], "left_anti")
    return log.unionByName(batch.where(F.col(request).isNull())).unionByName(fresh.select(log.columns))


def clear_tenant(table: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    return table.where(~F.col(column).eqNullSafe(F.lit(tenant)))


class SnapshotStore:
    """Named tables under a folder; each write makes a new snapshot and then moves the pointer.

    A pointer is an empty file whose name carries a number and the snapshot;
    the highest counts, so moving it is one creation. A writer that finds it
    moved since it began gets an error instead of losing the other's rows.
    The last ``keep`` snapshots stay for results that still read them.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _versions(self, name: str) -> list[tuple[int, str]]:
        """(number, snapshot), oldest first."""
        fs, where = self._fs(f"{self.folder}/{name}")
        if not fs.exists(where):
            return []
        names = [str(f.getPath().getName()) for f in fs.listStatus(where)]
        return sorted((int(n.split(".")[1]), n.split(".")[2]) for n in names if n.startswith("pointer."))

    def read(self, name: str) -> DataFrame | None:
        versions = self._versions(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/{versions[-1][1]}") if versions else None

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write a snapshot of ``df``, which may be derived from the current one."""
        before, at = self._versions(name), f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}/{at}")
        now = self._versions(name)
        number = before[-1][0] + 1 if before else 1
        if now != before:
            raise RuntimeError(f"{name} was written by another meanwhile")
        fs, where = self._fs(f"{self.folder}/{name}/pointer.{number:012d}.{at}")
        fs.create(where, False).close()
        for old, snapshot in now[: max(0, len(now) + 1 - self.keep)]:
            for path in (f"pointer.{old:012d}.{snapshot}", snapshot):
                fs, where = self._fs(f"{self.folder}/{name}/{path}")
                fs.delete(where, True)
        return self.spark.read.parquet(f"{self.folder}/{name}/{at}")
