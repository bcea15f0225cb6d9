"""Structured Streaming: ingestion into snapshots, and sessions of late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources import store as T


def ingest_stream(stream: DataFrame, store: T.SnapshotStore, name: str, key: list[str], fingerprint: str, checkpoint: str, order: str, reject: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataStreamWriter:
    """A writer that upserts each micro-batch into a snapshot.

    Of a key's rows in a batch the last by ``order`` counts. ``reject`` splits
    a batch into accepted and rejected rows; the latter go to ``<name>_dead``.
    A batch that is run again after a failure finds equal fingerprints and
    changes nothing.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        if reject is not None:
            batch, dead = reject(batch)
            dead.write.mode("overwrite").parquet(f"{store.folder}/{name}_dead/{batch_id}")
        rest = [c for c in batch.columns if c not in key]
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
        current = store.read(name)
        store.write(name, last if current is None else T.keyed_upsert(current, last, key, fingerprint).drop("status"))

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def sessions_stream(stream: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Gap sessions with a watermark: one row per (key, session) once it can't grow any more."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.col(key), F.session_window(at, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("observations"), F.min(at).alias("started_at"), F.max(at).alias("ended_at"))
        .select(key, "started_at", "ended_at", "observations")
    )


def tumbling_counts(stream: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The access log without repeated requests within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)
