"""Incremental scans after a checkpoint, and the checkpoint of a batch."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)?$")


def guard_identifier(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def resolve_columns(columns: list[str] | None, cursor: tuple[str, str], soft_delete: str | None = None) -> list[str]:
    """The columns to read: those asked for, then the soft-delete and cursor columns that are missing."""
    if columns is None:
        return ["*"]
    wanted = [*columns, *([soft_delete] if soft_delete else []), *cursor]
    return [guard_identifier(c) for c in dict.fromkeys(wanted)]


def incremental_scan(table: DataFrame, cursor: tuple[str, str], checkpoint: tuple[Any, Any] | None = None, columns: list[str] | None = None, equal: dict[str, Any] | None = None, soft_delete: str | None = None) -> DataFrame:
    """Rows after the checkpoint in (timestamp, id) order; filters and columns reach the scan."""
    for name, value in (equal or {}).items():
        table = table.where(F.col(guard_identifier(name)) == F.lit(value))
    if checkpoint is not None:
        ts, key = F.col(cursor[0]), F.col(cursor[1])
        at, last = F.lit(checkpoint[0]), F.lit(checkpoint[1])
        # the first test is implied by the second and is there for the scan's statistics
        table = table.where((ts >= at) & ((ts > at) | (key > last)))
    return table.select(*resolve_columns(columns, cursor, soft_delete))


def checkpoint_of(batch: DataFrame, cursor: tuple[str, str]) -> DataFrame:
    """One row with the last (timestamp, id); nulls if the batch is empty."""
    last = F.max(F.struct(*cursor))
    return batch.agg(last.alias("c")).select(*(F.col(f"c.{x}").alias(x) for x in cursor))


def read_table(spark, path: str, kind: str = "parquet", **options: Any) -> DataFrame:
    """Any format that Spark reads: parquet, orc, csv, json, text, avro, jdbc."""
    reader = spark.read.format(kind).options(**options)
    return reader.load() if kind == "jdbc" else reader.load(path)
