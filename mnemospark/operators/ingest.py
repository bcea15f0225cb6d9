"""Acceptance policy and retention of observations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalize_content

_STRIP = "^[\\s\\x1C-\\x1F]+|[\\s\\x1C-\\x1F]+$"


def policy(df: DataFrame, content: str = "content", deleted: str = "is_deleted") -> DataFrame:
    """Adds accepted, attention_score and policy_reason."""
    short = F.char_length(F.regexp_replace(F.coalesce(content, F.lit("")), _STRIP, "")) < 3
    gone = F.col(deleted)
    return df.select(
        "*",
        (gone | ~short).alias("accepted"),
        F.when(gone, 0.3).when(~short, 0.5).alias("attention_score"),
        F.when(gone, "deletion_event").when(short, "content_too_short").alias("policy_reason"),
    )


def retain(df: DataFrame, mode: str = "full", content: str = "content", redact: Callable[[Column], Column] | None = None) -> DataFrame:
    """``df`` with the content that is kept and the hash of the whole; modes full, redacted, hash_only."""
    normal = normalize_content(F.col(content))
    out = df.withColumn("content_hash", content_hash(normal))
    if mode == "full":
        return out.withColumn(content, normal)
    if mode == "hash_only":
        return out.withColumn(content, F.lit(None).cast("string"))
    if mode == "redacted" and redact is not None:
        return out.withColumn(content, redact(normal))
    raise ValueError(f"retention mode {mode!r} isn't available" + " without a function that redacts" * (mode == "redacted"))


def ingest(df: DataFrame, tenant: str, mode: str = "full", redact: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted and retained, rejected) of a tenant's observations; another tenant's row is an error."""
    ours = F.when(F.col("tenant_id") == tenant, F.col("tenant_id")).otherwise(F.raise_error(F.lit("an observation of another tenant")).cast("string"))
    judged = policy(df.withColumn("tenant_id", ours))
    return retain(judged.where("accepted"), mode, redact=redact), judged.where(~F.col("accepted"))
