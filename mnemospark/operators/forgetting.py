"""Retention of memories over time, and compaction of their reference log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ActivationConfig, ForgettingConfig
from ..functions.maths import seconds_between, sigmoid, time_bucket


def retention_score(base: Column, importance: Column, cfg: ForgettingConfig = ForgettingConfig(), threshold: float = ActivationConfig().threshold) -> Column:
    raw = sigmoid(base - threshold)
    return raw * (cfg.importance_floor + (1 - cfg.importance_floor) * importance) if cfg.scale_importance else raw


def transitions(df: DataFrame, score: str, as_of: Column, protected: Column, cfg: ForgettingConfig = ForgettingConfig()) -> DataFrame:
    """Adds state, below_threshold_since, forgotten_at and reactivated.

    Needs the previous prev_state, prev_since and prev_forgotten_at, null for
    memories without one.
    """
    s = F.col(score)
    since = F.coalesce("prev_since", as_of)
    waited = seconds_between(since, as_of) >= cfg.grace_seconds
    state = F.when(s >= cfg.fading, "active").when(s > cfg.forgotten, "fading").when(waited & ~protected, "forgotten").otherwise("fading")
    low = s <= cfg.forgotten
    return df.select(
        "*",
        state.alias("state"),
        F.when(low, since).alias("below_threshold_since"),
        F.when(state == "forgotten", F.coalesce("prev_forgotten_at", as_of)).alias("forgotten_at"),
        ((s >= cfg.fading) & F.coalesce(F.col("prev_state").isin("fading", "forgotten"), F.lit(False))).alias("reactivated"),
    )


def counters(states: DataFrame) -> DataFrame:
    """One row: memories in each state, and those that came back."""
    return states.agg(*(F.count_if(F.col("state") == x).alias(x) for x in ("active", "fading", "forgotten")), F.count_if("reactivated").alias("reactivated"))


def protected_by_support(rows: DataFrame, derivations: DataFrame, status: str = "status") -> DataFrame:
    """``rows`` (kind, key) with ``protected``: episodes that a fact rests on which isn't superseded.

    ``derivations``: episode_id and the fact's status.
    """
    held = derivations.where(F.col(status) != "superseded").select(F.lit("episode").alias("kind"), F.col("episode_id").alias("key")).distinct().withColumn("protected", F.lit(True))
    return rows.join(held, ["kind", "key"], "left").withColumn("protected", F.coalesce("protected", F.lit(False)))


def drop_forgotten(candidates: DataFrame, dynamics: DataFrame, key: list[str]) -> DataFrame:
    """Candidates that aren't forgotten; those without a state stay."""
    return candidates.join(dynamics.where("state = 'forgotten'").select(*key), key, "left_anti")


def compact(log: DataFrame, by: list[str], at: str, weight: str, before: Column, as_of: Column, cfg: ForgettingConfig = ForgettingConfig(), decay: float = ActivationConfig().decay) -> DataFrame:
    """``log`` (by, at, weight) with the traces before a time merged per bucket.

    A merged trace has the sum of the weights and the age at which the base
    level is unchanged; traces of one time keep it.
    """
    old, new = log.where(F.col(at) < before), log.where(~(F.col(at) < before))
    age = F.greatest(seconds_between(F.col(at), as_of), F.lit(1.0))
    w = F.col(weight).cast("double")
    merged = old.groupBy(*by, time_bucket(F.col(at), cfg.bucket_seconds).alias("bucket")).agg(F.sum(weight).alias("w"), F.sum(w * F.pow(age, F.lit(-float(decay)))).alias("s"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    elapsed = F.pow(F.col("w") / F.col("s"), F.lit(1 / float(decay)))
    when = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("timestamp")).otherwise(F.timestamp_micros((F.unix_micros(as_of.cast("timestamp")) - F.round(elapsed * 1e6)).cast("long")))
    return new.select(*by, F.col(at).cast("timestamp").alias(at), F.col(weight).cast("long").alias(weight)).unionByName(merged.select(*by, when.alias(at), F.col("w").cast("long").alias(weight)))


def burst_limited(results: DataFrame, traces: DataFrame, key: list[str], at: str, as_of: Column, limit: int, window_seconds: float) -> DataFrame:
    """Results with fewer than ``limit`` traces in the window that ends at ``as_of``."""
    recent = traces.where((seconds_between(F.col(at), as_of) <= window_seconds) & (F.col(at) <= as_of)).groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= limit)
    return results.join(recent.select(*key), key, "left_anti")
