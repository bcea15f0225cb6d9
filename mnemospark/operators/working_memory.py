"""Relevance and priority of the rows that compete for working memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import WorkingMemoryConfig
from ..functions.maths import clip, half_life, seconds_between
from ..functions.text import token_f1

CFG = WorkingMemoryConfig()


def cue_relevance(fields: list[Column]) -> Column:
    """Plain mean of the supplied fields' fits (null: not supplied); 1 without any."""
    given = F.filter(F.array(*fields), lambda x: x.isNotNull())
    return F.when(F.size(given) == 0, F.lit(1.0)).otherwise(F.aggregate(given, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(given)))


def text_relevance(cue: Column, tokens: Column) -> Column:
    return F.when(F.size(cue) > 0, token_f1(cue, tokens))


def recall_share(cue: Column, values: Column) -> Column:
    return F.when(F.size(cue) > 0, F.size(F.array_intersect(cue, values)) / F.size(cue))


def carryover(previous: Column, age: Column, cfg: WorkingMemoryConfig = CFG) -> Column:
    return F.coalesce(clip(previous * half_life(age, cfg.half_life_seconds)), F.lit(0.0))


def priority(score: Column, relevance: Column, importance: Column, carried: Column, cfg: WorkingMemoryConfig = CFG) -> Column:
    total = sum(cfg.weights)
    a, b, c, d = (w / total for w in cfg.weights)
    return a * score + b * relevance + c * importance + d * carried


def adjusted(base: Column, utility: Column, stale: Column | None = None, cfg: WorkingMemoryConfig = CFG) -> Column:
    out = base + cfg.utility_weight * (2 * F.coalesce(utility, F.lit(0.5)) - 1)
    return clip(out if stale is None else out - stale)


def stale_goal_penalty(goal: Column, status: Column, tags: Column, cfg: WorkingMemoryConfig = CFG) -> Column:
    """For goals that speak of what is stale: superseded rows and rows so tagged lose."""
    both = cfg.stale_penalty * ((status == "superseded").cast("int") + F.coalesce(F.array_contains(tags, "stale"), F.lit(False)).cast("int"))
    return F.when(F.lower(goal).contains("stale"), F.least(F.lit(1.0), both)).otherwise(F.lit(0.0))


def above_floor(pool: DataFrame, relevance: str, cfg: WorkingMemoryConfig = WorkingMemoryConfig()) -> tuple[DataFrame, DataFrame]:
    """Rows relevant enough for the goal, and (cue_id, dropped), the number of the others."""
    low = F.col(relevance) < cfg.least_relevance
    return pool.where(~low), pool.groupBy("cue_id").agg(F.count_if(low).alias("dropped"))


def with_carryover(pool: DataFrame, previous: DataFrame, at: Column, cfg: WorkingMemoryConfig = WorkingMemoryConfig()) -> DataFrame:
    """``pool`` (cue_id, tenant_id, subject_id, kind, key) with ``carried``: what is left of the strength in the last selection.

    ``previous`` has cue_id, tenant_id, subject_id, kind, key, strength and
    selected_at; one of another tenant or subject is an error.
    """
    p = previous.select("cue_id", "kind", "key", F.col("tenant_id").alias("p_tenant"), F.col("subject_id").alias("p_subject"), "strength", "selected_at")
    x = pool.join(p, ["cue_id", "kind", "key"], "left")
    strange = F.col("strength").isNotNull() & ~(F.col("p_tenant").eqNullSafe(F.col("tenant_id")) & F.col("p_subject").eqNullSafe(F.col("subject_id")))
    age = seconds_between(F.col("selected_at"), at)
    value = F.when(strange, F.raise_error(F.lit("the last selection is of another tenant or subject")).cast("double")).otherwise(F.coalesce(carryover(F.col("strength"), age, cfg), F.lit(0.0)))
    return x.withColumn("carried", value).select(*pool.columns, "carried")
