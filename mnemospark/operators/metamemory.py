"""Quality of a result set: signals, flags and answerability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ActivationConfig, MetamemoryConfig
from ..functions.maths import half_life, saturation, sigmoid

CFG = MetamemoryConfig()


def weighted_mean(score: Column, value: Column) -> Column:
    """An aggregate: mean by score, the plain mean if scores add up to 0, 0 without rows."""
    total = F.sum(score)
    return F.coalesce(F.when(total > 0, F.sum(score * value) / total).otherwise(F.avg(value)), F.lit(0.0))


def conflict(status: Column, contra: Column, support: Column) -> Column:
    return F.when(status == "contested", 1.0).when(status == "superseded", 0.0).otherwise(F.when(contra + support > 0, contra / (contra + support)).otherwise(0.0))


def pressure(base: Column, threshold: float = ActivationConfig().threshold) -> Column:
    return 1 - sigmoid(base - threshold)


def freshness(age: Column, cfg: MetamemoryConfig = CFG) -> Column:
    return F.lit(1.0) if cfg.half_life_seconds is None else half_life(F.greatest(age, F.lit(0.0)), cfg.half_life_seconds)


def diversity(observations: Column, cfg: MetamemoryConfig = CFG) -> Column:
    """Of a number of distinct observations."""
    return saturation(F.greatest(F.lit(0), observations - 1), cfg.diversity_tau)


def cue_coverage(results: DataFrame, by: str, cue: str, tokens: str) -> DataFrame:
    """(by, coverage): share of the cue's tokens that some result has."""
    union = F.array_distinct(F.flatten(F.collect_set(tokens)))
    agg = results.groupBy(by).agg(F.first(cue).alias("__cue"), union.alias("__all"))
    return agg.select(by, F.when(F.size("__cue") == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("__cue", "__all")) / F.size("__cue")).alias("coverage"))


def flags(df: DataFrame, cfg: MetamemoryConfig = CFG) -> DataFrame:
    """Adds ``flags`` from coverage, strength, evidence, conflict, diversity, pressure and utility."""
    rules = [
        ("low_cue_coverage", F.col("coverage") < cfg.low_cue),
        ("weak_activation", F.col("strength") < cfg.low_strength),
        ("low_evidence", F.col("evidence") < cfg.low_evidence),
        ("conflicting", F.col("conflict") >= cfg.conflict),
        ("low_diversity", F.col("diversity") < cfg.low_diversity),
        ("fading", F.col("pressure") >= cfg.pressure),
        ("low_utility", F.col("utility") < cfg.low_utility),
        ("missing_knowledge", (F.col("coverage") < cfg.missing_coverage) | (F.col("strength") < cfg.missing_strength)),
    ]
    return df.withColumn("flags", F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules)), lambda x: x.isNotNull()))


def answerability(slot_like: Column, mode: Column, match: Column, obj: Column, status: Column) -> Column:
    """An aggregate: resolved if a matching fact with an object is there, active for current cues."""
    fine = F.bool_or(match & (F.trim(F.coalesce(obj, F.lit(""))) != "") & ((mode != "current") | (status == "active")))
    return F.when(~F.bool_or(slot_like), "not_applicable").when(F.coalesce(fine, F.lit(False)), "resolved").otherwise("unresolved")
