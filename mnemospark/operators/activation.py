"""Ranking of memories for cues: usage decay, text fit, field match, slots and policy.

Everything is keyed by cue, so a batch of cues is ranked in one plan; a single
cue is the case of one row. Candidates and cues carry token arrays, made once.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ActivationConfig
from ..functions.maths import log_term, seconds_between, sigmoid
from ..functions.text import jaccard
from ..functions.text import tokens as word_tokens
from .textfit import text_pairs

CFG = ActivationConfig()


def base_level(traces: DataFrame, by: list[str], at: str, as_of: Column, weight: str | None = None, cfg: ActivationConfig = CFG) -> DataFrame:
    """(by, base_level, traces): log of the weighted sum of decayed ages, as a stable log-sum-exp.

    A trace after ``as_of`` is an error.
    """
    age = seconds_between(F.col(at), as_of)
    age = F.when(age < 0, F.raise_error(F.lit("a trace is later than the evaluation time")).cast("double")).otherwise(age)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = traces.select(*by, (log_term(age, cfg.decay, cfg.unit_seconds, cfg.least_seconds) + F.log(w)).alias("x"))
    # the largest term is taken out, so that many or very old traces neither overflow nor vanish
    agg = rows.groupBy(*by).agg(F.max("x").alias("m"), F.count(F.lit(1)).alias("traces"))
    names = {k: f"m_{k}" for k in by}
    joined = rows.join(agg.withColumnsRenamed(names), functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(v)) for k, v in names.items())))
    return joined.groupBy(*by).agg((F.max("m") + F.log(F.sum(F.exp(F.col("x") - F.col("m")))) + cfg.constant).alias("base_level"), F.max("traces").alias("traces"))


def base_level_sum(traces: DataFrame, by: list[str], at: str, as_of: Column, weight: str | None = None, cfg: ActivationConfig = CFG) -> DataFrame:
    """Like :func:`base_level`, summed directly in one aggregation; the ages' powers are far from a double's ends."""
    age = seconds_between(F.col(at), as_of)
    age = F.when(age < 0, F.raise_error(F.lit("a trace is later than the evaluation time")).cast("double")).otherwise(age)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    term = w * F.exp(log_term(age, cfg.decay, cfg.unit_seconds, cfg.least_seconds))
    return traces.groupBy(*by).agg((F.log(F.sum(term)) + cfg.constant).alias("base_level"), F.count(F.lit(1)).alias("traces"))


def idf(docs: DataFrame, tokens: str, n: Column) -> DataFrame:
    """(token, df, idf) over the candidates; ``n`` is their number."""
    rows = docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return rows.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)


def idf_by(docs: DataFrame, tokens: str, by: list[str]) -> DataFrame:
    """(by, token, df, idf): idf within each group, whose candidates the others don't change."""
    n = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = docs.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"))
    return rows.join(n, by).select(*by, "token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def incident_scale(cue_tokens: Column, cfg: ActivationConfig = CFG) -> Column:
    """What the idf of a cue's tokens is multiplied by: more if it speaks of an incident."""
    return F.when(F.arrays_overlap(cue_tokens, F.array(*(F.lit(t) for t in cfg.incident_tokens))), F.lit(cfg.incident_scale)).otherwise(F.lit(1.0))


def weighted_text_fit(docs: DataFrame, doc_id: str, tokens: str, cues: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(cue_id, doc_id, coverage, f1): shares of idf mass.

    ``cues``: cue_id, tokens (distinct), and the columns ``by``, in which a
    cue and its documents agree. Only pairs that share a token are made, and
    by each document on its own (:mod:`.textfit`). A cue token that no document has weighs as
    much as one of no count; a column ``scale`` of the cues multiplies theirs.
    """
    return text_pairs(docs, doc_id, tokens, cues, weights, by).select("cue_id", doc_id, "coverage", "f1")


def partial_match(similarities: dict[str, tuple[Column, float]], penalty: float = 1.0) -> Column:
    """Weighted mean shortfall of the supplied fields (null similarity: not supplied); 0 without any."""
    top = functools.reduce(operator.add, (F.coalesce(w * (s - 1), F.lit(0.0)) for s, w in similarities.values()))
    by = functools.reduce(operator.add, (F.when(s.isNotNull(), w).otherwise(0.0) for s, w in similarities.values()))
    return F.when(by > 0, penalty * top / by).otherwise(F.lit(0.0))


def temporal_mode(valid_at: Column, cue_tokens: Column, predicate: Column, obj: Column, cfg: ActivationConfig = CFG) -> Column:
    words = F.array(*(F.lit(t) for t in cfg.current_tokens))
    current = F.arrays_overlap(cue_tokens, words) | predicate.isNotNull() | obj.isNotNull()
    return F.when(valid_at.isNotNull(), "historical").when(current, "current").otherwise("neutral")


def current_state(kind: Column, status: Column, statuses: Column, matched: Column, lexical: Column, supported: Column, cfg: ActivationConfig = CFG) -> Column:
    """The term for current-state cues, of matched slots and the episodes that support them."""
    w = cfg.current_weight
    active = status == "active"
    semantic = F.when(status == "superseded", F.lit(-w)).otherwise(0.5 * w * active.cast("int") + 0.25 * w * supported.cast("int") + w * (lexical & active).cast("int"))
    has = lambda x: F.array_contains(statuses, x)
    episode = F.when(lexical, w * has("active").cast("int") - w * has("superseded").cast("int")).otherwise(F.lit(0.0))
    return F.when(matched, F.when(kind == "semantic", semantic).otherwise(episode)).otherwise(F.lit(0.0))


def conjunction(cue_entities: Column, entities: Column, cfg: ActivationConfig = CFG) -> Column:
    both = (F.size(cue_entities) >= 2) & (F.size(F.array_intersect(cue_entities, entities)) >= 2)
    return F.when(both, cfg.conjunction_weight).otherwise(0.0)


def slot_match(predicate: Column, obj: Column, entities: Column, cue_predicate: Column, cue_object: Column, cue_entities: Column) -> Column:
    """Supplied fields must all match (canonical forms); false if none is supplied."""
    field = lambda c, x: c.isNull() | c.eqNullSafe(x)
    some = cue_predicate.isNotNull() | cue_object.isNotNull() | (F.size(cue_entities) > 0)
    return some & field(cue_predicate, predicate) & field(cue_object, obj) & ((F.size(cue_entities) == 0) | F.arrays_overlap(cue_entities, entities))


def slot_fit(applies: Column, match: Column, mode: Column, status: Column) -> Column:
    fits = match & ((mode == "neutral") | (mode == "historical") | ((mode == "current") & (status == "active")))
    return F.when(applies, fits.cast("double"))


def support_statuses(derivations: DataFrame) -> DataFrame:
    """(episode_id, statuses, provenance) from (episode_id, memory_key, revision_key, slot_key, status)."""
    return derivations.groupBy("episode_id").agg(F.array_sort(F.collect_set("status")).alias("statuses"), F.array_sort(F.collect_list(F.struct("slot_key", "memory_key", "revision_key"))).alias("provenance"))


def superseded_only(statuses: Column) -> Column:
    return F.coalesce(F.array_contains(statuses, "superseded") & ~F.array_contains(statuses, "active"), F.lit(False))


def scored(df: DataFrame, base: str, spread: str, cover: str, fit: str, current: Column, conj: Column, adjustment: Column, cfg: ActivationConfig = CFG) -> DataFrame:
    """Adds activation, rank_activation, score and latency_seconds.

    Coverage and fit enter as penalties (similarity less 1).
    """
    part = lambda c: cfg.mismatch_penalty * (F.col(c) - 1)
    activation = F.col(base) + F.col(spread) + part(cover) + current + conj
    out = df.withColumn("activation", activation).withColumn("rank_activation", F.col("activation") - part(cover) + part(fit) + adjustment)
    return out.withColumn("score", sigmoid(F.col("activation") - cfg.threshold)).withColumn("latency_seconds", cfg.latency_factor * F.exp(-cfg.latency_exponent * F.col("activation")))


def eligible(df: DataFrame, admitted: Column | None = None, cfg: ActivationConfig = CFG) -> DataFrame:
    """Rows at the threshold or above, or admitted past it."""
    over = F.col("activation") >= cfg.threshold
    return df.where(over if admitted is None else over | F.coalesce(admitted, F.lit(False)))


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k of each group with ``rank``; Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def seed_entities(candidates: DataFrame, entities: str, cues: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(cue_id, seeds): entities of candidates that a cue's tokens name, in whole or by one of their tokens."""
    keys = by or []
    every = candidates.select(*keys, F.explode(entities).alias("entity")).distinct()
    named = every.withColumn("token", F.explode(F.array_union(word_tokens(F.col("entity")), F.array(F.lower("entity")))))
    found = cues.select("cue_id", *keys, F.explode("tokens").alias("token")).join(named, [*keys, "token"])
    return found.groupBy("cue_id").agg(F.array_sort(F.collect_set("entity")).alias("seeds"))


def entity_similarity(cue: Column, entities: Column, seeded: bool = False, cfg: ActivationConfig = CFG) -> Column:
    return F.when(F.size(cue) > 0, jaccard(cue, entities) * (cfg.seeded_weight if seeded else 1.0))


def guard_candidates(df: DataFrame, cfg: ActivationConfig = CFG) -> DataFrame:
    """``df``; an error if there are more candidates than allowed (no limit by default)."""
    if cfg.max_candidates is not None and df.limit(cfg.max_candidates + 1).count() > cfg.max_candidates:
        raise ValueError(f"more than {cfg.max_candidates} candidates")
    return df
