"""Facts from observation metadata, and their consolidation across episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ConsolidationConfig
from ..functions.maths import clip
from ..functions.text import canonical_text, hash_parts, qualifier_pairs

FACT = "array<struct<predicate:string,object_value:string,object_entity_id:string,subject_entity_id:string,polarity:string,cardinality:string,confidence:double,valid_from:string,valid_until:string,qualifiers:map<string,string>>>"


def extract(df: DataFrame, facts: str, subject: str) -> DataFrame:
    """One row per fact in a JSON column, an array or a single object; ``failed`` marks those that can't be used."""
    text = F.trim(F.col(facts))
    whole = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    rows = df.withColumn("f", F.explode(F.from_json(whole, FACT))).drop(facts)
    polarity, cardinality = F.coalesce("f.polarity", F.lit("affirm")), F.coalesce("f.cardinality", F.lit("many"))
    time = lambda c: F.try_to_timestamp(c)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = blank(F.col("f.predicate")) | blank(F.col("f.object_value")) | ~polarity.isin("affirm", "deny") | ~cardinality.isin("one", "many")
    for c in ("f.valid_from", "f.valid_until"):
        bad = bad | (F.col(c).isNotNull() & (time(F.col(c)).isNull() | ~F.col(c).rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")))
    return rows.select(
        *(c for c in df.columns if c != facts),
        F.col("f.predicate").alias("predicate"), F.col("f.object_value").alias("object_value"), F.col("f.object_entity_id").alias("object_entity_id"),
        F.coalesce("f.subject_entity_id", F.col(subject).cast("string")).alias("subject_entity_id"), polarity.alias("polarity"), cardinality.alias("cardinality"),
        F.coalesce("f.confidence", F.lit(1.0)).alias("fact_confidence"), time(F.col("f.valid_from")).alias("valid_from"), time(F.col("f.valid_until")).alias("valid_until"),
        F.col("f.qualifiers").alias("qualifiers"), bad.alias("failed"),
    )


def slot_and_claim(tenant: Column, subject: Column, predicate: Column, qualifiers: Column, obj: Column, polarity: Column) -> tuple[Column, Column]:
    """Keys of the slot (subject, predicate, qualifiers) and of the claim made in it."""
    slot = hash_parts(tenant, F.coalesce(subject, F.lit("__none__")), canonical_text(predicate), F.array_join(qualifier_pairs(qualifiers), ","))
    return slot, hash_parts(slot, canonical_text(obj), polarity)


def claim_statement(subject: Column, predicate: Column, obj: Column, polarity: Column, qualifiers: Column | None = None) -> Column:
    """The claim as a sentence, qualifiers in brackets."""
    verb = F.translate(predicate, "_", " ")
    said = F.concat_ws(" ", F.coalesce(subject, F.lit("subject")), F.when(polarity == "deny", F.concat(F.lit("does not "), verb)).otherwise(verb), obj)
    if qualifiers is None:
        return said
    pairs = F.array_join(qualifier_pairs(qualifiers), ", ")
    return F.when(pairs == "", said).otherwise(F.concat(said, F.lit(" ("), pairs, F.lit(")")))


def best_per_episode(candidates: DataFrame, order: str) -> DataFrame:
    """One candidate per (episode, claim): the most confident, the first in a tie."""
    w = Window.partitionBy("episode_id", "claim_key").orderBy(F.desc("fact_confidence"), order)
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def claim_confidence(mass: Column, contra: Column, namespaces: Column, cfg: ConsolidationConfig = ConsolidationConfig()) -> Column:
    spread = 0.8 + 0.2 * F.least(F.lit(1.0), namespaces / F.lit(float(cfg.diversity_target)))
    return clip((1 - F.exp(-mass / F.lit(cfg.tau))) * F.when(mass + contra > 0, mass / (mass + contra)).otherwise(0.0) * spread)


def consolidate(candidates: DataFrame, cfg: ConsolidationConfig = ConsolidationConfig()) -> DataFrame:
    """Claims that enough episodes support, by slot, claim and validity.

    Input: episode_id, namespace, slot_key, claim_key, fact_confidence,
    episode_confidence, importance, observed_at, valid_from, valid_until. Both
    the claim and its validity must have ``least_episodes`` episodes;
    namespaces are counted over the claim.
    """
    weight = F.col("fact_confidence") * F.col("episode_confidence") * (0.5 + 0.5 * F.col("importance"))
    claim = ["slot_key", "claim_key"]
    wide = candidates.groupBy(*claim).agg(F.countDistinct("episode_id").alias("claim_episodes"), F.countDistinct("namespace").alias("namespaces")).where(F.col("claim_episodes") >= cfg.least_episodes)
    narrow = candidates.groupBy(*claim, "valid_from", "valid_until").agg(
        F.countDistinct("episode_id").alias("support_count"), F.sum(weight).alias("support_mass"), (0.6 * F.max("importance") + 0.4 * F.avg("importance")).alias("importance"), F.min("observed_at").alias("first_supported_at"), F.max("observed_at").alias("last_supported_at")
    )
    out = narrow.where(F.col("support_count") >= cfg.least_episodes).join(wide, claim)
    return out.withColumn("confidence", claim_confidence(F.col("support_mass"), F.lit(0.0), F.col("namespaces"), cfg))


def flatten_evidence(df: DataFrame, by: list[str], observation: str, weight: Column) -> DataFrame:
    """(by, evidence): for each observation the largest weight (1 at most), sorted and numbered from 0."""
    best = df.groupBy(*by, observation).agg(F.max(F.least(F.lit(1.0), weight)).alias("w"))
    w = Window.partitionBy(*by).orderBy(observation)
    return best.withColumn("sequence_number", F.row_number().over(w) - 1).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("sequence_number", F.col(observation).alias("observation_id"), F.col("w").alias("contribution_score")))).alias("evidence"))
