"""Structured cues: what their text names, the slots they ask for, and what follows for ranking.

Rows are pairs of a cue and a candidate. A cue has cue_tokens, cue_entities
(given explicitly), seeds (entities its text names), effective (explicit, else
seeds and tags), cue_predicate, cue_object, mode and lexical (asks for the
present state); a candidate has kind, status, predicate, object_value,
entities, tokens and object_tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ActivationConfig
from ..functions.text import canonical_text, same, tokens

CFG = ActivationConfig()


def _none() -> Column:
    return F.array().cast("array<string>")


def _named() -> Column:
    return F.col("cue_predicate").isNotNull() | F.col("cue_object").isNotNull()


def normalise_cues(cues: DataFrame, subject_id: str | None = None) -> DataFrame:
    """Cues with every field: text trimmed and null if blank, tokens, explicit entities, the given subject where there is none.

    A cue that has neither a text nor a field is an error.
    """
    have = dict(cues.dtypes)
    field = lambda name: F.when(F.trim(name) != "", F.trim(name)) if name in have else F.lit(None).cast("string")
    entities = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col("entity_ids"), _none()), lambda x: F.trim(x) != ""))) if "entity_ids" in have else _none()
    rows = cues.select("cue_id", F.col("tenant_id").alias("cue_tenant"), field("text").alias("cue_text"), F.coalesce(field("subject_id"), F.lit(subject_id)).alias("cue_subject"), field("predicate").alias("cue_predicate"), field("object_value").alias("cue_object"), entities.alias("cue_entities"))
    empty = F.coalesce("cue_text", "cue_subject", "cue_predicate", "cue_object").isNull() & (F.size("cue_entities") == 0)
    checked = F.when(empty, F.raise_error(F.lit("a cue needs a text or a field")).cast("string")).otherwise(F.col("cue_text"))
    return rows.withColumn("cue_text", checked).withColumn("cue_tokens", tokens(F.col("cue_text")))


def seed_tags(candidates: DataFrame, tags: str, cues: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(cue_id, tags): tags of candidates, in canonical form with hyphens, that are a cue's tokens."""
    keys = by or []
    named = candidates.select(*keys, F.explode(tags).alias("tag")).select(*keys, F.regexp_replace(canonical_text(F.col("tag")), " ", "-").alias("token")).where("token <> ''").distinct()
    found = cues.select("cue_id", *keys, F.explode("cue_tokens").alias("token")).join(named, [*keys, "token"])
    return found.groupBy("cue_id").agg(F.array_sort(F.collect_set("token")).alias("tags"))


def effective_entities(explicit: Column, seeds: Column, tags: Column) -> Column:
    return F.when(F.size(explicit) > 0, explicit).otherwise(F.array_sort(F.array_union(seeds, tags)))


def slot_sources() -> Column:
    """The entities that slots are matched by; tags aren't among them."""
    return F.when(F.size("cue_entities") > 0, F.col("cue_entities")).otherwise(F.col("seeds"))


def _fields() -> Column:
    fits = lambda cue, x: F.col(cue).isNull() | (same(F.col(cue), F.col(x)) == 1)
    return fits("cue_predicate", "predicate") & fits("cue_object", "object_value")


def matches(cfg: ActivationConfig = CFG) -> Column:
    """Whether a candidate is in a slot that the cue asks for.

    Given fields must all match, and entities that the text names must meet
    the candidate's where a predicate or an object is given. Without fields
    the named entities decide; without these, cues for the present state match
    by the tokens that don't just say so.
    """
    sources, explicit = slot_sources(), _named() | (F.size("cue_entities") > 0)
    meets = F.arrays_overlap(sources, F.col("entities"))
    given = _fields() & ((F.size("cue_entities") == 0) | meets) & ~((F.size("cue_entities") == 0) & (F.size(sources) > 0) & _named() & ~meets)
    rest = F.array_except("cue_tokens", F.array(*(F.lit(t) for t in cfg.current_tokens)))
    lexical = F.col("lexical") & F.arrays_overlap(rest, F.array_union("tokens", "object_tokens"))
    return F.coalesce(F.when(explicit, given).when(F.size(sources) > 0, meets).otherwise(lexical), F.lit(False))


def admission_active(cfg: ActivationConfig = CFG) -> Column:
    """Whether a cue may admit slots past the threshold."""
    if not cfg.slot_admission:
        return F.lit(False)
    if cfg.force_admission or not cfg.admission_requires_state:
        return F.lit(True)
    entities = (F.size(slot_sources()) > 0) if cfg.entity_admission else F.lit(False)
    return (F.col("mode") == "historical") | entities | F.col("lexical") | F.col("cue_predicate").isNotNull()


def admitted(pairs: DataFrame, derivations: DataFrame, live: bool, cfg: ActivationConfig = CFG) -> DataFrame:
    """(cue_id, kind, key): matched facts (active ones if ``live``) and the episodes that support them.

    ``derivations``: memory_key, episode_id, of supports.
    """
    facts = pairs.where((F.col("kind") == "semantic") & admission_active(cfg) & matches(cfg))
    facts = (facts.where("status = 'active'") if live else facts).select("cue_id", F.col("key").alias("memory_key")).distinct()
    episodes = facts.join(derivations.select("memory_key", "episode_id").distinct(), "memory_key").select("cue_id", F.lit("episode").alias("kind"), F.col("episode_id").alias("key"))
    return facts.select("cue_id", F.lit("semantic").alias("kind"), F.col("memory_key").alias("key")).unionByName(episodes).distinct()


def admission_label(cfg: ActivationConfig = CFG) -> Column:
    entities = (F.size("cue_entities") > 0) | ((F.size("seeds") > 0) if cfg.entity_admission else F.lit(False))
    return F.when(F.col("mode") == "historical", "historical_slot_admission").when(entities, "entity_slot_admission").otherwise("semantic_slot_admission")


def fit_of_fact() -> Column:
    """1 for a fact in the cue's slot and time, 0 for another, null where the cue asks for no slot."""
    given, neutral = F.size("cue_entities") > 0, F.col("mode") == "neutral"
    applies = _named() | (~neutral & (F.size("effective") > 0))
    required = F.when(given, F.col("cue_entities")).when(_named() | ~neutral, F.col("effective")).otherwise(_none())
    fits = _fields() & ((F.size(required) == 0) | F.arrays_overlap(required, F.col("entities")))
    timely = neutral | (F.col("mode") == "historical") | (F.col("status") == "active")
    return F.when(applies & (F.col("kind") == "semantic"), F.coalesce(fits & timely, F.lit(False)).cast("double"))


def inherited_fits(fits: DataFrame, derivations: DataFrame) -> DataFrame:
    """(cue_id, episode_id, slot_fit, revision_key): of the facts that an episode supports the best fit.

    ``fits``: cue_id, memory_key, slot_fit; ``derivations``: memory_key,
    revision_key, episode_id, contribution. Ties go to the larger
    contribution, then to the later revision key.
    """
    rows = derivations.join(fits.where("slot_fit is not null"), "memory_key")
    best = rows.groupBy("cue_id", "episode_id").agg(F.max(F.struct("slot_fit", "contribution", "revision_key")).alias("b"))
    return best.select("cue_id", "episode_id", "b.slot_fit", "b.revision_key")


def adjustment(fit: Column, cfg: ActivationConfig = CFG) -> Column:
    return F.coalesce(cfg.mismatch_penalty * (fit - 0.5), F.lit(0.0))


def episode_slots(live: DataFrame, superseded: DataFrame) -> DataFrame:
    """(episode_id, slot_key): of the facts that an episode supports the last one's, superseded ones coming after live ones.

    Both have episode_id, slot_key and place, their order.
    """
    both = live.withColumn("part", F.lit(0)).unionByName(superseded.withColumn("part", F.lit(1)))
    return both.groupBy("episode_id").agg(F.max_by("slot_key", F.struct("part", "place")).alias("slot_key"))


def reason() -> Column:
    """A line that explains a ranked row."""
    n = lambda name, c, digits=3: F.concat(F.lit(f"{name}="), F.format_string(f"%.{digits}f", F.col(c)))
    some = lambda c, text: F.when(F.col(c).isNotNull(), text)
    matched = F.concat(F.lit("matched_entities="), F.size(F.array_intersect("effective", "entities")).cast("string"), F.lit("/"), F.size("effective").cast("string"))
    parts = [n("activation", "activation"), n("base", "base_level"), n("spread", "spread"), F.concat(F.lit("references="), F.col("traces").cast("string")), matched, F.concat(F.lit("temporal_mode="), F.col("mode")), F.concat(F.lit("eligibility="), F.col("eligibility"))]
    parts += [n("rank_activation", "rank_activation"), n("text_coverage", "coverage"), n("text_cue_fit", "f1"), some("slot_fit", n("slot_fit", "slot_fit", 2)), n("current_state", "current_state"), n("conjunction", "conjunction")]
    return F.concat_ws("; ", *parts)
