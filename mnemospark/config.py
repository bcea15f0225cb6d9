"""Settings of the memory operators; the defaults are part of their semantics."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ActivationConfig:
    decay: float = 0.5
    constant: float = 0.0
    source_activation: float = 1.0
    associative_strength: float = 1.0
    mismatch_penalty: float = 1.0
    threshold: float = -3.0
    latency_factor: float = 1.0
    latency_exponent: float = 1.0
    unit_seconds: float = 3600.0
    least_seconds: float = 1.0
    spread_decay: float = 0.5
    hops: int = 2
    least_activation: float = 0.01
    learned_scale: float = 0.25
    collapse_jaccard: float = 0.75
    current_weight: float = 0.5
    current_tokens: tuple[str, ...] = ("currently", "current", "now", "live", "today")
    seeded_weight: float = 0.75
    conjunction_weight: float = 0.5
    incident_scale: float = 1.5
    incident_tokens: tuple[str, ...] = ("incident", "on", "call", "alert", "woke", "3am", "am", "overnight")
    max_candidates: int | None = None
    slot_admission: bool = True
    entity_admission: bool = True
    admission_requires_state: bool = True
    force_admission: bool = False


@dataclass(frozen=True)
class ForgettingConfig:
    fading: float = 0.25
    forgotten: float = 0.05
    grace_seconds: float = 604_800.0
    compact_after_seconds: float = 2_592_000.0
    bucket_seconds: int = 86_400
    importance_floor: float = 0.15
    scale_importance: bool = True


@dataclass(frozen=True)
class WorkingMemoryConfig:
    pool: int = 50
    max_items: int = 8
    max_tokens: int = 2048
    weights: tuple[float, float, float, float] = (0.45, 0.35, 0.15, 0.05)
    least_relevance: float = 0.0
    least_score: float = 0.0
    inhibition: float = 0.30
    redundancy: float = 0.70
    half_life_seconds: float = 300.0
    utility_weight: float = 0.10
    stale_penalty: float = 0.35


@dataclass(frozen=True)
class LearningConfig:
    prior_helpful: float = 1.0
    prior_unhelpful: float = 1.0
    incorrect_weight: float = 1.0
    tau: float = 3.0
    least_coactivations: int = 2
    max_items: int = 8


@dataclass(frozen=True)
class MetamemoryConfig:
    report: int = 8
    low_cue: float = 0.40
    low_strength: float = 0.40
    low_evidence: float = 0.50
    conflict: float = 0.25
    low_diversity: float = 0.30
    diversity_tau: float = 3.0
    pressure: float = 0.70
    low_utility: float = 0.35
    stale: float = 0.25
    half_life_seconds: float | None = None
    missing_coverage: float = 0.35
    missing_strength: float = 0.45


@dataclass(frozen=True)
class ConsolidationConfig:
    least_episodes: int = 2
    tau: float = 1.5
    diversity_target: int = 2
    contested_ratio: float = 0.25
    gap_seconds: float = 1800.0
    statement_chars: int = 2000
