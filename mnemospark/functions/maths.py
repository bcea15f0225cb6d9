"""Scalar numeric and temporal functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def saturation(x: Column, tau: float) -> Column:
    return 1 - F.exp(-x / F.lit(float(tau)))


def half_life(age: Column, seconds: float) -> Column:
    return F.pow(F.lit(2.0), -age / F.lit(float(seconds)))


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, microseconds kept."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6)


def time_bucket(t: Column, seconds: int) -> Column:
    """Start of the bucket, in seconds since the epoch."""
    return F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(1_000_000 * seconds)) * seconds


def valid_at(start: Column, end: Column, t: Column) -> Column:
    """Whether t is in [start, end), null ends being open."""
    return (start.isNull() | (t >= start)) & (end.isNull() | (t < end))


def interval_relation(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """before, after, overlaps or unknown, of half-open intervals with open ends."""
    none = a0.isNull() & a1.isNull() & b0.isNull() & b1.isNull()
    return (
        F.when(none, "unknown")
        .when((a0.isNull() & a1.isNull()) | (b0.isNull() & b1.isNull()), "overlaps")
        .when(F.coalesce(a1 <= b0, F.lit(False)), "before")
        .when(F.coalesce(b1 <= a0, F.lit(False)), "after")
        .otherwise("overlaps")
    )


def update_relation(same_claim: Column, same_object: Column, same_polarity: Column, one: Column, relation: Column, same_cardinality: Column | None = None, same_slot: Column | None = None, same_validity: Column | None = None) -> Column:
    """How a new claim relates to one that is there; ``one``: the new one's slot holds one value at a time.

    Claims of one slot whose cardinalities differ conflict, and so do opposite
    polarities of one object at overlapping or unknown times.
    """
    no, yes = F.lit(False), F.lit(True)
    differs, slot, valid = (no if same_cardinality is None else ~same_cardinality), (yes if same_slot is None else same_slot), (no if same_validity is None else same_validity)
    apart = relation.isin("before", "after")
    return (
        F.when(same_claim & (valid | relation.isin("overlaps", "unknown")), "reinforces")
        .when(~same_claim & ~slot, "coexists")
        .when(~one, "coexists")
        .when(differs, "conflicts")
        .when(same_object & ~same_polarity, F.when(apart, "supersedes").otherwise("conflicts"))
        .when(~slot, "coexists")
        .when(apart, "supersedes")
        .otherwise("conflicts")
    )


def log_term(age: Column, decay: float, unit: float, least: float) -> Column:
    """Log of a trace's weightless contribution to a base level."""
    return -F.lit(float(decay)) * F.log(F.greatest(age, F.lit(float(least))) / F.lit(float(unit)))


LN2 = math.log(2.0)
