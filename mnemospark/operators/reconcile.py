"""Revisions of slots: an ordered fold, conflict partners and current projections.

A slot's candidates come in order of validity; each is merged with the
revision of its key, or compared with the others of the slot. The fold needs
the order, so it runs over rows sorted by slot; one slot's candidates are its
only state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ConsolidationConfig
from ..functions.maths import valid_at

REVISION = "slot_key string, memory_key string, revision_key string, object_value string, cardinality string, valid_from timestamp, valid_until timestamp, support_count long, support_mass double, importance double, status string, update_relation string, conflicts array<string>, superseded_by array<string>, namespaces long"


def iso_utc(t: Column) -> Column:
    """A time as ISO 8601 in UTC, with microseconds where there are any."""
    utc = F.to_utc_timestamp(t.cast("timestamp"), F.current_timezone())
    micros = F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def revision_key(memory_key: Column, start: Column, end: Column) -> Column:
    marker = F.when(start.isNotNull(), iso_utc(start)).when(end.isNotNull(), F.concat(F.lit("end:"), iso_utc(end))).otherwise("unspecified")
    return F.sha2(F.concat_ws("\x1f", memory_key, marker), 256)


def semantic_fingerprint(claim_key: Column, status: Column, confidence: Column, importance: Column, supports: Column, contradictions: Column, evidence: Column, versions: tuple[str, str] = ("1", "1")) -> Column:
    """SHA-256 over a memory's content; numbers have six places.

    ``supports`` and ``contradictions``: arrays of (episode_id, weight);
    ``evidence``: an array of (observation_id, observation_revision,
    contribution_score), in its order.
    """
    six = lambda x: F.format_string("%.6f", x)
    pairs = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: F.concat_ws("\x1f", x["episode_id"], six(x["weight"]))), "\x1e")
    seen = F.array_join(F.transform(evidence, lambda x: F.concat_ws("\x1f", x["observation_id"], x["observation_revision"].cast("string"), six(x["contribution_score"]))), "\x1e")
    return F.sha2(F.concat_ws("\x1f", claim_key, status, six(confidence), six(importance), pairs(supports), pairs(contradictions), seen, *(F.lit(v) for v in versions)), 256)


def consolidation_counters(claims: DataFrame, revisions: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row: canonical claims, promoted memories, contested and superseded revisions, and created and kept revision keys."""
    found = claims.agg(F.countDistinct("claim_key").alias("canonical_claims"))
    old = revisions.select("revision_key").limit(0) if before is None else before.select("revision_key").distinct()
    r = revisions.join(old.withColumn("there", F.lit(True)), "revision_key", "left")
    counted = r.agg(F.countDistinct("memory_key").alias("promoted"), F.count_if(F.col("there").isNull()).alias("created"), F.count_if("there").alias("kept"), *(F.count_if(F.col("status") == x).alias(x) for x in ("active", "contested", "superseded")))
    # two single rows
    return found.crossJoin(counted)


def _relation(a: dict, b: dict) -> str:
    ends = (a["valid_from"], a["valid_until"], b["valid_from"], b["valid_until"])
    if all(x is None for x in ends):
        return "unknown"
    if ends[:2] == (None, None) or ends[2:] == (None, None):
        return "overlaps"
    if None not in (ends[1], ends[2]) and ends[1] <= ends[2]:
        return "before"
    if None not in (ends[3], ends[0]) and ends[3] <= ends[0]:
        return "after"
    return "overlaps"


def fold(rows: list[dict]) -> list[dict]:
    """The revisions that a slot's candidates make, taken by validity, memory and revision key. Times are microseconds."""
    kept: dict[str, dict] = {}
    live: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["valid_from"] is not None, r["valid_from"] or 0, r["memory_key"], r["revision_key"])):
        key = r["revision_key"]
        if key in kept:
            k = kept[key]
            k["support_count"], k["support_mass"] = max(k["support_count"], r["support_count"]), max(k["support_mass"], r["support_mass"])
            k["importance"], k["update_relation"] = r["importance"], "reinforces"
            continue
        r = r | {"status": "active", "update_relation": "created", "conflicts": [], "superseded_by": []}
        others = [k for k in live.values() if k["memory_key"] != r["memory_key"]] if r["cardinality"] == "one" else []
        apart = [k for k in others if _relation(k, r) in ("before", "after")]
        if apart:
            r["update_relation"] = "supersedes"
            for k in apart:
                k["status"] = "superseded"
                k["superseded_by"].append(key)
                k["valid_until"] = k["valid_until"] if r["valid_from"] is None else r["valid_from"]
                del live[k["revision_key"]]
        elif others:
            r["status"], r["update_relation"] = "contested", "conflicts"
            for k in others:
                k["status"] = "contested"
                k["conflicts"].append(key)
                r["conflicts"].append(k["revision_key"])
        kept[key] = live[key] = r
    return list(kept.values())


#: Arrow types of revisions that aren't strings.
_STRINGS, _STAMP = pa.list_(pa.string()), pa.timestamp("us", "UTC")
_KINDS = {"support_count": pa.int64(), "namespaces": pa.int64(), "support_mass": pa.float64(), "importance": pa.float64(), "conflicts": _STRINGS, "superseded_by": _STRINGS, "valid_from": _STAMP, "valid_until": _STAMP}


def _fold_slots(names: list[str]):
    """Candidates, sorted by slot, to revisions; many slots go through one batch."""

    def plain(b: pa.RecordBatch) -> list[dict]:
        columns = [c.cast(_STAMP).cast(pa.int64()) if pa.types.is_timestamp(c.type) else c for c in b.columns]
        return pa.RecordBatch.from_arrays(columns, b.schema.names).to_pylist()

    def made(rows: list[dict]) -> pa.RecordBatch:
        column = lambda n: pa.array([r[n] for r in rows], pa.int64() if _KINDS.get(n) == _STAMP else _KINDS.get(n, pa.string()))
        return pa.RecordBatch.from_arrays([column(n).cast(_STAMP) if _KINDS.get(n) == _STAMP else column(n) for n in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot: list[dict] = []  # it may go on in the next batch
        for b in batches:
            out: list[dict] = []
            for r in plain(b):
                if slot and slot[0]["slot_key"] != r["slot_key"]:
                    out += fold(slot)
                    slot = []
                slot.append(r)
            yield made(out)
        if slot:
            yield made(fold(slot))

    return run


def reconcile(candidates: DataFrame, cfg: ConsolidationConfig = ConsolidationConfig()) -> DataFrame:
    """Revisions with status, conflicts, confidence and a number within their memory.

    Input: slot_key, memory_key, object_value, cardinality, valid_from,
    valid_until, support_count, support_mass, importance, namespaces.
    """
    names = [x.split()[0] for x in REVISION.split(", ")]
    keyed = candidates.withColumn("revision_key", revision_key(F.col("memory_key"), F.col("valid_from"), F.col("valid_until")))
    folded = keyed.repartition("slot_key").sortWithinPartitions("slot_key").mapInArrow(_fold_slots(names), REVISION)
    mass, contra = F.greatest(F.col("support_count").cast("double"), F.col("support_mass")), F.size(F.array_distinct("conflicts"))
    spread = 0.8 + 0.2 * F.least(F.lit(1.0), F.col("namespaces") / F.lit(float(cfg.diversity_target)))
    confidence = F.least(F.lit(1.0), (1 - F.exp(-mass / F.lit(cfg.tau))) * (mass / (mass + contra)) * spread)
    contested = (F.col("status") != "superseded") & (contra / (F.col("support_count") + contra) >= cfg.contested_ratio)
    w = Window.partitionBy("memory_key").orderBy(F.col("valid_from").asc_nulls_first(), "revision_key")
    return folded.withColumn("contradiction_count", contra).withColumn("confidence", confidence).withColumn("status", F.when(contested, "contested").otherwise(F.col("status"))).withColumn("revision_number", F.row_number().over(w))


def conflict_partners(edges: DataFrame) -> DataFrame:
    """(revision_key, contradiction_count): distinct partners over both directions of (a, b)."""
    both = edges.select(F.col("a").alias("revision_key"), F.col("b").alias("other")).union(edges.select("b", "a"))
    return both.groupBy("revision_key").agg(F.countDistinct("other").alias("contradiction_count"))


def current_projection(revisions: DataFrame, by: list[str]) -> DataFrame:
    """The latest revision of each memory: an active one if there is one, else contested, else superseded."""
    rank = F.when(F.col("status") == "active", 2).when(F.col("status") == "contested", 1).otherwise(0)
    rest = [c for c in revisions.columns if c not in by]
    best = revisions.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(rank, "revision_number")).alias("r"))
    return best.select(*by, "r.*")


def as_of(revisions: DataFrame, memories: DataFrame, at: Column, key: str = "memory_key") -> DataFrame:
    """Revisions valid at a time with their memory's columns, one row per revision."""
    valid = revisions.where(valid_at(F.col("valid_from"), F.col("valid_until"), at))
    return valid.join(memories.select(key, *(c for c in memories.columns if c not in valid.columns)), key)


def as_of_each(revisions: DataFrame, probes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Each probe with the revisions of its keys that are valid at its own time."""
    names = {k: f"r_{k}" for k in keys}
    r = revisions.withColumnsRenamed(names)
    on = valid_at(F.col("valid_from"), F.col("valid_until"), F.col(at))
    for k, v in names.items():
        on = on & (F.col(k) == F.col(v))
    return probes.join(r, on).drop(*names.values())
