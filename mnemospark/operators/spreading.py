"""Spreading activation over the graph of memories and their entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ActivationConfig
from .learning import Linked

#: With fewer cues than this, a memory's entities are divided among tasks, so that one cue isn't one task's work.
MANY_CUES = 64


def fan(edges: DataFrame) -> DataFrame:
    """(entity, fan): candidate memories that hold the entity; edges are (memory, entity), distinct."""
    return edges.groupBy("entity").agg(F.count(F.lit(1)).alias("fan"))


def spread(edges: DataFrame, sources: DataFrame, cfg: ActivationConfig = ActivationConfig(), learned: DataFrame | Linked | None = None, parts: int | None = None) -> DataFrame:
    """(cue_id, memory, spreading, hop) from (memory, entity) and (cue_id, entity).

    A cue's activation is shared by its sources. At each hop an entity gives
    its memories a share by its fan; contributions below ``least_activation``
    are dropped; a memory that is reached for the first time passes what it
    got on to its entities, less those of the frontier. ``learned`` (left,
    right, strength) gives neighbours a part, which isn't passed on; a
    :class:`Linked` finds only the neighbours that can matter. Sums are
    capped, and the order of hops doesn't matter to them. Hops are few, so
    they are unrolled into one plan. ``parts`` is the number of partitions;
    without it, the session's.

    Edges are moved once to their entity and once to their memory; what a
    memory passes on travels as one list, and is cut by fan before it meets
    the entity's memories.
    """
    least, cap = cfg.least_activation, cfg.source_activation

    def at(df: DataFrame, *by: str | Column) -> DataFrame:
        return df.repartition(parts, *by) if parts else df.repartition(*by)

    held = at(edges, "entity").withColumn("fan", F.count(F.lit(1)).over(Window.partitionBy("entity")))
    sources = sources.select("cue_id", "entity").distinct()
    share = sources.groupBy("cue_id").agg((F.lit(cap) / F.count(F.lit(1))).alias("a"))
    frontier = sources.join(share, "cue_id")
    lists, expanded, total = None, None, None
    if cfg.hops > 1:
        buckets = max(1, MANY_CUES // max(1, sources.select("cue_id").distinct().limit(MANY_CUES).count()))
        mine = at(held, "memory").withColumn("degree", F.count(F.lit(1)).over(Window.partitionBy("memory")))
        lists = mine.groupBy("memory", F.pmod(F.xxhash64("entity"), F.lit(buckets)).alias("bucket")).agg(F.first("degree").alias("degree"), F.collect_list(F.struct("entity", "fan")).alias("held"))
    for hop in range(1, cfg.hops + 1):
        give = F.col("a") * cfg.associative_strength / F.col("fan")
        got = held.join(frontier.where(F.col("a") >= least).hint("merge"), "entity").withColumn("g", give).where(F.col("g") >= least)
        # by memory, where they meet lists and neighbours
        got = at(got.select("cue_id", "memory", "g"), "memory").groupBy("cue_id", "memory").agg(F.sum("g").alias("g"))
        made = got.withColumn("hop", F.lit(hop))
        if isinstance(learned, Linked):
            made = made.select("cue_id", F.array("memory").alias("memories"), "g", "hop").unionByName(_neighbours(got, learned, cfg, parts).withColumn("hop", F.lit(hop)))
        elif learned is not None:
            both = learned.select(F.col("left").alias("memory"), F.col("right").alias("to"), "strength").union(learned.select("right", "left", "strength"))
            extra = got.join(both, "memory").withColumn("e", F.col("g") * cfg.spread_decay * cfg.learned_scale * F.col("strength")).where(F.col("e") >= least)
            made = made.unionByName(extra.groupBy("cue_id", F.col("to").alias("memory")).agg(F.sum("e").alias("g")).withColumn("hop", F.lit(hop)))
        total = made if total is None else total.unionByName(made)
        if hop == cfg.hops:
            break
        fresh = got if expanded is None else got.join(expanded, ["cue_id", "memory"], "left_anti")
        p = F.col("g") * cfg.spread_decay / F.greatest(F.lit(1), F.col("degree") - 1)
        passed = fresh.join(lists.hint("merge"), "memory").withColumn("p", p).where(F.col("p") >= least).select("cue_id", "bucket", "p", "held")
        passed = at(passed, "cue_id", "bucket").select("cue_id", "bucket", "p", F.inline("held")).groupBy("cue_id", "bucket", "entity").agg(F.sum("p").alias("a"), F.first("fan").alias("fan"))
        if hop + 1 == cfg.hops:
            # of what is passed on last only what reaches a memory counts
            passed = passed.where((F.col("a") >= least) & (give >= least))
        reached = got.select("cue_id", "memory")
        expanded = reached if expanded is None else expanded.unionByName(reached)
        frontier = passed.select("cue_id", "entity", "a").join(frontier.select("cue_id", "entity"), ["cue_id", "entity"], "left_anti")
    if isinstance(learned, Linked):
        total = at(total, "cue_id").select("cue_id", F.explode("memories").alias("memory"), "g", "hop")
    return total.groupBy("cue_id", "memory").agg(F.least(F.lit(cap), F.sum("g")).alias("spreading"), F.min("hop").alias("hop"))


def _neighbours(got: DataFrame, learned: Linked, cfg: ActivationConfig, parts: int | None) -> DataFrame:
    """(cue_id, memories, g): what neighbours get of the activation ``got``, those of one memory and strength in one row."""
    part = cfg.spread_decay * cfg.learned_scale
    # the weakest link over which a memory's largest activation is still enough, a little less for rounding
    least = got.groupBy("memory").agg((cfg.least_activation / (F.max("g") * part) * (1 - 1e-9)).alias("strength")).where("strength <= 1")
    links = learned.of(least, parts)
    extra = got.join(links.hint("merge"), "memory").withColumn("e", F.col("g") * part * F.col("strength")).where(F.col("e") >= cfg.least_activation)
    return extra.select("cue_id", F.col("to").alias("memories"), F.col("e").alias("g"))
