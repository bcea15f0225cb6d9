"""Greedy selection from ranked rows: duplicates collapsed, budgets kept.

Both selections depend on what was kept before, so they fold over a cue's
ranked head, which is bounded by the pool; everything else is done before.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ActivationConfig, WorkingMemoryConfig


def near_duplicate(a: Column, b: Column, cfg: ActivationConfig = ActivationConfig()) -> Column:
    """Of structs with fingerprint and tokens: equal prints, or Jaccard of the tokens that aren't numbers."""
    words = lambda t: F.filter(t, lambda x: ~x.rlike("^[0-9]+$"))
    x, y = words(a["tokens"]), words(b["tokens"])
    alike = (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) >= cfg.collapse_jaccard * F.size(F.array_union(x, y)))
    return ((a["fingerprint"] != "") & (a["fingerprint"] == b["fingerprint"])) | alike


def collapse(ranked: DataFrame, by: str, rank: str, limit: int, cfg: ActivationConfig = ActivationConfig()) -> DataFrame:
    """The first ``limit`` rows of each group that aren't near-duplicates of one kept before.

    Needs key, fingerprint and tokens; ``ranked`` holds each group's pool. The
    fold is a higher-order function, so it stays in the JVM.
    """
    item = F.struct(F.col(rank).alias("rank"), F.col("key"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.col("tokens"))
    groups = ranked.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "array<struct<rank:int,key:bigint,fingerprint:string,tokens:array<string>>>"
    kept = F.aggregate(
        F.col("items").cast(kind), F.array().cast(kind), lambda acc, x: F.when((F.size(acc) >= limit) | F.exists(acc, lambda a: near_duplicate(a, x, cfg)), acc).otherwise(F.concat(acc, F.array(x)))
    )
    return groups.select(by, F.posexplode(kept).alias("place", "x")).select(by, (F.col("place") + 1).alias("place"), F.col("x.key").alias("key"), F.col("x.rank").alias("rank"))


def same_slot_collapse(ranked: DataFrame, by: str, slot: str, order: list[Column]) -> DataFrame:
    """One row per slot of a group, active ones first; rows without a slot all stay."""
    from pyspark.sql import Window

    w = Window.partitionBy(by, slot).orderBy(F.when(F.col("status") == "active", 0).otherwise(1), *order)
    return ranked.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | F.col(slot).isNull()).drop("__n")


def select_working_memory(pool: DataFrame, by: str, cfg: WorkingMemoryConfig = WorkingMemoryConfig()) -> DataFrame:
    """(by, place, kind, key, final_score, redundancy): a budgeted, diverse selection.

    Needs kind, key, adjusted, activation, n_tokens and tokens. Each round
    takes the row of the largest score less inhibition (ties: adjusted,
    activation, kind, key, larger first) and passes over rows that don't fit
    the rest of the token budget.
    """
    c = cfg

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        left = [(r, set(r["tokens"])) for r in rows.to_dict("records")]
        chosen: list[set] = []
        out, budget = [], c.max_tokens

        def similarity(a: set, b: set) -> float:
            return len(a & b) / len(a | b) if a | b else 1.0

        while left and len(out) < c.max_items:
            def value(x):
                r, t = x
                red = max((similarity(t, s) for s in chosen), default=0.0)
                final = min(1.0, max(0.0, r["adjusted"] - (c.inhibition * red if red >= c.redundancy else 0.0)))
                return (final, r["adjusted"], r["activation"], r["kind"], r["key"]), red

            best = max(left, key=lambda x: value(x)[0])
            (final, *_), red = value(best)
            if final < c.least_score:
                break
            left.remove(best)
            if best[0]["n_tokens"] > budget:
                continue
            budget -= best[0]["n_tokens"]
            chosen.append(best[1])
            out.append((best[0][by], len(out) + 1, best[0]["kind"], best[0]["key"], final, red))
        return pd.DataFrame(out, columns=[by, "place", "kind", "key", "final_score", "redundancy"])

    types = {f.name: f.dataType.simpleString() for f in pool.schema.fields}
    schema = f"{by} {types[by]}, place int, kind string, key {types['key']}, final_score double, redundancy double"
    return pool.select(by, "kind", "key", "adjusted", "activation", "n_tokens", "tokens").groupBy(by).applyInPandas(fold, schema)


def render(selected: DataFrame, by: str, place: str, statement: str) -> DataFrame:
    """(by, text): the statements of a selection as a list."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.concat(F.lit("- "), F.replace(F.col(statement), F.lit("\n"), F.lit("\n  "))).alias("s"))))
    return selected.groupBy(by).agg(F.concat(F.lit("Relevant memory:\n\n"), F.array_join(F.transform(lines, lambda x: x["s"]), "\n")).alias("text"))
