"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r in [0, most]; the rates minimise
sum(r ln r - r) subject to sum(r * size) = target for every source. The
solution is r = min(most, exp(lambda * c)), c being the size over its source's
mean size, and lambda the maximiser of the concave dual of its source's
constraint. All lambdas are found together by Newton iterations, each one an
aggregation by source; a step that leaves the bracket known to hold the
solution is replaced by bisection. A step is one plan that reads the state
once, with its join to the histogram, and carries it through the aggregation:
a state read twice a step would double the plan, and what the driver holds of
it, with each step in one.

The dual depends on a document by source and size only, so iterations run on
the counts of (source, size), and documents are read once. Rates are rounded
to copies by systematic rounding of their running sum in order of size, which
is made in two levels (buckets, then rows within a bucket) so that no source
is in one task, and then repaired: while it brings a source's words nearer to
its target, the document whose size fits best gains or loses a copy.

Everything is a DataFrame function; there is no Python in the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, one_of_each, row_key, words_of, write


@dataclass(frozen=True)
class MixConfig:
    """weights: given to sources in order, repeating; most: copies of a document at most."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most: int = 3
    #: more than bisection alone needs; beyond them is an error
    newton_steps: int = 200
    tolerance: float = 1e-9
    #: documents per rounding bucket, about
    bucket_rows: int = 50_000


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def targets(sources: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(source, source_size, n, least, target) from (source, source_size, n, least).

    Shares of the whole size by weight, capped at ``most`` times the source's
    size; the excess goes to the others by weight until no cap is exceeded.
    With sources ordered by size per weight, those capped are the first ones,
    so the level is found by running sums, without iterating.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in cfg.weights)), (F.row_number().over(order) - 1) % len(cfg.weights) + 1)
    x = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(cfg.most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    x = x.withColumn("level", left / F.greatest(weight_left, F.lit(1e-300)))
    x = x.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return x.select("source", "source_size", "n", "least", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def _solve(hist: DataFrame, goals: DataFrame, cfg: MixConfig) -> Written:
    """(source, lam, mean): the dual's solution for each source with words; lam is null where all rates are ``most``."""
    cap = math.log(cfg.most)
    mean = F.col("source_size") / F.col("n")
    ratio = F.col("target") / F.col("source_size")
    c_least = F.col("least") / mean
    start = goals.where("source_size > 0 and target > 0").select(
        "source",
        mean.alias("mean"),
        (F.col("target") / mean).alias("goal"),
        F.lit(0.0).alias("lam"),
        F.least(F.log(ratio) / c_least, F.lit(0.0)).alias("lo"),
        (F.lit(cap) / c_least).alias("hi"),
        F.when(ratio >= cfg.most * (1 - 1e-12), True).otherwise(False).alias("done"),
        F.when(ratio >= cfg.most * (1 - 1e-12), True).otherwise(False).alias("full"),
    )
    def newton(state: DataFrame) -> DataFrame:
        # each source of the state has words, so none is lost in the join
        joined = hist.join(state, F.col("h_source").eqNullSafe(F.col("source")))
        c = F.col("size") / F.col("mean")
        u = F.col("lam") * c
        rate = F.exp(F.least(u, F.lit(cap)))
        s = joined.groupBy(*state.columns).agg(F.sum(F.col("count") * rate * c).alias("g"), F.sum(F.when(u < cap, F.col("count") * rate * c * c).otherwise(0.0)).alias("h"))
        off = F.col("g") - F.col("goal")
        lo, hi = F.when(off <= 0, F.col("lam")).otherwise(F.col("lo")), F.when(off >= 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - off / F.when(F.col("h") > 0, F.col("h"))
        inside = (step > lo) & (step < hi)
        near = F.abs(off) <= cfg.tolerance * F.col("goal")
        tight = (F.col("hi") - F.col("lo")) <= 1e-14 * (1 + F.abs(F.col("lam")))
        stop = F.col("done") | near | tight
        return s.select(
            "source", "mean", "goal",
            F.when(stop, F.col("lam")).when(inside, step).otherwise((lo + hi) / 2).alias("lam"),
            F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"), F.coalesce(stop, F.lit(True)).alias("done"), "full",
        )

    state = write(start, "dual")
    for _ in range(cfg.newton_steps):
        new = write(newton(state.df), "dual")
        state.drop()
        state = new
        if state.df.where("not done").limit(1).count() == 0:
            return state
    raise ValueError(f"rates of some sources aren't found after {cfg.newton_steps} steps")


def mix(docs: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    A null or empty text has size 0 and one copy, of no words. Null sources
    are one source, the last. Order within a source is by size, the id's hash
    and the id, so reruns agree; rows that are wholly equal in these share
    their rounding's order, not its result. An empty table gives no rows. A
    source's words miss its target by less than its smallest useful document.
    """
    sized = write(docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size")), "sizes").df
    hist = write(sized.groupBy(F.col("source").alias("h_source"), "size").agg(F.count(F.lit(1)).alias("count")), "histogram").df
    totals = hist.groupBy(F.col("h_source").alias("source")).agg(F.sum(F.col("size") * F.col("count")).alias("source_size"), F.sum("count").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    goals = write(targets(totals, cfg), "targets").df
    dual = _solve(hist.where("size > 0"), goals, cfg)
    # the rate and the floor of the running sum before each (source, size), from the histogram
    rated = hist.join(goals.select(F.col("source").alias("t_source"), "target", "source_size"), F.col("h_source").eqNullSafe(F.col("t_source"))).join(
        dual.df.select(F.col("source").alias("d_source"), "lam", "mean", "full"), F.col("h_source").eqNullSafe(F.col("d_source")), "left"
    )
    rate = (
        F.when(F.col("size") == 0, F.lit(1.0))
        .when(F.col("full"), F.lit(float(cfg.most)))
        .when(F.col("lam").isNull(), F.lit(0.0))
        .otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cfg.most)))), F.lit(float(cfg.most))))
    )
    rated = rated.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-12)).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    upto = Window.partitionBy("h_source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rates = write(rated.select("h_source", F.col("size").alias("h_size"), "target", "source_size", "count", "whole", "part", F.coalesce(F.sum(F.col("part") * F.col("count")).over(upto), F.lit(0.0)).alias("before")), "rates").df
    # a row's number within its (source, size), in two levels: documents of one size can be a third of all
    spread = sized.withColumn("hash", F.xxhash64("doc_id")).join(rates, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("size") == F.col("h_size")))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("count") / cfg.bucket_rows)).cast("long")
    # buckets are ranges of the hash, so that their order is that of the hash
    spread = spread.withColumn("bucket", F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * buckets).cast("long")).select("doc_id", "source", "size", "hash", "bucket", "target", "source_size", "whole", "part", "before")
    spread = write(spread, "spread").df
    per = spread.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    earlier = per.withColumn("skip", F.coalesce(F.sum("in_bucket").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("bucket").alias("p_bucket"), "skip")
    inside = Window.partitionBy("source", "size", "bucket").orderBy("hash", "doc_id")
    ranked = spread.withColumn("nth", F.row_number().over(inside)).join(earlier, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("bucket") == F.col("p_bucket")))
    nth = F.col("nth") + F.col("skip")
    running = lambda k: F.floor(F.col("before") + F.col("part") * k + 0.5)
    copies = (F.col("whole") + F.when(F.col("part") > 0, running(nth) - running(nth - 1)).otherwise(0)).cast("long")
    chosen = write(ranked.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(F.least(copies, F.lit(cfg.most).cast("long"))).alias("copies"), "hash", nth.alias("nth")), "copies")
    fixes = _repairs(chosen.df, cfg)
    fixed = chosen.df.join(fixes.withColumnRenamed("source", "f_source"), F.col("source").eqNullSafe(F.col("f_source")) & (F.col("size") == F.col("f_size")) & (F.col("nth") == F.col("f_nth")), "left")
    copies = F.col("copies") + F.coalesce("change", F.lit(0))
    return fixed.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _repairs(chosen: DataFrame, cfg: MixConfig) -> DataFrame:
    """(source, f_size, f_nth, change): documents that gain or lose a copy.

    A source's candidates are one document for each (size, copies), the one
    with the least number; there are no more of them than sizes times copies.
    Each is used once, and rounds end when none brings a source nearer. A
    source without candidates has no repairs and leaves in the first round.
    """
    cells = write(chosen.where("size > 0").groupBy("source", "size", "copies").agg(F.min("nth").alias("nth"), F.max("nth").alias("last")), "cells").df
    sums = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"))
    state = sums.select(F.col("source").alias("s_source"), (F.col("target") - F.col("taken")).alias("gap"), F.array().cast("array<struct<f_size:bigint,f_nth:bigint,change:bigint>>").alias("fixes"))
    state = write(state, "gaps")
    def repair(state: DataFrame) -> DataFrame:
        used = F.exists("fixes", lambda f: (f["f_size"] == F.col("size")) & (f["f_nth"] == F.col("nth")))
        change = F.when(F.col("gap") > 0, F.lit(1)).otherwise(F.lit(-1)).cast("long")
        fits = F.when(F.col("gap") > 0, F.col("copies") < cfg.most).otherwise(F.col("copies") > 0)
        after = F.abs(F.col("gap") - change * F.col("size"))
        best = (
            cells.join(state, F.col("source").eqNullSafe(F.col("s_source")))
            .groupBy("s_source", "gap", "fixes")
            .agg(F.min(F.when(fits & ~used & (after < F.abs(F.col("gap"))), F.struct(after.alias("after"), F.col("size").alias("f_size"), F.col("nth").alias("f_nth"), change.alias("change")))).alias("b"))
        )
        return best.select(
            "s_source",
            F.when(F.col("b").isNull(), F.col("gap")).otherwise(F.col("gap") - F.col("b.change") * F.col("b.f_size")).alias("gap"),
            F.when(F.col("b").isNull(), F.col("fixes")).otherwise(F.concat("fixes", F.array(F.struct("b.f_size", "b.f_nth", "b.change")))).alias("fixes"),
            F.col("b").isNotNull().alias("nearer"),
        )

    while True:
        new = write(repair(state.df), "gaps")
        state.drop()
        state = new
        if not new.df.where("nearer").limit(1).count():
            break
    return state.df.select(F.col("s_source").alias("source"), F.explode("fixes").alias("f")).select("source", "f.*")


def repeat(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` copies it.

    Rows that share an id are told apart by their other columns; rows equal in
    all of them are made once, as often as all of them together. Columns are
    those of ``docs``, whatever they are called.
    """
    rows = docs.select(F.struct(*row_key(docs)).alias("doc_id"), F.col("source"), F.col("text"))
    plan = mix(rows, cfg).groupBy("doc_id.k1", "doc_id.k2").agg(F.sum("copies").alias("copies")).where("copies > 0")
    plan = write(plan, "mix").df
    often = one_of_each(docs).hint("merge").join(plan.hint("merge"), ["k1", "k2"])
    return often.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
