"""Quality rules whose cutoffs carry a guarantee against false rejection.

Word statistics give a document a few rule metrics (whole numbers). For each
stratum and rule the labelled documents of good quality are a holdout: the
cutoff "reject at metric >= m" is certified if the exact binomial tail
P(Bin(n, alpha') <= k) is at most delta', with k of n good documents rejected.
That is the Clopper-Pearson upper bound on the false-rejection rate being at
most alpha'. alpha' is the stratum's allowed rate divided by the number of
rules (a document rejected by any rule counts), and delta' is the error
probability divided by the number of (stratum, rule) pairs (Bonferroni).
Within a pair, cutoffs are ordered by k, so testing them in that order needs
no further correction. Of the certified cutoffs of a rule the one with the largest
share of bad less share of good documents rejected is used, counting documents
that the rules before it let through, the mildest in a tie; none, if that
difference is never positive.

Everything is a DataFrame function; there is no Python in the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, let, small, words_of, write

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class RiskConfig:
    """alpha: false rejections allowed per stratum; delta: probability that any stratum exceeds it."""

    alpha: float = 0.05
    delta: float = 0.05
    least_words: int = 50
    repeat_percent: int = 50


def text_stats(text: Column) -> Column:
    """A struct of whole-number statistics of a text; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))

    def repeats(w: Column) -> Column:
        """Words inside 3-word windows that the text has at least twice."""
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def covered(h: Column) -> Column:
            pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def positions(p: Column) -> Column:
                same = lambda a, j: a["h"] == F.get(p, j)["h"]
                hit = F.filter(p, lambda a, j: F.coalesce(same(a, j - 1), F.lit(False)) | F.coalesce(same(a, j + 1), F.lit(False)))
                at = lambda k: F.transform(hit, lambda a: a["i"] + k)
                return F.size(F.array_distinct(F.concat(at(0), at(1), at(2))))

            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, positions))

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, covered))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    of_words = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeats(w).cast("long").alias("n_repeat_words")),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.char_length(F.regexp_replace(text, SYMBOLS.replace("[", "[^", 1) + "+", "")).cast("long")
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols")),
        lambda s: F.struct(
            s["w"]["n_words"].alias("n_words"), s["w"]["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["l"]["n_dup_lines"].alias("n_dup_lines"), s["w"]["n_repeat_words"].alias("n_repeat_words"), s["l"]["n_lines"].alias("n_lines")
        ),
    )


def base_failed(s: Column, cfg: RiskConfig = RiskConfig()) -> Column:
    return (s["n_words"] < cfg.least_words) | (100 * s["n_repeat_words"] > cfg.repeat_percent * s["n_words"])


def _per(top: Column, by: Column, scale: int) -> Column:
    return F.when(by > 0, F.floor(top * scale / F.greatest(by, F.lit(1)))).otherwise(F.lit(0)).cast("long")


#: Rule -> metric of the statistics; a document is rejected where it is at or above the cutoff.
RULES = {
    "symbols": lambda s: _per(s["n_symbols"], s["n_words"], 1000),
    "dup_lines": lambda s: _per(s["n_dup_lines"], s["n_lines"], 1000),
    "repeats": lambda s: _per(s["n_repeat_words"], s["n_words"], 1000),
    "long_words": lambda s: _per(s["word_chars"], s["n_words"], 100),
    "short_words": lambda s: -_per(s["word_chars"], s["n_words"], 100),
}


def _log_factorial(x: Column) -> Column:
    d = F.greatest(x.cast("double"), F.lit(21.0))
    stirling = d * F.log(d) - d + 0.5 * F.log(d * (2 * math.pi)) + 1 / (12 * d) - 1 / (360 * d * d * d) + 1 / (1260 * F.pow(d, F.lit(5.0)))
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")))).otherwise(stirling)


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k) where k <= n * p, by summing from k down; 1 elsewhere.

    The terms fall faster than geometrically; those left out beyond
    60 * sqrt(n) + 100 are below a double's precision.
    """
    log_top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(p) + (n - k) * F.log1p(-p)
    steps = F.least(k, (60 * F.sqrt(n) + 100).cast("long"))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j + 1) / (n - k + j) * (1 - p) / p
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    more = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1))), zero, add, lambda a: a["sum"])).otherwise(F.lit(1.0))
    return F.when(k <= n * p, F.exp(log_top) * more).otherwise(F.lit(1.0))


def stratum_of(column: Column) -> Column:
    """Null strata are a stratum of their own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def certified_cutoffs(stats: DataFrame, labels: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """(stratum, cutoffs map<rule, int>) from (doc_id, stratum, s) and (doc_id, quality).

    Labels that are null don't count; of several for a document the best one
    does. Documents that the base rules reject don't take part. Strata without
    enough good documents for any certificate aren't in the result.
    """
    labelled = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    columns = [of(F.col("s")).alias(name) for name, of in RULES.items()]
    used = write(stats.where(~base_failed(F.col("s"), cfg)).join(labelled, "doc_id").select("stratum", (F.col("quality") == 1).alias("good"), *columns), "labelled-stats").df
    strata = used.select("stratum").distinct().count()
    chosen = used.select("stratum").distinct().select("stratum", F.create_map().cast("map<string,bigint>").alias("cutoffs"))
    for name in RULES:
        chosen = write(_add_cutoff(used, chosen, strata, name, cfg), "cutoffs").df
    return chosen.where(F.size("cutoffs") > 0)


def _add_cutoff(used: DataFrame, chosen: DataFrame, strata: int, name: str, cfg: RiskConfig) -> DataFrame:
    """``chosen`` with the cutoff of rule ``name``.

    Its certificate counts all good documents; its gain only the documents
    that the cutoffs chosen before let through, so a rule that adds nothing
    rejects nothing.
    """
    caught = F.lit(False)
    for rule in RULES:
        caught = caught | F.coalesce(F.col(rule) >= F.try_element_at("cutoffs", F.lit(rule)), F.lit(False))
    rows = used.join(chosen, "stratum").select("stratum", "good", F.col(name).alias("m"), caught.alias("caught"))
    count = lambda x: F.count_if(x)
    counted = rows.groupBy("stratum", "m").agg(count(F.col("good")).alias("good"), count(F.col("good") & ~F.col("caught")).alias("new_good"), count(~F.col("good") & ~F.col("caught")).alias("new_bad"), count(~F.col("good")).alias("bad"))
    # a row per value that a ratio of whole numbers takes in a stratum, far fewer than documents
    whole, falling = Window.partitionBy("stratum"), Window.partitionBy("stratum").orderBy(F.desc("m"))
    over = lambda c, w: F.sum(c).over(w)
    at = counted.select("stratum", "m", over("good", falling).alias("k"), over("new_good", falling).alias("lost"), over("new_bad", falling).alias("hit"), over("good", whole).alias("n"), over("bad", whole).alias("n_bad"))
    at = at.where("n > 0 and n_bad > 0").withColumn("gain", F.col("hit") / F.col("n_bad") - F.col("lost") / F.col("n")).where("gain > 0")
    tail = binomial_tail(F.col("n"), F.col("k"), F.lit(cfg.alpha / len(RULES)))
    best = at.where(tail <= F.lit(cfg.delta / len(RULES) / max(strata, 1))).groupBy("stratum").agg(F.max_by("m", F.struct("gain", "m")).alias("m"))
    return chosen.join(best, "stratum", "left").select("stratum", F.when(F.col("m").isNull(), F.col("cutoffs")).otherwise(F.map_concat("cutoffs", F.create_map(F.lit(name), F.col("m")))).alias("cutoffs"))


def passes(s: Column, cutoffs: Column) -> Column:
    """False where a certified cutoff is reached; a stratum without cutoffs rejects nothing."""
    over = [F.coalesce(of(s) >= F.try_element_at(cutoffs, F.lit(name)), F.lit(False)) for name, of in RULES.items()]
    bad = over[0]
    for x in over[1:]:
        bad = bad | x
    return ~bad


def judge(docs: DataFrame, labels: DataFrame, cfg: RiskConfig = RiskConfig(), stratum_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: the statistics, base_failed and kept.

    Null and empty texts have no words and fail the base rules. Null ids are
    judged like others but match no label. Repeated rows are judged one by
    one. An empty table of documents or labels is fine: without labels only
    the base rules reject.
    """
    rows = docs.select(F.col("doc_id"), stratum_of(F.col(stratum_col)).alias("stratum"), text_stats(F.col("text")).alias("s"))
    stats = write(rows, "quality-stats").df
    cutoffs = write(certified_cutoffs(stats, labels, cfg), "cutoffs").df
    out = stats.join(small(cutoffs), "stratum", "left")
    return out.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", base_failed(F.col("s"), cfg).alias("base_failed"), (~base_failed(F.col("s"), cfg) & passes(F.col("s"), F.col("cutoffs"))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, cfg: RiskConfig = RiskConfig(), stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their columns, whatever they are called.

    Rows are written with their statistics, which cost far more than a write:
    the cutoffs are made of the statistics, and the verdict needs both.
    """
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("doc_id"), stratum_of(docs[stratum_col]).alias("stratum"), text_stats(docs["text"]).alias("s"))
    rows = write(rows, "quality-stats").df
    cutoffs = write(certified_cutoffs(rows.select("doc_id", "stratum", "s"), labels, cfg), "cutoffs").df
    judged = rows.join(small(cutoffs), "stratum", "left")
    return judged.where(~base_failed(F.col("s"), cfg) & passes(F.col("s"), F.col("cutoffs"))).select("row.*")
