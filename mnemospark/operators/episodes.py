"""Sessions of observations and their roll-up to episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ConsolidationConfig
from ..functions.maths import clip, seconds_between
from ..functions.text import hash_parts


def group_of(metadata: dict[str, Column]) -> Column:
    """{type, value} of the first grouping field that isn't blank, null without one."""
    out = F.lit(None).cast("struct<type:string,value:string>")
    for name, value in reversed(list(metadata.items())):
        text = F.trim(value.cast("string"))
        out = F.when(text != "", F.struct(F.lit(name).alias("type"), text.alias("value"))).otherwise(out)
    return out


def sessionise(df: DataFrame, keys: list[str], at: str, order: str, gap_seconds: float | None = 1800.0, boundary: str | None = None, terminal: str | None = None) -> DataFrame:
    """``df`` with ``session`` (from 0 within the keys) and ``sequence_number``.

    A session starts where the gap exceeds ``gap_seconds`` (None: gaps don't
    matter), at a boundary row, and after a terminal one.
    """
    w = Window.partitionBy(*keys).orderBy(at, order)
    start = F.lit(False)
    if gap_seconds is not None:
        start = start | F.coalesce(seconds_between(F.lag(at).over(w), F.col(at)) > gap_seconds, F.lit(False))
    if boundary:
        start = start | F.coalesce(F.col(boundary), F.lit(False))
    if terminal:
        start = start | F.coalesce(F.lag(terminal).over(w), F.lit(False))
    flagged = df.withColumn("__start", (start & (F.row_number().over(w) > 1)).cast("int"))
    numbered = flagged.withColumn("session", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")
    inside = Window.partitionBy(*keys, "session").orderBy(at, order)
    return numbered.withColumn("sequence_number", F.row_number().over(inside) - 1)


def salience(attention: Column, explicit: Column | None = None, terminal: Column | None = None) -> Column:
    """An aggregate: half the largest attention, three tenths of the mean, explicit importance, a terminal event."""
    out = 0.50 * F.max(attention) + 0.30 * F.avg(attention)
    if explicit is not None:
        fine = F.when(explicit.between(0, 1), explicit)
        out = out + 0.15 * F.coalesce(F.max(fine), F.lit(0.0))
    if terminal is not None:
        out = out + 0.05 * F.bool_or(terminal).cast("int")
    return clip(out)


def confidence(content: Column) -> Column:
    """An aggregate: 0.7 and 0.3 times the share of rows with content."""
    return 0.7 + 0.3 * F.avg(F.when(F.trim(F.coalesce(content, F.lit(""))) != "", 1.0).otherwise(0.0))


def statement(rows: Column, kind: Column, namespace: Column, most: int = 2000) -> Column:
    """Contents of an ordered array, adjacent equal ones once, joined by lines and cut at ``most`` characters."""
    texts = F.filter(F.transform(rows, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    fresh = F.filter(texts, lambda x, i: (i == 0) | (x != F.get(texts, i - 1)))
    n = F.size(rows)
    fallback = F.concat(F.lit("Episode containing "), n.cast("string"), F.lit(" "), kind, F.when(n == 1, " observation").otherwise(" observations"), F.lit(" from "), namespace, F.lit("."))
    return F.substring(F.when(F.size(fresh) > 0, F.array_join(fresh, "\n")).otherwise(fallback), 1, most)


def rollup(sessions: DataFrame, keys: list[str], obs_id: str, at: str, content: str, attention: str, terminal: str, kind: str, namespace: str = "direct", cfg: ConsolidationConfig = ConsolidationConfig()) -> DataFrame:
    """One row per episode: span, evidence, statement, salience, confidence, key and fingerprint."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("sequence_number").alias("sequence_number"), F.col(obs_id).alias("observation_id"), F.col(content).alias("content"), F.col(kind).alias("kind"))))
    agg = sessions.groupBy(*keys, "session").agg(
        F.min(at).alias("started_at"),
        F.max(at).alias("ended_at"),
        F.count(F.lit(1)).alias("observations"),
        salience(F.col(attention), terminal=F.col(terminal)).alias("importance"),
        confidence(F.col(content)).alias("confidence"),
        F.array_sort(F.collect_set(kind)).alias("event_types"),
        rows.alias("rows"),
    )
    text = statement(F.transform("rows", lambda r: r["content"]), F.get("rows", F.lit(0))["kind"], F.lit(namespace), cfg.statement_chars)
    evidence = F.transform("rows", lambda r: F.struct(r["observation_id"].alias("observation_id"), r["sequence_number"].alias("sequence_number")))
    first = F.get("rows", F.lit(0))["observation_id"]
    prints = F.array_join(F.transform("rows", lambda r: F.concat_ws("\x1f", r["observation_id"].cast("string"), F.lit("1"), r["sequence_number"].cast("string"))), "\x1f")
    return agg.select(
        *keys, "session", "started_at", "ended_at", "observations", "importance", "confidence", "event_types",
        text.alias("statement"), evidence.alias("evidence"), hash_parts(*(F.col(k) for k in keys), first).alias("memory_key"), F.sha2(prints, 256).alias("fingerprint"),
    )


def entities(df: DataFrame, by: list[str], subject: Column, actor: Column | None = None, named: Column | None = None) -> DataFrame:
    """The distinct (entity_id, role) of each group, sorted; blanks dropped."""
    pair = lambda e, role: F.struct(F.trim(e.cast("string")).alias("entity_id"), F.lit(role).alias("role"))
    parts = [F.array(pair(subject, "subject"))]
    parts += [F.array(pair(actor, "actor"))] if actor is not None else []
    parts += [F.transform(F.coalesce(named, F.array().cast("array<string>")), lambda e: pair(e, "entity"))] if named is not None else []
    rows = df.select(*by, F.explode(F.concat(*parts)).alias("e")).where("e.entity_id is not null and e.entity_id <> ''")
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set("e")).alias("entities"))


def metadata(sessions: DataFrame, keys: list[str], at: str, sets: dict[str, str]) -> DataFrame:
    """Of each session: observations, whole seconds it lasts, and the sorted distinct values of columns.

    ``sets``: name of the result -> column.
    """
    length = (F.unix_seconds(F.max(F.col(at).cast("timestamp"))) - F.unix_seconds(F.min(F.col(at).cast("timestamp")))).alias("duration_seconds")
    return sessions.groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("observation_count"), length, *(F.array_sort(F.collect_set(c)).alias(name) for name, c in sets.items()))
