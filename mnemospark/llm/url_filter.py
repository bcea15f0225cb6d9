"""URL rules, and a verdict by link-graph propagation where no rule fits.

A rule fits a host and its subdomains, and paths that start with its own; the
longest rule wins. Hosts of pages that a rule allows or blocks are seeds.
Trust flows along links between hosts by personalised PageRank from the
trusted seeds; distrust flows against links from the blocked seeds. A seed's
share of the teleport is that of its pages so judged. A page
that no rule fits is blocked if its host's distrust exceeds ``threshold`` and
its trust, and allowed otherwise.

Edges are aggregated to hosts before anything is iterated, so the graph is
small beside the pages. A host's out-links are shared out by weight; ranks are
written after every few rounds, which go on until the ranks are settled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, UPPER_ASCII, write

#: rounds of propagation in one plan
STEPS = 4


@dataclass(frozen=True)
class UrlConfig:
    """rules: (host, path, verdict)."""

    rules: tuple[tuple[str, str, str], ...] = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
    damping: float = 0.85
    #: most that trust and distrust of all hosts may be off together, in even shares of a host
    tolerance: float = 1e-6
    #: distrust, over a host's even share of it, above which a host is blocked
    threshold: float = 0.4


def _after(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(_after(url), F.lit("")), "(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER_ASCII, LOWER_ASCII)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after(url), F.lit("")), "(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, cfg: UrlConfig) -> Column:
    """A struct of the longest rule that fits and its verdict; nulls without one."""
    found = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for h, p, verdict in sorted(cfg.rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts in (host, html)."""
    links = F.expr(r"""regexp_extract_all(html, '(?is)href\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]+)', 1)""")
    found = pages.where("html is not null").select(F.col("host").alias("src"), F.explode(F.array_distinct(links)).alias("link"))
    target = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    return found.select("src", target.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, known: int, cfg: UrlConfig) -> DataFrame:
    """(host, rank): personalised PageRank along ``edges`` from (host, share), shares adding up to 1.

    A round moves at most ``damping`` of what the last one moved, which bounds
    what is left: rounds end when that is below the tolerance over ``known``
    hosts, or after the number that is enough for any graph. What reaches a
    host without out-links goes on at the seeds: that is the same ranks but
    for a factor, so they are made without it and then scaled to add up to 1.
    A host that no seed reaches has no row.
    """
    total = edges.groupBy(F.col("src").alias("t_src")).agg(F.sum("weight").alias("total"))
    shares = write(edges.join(total, F.col("src") == F.col("t_src")).select("src", "dst", (F.col("weight") / F.col("total")).alias("w")), "edges")
    start = write(seeds.select("host", ((1 - cfg.damping) * F.col("share")).alias("base")), "seeds")
    rank = write(start.df.select("host", F.col("base").alias("rank")), "rank")
    if not 0 < cfg.damping < 1:
        raise ValueError("damping must be between 0 and 1")
    # scaling multiplies what is off by 1 / (1 - damping) at most
    least = cfg.tolerance / max(known, 1) * (1 - cfg.damping) / 2
    kept = cfg.damping**STEPS
    base = start.df.select("host", F.col("base").alias("rank"))
    for _ in range(max(1, math.ceil(math.log(least) / math.log(kept)))):
        new, was = rank.df, rank.df.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"))
        for step in range(STEPS):
            flow = new.join(shares.df, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (cfg.damping * F.col("rank") * F.col("w")).alias("rank"))
            new = base.unionByName(flow)
            if step < STEPS - 1:
                new = new.groupBy("host").agg(F.sum("rank").alias("rank"))
        both = new.withColumn("was", F.lit(0.0)).unionByName(was)
        settled = write(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")), "rank")
        moved = settled.df.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        rank.drop()
        rank = settled
        if not moved or moved * kept / (1 - kept) < least:
            break
    whole = rank.df.agg(F.sum("rank")).first()[0] or 1.0
    return rank.df.select("host", (F.col("rank") / whole).alias("rank"))


def judge(pages: DataFrame, cfg: UrlConfig = UrlConfig()) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ``://``, has an empty host and path, no rule,
    and is allowed. A null html has no links. Trust and distrust are those of
    the host, in shares of an even spread over the hosts (1 is average).
    Repeated rows are judged one by one; an empty table gives no rows.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html").alias("html"))
    judged = parts.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), cfg).alias("r"))
    hosts = write(judged.groupBy("host").agg(F.count_if(F.col("r.verdict") == "allow").alias("allow"), F.count_if(F.col("r.verdict") == "block").alias("block"), F.count(F.lit(1)).alias("pages")), "hosts").df
    edges = write(host_edges(parts.select("host", "html")), "links").df
    known = hosts.select("host").union(edges.select("dst")).distinct().where("host <> ''").count()

    def seeds(mine: str) -> DataFrame:
        # a host counts by the share of its pages that rules judge so
        share = F.col(mine) / F.col("pages")
        part = hosts.where((F.col(mine) > 0) & (F.col("host") != "")).select("host", share.alias("s"))
        whole = part.agg(F.sum("s")).first()[0] or 1.0
        return part.select("host", (F.col("s") / whole).alias("share"))

    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = propagate(edges, seeds("allow"), known, cfg).select(F.col("host").alias("a_host"), F.col("rank").alias("trust"))
    distrust = propagate(back, seeds("block"), known, cfg).select(F.col("host").alias("b_host"), F.col("rank").alias("distrust"))
    scored = hosts.select("host").join(trust, F.col("host") == F.col("a_host"), "left").join(distrust, F.col("host") == F.col("b_host"), "left")
    scored = write(scored.select(F.col("host").alias("h_host"), (F.coalesce("trust", F.lit(0.0)) * known).alias("trust"), (F.coalesce("distrust", F.lit(0.0)) * known).alias("distrust")), "scores").df
    out = judged.join(scored, F.col("host") == F.col("h_host"), "left")
    bad = (F.col("distrust") > cfg.threshold) & (F.col("distrust") > F.col("trust"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when((F.col("host") != "") & bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
