"""Toxicity: a linear character n-gram classifier with naive Bayes scaling.

Features are the presence in a text of hashed character n-grams of its
lower-cased words, their ends marked. Each is scaled by its smoothed log-count
ratio between toxic and other training texts; a logistic model over the scaled
features is trained by stochastic gradient descent on a bounded sample of
labelled rows. Rare n-grams have no reliable ratio and are left out.

Executors get one number per bucket (4 MB, whatever the input). For each word
the buckets that matter are kept in a bounded cache, and a text's score adds
each bucket's weight once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, fresh
from .textmodel import hashed_ngrams, sigmoid, slices, training_rows, with_scores


@dataclass(frozen=True)
class ToxicityConfig:
    """sample: labelled rows to train on at most; least_texts: training texts an n-gram must be in."""

    sample: int = 6000
    bits: int = 20
    least_n: int = 3
    most_n: int = 6
    least_texts: int = 4
    smoothing: float = 0.5
    epochs: int = 12
    rate: float = 0.02
    decay: float = 1e-4
    least_ratio: float = 1.0
    threshold: float = 0.5
    seed: int = 11
    cache_words: int = 200_000


@dataclass
class ToxicityModel:
    weight: np.ndarray
    bias: float
    cfg: ToxicityConfig

    def scorer(self) -> Callable[[list[str]], list[float]]:
        weight, bias, cfg = self.weight, self.bias, self.cfg
        #: the buckets with a weight, of words that have any; seen: all words looked at
        cache: dict[str, list[int]] = {}
        seen: set[str] = set()

        def score(texts: list[str]) -> list[float]:
            out = []
            for part in slices(texts):
                split = [set(t.lower().split()) for t in part]
                if len(seen) > cfg.cache_words:
                    seen.clear()
                    cache.clear()
                new = list(set().union(*split) - seen)
                owner, ids = hashed_ngrams(new, cfg.least_n, cfg.most_n, cfg.bits)
                heavy = weight[ids] != 0
                for o, i in zip(owner[heavy].tolist(), ids[heavy].tolist(), strict=True):
                    cache.setdefault(new[o], []).append(i)
                seen.update(new)
                for words in split:
                    there = set(chain.from_iterable(map(cache.__getitem__, cache.keys() & words)))
                    out.append(sigmoid(bias + (float(weight[sorted(there)].sum()) if there else 0.0)))
            return out

        return score


def train(rows: list[tuple[str, int]], cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Ratios from counts of texts, then stochastic gradient descent over them.

    The logistic weights start at zero and the features are the ratios. Only
    ratios of ``least_ratio`` or more in absolute value are kept: smaller ones
    carry little, and a long text would add up thousands of them. Without rows
    of both labels every text scores 1 (all are toxic) or 0.
    """
    ones = sum(y for _, y in rows)
    if ones in (0, len(rows)):
        return ToxicityModel(np.zeros((1 << cfg.bits), np.float32), 700.0 if ones else -700.0, cfg)
    docs = [(np.unique(hashed_ngrams(list(set(t.lower().split())), cfg.least_n, cfg.most_n, cfg.bits)[1]).astype(np.int32), y) for t, y in rows]
    toxic, other = np.zeros((1 << cfg.bits)), np.zeros((1 << cfg.bits))
    for ids, y in docs:
        (toxic if y else other)[ids] += 1
    a, b = cfg.smoothing, len(rows) - ones
    ratio = np.log((toxic + a) / (ones + 2 * a)) - np.log((other + a) / (b + 2 * a))
    ratio[(toxic + other < cfg.least_texts) | (np.abs(ratio) < cfg.least_ratio)] = 0
    kept = np.flatnonzero(ratio)
    docs = [(ids[ratio[ids] != 0], y) for ids, y in docs]
    w, bias = np.zeros((1 << cfg.bits)), 0.0
    rng = np.random.default_rng(cfg.seed)
    for epoch in range(cfg.epochs):
        rate = cfg.rate * (1 - epoch / cfg.epochs)
        for k in rng.permutation(len(docs)):
            ids, y = docs[k]
            r = ratio[ids]
            z = bias + float(w[ids] @ r)
            g = y - 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
            w[ids] += rate * g * r / max(1.0, math.sqrt(len(ids)) / 4)
            bias += rate * g
        w[kept] *= 1 - cfg.decay
    return ToxicityModel((w * ratio).astype(np.float32), bias, cfg)


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Train on labels of ids whose crc32 modulo 5 isn't 0; the others are held out."""
    return train(training_rows(docs, labels, "toxic", crc_mod(F.col("doc_id"), 5) != 0, cfg.sample), cfg)


def score(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null text is scored as the empty one; a null id is scored, never learnt
    from, and not held out. Only the text is an input of the score. Repeated
    rows get equal scores. Empty tables give a score of 0, or no rows.
    """
    model = fit(docs, labels, cfg)
    scored = with_scores(docs.select("doc_id", "text"), model.scorer(), "text", "score")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cfg.threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns, whatever they are called."""
    model = fit(docs, labels, cfg)
    name = fresh(docs.columns, "toxicity")
    return with_scores(docs, model.scorer(), "text", name).where(F.col(name) < cfg.threshold).drop(name)
