"""Quality classifier: averaged subword embeddings with a softmax output.

A text's words (white space, case kept), each two that follow one another, and
the character n-grams of each word, with its ends marked, are hashed to rows of
an embedding table; the end of the text has a row of its own. The document's vector is the average of all of them, repeats included; a
softmax over two labels follows. Table and output are trained by numpy stochastic
gradient descent on a bounded sample of labelled rows.

The output is linear in the average, so for scoring the table is multiplied by
the output's difference once: what executors get is one number per bucket
(1 MB, whatever the input), and a word's sum over its features is kept in a
bounded cache. Scores equal those of the unmultiplied model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .textmodel import bigram_buckets, hashed_ngrams, sigmoid, slices, training_rows, with_scores, word_hashes


@dataclass(frozen=True)
class QualityConfig:
    """sample: labelled rows to train on at most; threshold: score at which a text is predicted good."""

    sample: int = 6000
    bits: int = 18
    width: int = 16
    least_n: int = 3
    most_n: int = 5
    epochs: int = 3
    rate: float = 0.5
    #: the table's rate over the output's: its gradient is spread over all of a text's features
    table_rate: float = 50.0
    threshold: float = 0.7
    seed: int = 7
    #: rows of the rarer label are weighted up to this share of all
    rare_share: float = 1 / 3
    #: how often the feature of a text's end counts; short texts lean on it
    end_counts: int = 10
    cache_words: int = 200_000


def document(words: list[str], cfg: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's words."""
    counted = Counter(words)
    names = list(counted)
    owner, ids = hashed_ngrams(names, cfg.least_n, cfg.most_n, cfg.bits, whole=True)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0)
    index = dict(zip(names, range(len(names)), strict=True))
    pairs = bigram_buckets(word_hashes(names)[[index[w] for w in words]], cfg.bits)
    times = np.concatenate([np.fromiter(counted.values(), float)[owner], np.ones(len(pairs))])
    found, place = np.unique(np.concatenate([ids, pairs]), return_inverse=True)
    return np.append(found, 1 << cfg.bits), np.append(np.bincount(place, times), cfg.end_counts)


@dataclass
class QualityModel:
    """weight: a bucket's contribution to the logit of label 1; bias: that of the empty text."""

    weight: np.ndarray
    bias: float
    cfg: QualityConfig

    def scorer(self) -> Callable[[list[str]], list[float]]:
        weight, bias, cfg = self.weight, self.bias, self.cfg
        index: dict[str, int] = {}
        sums, counts, hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

        def score(texts: list[str]) -> list[float]:
            nonlocal sums, counts, hashes
            out = []
            for part in slices(texts):
                split = [t.split() for t in part]
                if len(index) > cfg.cache_words:
                    index.clear()
                    sums, counts, hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)
                new = [w for w in set().union(*split) if w not in index]
                owner, ids = hashed_ngrams(new, cfg.least_n, cfg.most_n, cfg.bits, whole=True)
                sums = np.concatenate([sums, np.bincount(owner, weight[ids], len(new))])
                counts = np.concatenate([counts, np.bincount(owner, minlength=len(new))])
                hashes = np.concatenate([hashes, word_hashes(new)])
                index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
                for words in split:
                    at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                    pairs = bigram_buckets(hashes[at], cfg.bits)
                    n = counts[at].sum() + len(pairs) + cfg.end_counts
                    total = sums[at].sum() + weight[pairs].sum(dtype=float) + cfg.end_counts * float(weight[-1])
                    out.append(sigmoid(bias + (float(total / n) if words else 0.0)))
            return out

        return score


def train(rows: list[tuple[str, int]], cfg: QualityConfig = QualityConfig()) -> QualityModel:
    """Stochastic gradient descent over the rows in a seeded order, the rate falling to zero.

    Rows of the rarer label are weighted up to ``rare_share`` of all. Without rows of
    both labels there is nothing to tell apart: every text's score is then the
    share of label 1 among the rows, 0 without any.
    """
    ones = sum(y for _, y in rows)
    if ones in (0, len(rows)):
        return QualityModel(np.zeros((1 << cfg.bits) + 1, np.float32), 700.0 if ones else -700.0, cfg)
    rng = np.random.default_rng(cfg.seed)
    table = ((rng.random(((1 << cfg.bits) + 1, cfg.width), dtype=np.float32)) - 0.5) / cfg.width
    out = np.zeros((2, cfg.width), np.float32)
    bias = np.zeros(2, np.float32)
    share = min(ones, len(rows) - ones) / len(rows)
    rare = max(1.0, cfg.rare_share / share * (1 - share) / (1 - cfg.rare_share))
    minor = int(ones * 2 < len(rows))
    docs = []
    for text, y in rows:
        ids, counts = document(text.split(), cfg)
        # 8 bytes a feature from here on: those of all texts are in memory together
        docs.append((ids.astype(np.int32), (counts / max(counts.sum(), 1)).astype(np.float32), y))
    steps = cfg.epochs * len(docs)
    step = 0
    for _ in range(cfg.epochs):
        for k in rng.permutation(len(docs)):
            ids, share_of, y = docs[k]
            rate = cfg.rate * (1 - step / steps) * (rare if y == minor else 1.0)
            step += 1
            mean = share_of @ table[ids] if len(ids) else np.zeros(cfg.width, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            error = -p
            error[y] += 1
            back = error @ out
            # steps are no longer than what would move the output by about ``rate``, so that they can't overshoot
            reach = float(share_of @ share_of) * max(1.0, float((out * out).sum()))
            out += rate / max(1.0, float(mean @ mean)) * np.outer(error, mean)
            bias += rate * error
            if len(ids):
                table[ids] += (rate * min(cfg.table_rate, 1 / reach) * share_of)[:, None] * back
    return QualityModel((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]), cfg)


def fit(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> QualityModel:
    """Train on labels of ids whose crc32 modulo 4 isn't 2; the others are held out."""
    return train(training_rows(docs, labels, "quality", crc_mod(F.col("doc_id"), 4) != 2, cfg.sample), cfg)


def score(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null text is scored as the empty one; a null id is scored, never learnt
    from, and not held out. Only the text is an input of the score. Repeated
    rows get equal scores. Empty tables give a score of 0, or no rows.
    """
    model = fit(docs, labels, cfg)
    scored = with_scores(docs.select("doc_id", "text"), model.scorer(), "text", "score")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cfg.threshold).cast("int").alias("predicted"))
