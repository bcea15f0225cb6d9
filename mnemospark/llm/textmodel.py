"""What the two text classifiers share: bounded training samples and scoring in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import write


#: bytes of text that the driver trains on at most
TRAINING_BYTES = 64 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, most: int, most_bytes: int = TRAINING_BYTES) -> list[tuple[str, int]]:
    """(text, label) of at most ``most`` labelled rows and ``most_bytes`` bytes.

    Labels have the shares they have among all rows, but the rarer one a
    quarter if there are enough of it.

    Rows are those of ``labels`` where ``learn`` holds, the label is 0 or 1 and
    the id is that of a document; of each label those whose id hashes lowest
    are taken, so reruns take the same ones. Contradicting labels of an id
    count as 1. A text that would exceed the bytes is passed over. Only the
    ids drawn, ``most`` at the most, are broadcast to the documents.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label_col).alias("__label"))
    there = docs.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct()
    rows = rows.join(there, F.col("doc_id") == F.col("__id"), "left_semi")
    found = write(rows, "labelled").df
    n = {int(r[0]): r[1] for r in found.groupBy("__label").agg(F.count(F.lit(1))).collect()}
    ones = min(max(n.get(1, 0) / max(sum(n.values()), 1), 0.25), 0.75)
    part = lambda v, share: found.where(F.col("__label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(round(most * share))
    drawn = write(part(1, ones).unionByName(part(0, 1 - ones)).select(F.col("doc_id").alias("__id"), "__label"), "drawn")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn.df), F.col("doc_id") == F.col("__id"))
    texts = texts.select(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t")).alias("at"), "text", "__label")
    texts = write(texts, "training")
    # an id that stands in several rows may give more rows than were drawn
    sizes = texts.df.select("at", F.octet_length("text").alias("n")).orderBy("at").limit(most).collect()
    taken, room = [], most_bytes
    for r in sizes:
        if r["n"] <= room:
            taken.append((r["at"]["h"], r["at"]["t"]))
            room -= r["n"]
    out: list[tuple[str, int]] = []
    if taken:
        chosen = docs.sparkSession.createDataFrame(sorted(set(taken)), "h long, t long")
        found = texts.df.join(F.broadcast(chosen), (F.col("at.h") == F.col("h")) & (F.col("at.t") == F.col("t")), "left_semi")
        out = [(r[0], int(r[1])) for r in found.orderBy("at").limit(len(taken)).select("text", "__label").collect()]
    drawn.drop()
    texts.drop()
    return out


_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def hashed_ngrams(words: list[str], least: int, most: int, bits: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of every character n-gram of the words.

    A word's ends are marked by < and >. Buckets are the top ``bits`` bits of
    a mixed polynomial hash, computed for all words at once. ``whole`` adds a
    bucket for each entire word.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(ends, sizes) - np.arange(len(codes))
    shift = np.uint64(64 - bits)
    owners, buckets = [], []
    with np.errstate(over="ignore"):
        h = codes + np.uint64(1)
        for n in range(2, most + 1):
            h = h[:-1] * _STEP + codes[n - 1 :]
            if n >= least and len(h):
                fits = room[: len(h)] >= n
                owners.append(owner[: len(h)][fits])
                mixed = (h[fits] ^ (h[fits] >> np.uint64(29))) * _MIX
                buckets.append(((mixed ^ (mixed >> np.uint64(32))) * _STEP >> shift).astype(np.int64))
        if whole:
            place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
            power = np.cumprod(np.full(int(sizes.max()), _MIX, np.uint64))
            h = np.add.reduceat(codes * power[place], ends - sizes)
            mixed = (h ^ (h >> np.uint64(31))) * _STEP
            owners.append(np.arange(len(words)))
            buckets.append(((mixed ^ (mixed >> np.uint64(30))) * _MIX >> shift).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def word_hashes(words: list[str]) -> np.ndarray:
    """64 bits of each word; those of a word don't depend on the others."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer("".join(f"<{w}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(codes * np.cumprod(np.full(int(sizes.max()), _STEP, np.uint64))[place], starts)
        return (h ^ (h >> np.uint64(31))) * _MIX


def bigram_buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each two words that follow one another, from the words' hashes."""
    with np.errstate(over="ignore"):
        h = hashes[:-1] * _STEP + hashes[1:]
        return (((h ^ (h >> np.uint64(29))) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def slices(texts: list[str], chars: int = 500_000) -> Iterator[list[str]]:
    """The texts in lists of about ``chars`` characters, or one longer text."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def with_scores(docs: DataFrame, scorer: Callable[[list[str]], list[float]], text_col: str, name: str) -> DataFrame:
    """``docs`` with a double column ``name``: the score of each whole text (null: empty)."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            scores = scorer(["" if t is None else t for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(batches, schema)
