"""Exact inner-product search: ball trees with branch and bound in every shard.

Vectors are clustered: centres are fitted to a bounded sample, every vector
belongs to the nearest, and large cells are split into shards by hash. A
cell's products with a query q are at most min(q.c + |q| r, |q| m), of its
centre c, radius r and greatest norm m; there are at most ``cells`` of them,
so their balls are known to the driver. Every query first meets one shard of
the cell with its highest bound, then the rest of the ``near`` cells of highest
bound, then all others. The kth score found so far goes with the query: a
round sends it only to cells whose bound reaches that score.

In a shard a tree of balls is built by halving along the direction between
two far points. Queries are taken in groups that are alike. Nodes are opened
in falling order of their bound, best first; a node whose bound is below the
kth score of every query of the group is left closed, with all below it.

A task holds one shard and one block of queries at a time. Products are exact:
in doubles where they can't exceed 2**53, else in 64-bit or Python integers.
Bounds carry a margin for rounding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let, small, write

MOST, LEAST = (1 << 63) - 1, -(1 << 63)


@dataclass(frozen=True)
class SearchConfig:
    """sample and sample_bytes: vectors that centres are fitted to at most; shard_bytes: of a shard's vectors, about."""

    k: int = 5
    shard_rows: int = 8192
    shard_bytes: int = 32 << 20
    block_rows: int = 8192
    leaf_rows: int = 128
    group_rows: int = 64
    cells: int = 1024
    near: int = 4
    sample: int = 16_384
    sample_bytes: int = 32 << 20
    scale: int = 256
    every: int = 50

    def rows_of(self, dim: int) -> int:
        return max(1, min(self.shard_rows, self.shard_bytes // (8 * max(dim, 1))))


def ball_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """An upper bound of each query's products with each ball's vectors."""
    length = np.sqrt((q * q).sum(axis=1))[:, None]
    bound = np.minimum(q @ centres.T + length * radii, length * norms)
    return bound + np.abs(bound) * 1e-9 + length * (norms + radii) * 1e-9 + 1e-6


class BallTree:
    """Centres, radii, greatest norms and row ranges of a shard's nodes, root first.

    ``seen`` counts the (query, vector) products made, for tests and tuning.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int, group: int = 64) -> None:
        self.group, self.seen = group, 0
        fine = x.astype(float)
        order = np.arange(len(x))
        self.nodes: list[list[int]] = []
        centres, radii, norms = [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            part = fine[order[a:b]]
            centre = part.mean(axis=0)
            far = np.sqrt(((part - centre) ** 2).sum(axis=1))
            me = len(self.nodes)
            self.nodes.append([a, b, -1, -1])
            centres.append(centre)
            radii.append(float(far.max()))
            norms.append(float(np.sqrt((part * part).sum(axis=1)).max()))
            if parent >= 0:
                self.nodes[parent][3 if self.nodes[parent][2] >= 0 else 2] = me
            if b - a > leaf and far.max() > 0:
                p = part[far.argmax()]
                q = part[((part - p) ** 2).sum(axis=1).argmax()]
                order[a:b] = order[a:b][np.argsort(part @ (q - p), kind="stable")]
                middle = (a + b) // 2
                todo += [(middle, b, me), (a, middle, me)]
        self.x, self.fine, self.ids, self.rows = x[order], fine[order], ids[order], rows[order]
        self.c, self.r, self.m = np.array(centres), np.array(radii), np.array(norms)
        self.largest = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))

    def products(self, q: np.ndarray, fine: np.ndarray, a: int, b: int) -> np.ndarray:
        """Exact, as 64-bit integers; beyond their range the nearest."""
        most = q.shape[1] * self.largest * int(max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))))
        if most < 1 << 53:
            return (fine @ self.fine[a:b].T).astype(np.int64)
        if most <= MOST:
            return q @ self.x[a:b].T
        whole = q.astype(object) @ self.x[a:b].T.astype(object)
        return np.clip(whole, LEAST, MOST).astype(np.int64)

    def search(self, q: np.ndarray, q_rows: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's number, id, score) of up to k vectors for each query, not of its own row; ``floor``: scores below which none are wanted."""
        fine = q.astype(float)
        leaves = [i for i, node in enumerate(self.nodes) if node[2] < 0]
        best = ball_bounds(fine, self.c[leaves], self.r[leaves], self.m[leaves]).argmax(axis=1)
        order = np.argsort(best, kind="stable")
        found = [self._group(q, fine, q_rows, k, floor, order[i : i + self.group]) for i in range(0, len(order), self.group)]
        return tuple(np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3))  # type: ignore[return-value]

    def _group(self, q: np.ndarray, fine: np.ndarray, q_rows: np.ndarray, k: int, floor: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(mine)
        scores, ids, there = np.full((n, k), LEAST), np.full((n, k), MOST), np.zeros((n, k), bool)
        kth = floor[mine].astype(float)
        bounds = ball_bounds(fine[mine], self.c, self.r, self.m)
        heap = [(-float(bounds[:, 0].max()), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            want = np.flatnonzero(bounds[:, node] >= kth)
            if not len(want):
                continue
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    np.minimum(bounds[:, child], bounds[:, node], out=bounds[:, child])
                    heapq.heappush(heap, (-float(bounds[want, child].max()), child))
                continue
            at = mine[want]
            new = self.products(q[at], fine[at], a, b)
            self.seen += new.size
            valid = q_rows[at][:, None] != self.rows[None, a:b]
            all_scores = np.concatenate([scores[want], new], axis=1)
            all_ids = np.concatenate([ids[want], np.broadcast_to(self.ids[a:b], new.shape)], axis=1)
            all_there = np.concatenate([there[want], valid], axis=1)
            # ~x turns the order of integers round without overflow
            top = np.lexsort((all_ids, ~all_scores, ~all_there), axis=1)[:, :k]
            scores[want], ids[want], there[want] = (np.take_along_axis(x, top, 1) for x in (all_scores, all_ids, all_there))
            full = want[there[want, -1]]
            kth[full] = np.maximum(kth[full], scores[full, -1].astype(float) * (1 - 1e-15 * np.sign(scores[full, -1])))
        i, j = np.nonzero(there)
        return mine[i], ids[i, j], scores[i, j]


def quantised(vectors: DataFrame, cfg: SearchConfig) -> DataFrame:
    """(vec_id, v) of the rows that take part: floor(scale * x) of finite components only."""
    whole = let(F.transform("embedding", lambda x: x.cast("double")), lambda v: F.when(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.transform(v, lambda x: F.floor(x * cfg.scale).cast("long"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).where("v is not null and vec_id is not null")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """At most n centres of a sample's clusters, by Lloyd's rounds from spread rows."""
    c = np.unique(x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        near = _nearest(x, c)
        sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = sums[counts > 0] / counts[counts > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 1024] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 1024)] or [np.zeros(0, np.int64)])


@dataclass
class Cells:
    """The balls of one length of vector: centres, radii, greatest norms, and into how many shards each is split."""

    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    shards: np.ndarray


class Index:
    """``rows`` (dim, cell, shard, row, vec_id, v) of all vectors, and the cells of each length of vector."""

    def __init__(self, vectors: DataFrame, cfg: SearchConfig) -> None:
        self.cfg = cfg
        rows = write(quantised(vectors, cfg).withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors").df
        # cells are fitted for the most frequent lengths; in a sane table there is one. Vectors of others are a cell of no known ball
        counts = {int(r[0]): int(r[1]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(16).collect()}
        fitted = {d: self._fit(rows, d, n) for d, n in counts.items()}

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column(b.schema.names.index("dim")).to_numpy()
                v = b.column(b.schema.names.index("v"))
                cell, far, norm = np.zeros(len(dims), np.int64), np.full(len(dims), np.inf), np.full(len(dims), np.inf)
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    if int(d) in fitted:
                        x = _matrix(v.take(pa.array(at))).astype(float)
                        c = fitted[int(d)]
                        near = _nearest(x, c)
                        cell[at], far[at], norm[at] = near, np.sqrt(((x - c[near]) ** 2).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far), pa.array(norm)], [*b.schema.names, "cell", "far", "norm"])

        placed = write(rows.mapInArrow(assign, "vec_id long, v array<bigint>, dim int, row long, cell long, far double, norm double"), "cells").df
        size = F.greatest(F.lit(1), F.least(F.lit(cfg.shard_rows), F.floor(F.lit(cfg.shard_bytes) / (8 * F.greatest("dim", F.lit(1))))))
        balls = placed.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.max("norm").alias("norm"), F.ceil(F.count(F.lit(1)) / size).alias("shards"))
        balls = write(balls, "balls").df
        split = placed.join(small(balls.select("dim", "cell", "shards")), ["dim", "cell"])
        self.rows = split.select("dim", "cell", F.pmod(F.xxhash64("row"), "shards").alias("shard"), "row", "vec_id", "v")
        self.cells = {}
        for d, c in fitted.items():
            # at most ``cells`` of each of 16 lengths
            known = {int(r["cell"]): r for r in balls.where(F.col("dim") == d).collect()}
            self.cells[d] = Cells(c, *(np.array([float(known[i][k]) if i in known else e for i in range(len(c))]) for k, e in (("radius", 0.0), ("norm", 0.0))), np.array([int(known[i]["shards"]) if i in known else 0 for i in range(len(c))]))
        self.others = balls.where(~F.col("dim").isin(list(fitted) or [-1]))

    def _fit(self, rows: DataFrame, dim: int, n: int) -> np.ndarray:
        cfg = self.cfg
        wanted = min(cfg.cells, -(-n // cfg.rows_of(dim)), max(1, cfg.sample_bytes // (8 * max(dim, 1))))
        if wanted == 1 or dim == 0:
            return np.zeros((1, dim))
        most = min(cfg.sample, max(1, cfg.sample_bytes // (8 * dim)))
        part = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, 0.9 * most / n) * (1 << 30))
        x = rows.where((F.col("dim") == dim) & part).select("v").limit(most).toArrow()
        return centres(_matrix(x.column("v")).astype(float), wanted) if len(x) else np.zeros((1, dim))

    def send(self, asked: DataFrame, turn: int) -> DataFrame:
        """(dim, cell, shard, row, q_id, v, floor): where the queries (dim, row, vec_id, v, floor) go in a round."""
        cells, near = self.cells, self.cfg.near

        def targets(d: int, x: np.ndarray, rows: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, int, int]]:
            c = cells[d]
            bounds = np.where(c.shards > 0, ball_bounds(x, c.centre, c.radius, c.norm), -np.inf)
            order = np.argsort(-bounds, axis=1, kind="stable")
            for i in range(len(x)):
                top = int(order[i, 0])
                own = int(rows[i]) % int(c.shards[top])
                if turn == 0:
                    yield i, top, own
                    continue
                places = order[i, :near] if turn == 1 else order[i, near:]
                for j in places[bounds[i, places] >= floor[i]].tolist():
                    for s in range(int(c.shards[j])):
                        if (j, s) != (top, own):
                            yield i, j, s

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims, rows, floor = (b.column(b.schema.names.index(n)).to_numpy() for n in ("dim", "row", "floor"))
                v = b.column(b.schema.names.index("v"))
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    for i in range(0, len(at), 256):
                        part = at[i : i + 256]
                        x = _matrix(v.take(pa.array(part))).astype(float)
                        to = np.array(list(targets(int(d), x, rows[part], floor[part])), np.int64).reshape(-1, 3)
                        for k in range(0, len(to), 4096):
                            some = to[k : k + 4096]
                            taken = b.take(pa.array(part[some[:, 0]]))
                            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(some[:, 1]), pa.array(some[:, 2])], [*b.schema.names, "cell", "shard"])

        known = asked.where(F.col("dim").isin(list(cells) or [-1]))
        sent = known.mapInArrow(run, "dim int, row long, vec_id long, v array<bigint>, floor double, cell long, shard long")
        if turn == 2:
            # queries of a length without fitted cells meet all its shards
            every = asked.join(self.others.select("dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")), "dim")
            sent = sent.unionByName(every)
        return sent

    def ask(self, sent: DataFrame) -> DataFrame:
        """(row, query_id, vec_id, score): of each shard the k best for each query sent to it, none below its floor."""
        cfg, at = self.cfg, ["dim", "cell", "shard"]
        blocks = write(sent.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / cfg.block_rows).alias("blocks")), "blocks").df
        # only shards that are asked, once for each block of queries
        left = self.rows.join(small(blocks, 100_000), at).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*at, "block", "row", "vec_id", "v")
        right = sent.join(small(blocks, 100_000), at).select(*at, F.pmod(F.xxhash64("row", F.lit(5)), "blocks").alias("block"), "row", F.col("vec_id").alias("q_id"), "v", "floor")
        keys = [*at, "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searcher(cfg), "row long, query_id long, vec_id long, score long")


def _searcher(cfg: SearchConfig):
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(data) or not len(queries):
            return schema.empty_table()
        numbers = lambda t, c: t.column(c).to_numpy()
        tree = BallTree(_matrix(data.column("v")), numbers(data, "vec_id"), numbers(data, "row"), cfg.leaf_rows, cfg.group_rows)
        rows, ids = numbers(queries, "row"), numbers(queries, "q_id")
        q, found, scores = tree.search(_matrix(queries.column("v")), rows, cfg.k, numbers(queries, "floor"))
        return pa.table([pa.array(rows[q]), pa.array(ids[q]), pa.array(found), pa.array(scores)], schema=schema)

    return run


def search(vectors: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``; candidates are
    all other rows, also those of the same id. Vectors that are null or hold a
    null or non-finite component take no part, nor do null ids; vectors of
    different lengths don't meet, and empty ones have products of 0. Repeated
    rows are queries and candidates each. Components and scores beyond 64 bits
    are the nearest that fit. An empty table gives no rows.
    """
    index = Index(vectors, cfg)
    asked = write(index.rows.where(F.col("vec_id") % cfg.every == 0).select("dim", "row", "vec_id", "v", F.lit(float("-inf")).alias("floor")), "queries").df
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    found = None
    for turn in range(3):
        if found is not None:
            kth = found.groupBy("row").agg(F.when(F.count(F.lit(1)) >= cfg.k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor"))
            sent = index.send(asked.drop("floor").join(kth, "row", "left").select("dim", "row", "vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), turn)
        else:
            sent = index.send(asked, turn)
        sent = write(sent, "sent").df
        if found is not None and not sent.limit(1).count():
            continue
        new = index.ask(sent)
        best = (new if found is None else found.drop("rank").unionByName(new)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k)
        found = write(best, "found").df
    return found.select("query_id", "rank", "vec_id", "score")
