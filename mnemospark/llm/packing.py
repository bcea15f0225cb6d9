"""Packing token sequences by minimum bin slack.

A document's ids (and a closing id 0) fill whole windows as far as they go;
what remains has a length below the window's. The multiset of remaining
lengths is all that the packing depends on: at most window - 1 counts,
whatever the input. The largest remaining length opens a window; a subset-sum
dynamic programme over bitsets finds the multiset of other remaining lengths
that comes closest to its capacity, and backtracking gives their counts. The
pattern is used as often as the counts allow before the next one is sought.

A sequence needs no padding if it is full or its length is a power of two, and
a window that lacks ``slack`` ids or fewer is padded. What is left are the last
windows, for which no small lengths remain: their documents are cut into pieces
whose lengths are powers of two. Laid end to end by falling length such pieces
never cross a window's end, nor a power of two's place in the last window, so
these sequences need no padding.

Documents find their place by their number within their length, which comes
from counts per task and length; no length's documents are in one task. Token
ids aren't kept: a piece's checksum is made when the text is tokenised.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import write


@dataclass(frozen=True)
class PackConfig:
    """tokenizer and ranks: files of public_tokenizers, the same vocabulary for two libraries; slack: ids that a window may lack."""

    window: int = 1024
    slack: int = 16
    tokenizer: str = "byte_bpe_50k.json"
    ranks: str | None = "byte_bpe_50k.tiktoken"
    end_id: int = 0
    cache_words: int = 250_000


class Encoder:
    """A text's ids as little-endian 32-bit bytes, as tokenizers makes them.

    The pre-tokenizer ends a token before a space that stands between other
    characters, so a text is cut there and parts are kept in a bounded cache.
    A text with other white space next to a space is encoded as a whole. Parts
    of letters below U+0250 are encoded by tiktoken with the same vocabulary,
    which is faster; both libraries agree there. A text that holds one of the
    tokenizer's added tokens, which have ids of their own, is left to it whole.
    """

    def __init__(self, cfg: PackConfig) -> None:
        import public_tokenizers as files
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(files.path(cfg.tokenizer))
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if cfg.ranks:
            import base64

            import tiktoken

            with open(files.path(cfg.ranks), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.parts: dict[str, bytes | None] = {}
        self.most = cfg.cache_words

    def by_tokenizer(self, text: str) -> bytes:
        ids = self.slow.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or max(text) >= "ɐ":
            return self.by_tokenizer(text)
        ids = self.fast.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def part(self, c: str) -> bytes | None:
        """Ids of a space and ``c``; None if the text can't be cut beside it."""
        ids = None if not c or c[0].isspace() or c[-1].isspace() else self.whole(" " + c)
        if len(c) <= 48:
            if len(self.parts) >= self.most:
                self.parts.clear()
            self.parts[c] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self.by_tokenizer(text)
        first, *rest = text.split(" ")
        if not rest or first and first[-1].isspace():
            return self.whole(text)
        get = self.parts.get
        found = list(map(get, rest))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    x = self.part(rest[i])
                    if x is None:
                        return self.whole(text)
                    found[i] = x
        return self.whole(first) + b"".join(found)


@cache
def _encoder(cfg: PackConfig) -> Encoder:
    return Encoder(cfg)


PIECE = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("crc", T.LongType())])


def tokenised(docs: DataFrame, cfg: PackConfig) -> DataFrame:
    """(doc_id, part, n, full, first, rest, nth, cuts) for each row of (doc_id, text).

    full: pieces of whole windows, ``first`` their number in the task; rest:
    the remaining piece, ``nth`` its number in the task among those of its
    length; cuts: the remaining piece in powers of two.
    """
    pieces = T.ArrayType(PIECE)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("part", T.LongType()), ("n", T.LongType()), ("full", pieces), ("first", T.LongType()), ("rest", PIECE), ("nth", T.LongType()), ("cuts", pieces)))])
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])
    window, end = cfg.window, struct.pack("<I", cfg.end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(cfg).encode
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        first = 0
        for b in batches:
            names = b.schema.names
            rows: list[tuple] = []
            for text in b.column(names.index("text")).to_pylist():
                ids = memoryview(encode(text or "") + end)
                n = len(ids) // 4
                piece = lambda a, k, ids=ids: {"start": a, "length": k, "crc": zlib.crc32(ids[4 * a : 4 * (a + k)])}
                full = [piece(a, window) for a in range(0, n - window + 1, window)]
                left = n % window
                at, cuts = n - left, []
                for bit in reversed(range(left.bit_length())):
                    if left >> bit & 1:
                        cuts.append(piece(at, 1 << bit))
                        at += 1 << bit
                rows.append((part, n, full, first, piece(n - left, left) if left else None, seen[left], cuts))
                seen[left] += 1
                first += len(full)
            kinds = (pa.int64(), pa.int64(), pa.list_(kind), pa.int64(), kind, pa.int64(), pa.list_(kind))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(names.index("doc_id")), *columns], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum comes closest to ``capacity`` from below."""
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((k for k in counts if k <= capacity and counts[k] > 0), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (k * length) & mask
            left -= k
            k *= 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] += k
            at -= k * length
    return dict(used)


def patterns(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(lengths and how often each is in the window, number of such windows), covering ``counts``."""
    left = {k: n for k, n in counts.items() if n > 0}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        used = fill(left, window - seed)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(left[k] // m for k, m in used.items())
        for k, m in used.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
        out.append((used, times))
    return out


def places(counts: dict[int, int], window: int, slack: int = 0) -> tuple[list[tuple[int, int, int, int, int, int, bool]], dict[tuple[int, int], int], int, int]:
    """Where documents of each length and number go.

    Rows (length, least number, number beyond, per window, first window,
    offset, cut); for cut ones the window is that of the length's first cut
    document. Then the position of each (length, power)'s first cut piece, the
    number of windows before the cut ones, and the ids in these.
    """
    rows, base, window_at = [], Counter(), 0
    cut, cuts = [], Counter()
    for used, times in patterns(counts, window):
        total = sum(k * m for k, m in used.items())
        whole = total >= window - slack or total & (total - 1) == 0
        at = 0
        for k in sorted(used, reverse=True):
            m = used[k]
            if whole:
                rows.append((k, base[k], base[k] + m * times, m, window_at, at, False))
                at += k * m
            else:
                cut.append((k, base[k], base[k] + m * times, 1, cuts[k], 0, True))
                cuts[k] += m * times
            base[k] += m * times
        window_at += times if whole else 0
    position, at = {}, 0
    for bit in reversed(range(window.bit_length())):
        for k in sorted(cuts):
            if k >> bit & 1:
                position[k, bit] = at
                at += cuts[k] << bit
    return rows + cut, position, window_at, at


def _tail(total: int, window: int) -> list[tuple[int, int]]:
    """(offset, number) of the sequences that the last window is split into."""
    out, at = [], 0
    f = total % window
    for bit in reversed(range(window.bit_length())):
        if f >> bit & 1:
            out.append((at, len(out)))
            at += 1 << bit
    return out


def pack(docs: DataFrame, cfg: PackConfig = PackConfig(), id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the closing id alone. Every row of ``docs`` is a
    document, also a repeated one or one of a null id. An empty table gives no
    pieces. Other columns are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    rows = write(tokenised(docs.select(F.col(id_col).alias("doc_id"), F.col("text").alias("text")), cfg), "pieces").df
    rest = rows.where("rest is not null").select("doc_id", "part", "n", "rest", "nth", "cuts")
    per_task = rest.groupBy(F.col("rest.length").alias("length"), "part").agg(F.count(F.lit(1)).alias("rows"))
    per_task = write(per_task, "counts").df
    # at most window - 1 rows
    counts = {int(k): int(n) for k, n in per_task.groupBy("length").agg(F.sum("rows")).collect()}
    plan, position, n_whole, n_cut = places(counts, cfg.window, cfg.slack)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    skips = per_task.select(F.col("length").alias("s_length"), F.col("part").alias("s_part"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("skip"))
    numbered = rest.join(skips, (F.col("rest.length") == F.col("s_length")) & (F.col("part") == F.col("s_part"))).withColumn("g", F.col("nth") + F.col("skip"))
    fields = "p_length long, low long, high long, per long, at long, shift long, cut boolean"
    # its rows depend on the window's number of lengths, not on the documents
    table = F.broadcast(spark.createDataFrame(plan, fields))
    placed = numbered.join(table, (F.col("rest.length") == F.col("p_length")) & (F.col("g") >= F.col("low")) & (F.col("g") < F.col("high")))
    k = F.col("g") - F.col("low")
    in_whole = placed.where("not cut").select("doc_id", F.col("rest").alias("p"), "n", (2 * (F.col("at") + F.floor(k / F.col("per")))).alias("sequence_id"), (F.col("shift") + k % F.col("per") * F.col("p_length")).alias("offset"))
    in_full = rows.select("doc_id", "part", "n", "first", F.posexplode("full").alias("i", "p")).select("doc_id", "p", "n", (2 * (F.col("part") * (1 << 32) + F.col("first") + F.col("i")) + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    starts = F.create_map(*(F.lit(x) for (length, bit), at in sorted(position.items()) for x in (f"{length}/{1 << bit}", at))) if position else F.create_map().cast("map<string,bigint>")
    cuts = placed.where("cut").select("doc_id", "n", F.explode("cuts").alias("p"), (F.col("at") + k).alias("nth"), "p_length")
    where = F.try_element_at(starts, F.concat(F.col("p_length").cast("string"), F.lit("/"), F.col("p.length").cast("string"))) + F.col("nth") * F.col("p.length")
    cuts = cuts.select("doc_id", "p", "n", where.alias("where")).select("doc_id", "p", "n", F.floor(F.col("where") / cfg.window).alias("w"), (F.col("where") % cfg.window).alias("o"))
    split: Column = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("o"))
    for at, number in _tail(n_cut, cfg.window)[1:]:
        split = F.when(F.col("o") >= at, F.struct(F.lit(number).cast("long").alias("k"), F.lit(at).cast("long").alias("o"))).otherwise(split)
    last = n_cut // cfg.window
    split = F.when(F.col("w") == last, split).otherwise(F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("o")))
    in_cut = cuts.withColumn("t", split).select("doc_id", "p", "n", (2 * (n_whole + F.col("w") + F.col("t.k"))).alias("sequence_id"), (F.col("o") - F.col("t.o")).alias("offset"))
    out = in_full.unionByName(in_whole).unionByName(in_cut)
    return out.select("doc_id", F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.col("p.crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
