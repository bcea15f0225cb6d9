"""SimHash near-duplicates with deletion-variant signatures.

A 64-bit fingerprint is cut into four segments of 16 bits. Two fingerprints
that differ in six bits or fewer have a segment in which they differ in one
bit at most (four segments with two each would make eight). So each segment
is indexed 16 times, each time with one bit deleted: segments that differ in
one bit agree in the variant that deletes it, and equal ones agree in all.
Pairs come from an equality join of the variants and are verified by the
number of differing bits.

Scale: documents with equal fingerprints are one class, so copies, however
many, are one row in the join. A pair is made under one key only, the first
segment that differs in one bit at most with that bit deleted (bit 0 if the
segments are equal); the test is part of the join's condition, and no
duplicate pair is written or shuffled. A key that more than ``heavy``
fingerprints share is made longer: the 48 bits outside its segment are cut
into four again, which also leaves one that differs in one bit at most, and
the one-wildcard variants of these are added to the key.

Everything is a DataFrame function; there is no Python in the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, UPPER_ASCII, Written, let, one_of_each, row_key, words_of, write

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: width of the segments that a heavy key is made longer by
PART = (BITS - WIDTH) // SEGMENTS


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER_ASCII, LOWER_ASCII))


def shingle_hashes(text: Column, width: int = 2) -> Column:
    """XXH64 (seed 42) of each shingle of ``width`` words, repeats included."""

    def hashes(w: Column) -> Column:
        joined = lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(width)))
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(joined(i)))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(none)

    return let(words_of(ascii_lower(text)), hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fp) for each row of ``docs``; null and empty texts have fingerprint zero."""
    return _prints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))


def _prints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fp`` instead of ``text``.

    The 64 counts are kept as 32 sums of two lanes of 32 bits; shingles are
    exploded and counted in the same stage, so what is shuffled is one row of
    counts for each document.
    """
    keys = [c for c in docs.columns if c != "text"]
    # numbered before it is exploded: in one select the number would be that of the shingle
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), *docs.columns)
    rows = numbered.select("rid", *keys, F.explode_outer(shingle_hashes(F.col("text"))).alias("h"))
    lanes = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(lanes)).alias(f"s{i}") for i in range(32)]
    counted = rows.groupBy("rid", *keys).agg(F.count("h").alias("n"), *sums)
    fp = F.lit(0).cast("bigint")
    for i in range(32):
        low, high = F.col(f"s{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"s{i}", 32)
        for count, bit in ((low, i), (high, i + 32)):
            set_bit = F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("bigint")
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("n"), set_bit).otherwise(F.lit(0).cast("bigint")))
    return counted.select(*keys, fp.alias("fp"))


def _segment(bits: Column, k: int, width: int = WIDTH) -> Column:
    return F.shiftrightunsigned(bits, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _without_bit(segment: Column, p: int, width: int) -> Column:
    low = (1 << p) - 1
    return F.shiftright(segment, 1).bitwiseAND(F.lit(~low & (1 << width - 1) - 1)).bitwiseOR(segment.bitwiseAND(F.lit(low)))


def _keys(bits: Column, width: int) -> Column:
    """The one-wildcard variants of four segments: the number of the deleted bit, then the others of its segment."""
    one = lambda k, p: F.lit((k * width + p) << (width - 1)).bitwiseOR(_without_bit(_segment(bits, k, width), p, width))
    return F.array(*(one(k, p) for k in range(SEGMENTS) for p in range(width)))


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard variants of each fingerprint."""
    return fps.select(F.explode(_keys(F.col("fp"), WIDTH)).alias("key"), "fp")


def _slot(x: Column, width: int) -> Column:
    """Of two fingerprints' xor: the number of the deleted bit under which alone the pair is made."""
    slot = F.lit(-1)
    for k in reversed(range(SEGMENTS)):
        s = _segment(x, k, width)
        # a power of two less one has as many bits set as the number of the bit
        slot = F.when(F.bit_count(s) <= 1, F.lit(k * width) + F.when(s == 0, 0).otherwise(F.bit_count(s - 1))).otherwise(slot)
    return slot


def _outside(fp: Column, key: Column) -> Column:
    """The 48 bits outside the segment that ``key`` is a variant of."""
    at = F.shiftright(key, WIDTH - 1)
    out = F.shiftrightunsigned(fp, WIDTH)
    for k in range(1, SEGMENTS):
        low = (1 << k * WIDTH) - 1
        # the part above the segment comes down by the segment's width
        part = F.shiftrightunsigned(fp, WIDTH).bitwiseAND(F.lit(((1 << 48) - 1) & ~low)).bitwiseOR(fp.bitwiseAND(F.lit(low)))
        out = F.when(at >= k * WIDTH, part).otherwise(out)
    return out


def linked_pairs(fps: DataFrame, most: int = 6, heavy: int = 4096) -> DataFrame:
    """(a, b), a < b: distinct fingerprints that differ in ``most`` bits or fewer, each pair once."""
    if most >= 2 * SEGMENTS:
        raise ValueError(f"four segments find pairs of {2 * SEGMENTS - 1} differing bits at most")
    index = variants(fps)
    hot = write(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).select("key"), "heavy-keys").df
    if not hot.limit(1).count():
        return _meet(index, ["key"], most)
    # each index row goes one of two ways, and so does each pair, whose two rows have one key
    marked = index.hint("merge").join(hot.withColumn("heavy", F.lit(True)).hint("merge"), "key", "left")
    longer = marked.where("heavy").select("key", F.explode(_keys(_outside(F.col("fp"), F.col("key")), PART)).alias("more"), "fp")
    return _meet(marked.where("heavy is null").select("key", "fp"), ["key"], most).unionByName(_meet(longer, ["key", "more"], most))


def _meet(index: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(a, b) of the fingerprints that meet under a key; a pair that meets under several is made under one."""
    a, b = index.select(*keys, F.col("fp").alias("a")), index.select(*keys, F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(x) <= most) & (_slot(x, WIDTH) == F.shiftright("key", WIDTH - 1))
    if len(keys) > 1:
        close = close & (_slot(_outside(x, F.col("key")), PART) == F.shiftright("more", PART - 1))
    # the planner's estimate for an exploded table is that of the table before it, so without the hint it may broadcast the index
    return a.hint("merge").join(b.hint("merge"), keys).where(close).select("a", "b")


def components(edges: Written) -> Written:
    """(fp, label): the smallest fingerprint reachable, for those with a link.

    Each round takes the least label among a node and its neighbours, then
    follows labels once more (a label is itself a node), so chains halve.
    """
    both = edges.df.select(F.col("a").alias("fp"), F.col("b").alias("to")).union(edges.df.select(F.col("b"), F.col("a")))
    labels = write(both.groupBy("fp").agg(F.least(F.col("fp"), F.min("to")).alias("label")), "labels")
    while True:
        seen = both.join(labels.df.select(F.col("fp").alias("to"), "label"), "to").select("fp", "label")
        nearer = seen.union(labels.df).groupBy("fp").agg(F.min("label").alias("label"))
        jumped = nearer.alias("n").join(labels.df.select(F.col("fp").alias("at"), F.col("label").alias("far")), F.col("n.label") == F.col("at"), "left")
        step = jumped.select("fp", F.least("n.label", F.coalesce("far", "n.label")).alias("label"))
        new = write(step, "labels")
        moved = new.df.join(labels.df, ["fp", "label"], "left_anti").limit(1).count()
        labels.drop()
        labels = new
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 6) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, n_near, component_id.

    n_near counts the other rows whose fingerprints differ in ``most`` bits or
    fewer, copies included; component_id is the smallest id that links reach.
    Null and empty texts have fingerprint zero and are linked like others.
    A null id is kept and takes part; a group of null ids only has a null
    component_id. Repeated rows count as separate documents. An empty table
    gives an empty result; other columns of ``docs`` are not looked at.
    """
    rows = write(_prints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "fingerprints").df
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    found = rows.join(_classes(rows, order, most), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", F.col("least.id").alias("component_id"))


def _classes(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """(fp, n_near, least): of each fingerprint; ``least`` is the lowest ``order`` of its component's rows."""
    classes = write(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("least")), "classes")
    edges = write(linked_pairs(classes.df.select("fp"), most), "edges")
    labels = components(edges)
    both = edges.df.select(F.col("a").alias("fp"), F.col("b").alias("to")).union(edges.df.select(F.col("b"), F.col("a")))
    others = both.join(classes.df.select(F.col("fp").alias("to"), "n"), "to").groupBy("fp").agg(F.sum("n").alias("others"))
    whole = classes.df.join(labels.df, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = whole.groupBy("label").agg(F.min("least").alias("least"))
    facts = whole.drop("least").join(least, "label").join(others, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "least")
    facts = write(facts, "classes").df
    for done in (classes, edges, labels):
        done.drop()
    return facts


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 6) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near-duplicates.

    A row with the group's smallest id stays, and it alone; where that id
    stands in several rows of the group, one of them. Ids may be of any type
    that has an order; null ones come last. Columns are those of ``docs``,
    whatever they are called. Which rows stay is found from fingerprints and
    hashes of rows; then the rows are shuffled once, at every size.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *row_key(docs))
    prints = write(_prints(rows), "fingerprints").df
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("k1").alias("k1"), F.col("k2").alias("k2"))
    stays = write(_classes(prints, order, most).select("least.k1", "least.k2").distinct(), "stays").df
    return one_of_each(docs).hint("merge").join(stays.hint("merge"), ["k1", "k2"], "left_semi").select("row.*")
