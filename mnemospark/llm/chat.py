"""Chat formatting by linking quotations to the messages they come from.

A line's quote level is the number of ``>`` it starts with, blanks between
them allowed. Runs of lines of one level are passages, compared by their words
(lower case). Originals are what messages say themselves: any run of their
lines, whether or not quotes stood between them. A passage comes from the
latest earlier turn of its conversation that has such a run of equal words; a
message replies to the latest origin of its least nested passages. Replies
give threads (the first message reached), depths, and positions: in a conversation's thread
by its positions every message follows the one it replies to.

Runs aren't listed. Blocks of 1, 2, 4, ... words have hashes made of those of
their halves. A passage is two blocks of the largest size that fits, one from
its start and one to its end; a message says it where a line starts with the
first block and a line ends, the passage's number of words on, with the second.

"Latest earlier turn" is found without pairing quotes with originals: rows of
a (conversation, hash) are cut into blocks of turns, whose last originals are
carried on, so that a passage many messages share, or one huge conversation,
is no single task's work. Roots are found by pointer jumping, so long chains
take few rounds. Everything is a DataFrame function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Written, let, words_of, write

BLOCK = 4096
_QUOTE = "^((?:[ \\t]*>)+)"


def _lines(text: Column) -> Column:
    """[{level, body}] of a text's lines."""

    def line(x: Column) -> Column:
        level = F.char_length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 1), "[^>]", ""))
        return F.struct(level.alias("level"), F.regexp_replace(x, _QUOTE + " ?", "").alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), line)


def _word_hashes(text: Column) -> Column:
    return F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))


def _doubled(hashes: Column, size: Column) -> Column:
    """Hashes of blocks of twice ``size`` words, by first word, from those of ``size``."""
    n = F.size(hashes) - size
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, size + 1, n), lambda x, y: F.xxhash64(x, y))


def _steps(n: Column) -> Column:
    """[1, ..., n]; empty for a null n or one below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _doublings(n: Column) -> Column:
    """How often blocks of one word can be doubled in ``n`` words, which are one at least."""
    return F.length(F.bin(n)) - 1


def _passage(words: Column) -> Column:
    """(words, size, first, last, hash) of a passage's word hashes: its two largest blocks; null without words."""
    at = F.struct(words.alias("h"), F.lit(1).alias("size"))
    grown = F.aggregate(_steps(_doublings(F.size(words))), at, lambda x, _: F.struct(_doubled(x["h"], x["size"]).alias("h"), (x["size"] * 2).alias("size")))

    def ends(x: Column) -> Column:
        first, last, n = F.get(x["h"], F.lit(0)), F.element_at(x["h"], -1), F.size(x["h"]) + x["size"] - 1
        return F.struct(n.alias("words"), x["size"].alias("size"), first.alias("first"), last.alias("last"), F.xxhash64(n, first, last).alias("hash"))

    return F.when(F.size(words) > 0, let(grown, ends))


def _blocks(own: Column, most: int) -> Column:
    """[{starts, size, place, h}]: blocks of up to ``most`` words that start at ``place``, where a line starts, or end before it, where one ends."""

    def of_line(line: Column) -> Column:
        return let(_word_hashes(line), lambda w: F.transform(w, lambda h, i: F.struct(h.alias("h"), (i == 0).alias("starts"), (i == F.size(w) - 1).alias("ends"))))

    def places(x: Column) -> Column:
        at = F.transform(x, lambda y, i: F.struct(i.alias("i"), y["starts"].alias("starts"), y["ends"].alias("ends")))
        return F.struct(
            F.transform(x, lambda y: y["h"]).alias("h"),
            F.transform(F.filter(at, lambda y: y["starts"]), lambda y: y["i"]).alias("starts"),
            F.transform(F.filter(at, lambda y: y["ends"]), lambda y: y["i"] + 1).alias("ends"),
        )

    def found(x: Column) -> Column:
        def picked(h: Column, size: Column) -> Column:
            row = lambda starts, place, at: F.struct(F.lit(starts).alias("starts"), size.alias("size"), place.alias("place"), F.get(h, at).alias("h"))
            firsts = F.transform(F.filter(x["starts"], lambda i: i < F.size(h)), lambda i: row(True, i, i))
            return F.concat(firsts, F.transform(F.filter(x["ends"], lambda i: i >= size), lambda i: row(False, i, i - size)))

        def grow(acc: Column, _: Column) -> Column:
            more = F.struct(_doubled(acc["h"], acc["size"]).alias("h"), (acc["size"] * 2).alias("size"), acc["rows"].alias("rows"))
            return let(more, lambda m: F.struct(m["h"].alias("h"), m["size"].alias("size"), F.concat(m["rows"], picked(m["h"], m["size"])).alias("rows")))

        one = F.lit(1)
        start = F.struct(x["h"].alias("h"), one.alias("size"), picked(x["h"], one).alias("rows"))
        return F.aggregate(_steps(F.least(_doublings(F.size(x["h"])), F.lit(most.bit_length() - 1))), start, grow, lambda acc: acc["rows"])

    return let(let(F.flatten(F.transform(F.split(own, "\n"), of_line)), places), found)


def parsed(chats: DataFrame) -> DataFrame:
    """(rid, conv_id, turn, role, own, quoted): own text without quotes, and the lines of texts that quote."""
    def parts(x: Column) -> Column:
        own = F.array_join(F.transform(F.filter(x, lambda y: y["level"] == 0), lambda y: y["body"]), "\n")
        return F.struct(F.trim(own, F.lit(SPACE_CHARS)).alias("own"), F.when(F.exists(x, lambda y: y["level"] > 0), x).alias("quoted"))

    rows = chats.select(F.monotonically_increasing_id().alias("rid"), F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), let(_lines(F.col("text")), parts).alias("p"))
    return rows.select("rid", "conv_id", "turn", "role", "p.own", "p.quoted")


def passages(rows: DataFrame) -> DataFrame:
    """(rid, conv_id, turn, level, nth, words, size, first, last, hash): the quoted passages of each message."""
    lines = rows.where("quoted is not null and conv_id is not null and turn is not null").select("rid", "conv_id", "turn", F.posexplode("quoted").alias("i", "x")).select("rid", "conv_id", "turn", "i", "x.level", "x.body")
    order = Window.partitionBy("rid").orderBy("i")
    starts = lines.withColumn("new", F.when(F.coalesce(F.lag("level").over(order) != F.col("level"), F.lit(True)), 1).otherwise(0))
    runs = starts.withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("level > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda y: y["body"]), "\n")
    whole = runs.groupBy("rid", "conv_id", "turn", "level", "nth").agg(body.alias("body"))
    return whole.select("rid", "conv_id", "turn", "level", "nth", let(_word_hashes(F.col("body")), _passage).alias("p")).where("p is not null").select("rid", "conv_id", "turn", "level", "nth", "p.*")


def originals(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of the quoted passages that messages say themselves."""
    wanted = quotes.select("conv_id", "words", "size", "first", "last", "hash").distinct()
    most = quotes.agg(F.max("size")).first()[0] or 0
    said = rows.where(F.lit(most > 0) & F.expr("own <> '' and conv_id is not null and turn is not null"))
    every = said.select("rid", "conv_id", "turn", F.explode(_blocks(F.col("own"), most)).alias("b")).select("rid", "conv_id", "turn", "b.*")
    asked = wanted.select("conv_id", "size", F.lit(True).alias("starts"), F.col("first").alias("h")).union(wanted.select("conv_id", "size", F.lit(False), "last")).distinct()
    # an exploded table is larger than the planner takes it to be
    blocks = write(every.hint("merge").join(asked.hint("merge"), ["conv_id", "size", "starts", "h"], "left_semi"), "blocks").df
    firsts = blocks.where("starts").withColumnRenamed("h", "first").drop("starts")
    meant = firsts.hint("merge").join(wanted.hint("merge"), ["conv_id", "size", "first"]).select("conv_id", "rid", "turn", "size", (F.col("place") + F.col("words")).alias("place"), F.col("last").alias("h"), "hash")
    ends = blocks.where("not starts").select("rid", "size", "place", "h")
    return meant.hint("merge").join(ends.hint("merge"), ["rid", "size", "place", "h"], "left_semi").select("conv_id", "turn", "hash").distinct()


def latest_before(asked: DataFrame, given: DataFrame) -> DataFrame:
    """``asked`` (conv_id, hash, turn, ...) with ``origin``: the latest lower turn of ``given`` with its keys."""
    extra = [c for c in asked.columns if c not in ("conv_id", "hash", "turn")]
    both = asked.withColumn("given", F.lit(None).cast("long")).unionByName(given.withColumn("given", F.col("turn")), allowMissingColumns=True).withColumn("block", F.floor(F.col("turn") / BLOCK))
    key = ["conv_id", "hash"]
    blocks = given.groupBy(*key, F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.max("turn").alias("last"))
    # blocks with a question but no original carry on the one before them
    blocks = blocks.unionByName(asked.select(*key, F.floor(F.col("turn") / BLOCK).alias("block")).distinct().withColumn("last", F.lit(None).cast("long"))).groupBy(*key, "block").agg(F.max("last").alias("last"))
    carried = blocks.withColumn("carried", F.max("last").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    within = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("inside", F.max("given").over(within)).where("given is null")
    found = seen.join(carried, [*key, "block"], "left")
    return found.select(*key, "turn", *extra, F.coalesce("inside", "carried").alias("origin"))


def threads(replies: DataFrame) -> Written:
    """(conv_id, turn, thread, depth) from (conv_id, turn, reply_to), one row for each (conv_id, turn)."""
    now = write(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        far = now.df.select(F.col("conv_id").alias("f_conv"), F.col("turn").alias("f_turn"), F.col("thread").alias("f_thread"), F.col("depth").alias("f_depth"))
        joined = now.df.join(far, (F.col("conv_id") == F.col("f_conv")) & (F.col("thread") == F.col("f_turn")), "left")
        new = write(joined.select("conv_id", "turn", F.coalesce("f_thread", "thread").alias("thread"), (F.col("depth") + F.coalesce("f_depth", F.lit(0))).alias("depth"), F.col("f_turn").isNotNull().alias("moved")), "threads")
        now.drop()
        moved = new.df.where("moved").limit(1).count()
        now = Written(new.spark, new.path, new.df.drop("moved"))
        if not moved:
            return now


def positions(placed: DataFrame) -> DataFrame:
    """(p_conv, p_thread, p_turn, position): numbers of the turns of each thread, counted in blocks of turns."""
    turns = placed.select("conv_id", "thread", "turn").where("conv_id is not null and turn is not null").distinct().withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = turns.groupBy("conv_id", "thread", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id", "thread").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    skips = blocks.select("conv_id", "thread", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    within = Window.partitionBy("conv_id", "thread", "block").orderBy("turn")
    numbered = turns.withColumn("nth", F.row_number().over(within)).join(skips, ["conv_id", "thread", "block"])
    return numbered.select(F.col("conv_id").alias("p_conv"), F.col("thread").alias("p_thread"), F.col("turn").alias("p_turn"), (F.col("nth") + F.col("skip")).alias("position"))


def link(chats: DataFrame) -> DataFrame:
    """One row per row of ``chats`` (conv_id, turn, role, text).

    Columns: conv_id, turn, role, text (without quotes), n_quotes, n_linked
    (passages whose origin was found), reply_to (a turn, null for none),
    thread (the turn it starts with), depth, position (from 1 in the thread) and
    formatted (role, text). Order by conv_id, thread and position for the
    conversations without quotes. A null text is empty; a
    null role is "unknown" in formatted. Messages with a null conversation or
    turn aren't linked. Rows of one conversation and turn are one message for
    those that quote them; if they quote, the latest origin holds for all, and
    they share a position. An empty table gives no rows.
    """
    rows = write(parsed(chats), "messages").df
    quotes = write(passages(rows), "passages").df
    found = latest_before(quotes.select("rid", "conv_id", "turn", "level", "nth", "hash"), originals(rows, quotes))
    top = Window.partitionBy("rid")
    linked = found.withColumn("least", F.min(F.when(F.col("origin").isNotNull(), F.col("level"))).over(top))
    per = linked.groupBy("rid", "conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("origin").alias("n_linked"), F.max(F.when(F.col("level") == F.col("least"), F.col("origin"))).alias("reply_to"))
    per = write(per, "replies").df
    replies = per.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to"))
    ends = threads(replies).df.join(replies, ["conv_id", "turn"])
    ends = ends.select(F.col("conv_id").alias("e_conv"), F.col("turn").alias("e_turn"), "thread", "depth", "reply_to")
    counts = per.select(F.col("rid").alias("c_rid"), "n_quotes", "n_linked")
    out = rows.join(counts, F.col("rid") == F.col("c_rid"), "left").join(ends, (F.col("conv_id") == F.col("e_conv")) & (F.col("turn") == F.col("e_turn")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own"), F.lit("\n<|end|>"))
    placed = out.withColumn("thread", F.coalesce("thread", "turn"))
    placed = placed.join(positions(placed), (F.col("conv_id") == F.col("p_conv")) & (F.col("thread") == F.col("p_thread")) & (F.col("turn") == F.col("p_turn")), "left")
    return placed.select("conv_id", "turn", "role", F.col("own").alias("text"), zero("n_quotes"), zero("n_linked"), "reply_to", "thread", zero("depth"), "position", formatted.alias("formatted"))
