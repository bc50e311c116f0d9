"""Quotation linking: messages without quotes, in reply order.

A message's lines are parsed into quote levels (``>`` markers, also ``> >`` and ``>>``). Its passages are the lines and the
paragraphs (lines up to a blank one or another level, so a quote may be wrapped anew) of one level; they are normalised (lower
case, letters and digits, single spaces), hashed, and joined to the messages of the same conversation that say them without
quoting, earlier. A passage of any level links a message to the latest earlier message that says it. The message's parent is found at
the shallowest level that links at all: the linked message with most passages of that level, the latest of equals; deeper
levels are quotes of what that message quotes in turn, so they decide only where no shallower one links. Threads: a message without a parent starts one; replies stand below their thread's first message, in turn order,
so each message comes after the one it answers.

Scale: passages travel as hashes; only those that someone quotes are joined. The latest earlier turn is found by running maxima within
chunks of ``CHUNK`` turns and over the chunks' ends, so a conversation or a line with a third of all rows is dealt to many
tasks; no pairs of equal lines are built. Thread roots are found by pointer doubling (rounds: logarithm of the depth).

Edge cases: null text has no lines; a null conv_id is a conversation of its own kind (null rows belong together); a null turn sorts
first and is quoted by none; repeated rows (same conversation and turn) are told apart by the row and share links; a quote that no
earlier message holds links to none and is still removed; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litfeed.llm.common import let, positions, written

CHUNK = 4096

#: A quote marker at the start of a line: levels are its ``>`` characters.
MARKER = r"^[\x20\t]*((?:>[\x20\t]?)+)"
#: The line that announces a quote ("On ... X wrote:"); it goes with the quote below it.
INTRODUCTION = r"(?i)^.*\b(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"


def normalised(line):
    """A line as it is compared: lower case, only letters and digits of any script, single spaces."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _passages(lines, level):
    """Distinct hashes of the lines and paragraphs of one level (a number or a column)."""
    text = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["text"]).otherwise("")), "\n")
    parts = F.concat(F.split(text, "\n"), F.split(text, r"\n[\x20\t]*\n"))
    return F.transform(F.array_distinct(F.filter(F.transform(parts, normalised), lambda x: x != "")), lambda x: F.xxhash64(x))


def _asked(lines):
    """(level, hash) of the passages of every quote level."""
    levels = F.array_distinct(F.filter(F.transform(lines, lambda x: x["level"]), lambda v: v > 0))
    return F.flatten(F.transform(levels, lambda v: F.transform(_passages(lines, v), lambda h: F.struct(v.alias("level"), h.alias("hash")))))


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with the hashes it says and asks for, its numbers of quoted passages and lines, and its text without quotes."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKER, 1), r"[^>]", ""))
    cut = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), r"\r?\n"), lambda x: F.struct(
        level(x).alias("level"), F.regexp_replace(x, MARKER, "").alias("text")))
    # an introduction right above a quote belongs to it
    lines = let(cut, lambda c: F.transform(c, lambda x, i: F.struct(
        F.when((x["level"] == 0) & x["text"].rlike(INTRODUCTION) & (F.get(c, i + 1)["level"] > 0), F.lit(-1))
        .otherwise(x["level"]).alias("level"), x["text"].alias("text"))))
    d = messages.withColumn("lines", lines)
    levels = F.transform("lines", lambda x: x["level"])
    starts = let(levels, lambda v: F.size(F.filter(F.transform(
        v, lambda x, i: (x > 0) & ~F.get(v, i - 1).eqNullSafe(x)), lambda x: x)))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    quoted = F.exists("lines", lambda x: x["level"] != 0)
    own = F.when(quoted, F.regexp_replace(own, r"^\s+|\s+$", "")).otherwise(F.coalesce(F.col("text"), F.lit("")))
    return d.select(*messages.columns, _passages(F.col("lines"), 0).alias("says"), _asked(F.col("lines")).alias("asks"),
                    starts.cast("long").alias("n_passages"),
                    F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"), own.alias("own"))


def latest_earlier(rows: DataFrame) -> DataFrame:
    """Rows (conv, hash, turn, asks, ...) with ``found``: the latest earlier turn of a row of the same conversation and
    hash that does not ask."""
    said = F.when(~F.col("asks"), F.col("turn"))
    d = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    within = Window.partitionBy("conv", "hash", "chunk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("near", F.max(said).over(within))
    ends = d.groupBy("conv", "hash", "chunk").agg(F.max(said).alias("last"))
    before = Window.partitionBy("conv", "hash").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("far", F.max("last").over(before)).drop("last")
    a, b = d.alias("a"), ends.alias("b")
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.hash") == F.col("b.hash")) & (F.col("a.chunk") == F.col("b.chunk"))
    return a.join(b, same).select("a.*", F.coalesce("a.near", "b.far").alias("found")).drop("near")


def linked(messages: DataFrame) -> DataFrame:
    """(row, conv, turn, n_passages, n_quoted, n_linked, parent_turn, own) per message of ``messages(row, conv, turn, text)``."""
    p = written(parsed(messages), "parsed")
    of = lambda name: p.filter(F.col("turn").isNotNull()).select("row", "conv", "turn", F.explode(name).alias("hash"))
    quotes = of("asks").select("row", "conv", "turn", "hash.level", "hash.hash", F.lit(True).alias("asks"))
    wanted = quotes.select("conv", "hash").distinct()
    own = of("says").groupBy("conv", "turn", "hash").agg(F.min("row").alias("row"))
    a, w = own.alias("a"), wanted.alias("w")
    own = a.join(w, F.col("a.conv").eqNullSafe(F.col("w.conv")) & (F.col("a.hash") == F.col("w.hash")), "left_semi").select(
        "row", "conv", "turn", F.lit(0).alias("level"), "hash", F.lit(False).alias("asks"))
    found = latest_earlier(quotes.unionByName(own)).filter(F.col("asks") & F.col("found").isNotNull())
    votes = found.groupBy("row", "level", "found").agg(F.count("*").alias("n"))
    parents = votes.groupBy("row").agg(F.max(F.struct((-F.col("level")).alias("shallow"), "n", "found"))["found"].alias("parent_turn"),
                                       F.sum("n").alias("n_linked"))
    return p.join(parents, "row", "left").select(
        "row", "conv", "turn", "n_passages", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn", "own")


def threaded(links: DataFrame) -> DataFrame:
    """``links`` with ``thread_turn``: the turn that starts the message's thread, by pointer doubling."""
    key = links.select("conv", "turn", "parent_turn")
    # turns that answer another; all others start a thread
    up = written(key.filter(F.col("parent_turn").isNotNull()).groupBy("conv", "turn").agg(
        F.max("parent_turn").alias("up")), "parents")
    moved = not up.isEmpty()
    while moved:
        a, b = up.alias("a"), up.alias("b")
        hop = a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.up") == F.col("b.turn")), "left")
        up = written(hop.select("a.conv", "a.turn", F.coalesce("b.up", "a.up").alias("up"),
                                F.col("b.up").isNotNull().alias("moved")), "hops")
        moved, up = not up.filter("moved").isEmpty(), up.drop("moved")
    a, b = links.alias("a"), up.alias("b")
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & F.col("a.turn").eqNullSafe(F.col("b.turn"))
    return a.join(b, same, "left").select("a.*", F.coalesce("b.up", "a.turn").alias("thread_turn"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message of ``messages(conv_id, turn, role, text)``: conv_id, turn, role, position in reply order, thread_turn,
    parent_turn, counts of quotes, and the text without quotes."""
    m = written(messages.select("conv_id", "turn", "role", "text").withColumn("row", F.monotonically_increasing_id()), "messages")
    links = linked(m.select("row", F.col("conv_id").alias("conv"), "turn", "text"))
    ordered = positions(threaded(links), "conv", [F.col("thread_turn"), F.col("turn"), F.col("row")], "position")
    return ordered.join(m.select("row", "role"), "row").select(
        F.col("conv").alias("conv_id"), "turn", "role", "position", "thread_turn", "parent_turn", "n_passages", "n_quoted", "n_linked",
        F.col("own").alias("text"))
