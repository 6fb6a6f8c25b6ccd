"""Quotation linking: quote levels parsed, quoted passages hashed and joined to the messages they come from, replies in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import before, kept

#: A line's quote marks, and a line that only says who wrote what is quoted next.
MARKS = r"^[ \t]?(?:>[ \t]?)+"
INTRODUCTION = r"(?i)^\s*(on\b.*\bwrote|.*\b(schrieb|a écrit|escribió)\b.*)\s*:\s*$"


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.char_length(marks) - F.char_length(F.replace(marks, F.lit(">"), F.lit("")))


def _passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, th, level, lo, h1, h2, n, start): runs of lines of one quote level, their text normalised and hashed;
    n counts the lines, start is the hash of the first.

    Normalised: without marks, white space as single spaces, lower-cased. Blank lines neither cut a run nor count;
    an introduction above a quote belongs to no run.
    """
    lines = messages.select("conv", "turn", "th", F.posexplode(F.split("text", "\r?\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("level", _level(F.col("line")))
    lines = lines.withColumn("said", F.trim(F.regexp_replace(F.lower(F.regexp_replace("line", MARKS, "")), r"\s+", " ")))
    lines = lines.where((F.col("said") != "") & ~F.col("line").rlike(INTRODUCTION))
    order = Window.partitionBy("conv", "turn", "th").orderBy("pos")
    lines = lines.withColumn("run", F.sum(F.when(F.col("level") == F.lag("level").over(order), 0).otherwise(1)).over(order))
    runs = lines.groupBy("conv", "turn", "th", "run", "level").agg(F.min("pos").alias("lo"), F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("said"))
    text = F.array_join(F.transform("said", lambda x: x["said"]), " ")
    return runs.select("conv", "turn", "th", "level", "lo", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.size("said").alias("n"), F.xxhash64(F.col("said")[0]["said"]).alias("start"))


def _own_units(messages: DataFrame) -> DataFrame:
    """What of a message others may quote: its own lines, its own paragraphs and all it says itself, hashed."""
    own = F.filter(F.split("text", "\r?\n", -1), lambda x: (_level(x) == 0) & ~x.rlike(INTRODUCTION))
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    whole = F.array_join(own, "\n")
    units = F.array_distinct(F.concat(F.transform(own, norm), F.transform(F.split(whole, r"\n[ \t]*\n"), norm), F.array(norm(whole))))
    found = messages.select("conv", "turn", F.explode(units).alias("unit")).where("unit != ''")
    return found.select("conv", "turn", F.xxhash64("unit").alias("h1"), F.xxhash64(F.lit(1), "unit").alias("h2")).distinct()


def _own_spans(messages: DataFrame, starts: DataFrame) -> DataFrame:
    """(conv, turn, h1, h2): runs of a message's own lines without the blank ones, hashed as passages are; of so many
    lines and from such first lines as the starts (conv, start, n) name."""
    own = F.filter(F.split("text", "\r?\n", -1), lambda x: (_level(x) == 0) & ~x.rlike(INTRODUCTION))
    said = F.filter(F.transform(own, lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))), lambda x: x != "")
    lines = messages.select("conv", "turn", "th", F.posexplode(said).alias("pos", "line"))
    found = lines.select("conv", "turn", "th", "pos", F.xxhash64("line").alias("start")).join(starts, ["conv", "start"])
    found = found.groupBy("conv", "turn", "th").agg(F.collect_set(F.struct("pos", "n")).alias("spans"))
    whole = messages.select("conv", "turn", "th", said.alias("said")).join(found, ["conv", "turn", "th"])
    whole = whole.select("conv", "turn", "said", F.explode("spans").alias("span")).where(F.col("span.pos") + F.col("span.n") <= F.size("said"))
    text = F.array_join(F.slice("said", F.col("span.pos") + 1, F.col("span.n")), " ")
    return whole.select("conv", "turn", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def without_quotes(text: Column) -> Column:
    """What a message says itself: no quoted lines, no introductions, no blank lines at the ends."""
    own = F.filter(F.split(text, "\r?\n", -1), lambda x: (_level(x) == 0) & ~x.rlike(INTRODUCTION))
    return F.regexp_replace(F.array_join(own, "\n"), r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations in reply order, without quotes.

    Returns (conv_id, turn, role, text, body, n_quotes, n_linked, parent_turn, depth, position), one row per message.
    A quoted passage of level 1 is looked up among what earlier messages of the conversation say themselves, as a
    line, a paragraph, a whole or any lines that follow each other, blank ones apart; the latest that says it is meant, and the last of a message's linked passages
    names its parent. Deeper levels count as linked if some earlier message of the conversation says them. Messages
    without a parent are roots; each is followed by its replies, depth first, by turn.

    Only hashes meet, and only hashes that some message quotes leave the originals, so a passage that a third
    of the messages repeat is sent on only where it is quoted; the latest message that says it is handed on in a sort by
    ranges. Positions come from a tour of the trees and a sort by ranges, so one very long conversation, chain of
    replies or crowd of replies to one message is dealt over many tasks.

    Null texts are empty and have no quotes. Null conversation ids or turns are values of their own and come first.
    Repeated rows each stay; rows that share a conversation and a turn are ordered by their texts' hash. Other
    columns are ignored; an empty table gives none.
    """
    base = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    quoting = base.where(F.col("text").rlike("(?m)" + MARKS)).select("conv", "turn", "th", "text").distinct()  # a repeated row quotes once
    quotes = kept(_passages(quoting).where("level > 0"))
    wanted = quotes.select("conv", "h1", "h2").distinct()
    units = _own_units(base)
    starts = quotes.where("n > 1").select("conv", "start", "n").distinct()
    if not starts.isEmpty():
        units = units.union(_own_spans(base, starts))
    units = units.join(wanted, ["conv", "h1", "h2"], "left_semi")
    said = units.select("conv", "h1", "h2", "turn", F.lit(1).alias("kind"), F.col("turn").alias("told"))
    asked = quotes.select("conv", "h1", "h2", "turn", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("told"), "th", "level", "lo")
    met = before(asked.unionByName(said, allowMissingColumns=True), ["conv", "h1", "h2"], ["turn", "kind"], "told", "source")
    linked = met.where("kind = 0").withColumn("source", F.when(F.col("conv").isNotNull(), F.col("source")))
    own = linked.groupBy("conv", "turn", "th").agg(F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"), F.max_by("source", F.when((F.col("level") == 1) & F.col("source").isNotNull(), F.col("lo"))).alias("parent_turn"))
    own = own.select(*(F.col(c).alias(f"q_{c}") for c in ("conv", "turn", "th")), "n_quotes", "n_linked", "parent_turn")
    rows = base.join(own, (F.col("conv") == F.col("q_conv")) & (F.col("turn") == F.col("q_turn")) & (F.col("th") == F.col("q_th")), "left").drop("q_conv", "q_turn", "q_th")
    rows = rows.withColumn("body", without_quotes(F.col("text")))

    links = own.where("parent_turn is not null").groupBy(F.col("q_conv").alias("conv"), F.col("q_turn").alias("turn")).agg(F.max("parent_turn").alias("parent"))
    places = _toured(links).select(F.col("conv").alias("p_conv"), F.col("turn").alias("p_turn"), "root", "place", "depth")
    rows = rows.join(places, (F.col("conv") == F.col("p_conv")) & (F.col("turn") == F.col("p_turn")), "left").drop("p_conv", "p_turn")
    rows = rows.withColumns({"root": F.coalesce("root", "turn"), "place": F.coalesce("place", F.lit(-1)), "depth": F.coalesce("depth", F.lit(0)).cast("int")})
    return _numbered(rows).select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col), "body", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn", "depth", "position")


def _toured(links: DataFrame) -> DataFrame:
    """(conv, turn, root, place, depth) of all messages of trees (conv, turn, parent); parents are earlier turns.

    A tour enters each message, its replies in order, and leaves it; element 2t enters turn t and 2t + 1 leaves it. Each
    element knows the next one, and rounds of doubling add up how many messages are entered and left from it to the
    tour's end: that is the order, negative in place, and the depth. A row stays small however long the chain of replies.
    """
    links = kept(links)
    child = links.select("conv", "turn", "parent", (-F.col("turn")).alias("late"))
    child = before(child, ["conv", "parent"], ["late"], "turn", "sibling")  # the next one, as later ones come first
    roots = links.select("conv", F.col("parent").alias("turn")).distinct().join(links.select("conv", "turn"), ["conv", "turn"], "left_anti")
    nodes = child.select("conv", "turn", F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("after"))
    nodes = nodes.unionByName(roots.withColumn("after", F.lit(None).cast("long")))
    first = links.groupBy(F.col("conv").alias("c_conv"), F.col("parent").alias("c_turn")).agg(F.min("turn").alias("first"))
    nodes = nodes.join(first, (F.col("conv") == F.col("c_conv")) & (F.col("turn") == F.col("c_turn")), "left")
    enter = F.struct((F.col("turn") * 2).alias("at"), F.coalesce(F.col("first") * 2, F.col("turn") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(0).cast("long").alias("left"), F.col("turn").alias("last"))
    leave = F.struct((F.col("turn") * 2 + 1).alias("at"), F.col("after").alias("next"), F.lit(0).cast("long").alias("entered"), F.lit(1).cast("long").alias("left"), F.col("turn").alias("last"))
    now = kept(nodes.select("conv", F.explode(F.array(enter, leave)).alias("e")).select("conv", "e.*"))
    while not now.where("next is not null").isEmpty():
        ahead = now.select(F.col("conv").alias("a_conv"), F.col("at").alias("a_at"), F.col("next").alias("a_next"), F.col("entered").alias("a_entered"), F.col("left").alias("a_left"), F.col("last").alias("a_last"))
        met = now.join(ahead, (F.col("conv") == F.col("a_conv")) & (F.col("next") == F.col("a_at")), "left")
        more = lambda c: (F.col(c) + F.coalesce(f"a_{c}", F.lit(0))).alias(c)
        now = kept(met.select("conv", "at", F.col("a_next").alias("next"), more("entered"), more("left"), F.coalesce("a_last", "last").alias("last")))
    return now.where("at % 2 = 0").select("conv", (F.col("at") / 2).cast("long").alias("turn"), F.col("last").alias("root"), (-F.col("entered")).alias("place"), (F.col("left") - F.col("entered")).cast("int").alias("depth"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds position, from 1 in each conversation by root and place. Sorted by ranges; each range counts its own rows of a
    conversation, and the counts of the ranges before are added."""
    placed = kept(rows.repartitionByRange("conv", "root", "place", "turn", "th").sortWithinPartitions("conv", "root", "place", "turn", "th").withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("range", F.shiftright("place", 33))
    counts = placed.groupBy("conv", "range").agg(F.min("place").alias("low"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("conv").alias("s_conv"), F.col("range").alias("s_range"), "low", before.alias("before"))
    out = placed.join(starts, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("range") == F.col("s_range")))
    return out.withColumn("position", F.col("place") - F.col("low") + F.col("before") + 1)
