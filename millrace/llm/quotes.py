"""Quotation linking: quoted passages are matched to the messages they come from.

A line's quote level is the number of ``>`` marks it starts with (white space
between them allowed).  Lines of one level that follow each other are a passage.
Passages and messages are normalised (case and runs of white space) and hashed.
What a message may be quoted by: its own text without quotes, whole, each of its
paragraphs (between blank lines) and each of its lines.  A quoted passage, and
each of its lines, is joined to the earliest message that wrote it: the earliest of
its own conversation, if that is earlier than the quote, else the earliest of all.

A message's parent is the original of its best linked quote, if that is earlier than
the message in the order of (conversation, turn).  Best is the lowest level, there a
whole passage before a line, then one from the same conversation, then the longest,
then the first.  Without one the parent is, with ``follow_turns``, the message before
it in its conversation.  Replies are then laid out depth first: ``position`` counts the messages of a thread so that
every message follows its parent and siblings keep their order.

Defined cases: null text has no passages and stays null; null conversation or
turn: the row is kept, links to nothing and is a thread of its own; repeated rows
(same conversation, turn and text) are one message; two texts under one
(conversation, turn) are ordered by their hashes; a passage that many messages
wrote belongs to the first of the conversation, or of all; a quote of nothing known
is counted and dropped from the clean text all the same; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, numbered, spool, text_hash

MARK = r"^(?:[ \t]*>)+[ \t]?"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """message columns with lines: array of struct(pos, level, body)."""
    def line(x: Column, i: Column) -> Column:
        body = F.regexp_replace(x, MARK, "")
        level = F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", ""))
        return F.struct(i.alias("pos"), level.alias("level"), body.alias("body"))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), line)
    return messages.withColumn("lines", lines)


def _passages(lines: Column) -> Column:
    """array of struct(pos, level, body): lines of one level that follow each other, joined.

    The places where the level changes come first; each passage is then cut out once.
    """
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    heads = F.filter(at, lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))

    def passage(heads: Column, i: Column, j: Column) -> Column:
        size = F.coalesce(F.get(heads, j + 1), F.size(lines)) - i
        body = F.array_join(F.transform(F.slice(lines, i + 1, size), lambda x: x["body"]), "\n")
        return F.struct(i.alias("pos"), F.get(lines, i)["level"].alias("level"), body.alias("body"))

    # as a lambda's variable heads is evaluated once
    return F.element_at(F.transform(F.array(heads), lambda h: F.transform(h, lambda i, j: passage(h, i, j))), 1)


def link(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", follow_turns: bool = True) -> DataFrame:
    """One row for each message: its quotes, parent, thread, position in it, and clean text."""
    m = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    m = m.withColumn("th", text_hash()).dropDuplicates(["conv_id", "turn", "role", "th"])
    m = m.withColumn("id", F.xxhash64(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.col("role").isNull(), F.coalesce("role", F.lit("")), "th"))
    m = m.withColumn("at", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.struct("conv_id", "turn", "th", "id")))
    p = parsed(m).withColumn("own", F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n"))
    quoted = F.when(F.exists("lines", lambda x: x["level"] > 0), _passages(F.col("lines")))
    p = spool(p.select("id", "at", "conv_id", "turn", "role", F.col("text").isNotNull().alias("there"), "own", F.coalesce(F.filter(quoted, lambda x: (x["level"] > 0) & (F.length(F.trim(x["body"])) > 0)), F.array().cast("array<struct<pos:int,level:int,body:string>>")).alias("quotes")))

    # originals: whole messages, paragraphs and lines, each filed under the first writer of each conversation
    units = F.array_distinct(F.filter(F.transform(F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n")), normal), lambda x: F.length(x) > 0))
    whole = normal(F.col("q.body"))
    parts = F.filter(F.array_distinct(F.transform(F.split("q.body", "\n"), normal)), lambda x: (F.length(x) > 0) & (x != whole))
    every = F.concat(F.array(F.struct(F.lit(0).alias("part"), whole.alias("unit"))), F.transform(parts, lambda x: F.struct(F.lit(1).alias("part"), x.alias("unit"))))
    asked = p.where(F.size("quotes") > 0).select("id", "at", F.explode("quotes").alias("q")).select("id", "at", "q.pos", "q.level", F.explode(every).alias("u"))
    asked = asked.select("id", "at", "pos", "level", F.col("u.part").alias("part"), (-F.length("u.unit")).alias("short"), F.xxhash64("u.unit").alias("h"), F.col("at.conv_id").alias("conv"))
    wanted = asked.select("h").distinct()
    written = p.where("at is not null").select("at", F.explode(units).alias("unit")).select("at", F.xxhash64("unit").alias("h"))
    here = spool(written.join(wanted, "h", "left_semi").groupBy("h", F.col("at.conv_id").alias("conv")).agg(F.min("at").alias("here")))
    origin = here.groupBy("h").agg(F.min("here").alias("first"))
    linked = asked.join(origin, "h").join(here, ["h", "conv"], "left")
    linked = linked.withColumn("elsewhere", ~F.coalesce(F.col("here") < F.col("at"), F.lit(False)))
    linked = linked.withColumn("origin", F.when(F.col("elsewhere"), F.col("first")).otherwise(F.col("here"))).where(F.col("origin") < F.col("at"))
    found = linked.groupBy("id").agg(F.min(F.struct("level", "part", "elsewhere", "short", "pos", "origin")).alias("best"), F.count_distinct("pos").alias("n_linked")).select("id", F.col("best.origin").alias("quoted_from"), "n_linked")

    tree = p.select("id", "at", "conv_id", "turn", F.size("quotes").cast("long").alias("n_quotes")).join(found, "id", "left")  # texts come last
    if follow_turns:  # a conversation of any length is numbered over many tasks, and met with itself by number
        turns = spool(numbered(p.where("at is not null").select("conv_id", "at", "id"), "conv_id", ["at"], "n"))
        previous = turns.select("conv_id", (F.col("n") + 1).alias("n"), F.col("at").alias("previous"))
        tree = tree.join(turns.join(previous, ["conv_id", "n"]).select("id", "previous"), "id", "left")
    else:
        tree = tree.withColumn("previous", F.lit(None).cast(p.schema["at"].dataType))
    tree = tree.withColumn("parent", F.coalesce("quoted_from", "previous"))
    tree = spool(tree.select("id", "at", "conv_id", "turn", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent"))
    out = tree.select("id", "n_quotes", "n_linked", "parent").join(_places(tree), "id").join(p.select("id", "conv_id", "turn", "role", "there", "own"), "id")
    return out.select(
        "conv_id", "turn", "role", "n_quotes", "n_linked",
        F.col("parent.conv_id").alias("parent_conv_id"), F.col("parent.turn").alias("parent_turn"),
        F.col("root.conv_id").alias("thread_conv_id"), F.col("root.turn").alias("thread_turn"), "position", "depth",
        F.when(F.col("there"), F.trim("own")).alias("clean_text"),
    )


def _places(tree: DataFrame) -> DataFrame:
    """id, root (conv_id, turn), position and depth of each message in its thread.

    A thread's tour goes down to each message, through its replies in order, and up
    again: two arcs for each message, each with a successor that is known from the
    message's first reply, next sibling or parent.  Sums from an arc to the tour's end
    are made by doubling, over arcs that haven't met the end, so neither a long chain
    nor a message that many reply to is held by one row or task.
    """
    kids = tree.where("parent is not null").select("id", F.col("parent.id").alias("up"), "at")
    kids = spool(numbered(kids, "up", ["at"], "n").drop("at"))
    first = kids.where("n = 1").select(F.col("up").alias("id"), F.col("id").alias("child"))
    later = kids.select("up", (F.col("n") - 1).alias("n"), F.col("id").alias("sibling"))
    after = kids.join(later, ["up", "n"], "left").select("id", "up", "sibling")
    near = tree.select("id").join(first, "id", "left").join(after, "id", "left")
    down = F.struct(F.lit(0).alias("k"), F.lit(1).alias("n"), F.lit(1).alias("d"), F.coalesce("child", "id").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_k"))
    up = F.struct(F.lit(1).alias("k"), F.lit(0).alias("n"), F.lit(-1).alias("d"), F.coalesce("sibling", "up").alias("to"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("to_k"))
    arcs = near.select("id", F.explode(F.array(down, up)).alias("x")).select("id", "x.k", F.col("x.n").cast("long").alias("n"), F.col("x.d").cast("long").alias("d"), "x.to", "x.to_k")
    arcs = spool(arcs.withColumn("end", F.when(F.col("to").isNull(), F.col("id"))))
    while arcs.where("to is not null").limit(1).count():
        then = arcs.select(F.col("id").alias("to"), F.col("k").alias("to_k"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("to").alias("to2"), F.col("to_k").alias("to_k2"), F.col("end").alias("end2"))
        went = arcs.where("to is not null").join(then, ["to", "to_k"])
        went = went.select("id", "k", (F.col("n") + F.col("n2")).alias("n"), (F.col("d") + F.col("d2")).alias("d"), F.col("to2").alias("to"), F.col("to_k2").alias("to_k"), F.col("end2").alias("end"))
        old, arcs = arcs, spool(arcs.where("to is null").unionByName(went))
        discard(old)
    tours = arcs.where("k = 0").select("id", "n", (-F.col("d")).alias("depth"), "end")
    whole = tours.where("id = end").join(tree.select("id", F.struct("conv_id", "turn").alias("root")), "id").select("end", F.col("n").alias("all"), "root")
    return tours.join(whole, "end").select("id", "root", (F.col("all") - F.col("n") + 1).alias("position"), "depth")
