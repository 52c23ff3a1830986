"""Conversations from event logs, and their chat format. DataFrame functions only.

A log has a row for each event of a conversation: (conv, seq, kind, message, role, text).

* ``message`` opens a message with a role and a first text;
* ``delta`` appends to it;
* ``edit`` replaces its text;
* ``regenerate`` empties it and takes back every later message that was there then.

Events are first folded by message, then messages by conversation, so the log of a
long conversation is aggregated in parts; what meets in one row is a conversation's
final messages, which the format needs in one string anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The control strings of the template.
OPEN, BODY, END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"([<\[])(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    """``text`` without control strings: backslashes are doubled, and one goes inside each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv, place, role, text): the final messages of each conversation, ``place`` by when they were opened.

    Null texts are empty and null roles are empty roles; of equal ``seq`` values, texts
    go in order. Events of a message that was never opened count as if opened by the
    first of them. Null conversations are one conversation. Repeated rows are repeated
    events. No events, no rows. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    resets = F.col("kind").isin("message", "edit", "regenerate")
    message = events.groupBy("conv", "message").agg(
        F.min("seq").alias("opened"),
        F.max(F.when(resets, F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.sort_array(F.collect_list(F.struct("seq", text.alias("text")))).alias("parts"),
    )
    live = F.filter("parts", lambda p: F.col("reset").isNull() | (p["seq"] >= F.col("reset")))
    folded = message.select("conv", "message", "opened", "regenerated", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda p: p["text"]), "").alias("text"))
    earlier = Window.partitionBy("conv").orderBy("opened", "message").rowsBetween(Window.unboundedPreceding, -1)
    taken_back = F.coalesce(F.max("regenerated").over(earlier) > F.col("opened"), F.lit(False))
    return folded.withColumn("gone", taken_back).where("not gone").select("conv", F.struct("opened", "message").alias("place"), "role", "text")


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv, formatted, segments) of final messages.

    ``formatted`` is the segments' texts in order. A segment with ``loss`` is a text of
    the role ``learn``, escaped as it stands in ``formatted``; the segments are the loss
    mask as run lengths. Control strings inside roles and texts are escaped.
    """
    turn = F.struct("place", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == learn).alias("loss"))
    turns = messages.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        plain = F.lit(False)
        return F.array(
            F.struct(F.concat(F.lit(OPEN), t["role"], F.lit(BODY)).alias("text"), plain.alias("loss")),
            F.struct(t["text"].alias("text"), t["loss"].alias("loss")),
            F.struct(F.lit(END + CLOSE).alias("text"), plain.alias("loss")),
        )

    cut = turns.select("conv", F.flatten(F.transform("turns", segments)).alias("segments"))
    return cut.select("conv", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    whole = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")

    def turn(t: Column) -> Column:
        halves = F.split(t, r"\[INST\]", 2)
        role, body = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
        return F.struct(
            unescape(F.substring(role, len(OPEN) + 1, 1 << 30)).alias("role"),
            unescape(F.substr(body, F.lit(1), F.length(body) - len(END))).alias("text"),
        )

    return F.transform(whole, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def events_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """An event log of conversations that are stored as turns: each row opens a message, by turn (null first, ties by role and text)."""
    order = Window.partitionBy(conv).orderBy(turn, role, text)
    return rows.select(F.col(conv).alias("conv"), F.row_number().over(order).cast("long").alias("seq"), F.lit("message").alias("kind"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).withColumn("message", F.col("seq"))
