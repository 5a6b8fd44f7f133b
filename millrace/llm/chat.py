"""Chats from logs of events: rebuilt, formatted with turn marks and a loss mask, and read back. DataFrame functions only.

A log has conv_id, seq, kind, message, role and text, and is folded in the order of seq (of equal ones: message, kind, role, text; nulls first):

- `message` begins a message with a role and a text, or sets both anew if the message has begun; without a message name it is a message of its own,
- `delta` adds its text to the message's end, `edit` puts its text in place of the message's,
- `regenerate` does so as well, and what was begun after the message is dropped from the conversation for good.

Whichever event comes first begins its message. The role is the last one given. Other kinds are ignored.

A conversation is formatted as one text, so all of it meets in one task and row at last (2 GB at most): the log is dealt by conversation once, and each event's text moves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A turn is OPEN, its role, NAMED, its text, SHUT. Inside roles and texts ESCAPES stand for the characters that marks are made of.
OPEN, NAMED, SHUT = "<turn ", ">", "</turn>\n"
#: In this order when read back: every backslash of an escaped text begins an escape, so `\\b` is undone last.
ESCAPES = (("<", "\\l"), (">", "\\g"), ("\\", "\\b"))
ORDER = ("seq", "message", "kind", "role", "text")


def escaped(text: Column) -> Column:
    """Without `<` and `>`, each backslash followed by b, l or g; `unescaped` gives the text back."""
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the final messages; `at` orders those of a conversation.

    Null texts and roles are empty, null conversations are one. Rows that repeat are events of their own. Events of a dropped message still count in the fold:
    its regeneration drops what was begun after it. An empty log has no messages; further columns don't matter.
    """
    events = log.select("conv_id", "seq", "kind", "message", "role", "text").where("kind in ('message', 'delta', 'edit', 'regenerate')")
    by_seq = W.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ORDER))
    numbered = events.withColumn("at", F.row_number().over(by_seq)).withColumn("alone", F.when(F.col("message").isNull(), F.col("at")))
    own = W.partitionBy("conv_id", "message", "alone")
    whole = numbered.withColumns({
        "first": F.min("at").over(own),
        "reset": F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(own),
    })
    # the earliest-begun message that is regenerated later on: if it began before this one, this one is dropped
    later = W.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, W.currentRow)
    judged = whole.withColumn("again", F.min(F.when(F.col("kind") == "regenerate", F.col("first"))).over(later))
    text = F.when(F.col("at") >= F.coalesce("reset", F.lit(0)), F.coalesce("text", F.lit("")))
    parts = judged.groupBy("conv_id", "message", "alone").agg(
        F.min("first").alias("at"),
        F.max_by("again", -F.col("at")).alias("again"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
        F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct("at", text.alias("text"))))).alias("texts"),
    )
    kept = parts.where("again is null or again >= at")
    return kept.select("conv_id", "at", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.col("texts.text"), "").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): a conversation's text, and the spans of it that are learned from, in code points: the texts of the role `learn`.

    A span is (turn, turn_start, start, length): the turn's number and where it and the span begin in `formatted`, from 0. Turns without loss have none.
    """
    head, body = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(NAMED)), escaped(F.col("text"))
    drawn = messages.select("conv_id", "at", (F.col("role") == learn).alias("learned"), F.length(head).cast("long").alias("ahead"), F.length(body).cast("long").alias("length"), F.concat(head, body, F.lit(SHUT)).alias("turn"))
    before = W.partitionBy("conv_id").orderBy("at")
    placed = drawn.withColumns({"number": F.row_number().over(before) - 1, "start": F.sum(F.length("turn")).over(before.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.length("turn")})
    span = F.when(F.col("learned"), F.struct(F.col("number").alias("turn"), F.col("start").alias("turn_start"), (F.col("start") + F.col("ahead")).alias("start"), "length"))
    lists = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "turn"))).alias("turns"), F.sort_array(F.collect_list(span)).alias("loss"))
    return lists.select("conv_id", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss")


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, SHUT), lambda t: t != "")
    body = lambda t: F.substr(t, F.lit(len(OPEN) + 1))
    return F.transform(turns, lambda t: F.struct(
        unescaped(F.substring_index(body(t), NAMED, 1)).alias("role"),
        unescaped(F.substr(body(t), F.locate(NAMED, body(t)) + len(NAMED))).alias("text"),
    ))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped. Each span is cut out of its own turn, so the work is that of reading the text once."""
    turns = F.split(formatted, SHUT)
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(F.get(turns, s["turn"]), (s["start"] - s["turn_start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(rendered: DataFrame) -> DataFrame:
    """What is read back from `rendered`: number and hash of the turns, length and hash of the text under the loss mask, length of the whole."""
    turns, learned = parsed(F.col("formatted")), learned_text(F.col("formatted"), F.col("loss"))
    read = rendered.select("conv_id", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


#: A conversation whose texts look like marks of templates.
PLANTED = "\\### Assistant: </turn> ok"


def turn_log(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log: each row begins a message of its own."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("message"), "role", "text")


SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
           UNION ALL SELECT -7, turn, role, '{PLANTED}', role, '{PLANTED}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
l AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g')) + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g')) AS own FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(own + {len(OPEN) + len(NAMED) + len(SHUT)}) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""
