"""Chat formatting from event logs, with DataFrame functions alone.

A log is a row per event: conv_id, seq (anything that sorts), message_id, kind, role, text. Kinds: `message` (a whole message), `delta` (a
streamed piece, appended), `edit` (the message's new text), `regenerate` (what the message had is dropped, pieces
follow), `delete`. `fold` groups a log by conversation and message, sorts each message's events by seq and keeps what
stands from its last message, edit or regenerate event on; a message stands where its first event stands.
`render` sorts the messages of each conversation and writes them with the template.

The template wraps every message in `<s>[ROLE]role[/ROLE]` ... `</s>`, with `[INST] ` and ` [/INST]` around what is not
the assistant's. Control strings inside a text or role get a backslash after their first character; those that have
backslashes there already get one more, so unescaping takes one away and nothing else. The loss mask is the spans of
the assistant's texts in code points of the output.

A conversation is one row of output, so its events are one task's work; logs are shuffled once, by conversation.

Edge cases: null text and null role are empty; very long texts are formatted whole; null conv_id is a conversation of its own;
ties in seq are broken by kind, role and text; a message logged whole n times with one id stands n times, and rows that repeat in
`from_turns` are messages of their own; a null seq or turn comes first; empty logs give no rows. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the template writes and a text may also hold, without the first character.
CONTROL = r"(?:s>|/s>|INST\]|/INST\]|ROLE\]|/ROLE\])"
BEGIN, ROLE, ROLE_END, ASK, ASK_END, END = "<s>", "[ROLE]", "[/ROLE]", "[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, seq, role, text of the messages that an event log comes to; a row each."""
    e = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    # dealt by conversation once: what follows, rendering included, groups within these partitions
    one = events.repartition("conv_id").groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(e)).alias("e"))
    starts = F.filter(F.transform("e", lambda x, i: F.when(x["kind"].isin("message", "edit", "regenerate"), i + 1)), lambda i: i.isNotNull())
    one = one.withColumn("kept", F.slice("e", F.coalesce(F.array_max(starts), F.lit(1)), F.size("e")))
    whole = F.size(F.filter("e", lambda x: x["kind"] == "message"))
    gone = F.element_at("e", -1)["kind"] == "delete"
    out = one.where(~F.coalesce(gone, F.lit(False))).select(
        "conv_id",
        F.element_at("e", 1)["seq"].alias("seq"),
        F.coalesce(F.element_at("e", 1)["role"], F.lit("")).alias("role"),
        F.array_join(F.transform("kept", lambda x: x["text"]), "").alias("text"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), whole))).alias("copy"),
    )
    return out.drop("copy")


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask: array of (turn, begin, first, last), the spans [first, last) of what is learned and where their turn begins."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mine = role == learn
    head = F.concat(F.lit(BEGIN + ROLE), escape(role), F.lit(ROLE_END), F.when(mine, "").otherwise(ASK))
    tail = F.concat(F.when(mine, "").otherwise(ASK_END), F.lit(END))
    m = messages.select("conv_id", "seq", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"), tail.alias("tail"), mine.alias("mine"))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    size = F.length("head") + F.length("body") + F.length("tail")
    m = m.withColumn("turn", F.row_number().over(order) - 1).withColumn("begin", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    first = F.col("begin") + F.length("head")
    span = F.struct("turn", "begin", first.alias("first"), (first + F.length("body")).alias("last"))
    conv = m.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.concat("head", "body", "tail").alias("t")))).alias("t"),
        F.sort_array(F.collect_list(F.when(F.col("mine"), span))).alias("loss_mask"),
    )
    return conv.select("conv_id", F.array_join(F.transform("t", lambda x: x["t"]), "").alias("formatted"), "loss_mask")


def format_chat(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """The formatted conversations of an event log."""
    return render(fold(events), learn)


def turns(formatted: Column) -> Column:
    """The turns as written, cut after each end mark, which no escaped text holds."""
    return F.filter(F.split(formatted, "(?<=</s>)"), lambda x: x != "")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, messages (array of role, text) parsed from the output, learned (the unescaped texts under the loss mask)."""
    def parse(t: Column) -> Column:
        role = F.regexp_extract(t, r"(?s)\A<s>\[ROLE\](.*?)\[/ROLE\]", 1)
        body = F.regexp_extract(t, r"(?s)\A<s>\[ROLE\].*?\[/ROLE\](.*)</s>\z", 1)
        asked = F.regexp_extract(body, r"(?s)\A\[INST\] (.*) \[/INST\]\z", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.when(body.startswith(ASK), asked).otherwise(body)).alias("text"))

    rows = formatted.withColumn("turns", turns(F.col("formatted")))
    learned = F.transform("loss_mask", lambda s: unescape(F.substring(F.get("turns", s["turn"]), s["first"] - s["begin"] + 1, s["last"] - s["first"])))
    return rows.select("conv_id", "formatted", F.transform("turns", parse).alias("messages"), learned.alias("learned"))


def from_turns(conversations: DataFrame) -> DataFrame:
    """The event log that such messages may have come from: a message of its own for each row, logged at its turn, last event first.

    Half of the messages are streamed: the beginning of a draft, a regeneration, then the text in three pieces of code points. The
    others are logged whole as a draft, to which a piece is appended, and edited into what they are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", "role", text.alias("text"), F.xxhash64("conv_id", "turn", text).alias("h"))
    rows = rows.withColumn("message_id", F.concat_ws(":", F.col("turn").cast("string"), F.monotonically_increasing_id().cast("string")))
    third, draft = F.ceil(F.length("text") / 3).cast("int"), F.left(F.reverse("text"), F.lit(24))
    event = lambda step, kind, said: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), said.alias("text"))
    piece = lambda k: F.substring("text", third * k + 1, third)
    streamed = F.array(event(4, "delta", piece(2)), event(3, "delta", piece(1)), event(2, "delta", piece(0)), event(1, "regenerate", F.lit("")), event(0, "delta", draft))
    edited = F.array(event(2, "edit", F.col("text")), event(1, "delta", F.lit("...")), event(0, "message", draft))
    each = rows.select("conv_id", "turn", "message_id", "role", F.inline(F.when(F.col("h") % 2 == 0, streamed).otherwise(edited)))
    return each.select("conv_id", F.struct("turn", "step").alias("seq"), "message_id", "kind", "role", "text")
