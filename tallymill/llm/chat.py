r"""Chat formatting from an event log, with DataFrame functions only.

``fold_events`` rebuilds the final messages of each conversation from its log, sorted by sequence:

- ``message`` begins a message (its role and first text),
- ``delta`` appends text to a message,
- ``edit`` replaces the text of a message that far,
- ``regenerate`` empties a message, and discards all messages that began after it and before the
  event; deltas that follow build it anew.

``render`` makes one row per message: a segment ``<|im_start|>role\ntext<|im_end|>\n`` whose texts
are escaped, and the place of the loss text (assistant messages) in it. The segments of a
conversation in order are its formatted string; ``conversations_of`` joins them. Escaping is
reversible: a backslash is doubled, ``<|`` becomes ``<\|``, and a line break in a role is preceded
by a backslash. So no control string can occur inside a text. ``read_back`` cuts the strings at their
control strings, and a turn at its first line break that no backslash precedes.

Everything up to the segments is windows and joins by conversation and message whose rows are
streamed, so a conversation with a third of all events is sorted, not held. One string or digest per
conversation needs that conversation's segments together, as any single value must.

Defined cases: a NULL role or text is empty; a NULL conversation or sequence is a value of its own
and comes first; events that tie are ordered by kind, role and text, and repeated rows are kept; an
event for a message that never began is left out; an edit of a discarded message has no effect;
other columns are not read; an empty table gives none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def messages_as_events(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A log in which each row is a whole message; rows that tie stay apart."""
    rows = df.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("seq"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    return rows.select("conv_id", F.row_number().over(order).cast("bigint").alias("seq"), "role", "text").select(
        "conv_id", "seq", F.lit("message").alias("kind"), F.col("seq").alias("message_id"), "role", "text"
    )


def messages_as_log(messages: DataFrame) -> DataFrame:
    """The log that a client would have written of ``messages_as_events``: by a hash of its place, a
    message is said at once, in two parts, wrongly and edited, or drafted together with an answer that
    begins after it, and regenerated."""
    half = F.length("text") / 2
    first, rest = F.substring("text", F.lit(1), half.cast("int")), F.expr("substring(text, cast(length(text) / 2 as int) + 1)")

    def event(step: int, kind: str, text: Column, message: Column = F.col("message_id"), role: Column = F.col("role")) -> Column:
        return F.struct(
            (F.col("seq") * 4 + step).alias("seq"), F.lit(kind).alias("kind"), message.alias("message_id"), role.alias("role"), text.alias("text")
        )

    none = F.lit(None).cast("string")
    way = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("seq").cast("string")).cast("binary")) % 4
    log = (
        F.when(way == 0, F.array(event(0, "message", F.col("text"))))
        .when(way == 1, F.array(event(0, "message", first), event(1, "delta", rest, role=none)))
        .when(way == 2, F.array(event(0, "message", rest), event(1, "edit", first, role=none), event(2, "delta", rest, role=none)))
        .otherwise(
            F.array(
                event(0, "message", F.concat(F.lit("draft "), first)),
                event(1, "message", rest, -F.col("message_id"), F.lit("assistant")),
                event(2, "regenerate", none, role=none),
                event(3, "delta", F.col("text"), role=none),
            )
        )
    )
    return messages.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, turn_no (from 1), role, text of the final messages of a log (conv_id, seq, kind, message_id, role, text)."""
    log = events.select(
        "conv_id",
        F.coalesce(F.col("seq").cast("bigint"), F.lit(-(1 << 63))).alias("seq"),
        "kind",
        "message_id",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    of_message = Window.partitionBy("conv_id", "message_id")
    so_far = of_message.orderBy("seq", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.when(F.col("kind") == "message", F.col("seq"))
    log = (
        log.withColumn("began", F.min(begins).over(of_message))
        .withColumn("own_role", F.first(F.when(F.col("kind") == "message", F.col("role")), ignorenulls=True).over(so_far))
        # which text of the message a row belongs to: each event but a delta starts another
        .withColumn("version", F.sum((F.col("kind") != "delta").cast("bigint")).over(so_far))
        .withColumn("last_version", F.max("version").over(of_message))
        .where("began <= seq")
    )
    # what a later regeneration of an earlier message discards: read backwards, so each frame grows by one row
    later = (
        Window.partitionBy("conv_id").orderBy(F.col("seq").desc(), "kind", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    )
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("began"))).over(later)
    log = log.withColumn("_cut", F.when(F.col("kind") == "message", cut))
    log = log.withColumn("discarded", F.max(F.coalesce(F.col("_cut") < F.col("began"), F.lit(False))).over(of_message))
    pieces = log.where("not discarded and version = last_version")
    texts = pieces.groupBy("conv_id", "message_id", "began").agg(
        F.max("own_role").alias("role"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))), lambda p: F.when(p["kind"] == "regenerate", "").otherwise(p["text"])), ""
        ).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("began", "message_id"))
    return texts.select("conv_id", place.cast("bigint").alias("turn_no"), "role", "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, turn_no, segment, loss_start, loss_end: a formatted segment per message and its loss text (NULL: none)."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escape(F.col("text"))
    is_loss = F.col("role") == loss_role
    return messages.select(
        "conv_id",
        "turn_no",
        F.concat(head, body, F.lit(END + "\n")).alias("segment"),
        F.when(is_loss, F.length(head)).alias("loss_start"),
        F.when(is_loss, F.length(head) + F.length(body)).alias("loss_end"),
    )


def conversations_of(segments: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of start and end in code points of the formatted string)."""
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("segment").cast("bigint")).over(before), F.lit(0).cast("bigint"))
    placed = segments.withColumn("_at", at)
    span = F.struct((F.col("_at") + F.col("loss_start")).alias("start"), (F.col("_at") + F.col("loss_end")).alias("end"))
    joined = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn_no", "segment"))).alias("rows"),
        F.array_sort(F.collect_list(F.when(F.col("loss_start").isNotNull(), span))).alias("loss"),
    )
    return joined.select("conv_id", F.array_join(F.col("rows.segment"), "").alias("formatted"), "loss")


def read_back(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_no, role, text, loss_text (NULL: none), segment_chars: the messages, parsed from the
    formatted strings and their loss mask alone.

    A string is cut where a turn begins and each turn where it ends; every span of the mask is read
    in the turn that it begins in. Turns and spans are rows, ordered by their place in the string.
    """
    of_conv = Window.partitionBy("conv_id").orderBy("at", "is_span")
    turns = conversations.select("conv_id", F.posexplode(F.split("formatted", re.escape(START))).alias("place", "body"))
    length = F.length("body").cast("bigint") + F.when(F.col("place") > 0, len(START)).otherwise(0)
    ended = F.sum(length).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # what stands before the first turn, nothing in a whole string, is no turn
    turns = turns.select("conv_id", (ended - length).alias("at"), F.lit(False).alias("is_span"), "place", "body", ended.alias("ended")).where("place > 0")
    spans = conversations.select("conv_id", F.explode("loss").alias("span")).select(
        "conv_id", F.col("span.start").alias("at"), F.lit(True).alias("is_span"), F.col("span.end").alias("ended")
    )
    rows = turns.unionByName(spans, allowMissingColumns=True)
    so_far = of_conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.last(F.when(~F.col("is_span"), F.struct("place", "at", "body")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("turn", turn)
    skipped = F.col("at") - F.col("turn.at") - len(START)
    said = F.when(F.col("is_span"), F.substring(F.col("turn.body"), (skipped + 1).cast("int"), (F.col("ended") - F.col("at")).cast("int")))
    parsed = (
        rows.withColumn("said", F.when(F.col("is_span"), F.struct("at", said.alias("text"))))
        .groupBy("conv_id", F.col("turn.place").cast("bigint").alias("turn_no"))
        .agg(
            F.max("body").alias("body"),
            F.max(F.when(~F.col("is_span"), F.col("ended") - F.col("at"))).alias("segment_chars"),
            F.array_sort(F.collect_list("said")).alias("said"),
        )
    )
    inner = F.substring_index("body", END, 1)
    head = F.regexp_extract("inner", r"^((?:[^\\\n]|\\[\s\S])*+)\n", 1)
    return (
        parsed.withColumn("inner", inner)
        .withColumn("head", head)
        .select(
            "conv_id",
            "turn_no",
            unescape(F.col("head")).alias("role"),
            unescape(F.expr("substring(inner, length(head) + 2)")).alias("text"),
            F.when(F.size("said") > 0, unescape(F.array_join(F.col("said.text"), ""))).alias("loss_text"),
            "segment_chars",
        )
    )


def digests(messages: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests of what ``read_back`` returned."""
    rows = F.array_sort(F.collect_list(F.struct("turn_no", "role", "text", "loss_text")))
    grouped = messages.groupBy("conv_id").agg(rows.alias("rows"), F.sum("segment_chars").alias("formatted_chars"))
    turns = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("rows", lambda r: F.coalesce(r["loss_text"], F.lit(""))), "")
    return grouped.select("conv_id", F.size("rows").cast("bigint").alias("n_turns"), turns.alias("turns"), loss.alias("loss"), "formatted_chars").select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
