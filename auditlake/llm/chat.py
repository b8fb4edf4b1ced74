"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log of events is partitioned by conversation and sorted by sequence. Windows fold it: of each message the last event
that sets its text (a post, an edit, a regeneration) counts, with the deltas streamed after it, and an edit or a
regeneration takes what followed it in the conversation away. What is left is rendered turn by turn, with the place of
every assistant text in the result, and can be read back from it.

One shuffle, by conversation: a conversation is one row of the result, so its final text has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: kinds of events
POST, EDIT, REGENERATE, DELTA = "post", "edit", "regenerate", "delta"
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: a text that holds one of these gets a backslash after the first character; the template's own marks begin with the first
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """text without control strings, from which unescaped() makes text again: backslashes are doubled first."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def final_messages(log: DataFrame, conv_id: str = "conv_id", message: str = "message", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, message, role, text): the messages that a log of events leaves, in no order.

    post, edit and regenerate set a message's role and text (regenerate mostly sets an empty one); delta appends to it.
    An edit or a regeneration drops all messages of a higher number that were set before it. A delta counts if it comes
    after what set its message, and nothing dropped the message since; the rest of a cancelled stream is ignored. Other
    kinds and events without a message number or kind are ignored. A null text is empty, a null role ''.
    Events are ordered by seq (null first), then kind (what sets a text before deltas), message, role and text. Equal
    events count once: logs deliver some twice. Events without a conversation are one conversation, whose id is null.
    An empty log gives no rows; other columns are ignored.
    """
    nothing = F.lit("")
    sets = F.array_position(F.array(*map(F.lit, (POST, EDIT, REGENERATE))), F.col(kind))
    e = log.select(
        F.col(conv_id).alias("conv_id"), F.col(message).alias("message"),
        F.struct(F.col(seq).alias("seq"), (F.col(kind) == DELTA).alias("delta"), sets.alias("sets"), F.coalesce(role, nothing).alias("role"), F.coalesce(text, nothing).alias("text")).alias("e"),
    ).where(F.col("message").isNotNull() & ((F.col("e.sets") > 0) | F.col("e.delta")))
    # the first window shuffles by conversation; all that follows finds its rows there
    in_order = Window.partitionBy("conv_id").orderBy("message", "e")
    of_message = Window.partitionBy("conv_id", "message").orderBy("e")
    so_far = of_message.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = of_message.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.struct("e.seq", "e.delta", "e.sets", "message")
    event = F.struct("message", "e")
    seen = e.withColumn("again", F.coalesce(F.lag(event).over(in_order) == event, F.lit(False)))
    seen = seen.withColumn("set_no", F.count_if((F.col("e.sets") > 0) & ~F.col("again")).over(so_far))
    seen = seen.withColumn("last_set", F.max("set_no").over(whole)).withColumn("rewound", F.max(F.when(F.col("e.sets") > 1, at)).over(whole))
    live = seen.where("set_no = last_set and set_no > 0 and not again")
    folded = live.groupBy("conv_id", "message").agg(
        F.max("rewound").alias("rewound"), F.max(F.when(F.col("e.sets") > 0, at)).alias("set_at"), F.max(F.when(F.col("e.sets") > 0, F.col("e.role"))).alias("role"),
        F.array_sort(F.collect_list("e")).alias("pieces"),
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    kept = folded.withColumn("dropped", F.max("rewound").over(before)).where("dropped is null or set_at > dropped")
    return kept.select("conv_id", "message", "role", F.array_join(F.col("pieces.text"), "").alias("text"))


def rendered(messages: DataFrame, conv_id: str = "conv_id", message: str = "message", role: str = "role", text: str = "text", learn: str = ASSISTANT) -> DataFrame:
    """(conv_id, formatted, loss): each conversation as one text, and where in it the model is to learn.

    A turn is START role MIDDLE text END, roles and texts escaped. loss has an element (at, start, end) for each turn, in
    code points from 0: where the turn begins and the span of its text, which is empty unless the role is `learn`.
    Null roles and texts are empty. Turns are ordered by message (null first), then escaped role and text; repeated
    rows are turns of their own. An empty table gives no rows.
    """
    e = lambda c: escaped(F.coalesce(F.col(c), F.lit("")))
    parts = messages.select(F.col(conv_id).alias("conv_id"), F.col(message).alias("message"), e(role).alias("role"), e(text).alias("text"), (F.col(role) == learn).alias("learn"))
    head = F.length("role") + len(START) + len(MIDDLE)
    before = Window.partitionBy("conv_id").orderBy("message", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("size", head + F.length("text") + len(END)).withColumn("at", F.sum("size").over(before) - F.col("size"))
    start = F.col("at") + head
    end = F.when(F.col("learn"), start + F.length("text")).otherwise(start)
    turn = F.struct("at", F.concat(F.lit(START), "role", F.lit(MIDDLE), "text", F.lit(END)).alias("turn"), F.struct("at", start.alias("start"), end.alias("end")).alias("loss"))
    turns = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select("conv_id", F.array_join("turns.turn", "").alias("formatted"), F.col("turns.loss").alias("loss"))


def formatted(log: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of the conversations of a log; see final_messages() and rendered()."""
    return rendered(final_messages(log))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, END.replace("|", r"\|"), -1), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    of = lambda p, side: unescaped(F.substring_index(body(p), MIDDLE, side))
    return F.transform(parts, lambda p: F.struct(of(p, 1).alias("role"), of(p, -1).alias("text")))


def learned(formatted: Column, loss: Column) -> Column:
    """array<string>: what stands under the loss mask, unescaped, one element a turn."""
    parts = F.filter(F.split(formatted, END.replace("|", r"\|"), -1), lambda p: p != "")
    under = lambda p, m: F.substr(p, (m["start"] - m["at"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))
    return F.zip_with(parts, loss, lambda p, m: unescaped(under(p, m)))


def as_log(conversations: DataFrame, piece: int = 256) -> DataFrame:
    """The log from which a table of finished conversations (conv_id, turn, role, text) might come.

    Messages are numbered by turn (null first), role and text. Assistant texts are posted with a first draft, regenerated
    and streamed in deltas of `piece` code points; others are posted empty and edited. Null texts are empty.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = conversations.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    streamed = F.concat(F.array(event(POST, F.substring("text", 1, piece)), event(REGENERATE, F.lit(""))), F.transform(pieces, lambda p: event(DELTA, p)))
    written = F.array(event(POST, F.lit("")), event(EDIT, F.col("text")))
    events = own.select("conv_id", "message", "role", F.posexplode(F.when(F.col("role") == ASSISTANT, streamed).otherwise(written)).alias("k", "event"))
    seq = F.shiftleft("message", 24) + F.col("k")
    return events.select("conv_id", "message", seq.alias("seq"), "event.kind", "role", "event.text")
