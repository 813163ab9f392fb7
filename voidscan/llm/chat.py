"""Chat formatting: conversations rebuilt from event logs, rendered with a reversible template.  DataFrame operations only.

An event has a conversation, a sequence number, a turn, a kind, a role and a text:

- message     the turn's text, in place of what it had
- delta       text that follows what the turn has
- edit        new text for the turn
- regenerate  the turn starts anew; later turns written before this event go

Events are partitioned by conversation once, sorted by sequence, and folded with window functions.

A table of conversations is a log of messages.  Rows that are the same in every column are events of their own, in any order.

The template writes a turn as  <|im_start|>ROLE\\nTEXT<|im_end|>\\n .  In texts and roles a backslash becomes two, and a backslash goes between
the characters of each "<|", so no marker can occur in them; in roles a backslash goes before \\n too.  To read back, drop each
backslash and keep the character after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
_STOP_PATTERN = r"<\|im_end\|>\n"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(c: Column) -> Column:
    return F.replace(escaped(c), F.lit("\n"), F.lit("\\\n"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): final messages of events (conv_id, seq, turn, kind, role, text).

    Events of equal sequence are taken in the order of turn, kind, role and text.  A null text is empty; a turn's role is that of its last
    event that has one, else empty.  Events of a null conversation are one conversation.  Unknown kinds count as deltas.
    """
    order = [F.col(c) for c in ("seq", "turn", "kind", "role", "text")]
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    later = Window.partitionBy("conv_id").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("conv_id", "turn").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    live = events.withColumn("__cut", F.min(F.when(kind == "regenerate", F.col("turn"))).over(later)).where(F.coalesce(F.col("__cut") >= F.col("turn"), F.lit(True)))
    live = live.withColumn("__anew", F.coalesce(F.sum(F.when(kind.isin("message", "edit", "regenerate"), 1).otherwise(0)).over(rest), F.lit(0)))
    part = F.struct(*order[:1], F.col("turn"), F.col("kind"), F.col("role"), F.when(F.col("__anew") == 0, F.coalesce("text", F.lit(""))).otherwise("").alias("text"))
    whole = live.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(part)).alias("__parts"))
    said = F.filter("__parts", lambda p: p["role"].isNotNull())
    return whole.select("conv_id", "turn", F.coalesce(F.try_element_at(said, F.lit(-1))["role"], F.lit("")).alias("role"), F.array_join(F.transform("__parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans): conversations by the template, turns in order.

    loss_spans: (start, length) in code points of what is learned, the escaped texts of `learn` roles.  A conversation's output is one
    string, so its turns meet in one row; they arrive rendered, and their places come from a running sum.
    """
    m = messages.select("conv_id", "turn", "role", escaped("text").alias("__text"), F.concat(F.lit(START), escaped_role("role"), F.lit("\n")).alias("__head"))
    m = m.withColumn("__piece", F.concat("__head", "__text", F.lit(STOP + "\n")))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("__at", F.coalesce(F.sum(F.length("__piece").cast("long")).over(before), F.lit(0)) + F.length("__head"))
    span = F.when(F.col("role").isin(*learn), F.struct(F.col("__at").alias("start"), F.length("__text").cast("long").alias("length")))
    return m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "__piece"))).alias("__pieces"), F.array_sort(F.collect_list(span)).alias("loss_spans")).select(
        "conv_id", F.array_join(F.transform("__pieces", lambda p: p["__piece"]), "").alias("formatted"), "loss_spans")


def masked(formatted: Column, spans: Column, block: int = 1024) -> Column:
    """The texts that lie under the loss mask, unescaped, an array in the order of the spans.

    The string is cut into blocks once and each text comes from its own blocks, so the cost is the string's length, not its length times
    the number of spans.
    """
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))

    def text(s: Column) -> Column:
        first = F.floor(s["start"] / block)
        last = F.floor((s["start"] + s["length"]) / block)
        near = F.array_join(F.slice(blocks, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return unescaped(F.substr(near, (s["start"] - first * block + 1).cast("int"), s["length"].cast("int")))

    return F.transform(spans, text)


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: an array of (role, text), unescaped."""
    pieces = F.split(formatted, _STOP_PATTERN, -1)

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(START) + 1))
        role = F.regexp_extract(body, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def events_of(conversations: DataFrame) -> DataFrame:
    """Events of a table (conv_id, turn, role, text): a message each; rows of one turn follow each other by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nth = F.row_number().over(order).cast("long")
    return conversations.select("conv_id", nth.alias("seq"), nth.alias("turn"), F.lit("message").alias("kind"), "role", "text")
