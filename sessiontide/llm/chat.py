"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has one event per row: conversation, sequence number, message, kind, role and text.

* ``message`` opens a message, ``edit`` replaces its text;
* ``delta`` appends to the text;
* ``regenerate`` replaces the text and withdraws every later message that the log held until then.

Template of a turn: ``<|turn|>role<|text|>text<|end|>``. In roles and texts ``<``, backslashes and ``|`` get one
backslash more before the bar, so that no control string can stand inside them; reading takes one away.

Nulls: a null role or text is empty, a null kind is ``message``, a null conversation is one of its own. Events that tie in
sequence are applied in the order of kind and text, a ``regenerate`` last, of the latest message first; a message's role is
the first that is named, of tied ones the least. A repeated delta stands twice, a repeated replacement once. Texts may be
as long as a cell of a table; an empty log gives no rows. Only the columns named above are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): the messages that stand at the end of the log.

    One shuffle by conversation serves the windows and the grouping; a message is folded by the place of its last
    replacing event, so no conversation is gathered into one value here.
    """
    kind = F.coalesce("kind", F.lit("message"))
    events = log.select("conv_id", "seq", "msg", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy("msg").rangeBetween(Window.unboundedPreceding, -1)
    of_msg = Window.partitionBy("conv_id", "msg")
    withdrawn = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier)
    live = events.withColumn("withdrawn", withdrawn).filter("withdrawn is null or seq > withdrawn")
    began = F.max(F.when(F.col("kind") != "delta", F.struct("seq", "kind", "text"))).over(of_msg)
    place = F.struct("seq", "kind", "text")
    return (
        live.withColumn("began", began)
        .groupBy("conv_id", "msg")
        .agg(
            F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("first"),
            F.first("began").alias("began"),
            F.array_sort(F.collect_list(F.when(F.col("began").isNull() | (place > F.col("began")), place))).alias("parts"),
        )
        .select("conv_id", "msg", F.coalesce("first.role", F.lit("")).alias("role"), F.concat(F.coalesce("began.text", F.lit("")), F.array_join("parts.text", "")).alias("text"))
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): the spans are [start, end) in code points of the formatted text."""
    shown = messages.select(
        "conv_id", "msg", "role", escape(F.coalesce("role", F.lit(""))).alias("shown_role"), escape(F.coalesce("text", F.lit(""))).alias("shown")
    )
    turn = F.concat(F.lit(TURN), "shown_role", F.lit(TEXT), "shown", F.lit(END))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("turn", turn).withColumn("at", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)))
    start = F.col("at") + len(TURN) + F.length("shown_role") + len(TEXT)
    span = F.struct(start.alias("start"), (start + F.length("shown")).alias("end"))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("msg", "turn"))).getField("turn"), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("role") == loss_role, span))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text): turns and masked text parsed out of the formatted text."""
    fields = F.split("formatted", r"<\|turn\|>|<\|text\|>|<\|end\|>")
    numbers = F.when(F.size("fields") > 3, F.sequence(F.lit(0), ((F.size("fields") - 4) / 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    turns = F.transform(
        F.col("numbers").cast("array<int>"),
        lambda k: F.struct(unescape(F.element_at("fields", k * 3 + 2)).alias("role"), unescape(F.element_at("fields", k * 3 + 3)).alias("text")),
    )
    masked = F.transform(
        "loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s.getField("start") + 1).cast("int"), (s.getField("end") - s.getField("start")).cast("int")))
    )
    return (
        formatted.withColumn("fields", fields)
        .withColumn("numbers", numbers)
        .select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))
    )


#: Places of one message's events in a log, and code points of a delta.
EVENTS, PIECE = 1 << 20, 256


def as_log(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as a log that says the same: by the hash of its place a message comes whole, as a
    stream of deltas, as a draft that is edited, or as one that is regenerated after the next message was begun on it."""
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.select("conv_id", F.row_number().over(in_order).alias("msg"), "role", F.coalesce("text", F.lit("")).alias("text"))
    way = F.pmod(F.xxhash64("conv_id", "msg"), F.lit(4))
    none, draft = F.lit(None).cast("string"), F.reverse("text")
    event = lambda msg, kind, role, text: F.struct(msg.cast("int").alias("msg"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    msg, role, text = F.col("msg"), F.col("role"), F.col("text")
    pieces = F.sequence(F.lit(0), F.ceil(F.length("text") / PIECE).cast("int"))  # one more than there are; the last is empty
    deltas = F.transform(pieces, lambda k: event(msg, "delta", none, F.substring(text, k * PIECE + 1, F.lit(PIECE))))
    events = (
        F.when(way == 0, F.array(event(msg, "message", role, text)))
        .when(way == 1, F.concat(F.array(event(msg, "message", role, F.lit(""))), deltas))
        .when(way == 2, F.array(event(msg, "message", role, draft), event(msg, "edit", none, text)))
        .otherwise(F.array(event(msg, "message", role, draft), event(msg + 1, "message", F.lit("draft"), draft), event(msg, "regenerate", none, text)))
    )
    told = placed.select("conv_id", F.col("msg").alias("first"), F.posexplode(events).alias("k", "e"))
    return told.select("conv_id", (F.col("first").cast("long") * EVENTS + F.col("k")).alias("seq"), "e.msg", "e.kind", "e.role", "e.text")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    back = read_back(render(reconstruct(as_log(rows))))
    said = F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
