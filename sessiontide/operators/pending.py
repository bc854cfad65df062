"""State that came before its message had a name.

Observations of a session without a message id belong to the message that is named next in their session, unless that was
completed before; the name is known only later, so one window looks ahead. What a message then has is one fold over its own rows and
those that it took over, the same for any way in which rows and names came to be told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def named(observations: DataFrame) -> DataFrame:
    """The observations (session_id, message_id, pos, completes) with `owner`, the message that each belongs to, and `taken` for those
    that it took over. Rows after the last name of their session have no owner yet."""
    upto = Window.partitionBy("session_id", "message_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # looks ahead from the last row back, so that a session's rows are gone through once, not once for each of them
    ahead = Window.partitionBy("session_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = F.coalesce(F.max(F.coalesce("completes", F.lit(False))).over(upto), F.lit(False))
    open_ = observations.withColumn("__name", F.when(F.col("message_id").isNotNull() & ~done, F.col("message_id")))
    owner = F.coalesce("message_id", F.last("__name", ignorenulls=True).over(ahead))
    return open_.withColumn("owner", owner).withColumn("taken", F.col("message_id").isNull() & F.col("owner").isNotNull()).drop("__name")


def merged(owned: DataFrame) -> DataFrame:
    """A row a message: earliest start and first token, whether it is live, whether it was seen from its start all along, model, agent and
    cost of its own rows before those taken over, the last report of a counter, own ones last, and of the cache the greatest; how many observations it has and how many of them it took over."""
    rows = owned.filter("owner is not null")
    own_first = F.struct("taken", "pos")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), own_first)).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct((~F.col("taken")).alias("own"), "pos"))).alias(c)
    return rows.groupBy(F.col("owner").alias("message_id")).agg(
        F.min("session_id").alias("session_id"), F.min("ts").alias("start"), F.min("first_token").alias("first_token"), F.max("live").alias("live"), F.min("from_start").alias("from_start"),
        first("model"), first("agent"), first("cost"), *(last(c) for c in ("input", "output", "reasoning")), F.max("cache_read").alias("cache_read"), F.max("cache_write").alias("cache_write"), F.count("*").alias("observations"),
        F.sum(F.col("taken").cast("long")).alias("taken"),
    )
