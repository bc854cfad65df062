"""Totals of runs: what a session used between its first active fact and the next inactive one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def with_epoch(records: DataFrame, runs: DataFrame) -> DataFrame:
    """The records with the run of their session that began last at or before their start, 0 before all runs.

    Runs and records are sorted together by session and time, so one window finds the run of each record.
    """
    columns = records.columns
    body = records.select("session_id", F.col("start").alias("__at"), F.lit(1).alias("__is"), F.lit(None).cast("long").alias("__run"), F.struct(*columns).alias("__row"))
    begins = runs.select("session_id", F.col("start").cast(records.schema["start"].dataType).alias("__at"), F.lit(0).alias("__is"), F.col("epoch").cast("long").alias("__run"), F.lit(None).cast(body.schema["__row"].dataType).alias("__row"))
    upto = Window.partitionBy("session_id").orderBy("__at", "__is").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = body.unionByName(begins).withColumn("epoch", F.coalesce(F.max("__run").over(upto), F.lit(0)))
    return met.filter("__is = 1").select("__row.*", "epoch")


def totals(records: DataFrame, measures: list[str]) -> DataFrame:
    """(session_id, epoch, calls, measures, started, first_token) of records that count once each."""
    sums = [F.sum(m).alias(m) for m in measures]
    return records.groupBy("session_id", "epoch").agg(F.count("*").alias("calls"), *sums, F.min("start").alias("started"), *([F.min("first_token").alias("first_token")] if "first_token" in records.columns else []))


def summaries(records: DataFrame, runs: DataFrame, measures: list[str]) -> DataFrame:
    """Totals of the runs that are over, with their start and end; a correction of a record changes its own run's."""
    done = runs.filter("end is not null").select("session_id", "epoch", F.col("start").alias("run_start"), F.col("end").alias("run_end"))
    return done.join(totals(records, measures), ["session_id", "epoch"])


def last_completed(records: DataFrame) -> DataFrame:
    """(session_id, message_id, epoch): a session's record of the latest run, in it the one completed last."""
    when = F.struct("epoch", F.coalesce("completed", "start").alias("t"), F.col("pos"), F.col("message_id"))
    return records.groupBy("session_id").agg(F.max(when).alias("m")).select("session_id", "m.message_id", "m.epoch")


def of_trees(active: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, epoch, start, end): runs of whole trees, from when the first of its sessions goes active to when all are idle."""
    own = active.join(roots.withColumnRenamed("id", "session_id"), "session_id").select("root", "start", "end")
    whole = intervals.union(own, ["root"])
    return whole.withColumn("epoch", F.row_number().over(Window.partitionBy("root").orderBy("start")).cast("long"))
