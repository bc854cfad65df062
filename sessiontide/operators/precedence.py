"""Which of several records of one message, or copies of one fact, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AMOUNT_WEIGHTS, FIELD_WEIGHTS, MOST_SAMPLES, SAMPLES_WEIGHT


def is_exact(quality: str = "quality") -> Column:
    return F.coalesce(F.col(quality), F.lit("exact")) == "exact"


def best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row by key; the order must be total."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__place = 1").drop("__place")


def preferred(records: DataFrame) -> DataFrame:
    """Exact before provisional, then the latest completed (else start), then the latest arrival."""
    when = F.coalesce("completed", "start")
    return best(records, ["message_id"], is_exact().desc(), when.desc_nulls_last(), F.col("pos").desc())


def completeness(columns: list[str]) -> Column:
    """Weight of the fields that a record has, of those that the table has."""
    out = F.lit(0)
    for c, w in FIELD_WEIGHTS.items():
        if c in columns:
            out = out + F.when(F.col(c).isNotNull(), w).otherwise(0)
    for c, w in AMOUNT_WEIGHTS.items():
        if c in columns:
            out = out + F.when(F.col(c) > 0, w).otherwise(0)
    if "samples" in columns:
        out = out + F.when(F.size("samples") > 0, SAMPLES_WEIGHT + F.least(F.size("samples"), F.lit(MOST_SAMPLES))).otherwise(0)
    return out


def freshness() -> Column:
    return F.greatest("start", "first_token", "completed")


def runtime_preferred(records: DataFrame) -> DataFrame:
    """Newest revision, then quality, freshness, completeness and arrival."""
    return best(records, ["message_id"], F.col("revision").desc_nulls_last(), is_exact().desc(), freshness().desc_nulls_last(), completeness(records.columns).desc(), F.col("pos").desc())


def distinct_facts(facts: DataFrame) -> DataFrame:
    """Facts whose whole payload is equal count once, the first to arrive; one id with another payload stays."""
    payload = [c for c in facts.columns if c != "pos"]
    key = F.xxhash64(*payload)
    same = Window.partitionBy("key", *payload).orderBy("pos")
    return facts.withColumn("key", key).withColumn("n", F.row_number().over(same)).filter("n = 1").drop("n", "key")


def newest(records: DataFrame, ends: int, protected: DataFrame | None = None) -> DataFrame:
    """The last `ends` by admission, and the protected ones whatever their age."""
    last = records.orderBy(F.col("pos").desc(), F.col("message_id").desc()).limit(ends)
    if protected is None:
        return last
    also = records.join(protected.select("message_id").distinct(), "message_id", "left_semi")
    return last.unionByName(also.select(last.columns)).dropDuplicates(["message_id", "pos"])
