"""Interval algebra by sorting end points: union, difference, intersection and layered sweeps.

Intervals are half-open rows (keys, start, end). No operator compares pairs of intervals: a union is a running maximum, every
other one a running sum of starts and ends, so each is one shuffle by key and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Disjoint intervals; touching ones merge, empty and reversed ones vanish."""
    rows = df.filter(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("start"), F.col(end).alias("end"))
    by = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)
    islands = rows.withColumn("reach", reach).withColumn("opens", opens)
    islands = islands.withColumn("island", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def normalized(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union that first turns reversed intervals around."""
    turned = df.select(*keys, F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"))
    return union(turned, keys)


def length(df: DataFrame, keys: Sequence[str], name: str = "length") -> DataFrame:
    """Total length of disjoint intervals by key."""
    return df.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(name))


def sweep(layers: dict[str, DataFrame], keys: Sequence[str], keep: Column) -> DataFrame:
    """Segments between end points of several layers where `keep` holds; it sees each layer's number of open intervals.

    Neighbouring segments come out merged. End points are added up before the sort, so a key's sort holds no more rows
    than it has different end points.
    """
    events = None
    for name, df in layers.items():
        ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("sign")))).alias("e")
        rows = df.filter(F.col("end") > F.col("start")).select(*keys, ends).select(*keys, F.col("e.at").alias("at"), *(F.when(F.lit(other == name), F.col("e.sign")).otherwise(0).cast("long").alias(other) for other in layers))
        events = rows if events is None else events.unionByName(rows)
    points = events.groupBy(*keys, "at").agg(*(F.sum(name).alias(name) for name in layers))
    by = Window.partitionBy(*keys).orderBy("at")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    segments = points.select(*keys, F.col("at").alias("start"), F.lead("at").over(by).alias("end"), *(F.sum(name).over(upto).alias(name) for name in layers))
    return union(segments.filter(F.col("end").isNotNull() & keep), keys)


def subtract(base: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sweep({"base": base, "removed": removed}, keys, (F.col("base") > 0) & (F.col("removed") == 0))


def intersect(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sweep({"a": left, "b": right}, keys, (F.col("a") > 0) & (F.col("b") > 0))


def eligible(busy: DataFrame, maintenance: DataFrame, normal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Busy time outside maintenance, and busy time under normal work even inside it."""
    keep = (F.col("busy") > 0) & ((F.col("maintenance") == 0) | (F.col("normal") > 0))
    return sweep({"busy": busy, "maintenance": maintenance, "normal": normal}, keys, keep)
