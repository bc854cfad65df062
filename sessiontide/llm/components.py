"""Connected components of a link table, by alternating large and small stars.

Every round is a grouping and a join on small rows, written out before the next; nothing is gathered on the driver but
one count and one checksum. Null ends are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    near = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = near.join(least, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every end of a link (a, b): root is the least id of its component."""
    edges = written(links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    check = lambda df: tuple(df.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(20, 0)))")).first())
    state = check(edges)
    while state[0]:
        edges = written(_star(_star(edges, True), False), "links", instead_of=edges)
        now = check(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
