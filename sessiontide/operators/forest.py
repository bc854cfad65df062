"""Operators on parent links (child, parent): each child has one parent at most, and links may form cycles.

Jumps and closures double their reach every round, so a chain of n links takes about log2(n) joins. Sums and exclusions
carry one row a node through the rounds, listings too; only `closure` writes all pairs of a node and its ancestors.
Null, empty and self links are no edges. Loops are driven by one count per round; rows stay in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def edges(links: DataFrame) -> DataFrame:
    proper = F.col("parent").isNotNull() & (F.col("parent") != F.col("child")) & (F.col("parent").cast("string") != "")
    return links.filter(proper & F.col("child").isNotNull()).select("child", "parent")


def nodes(links: DataFrame, *more: DataFrame) -> DataFrame:
    """(id): every end of a link, and the ids of other tables' first columns."""
    all_ = links.select(F.col("child").alias("id")).unionByName(links.select(F.col("parent").alias("id")))
    for df in more:
        all_ = all_.unionByName(df.select(F.col(df.columns[0]).alias("id")))
    return all_.filter("id is not null").distinct()


def closure(links: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, ancestor, depth): all reachable ancestors, with the id itself at depth 0; depth is the shortest way."""
    known = edges(links)
    reach = nodes(known, *([ids] if ids is not None else [])).select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    reach = cut(reach.unionByName(known.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))).distinct())
    count = reach.count()
    while True:
        far = reach.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("depth").alias("more"))
        step = reach.join(far, "ancestor").select("id", F.col("beyond").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        reach = cut(step.groupBy("id", "ancestor").agg(F.min("depth").alias("depth")), instead_of=reach)
        now = reach.count()
        if now == count:
            return reach
        count = now


def ancestors(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, ancestor): the given ids and all above them in a forest. Rows are those of the given ids only, and jumps double, so
    it takes log2 of the longest way up."""
    reach = cut(ids.select("id", F.col("id").alias("ancestor")))
    jumps = cut(links.select(F.col("child").alias("ancestor"), F.col("parent").alias("to")))
    while True:
        met = cut(reach.join(jumps, "ancestor").select("id", F.col("to").alias("ancestor")))
        if met.isEmpty():
            return reach
        reach = cut(reach.unionByName(met), instead_of=reach)
        ahead = jumps.select(F.col("ancestor").alias("to"), F.col("to").alias("beyond"))
        jumps = cut(jumps.join(ahead, "to").select("ancestor", F.col("beyond").alias("to")), instead_of=jumps)


def _jumps(links: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, to, least) after so many doublings that `to` is a root or in a cycle; `least` is the least id on the way."""
    known = edges(links)
    all_ = nodes(known, *([ids] if ids is not None else []))
    start = all_.join(known, all_["id"] == known["child"], "left").select("id", F.coalesce("parent", "id").alias("to"))
    written, reach = cut(start.withColumn("least", F.least("id", "to"))), 1
    jumps = written
    total = jumps.count()
    while reach < total:
        ahead = jumps.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("least").alias("other"))
        step = jumps.join(ahead, "to").select("id", F.col("beyond").alias("to"), F.least("least", "other").alias("least"), (F.col("beyond") != F.col("to")).alias("moved"))
        written = cut(step, instead_of=written)
        jumps, reach = written.drop("moved"), reach * 2
        if written.filter("moved").isEmpty():
            break
    return jumps


def roots(links: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, root): the last ancestor; in or below a cycle, the cycle's least member.

    Jumps double each round and carry the least id met. After log2(n) rounds every jump ends in a root or in a cycle, and
    the least id met from there on is the cycle's least member, or the root itself. Without cycles it ends as soon as
    all jumps stand at roots.
    """
    jumps = _jumps(links, ids)
    return jumps.select("id", "to").join(jumps.select(F.col("id").alias("to"), F.col("least").alias("root")), "to").select("id", "root")


def contracted(links: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The links with every cycle as one node, its least member, and (id, node) for all ids.

    From everywhere the jumps end at a root or in a cycle, and those of a cycle's members at all of its members; a root has no
    parent.
    """
    jumps, known = _jumps(links, ids), edges(links)
    inside = jumps.select(F.col("to").alias("child")).distinct().join(known.select("child"), "child", "left_semi")
    head = cut(jumps.select(F.col("id").alias("child"), F.col("least").alias("node")).join(inside, "child"))
    if head.isEmpty():
        return known, jumps.select("id", F.col("id").alias("node"))
    of = jumps.select("id").join(head.withColumnRenamed("child", "id"), "id", "left").select("id", F.coalesce("node", "id").alias("node"))
    up = head.select(F.col("child").alias("parent"), F.col("node").alias("head"))
    outer = known.join(inside, "child", "left_anti").join(up, "parent", "left").select("child", F.coalesce("head", "parent").alias("parent"))
    return outer, of


def gathered(values: DataFrame, links: DataFrame, merge: dict[str, Column], up: bool) -> DataFrame:
    """(id, columns of `merge`) over a forest: each node's values merged with those of all below it, or with `up` above it.

    After k rounds a node holds what is less than 2**k links away, and its jump is 2**k links long; what is at most as
    far again is what the nodes hold that jump to it, or what its jump holds. So a round is one join or grouping of one row
    a node, and a chain of n links takes log2(n) rounds. `merge` are aggregates that don't care about order.
    """
    known = links.select(F.col("child").alias("id"), F.col("parent").alias("to"))
    held = cut(values.join(known, "id", "left"))
    while not held.filter("to is not null").isEmpty():
        moving = held.filter("to is not null")
        if up:
            above = held.select(F.col("id").alias("to"), *merge, F.col("to").alias("beyond"))
            met = moving.select("id", "to").join(above, "to").select("id", *merge)
        else:
            met = moving.select(F.col("to").alias("id"), *merge)
        merged = held.select("id", *merge).unionByName(met).groupBy("id").agg(*(f.alias(c) for c, f in merge.items()))
        ahead = held.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        jumps = held.select("id", "to").join(ahead, "to", "left").select("id", F.col("beyond").alias("to"))
        held = cut(merged.join(jumps, "id"), instead_of=held)
    return held.drop("to")


def excluded(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id): sessions with evidence themselves or above them. `evidence` (id)."""
    ids = evidence.select(F.col("id")).filter("id is not null").distinct()
    if ids.isEmpty():
        return ids
    outer, of = contracted(links, ids)
    marked = of.join(ids.withColumn("hit", F.lit(True)), "id", "left").groupBy("node").agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"))
    found = gathered(marked.withColumnRenamed("node", "id"), outer, {"hit": F.max("hit")}, up=True).filter("hit")
    return of.join(found.select(F.col("id").alias("node")), "node", "left_semi").select("id")


def rollup(totals: DataFrame, links: DataFrame, measures: list[str], without: DataFrame | None = None) -> DataFrame:
    """(id, direct_*, including_*): sums of each node, and of all below it once each; excluded nodes count nothing and are not listed."""
    known = edges(links)
    if without is not None:
        gone = excluded(known, without)
        known = known.join(gone.withColumnRenamed("id", "child"), "child", "left_anti").join(gone.withColumnRenamed("id", "parent"), "parent", "left_anti").select("child", "parent")
        totals = totals.join(gone, "id", "left_anti")
    direct = cut(totals.filter("id is not null").groupBy("id").agg(*(F.sum(m).alias(m) for m in measures)))
    outer, of = contracted(known, direct)
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = of.join(direct, "id", "left")
    sums = own.groupBy(F.col("node").alias("id")).agg(*(zero(F.sum(m)).alias(m) for m in measures))
    whole = gathered(sums, outer, {m: F.sum(m) for m in measures}, up=False).select(F.col("id").alias("node"), *(F.col(m).alias(f"including_{m}") for m in measures))
    return own.join(whole, "node").select("id", *(zero(F.col(m)).alias(f"direct_{m}") for m in measures), *(f"including_{m}" for m in measures))


def family(links: DataFrame, selected: DataFrame) -> DataFrame:
    """(id): the selected nodes (first column) and all below them."""
    return excluded(links, selected.select(F.col(selected.columns[0]).alias("id")))


def shown_depth(links: DataFrame, shown: DataFrame) -> DataFrame:
    """(id, depth) of the shown nodes below a root: how many shown ones stand between them and it. Hidden nodes add no depth,
    and neither does the root. Members of cycles count once, under their root."""
    root = roots(links, shown)
    opened = edges(links).join(root.select(F.col("id").alias("child"), "root"), "child").filter("child <> root").select("child", "parent")
    marked = root.join(shown.select("id").distinct().withColumn("seen", F.lit(1)), "id", "left")
    values = marked.select("id", F.when(F.col("id") == F.col("root"), 0).otherwise(F.coalesce("seen", F.lit(0))).alias("n"))
    above = gathered(values, opened, {"n": F.sum("n")}, up=True)
    return above.join(marked.filter("seen = 1 and id <> root").select("id", "root"), "id").select("root", "id", (F.col("n") - 1).cast("int").alias("depth"))


def children(links: DataFrame) -> DataFrame:
    """(parent, children): ids in collated order."""
    return edges(links).groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def _opened(links: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The links with every cycle opened at its root, so that they are a forest, and (id, root)."""
    root = cut(roots(links, ids))
    known = edges(links).join(root.select(F.col("id").alias("child"), "root"), "child").filter("child <> root").select("child", "parent")
    return cut(known), root


def earlier_siblings(sized: DataFrame) -> DataFrame:
    """(child, parent, before): what the children of the same parent with smaller ids weigh together. `sized` (child, parent, size).

    Children are dealt in ranges, so those of one parent may stand in many tasks; only the ranges' sums are put in order by parent.
    """
    ranged = cut(sized.repartitionByRange("parent", "child").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("parent", "part").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("parent", "part").agg(F.sum("size").alias("size"))
    over = Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.select("parent", "part", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("shift"))
    own = ranged.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return own.join(shifts, ["parent", "part"]).select("child", "parent", (F.col("own") + F.col("shift")).alias("before"))


def listing(links: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(root, id, depth, place): nodes below each root in pre-order, children by id; members of cycles once, under their root.

    A node comes one place after its parent, and after all nodes below its earlier siblings. So its place is a sum over itself and
    its ancestors, its depth another, and both are gathered in rounds that double their reach: n log n rows, no table of ancestors.
    """
    opened, root = _opened(links, ids)
    sizes = gathered(root.select("id", F.lit(1).cast("long").alias("size")), opened, {"size": F.sum("size")}, up=False)
    sized = opened.join(sizes.withColumnRenamed("id", "child"), "child")
    steps = earlier_siblings(sized).select(F.col("child").alias("id"), (F.col("before") + 1).alias("place"), F.lit(1).alias("depth"))
    values = root.join(steps, "id", "left").select("id", F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("depth", F.lit(0)).alias("depth"))
    placed = gathered(values, opened, {"place": F.sum("place"), "depth": F.sum("depth")}, up=True)
    return placed.join(root, "id").select("root", "id", F.col("depth").cast("int").alias("depth"), (F.col("place") + 1).cast("long").alias("place"))


def ordered_edges(links: DataFrame) -> DataFrame:
    """(child, parent, rank): parents come before their children; rank is the parent's depth."""
    opened, root = _opened(links)
    values = root.select("id", F.when(F.col("id") == F.col("root"), 0).otherwise(1).alias("rank"))
    depth = gathered(values, opened, {"rank": F.sum("rank")}, up=True).select(F.col("id").alias("parent"), F.col("rank").cast("long").alias("rank"))
    return edges(links).join(depth, "parent").select("child", "parent", "rank")
