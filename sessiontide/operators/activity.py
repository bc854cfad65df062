"""From lifecycle and work facts to active time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ACTIVE, TERMINAL
from ..plans.lineage import cut
from . import forest, intervals, precedence

EXECUTION = ["session_id", "instance_id", "execution_id"]


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join where null keys are equal, as a stream may have no execution id; the left keys stay."""
    other = right.select(*(F.col(c).alias(f"__{c}") if c in keys else c for c in right.columns))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = left.join(other, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"__{c}" for c in keys))


def latest_executions(facts: DataFrame) -> DataFrame:
    """(execution): of each session and instance the execution whose first active fact is the last; with no active fact
    at all, every execution. Only these may use a trusted instance's clock."""
    when = F.struct("ts", F.col("source_sequence"), F.col("seq"), F.col("pos"))
    began = facts.groupBy(*EXECUTION).agg(F.min(F.when(F.col("state").isin(*ACTIVE), when)).alias("began"))
    last = F.max("began").over(Window.partitionBy("session_id", "instance_id"))
    return began.withColumn("last", last).filter(F.col("last").isNull() | (F.col("began") == F.col("last"))).select(*EXECUTION)


def boundaries(facts: DataFrame, trusted: DataFrame | None = None, cutoff: float | None = None, named: DataFrame | None = None) -> DataFrame:
    """(execution, boundary, proved, latest): where an open tail may end.

    The least of: the cutoff (the latest execution of trusted instances only), a named end (session_id, instance_id, end), the facts' own
    ends of the instance, and the last observation; without any of them the latest fact.
    """
    found = facts.groupBy(*EXECUTION).agg(F.min("ended_at").alias("ended"), F.max("last_observed").alias("observed"), F.max("ts").alias("latest"))
    found = found.withColumn("cutoff", F.lit(None).cast("double")).withColumn("named", F.lit(None).cast("double"))
    if trusted is not None and cutoff is not None:
        clock = latest_executions(facts).join(trusted.select("instance_id").distinct(), "instance_id", "left_semi")
        found = joined(found.drop("cutoff"), clock.withColumn("cutoff", F.lit(float(cutoff))), EXECUTION, "left")
    if named is not None:
        found = found.drop("named").join(named.select("session_id", "instance_id", F.col("end").cast("double").alias("named")), ["session_id", "instance_id"], "left")
    explicit = F.least(*(F.col(c).cast("double") for c in ("cutoff", "named", "ended", "observed")))
    return found.select(*EXECUTION, F.coalesce(explicit, F.col("latest").cast("double")).alias("boundary"), explicit.isNotNull().alias("proved"))


def lifecycle_intervals(facts: DataFrame, ends: DataFrame | None = None, live_now: float | None = None, trusted: DataFrame | None = None) -> DataFrame:
    """(execution, start, end) of busy and retry states.

    A state lasts to the next fact, the last one to the boundary. In an execution with an id a terminal state ends all
    activity for good. With `live_now`, an open tail of a trusted instance's latest execution lasts to that time, or a
    proved boundary.
    """
    ends = boundaries(facts) if ends is None else ends
    rows = joined(facts, ends.select(*EXECUTION, "boundary", "proved"), EXECUTION, "inner").filter("ts <= boundary")
    by = Window.partitionBy(*EXECUTION).orderBy("ts", F.col("source_sequence").asc_nulls_first(), F.col("seq").asc_nulls_first(), "pos")
    ended = F.max(F.when(F.col("state").isin(*TERMINAL) & F.col("execution_id").isNotNull(), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("over", F.coalesce(ended, F.lit(0))).withColumn("next", F.lead("ts").over(by))
    tail = F.col("boundary")
    if live_now is not None and trusted is not None:
        clock = latest_executions(facts).join(trusted.select("instance_id").distinct(), "instance_id", "left_semi")
        rows = joined(rows, clock.withColumn("trusted", F.lit(True)), EXECUTION, "left")
        live = F.least(F.greatest(F.lit(float(live_now)), F.col("ts")), F.when(F.col("proved"), F.col("boundary")))
        tail = F.when(F.col("trusted"), live).otherwise(tail)
    active = rows.filter(F.col("state").isin(*ACTIVE) & (F.col("over") == 0))
    return active.select(*EXECUTION, F.col("ts").alias("start"), F.coalesce("next", tail).alias("end")).filter(F.col("end") > F.col("start"))


def work_spans(work: DataFrame, maintenance: Column, normal: Column) -> DataFrame:
    """One row per work item: first start, last end, and its sticky classes; a tool takes maintenance over from its step."""
    key = [*EXECUTION, "source", "step_id", "work_id"]
    spans = work.groupBy(*key).agg(
        F.min(F.when(F.col("phase") == "start", F.col("ts"))).alias("start"),
        F.max(F.when(F.col("phase") == "end", F.col("ts"))).alias("end"),
        F.max(maintenance).alias("maintenance"),
        F.max(normal).alias("normal"),
    )
    steps = spans.filter("source = 'step' and maintenance").select(*(F.col(c).alias(f"s_{c}") for c in EXECUTION), F.col("work_id").alias("s_work")).distinct()
    same = F.col("step_id") == F.col("s_work")
    for c in EXECUTION:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    owned = spans.join(steps, same, "left")
    return owned.select(*key, "start", "end", (F.col("maintenance") | (F.col("s_work").isNotNull() & (F.col("source") == "tool"))).alias("maintenance"), "normal")


def pure_maintenance(lifecycle: DataFrame, spans: DataFrame, certificates: DataFrame, ends: DataFrame) -> DataFrame:
    """Executions that a certificate and complete evidence prove to be maintenance throughout."""
    seen = lifecycle.groupBy(*EXECUTION).agg(
        F.min(F.struct("ts", "pos", "state")).getField("state").alias("first_state"),
        F.max(F.struct("ts", "pos", "state")).getField("state").alias("last_state"),
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"),
    )
    inside = F.coalesce(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("maintenance") & (F.col("start") <= F.col("end")), F.lit(False))
    work = spans.groupBy(*EXECUTION).agg(F.min(inside).alias("all_in"), F.min("start").alias("w0"), F.max("end").alias("w1"))
    proved = certificates.select(*EXECUTION).distinct()
    for more in (seen, work, ends):
        proved = joined(proved, more, EXECUTION, "inner")
    whole = (F.col("first_state") == "busy") & (F.col("n") >= 2) & ~F.col("last_state").isin(*ACTIVE) & F.col("all_in")
    return proved.filter(whole & (F.col("w0") >= F.col("first")) & (F.col("w1") <= F.col("last")) & (~F.col("proved") | (F.col("boundary") >= F.col("last")))).select(*EXECUTION)


def eligible_time(busy: DataFrame, spans: DataFrame, pure: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Busy time less maintenance, with normal work restored; all of a purely maintaining execution's busy time is maintenance."""
    keys = keys or EXECUTION
    paired = spans.filter("start is not null and end is not null and end >= start")
    maintenance = paired.filter("maintenance").select(*keys, "start", "end")
    if pure is not None:
        maintenance = maintenance.unionByName(joined(busy, pure, keys, "left_semi").select(*keys, "start", "end"))
    return intervals.eligible(busy, maintenance, paired.filter("normal"), keys)


def resolved_parents(facts: DataFrame, context: DataFrame | None = None, proof: DataFrame | None = None) -> DataFrame:
    """(child, parent): given links first, then the last parent fact (which may clear the link), then what evidence names."""
    last = facts.filter("kind = 'parent'").groupBy(F.col("session_id").alias("child")).agg(F.max(F.struct("ts", "pos", "parent_id")).getField("parent_id").alias("parent"))
    out = last
    if context is not None:
        out = context.select("child", "parent").unionByName(last.join(context.select("child"), "child", "left_anti"))
    if proof is not None:
        out = out.unionByName(proof.select("child", "parent").join(out.select("child"), "child", "left_anti"))
    return out


def task_time(active: DataFrame, links: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(id, direct, including): length of the union of a session's own intervals, and with all below it; parallel work counts once."""
    if without is not None:
        gone = forest.excluded(links, without)
        active = active.join(gone.withColumnRenamed("id", "session_id"), "session_id", "left_anti")
        links = links.join(gone.withColumnRenamed("id", "child"), "child", "left_anti")
    direct = cut(intervals.union(active, ["session_id"]))
    outer, of = forest.contracted(links, direct.select("session_id"))
    held = direct.join(of.withColumnRenamed("id", "session_id"), "session_id").select(F.col("node").alias("id"), "start", "end")
    held, jumps = cut(intervals.union(held, ["id"])), cut(outer.select(F.col("child").alias("id"), F.col("parent").alias("to")))
    # as sums are gathered in a forest: a node's intervals are merged with those of the nodes that jump to it, and jumps double
    while not jumps.isEmpty():
        moved = held.join(jumps, "id").select(F.col("to").alias("id"), "start", "end")
        held = cut(intervals.union(held.unionByName(moved), ["id"]), instead_of=held)
        ahead = jumps.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        jumps = cut(jumps.join(ahead, "to").select("id", F.col("beyond").alias("to")), instead_of=jumps)
    own = intervals.length(direct, ["session_id"], "direct").withColumnRenamed("session_id", "id")
    whole = intervals.length(held, ["id"], "including").withColumnRenamed("id", "node")
    return of.join(whole, "node").join(own, "id", "left").select("id", F.coalesce("direct", F.lit(0)).alias("direct"), "including")


def split_at_gaps(facts: DataFrame, gaps: DataFrame) -> DataFrame:
    """Facts where a gap in transport (session_id, instance_id, at) ends the instance: each stream is stopped at its last fact
    before the gap, and what comes after it belongs to a new instance, named by the number of gaps before it."""
    kind = facts.schema["ts"].dataType
    marks = gaps.select("session_id", "instance_id", F.col("at").cast(kind).alias("ts"), F.lit(1).alias("__gap"))
    rows = facts.withColumn("__gap", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("session_id", "instance_id").orderBy("ts", F.col("__gap").asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("__no", F.sum("__gap").over(upto)).filter("__gap = 0").drop("__gap")
    most = gaps.groupBy("session_id", "instance_id").agg(F.count("*").alias("__most"))
    by = Window.partitionBy(*EXECUTION, "__no").orderBy(F.col("ts").desc(), F.col("source_sequence").desc_nulls_last(), F.col("seq").desc_nulls_last(), F.col("pos").desc())
    last = numbered.withColumn("__place", F.row_number().over(by)).filter("__place = 1").drop("__place")
    stopped = last.filter(F.col("state").isin(*ACTIVE)).join(most, ["session_id", "instance_id"]).filter("__no < __most").drop("__most")
    stopped = stopped.withColumns({"state": F.lit("stopped"), "event_id": F.concat_ws("/", F.lit("gap"), "session_id", "instance_id", F.coalesce("execution_id", F.lit("")), "__no"), "pos": F.col("pos") + 1})
    named = F.when(F.col("__no") > 0, F.concat_ws("#", "instance_id", "__no")).otherwise(F.col("instance_id").cast("string"))
    return numbered.unionByName(stopped.select(numbered.columns)).withColumn("instance_id", named).drop("__no")


def replay(facts: DataFrame, links: DataFrame, spans: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """(id, root, direct, including): active time of every session and of all below it, maintenance taken out, from facts that may
    be delivered more than once."""
    busy = lifecycle_intervals(precedence.distinct_facts(facts))
    if spans is not None:
        busy = eligible_time(intervals.union(busy, EXECUTION), spans)
    return task_time(busy, links, without).join(forest.roots(links, facts.select("session_id")), "id", "left").select("id", "root", "direct", "including")


def is_live(facts: DataFrame, trusted: DataFrame, links: DataFrame, cutoff: float | None = None, without: DataFrame | None = None) -> DataFrame:
    """(id, live): whether a session, or one below it, has an open active state in a trusted instance's latest execution that
    no proof ends and, with a cutoff, that has no fact after it. Excluded sessions are never live."""
    ends = boundaries(facts)
    by = Window.partitionBy(*EXECUTION).orderBy(F.col("ts").desc(), F.col("source_sequence").desc_nulls_last(), F.col("seq").desc_nulls_last(), F.col("pos").desc())
    last = facts.withColumn("place", F.row_number().over(by)).filter("place = 1")
    terminal = facts.filter(F.col("state").isin(*TERMINAL) & F.col("execution_id").isNotNull()).select(*EXECUTION).distinct()
    open_ = joined(joined(last.filter(F.col("state").isin(*ACTIVE)), terminal, EXECUTION, "left_anti"), ends.filter("not proved").select(*EXECUTION), EXECUTION, "left_semi")
    if cutoff is not None:
        open_ = open_.filter(F.col("ts") <= cutoff)
    clock = latest_executions(facts).join(trusted.select("instance_id").distinct(), "instance_id", "left_semi")
    own = joined(open_, clock, EXECUTION, "left_semi").select(F.col("session_id").alias("id")).distinct()
    ids = facts.select(F.col("session_id").alias("id")).distinct()
    marked = ids.join(own.withColumn("n", F.lit(1)), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("live"))
    return forest.rollup(marked, links, ["live"], without).select("id", (F.col("including_live") > 0).alias("live"))


def visible(facts: DataFrame, selection: DataFrame, replacements: DataFrame | None = None) -> DataFrame:
    """Facts of streams that are not hidden or replaced, and those that replace them. `selection` (execution, mode)."""
    out = joined(facts, selection.filter("mode <> 'visible'").select(*EXECUTION), EXECUTION, "left_anti")
    return out if replacements is None else out.unionByName(replacements.select(out.columns))


def reconciled(canonical: DataFrame, live: DataFrame) -> DataFrame:
    """Facts of both, where a live execution hides the canonical one until that is terminal and covers every live fact."""
    missing = joined(live, canonical.select(*EXECUTION, "event_id"), [*EXECUTION, "event_id"], "left_anti").select(*EXECUTION).distinct()
    ended = canonical.filter(F.col("state").isin(*TERMINAL)).select(*EXECUTION).distinct()
    done = joined(ended, missing, EXECUTION, "left_anti")
    from_live = joined(live, done, EXECUTION, "left_anti")
    others = joined(canonical, from_live.select(*EXECUTION).distinct(), EXECUTION, "left_anti")
    return others.select(canonical.columns).unionByName(from_live.select(canonical.columns))


def recovery_facts(facts: DataFrame, older: DataFrame) -> DataFrame:
    """A `stopped` fact at the boundary of each open stream of older instances; its id depends on the stream alone."""
    ends = boundaries(facts)
    last = facts.groupBy(*EXECUTION).agg(F.max(F.struct("ts", "pos", "state")).getField("state").alias("state"))
    open_ = last.filter(F.col("state").isin(*ACTIVE)).join(older.select("instance_id").distinct(), "instance_id", "left_semi")
    open_ = joined(open_, ends, EXECUTION, "inner")
    return open_.select(*EXECUTION, F.concat_ws("/", F.lit("recovered"), *EXECUTION).alias("event_id"), F.lit("stopped").alias("state"), F.col("boundary").alias("ts"))


def run_epochs(facts: DataFrame) -> DataFrame:
    """(session_id, epoch, start, end): runs of a session from the first active fact to the next inactive one; end is null while open."""
    by = Window.partitionBy("session_id").orderBy("ts", "seq")
    active = F.col("state").isin(*ACTIVE)
    rows = facts.withColumn("active", active).withColumn("was", F.coalesce(F.lag("active").over(by), F.lit(False)))
    rows = rows.withColumn("epoch", F.sum(F.when(F.col("active") & ~F.col("was"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.filter("epoch > 0 and (active or was)")
    return runs.groupBy("session_id", "epoch").agg(F.min("ts").alias("start"), F.max(F.when(~F.col("active"), F.col("ts"))).alias("end"))
