"""Records of several sources: which layer counts, windows over all of them, and what only the reader knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import TOKENS
from . import ledger


def inferred_quality() -> Column:
    """The quality of a stored record; one that says nothing is exact if it has a first token, a delay or samples."""
    known = F.col("first_token").isNotNull() | F.col("ttft").isNotNull() | (F.size("samples") > 0)
    return F.coalesce(F.col("quality"), F.when(F.coalesce(known, F.lit(False)), "exact").otherwise("provisional"))


def _by_update(new: dict, old: dict) -> bool | None:
    """Whether a candidate wins by its update; None if neither has one."""
    a, b = new["update"], old["update"]
    if not a and not b:
        return None
    exact, was = new["quality"] == "exact", old["quality"] == "exact"
    if a and b:
        if (a["fingerprint"], a["revision"]) == (b["fingerprint"], b["revision"]):
            return new["layer"] == "disk"  # the stored copy of a fact confirms what was seen of it
        return ledger.is_newer(a, b) and (exact or not was)
    return exact if exact != was else bool(a)


def _wins(new: dict, old: dict) -> bool:
    """Of two layers' records: update, quality, completeness across layers, volume, freshness, completeness, order."""
    said = _by_update(new, old)
    if said is not None:
        return said
    if new["quality"] != old["quality"]:
        return new["quality"] == "exact"
    whole = ledger.completeness(new), ledger.completeness(old)
    if new["layer"] != old["layer"] and whole[0] != whole[1]:
        return whole[0] > whole[1]
    volume = lambda r: sum(r[c] or 0 for c in TOKENS)
    fresh = lambda r: max((r[c] for c in ("start", "first_token", "completed") if r.get(c) is not None), default=0)
    for a, b in ((volume(new), volume(old)), (fresh(new), fresh(old)), whole, (new["pos"], old["pos"])):
        if a != b:
            return a > b
    return new["layer"] == "optimistic"


def fold_layers(records: list[dict]) -> dict | None:
    held: dict | None = None
    for r in sorted(records, key=lambda r: (r["layer"] != "disk", r["pos"])):
        if held is None:
            held = r
            continue
        kept, other = (r, held) if _wins(r, held) else (held, r)
        same = kept["session_id"] == other["session_id"] and kept["agent"] is None
        held = kept | {"agent": other["agent"]} if same else kept
    return held


def merged_layers(records: DataFrame) -> DataFrame:
    """One record a message, of stored (`layer` disk) and optimistic ones; qualities must be there. A message with one
    record needs no fold."""
    known = records.filter("message_id is not null").withColumn("__n", F.count("*").over(Window.partitionBy("message_id")))
    alone, several = known.filter("__n = 1").select(*records.columns), known.filter("__n > 1").select(*records.columns)
    return alone.unionByName(ledger.by_message(several, fold_layers))


def window_of(records: DataFrame, last: int) -> DataFrame:
    """The last records of several sources by the time they were completed, then by id."""
    return records.orderBy(F.coalesce("completed", "start").desc_nulls_last(), F.col("message_id").desc()).limit(last)


def with_parents(records: DataFrame, parents: DataFrame) -> DataFrame:
    """The records with the parent that is known of their session (null if known to have none), else the one they name."""
    known = parents.select(F.col("child").alias("session_id"), F.col("parent").alias("__parent"), F.lit(True).alias("__known"))
    met = records.join(known, "session_id", "left")
    return met.withColumn("parent_id", F.when(F.col("__known"), F.col("__parent")).otherwise(F.col("parent_id"))).select(*records.columns)


def parent_evidence(witnesses: DataFrame) -> DataFrame:
    """(id, parent, conflict) from witnesses (id, parent, origin, epoch, sequence, pos) of three origins.

    `canonical` counts before `live`, and that before `cache`; of an origin's the last by place. Live witnesses compare only
    within an epoch, by sequence: if their epochs' last ones disagree, or two of one sequence do, there is a conflict. A live
    parent that differs from the canonical one wins if it is later in the same epoch; in another epoch, or without one,
    it is a conflict, and the canonical parent stands until it is proved.
    """
    last = lambda origin, name: F.max(F.when(F.col("origin") == origin, F.struct("pos", "parent", "epoch", "sequence"))).alias(name)
    live = witnesses.filter("origin = 'live'").groupBy("id", "epoch").agg(F.max("sequence").alias("top"), F.max(F.struct(F.coalesce("sequence", F.lit(-1)).alias("s"), F.col("pos"))).getField("s").alias("s"))
    tops = witnesses.filter("origin = 'live'").join(live.withColumnRenamed("id", "i").withColumnRenamed("epoch", "e"), (F.col("id") == F.col("i")) & F.col("epoch").eqNullSafe(F.col("e")) & (F.coalesce("sequence", F.lit(-1)) == F.col("s")))
    parent = F.coalesce(F.col("parent").cast("string"), F.lit(""))
    at_odds = tops.groupBy("id").agg((F.countDistinct(parent) > 1).alias("at_odds"))
    rows = witnesses.groupBy("id").agg(last("canonical", "c"), F.max(F.when(F.col("origin") == "live", F.struct(F.coalesce("sequence", F.lit(-1)).alias("s"), "pos", "parent", "epoch", "sequence"))).alias("l"), last("cache", "h")).join(at_odds, "id", "left")
    differ = F.col("c").isNotNull() & F.col("l").isNotNull() & ~F.col("c.parent").eqNullSafe(F.col("l.parent"))
    comparable = F.coalesce((F.col("c.epoch") == F.col("l.epoch")) & F.col("c.sequence").isNotNull() & F.col("l.sequence").isNotNull(), F.lit(False))
    odd = F.coalesce("at_odds", F.lit(False))
    later = differ & comparable & (F.col("l.sequence") > F.col("c.sequence")) & ~odd
    chosen = F.when(later, F.col("l.parent")).when(F.col("c").isNotNull(), F.col("c.parent")).when(F.col("l").isNotNull(), F.col("l.parent")).otherwise(F.col("h.parent"))
    return rows.select("id", chosen.alias("parent"), (odd | (differ & ~comparable)).alias("conflict"))


def excluded_ids(message_scopes: DataFrame, contributions: DataFrame) -> DataFrame:
    """(message_id) that a ledger excludes: by evidence on the message, or a settled contribution taken back. A settled
    one without a body is no proof."""
    return message_scopes.select("message_id").unionByName(contributions.filter("excluded").select("message_id")).distinct()


def without_messages(totals: DataFrame, contributions: DataFrame, gone: DataFrame, measures: list[str]) -> DataFrame:
    """A ledger's session sums less the contributions that the reader's own evidence excludes; at least 0."""
    known = contributions.filter("not excluded").join(gone.select("message_id").distinct(), "message_id", "left_semi")
    less = known.select("session_id", *((-F.col(m)).alias(m) for m in measures))
    return totals.select("session_id", *measures).unionByName(less).groupBy("session_id").agg(*(F.greatest(F.sum(m), F.lit(0)).alias(m) for m in measures))


def session_agent(entities: DataFrame) -> DataFrame:
    """(session_id, agent): the first usable agent of entities (session_id, id, role, agent, pos) that are the session itself."""
    name = text.agent_name(F.col("agent"))
    own = entities.filter((F.col("id") == F.col("session_id")) & ~F.coalesce(F.col("role").isin("assistant", "user"), F.lit(False)))
    return own.withColumn("name", name).filter("name is not null").groupBy("session_id").agg(F.min(F.struct("pos", "name")).getField("name").alias("agent"))


def fallback_tokens(reports: DataFrame, key: str = "message_id") -> DataFrame:
    """One row a message from partial counters in order of `pos`: the last report counts, of the cache the greatest."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("pos", c))).getField(c).alias(c)
    return reports.groupBy(key).agg(*(last(c) for c in ("input", "output", "reasoning")), *(F.max(c).alias(c) for c in ("cache_read", "cache_write")))


def tainted(events: DataFrame) -> DataFrame:
    """(message_id, tainted, reasons): whether anything that invalidates a measurement befell a response."""
    bad = F.col("kind").isin("retry", "failed", "recovery", "disconnect", "aborted", "cancelled")
    return events.groupBy("message_id").agg(F.max(bad).alias("tainted"), F.array_sort(F.collect_set(F.when(bad, F.col("kind")))).alias("reasons"))


def same_record(columns: list[str], left: str = "l", right: str = "r") -> Column:
    """Field by field, nulls equal to nulls; a missing quality is exact."""
    out = F.lit(True)
    for c in columns:
        a, b = F.col(f"{left}.{c}"), F.col(f"{right}.{c}")
        out = out & (F.coalesce(a, F.lit("exact")) == F.coalesce(b, F.lit("exact")) if c == "quality" else a.eqNullSafe(b))
    return out
