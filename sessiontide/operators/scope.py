"""Evidence that a session or a message is maintenance, and what it excludes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import EXCLUDED_ITEM, EXCLUDED_SESSION, PENDING, USER
from . import forest

def session_class(agents: list[str], prefixes: list[str], titles: list[str], flag: str, roles: list[str]) -> Column:
    """Scope of a session from its metadata (hidden flag, with no role or one of `roles`), agent and title; the lists are configuration."""
    role = F.coalesce(F.col("role"), F.lit(""))
    hidden = (F.coalesce(F.col("flag"), F.lit("")) == flag) & ((role == "") | role.isin(*roles))
    title = F.coalesce(F.col("title"), F.lit(""))
    begins = F.lit(False)
    for p in prefixes:
        begins = begins | title.startswith(p)
    agent = F.coalesce(F.col("agent"), F.lit(""))
    return F.when(hidden | agent.isin(*agents) | begins | title.isin(*titles), EXCLUDED_SESSION).when(agent != "", USER).otherwise(PENDING)


def message_class(agents: list[str], maintenance_id: str, models: tuple[str, ...] = ("provider_id", "model_id")) -> Column:
    """Scope of a message from its role, agent, mode, summary flag and the ids of its provider and model, which may stand in
    fields of a struct too (`models` names them all)."""
    at = lambda c: F.coalesce(F.col(c), F.lit(""))
    other = F.col("role").isNotNull() & (F.col("role") != "assistant")
    model = F.lit(False)
    for c in models:
        model = model | (at(c) == maintenance_id)
    maintenance = at("agent").isin(*agents, "compaction") | at("mode").isin(*agents) | model
    compacted = F.coalesce(F.col("summary"), F.lit(False)) & (at("mode") == "compaction")
    return F.when(other, PENDING).when(maintenance | compacted, EXCLUDED_ITEM).when((at("agent") != "") | (at("mode") != ""), USER).otherwise(PENDING)


def merged(evidence: DataFrame, key: str = "session_id") -> DataFrame:
    """One row by key: the strongest scope (of equal ones the latest), all reasons in order of first sight, the last parent."""
    rank = F.when(F.col("scope") == EXCLUDED_SESSION, 2).when(F.col("scope") == EXCLUDED_ITEM, 1).otherwise(0)
    # below the exclusions the latest evidence that is not pending counts
    weak = F.max(F.when(F.col("scope").isin(USER), F.struct("pos", "scope"))).alias("weak")
    reasons = F.array_sort(F.collect_list(F.struct("pos", "reasons"))).getField("reasons")
    return (
        evidence.withColumn("rank", rank)
        .groupBy(key)
        .agg(F.max("rank").alias("rank"), weak, F.array_distinct(F.flatten(reasons)).alias("reasons"), F.max(F.when(F.col("parent").isNotNull(), F.struct("pos", "parent"))).alias("up"))
        .select(key, F.when(F.col("rank") == 2, EXCLUDED_SESSION).when(F.col("rank") == 1, EXCLUDED_ITEM).otherwise(F.coalesce("weak.scope", F.lit(PENDING))).alias("scope"), "reasons", F.col("up.parent").alias("parent"))
    )


def metadata_batch(known: DataFrame, updates: DataFrame) -> DataFrame:
    """(session_id, scope, reasons, parent, agents) after a batch of updates (session_id, pos, scope, reasons, parent, agents)
    to sessions. A batch with a message's exclusion, an unknown scope or an unusable agent is refused whole."""
    usable = ~F.exists(F.coalesce("agents", F.array().cast("array<string>")), lambda a: F.coalesce(text.agent_name(a) != a, F.lit(True)))
    right = F.coalesce(F.col("scope").isin(PENDING, USER, EXCLUDED_SESSION), F.col("scope").isNull()) & usable & (F.col("session_id") != "")
    checked = updates.filter(F.when(F.coalesce(right, F.lit(False)), True).otherwise(F.raise_error(F.lit("a session's metadata are invalid"))))
    rows = known.withColumn("pos", F.lit(-1).cast("long")).unionByName(checked.withColumn("pos", F.col("pos").cast("long")))
    scopes = merged(rows.filter("scope is not null"))
    agents = rows.groupBy("session_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("agents", F.array().cast("array<string>")))))).alias("agents"))
    return agents.join(scopes, "session_id", "left").select("session_id", "scope", "reasons", "parent", "agents")


def parents(explicit: DataFrame, proof: DataFrame) -> DataFrame:
    """(child, parent): an explicit link stands even if it is null; otherwise the parent that evidence names."""
    more = proof.join(explicit.select("child"), "child", "left_anti").select("child", "parent")
    return explicit.select("child", "parent").unionByName(more)


def excluded_sessions(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id) of sessions excluded by their own evidence or an ancestor's. `evidence` (session_id, scope)."""
    marked = evidence.filter(F.col("scope") == EXCLUDED_SESSION).select(F.col("session_id").alias("id"))
    return forest.excluded(links, marked)


def eligible_records(records: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Records that neither their own scope nor an excluded session or recorded parent removes."""
    gone = excluded_sessions(links, evidence)
    own = records.filter(~F.coalesce("scope", F.lit(PENDING)).isin(EXCLUDED_ITEM, EXCLUDED_SESSION))
    out = own.join(gone.withColumnRenamed("id", "session_id"), "session_id", "left_anti")
    if "parent_id" in records.columns:
        out = out.join(gone.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti")
    return out.select(*records.columns)
