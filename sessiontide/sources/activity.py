"""Activity logs: one fact as JSON per line, read in batches or as a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.leaves import Leaves, filled
from ..operators import precedence
from ..schema import STATES
from . import store
from . import tail as tails
from .history import evidence, lines, stored_scope

#: The words of facts on work and on what an execution was for.
SOURCES, PHASES, CLASSIFICATION, COVERAGE = ("step", "tool"), ("start", "end"), "pure-maintenance", "complete"
#: Names of a fact's plain fields as logs write them.
STORED = {
    "kind": "kind", "event_id": "eventID", "session_id": "sessionID", "instance_id": "instanceID", "execution_id": "executionID", "ts": "timestamp", "observed_at": "observedAt",
    "seq": "seq", "source_sequence": "sourceSequence", "source_event_id": "sourceEventID", "ended_at": "instanceEndedAt", "last_observed": "lastObservedAt", "state": "state",
    "parent_id": "parentSessionID", "work_id": "workID", "source": "source", "phase": "phase", "step_id": "stepID", "classification": "classification", "coverage": "coverage",
}
#: Evidence on a fact and on the work that it measures.
EVIDENCE = {"scope": "scope", "measure": "measurementScope"}


def facts(rows: DataFrame) -> DataFrame:
    """Normalized facts of lines (value, pos). A state makes a lifecycle fact, the presence of a parent (null too) a parent fact.

    Work needs an execution, an id, a source, a phase and evidence of what it was for; an execution's classification needs complete
    coverage; neither exists in logs of version 1. Evidence comes as `scope` and `measure`, each with `_reasons` and `_parent`.
    """
    leaves = Leaves()
    text, number = leaves.text, leaves.number
    full = lambda p: filled(text(p))
    version = number("version")
    right = leaves.raw("version").isNull() | F.coalesce(version.isin(1, 2), F.lit(False))
    parent = leaves.raw("parentSessionID")
    state = text("state")
    kind = F.coalesce(text("kind"), F.when(state.isNotNull(), "lifecycle").when(parent.isNotNull(), "parent"))
    whole = lambda p: number(p).cast("long")
    proofs = {}
    for name, path in EVIDENCE.items():
        own = evidence(leaves, path)
        proofs |= {name: own["scope"], f"{name}_reasons": own["reasons"], f"{name}_parent": own["parent"]}
    ts = number("timestamp")
    columns = {
        "kind": kind, "event_id": text("eventID"), "session_id": full("sessionID"), "instance_id": F.coalesce(full("instanceID"), F.lit("default")), "execution_id": full("executionID"), "ts": ts,
        "observed_at": F.coalesce(number("observedAt"), ts), "seq": whole("seq"), "source_sequence": whole("sourceSequence"), "source_event_id": full("sourceEventID"),
        "state": F.when(state.isin(*STATES), state), "ended_at": number("instanceEndedAt"), "last_observed": number("lastObservedAt"), "parent_id": full("parentSessionID"),
        "work_id": full("workID"), "source": text("source"), "phase": text("phase"), "step_id": full("stepID"), "classification": text("classification"), "coverage": text("coverage"), **proofs,
    }
    bad_parent = parent.isNotNull() & text("parentSessionID").isNull() & (F.schema_of_variant(parent) != "VOID")
    read_ = leaves.over(rows).filter(right).select(*(c.alias(n) for n, c in columns.items()), (version == 1).alias("__old"), bad_parent.alias("__bad"), "pos")
    known = F.coalesce((F.col("kind") == "parent") & ~F.col("__bad"), F.lit(False)) | ((F.col("kind") == "lifecycle") & F.col("state").isNotNull())
    new = ~F.coalesce("__old", F.lit(False)) & F.col("execution_id").isNotNull()
    work = (F.col("kind") == "work") & F.col("work_id").isNotNull() & F.col("source").isin(*SOURCES) & F.col("phase").isin(*PHASES) & F.col("measure").isNotNull()
    pure = (F.col("kind") == "execution-scope") & (F.col("classification") == CLASSIFICATION) & (F.col("coverage") == COVERAGE)
    fine = F.coalesce(known | (new & (F.coalesce(work, F.lit(False)) | F.coalesce(pure, F.lit(False)))), F.lit(False))
    return read_.filter(fine & F.col("session_id").isNotNull() & F.col("ts").isNotNull()).drop("__old", "__bad")


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return precedence.distinct_facts(facts(lines(spark, path)))


def stored_evidence(name: str, columns: list[str]) -> Column:
    """Evidence as logs write it, null without a scope."""
    part = lambda c, kind: F.col(c) if c in columns else F.lit(None).cast(kind)
    reasons = F.coalesce(part(f"{name}_reasons", "array<string>"), F.array().cast("array<string>"))
    body = F.struct(F.lit(1).alias("version"), stored_scope(F.col(name)).alias("sourceScope"), reasons.alias("reasons"), part(f"{name}_parent", "string").alias("parentSessionID"))
    return F.when(F.col(name).isNotNull(), body)


def body(columns: list[str]) -> Column:
    """A fact as the struct that its line has; what a table lacks is left out, and a parent fact without a parent clears it."""
    plain = [F.col(c).alias(n) for c, n in STORED.items() if c in columns]
    return F.struct(F.lit(2).alias("version"), *plain, *(stored_evidence(name, columns).alias(n) for name, n in EVIDENCE.items() if name in columns))


def append(rows: DataFrame, path: str) -> None:
    """Facts as JSON lines behind those that are there."""
    rows.select(F.to_json(body(rows.columns)).alias("value")).write.mode("append").text(path)


def compact(spark: SparkSession, path: str) -> None:
    """A log rewritten with every fact once; the old one stays until the new one is in its place."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    append(read(spark, path), new)
    store.swap(spark, new, path)


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as facts; the checkpoint of the query keeps the place."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return facts(text.select(F.regexp_replace("value", "^﻿|\r$", "").alias("value"), F.lit(0).cast("long").alias("pos")).filter("trim(value) <> ''"))


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of lines as they are added to a folder's logs; `reset` marks those of a log that was truncated or rewritten."""
    rows = tails.stream(spark, folder)
    return facts(rows.select(F.regexp_replace("value", "^﻿|\r$", "").alias("value"), F.struct("file", "at", "reset").alias("pos")).filter("trim(value) <> ''"))
