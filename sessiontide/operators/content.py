"""What was observed of a response while it came in, and whether that proves a generation rate.

Observations (one table, `pos` is the order of arrival) have message_id, pos and a kind: `begin` (from_start), `step` (step_id, which a snapshot may have too), `taint`
(reason), `delta` and `snapshot` of a part (part_id, part_type, text; stream, event_id, received_at, received_mono, clock_source and
clock_resolution_ms of a delta; final of a snapshot). `progress` condenses them to a row a response, `proof` judges it. Texts are
compared whole: what was received must be the final snapshot, or that but for white space at its end.

Parts are grouped before messages, so a task holds the text of one part at a time.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics

#: Types of parts that hold generated content, and the clock that is trusted.
CONTENT, TRUSTED_CLOCK = ("text", "output", "reasoning"), "performance.now"
OBSERVATION = (
    "message_id string, pos long, kind string, from_start boolean, step_id string, reason string, part_id string, part_type string, text string, final boolean, "
    "stream string, event_id string, received_at double, received_mono double, clock_source string, clock_resolution_ms double"
)
#: Code points of white space that a snapshot may lack at its end.
WHITE = [*range(0x9, 0xE), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
AT_END = f"[{''.join(f'\\x{{{c:X}}}' for c in WHITE)}]+\\z"


def _kind(part_type: Column) -> Column:
    return F.when(part_type == "reasoning", "reasoning").otherwise("output")


def deltas(observations: DataFrame) -> DataFrame:
    """The deltas that count: not empty, each event once, with `clocked` (a valid clock), `timed` (and in order of it)."""
    own = observations.filter("kind = 'delta' and text <> ''")
    again = Window.partitionBy("message_id", "event_id").orderBy("pos")
    once = own.withColumn("__n", F.when(F.col("event_id").isNotNull(), F.row_number().over(again)).otherwise(1)).filter("__n = 1").drop("__n")
    attributed = F.col("part_id").isNotNull() & F.col("part_type").isin(*CONTENT)
    clocked = F.coalesce(attributed, F.lit(False)) & metrics.valid(F.col("received_at")) & metrics.valid(F.col("received_mono"))
    latest = F.max(F.when(F.col("clocked"), F.col("received_mono"))).over(Window.partitionBy("message_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return once.withColumn("attributed", F.coalesce(attributed, F.lit(False))).withColumn("clocked", clocked).withColumn("timed", F.col("clocked") & ~F.coalesce(F.col("received_mono") < latest, F.lit(False)))


def parts(observations: DataFrame, counted: DataFrame) -> DataFrame:
    """(message_id, part_id, type, received, gap, ...): a row a part; how its deltas compare with its final snapshot."""
    columns = ["message_id", "part_id", "pos", "kind", "part_type", "text", "final"]
    shown = observations.filter("kind = 'snapshot' and part_id is not null").select(*columns)
    rows = counted.filter("part_id is not null").select(*columns, "timed").unionByName(shown, allowMissingColumns=True)
    is_delta, is_shown = F.col("kind") == "delta", F.col("kind") == "snapshot"
    first = F.min(F.when(is_delta & F.col("part_type").isNotNull(), F.struct("pos", "part_type"))).over(Window.partitionBy("message_id", "part_id"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_delta, F.struct("pos", "text")))), lambda x: x["text"]), "")
    changed = is_shown & (F.col("pos") > F.col("first.pos")) & (F.col("part_type") != F.col("first.part_type"))
    own = rows.withColumn("first", first).groupBy("message_id", "part_id").agg(
        text.alias("sent"), F.max("first.part_type").alias("sent_type"), F.coalesce(F.sum(F.when(F.col("timed"), F.octet_length("text"))), F.lit(0)).alias("received"),
        F.max(F.when(is_shown & F.col("final") & F.col("text").isNotNull(), F.struct("pos", "text"))).getField("text").alias("final_text"),
        F.max(F.when(is_shown, F.struct("pos", "part_type"))).getField("part_type").alias("shown_type"), F.coalesce(F.max(changed), F.lit(False)).alias("changed"),
    )
    same = (F.col("final_text") == F.col("sent")) | ((F.col("final_text") == F.regexp_replace("sent", AT_END, "")) & (F.col("sent") != ""))
    longer = F.octet_length("final_text") > F.octet_length("sent")
    return own.select(
        "message_id", "part_id", F.coalesce("shown_type", "sent_type").alias("type"), F.octet_length("sent").alias("bytes"), "received", F.col("final_text").isNull().alias("unshown"),
        F.when(~same, F.when(longer, "snapshot-delta-gap").otherwise("snapshot-delta-mismatch")).alias("gap"), "changed",
    )


def progress(observations: DataFrame) -> DataFrame:
    """A row a response: taints, steps, stream, parts, receive span and bytes by kind. Observations in another order of delivery
    with the same `pos` give the same row. Taints are in order of name."""
    counted = deltas(observations)
    flags = lambda test, name: F.when(F.coalesce(F.max(F.coalesce(test, F.lit(False))), F.lit(False)), name)
    begun = F.max(F.when(F.col("kind") == "begin", F.col("from_start")))
    named = F.trim("step_id")
    tells = (F.col("kind") == "step") | ((F.col("kind") == "snapshot") & F.col("step_id").isNotNull())
    general = observations.groupBy("message_id").agg(
        F.coalesce(begun, F.lit(False)).alias("from_start"),
        F.array_sort(F.collect_set(F.when(tells & (named != ""), F.col("step_id")))).alias("steps"),
        F.collect_set(F.when(F.col("kind") == "taint", F.when(F.trim("reason") != "", F.trim("reason")).otherwise("unknown-coverage"))).alias("told"),
        flags(tells & ~F.coalesce(named != "", F.lit(False)), "unknown-step-identity").alias("t1"),
        flags((F.col("kind") == "snapshot") & F.col("part_id").isNull(), "anonymous-snapshot").alias("t2"),
        flags((F.col("kind") == "snapshot") & (F.col("part_type") == "tool"), "tool-usage-uncertain").alias("t3"),
    )
    bytes_ = F.octet_length("text")
    timed = F.col("timed")
    clock = (F.col("clock_source") == TRUSTED_CLOCK) & (F.col("clock_resolution_ms") > 0)
    first = F.min(F.when(timed, F.col("received_mono"))).over(Window.partitionBy("message_id"))
    by_kind = []
    for k in metrics.KINDS:
        own = timed & (_kind(F.col("part_type")) == k)
        by_kind += [F.coalesce(F.sum(F.when(own, bytes_)), F.lit(0)).alias(f"{k}_bytes"), F.coalesce(F.sum(F.when(own & (F.col("received_mono") == F.col("first")), bytes_)), F.lit(0)).alias(f"{k}_first")]
    received = counted.withColumn("first", first).groupBy("message_id").agg(
        F.min(F.when(timed, F.col("received_mono"))).alias("first_receive"), F.max(F.when(timed, F.col("received_mono"))).alias("last_receive"),
        F.min_by("received_at", F.when(timed, F.col("pos"))).alias("start"), F.max_by("received_at", F.when(timed, F.col("pos"))).alias("end"),
        F.countDistinct(F.when(timed, F.col("received_mono"))).alias("observations"), F.coalesce(F.min(F.when(timed, F.coalesce(clock, F.lit(False)))), F.lit(False)).alias("clock_trusted"),
        F.max(F.when(timed, F.col("clock_resolution_ms"))).alias("clock_resolution_ms"), F.array_sort(F.collect_set("stream")).alias("streams"), *by_kind,
        flags(F.col("part_id").isNull(), "anonymous-delta").alias("t4"), flags(~F.col("attributed"), "anonymous-or-tool-arrival").alias("t5"), flags(F.col("part_type") == "tool", "tool-usage-uncertain").alias("t6"),
        flags(F.col("attributed") & ~F.col("clocked"), "invalid-receive-clock").alias("t7"), flags(F.col("clocked") & ~timed, "nonmonotonic-receive-clock").alias("t8"), F.max("clocked").alias("arrived"),
    )
    content = F.col("type").isin(*CONTENT)
    of_parts = parts(observations, counted).groupBy("message_id").agg(
        F.sum(content.cast("int")).alias("content_parts"), F.coalesce(F.max(F.col("type") == "tool"), F.lit(False)).alias("tool_parts"), F.coalesce(F.max(content & F.col("unshown")), F.lit(False)).alias("unshown"),
        F.min_by(F.when(content, F.col("gap")), F.when(content & F.col("gap").isNotNull(), F.col("part_id"))).alias("gap"), flags(F.col("changed"), "part-kind-changed").alias("t9"),
        F.coalesce(F.max(content & (F.col("bytes") != F.col("received"))), F.lit(False)).alias("untimed"),
        *(F.coalesce(F.sum(F.when(content & (_kind(F.col("type")) == k), F.col("bytes"))), F.lit(0)).alias(f"{k}_sent") for k in metrics.KINDS),
    )
    met = general.join(received, "message_id", "left").join(of_parts, "message_id", "left")
    more = [
        F.when(F.size("steps") > 1, "multiple-step-identities"),
        F.when(F.size("streams") > 1, "mixed-streams"),
        F.when(F.col("arrived") & ~F.col("from_start"), "not-observed-from-current-start"),
    ]
    taints = F.array_sort(F.array_distinct(F.filter(F.concat("told", F.array(*(f"t{i}" for i in range(1, 10)), *more)), lambda x: x.isNotNull())))
    zero = [c for c in met.columns if c.endswith(("_bytes", "_first", "_sent"))] + ["observations", "content_parts"]
    nothing = F.array().cast("array<string>")
    out = met.withColumn("taints", taints).withColumn("streams", F.coalesce("streams", nothing)).na.fill(0, zero).na.fill(False, ["clock_trusted", "tool_parts", "unshown", "untimed"])
    return out.drop("told", "arrived", *(f"t{i}" for i in range(1, 10)))


def _evidence() -> Column:
    trusted = F.col("clock_trusted")
    span = F.col("last_receive") - F.col("first_receive")
    kinds = []
    for k in metrics.KINDS:
        kinds += [F.col(f"{k}_bytes").cast("long").alias(f"{k}_bytes"), F.col(f"{k}_first").cast("long").alias(f"{k}_first"), F.col(f"usage_{k}").alias(f"{k}_usage"), (F.col(f"{k}_bytes") > 0).alias(f"{k}_observed")]
    return F.struct(
        F.lit(3).alias("version"), F.lit("complete").alias("coverage"), F.lit(True).alias("from_start"), F.lit("receive-monotonic").alias("time_source"), F.element_at("streams", 1).alias("stream"),
        F.element_at("steps", 1).alias("step_id"), F.col("start").alias("start"), F.col("end").alias("end"), "first_receive", "last_receive", F.col("observations").cast("int").alias("observations"),
        F.when(trusted, TRUSTED_CLOCK).alias("clock_source"), F.when(trusted, F.col("clock_resolution_ms")).alias("clock_resolution_ms"),
        F.when(span < metrics.LONG_SPAN, "short").otherwise("standard").alias("quality"), *kinds,
    )


def proof(progress_rows: DataFrame, responses: DataFrame) -> DataFrame:
    """(message_id, status, reasons, evidence): whether what was observed proves a generation rate; the first condition that fails
    names the rejection.

    `responses` has message_id, output, reasoning, completed, usage_exact and reasoning_known.
    """
    met = responses.select("message_id", F.col("output").alias("usage_output"), F.col("reasoning").alias("usage_reasoning"), "completed", "usage_exact", "reasoning_known").join(progress_rows, "message_id", "left")
    span = F.col("last_receive") - F.col("first_receive")
    clock = F.col("clock_trusted") & (span >= F.greatest(F.lit(float(metrics.LEAST_SPAN)), 10 * F.col("clock_resolution_ms")))
    declared = F.col("clock_trusted")
    fits = F.when((span < metrics.LONG_SPAN) | declared, F.coalesce(clock, F.lit(False))).otherwise(True)
    no = lambda test: ~F.coalesce(test, F.lit(False))
    steps = [
        (F.col("steps").isNull(), "missing-content-observation"),
        (F.size("taints") > 0, None),
        (no(F.col("from_start")), "not-observed-from-current-start"),
        (no(F.col("usage_exact")), "unknown-final-usage"),
        (no(F.col("reasoning_known")), "unknown-reasoning-usage"),
        (F.size("steps") != 1, "unknown-or-multiple-step-identities"),
        (~metrics.valid(F.col("completed")), "unfinished-response"),
        (F.col("tool_parts"), "tool-usage-uncertain"),
        ((F.col("content_parts") == 0) | F.col("unshown"), "missing-comparable-final-snapshot"),
        (F.col("gap") == "snapshot-delta-gap", "snapshot-delta-gap"),
        (F.col("gap").isNotNull(), "snapshot-delta-mismatch"),
        (F.col("first_receive").isNull() | (F.size("streams") < 1), "missing-receive-observations"),
        ((F.col("observations") < 2) | no(span >= metrics.LEAST_SPAN), "insufficient-receive-span"),
        ((span < metrics.LONG_SPAN) & ~F.col("clock_trusted"), "unknown-receive-clock"),
        (~fits, "insufficient-receive-span"),
        (F.col("untimed"), "missing-byte-receive-timing"),
        ((F.col("usage_reasoning") > 0) & (F.col("reasoning_sent") == 0), "hidden-reasoning"),
        ((F.col("usage_output") > 0) & (F.col("output_sent") == 0), "unobserved-output"),
        (functools.reduce(Column.__or__, (F.col(f"{k}_bytes") != F.col(f"{k}_sent") for k in metrics.KINDS)), "receive-byte-mismatch"),
    ]
    reason = F.lit(None).cast("array<string>")
    for test, name in reversed(steps):
        reason = F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(name)) if name else F.col("taints")).otherwise(reason)
    judged = met.withColumn("reasons", reason).withColumn("evidence", F.when(reason.isNull(), _evidence()))
    sound = metrics.whole_evidence("evidence")
    reasons = F.coalesce("reasons", F.when(~sound, F.array(F.lit("invalid-v3-evidence"))))
    gap = F.exists(reasons, lambda r: r.contains("snapshot-delta"))
    status = F.when(reasons.isNull(), "complete").when(gap, "gap").otherwise("unknown")
    told = metrics.coverage(status, F.coalesce(reasons, F.array().cast("array<string>")))
    return judged.select("message_id", told.alias("coverage"), F.when(sound & F.col("evidence").isNotNull(), F.col("evidence")).alias("evidence"))
