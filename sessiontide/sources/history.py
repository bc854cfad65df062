"""Histories: one response as JSON per line.

A record counts only if its ids are texts and not empty. What else has the wrong type is null, and so is all of a line that is no JSON.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, tokens
from ..functions.leaves import Leaves, filled, whole_number, whole_text
from ..operators import ledger, speed
from ..schema import EXCLUDED_ITEM, EXCLUDED_SESSION, PENDING, USER
from . import speeds as stored_speeds
from . import tail as tails


#: A line's place: files left behind come after all others, by their time stamp, then files by name and lines as they stand.
PLACE = "struct<stamp:bigint,file:string,row:bigint>"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, pos): lines that are not blank; `pos` is a struct that orders lines over all files.

    Spark deals files to tasks by size, so a row's number alone is no order over several files. Files go by the
    time stamp in their name, if they are temporary ones left behind (`name.process.time.mark.tmp`), and by
    name; within a file, tasks and their rows are in order of place.
    """
    rows = spark.read.text(path).select(F.regexp_replace("value", "^﻿|\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    stamp = F.coalesce(F.expr("try_cast(nullif(regexp_extract(file, '[.][0-9]+[.]([0-9]+)[.][^./]+[.]tmp$', 1), '') as bigint)"), F.lit(-1))
    return rows.filter(F.trim("value") != "").select("value", "file", F.struct(stamp.alias("stamp"), "file", "row").alias("pos"))


#: The scopes as they are stored, and the reasons that evidence may give. Anything else is no evidence.
STORED_SCOPES = {"user": USER, "pending": PENDING, "magic-message": EXCLUDED_ITEM, "magic-session": EXCLUDED_SESSION}
REASONS = ["hidden-metadata", "session-agent", "session-title", "message-agent", "message-mode", "magic-model", "compaction-summary", "compaction-agent", "normal-agent", "parent-link"]


def evidence(leaves: Leaves, path: str) -> dict[str, Column]:
    """scope, reasons and parent of stored evidence of version 1 at a path, null for unknown scopes; the known reasons among the
    first 64, each once in order."""
    said = leaves.text(f"{path}.sourceScope")
    scope = F.lit(None).cast("string")
    for stored, name in STORED_SCOPES.items():
        scope = F.when(said == stored, name).otherwise(scope)
    scope = F.when(leaves.number(f"{path}.version") == 1, scope)
    raw = F.coalesce(F.try_variant_get(leaves.raw(f"{path}.reasons"), "$", "array<variant>"), F.array().cast("array<variant>"))
    given = F.transform(F.slice(raw, 1, 64), whole_text)
    reasons = F.array_distinct(F.filter(given, lambda x: F.coalesce(x.isin(REASONS), F.lit(False))))
    parent = filled(leaves.text(f"{path}.parentSessionID"))
    return {"scope": scope, "reasons": F.when(scope.isNotNull(), reasons), "parent": F.when(scope.isNotNull(), parent)}


def stored_scope(scope: Column) -> Column:
    out = F.lit(None).cast("string")
    for stored, name in STORED_SCOPES.items():
        out = F.when(scope == name, stored).otherwise(out)
    return out


def live_update(leaves: Leaves, path: str) -> Column:
    """A live update at a path, null unless all of it but the revision is there."""
    text_, amount = (lambda name: leaves.text(f"{path}.{name}")), (lambda name: F.when(leaves.number(f"{path}.{name}") >= 0, leaves.number(f"{path}.{name}")))
    seen = F.transform(F.try_variant_get(leaves.raw(f"{path}.seenFingerprints"), "$", "array<variant>"), whole_text)
    body = F.struct(
        text_("instanceID").alias("instance"), amount("sequence").alias("sequence"), amount("receivedAt").alias("received_at"), amount("revision").alias("revision"),
        text_("fingerprint").alias("fingerprint"), seen.alias("seen"),
    )
    there = [body[c].isNotNull() for c in ("instance", "sequence", "received_at", "fingerprint")]
    whole = (text_("source") == "live") & functools.reduce(Column.__and__, there) & ~F.exists(seen, lambda x: x.isNull())
    return F.when(F.coalesce(whole, F.lit(False)), body)


def samples_at(leaves: Leaves, path: str) -> Column:
    """Samples with a time and a number of tokens; amounts are at least 0."""
    get = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    raw = F.coalesce(F.try_variant_get(leaves.raw(path), "$", "array<variant>"), F.array().cast("array<variant>"))
    typed = F.transform(raw, lambda x: F.struct(F.transform(F.array(*(get(x, n) for n in ("timestamp", "tokens", "estimatedTokens", "bytes"))), whole_number).alias("n"), whole_text(get(x, "kind")).alias("kind")))
    good = F.filter(typed, lambda x: x["n"][0].isNotNull() & x["n"][1].isNotNull())
    return F.transform(
        good,
        lambda x: F.struct(
            x["n"][0].alias("timestamp"), tokens.floored(x["n"][1]).alias("tokens"), tokens.floored(x["n"][2]).alias("estimatedTokens"), tokens.floored(x["n"][3]).alias("bytes"),
            F.when(x["kind"].isin("output", "reasoning"), x["kind"]).alias("kind"),
        ),
    )


TIMES = {"start": "start", "first_token": "firstToken", "first_response": "firstResponse", "first_content": "firstContent", "completed": "completed", "ttft": "ttft", "duration": "duration"}


def responses(rows: DataFrame, speeds: bool = False) -> DataFrame:
    """Normalized records of lines (value, pos); those with another version or without ids are dropped. With `speeds` the
    stored speed comes too, with what is valid of it."""
    leaves = Leaves()
    said, number = leaves.text, leaves.number
    among = lambda c, *names: F.when(c.isin(*names), c)
    proof = evidence(leaves, "scope")
    start = number("time.start")
    columns = [
        filled(said("messageID")).alias("message_id"),
        filled(said("sessionID")).alias("session_id"),
        filled(said("parentSessionID")).alias("parent_id"),
        filled(said("model")).alias("model"),
        text.agent_name(said("agent")).alias("agent"),
        among(said("quality"), "exact", "provisional").alias("quality"),
        *tokens.said(number, "tokens."),
        F.coalesce(tokens.floored(number("cost")), F.lit(0.0)).alias("cost"),
        *(F.coalesce(start, F.lit(0.0)).alias("start") if c == "start" else number(f"time.{p}").alias(c) for c, p in TIMES.items()),
        (F.coalesce(leaves.flag("time.startMissing"), F.lit(False)) | start.isNull()).alias("start_missing"),
        among(said("time.firstResponseSource"), "thinking", "content").alias("first_response_source"),
        among(said("time.firstResponseTimeSource"), "part-start", "arrival").alias("first_response_time_source"),
        leaves.flag("time.firstResponseEstimated").alias("first_response_estimated"),
        samples_at(leaves, "samples").alias("samples"),
        live_update(leaves, "update").alias("update"),
        number("update.revision").alias("revision"),
        proof["scope"].alias("scope"),
        proof["reasons"].alias("scope_reasons"),
        proof["parent"].alias("scope_parent"),
    ]
    if speeds:
        columns.append(stored_speeds.stored(leaves, "speed").alias("speed"))
    right = leaves.raw("version").isNull() | F.coalesce(number("version") == 1, F.lit(False))
    read_ = leaves.over(rows).filter(right).select(*columns, "pos").filter("message_id is not null and session_id is not null")
    whole = read_.withColumn("tokens", tokens.counters())
    whole = speed.coerced(whole) if speeds else whole
    return whole.select(*(c for c in read_.columns if not c.startswith("said_")), *(F.col(f"tokens.{c}").alias(c) for c in ("input", "output", "reasoning", "cache_read", "cache_write")))


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The history of one or several files, each message once, as upserts in order of file and line leave it; temporary
    files that were left behind come after the others, in order of the time stamp in their name."""
    return ledger.history(responses(lines(spark, path)))


def body(columns: list[str]) -> Column:
    """A record as the struct that its JSON line has; what a table lacks is left out."""
    some = lambda pairs: [F.col(c).alias(n) for c, n in pairs if c in columns]
    update = F.struct(F.lit("live").alias("source"), F.col("update.instance").alias("instanceID"), F.col("update.sequence").alias("sequence"), F.col("update.received_at").alias("receivedAt"), F.col("update.revision").alias("revision"), F.col("update.fingerprint").alias("fingerprint"), F.col("update.seen").alias("seenFingerprints"))
    scope = F.struct(F.lit(1).alias("version"), stored_scope(F.col("scope")).alias("sourceScope"), F.coalesce("scope_reasons", F.array().cast("array<string>")).alias("reasons"), F.col("scope_parent").alias("parentSessionID"))
    times = some([*TIMES.items(), ("start_missing", "startMissing"), ("first_response_source", "firstResponseSource"), ("first_response_time_source", "firstResponseTimeSource"), ("first_response_estimated", "firstResponseEstimated")])
    rate = [stored_speeds.body().alias("speed")] if "speed" in columns else []
    return F.struct(
        *rate, F.lit(1).alias("version"), *some([("message_id", "messageID"), ("session_id", "sessionID"), ("parent_id", "parentSessionID"), ("model", "model"), ("agent", "agent"), ("quality", "quality")]),
        F.struct("input", "output", "reasoning", F.col("cache_read").alias("cacheRead"), F.col("cache_write").alias("cacheWrite")).alias("tokens"), "cost", F.struct(*times).alias("time"), *some([("samples", "samples")]),
        F.when(F.col("update").isNotNull(), update).alias("update"), F.when(F.col("scope").isNotNull(), scope).alias("scope"),
    )


def write(records: DataFrame, path: str) -> None:
    """One JSON line a record, each message once, in order of admission within a file, replacing what was there."""
    rows = ledger.history(records)
    rows.select("pos", F.to_json(body(rows.columns)).alias("value")).sortWithinPartitions("pos").select("value").write.mode("overwrite").text(path)


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as records; the checkpoint of the query keeps the place."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    rows = text.select(F.regexp_replace("value", "^﻿|\r$", "").alias("value"), F.lit(0).cast("long").alias("pos"))
    return responses(rows.filter("trim(value) <> ''"))


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """Records of lines as they are added to a folder's files, with their place (file, at) as `pos`."""
    rows = tails.stream(spark, folder)
    return responses(rows.select(F.regexp_replace("value", "^﻿|\r$", "").alias("value"), F.struct("file", "at").alias("pos")).filter("trim(value) <> ''"))
