"""Totals ledgers: one JSON document of maps, read as rows. Reading is strict: a ledger with any wrong member is refused."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import speed
from . import speeds, store
from .history import STORED_SCOPES

EVIDENCE = "struct<version:int,sourceScope:string,reasons:array<string>,parentSessionID:string>"
UPDATE = "struct<source:string,instanceID:string,sequence:double,receivedAt:double,revision:double,fingerprint:string,seenFingerprints:array<string>>"
_MEASURE = "struct<generatedTokens:double,durationMs:double,estimated:boolean,coverageGeneratedTokens:double,observationQuality:string>"
_BYTES = "struct<total:bigint,firstBatch:bigint>"
_PROOF = (
    "struct<version:int,coverage:string,fromCurrentStart:boolean,timeSource:string,selectedStream:string,stepID:string,start:double,end:double,firstReceiveMono:double,lastReceiveMono:double,"
    f"observationCount:int,clockSource:string,clockResolutionMs:double,observationQuality:string,outputObserved:boolean,reasoningObserved:boolean,bytes:struct<output:{_BYTES},reasoning:{_BYTES}>,"
    "usage:struct<output:double,reasoning:double>>"
)
SPEED = f"struct<generation:{_MEASURE},response:{_MEASURE},generationEvidence:{_PROOF},generationCoverage:struct<status:string,reasons:array<string>>>"
_SUMS = f"struct<{','.join(f'{n}:double' for n in speeds.ACCUMULATOR.values())}>"
SESSION_SPEED = f"struct<generation:{_SUMS},response:{_SUMS}>"
CONTRIBUTION = f"struct<speed:{SPEED},sessionID:string,quality:string,tokens:struct<input:double,output:double,reasoning:double,cacheRead:double,cacheWrite:double>,cost:double,update:{UPDATE},excluded:{EVIDENCE}>"
SESSION = "struct<tokens:struct<input:double,output:double,reasoning:double,cacheRead:double,cacheWrite:double>,cost:double,responseCount:double,speed:" + SESSION_SPEED + ">"
# a settled message may be `true`, which no struct can hold: its value is read as text first
DOCUMENT = f"version int, generationBasisVersion int, sessions map<string,{SESSION}>, open map<string,{CONTRIBUTION}>, settled map<string,string>, sessionScopes map<string,{EVIDENCE}>, messageScopes map<string,{EVIDENCE}>, sessionAgents map<string,array<string>>"
VERSION = 1


def document(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("ledger", F.col("_metadata.file_path"))
    return doc.filter(F.when(F.coalesce(F.col("version") == VERSION, F.lit(False)), True).otherwise(F.raise_error(F.lit("the totals ledger is invalid"))))


#: Names of the counters as ledgers write them.
STORED = {"input": "input", "output": "output", "reasoning": "reasoning", "cache_read": "cacheRead", "cache_write": "cacheWrite"}


def checked(tokens: str, cost: str, row: DataFrame) -> DataFrame:
    """The rows, or an error at the first one with a counter that is missing, negative or no number."""
    fine = F.lit(True)
    for c in (*(f"{tokens}.{t}" for t in STORED.values()), cost):
        fine = fine & F.coalesce((F.col(c) >= 0) & ~F.isnan(c) & (F.col(c) != float("inf")), F.lit(False))
    return row.filter(F.when(fine, True).otherwise(F.raise_error(F.lit("the totals ledger is invalid"))))


def sessions(doc: DataFrame) -> DataFrame:
    rows = doc.select("ledger", F.col("generationBasisVersion").alias("basis"), F.explode("sessions").alias("session_id", "s"))
    return checked("s.tokens", "s.cost", rows).select("ledger", "session_id", *(F.col(f"s.tokens.{n}").alias(t) for t, n in STORED.items()), F.col("s.cost").alias("cost"), F.col("s.responseCount").alias("calls"), "basis", *accumulated("s.speed"))


def accumulated(path: str) -> list[Column]:
    """The accumulators of a session's rates, `generation_...` and `response_...`; an invalid one is an error, none is null."""
    out = []
    for kind in ("generation", "response"):
        at = F.col(f"{path}.{kind}")
        for name, stored in speeds.ACCUMULATOR.items():
            value = at[stored]
            fine = value.isNull() | ((value >= 0) & ~F.isnan(value) & (value != float("inf")))
            needed = at.isNull() | value.isNotNull() if name in ("tokens", "ms", "responses", "estimated") else F.lit(True)
            out.append(F.when(fine & needed, value).otherwise(F.raise_error(F.lit("the totals ledger is invalid")).cast("double")).alias(f"{kind}_{name}"))
    return out


def speed_of(path: str) -> Column:
    """A contribution's speed under our own names."""
    c = F.col(path)
    measure = lambda m: F.when(m.isNotNull(), F.struct(*(m[s].alias(n) for n, s in speeds.MEASURE.items())))
    deep = lambda s: functools.reduce(lambda at, name: at[name], s.split("."), c["generationEvidence"])
    evidence = F.when(c["generationEvidence"].isNotNull(), F.struct(*(deep(s).alias(n) for n, s in speeds.EVIDENCE.items())))
    coverage = c["generationCoverage"]
    whole = F.struct(measure(c["generation"]).alias("generation"), measure(c["response"]).alias("response"), evidence.alias("evidence"), coverage.alias("coverage"))
    return F.when(c.isNotNull(), whole).cast(speed.SPEED)


def contributions(doc: DataFrame) -> DataFrame:
    """Messages of a ledger with their update and what excludes them; a settled one without a body (`true`) is counted in its
    session but can't be taken back (`legacy`)."""
    open_ = doc.select("ledger", F.lit("open").alias("status"), F.explode("open").alias("message_id", "c")).withColumn("legacy", F.lit(False))
    raw = doc.select("ledger", F.lit("settled").alias("status"), F.explode("settled").alias("message_id", "t"))
    body = F.from_json("t", CONTRIBUTION)
    legacy = F.coalesce(F.col("t") == "true", F.col("t").isNull())
    settled = raw.select("ledger", "status", "message_id", F.when(~legacy, body).alias("c"), legacy.alias("legacy"))
    rows = open_.unionByName(settled)
    good = checked("c.tokens", "c.cost", rows.filter("not legacy")).unionByName(rows.filter("legacy"))
    up = F.struct(F.col("c.update.instanceID").alias("instance"), F.col("c.update.sequence").alias("sequence"), F.col("c.update.receivedAt").alias("received_at"), F.col("c.update.revision").alias("revision"), F.col("c.update.fingerprint").alias("fingerprint"), F.col("c.update.seenFingerprints").alias("seen"))
    read_ = good.withColumn("speed", speed_of("c.speed")).withColumn("__given", F.col("speed").isNotNull())
    valid = speed.coerced(read_).filter(F.when(~F.col("__given") | F.col("speed").isNotNull(), True).otherwise(F.raise_error(F.lit("the totals ledger is invalid"))))
    return valid.select(
        "speed", "ledger", "status", "message_id", "legacy", F.col("c.sessionID").alias("session_id"), F.col("c.quality").alias("quality"), *(F.col(f"c.tokens.{n}").alias(t) for t, n in STORED.items()), F.col("c.cost").alias("cost"),
        F.when(F.col("c.update").isNotNull(), up).alias("update"), F.col("c.excluded").isNotNull().alias("excluded"),
    )


def scopes(doc: DataFrame, kind: str = "session") -> DataFrame:
    """(ledger, id, scope, reasons, parent): evidence on sessions or messages that a ledger keeps; unknown scopes are none."""
    rows = doc.select("ledger", F.explode(f"{kind}Scopes").alias("id", "s")).filter("s.version = 1")
    name = F.lit(None).cast("string")
    for stored, own in STORED_SCOPES.items():
        name = F.when(F.col("s.sourceScope") == stored, own).otherwise(name)
    return rows.select("ledger", "id", name.alias("scope"), F.col("s.reasons").alias("reasons"), F.col("s.parentSessionID").alias("parent")).filter("scope is not null")


def agents(doc: DataFrame) -> DataFrame:
    return doc.select("ledger", F.explode("sessionAgents").alias("session_id", "agents"))


#: The tables of a written ledger.
TABLES = ("sessions", "contributions", "session_scopes", "message_scopes", "agents")


def write(folder: str, **tables: DataFrame) -> None:
    """A ledger as tables (`TABLES`), each replacing what was there; a document in one piece would have to pass through one task."""
    if odd := set(tables) - set(TABLES):
        raise ValueError(f"a ledger has no {sorted(odd)}")
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a written ledger that are there."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES if store.exists(spark, f"{folder}/{name}")}
