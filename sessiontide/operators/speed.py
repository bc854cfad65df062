"""Speed as a part of a record: measures, the evidence behind them, and what becomes of them when a record is corrected.

A speed is a struct of `generation` and `response` (measures), `evidence` of the generation and `coverage` (why there is none). Every
function takes rows and adds a column, step by step, so that no step's expression is copied into the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics

MEASURE = "struct<tokens:double,ms:double,estimated:boolean,coverage:double,quality:string>"
EVIDENCE = (
    "struct<version:int,coverage:string,from_start:boolean,time_source:string,stream:string,step_id:string,start:double,end:double,first_receive:double,last_receive:double,"
    "observations:int,clock_source:string,clock_resolution_ms:double,quality:string,output_bytes:bigint,output_first:bigint,output_usage:double,output_observed:boolean,"
    "reasoning_bytes:bigint,reasoning_first:bigint,reasoning_usage:double,reasoning_observed:boolean>"
)
COVERAGE = "struct<status:string,reasons:array<string>>"
SPEED = f"struct<generation:{MEASURE},response:{MEASURE},evidence:{EVIDENCE},coverage:{COVERAGE}>"


def _speed(generation: Column, response: Column, evidence: Column, coverage: Column) -> Column:
    return F.struct(generation.cast(MEASURE).alias("generation"), response.cast(MEASURE).alias("response"), evidence.cast(EVIDENCE).alias("evidence"), coverage.cast(COVERAGE).alias("coverage"))


def _interval(evidence: str) -> Column:
    """What evidence measures; null unless it holds."""
    m = metrics.interval_measure(evidence)
    return F.when(m.isNotNull(), F.struct(m["tokens"].alias("tokens"), m["ms"].cast("double").alias("ms"), F.lit(True).alias("estimated"), m["coverage"].cast("double").alias("coverage"), m["quality"].alias("quality")).cast(MEASURE))


def _lacking(reason: Column | str) -> Column:
    return F.struct(F.lit("unknown").alias("status"), F.array(reason if isinstance(reason, Column) else F.lit(reason)).alias("reasons"))


def _incomplete(coverage: Column) -> Column:
    return F.when(coverage["status"] != "complete", coverage)


def _with_usage(evidence: str) -> Column:
    """Evidence with the record's usage; its proportions stay."""
    return F.col(evidence).withField("output_usage", F.col("output").cast("double")).withField("reasoning_usage", F.col("reasoning").cast("double"))


def coerced(rows: DataFrame, name: str = "speed") -> DataFrame:
    """A stored speed with only what is valid: measures with tokens, a time above 0 and a known quality; evidence of version 3
    that holds, or older evidence whose span is the measure's time; known reasons. Null if nothing is left."""

    def clean(m: Column) -> Column:
        good = metrics.valid(m["tokens"]) & metrics.valid(m["ms"]) & (m["ms"] > 0) & m["estimated"].isNotNull() & (m["quality"].isNull() | m["quality"].isin("short", "standard"))
        return F.when(F.coalesce(good, F.lit(False)), m.withField("coverage", F.when(metrics.valid(m["coverage"]), m["coverage"])))

    s = F.col(name)
    kept = rows.withColumns({"__generation": clean(s["generation"]), "__response": clean(s["response"]), "__coverage": metrics.coverage(s["coverage"]["status"], s["coverage"]["reasons"]), "__whole": metrics.whole_evidence(f"{name}.evidence")})
    e = s["evidence"]
    span = metrics.valid(e["start"]) & metrics.valid(e["end"]) & (e["end"] > e["start"]) & (e["end"] - e["start"] == F.col("__generation.ms"))
    second = (e["version"] == 2) & e["coverage"].isin("complete", "unknown", "gap")
    none = F.lit(None).cast(EVIDENCE)
    old = {"start": e["start"], "end": e["end"], "output_observed": e["output_observed"], "reasoning_observed": e["reasoning_observed"], "version": F.when(second, 2), "coverage": F.when(second, e["coverage"])}
    names = [f.split(":")[0] for f in EVIDENCE[7:-1].split(",")]
    older = F.struct(*(old.get(n, none[n]).alias(n) for n in names)).cast(EVIDENCE)
    fine = F.col("__generation").isNotNull()
    evidence = F.when(fine & F.col("__whole"), e.cast(EVIDENCE)).when(F.coalesce(fine & span & e["output_observed"].isNotNull() & e["reasoning_observed"].isNotNull(), F.lit(False)), older)
    some = fine | F.col("__response").isNotNull() | F.col("__coverage").isNotNull()
    out = kept.withColumn(name, F.when(some, _speed(F.col("__generation"), F.col("__response"), evidence, F.col("__coverage"))))
    return out.drop("__generation", "__response", "__coverage", "__whole")


def measured(rows: DataFrame, name: str = "speed") -> DataFrame:
    """The speed of records from what was observed of them.

    `rows` has output, reasoning, start, completed, usage_exact, timing_exact, evidence (null unless complete) and coverage. The
    response's measure takes its whole time; the generation's needs exact usage and evidence that holds with the record's usage.
    """
    made = F.col("output") + F.col("reasoning")
    usable = metrics.valid(F.col("output")) & metrics.valid(F.col("reasoning")) & metrics.valid(made)
    timed = usable & metrics.valid(F.col("start")) & metrics.valid(F.col("completed")) & (F.col("completed") > F.col("start"))
    sure = F.coalesce(F.col("usage_exact") & F.col("timing_exact"), F.lit(False))
    none = F.lit(None)
    response = F.struct(made.cast("double").alias("tokens"), (F.col("completed") - F.col("start")).cast("double").alias("ms"), (~sure).alias("estimated"), none.cast("double").alias("coverage"), none.cast("string").alias("quality"))
    step = rows.withColumns({"__response": F.when(timed, response), "__sound": metrics.whole_evidence("evidence"), "__used": _with_usage("evidence")}).withColumn("__interval", _interval("__used"))
    proved = usable & F.coalesce(F.col("usage_exact"), F.lit(False)) & F.col("__sound") & metrics.valid(F.col("completed")) & F.col("__interval").isNotNull()
    given = _incomplete(metrics.coverage(F.col("coverage.status"), F.col("coverage.reasons")))
    reason = F.when(proved, none.cast(COVERAGE)).when(usable & F.col("evidence").isNotNull(), F.coalesce(given, _lacking("invalid-v3-evidence"))).otherwise(given)
    out = step.withColumn(name, _speed(F.when(proved, F.col("__interval")), F.col("__response"), F.when(proved, F.col("__used")), reason))
    return out.drop("__response", "__sound", "__used", "__interval")


def _qualified(rows: DataFrame, speed: str, flag: str) -> DataFrame:
    """Adds whether a stored generation is just what its evidence measures."""
    step = rows.withColumn("__expected", _interval(f"{speed}.evidence"))
    g, e = F.col(f"{speed}.generation"), F.col("__expected")
    named = F.when((e["quality"] == "short") | g["quality"].isNotNull(), g["quality"].eqNullSafe(e["quality"])).otherwise(True)
    same = e.isNotNull() & g["estimated"] & (g["ms"] == e["ms"]) & (g["tokens"] == e["tokens"]) & (g["coverage"] == e["coverage"]) & named
    return step.withColumn(flag, F.coalesce(same, F.lit(False))).drop("__expected")


def qualified(rows: DataFrame, speed: str = "speed", flag: str = "qualified") -> DataFrame:
    """Adds whether a record's generation holds: its evidence measures it, and with the usage of the record, which is completed."""
    own = F.col(f"{speed}.evidence.output_usage") == F.col("output"), F.col(f"{speed}.evidence.reasoning_usage") == F.col("reasoning")
    return _qualified(rows, speed, flag).withColumn(flag, F.col(flag) & metrics.valid(F.col("completed")) & F.coalesce(own[0] & own[1], F.lit(False)))


def corrected(rows: DataFrame, speed: str = "speed", prior: str = "prior") -> DataFrame:
    """The speed of records after a correction; `rows` has output, reasoning, completed, the new and the prior speed, and
    generation_status.

    An invalidated generation goes for good and says why. A new one that holds counts. Else the prior one is rescaled to the
    corrected usage, and if its evidence does not bear that, the reason stands: reasoning or output that was never observed.
    """
    step = _qualified(qualified(rows, speed, "__now"), prior, "__before").withColumn("__used", _with_usage(f"{prior}.evidence")).withColumn("__interval", _interval("__used"))
    s, p = F.col(speed), F.col(prior)
    none = F.lit(None)
    left = _incomplete(p["coverage"])
    told = F.coalesce(s["coverage"], left)
    hidden = F.when((F.col("reasoning") > 0) & (p["evidence"]["reasoning_bytes"] == 0), "hidden-reasoning").when((F.col("output") > 0) & (p["evidence"]["output_bytes"] == 0), "unobserved-output").otherwise("unknown-final-usage")
    retried = F.col("__before") & metrics.valid(F.col("completed"))
    scaled = retried & F.col("__interval").isNotNull()
    revoked = _speed(none, s["response"], none, F.coalesce(_incomplete(s["coverage"]), left, _lacking("generation-invalidated")))
    outcome = (
        F.when(F.col("generation_status") == "invalidated", revoked)
        .when(F.col("__now"), _speed(s["generation"], s["response"], s["evidence"], none))
        .when(scaled, _speed(F.col("__interval"), s["response"], F.col("__used"), none))
        .when(retried, _speed(none, s["response"], none, F.coalesce(told, _lacking(hidden))))
        .otherwise(_speed(none, s["response"], none, told))
    )
    return step.withColumn(speed, outcome).drop("__now", "__before", "__used", "__interval")


def primary_rate(rows: DataFrame, speed: str = "speed") -> DataFrame:
    """Adds available, rate and basis: the observed generation, or none; the response's rate never stands in for it."""
    g = F.col(f"{speed}.generation")
    step = qualified(rows, speed, "__holds").withColumn("rate", F.when(F.col("__holds") & (g["ms"] > 0), g["tokens"] * 1000 / g["ms"]))
    return step.withColumns({"available": F.col("rate").isNotNull(), "basis": F.when(F.col("rate").isNotNull(), "generation")}).drop("__holds")
