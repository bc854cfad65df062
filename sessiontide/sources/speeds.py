"""Speeds as ledgers store them: reading them from JSON by type, and writing them back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.leaves import Leaves, whole_text
from ..operators import speed

#: Names under which a speed's measures, evidence and accumulators are stored.
MEASURE = {"tokens": "generatedTokens", "ms": "durationMs", "estimated": "estimated", "coverage": "coverageGeneratedTokens", "quality": "observationQuality"}
EVIDENCE = {
    "version": "version", "coverage": "coverage", "from_start": "fromCurrentStart", "time_source": "timeSource", "stream": "selectedStream", "step_id": "stepID", "start": "start", "end": "end",
    "first_receive": "firstReceiveMono", "last_receive": "lastReceiveMono", "observations": "observationCount", "clock_source": "clockSource", "clock_resolution_ms": "clockResolutionMs",
    "quality": "observationQuality", "output_bytes": "bytes.output.total", "output_first": "bytes.output.firstBatch", "output_usage": "usage.output", "output_observed": "outputObserved",
    "reasoning_bytes": "bytes.reasoning.total", "reasoning_first": "bytes.reasoning.firstBatch", "reasoning_usage": "usage.reasoning", "reasoning_observed": "reasoningObserved",
}
ACCUMULATOR = {"tokens": "generatedTokens", "ms": "durationMs", "responses": "responseCount", "estimated": "estimatedResponseCount", "coverage": "coverageGeneratedTokens", "short": "shortResponseCount"}


def _kinds(ddl: str) -> dict[str, str]:
    return dict(f.split(":") for f in ddl[len("struct<") : -1].split(","))


def _typed(leaves: Leaves, path: str, kind: str) -> Column:
    if kind in ("string", "boolean"):
        return leaves.text(path) if kind == "string" else leaves.flag(path)
    number = leaves.number(path)
    return number if kind == "double" else F.when(number == F.floor(number), number.try_cast(kind))


def stored(leaves: Leaves, path: str) -> Column:
    """The speed at a path as it is stored, each field by its type; `operators.speed.coerced` says what of it is valid."""
    group = lambda ddl, names, inside: F.struct(*(_typed(leaves, f"{path}.{inside}.{names[n]}", k).alias(n) for n, k in _kinds(ddl).items()))
    reasons = F.transform(F.try_variant_get(leaves.raw(f"{path}.generationCoverage.reasons"), "$", "array<variant>"), whole_text)
    coverage = F.struct(leaves.text(f"{path}.generationCoverage.status").alias("status"), reasons.alias("reasons"))
    return F.struct(
        group(speed.MEASURE, MEASURE, "generation").alias("generation"), group(speed.MEASURE, MEASURE, "response").alias("response"),
        group(speed.EVIDENCE, EVIDENCE, "generationEvidence").alias("evidence"), coverage.alias("coverage"),
    ).cast(speed.SPEED)


def body(name: str = "speed") -> Column:
    """A speed as the struct that is stored; null parts are left out of the JSON."""
    measure = lambda c: F.when(F.col(c).isNotNull(), F.struct(*(F.col(f"{c}.{n}").alias(s) for n, s in MEASURE.items())))
    e = f"{name}.evidence"
    flat = [F.col(f"{e}.{n}").alias(s) for n, s in EVIDENCE.items() if "." not in s]
    bytes_ = F.struct(*(F.struct(F.col(f"{e}.{k}_bytes").alias("total"), F.col(f"{e}.{k}_first").alias("firstBatch")).alias(k) for k in ("output", "reasoning")))
    usage = F.struct(*(F.col(f"{e}.{k}_usage").alias(k) for k in ("output", "reasoning")))
    evidence = F.when(F.col(e).isNotNull(), F.struct(*flat, bytes_.alias("bytes"), usage.alias("usage")))
    whole = F.struct(measure(f"{name}.generation").alias("generation"), measure(f"{name}.response").alias("response"), evidence.alias("generationEvidence"), F.col(f"{name}.coverage").alias("generationCoverage"))
    return F.when(F.col(name).isNotNull(), whole)
