"""Sums, rates and latencies of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, tokens
from ..schema import TOKENS
from . import forest


def session_usage(responses: DataFrame, key: str = "session_id") -> DataFrame:
    """Direct sums of a session, calls, total, generated and cache hit rate."""
    sums = responses.groupBy(key).agg(*(F.sum(c).alias(c) for c in TOKENS), F.sum("cost").alias("cost"), F.count("*").alias("calls"))
    rate = tokens.cache_hit_rate(F.col("cache_read"), F.col("input"), F.col("cache_write"))
    return sums.select("*", tokens.total().alias("total"), tokens.generated().alias("generated"), rate.alias("cache_hit_rate"))


def at_least_zero(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))


def first_token_delay(start: str = "start", first: str = "first_response", explicit: str = "ttft", token: str = "first_token") -> Column:
    """Milliseconds to the first response, else the reported delay, else to the first token; at least 0, null if unknown."""
    known = F.col(first).isNotNull() & F.col(start).isNotNull() & (F.col(first) >= F.col(start))
    return at_least_zero(F.when(known, F.col(first) - F.col(start)).when(F.col(explicit).isNotNull(), F.col(explicit)).otherwise(F.col(token) - F.col(start)))


def duration(start: str = "start", completed: str = "completed", explicit: str = "duration") -> Column:
    return at_least_zero(F.coalesce(F.col(explicit), F.col(completed) - F.col(start)))


def original_timing() -> Column:
    return ~F.coalesce(F.col("start_missing"), F.lit(False)) & F.coalesce(F.col("completed") > F.col("start"), F.lit(False))


def first_output(candidates: list[str], start: str = "start", completed: str = "completed") -> Column:
    """The earliest candidate within the response's time."""
    inside = F.filter(F.array(*candidates), lambda t: t.isNotNull() & (t >= F.col(start)) & (t <= F.coalesce(F.col(completed), t)))
    return F.array_min(inside)


def first_response(signal: str = "signal") -> Column:
    """struct(first_response, source, time_source, estimated) after a signal (at, source, time_source, estimated) is taken in.

    A signal outside the response's time changes nothing. Of the response known before, the earliest output and the signal
    the earliest counts; at equal times what was known before.
    """
    start, completed, prior, at = F.col("start"), F.col("completed"), F.col("first_response"), F.col(f"{signal}.at")
    inside = lambda t: F.coalesce((t >= start) & (t >= 0) & (completed.isNull() | (t <= completed)), F.lit(False))
    content = first_output(["first_content", "first_token"])
    known = F.when(inside(prior), prior)
    as_was = F.struct(prior.alias("first_response"), F.col("first_response_source").alias("source"), F.col("first_response_time_source").alias("time_source"), F.col("first_response_estimated").alias("estimated"))
    by_content = F.struct(content.alias("first_response"), F.lit("content").alias("source"), F.lit("arrival").alias("time_source"), F.lit(True).alias("estimated"))
    by_signal = F.struct(at.alias("first_response"), F.col(f"{signal}.source").alias("source"), F.col(f"{signal}.time_source").alias("time_source"), F.col(f"{signal}.estimated").alias("estimated"))
    stays = ~inside(at) | (known.isNotNull() & (known <= at) & (content.isNull() | (known <= content)))
    older = content.isNotNull() & (content <= at) & (known.isNull() | (content < known))
    return F.when(F.coalesce(stays, F.lit(False)), as_was).when(F.coalesce(older, F.lit(False)), by_content).otherwise(by_signal)


def content_arrival(at: str = "at") -> Column:
    """struct(first_content, first_token, first_response, source, time_source, estimated) after content came in at a time.

    Content outside the response's time changes nothing; else the earliest content known is the first, and stands as a signal
    of the first response too.
    """
    start, completed, now = F.col("start"), F.col("completed"), F.col(at)
    fine = valid(start) & valid(now) & (now >= start) & (completed.isNull() | (valid(completed) & (now <= completed)))
    known = F.filter(F.array("first_content", "first_token", at), lambda t: t.isNotNull() & (t >= start) & (t <= F.coalesce(completed, now)))
    first = F.array_min(known)
    prior = F.col("first_response")
    held = F.when(F.coalesce((prior >= start) & (prior >= 0) & (completed.isNull() | (prior <= completed)), F.lit(False)), prior)
    stays = F.coalesce(held <= first, F.lit(False))
    shape = lambda content, token, response, source, clock, estimated: F.struct(
        content.alias("first_content"), token.alias("first_token"), response.alias("first_response"), source.alias("source"), clock.alias("time_source"), estimated.alias("estimated")
    )
    was = [F.col("first_response"), F.col("first_response_source"), F.col("first_response_time_source"), F.col("first_response_estimated")]
    new = [first, F.lit("content"), F.lit("arrival"), F.lit(True)]
    return F.when(~fine, shape(F.col("first_content"), F.col("first_token"), *was)).when(stays, shape(first, first, *was)).otherwise(shape(first, first, *new))


#: Why a generation rate was not measured; the first eight known ones of 64 are kept.
COVERAGE_REASONS = [
    "unknown-coverage", "generation-invalidated", "invalid-v3-evidence", "missing-content-observation", "not-observed-from-current-start", "unknown-final-usage", "unknown-reasoning-usage", "unattributed-or-merged-deltas",
    "unknown-or-multiple-step-identities", "unknown-step-identity", "multiple-step-identities", "missing-receive-observations", "insufficient-receive-span", "unknown-receive-clock", "unfinished-response", "tool-usage-uncertain",
    "snapshot-delta-gap", "snapshot-delta-mismatch", "missing-comparable-final-snapshot", "missing-byte-receive-timing", "hidden-reasoning", "unobserved-output", "receive-byte-mismatch", "invalid-arrival-bytes", "anonymous-or-tool-arrival",
    "invalid-receive-clock", "arrival-kind-mismatch", "mixed-streams", "duplicate-or-unparsed-arrival", "nonmonotonic-receive-clock", "merged-receive-streams", "merged-recovered-content", "merged-delta-streams", "unknown-merged-coverage",
    "anonymous-snapshot", "part-kind-changed", "anonymous-delta", "retry", "failed", "recovery", "disconnect", "transport-disruption", "recovered-content", "unobserved-response-start", "not-current-assistant",
    "superseded-assistant", "previous-response-disruption", "aborted", "cancelled",
]


def coverage(status: Column, reasons: Column) -> Column:
    """struct(status, reasons): none for complete coverage, and one at least for any other; null for an unknown status."""
    known = F.slice(F.array_distinct(F.filter(F.slice(reasons, 1, 64), lambda r: F.coalesce(r.isin(COVERAGE_REASONS), F.lit(False)))), 1, 8)
    some = F.when(F.coalesce(F.size(known), F.lit(0)) > 0, known).otherwise(F.array(F.lit("unknown-coverage")))
    return F.when(status == "complete", F.struct(status.alias("status"), F.array().cast("array<string>").alias("reasons"))).when(status.isin("unknown", "gap"), F.struct(status.alias("status"), some.alias("reasons")))


def of_basis(totals: DataFrame, measures: list[str], version: int = 3) -> DataFrame:
    """Sums of generation measures where they were taken on another basis start again at 0; all others stay."""
    other = ~F.coalesce(F.col("basis") == version, F.lit(False))
    return totals.withColumns({m: F.when(other, F.lit(0).cast(totals.schema[m].dataType)).otherwise(F.col(m)) for m in measures}).withColumn("basis", F.lit(version))


def finite(x: Column) -> Column:
    """x where it is finite and not negative."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x != float("inf")), x.cast("double"))


def response_stats(responses: DataFrame, key: str = "session_id", order: tuple[str, ...] = ("pos", "message_id"), part: str | None = None) -> DataFrame:
    """Calls, and average, greatest and least speed (output per second), first-token delay and duration over finite values that are
    not negative; 0 without any.

    Sums of fractions depend on their order, so rows are added in `order`: the same bits however rows are dealt to tasks. With
    `part` (few values) each part of a session is added up alone, and then the parts in order. Running sums hold no session in memory.
    """
    rows = responses.withColumn("took", duration()).withColumn("delay", first_token_delay())
    rows = rows.withColumn("speed", F.when(F.col("took") > 0, F.col("output") * 1000 / F.col("took")))
    names = {"speed": "speed", "delay": "delay", "duration": "took"}
    rows = rows.select(F.col(key), (F.col(part) if part else F.lit(0)).alias("__part"), F.struct(*order, *names.values()).alias("__place"), *(finite(F.col(c)).alias(n) for n, c in names.items()))
    upto = Window.partitionBy(key, "__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({f"__sum_{n}": F.sum(n).over(upto) for n in names})
    last = F.max_by(F.struct(*(F.col(f"__sum_{n}").alias(n) for n in names)), "__place").alias("sums")
    parts = summed.groupBy(key, "__part").agg(F.count("*").alias("calls"), last, *(f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.count, F.max, F.min)))
    held = parts.groupBy(key).agg(
        F.sum("calls").alias("calls"), F.transform(F.array_sort(F.collect_list(F.struct("__part", "sums"))), lambda x: x["sums"]).alias("sums"),
        *(f(f"{was}_{n}").alias(f"{was}_{n}") for n in names for f, was in ((F.sum, "count"), (F.max, "max"), (F.min, "min"))),
    )
    whole = lambda n: F.aggregate("sums", F.lit(0.0), lambda x, y: x + F.coalesce(y[n], F.lit(0.0)))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    told = [c for n in names for c in (zero(F.when(F.col(f"count_{n}") > 0, whole(n) / F.col(f"count_{n}")), f"avg_{n}"), zero(F.col(f"max_{n}"), f"max_{n}"), zero(F.col(f"min_{n}"), f"min_{n}"))]
    return held.select(key, "calls", *told)


def response_rate(responses: DataFrame) -> DataFrame:
    """Generated tokens and milliseconds of each response that has original timing; an estimate unless quality is exact."""
    exact = F.coalesce(F.col("quality"), F.lit("exact")) == "exact"
    return responses.filter(original_timing()).select("message_id", "session_id", tokens.generated().alias("tokens"), (F.col("completed") - F.col("start")).alias("ms"), (~exact).alias("estimated"))


def session_rate(measures: DataFrame, key: str = "session_id") -> DataFrame:
    """Tokens per second of a session: the ratio of sums, not the mean of ratios; null without time."""
    sums = measures.groupBy(key).agg(F.sum("tokens").alias("tokens"), F.sum("ms").alias("ms"), F.sum(F.col("estimated").cast("long")).alias("estimates"))
    return sums.select("*", F.when(F.col("ms") > 0, F.col("tokens") * 1000 / F.col("ms")).alias("rate"))


def speed_totals(measures: DataFrame, key: str = "session_id") -> DataFrame:
    """Accumulators of rates from measures (tokens, ms, estimated, short, coverage, sign): what is taken back has sign -1, and
    no sum goes below 0."""
    sign = F.col("sign")
    up = lambda c, name: F.greatest(F.sum(c), F.lit(0)).alias(name)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    return measures.groupBy(key).agg(up(sign * F.col("tokens"), "tokens"), up(sign * F.col("ms"), "ms"), up(sign, "responses"), up(sign * flag("estimated"), "estimated"), up(sign * flag("short"), "short"), up(sign * F.col("coverage"), "coverage"))


#: Milliseconds that a span must have at least, and from which it needs no declared clock.
LEAST_SPAN, LONG_SPAN = 100, 1000
KINDS = ("output", "reasoning")


def valid(x: Column) -> Column:
    return F.coalesce((x >= 0) & ~F.isnan(x.cast("double")) & (x.cast("double") != float("inf")), F.lit(False))


def whole_evidence(e: str = "evidence") -> Column:
    """Whether stored evidence of a generation rate holds by all of its fields: kind, source, clock, span, counts, bytes and usage."""
    c = lambda name: F.col(f"{e}.{name}")
    span = c("last_receive") - c("first_receive")
    declared = c("clock_source").isNotNull() | c("clock_resolution_ms").isNotNull()
    clock = (c("clock_source") == "performance.now") & (c("clock_resolution_ms") > 0) & (span >= F.greatest(F.lit(LEAST_SPAN), 10 * c("clock_resolution_ms")))
    timed = valid(span) & (span >= LEAST_SPAN) & (((span >= LONG_SPAN) & ~declared) | F.coalesce(clock, F.lit(False)))
    quality = F.when(span < LONG_SPAN, "short").otherwise("standard")
    named = F.when((quality == "short") | c("quality").isNotNull(), c("quality").eqNullSafe(quality)).otherwise(True)
    out = (c("version") == 3) & (c("coverage") == "complete") & c("from_start") & (c("time_source") == "receive-monotonic") & c("stream").isin("legacy", "v2") & (F.trim(c("step_id")) != "")
    out = out & valid(c("start")) & valid(c("end")) & valid(c("first_receive")) & valid(c("last_receive")) & timed & (c("observations") >= 2) & named
    for k in KINDS:
        bytes_, first, usage = c(f"{k}_bytes"), c(f"{k}_first"), c(f"{k}_usage")
        out = out & (first >= 0) & (first <= bytes_) & valid(usage) & ~((usage > 0) & (bytes_ == 0)) & (c(f"{k}_observed") == (bytes_ > 0))
    first, total = (sum((c(f"{k}_{x}") for k in KINDS[1:]), c(f"{KINDS[0]}_{x}")) for x in ("first", "bytes"))
    return F.coalesce(out & (first > 0) & (total > first), F.lit(False))


def interval_measure(e: str = "evidence") -> Column:
    """struct(tokens, coverage, ms, quality) of whole evidence: usage of each kind by the share of its bytes after the first batch."""
    c = lambda name: F.col(f"{e}.{name}")
    share = [F.when(c(f"{k}_bytes") > 0, c(f"{k}_usage") * ((c(f"{k}_bytes") - c(f"{k}_first")) / c(f"{k}_bytes"))).otherwise(F.lit(0.0)) for k in KINDS]
    ms = c("last_receive") - c("first_receive")
    body = F.struct((share[0] + share[1]).alias("tokens"), (c("output_usage") + c("reasoning_usage")).alias("coverage"), ms.alias("ms"), F.when(ms < LONG_SPAN, "short").otherwise("standard").alias("quality"))
    return F.when(whole_evidence(e), body)


def calibrated(samples: DataFrame, key: str = "key", weight: str = "weight", target: str = "target") -> DataFrame:
    """Whole numbers in proportion to the weights that add up to the target: largest remainders first, then by place."""
    whole = Window.partitionBy(key)
    exact = F.col(weight) * F.col(target) / F.sum(weight).over(whole)
    rows = samples.withColumn("exact", exact).withColumn("low", F.floor("exact").cast("long"))
    left = F.col(target) - F.sum("low").over(whole)
    place = F.row_number().over(whole.orderBy((F.col("exact") - F.col("low")).desc(), "pos"))
    return rows.withColumn("left", left).withColumn("place", place).select(*samples.columns, (F.col("low") + (F.col("place") <= F.col("left")).cast("long")).alias("share"))


def recent(responses: DataFrame, count: int = 24, below: DataFrame | None = None) -> DataFrame:
    """The last responses by the time they were completed, of all sessions or of those in `below` (id)."""
    if below is not None:
        responses = responses.join(below.withColumnRenamed("id", "session_id"), "session_id", "left_semi")
    return responses.orderBy(F.coalesce("completed", "start").desc_nulls_last(), F.col("pos").desc(), "message_id").limit(count)


def child_rows(records: DataFrame, links: DataFrame) -> DataFrame:
    """(root, id, depth, calls, generated, total, agents, model): sessions below a root with usage of their own or below them,
    what they used themselves, their agents in order and the model of their latest record ('-' if none)."""
    own = session_usage(records).select(F.col("session_id").alias("id"), "calls", "generated", "total")
    used = forest.rollup(own.select("id", "total"), links, ["total"]).filter("including_total > 0").select("id")
    shown = used.unionByName(own.select("id")).distinct()
    agents = records.groupBy(F.col("session_id").alias("id")).agg(text.agent_set(text.agent_name(F.col("agent"))).alias("agents"))
    models = latest_model(records).withColumnRenamed("session_id", "id")
    rows = forest.shown_depth(links, shown).join(own, "id", "left").join(agents, "id", "left").join(models, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("root", "id", "depth", zero("calls"), zero("generated"), zero("total"), F.coalesce("agents", F.array().cast("array<string>")).alias("agents"), F.coalesce("model", F.lit("-")).alias("model"))


def latest_model(responses: DataFrame, key: str = "session_id") -> DataFrame:
    when = F.struct(F.coalesce("completed", "start").alias("t"), "pos", "model")
    return responses.filter("model is not null").groupBy(key).agg(F.max(when).getField("model").alias("model"))
