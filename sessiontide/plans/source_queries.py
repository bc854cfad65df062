"""Queries over JSON made of the driver tables, as hosts and ledgers write it, and over records of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as shown
from ..functions import tokens
from ..functions.leaves import Leaves
from ..operators import activity, content, forest, intervals, layers, ledger, metrics, pending, precedence, runs, scope, speed
from ..schema import PENDING, UPDATE_STRUCT, USER
from ..sources import activity as logs
from ..sources import events as hosts
from ..sources import history
from ..streaming import trees
from . import projections as P
from .lineage import folder
from .queries import CLOSURE, IDS, PLAIN, QUERIES, SQL, measured, query, union_sql

__all__ = ["QUERIES", "SQL"]


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than the cluster has cores dealt out evenly, as parsing them is more work than reading them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def as_lines(rows: DataFrame, body: Column, pos: str = "pos", dealt: bool = False) -> DataFrame:
    return (rows if dealt else spread(rows)).select(F.to_json(body).alias("value"), F.col(pos).cast("long").alias("pos"))


def twice(lines: DataFrame) -> DataFrame:
    """Lines that are delivered twice, each written once."""
    return lines.withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("__copy")


# --- host events


def older_events(spark: SparkSession, d: str) -> DataFrame:
    """Status events whose word stands in several places, terminal types, types that only sound like them, and replays."""
    kind = F.col("event_type")
    nested = F.struct(F.struct(F.struct(F.lit("Retry").alias("name")).alias("state")).alias("status"))
    body = F.struct(
        F.when(kind.isin("click", "signup"), "session.status").when(kind == "view", "session.idle").when(kind == "purchase", "todo.completed").otherwise("Session.Error").alias("type"),
        F.col("event_id").cast("string").alias("id"), P.millis("ts").alias("timestamp"), F.when(F.col("event_id") % 13 == 0, "snapshot").alias("source"),
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sessionID"), F.when(kind == "click", F.struct(F.lit("busy").alias("type"))).alias("status"), F.when(kind == "signup", nested).alias("info")).alias("properties"),
    )
    return as_lines(P.table(spark, d, "events"), body, "event_id")


@query("""SELECT 'u' || user_id AS session_id, event_id::VARCHAR AS event_id, (epoch_us(ts) // 1000)::DOUBLE AS ts, CASE event_type WHEN 'click' THEN 'busy' WHEN 'signup' THEN 'retry' WHEN 'view' THEN 'idle' WHEN 'error' THEN 'failed' END AS state
FROM events WHERE event_type <> 'purchase' AND event_id % 13 <> 0""")
def event_facts(spark: SparkSession, d: str) -> DataFrame:
    """Lifecycle facts of the older kind of events: exact types, words anywhere, nothing from replays."""
    return hosts.older_facts(older_events(spark, d)).select("session_id", "event_id", "ts", "state")


@query("""WITH o AS (SELECT *, o_orderkey % 3 = 0 AS unsaid, o_orderkey % 5 = 0 AS blind FROM orders WHERE o_orderkey % 4 <> 0)
SELECT 'm' || o_orderkey AS message_id, CASE WHEN blind THEN 'provisional' ELSE 'exact' END AS quality, CASE WHEN blind THEN 0 ELSE o_custkey END::DOUBLE AS input,
  floor(o_totalprice)::DOUBLE AS output, CASE WHEN unsaid THEN 0 ELSE o_custkey % 7 END::DOUBLE AS reasoning, (epoch_us(o_orderdate) // 1000)::DOUBLE AS start, (epoch_us(o_orderdate) // 1000 + 5000)::DOUBLE AS completed FROM o""")
def event_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses of the newer kind of events: exact if input, output and reasoning were reported, or reasoning is zero;
    failed steps without usage are no calls. Every event is delivered twice."""
    key = F.col("o_orderkey")
    orders = P.table(spark, d, "orders").withColumn("at", P.millis("o_orderdate"))
    usage = F.struct(F.when(key % 5 != 0, F.col("o_custkey")).alias("input"), F.floor("o_totalprice").alias("output"), F.when(key % 3 != 0, F.col("o_custkey") % 7).alias("reasoning"))
    event = lambda kind, n, at, told: F.struct(kind.alias("type"), F.concat(F.lit(f"e{n}-"), key.cast("string")).alias("id"), at.alias("created"), F.struct((key * 2 + n).alias("seq")).alias("durable"), F.struct(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("sessionID"), F.concat(F.lit("m"), key.cast("string")).alias("assistantMessageID"), F.lit("build").alias("agent"), told.alias("tokens")).alias("data"))
    ended = key % 4 != 0
    begin = as_lines(orders, event(F.lit("session.step.started"), 0, F.col("at"), F.lit(None).cast("struct<input:long>")), "o_orderkey")
    end = as_lines(orders, event(F.when(ended, "session.step.ended").otherwise("session.step.failed"), 1, F.col("at") + 5000, F.when(ended, usage)), "o_orderkey")
    return hosts.newer_responses(twice(begin.unionByName(end))).select("message_id", "quality", "input", "output", "reasoning", "start", "completed")


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, floor(l_extendedprice)::BIGINT AS a, floor(l_quantity)::BIGINT AS q, l_suppkey % 11 AS s, (l_orderkey + l_linenumber) % 3 AS form FROM (SELECT DISTINCT * FROM lineitem))
SELECT k, n, sum(greatest(a - CASE form WHEN 2 THEN 0 ELSE q END, 0) + CASE form WHEN 2 THEN 0 ELSE 0 END)::DOUBLE AS input, sum(CASE form WHEN 0 THEN greatest(q - s, 0) ELSE q END)::DOUBLE AS output, sum(s)::DOUBLE AS reasoning, sum(CASE form WHEN 2 THEN 0 ELSE q END)::DOUBLE AS cache_read FROM l GROUP BY k, n""")
def token_normalization(spark: SparkSession, d: str) -> DataFrame:
    """Counters under three sets of names: totals that hold cache and reasoning, details apart, and plain ones."""
    line = P.table(spark, d, "lineitem").distinct().withColumns({"a": F.floor("l_extendedprice").cast("long"), "q": F.floor("l_quantity").cast("long"), "s": F.col("l_suppkey") % 11, "form": (F.col("l_orderkey") + F.col("l_linenumber")) % 3})
    form = lambda k, c: F.when(F.col("form") == k, c)
    body = F.struct(
        form(0, F.col("a")).alias("inputTokens"), form(0, F.col("q")).alias("cachedInputTokens"), form(0, F.col("q")).alias("outputTokens"), form(0, F.col("s")).alias("reasoningTokens"),
        F.when(F.col("form") == 1, F.col("a") - F.col("q")).when(F.col("form") == 2, F.col("a")).alias("input"), F.when(F.col("form") > 0, F.col("q")).alias("output"), form(2, F.col("s")).alias("reasoning"),
        form(1, F.struct(F.col("q").alias("read"))).alias("cache"), form(1, F.struct(F.col("s").alias("reasoningTokens"))).alias("outputTokenDetails"),
    )
    v = line.select("l_orderkey", "l_linenumber", F.to_json(body).alias("value"))
    v = tokens.read(v).select("l_orderkey", "l_linenumber", tokens.counters().alias("c"))
    return v.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(*(F.sum(f"c.{c}").alias(c) for c in ("input", "output", "reasoning", "cache_read")))


@query("""WITH l AS (SELECT o_orderkey AS id, o_custkey AS a, o_custkey % 7 AS q, o_custkey % 5 AS s, o_orderkey % 3 AS form FROM orders)
SELECT id, CASE form WHEN 0 THEN greatest(a - q, 0) WHEN 1 THEN greatest(a - 1, 0) END::DOUBLE AS input, CASE form WHEN 0 THEN greatest(a - s, 0) WHEN 1 THEN 9 WHEN 2 THEN 0 END::DOUBLE AS output, CASE form WHEN 1 THEN NULL ELSE s END::DOUBLE AS reasoning, CASE form WHEN 0 THEN q END::DOUBLE AS cache_read FROM l""")
def reader_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Counters as a reader finds them in records: nested under several names, only those that are reported."""
    form = F.col("o_orderkey") % 3
    a, q, s = F.col("o_custkey"), F.col("o_custkey") % 7, F.col("o_custkey") % 5
    body = F.struct(
        F.when(form == 0, F.struct(a.alias("inputTokens"), q.alias("cachedInputTokens"), a.alias("completionTokens"), a.alias("outputTokens"), s.alias("reasoningTokens"))).alias("usage"),
        F.when(form == 1, F.struct((a - 1).alias("noCacheTokens"), a.alias("promptTokens"), F.struct(F.lit(9).alias("textTokens")).alias("outputTokenDetails"))).alias("tokenUsage"),
        F.when(form == 2, F.struct(s.alias("reasoning"))).alias("tokens"),
    )
    rows = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.try_parse_json(F.to_json(body)).alias("v")).withColumn("src", tokens.reader_source("v"))
    return tokens.reader_fields(rows, "src", "c").select("id", *(F.col(f"c.{c}").alias(c) for c in ("input", "output", "reasoning", "cache_read")))


@query("""WITH o AS (SELECT o_orderkey AS id, (o_orderkey * 977) AS ms, o_custkey % 101 AS pc, round(o_totalprice * 100)::BIGINT AS cents FROM orders)
SELECT id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN CASE WHEN ((ms + 50) // 100) % 10 = 0 THEN ((ms + 50) // 1000)::VARCHAR ELSE (ms + 50) // 1000 || '.' || ((ms + 50) // 100) % 10 END || 's' WHEN ms < 3600000 THEN ms // 60000 || 'm ' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || 's'
  ELSE ms // 3600000 || 'h ' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || 'm ' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || 's' END AS took, pc || '%' AS share,
  '$' || format('{:,}', cents // 100) || CASE WHEN cents % 100 = 0 THEN '' WHEN cents % 10 = 0 THEN '.' || (cents // 10 % 10) ELSE '.' || lpad((cents % 100)::VARCHAR, 2, '0') END AS cost,
  CASE WHEN cents < 1000 THEN cents::VARCHAR WHEN cents < 100000 THEN CASE WHEN ((cents + 50) // 100) % 10 = 0 THEN ((cents + 50) // 1000)::VARCHAR ELSE (cents + 50) // 1000 || '.' || ((cents + 50) // 100) % 10 END || 'k' WHEN cents < 1000000 THEN (cents + 500) // 1000 || 'k'
  ELSE (cents + 50000) // 1000000 || '.' || ((cents + 50000) // 100000) % 10 || 'M' END AS compact FROM o""")
def shown_values(spark: SparkSession, d: str) -> DataFrame:
    """Durations, shares, costs and amounts as they are shown."""
    rows = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 977).alias("ms"), (F.col("o_custkey") % 101).alias("pc"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return rows.select("id", shown.shown_duration(F.col("ms")).alias("took"), shown.shown_percent(F.col("pc") / 100).alias("share"), shown.shown_cost(F.col("cents").cast("decimal(20,4)") / 100).alias("cost"), shown.shown_compact(F.col("cents")).alias("compact"))


@query("""SELECT l_orderkey AS session_id, greatest(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_linenumber), 0)::BIGINT AS tokens, greatest(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END), 0)::BIGINT AS responses,
  greatest(sum(CASE WHEN l_linestatus <> 'F' THEN 0 WHEN l_returnflag = 'R' THEN -1 ELSE 1 END), 0)::BIGINT AS short FROM lineitem GROUP BY 1""")
def speed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Accumulators of rates, some of them taken back."""
    n = F.col("l_linenumber").cast("long")
    rows = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), n.alias("tokens"), n.alias("ms"), n.alias("coverage"), F.lit(True).alias("estimated"), (F.col("l_linestatus") == "F").alias("short"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).cast("long").alias("sign"))
    return metrics.speed_totals(rows).select("session_id", "tokens", "responses", "short")


@query("""WITH o AS (SELECT o_orderkey AS id, 40 + o_orderkey % 2000 AS span, o_orderkey % 11 = 0 AS unclocked, o_orderkey % 7 AS q, o_custkey % 50 AS u FROM orders)
SELECT id, (u * 0.75)::DOUBLE AS tokens, span::DOUBLE AS ms, CASE WHEN span < 1000 THEN 'short' ELSE 'standard' END AS quality FROM o WHERE span >= 100 AND (span >= 1000 OR NOT unclocked) AND (unclocked OR span >= 10 * q) AND (unclocked OR q > 0)""")
def generation_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What stored evidence of a generation rate proves, by all of its fields."""
    key = F.col("o_orderkey")
    span, unclocked = 40 + key % 2000, key % 11 == 0
    e = F.struct(
        F.lit(3).alias("version"), F.lit("complete").alias("coverage"), F.lit(True).alias("from_start"), F.lit("receive-monotonic").alias("time_source"), F.lit("v2").alias("stream"), F.lit("x").alias("step_id"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"),
        F.lit(0.0).alias("first_receive"), span.cast("double").alias("last_receive"), F.lit(5).alias("observations"), F.when(~unclocked, "performance.now").alias("clock_source"), F.when(~unclocked, (key % 7).cast("double")).alias("clock_resolution_ms"), F.when(span < 1000, "short").otherwise("standard").alias("quality"),
        F.lit(40).cast("long").alias("output_bytes"), F.lit(10).cast("long").alias("output_first"), (F.col("o_custkey") % 50).cast("double").alias("output_usage"), F.lit(True).alias("output_observed"),
        F.lit(0).cast("long").alias("reasoning_bytes"), F.lit(0).cast("long").alias("reasoning_first"), F.lit(0.0).alias("reasoning_usage"), F.lit(False).alias("reasoning_observed"),
    )
    rows = P.table(spark, d, "orders").select(key.alias("id"), e.alias("evidence")).select("id", metrics.interval_measure().alias("m")).filter("m is not null")
    return rows.select("id", "m.tokens", "m.ms", "m.quality")


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey % 5 = 0 AND c_nationkey % 2 = 0 OR c_mktsegment = 'MACHINERY' OR c_nationkey = 7 THEN 'excluded_session' WHEN c_mktsegment <> 'BUILDING' THEN 'user' ELSE 'pending' END AS scope FROM customer""")
def session_scope(spark: SparkSession, d: str) -> DataFrame:
    """Scope of sessions from flag and role, agent and title."""
    rows = P.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 5 == 0, "hid").alias("flag"), F.when(F.col("c_nationkey") % 2 == 1, "other").alias("role"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "keeper").when(F.col("c_mktsegment") != "BUILDING", "build").alias("agent"), F.when(F.col("c_nationkey") == 7, "Maintain: x").alias("title"),
    )
    return rows.select("id", scope.session_class(["keeper"], ["Maintain:"], [], "hid", ["archivist"]).alias("scope"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'pending' WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'excluded_item' WHEN o_orderkey % 2 = 0 THEN 'user' ELSE 'pending' END AS scope FROM orders""")
def message_scope(spark: SparkSession, d: str) -> DataFrame:
    """Scope of messages from role, agent, mode, summary and ids of the model, nested ones too."""
    key = F.col("o_orderkey")
    rows = P.table(spark, d, "orders").select(
        key.alias("id"), F.when(F.col("o_orderstatus") == "F", "user").otherwise("assistant").alias("role"), F.when(key % 5 == 0, "keeper").when((key % 2 == 0) & (key % 13 != 0), "build").alias("agent"), F.when(key % 13 == 0, "compaction").alias("mode"),
        F.lit(None).cast("string").alias("provider_id"), F.when(key % 11 == 0, "upkeep").alias("model_id"), F.struct(F.when(key % 7 == 0, "upkeep").alias("providerID")).alias("model"), (key % 13 == 0).alias("summary"),
    )
    return rows.select("id", scope.message_class(["keeper"], "upkeep", ("provider_id", "model_id", "model.providerID")).alias("scope"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, max(CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CASE l_partkey % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'excluded_item' WHEN 2 THEN 'excluded_session' END END) AS scope,
  max(CASE WHEN l_partkey % 3 = 0 OR l_partkey % 4 = 3 THEN NULL ELSE 'parent-link,normal-agent' END) AS reasons FROM lineitem GROUP BY 1, 2 HAVING max(CASE WHEN l_partkey % 3 <> 0 AND l_partkey % 4 <> 3 THEN 1 ELSE 0 END) = 1""")
def scope_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Stored evidence: another version, unknown scopes and reasons don't count."""
    part = F.col("l_partkey")
    said = F.when(part % 4 == 0, "user").when(part % 4 == 1, "magic-message").when(part % 4 == 2, "magic-session").otherwise("magic")
    body = F.struct(F.struct((1 + (part % 3 == 0).cast("int")).alias("version"), said.alias("sourceScope"), F.array(*(F.lit(x) for x in ("parent-link", "unheard-of", "parent-link", "normal-agent"))).alias("reasons")).alias("scope"))
    rows = P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(body).alias("value"))
    leaves = Leaves()
    proof = history.evidence(leaves, "scope")
    columns = [F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), proof["scope"].alias("scope"), F.array_join(proof["reasons"], ",").alias("reasons")]
    read = leaves.over(rows).select(*columns)
    return read.groupBy("k", "n").agg(F.max("scope").alias("scope"), F.max("reasons").alias("reasons")).filter("scope is not null")


# --- stored histories


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The responses as JSON lines; of every eleventh message the last copy is a live update."""
    rows = P.responses(spark, d)
    live = F.struct(F.lit("live").alias("source"), F.lit("i").alias("instanceID"), F.lit(3).alias("sequence"), F.col("completed").alias("receivedAt"), F.lit("f").alias("fingerprint"), F.array().cast("array<string>").alias("seenFingerprints"))
    body = F.struct(
        F.lit(1).alias("version"), F.concat(F.lit("m"), F.col("message_id").cast("string")).alias("messageID"), F.col("session_id").alias("sessionID"), F.col("model").alias("model"), F.when(F.col("pos") == 0, "build").alias("agent"), F.col("quality").alias("quality"),
        F.struct(F.col("output").alias("output"), F.struct(F.lit(4).alias("read")).alias("cache")).alias("tokens"), F.col("cost").alias("cost"), F.struct("start", "completed").alias("time"),
        F.when(F.col("pos") == 2, live).alias("update"),
    )
    return as_lines(rows, body)


@query(f"""WITH {P.RESPONSES}, h AS (SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY (pos = 2) DESC, (quality = 'exact') DESC) = 1)
SELECT 'm' || message_id AS message_id, session_id, output::DOUBLE AS output, completed::DOUBLE AS completed, 'build' AS agent, pos = 2 AS live FROM h""")
def history_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Stored lines of each message folded in order: a live update beats the exact copy before it, a provisional one never does;
    the agent of the first stays."""
    kept = ledger.history(history.responses(stored(spark, d)))
    return kept.select("message_id", "session_id", "output", "completed", "agent", F.col("update").isNotNull().alias("live"))


@query(f"""WITH {P.RESPONSES} SELECT session_id, count(*)::BIGINT AS calls, sum(output)::DOUBLE AS output, sum(cost)::DOUBLE AS cost FROM
(SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY (pos = 2) DESC, (quality = 'exact') DESC) = 1) GROUP BY session_id""")
def stored_contributions(spark: SparkSession, d: str) -> DataFrame:
    """From stored lines to a ledger's sums."""
    rows = ledger.contributions(history.responses(stored(spark, d)))
    return rows.groupBy("session_id").agg(F.count("*").alias("calls"), F.sum("output").alias("output"), F.sum("cost").alias("cost"))


@query("""SELECT 'm' || o_orderkey AS message_id, o_orderpriority AS model, (o_custkey % 9)::DOUBLE AS reasoning, (o_orderkey % 5)::DOUBLE AS revision, CASE o_orderkey % 3 WHEN 0 THEN 'excluded_session' WHEN 1 THEN 'excluded_item' ELSE 'user' END AS scope,
  CASE WHEN o_orderkey % 2 = 0 THEN 'normal-agent,parent-link' ELSE '' END AS reasons, 'p' || o_custkey AS scope_parent, 2 AS n_samples, o_custkey::DOUBLE AS sampled, 'a,b' AS seen, o_orderkey % 7 = 0 AS start_missing FROM orders""")
def history_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines and read again: samples, updates and evidence come back whole."""
    key = F.col("o_orderkey")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    sample = F.struct(F.lit(1.0).alias("timestamp"), F.col("o_custkey").cast("double").alias("tokens"), F.lit(None).cast("double").alias("estimatedTokens"), F.lit(3.0).alias("bytes"), F.lit("output").alias("kind"))
    up = F.struct(F.lit("i").alias("instance"), F.lit(1.0).alias("sequence"), F.lit(2.0).alias("received_at"), (key % 5).cast("double").alias("revision"), F.lit("f").alias("fingerprint"), F.array(F.lit("a"), F.lit("b")).alias("seen"))
    zero = F.lit(0.0)
    rows = P.table(spark, d, "orders").select(
        text("m", "o_orderkey").alias("message_id"), text("s", "o_custkey").alias("session_id"), F.col("o_orderpriority").alias("model"), F.lit("exact").alias("quality"), zero.alias("input"), zero.alias("output"), (F.col("o_custkey") % 9).cast("double").alias("reasoning"), zero.alias("cache_read"), zero.alias("cache_write"),
        zero.alias("cost"), F.when(key % 7 != 0, F.lit(5.0)).alias("start"), F.lit(9.0).alias("completed"), (key % 7 == 0).alias("start_missing"), F.array(sample, sample).alias("samples"), up.cast(UPDATE_STRUCT).alias("update"), key.alias("pos"),
        F.when(key % 3 == 0, "excluded_session").when(key % 3 == 1, "excluded_item").otherwise("user").alias("scope"), F.when(key % 2 == 0, F.array(F.lit("normal-agent"), F.lit("parent-link"))).otherwise(F.array().cast("array<string>")).alias("scope_reasons"), text("p", "o_custkey").alias("scope_parent"),
    )
    back = history.responses(as_lines(rows, history.body(rows.columns)))
    return back.select("message_id", "model", "reasoning", F.col("update.revision").alias("revision"), "scope", F.array_join("scope_reasons", ",").alias("reasons"), "scope_parent", F.size("samples").alias("n_samples"), F.col("samples")[1]["tokens"].alias("sampled"), F.array_join("update.seen", ",").alias("seen"), "start_missing")


@query("""SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END + 3 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END
  + CASE WHEN o_orderkey % 13 > 0 THEN 2 + least(o_orderkey % 13, 8) ELSE 0 END + CASE WHEN o_custkey % 3 > 0 THEN 1 ELSE 0 END + 1 + 1 AS score FROM orders""")
def completeness_score(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a record's fields, samples, counters and cost."""
    key = F.col("o_orderkey")
    some = lambda n, c: F.when(key % n == 0, c)
    rows = P.table(spark, d, "orders").select(
        key.alias("message_id"), some(2, F.lit("p")).alias("parent_id"), some(3, F.lit("x")).alias("model"), some(5, F.lit(1.0)).alias("first_token"), F.lit(9.0).alias("completed"), some(7, F.lit(0.0)).alias("ttft"), F.lit(None).cast("double").alias("duration"),
        F.when(key % 13 > 0, F.sequence(F.lit(1).cast("long"), key % 13)).otherwise(F.array().cast("array<long>")).alias("samples"), (F.col("o_custkey") % 3).cast("double").alias("input"), F.col("o_totalprice").alias("output"), F.lit(0.0).alias("reasoning"), F.col("o_totalprice").alias("cost"),
    )
    return rows.select("message_id", precedence.completeness(rows.columns).cast("long").alias("score"))


# --- layers and windows over sources


def layered(spark: SparkSession, d: str) -> DataFrame:
    """Stored copies of all responses and optimistic ones of some, without updates but for every thirteenth."""
    none = F.lit(None).cast(UPDATE_STRUCT)
    live = F.struct(F.lit("i").alias("instance"), F.lit(9.0).alias("sequence"), F.lit(9.0).alias("received_at"), F.lit(None).cast("double").alias("revision"), F.lit("f").alias("fingerprint"), F.array().cast("array<string>").alias("seen")).cast(UPDATE_STRUCT)
    zero = F.lit(0).cast("long")
    base = P.responses(spark, d).filter("pos = 0").withColumns({"agent": F.lit("build"), "update": none, "layer": F.lit("disk"), "input": zero, "reasoning": zero, "cache_read": zero, "cache_write": zero})
    more = base.filter("message_id % 3 = 0 or message_id % 13 = 0").withColumns({
        "layer": F.lit("optimistic"), "agent": F.lit(None).cast("string"), "quality": F.when(F.col("message_id") % 2 == 0, "exact").otherwise("provisional"),
        "output": F.col("output") + F.when(F.col("message_id") % 5 == 0, F.lit(7)).otherwise(F.lit(-1)), "update": F.when(F.col("message_id") % 13 == 0, live), "pos": F.lit(1).cast("long"),
    })
    return base.unionByName(more)


@query(f"""WITH {P.RESPONSES} SELECT message_id, output + CASE WHEN message_id % 2 = 0 AND (message_id % 13 = 0 OR message_id % 3 = 0 AND message_id % 5 = 0) THEN CASE WHEN message_id % 5 = 0 THEN 7 ELSE -1 END ELSE 0 END AS output,
  'build' AS agent FROM responses WHERE pos = 0""")
def layer_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stored and optimistic records: an update of the same quality wins, else quality, then volume; the agent stays."""
    return layers.merged_layers(layered(spark, d)).select("message_id", "output", "agent")


@query(f"WITH {P.RESPONSES}, {P.PREFERRED} SELECT message_id, session_id, completed FROM preferred ORDER BY completed DESC, message_id DESC LIMIT 100")
def history_window(spark: SparkSession, d: str) -> DataFrame:
    """The last records of two sources that share some, each message once."""
    rows = P.responses(spark, d)
    both = rows.filter("message_id % 2 = 0 or message_id % 5 = 0").unionByName(rows.filter("message_id % 2 = 1"))
    return layers.window_of(precedence.preferred(both), 100).select("message_id", "session_id", "completed")


@query("""SELECT o_orderkey AS message_id, CASE WHEN o_custkey % 4 = 0 THEN 'none' WHEN o_custkey % 4 = 1 THEN 'known' ELSE 'named' END AS parent_id FROM orders""")
def parent_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """A known parent, or knowing that there is none, overrides what a record names."""
    records = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("message_id"), F.col("o_custkey").alias("session_id"), F.lit("named").alias("parent_id"))
    known = P.table(spark, d, "customer").filter("c_custkey % 4 < 2").select(F.col("c_custkey").alias("child"), F.when(F.col("c_custkey") % 4 == 1, "known").alias("parent"))
    return layers.with_parents(records, known).select("message_id", F.coalesce("parent_id", F.lit("none")).alias("parent_id"))


@query("""WITH w AS (SELECT o_custkey AS id, CASE WHEN c % 11 > 0 THEN 'p' || c % 3 END AS parent, CASE o_orderstatus WHEN 'F' THEN 'canonical' WHEN 'O' THEN 'live' ELSE 'cache' END AS origin, 'e' || o_orderkey % 2 AS epoch,
  CASE WHEN o_orderkey % 10 > 0 THEN c % 6 END AS seq, o_orderkey AS pos FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS c FROM orders)),
one AS (SELECT id, origin, parent, epoch, seq FROM w QUALIFY row_number() OVER (PARTITION BY id, origin ORDER BY CASE WHEN origin = 'live' THEN coalesce(seq, -1) END DESC, pos DESC) = 1),
top AS (SELECT id, parent FROM w WHERE origin = 'live' QUALIFY coalesce(seq, -1) = max(coalesce(seq, -1)) OVER (PARTITION BY id, epoch)),
odds AS (SELECT id, count(DISTINCT coalesce(parent, '')) > 1 AS odd FROM top GROUP BY id),
x AS (SELECT i.id, c.id IS NOT NULL AS has_c, l.id IS NOT NULL AS has_l, c.parent AS cp, l.parent AS lp, h.parent AS hp, coalesce(odd, false) AS odd, c.id IS NOT NULL AND l.id IS NOT NULL AND c.parent IS DISTINCT FROM l.parent AS differ,
  coalesce(c.epoch = l.epoch AND c.seq IS NOT NULL AND l.seq IS NOT NULL, false) AS comparable, coalesce(l.seq > c.seq, false) AS newer FROM (SELECT DISTINCT id FROM w) i
  LEFT JOIN (FROM one WHERE origin = 'canonical') c USING (id) LEFT JOIN (FROM one WHERE origin = 'live') l USING (id) LEFT JOIN (FROM one WHERE origin = 'cache') h USING (id) LEFT JOIN odds USING (id))
SELECT id, CASE WHEN differ AND comparable AND newer AND NOT odd THEN lp WHEN has_c THEN cp WHEN has_l THEN lp ELSE hp END AS parent, odd OR (differ AND NOT comparable) AS conflict FROM x""")
def parent_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Orders as witnesses of their customer's parent: of three origins and two epochs, with sequences or without, at odds or not."""
    c, key, status = F.round(F.col("o_totalprice") * 100).cast("long"), F.col("o_orderkey"), F.col("o_orderstatus")
    rows = P.table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), F.when(c % 11 > 0, F.concat(F.lit("p"), (c % 3).cast("string"))).alias("parent"), F.when(status == "F", "canonical").when(status == "O", "live").otherwise("cache").alias("origin"),
        F.concat(F.lit("e"), (key % 2).cast("string")).alias("epoch"), F.when(key % 10 > 0, c % 6).alias("sequence"), key.alias("pos"),
    )
    return layers.parent_evidence(rows)


@query(f"""WITH {P.RESPONSES}, r AS (SELECT * FROM responses WHERE pos = 0), gone AS (SELECT message_id FROM r WHERE message_id % 9 = 0 OR message_id % 10 = 0)
SELECT session_id, sum(CASE WHEN message_id IN (SELECT message_id FROM gone) THEN 0 ELSE output END)::BIGINT AS output FROM r GROUP BY session_id""")
def reader_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """What a ledger and the reader's own evidence exclude is taken out of a ledger's sums."""
    rows = P.responses(spark, d).filter("pos = 0").withColumn("excluded", F.lit(False))
    gone = layers.excluded_ids(rows.filter("message_id % 9 = 0"), rows.withColumn("excluded", F.col("message_id") % 10 == 0))
    return layers.without_messages(rows.groupBy("session_id").agg(F.sum("output").alias("output")), rows, gone, ["output"])


@query("""SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 5 = 0 THEN 'provisional' WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'exact' ELSE 'provisional' END AS quality FROM orders""")
def quality_inference(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = P.table(spark, d, "orders").select(key.alias("message_id"), F.when(key % 5 == 0, "provisional").alias("quality"), F.when(key % 2 == 0, F.lit(1.0)).alias("first_token"), F.when(key % 3 == 0, F.lit(1.0)).alias("ttft"), F.when(key % 7 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("samples"))
    return rows.select("message_id", layers.inferred_quality().alias("quality"))


@query("""SELECT l_orderkey AS message_id, arg_max(l_quantity, pos) AS input, arg_max(l_tax, pos) FILTER (l_tax > 0.02) AS output, max(l_discount) AS cache_read FROM
(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_discount) AS pos FROM lineitem) GROUP BY 1""")
def fallback_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Reports of one message: the last input and output that are given, the greatest cache."""
    at = Window.partitionBy("message_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")
    rows = P.table(spark, d, "lineitem").withColumn("message_id", F.col("l_orderkey")).withColumn("pos", F.row_number().over(at))
    none = F.lit(None).cast("double")
    rows = rows.select("message_id", "pos", F.col("l_quantity").alias("input"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("output"), none.alias("reasoning"), F.col("l_discount").alias("cache_read"), none.alias("cache_write"))
    return layers.fallback_tokens(rows).select("message_id", "input", "output", "cache_read")


@query("""SELECT c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN 'excluded_session' WHEN c_custkey % 3 = 1 THEN 'user' ELSE 'pending' END AS scope, CASE WHEN c_custkey % 2 = 0 THEN 'build,plan' ELSE 'build' END AS agents FROM customer""")
def metadata_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch of session metadata laid over what a ledger knows: scopes only grow stronger, agents are joined."""
    ids = P.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), F.col("c_custkey").alias("k"))
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    known = ids.select("session_id", F.when(F.col("k") % 3 == 0, "excluded_session").otherwise("pending").alias("scope"), empty.alias("reasons"), none.alias("parent"), F.array(F.lit("build")).alias("agents"))
    updates = ids.select("session_id", F.col("k").alias("pos"), F.when(F.col("k") % 3 == 1, USER).otherwise(PENDING).alias("scope"), empty.alias("reasons"), none.alias("parent"), F.when(F.col("k") % 2 == 0, F.array(F.lit("plan"))).alias("agents"))
    return scope.metadata_batch(known, updates).select(F.col("session_id").cast("long").alias("session_id"), "scope", F.array_join("agents", ",").alias("agents"))


REASONS = f"[{', '.join(map(repr, metrics.COVERAGE_REASONS))}]"


@query(f"""WITH e AS (SELECT event_id AS id, user_id % 4 AS k, round(value * 100)::BIGINT AS c FROM events),
given AS (SELECT id, i, {REASONS}[(c + i * i * (1 + c % 5)) % 60 + 1] AS reason FROM (SELECT id, c, unnest(range(c % 90)) AS i FROM e) WHERE i < 64),
once AS (SELECT id, reason, min(i) AS i FROM given WHERE reason IS NOT NULL GROUP BY id, reason),
eight AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM once),
named AS (SELECT id, string_agg(reason, ',' ORDER BY i) AS reasons FROM eight WHERE n <= 8 GROUP BY id)
SELECT id, CASE WHEN k = 1 THEN 'complete:' ELSE CASE WHEN k = 2 THEN 'gap:' ELSE 'unknown:' END || coalesce(reasons, 'unknown-coverage') END AS coverage FROM e LEFT JOIN named USING (id) WHERE k > 0""")
def coverage_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why no generation rate was measured: of the first 64 reasons the first eight known ones, once each; one at least unless coverage is complete."""
    c, k = F.col("c"), F.col("k")
    names = F.array(*map(F.lit, metrics.COVERAGE_REASONS))
    status = F.when(k == 0, "odd").when(k == 1, "complete").when(k == 2, "gap").otherwise("unknown")
    place = lambda i: ((c + i * i * (1 + c % 5)) % 60).cast("int")
    reason = lambda i: F.when(place(i) < F.size(names), F.get(names, place(i))).otherwise("no reason")
    reasons = F.when(c % 90 > 0, F.transform(F.sequence(F.lit(0).cast("long"), c % 90 - 1), reason)).otherwise(F.array().cast("array<string>"))
    rows = P.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("k"), F.round(F.col("value") * 100).cast("long").alias("c"))
    rows = rows.select("id", metrics.coverage(status, reasons).alias("c")).filter("c is not null")
    return rows.select("id", F.concat(F.col("c.status"), F.lit(":"), F.array_join("c.reasons", ",")).alias("coverage"))


TIMES = """t AS (SELECT o_orderkey AS id, (c % 50)::DOUBLE AS start, CASE WHEN c % 7 > 0 THEN c % 50 + 100 + c % 40 END::DOUBLE AS completed, CASE WHEN c % 3 > 0 THEN c // 7 % 220 END::DOUBLE AS prior,
  CASE WHEN c % 4 <> 1 THEN c // 11 % 220 END::DOUBLE AS content, CASE WHEN c % 5 <> 1 THEN c // 13 % 220 END::DOUBLE AS token, (c // 17 % 220)::DOUBLE AS sig FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders))"""


@query(f"""WITH {TIMES}, fit AS (SELECT *, sig >= start AND (completed IS NULL OR sig <= completed) AS taken FROM t),
known AS (SELECT id, prior AS ms, 0 AS place, 'prior' AS source FROM fit UNION ALL SELECT id, content, 1, 'content' FROM fit UNION ALL SELECT id, token, 1, 'content' FROM fit UNION ALL SELECT id, sig, 2, 'thinking' FROM fit),
first AS (SELECT id, min(ms) AS ms, arg_min(source, (ms, place)) AS source FROM known JOIN t USING (id) WHERE ms >= start AND (completed IS NULL OR ms <= completed) GROUP BY id)
SELECT fit.id AS message_id, CASE WHEN taken THEN first.ms ELSE prior END AS first_response, CASE WHEN taken THEN first.source WHEN prior IS NOT NULL THEN 'prior' END AS source FROM fit LEFT JOIN first USING (id)""")
def first_response_merge(spark: SparkSession, d: str) -> DataFrame:
    """The earliest of what was known, the output and a signal, in this order at equal times, each within the response's time; a signal
    outside it changes nothing."""
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    over = lambda n: F.floor(c / n) % 220
    t = {
        "start": c % 50, "completed": F.when(c % 7 > 0, c % 50 + 100 + c % 40), "first_response": F.when(c % 3 > 0, over(7)), "first_content": F.when(c % 4 != 1, over(11)), "first_token": F.when(c % 5 != 1, over(13)),
    }
    signal = F.struct(over(17).cast("double").alias("at"), F.lit("thinking").alias("source"), F.lit("part-start").alias("time_source"), F.lit(False).alias("estimated"))
    rows = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("message_id"), *(x.cast("double").alias(n) for n, x in t.items()), signal.alias("signal"))
    rows = rows.withColumns({"first_response_source": F.when(F.col("first_response").isNotNull(), "prior"), "first_response_time_source": F.lit("arrival"), "first_response_estimated": F.lit(True)})
    return rows.select("message_id", metrics.first_response().alias("f")).select("message_id", "f.first_response", "f.source")


@query("SELECT user_id AS message_id, max(event_type = 'error') AS tainted, CASE WHEN max(event_type = 'error') THEN 'failed' ELSE '' END AS reasons FROM events GROUP BY 1")
def response_taint(spark: SparkSession, d: str) -> DataFrame:
    rows = P.table(spark, d, "events").select(F.col("user_id").alias("message_id"), F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("kind"))
    return layers.tainted(rows).select("message_id", "tainted", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT o_custkey AS session_id, CASE WHEN bool_and(coalesce(CASE WHEN o_orderkey % 7 > 0 THEN 2 + o_shown END = 3, false)) THEN sum(c) ELSE 0 END::BIGINT AS tokens, sum(c)::BIGINT AS response
FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS c, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS o_shown FROM orders) GROUP BY 1""")
def generation_epoch(spark: SparkSession, d: str) -> DataFrame:
    """Generation sums of an older basis, or of none, start again, the response's stay; a session's basis is the lowest of its orders'."""
    basis = F.when(F.col("o_orderkey") % 7 > 0, F.when(F.col("o_orderstatus") == "P", 2).otherwise(3))
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = P.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.sum(c).alias("tokens"), F.sum(c).alias("response"), F.min(F.coalesce(basis, F.lit(0))).alias("basis"))
    return metrics.of_basis(rows.withColumn("basis", F.when(F.col("basis") > 0, F.col("basis"))), ["tokens"]).drop("basis")


@query("SELECT l_orderkey AS session_id, arg_min('a' || l_partkey, (l_linenumber, l_partkey)) AS agent FROM lineitem WHERE l_linenumber % 2 = 0 AND l_returnflag <> 'R' GROUP BY 1")
def session_agents(spark: SparkSession, d: str) -> DataFrame:
    """The first agent of entities that are the session itself and no message."""
    rows = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).alias("id"), F.when(F.col("l_returnflag") == "R", "assistant").alias("role"), F.concat(F.lit(" a"), F.col("l_partkey").cast("string")).alias("agent"), F.struct("l_linenumber", "l_partkey").alias("pos"))
    return layers.session_agent(rows)


# --- clocks, runs and gaps


@query(f"""WITH {P.FACTS}, x AS (SELECT *, 'x' || (event_id % 3) AS execution, false AS latch FROM facts),
b AS (SELECT session_id, instance_id, execution, min(CASE WHEN state IN ('busy', 'retry') THEN ts * 1000000 + seq END) AS began FROM x GROUP BY ALL), l AS (SELECT * FROM b QUALIFY began = max(began) OVER (PARTITION BY session_id, instance_id)),
t AS (SELECT *, lead(ts) OVER (PARTITION BY session_id, instance_id, execution ORDER BY ts, seq) AS next, max(CASE WHEN state IN ('completed', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, instance_id, execution ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM x),
active AS (SELECT t.session_id, ts AS start, coalesce(next, CASE WHEN instance_id = 0 AND l.execution IS NOT NULL THEN 1800000000000 END) AS "end" FROM t LEFT JOIN l USING (session_id, instance_id, execution) WHERE state IN ('busy', 'retry') AND coalesce(done, 0) = 0),
a AS (SELECT * FROM active WHERE "end" > start), {union_sql('a', 'session_id')} SELECT session_id, count(*)::BIGINT AS n, sum("end" - start)::BIGINT AS length FROM u GROUP BY session_id""")
def latest_execution(spark: SparkSession, d: str) -> DataFrame:
    """Live time: only the latest execution of a trusted instance goes on to the clock's time."""
    facts = P.facts(spark, d, 3)
    trusted = facts.filter("instance_id = 0").select("instance_id")
    return measured(intervals.union(activity.lifecycle_intervals(facts, None, 1.8e12, trusted), ["session_id"]))


@query(f"""WITH RECURSIVE {P.FACTS}, {P.SHALLOW}, {IDS}, {CLOSURE}, l AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY session_id, instance_id ORDER BY ts DESC, seq DESC) = 1),
own AS (SELECT session_id, max(state IN ('busy', 'retry') AND instance_id = 0) AS live FROM l GROUP BY 1) SELECT c.ancestor AS id, max(coalesce(own.live, false)) AS live FROM closure c LEFT JOIN own ON own.session_id = c.id GROUP BY 1""")
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with an open stream of the trusted instance at or below them."""
    facts = P.facts(spark, d)
    return activity.is_live(facts, facts.filter("instance_id = 0").select("instance_id"), P.shallow_links(spark, d))


RUNS = f"""{P.FACTS}, a AS (SELECT *, state IN ('busy', 'retry') AS active, coalesce(lag(state IN ('busy', 'retry')) OVER (PARTITION BY session_id ORDER BY ts, seq), false) AS was FROM facts),
e AS (SELECT *, sum(CASE WHEN active AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS epoch FROM a),
runs AS (SELECT session_id, epoch::BIGINT AS epoch, min(ts) AS start, max(CASE WHEN NOT active THEN ts END) AS "end" FROM e WHERE epoch > 0 AND (active OR was) GROUP BY session_id, epoch),
calls AS (SELECT user_id AS session_id, event_id AS message_id, epoch_us(ts) // 1000 + 1 AS start, epoch_us(ts) // 1000 + 1 + event_id % 100 AS completed, (value * 100)::BIGINT AS output FROM events),
placed AS (SELECT c.*, coalesce((SELECT max(r.epoch) FROM runs r WHERE r.session_id = c.session_id AND r.start <= c.start), 0) AS epoch FROM calls c)"""


def calls_of(spark: SparkSession, d: str) -> DataFrame:
    at = P.millis("ts") + 1
    rows = P.table(spark, d, "events")
    return rows.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("message_id"), at.alias("start"), (at + F.col("event_id") % 100).alias("completed"), F.round(F.col("value") * 100).cast("long").alias("output"), F.col("event_id").alias("pos"))


@query(f"""WITH {RUNS} SELECT session_id, epoch, count(*)::BIGINT AS calls, sum(output)::BIGINT AS output, min(placed.start) AS started, any_value(runs.start) AS run_start, any_value("end") AS run_end FROM placed JOIN runs USING (session_id, epoch) WHERE "end" IS NOT NULL GROUP BY session_id, epoch""")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the runs that are over used: each response counts in the run that began last before it."""
    epochs = activity.run_epochs(P.facts(spark, d))
    return runs.summaries(runs.with_epoch(calls_of(spark, d), epochs), epochs, ["output"])


@query(f"WITH {RUNS} SELECT session_id, arg_max(message_id, (epoch, completed, message_id)) AS message_id, max(epoch) AS epoch FROM placed GROUP BY 1")
def last_completed(spark: SparkSession, d: str) -> DataFrame:
    return runs.last_completed(runs.with_epoch(calls_of(spark, d), activity.run_epochs(P.facts(spark, d))))


@query(f"""WITH {P.FACTS}, g AS (SELECT session_id, instance_id, max(ts) - 1000000 AS at FROM facts GROUP BY 1, 2), n AS (SELECT f.*, CASE WHEN f.ts > g.at THEN 1 ELSE 0 END AS no FROM facts f JOIN g USING (session_id, instance_id)),
l AS (SELECT * FROM n WHERE no = 0 QUALIFY row_number() OVER (PARTITION BY session_id, instance_id ORDER BY ts DESC, seq DESC) = 1),
o AS (SELECT session_id, instance_id, no, state FROM n UNION ALL SELECT session_id, instance_id, no, 'stopped' FROM l WHERE state IN ('busy', 'retry'))
SELECT session_id, instance_id || CASE WHEN no > 0 THEN '#1' ELSE '' END AS instance_id, count(*)::BIGINT AS facts, count(*) FILTER (state = 'stopped') AS stopped FROM o GROUP BY 1, 2""")
def gap_split(spark: SparkSession, d: str) -> DataFrame:
    """A gap in transport ends an instance at its last fact, and what follows belongs to a new one."""
    facts = P.facts(spark, d)
    gaps = facts.groupBy("session_id", "instance_id").agg((F.max("ts") - 1_000_000).alias("at"))
    out = activity.split_at_gaps(facts, gaps)
    return out.groupBy("session_id", "instance_id").agg(F.count("*").alias("facts"), F.count(F.when(F.col("state") == "stopped", 1)).alias("stopped"))


@query(f"""WITH RECURSIVE {P.SHALLOW}, {IDS}, {CLOSURE}, gone AS (SELECT DISTINCT id FROM closure WHERE ancestor IN (3, 11)) SELECT event_id AS message_id FROM events
WHERE user_id NOT IN (SELECT id FROM gone) AND user_id % 17 NOT IN (SELECT id FROM gone) AND event_id % 6 <> 0""")
def record_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Records that neither their own scope nor an excluded session or named parent removes."""
    links = P.shallow_links(spark, d)
    evidence = links.select(F.col("child").alias("session_id"), F.when(F.col("child").isin(3, 11), "excluded_session").otherwise(PENDING).alias("scope"))
    records = P.table(spark, d, "events").select(F.col("event_id").alias("message_id"), F.col("user_id").alias("session_id"), (F.col("user_id") % 17).alias("parent_id"), F.when(F.col("event_id") % 6 == 0, "excluded_item").alias("scope"))
    return scope.eligible_records(records, links, evidence).select("message_id")


@query(f"""WITH RECURSIVE {P.SHALLOW}, depth(id, rank) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT l.child, d.rank + 1 FROM links l JOIN depth d ON l.parent = d.id WHERE l.child <> l.parent) SELECT l.child, l.parent, d.rank FROM links l JOIN depth d ON d.id = l.parent WHERE l.child <> l.parent""")
def dependency_order(spark: SparkSession, d: str) -> DataFrame:
    """Links with a rank by which parents come before their children."""
    return forest.ordered_edges(P.shallow_links(spark, d))


@query(f"""WITH {P.FACTS}, r AS (SELECT user_id AS session_id, event_id AS message_id, (epoch_us(ts) // 1000)::DOUBLE AS start FROM events),
c AS (SELECT r.message_id, min(f.ts)::DOUBLE AS completed FROM r JOIN facts f ON f.session_id = r.session_id AND f.ts >= r.start AND f.state NOT IN ('busy', 'retry') GROUP BY 1) SELECT message_id, 'provisional' AS quality, completed FROM c""")
def idle_flush(spark: SparkSession, d: str) -> DataFrame:
    """Unfinished responses end with their session's next inactive fact, as provisional ones."""
    none = F.lit(None).cast("string")
    open_ = P.table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("message_id"), P.millis("ts").cast("double").alias("start"), none.alias("quality"), F.lit(None).cast("double").alias("completed"))
    facts = P.facts(spark, d).withColumn("ts", F.col("ts").cast("double"))
    return hosts.idle_provisional(open_, facts).select("message_id", "quality", "completed")




@query(f"""WITH {P.RESPONSES}, {P.PREFERRED}, {P.REGIONS}, own AS (SELECT session_id AS id, count(*)::BIGINT AS calls, sum(output)::BIGINT AS total, arg_max(model, (completed, pos, model)) AS model FROM preferred GROUP BY 1),
n AS (SELECT DISTINCT 'n' || c_nationkey AS id FROM customer JOIN own ON own.id = 'c' || c_custkey WHERE own.total > 0), sets AS (SELECT session_id AS id, CASE WHEN max(message_id % 2) = 1 AND min(message_id % 2) = 0 THEN 'build,plan' WHEN max(message_id % 2) = 1 THEN 'plan' ELSE 'build' END AS agents FROM preferred GROUP BY 1)
SELECT 'r' || n_regionkey AS root, own.id, 1::INT AS depth, calls, total AS generated, total, agents, model FROM own JOIN sets USING (id) JOIN customer ON own.id = 'c' || c_custkey JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'r' || n_regionkey, n.id, 0::INT, 0, 0, 0, '', '-' FROM n JOIN nation ON n.id = 'n' || n_nationkey""")
def child_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions below a root with what they used, their agents and latest model; depth counts shown ones only."""
    zero = F.lit(0).cast("long")
    rows = precedence.preferred(P.responses(spark, d)).withColumns({"input": zero, "reasoning": zero, "cache_read": zero, "cache_write": zero, "agent": F.when(F.col("message_id") % 2 == 1, "plan").otherwise("build")})
    return metrics.child_rows(rows, P.region_links(spark, d)).withColumn("agents", F.array_join("agents", ","))


@query(f"""WITH {P.RESPONSES}, {P.PREFERRED} SELECT message_id, session_id, completed FROM preferred JOIN customer ON session_id = 'c' || c_custkey WHERE c_nationkey IN (3, 8) ORDER BY completed DESC, pos DESC, message_id LIMIT 24""")
def recent_of_tree(spark: SparkSession, d: str) -> DataFrame:
    """The last responses of two nodes and all below them."""
    selected = P.table(spark, d, "nation").filter("n_nationkey in (3, 8)").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    below = forest.family(P.region_links(spark, d), selected)
    return metrics.recent(precedence.preferred(P.responses(spark, d)), 24, below).select("message_id", "session_id", "completed")


@query(f"""WITH {PLAIN}, t AS (SELECT session_id // 40 AS root, start, "end" FROM active), {union_sql('t', 'root')} SELECT root, row_number() OVER (PARTITION BY root ORDER BY start) AS epoch, start, "end" FROM u""")
def tree_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of whole trees: sessions that are active at once, or one right after another, are one run."""
    active = activity.lifecycle_intervals(P.facts(spark, d))
    roots = P.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct().withColumn("root", F.expr("id div 40"))
    return runs.of_trees(active, roots).withColumn("end", F.col("end").cast("long"))


@query(f"""WITH {P.RESPONSES}, r AS (SELECT * FROM responses WHERE pos = 0) SELECT message_id, output, message_id % 9 = 0 AS excluded, CASE WHEN message_id % 9 = 0 THEN 'message-agent,message-mode' ELSE '' END AS proof FROM r
UNION ALL SELECT -1 - c_custkey, 0, true, 'message-agent,message-mode' FROM customer WHERE c_custkey % 9 = 0""")
def exclusion_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Contributions that evidence takes back keep their amounts and the proof; evidence on unknown messages stands for itself."""
    rows = P.responses(spark, d).filter("pos = 0").withColumn("excluded", F.lit(False))
    proof = rows.filter("message_id % 9 = 0").select("message_id").unionByName(P.table(spark, d, "customer").filter("c_custkey % 9 = 0").select((-1 - F.col("c_custkey")).alias("message_id")))
    twice = proof.withColumn("reasons", F.array(F.lit("message-mode"))).unionByName(proof.withColumn("reasons", F.array(F.lit("message-agent"), F.lit("message-mode"))))
    held, unknown = ledger.tombstones(rows, twice)
    known = held.select("message_id", "output", "excluded", F.coalesce(F.array_join("proof", ","), F.lit("")).alias("proof"))
    return known.unionByName(unknown.select("message_id", F.lit(0).cast("long").alias("output"), F.lit(True).alias("excluded"), F.array_join("reasons", ",").alias("proof")))


# --- what was observed of responses

#: How the observation of a message departs from a clean one, by a number from 0 to 19.
DEFECTS = 20


def observations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Assistant messages as streams of deltas of 16 characters, a fixed time apart, with a final snapshot; 19 kinds of defects."""
    said = spread(P.table(spark, d, "conversations")).filter("role = 'assistant'")
    text, way = F.coalesce("text", F.lit("")), (F.col("conv_id") * 7 + F.col("turn")) % DEFECTS
    rows = said.select(
        F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("message_id"), text.alias("t"), way.alias("way"),
        (F.col("conv_id") % 7 * 20 + 10).cast("double").alias("step"), F.ceil(F.length(text) / 16).cast("int").alias("n"),
    )
    way, n = F.col("way"), F.col("n")
    none = {f.name: F.lit(None).cast(f.dataType) for f in spark.createDataFrame([], content.OBSERVATION).schema}

    def seen(rows: DataFrame, **values: Column) -> DataFrame:
        return rows.select(*((F.col("message_id") if c == "message_id" else values.get(c, empty).cast(empty_type)).alias(c) for c, empty, empty_type in ((c, none[c], t) for c, t in KINDS)))

    KINDS = [(f.name, f.dataType) for f in spark.createDataFrame([], content.OBSERVATION).schema]
    lit = F.lit
    begin = seen(rows.filter(way != 17), pos=lit(0), kind=lit("begin"), from_start=way != 4)
    step = seen(rows.filter(way != 17), pos=lit(1), kind=lit("step"), step_id=F.when(way == 19, " ").otherwise("s"))
    second = seen(rows.filter(way == 3), pos=lit(2), kind=lit("step"), step_id=lit("t"))
    taint = seen(rows.filter(way == 5), pos=lit(3), kind=lit("taint"), reason=lit("retry"))
    cut = rows.filter((n > 0) & (way != 17)).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).filter((way != 1) | (F.col("k") < n - 1))
    back = (way == 14) & (F.col("k") == n - 1)
    mono = F.when(back, 0.0).otherwise(F.col("k") * F.col("step"))
    delta = seen(
        cut, pos=F.col("k") + 10, kind=lit("delta"), part_id=F.when((way != 13) | (F.col("k") > 0), "p"), part_type=lit("text"), text=F.substring("t", F.col("k") * 16 + 1, F.lit(16)),
        stream=F.when((way == 15) & (F.col("k") % 2 == 1), "legacy").otherwise("v2"), event_id=F.concat(lit("e"), F.col("k").cast("string")), received_at=mono + 1e6, received_mono=mono,
        clock_source=F.when(way != 11, "performance.now"), clock_resolution_ms=lit(1.0),
    )
    again = delta.join(rows.filter(way == 16).select("message_id"), "message_id", "left_semi").withColumn("pos", F.col("pos") + 100_000)
    shown = F.when(way == 2, F.expr("substring(t, 1, length(t) - 1)")).otherwise(F.col("t"))
    snapshot = seen(rows.filter(way != 17), pos=lit(1_000_000), kind=lit("snapshot"), part_id=lit("p"), part_type=lit("text"), text=shown, final=way != 10)
    tool = seen(rows.filter(way == 9), pos=lit(4), kind=lit("snapshot"), part_id=lit("q"), part_type=lit("tool"))
    told = begin
    for more in (step, second, taint, delta, again, snapshot, tool):
        told = told.unionByName(more)
    responses = rows.select(
        "message_id", (F.length("t") % 50 + 100).cast("double").alias("output"), F.when(way == 12, 5.0).otherwise(0.0).alias("reasoning"), F.when(way != 8, 1e9).alias("completed"),
        (way != 6).alias("usage_exact"), (way != 7).alias("reasoning_known"),
    )
    return told, responses


PROOFS = r"""c AS (SELECT 'm' || conv_id || '-' || turn AS message_id, coalesce(text, '') AS t, (conv_id * 7 + turn) % 20 AS way, (conv_id % 7 * 20 + 10)::DOUBLE AS step,
  ceil(length(coalesce(text, '')) / 16)::INT AS n FROM conversations WHERE role = 'assistant'),
s AS (SELECT *, CASE way WHEN 1 THEN greatest(n - 1, 0) ELSE n END AS sent, CASE WHEN way = 14 AND n > 2 THEN 1 ELSE 0 END AS late, length(t) % 50 + 100 AS usage FROM c),
p AS (SELECT *, (CASE WHEN way = 14 AND n > 0 THEN greatest(n - 2, 0) ELSE greatest(sent - 1, 0) END) * step AS span FROM s),
r AS (SELECT *, CASE
  WHEN way = 17 THEN ['missing-content-observation']
  WHEN way = 3 THEN ['multiple-step-identities'] WHEN way = 4 AND sent > 0 THEN ['not-observed-from-current-start'] WHEN way = 5 THEN ['retry'] WHEN way = 9 THEN ['tool-usage-uncertain']
  WHEN way = 13 AND sent > 0 THEN ['anonymous-delta', 'anonymous-or-tool-arrival'] WHEN late = 1 THEN ['nonmonotonic-receive-clock'] WHEN way = 15 AND sent > 1 THEN ['mixed-streams'] WHEN way = 19 THEN ['unknown-step-identity']
  WHEN way = 4 THEN ['not-observed-from-current-start'] WHEN way = 6 THEN ['unknown-final-usage'] WHEN way = 7 THEN ['unknown-reasoning-usage'] WHEN way = 8 THEN ['unfinished-response']
  WHEN way = 10 THEN ['missing-comparable-final-snapshot'] WHEN way = 1 AND n > 0 THEN ['snapshot-delta-gap']
  WHEN way = 2 AND n > 0 AND NOT regexp_matches(right(t, 1), '\s') THEN ['snapshot-delta-mismatch'] WHEN sent = 0 THEN ['missing-receive-observations']
  WHEN span < 100 THEN ['insufficient-receive-span'] WHEN span < 1000 AND way = 11 THEN ['unknown-receive-clock'] WHEN way = 12 THEN ['hidden-reasoning'] END AS why FROM p)"""


@query(f"""WITH {PROOFS} SELECT message_id, CASE WHEN why IS NULL THEN 'complete' WHEN why[1] LIKE 'snapshot-delta%' THEN 'gap' ELSE 'unknown' END AS status, array_to_string(coalesce(why, []), ',') AS reasons,
  CASE WHEN why IS NULL THEN round(usage * ((strlen(t) - strlen(left(t, 16))) / strlen(t)), 6) END AS tokens, CASE WHEN why IS NULL THEN span END AS ms FROM r""")
def generation_proof(spark: SparkSession, d: str) -> DataFrame:
    """What the observation of each response proves: the first condition that fails names the rejection."""
    told, responses = observations(spark, d)
    judged = content.proof(content.progress(told), responses).withColumn("m", metrics.interval_measure())
    return judged.select("message_id", "coverage.status", F.array_join("coverage.reasons", ",").alias("reasons"), F.round("m.tokens", 6).alias("tokens"), F.col("m.ms").alias("ms"))


@query(f"""WITH {PROOFS} SELECT message_id, why IS NULL AS available, CASE WHEN why IS NULL THEN round(usage * ((strlen(t) - strlen(left(t, 16))) / strlen(t)) * 1000 / span, 6) END AS rate, round((usage + CASE WHEN way = 12 THEN 5 ELSE 0 END) * 1000 / 4000, 6) AS response_rate,
  CASE WHEN why IS NOT NULL THEN array_to_string(why, ',') END AS why FROM r WHERE way <> 8""")
def record_speed(spark: SparkSession, d: str) -> DataFrame:
    """Speeds of records as they are measured: the generation by its proof, the response by its whole time, and the rate that is shown."""
    told, responses = observations(spark, d)
    proofs = content.proof(content.progress(told), responses)
    rows = responses.filter("completed is not null").join(proofs, "message_id").withColumns({"start": F.col("completed") - 4000, "timing_exact": F.lit(True)})
    shown = speed.primary_rate(speed.coerced(speed.measured(rows)))
    response = F.col("speed.response.tokens") * 1000 / F.col("speed.response.ms")
    why = F.when(~F.col("available"), F.array_join("speed.coverage.reasons", ","))
    return shown.select("message_id", "available", F.round("rate", 6).alias("rate"), F.round(response, 6).alias("response_rate"), why.alias("why"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS way, o_custkey % 40 + 1 AS u, 1000 + o_custkey % 3000 AS ms FROM orders),
f AS (SELECT *, CASE way WHEN 1 THEN 3 * u ELSE u END AS output, CASE way WHEN 2 THEN 4 ELSE 0 END AS reasoning FROM o)
SELECT id, CASE WHEN way IN (2, 3, 4, 6) THEN NULL WHEN way = 5 THEN (u * 0.5)::DOUBLE ELSE (output * 0.75)::DOUBLE END AS tokens, CASE WHEN way IN (2, 3, 4, 6) THEN NULL ELSE ms::DOUBLE END AS ms,
  CASE way WHEN 2 THEN 'hidden-reasoning' WHEN 3 THEN 'generation-invalidated' WHEN 6 THEN 'retry' END AS why FROM f""")
def speed_correction(spark: SparkSession, d: str) -> DataFrame:
    """Prior generations rescaled to corrected usage, revoked, replaced by new ones that hold, or dropped with the reason."""
    key, u = F.col("o_orderkey"), F.col("o_custkey") % 40 + 1
    way, ms, lit = key % 7, (1000 + F.col("o_custkey") % 3000).cast("double"), F.lit
    names = [f.split(":") for f in speed.EVIDENCE[7:-1].split(",")]
    held = {"version": lit(3), "coverage": lit("complete"), "from_start": lit(True), "time_source": lit("receive-monotonic"), "stream": lit("v2"), "step_id": lit("s"), "start": lit(0.0), "end": lit(1.0), "first_receive": lit(0.0), "last_receive": ms, "observations": lit(3),
            "output_bytes": lit(40), "output_first": lit(10), "output_usage": u, "output_observed": lit(True), "reasoning_bytes": lit(0), "reasoning_first": lit(0), "reasoning_usage": lit(0.0), "reasoning_observed": lit(False)}

    def made(first: int, share: float, fine: Column) -> Column:
        evidence = F.struct(*(({**held, "output_first": lit(first)}).get(n, lit(None)).cast(kind).alias(n) for n, kind in names))
        measure = F.struct((u * share).cast("double").alias("tokens"), ms.alias("ms"), lit(True).alias("estimated"), u.cast("double").alias("coverage"), lit("standard").alias("quality"))
        none = lit(None).cast(speed.COVERAGE)
        return F.when(fine, F.struct(measure.cast(speed.MEASURE).alias("generation"), lit(None).cast(speed.MEASURE).alias("response"), evidence.cast(speed.EVIDENCE).alias("evidence"), none.alias("coverage")))

    lost = F.struct(*(lit(None).cast(t).alias(n) for n, t in (("generation", speed.MEASURE), ("response", speed.MEASURE), ("evidence", speed.EVIDENCE))), F.struct(lit("gap").alias("status"), F.array(lit("retry")).alias("reasons")).alias("coverage"))
    rows = P.table(spark, d, "orders").select(
        key.alias("id"), F.when(way == 1, 3 * u).otherwise(u).cast("double").alias("output"), F.when(way == 2, 4.0).otherwise(0.0).alias("reasoning"), F.when(way != 4, 9.0).alias("completed"),
        made(20, 0.5, way == 5).alias("speed"), F.when(way == 6, lost).otherwise(made(10, 0.75, way != 6)).alias("prior"), F.when(way == 3, "invalidated").otherwise("unobserved").alias("generation_status"),
    )
    out = speed.corrected(speed.coerced(speed.coerced(rows), "prior"))
    return out.select("id", "speed.generation.tokens", "speed.generation.ms", F.array_join("speed.coverage.reasons", ",").alias("why"))


@query("""WITH e AS (SELECT *, 's' || (user_id % 500) AS session_id, CASE WHEN event_type <> 'view' THEN 'm' || user_id END AS message_id, event_type = 'error' AS completes FROM events),
d AS (SELECT *, coalesce(max(completes) OVER (PARTITION BY session_id, message_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM e),
n AS (SELECT *, coalesce(message_id, first_value(CASE WHEN NOT done THEN message_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS owner FROM d)
SELECT owner AS message_id, min(session_id) AS session_id, count(*)::BIGINT AS observations, count(*) FILTER (message_id IS NULL)::BIGINT AS taken, min(epoch_us(ts) // 1000)::DOUBLE AS start,
  arg_max(event_id, (message_id IS NOT NULL, event_id))::DOUBLE AS output, max(floor(value))::DOUBLE AS cache_read, coalesce(bool_and(event_id % 97 <> 0), false) AS from_start FROM n WHERE owner IS NOT NULL GROUP BY owner""")
def pending_names(spark: SparkSession, d: str) -> DataFrame:
    """Observations that came before their message had a name, merged into the message that is named next in the session."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = P.table(spark, d, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 500).cast("string")).alias("session_id"), F.when(F.col("event_type") != "view", F.concat(F.lit("m"), F.col("user_id").cast("string"))).alias("message_id"),
        F.col("event_id").alias("pos"), (F.col("event_type") == "error").alias("completes"), P.millis("ts").cast("double").alias("ts"), none("double").alias("first_token"), F.lit(True).alias("live"),
        (F.col("event_id") % 97 != 0).alias("from_start"), none("string").alias("model"), none("string").alias("agent"), none("double").alias("cost"), none("double").alias("input"),
        F.col("event_id").cast("double").alias("output"), none("double").alias("reasoning"), F.floor("value").cast("double").alias("cache_read"), none("double").alias("cache_write"),
    )
    return pending.merged(pending.named(rows)).select("message_id", "session_id", "observations", "taken", "start", "output", "cache_read", "from_start")


# --- logs and ledgers written and read again


@query("""SELECT CASE WHEN event_id % 3 = 0 THEN 'work' WHEN event_id % 3 = 1 THEN 'parent' ELSE 'lifecycle' END AS kind, event_id::VARCHAR AS event_id, 's' || user_id AS session_id, (epoch_us(ts) // 1000)::DOUBLE AS ts,
  CASE event_id % 3 WHEN 2 THEN 'busy' END AS state, CASE WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN 'p' || user_id % 9 END AS parent_id,
  CASE event_id % 5 WHEN 0 THEN 'excluded_session' WHEN 1 THEN 'excluded_item' WHEN 2 THEN 'pending' END AS scope, CASE WHEN event_id % 5 < 3 THEN 'session-title' END AS reasons, CASE WHEN event_id % 5 < 3 THEN 'q' || user_id END AS scope_parent,
  CASE WHEN event_id % 3 = 0 THEN CASE event_id % 2 WHEN 0 THEN 'user' ELSE 'excluded_item' END END AS measure, CASE WHEN event_id % 3 = 0 THEN 'w' || event_id END AS work_id FROM events""")
def activity_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Facts written as lines of a log and read again: evidence on facts and on work comes back whole."""
    n, s = F.col("event_id"), F.col("user_id").cast("string")
    kind = F.when(n % 3 == 0, "work").when(n % 3 == 1, "parent").otherwise("lifecycle")
    work = lambda c: F.when(n % 3 == 0, c)
    has = n % 5 < 3
    rows = P.table(spark, d, "events").select(
        kind.alias("kind"), n.cast("string").alias("event_id"), F.concat(F.lit("s"), s).alias("session_id"), P.millis("ts").cast("double").alias("ts"), F.when(n % 3 == 2, "busy").alias("state"),
        F.when((n % 3 == 1) & (n % 2 == 0), F.concat(F.lit("p"), (F.col("user_id") % 9).cast("string"))).alias("parent_id"), work(F.concat(F.lit("w"), n.cast("string"))).alias("work_id"),
        work(F.lit("x")).alias("execution_id"), work(F.lit("step")).alias("source"), work(F.lit("start")).alias("phase"), n.alias("pos"),
        F.when(n % 5 == 0, "excluded_session").when(n % 5 == 1, "excluded_item").when(n % 5 == 2, "pending").alias("scope"), F.when(has, F.array(F.lit("session-title"))).alias("scope_reasons"), F.when(has, F.concat(F.lit("q"), s)).alias("scope_parent"),
        work(F.when(n % 2 == 0, "user").otherwise("excluded_item")).alias("measure"), F.array().cast("array<string>").alias("measure_reasons"), F.lit(None).cast("string").alias("measure_parent"),
    )
    back = logs.facts(as_lines(rows, logs.body(rows.columns)))
    return back.select("kind", "event_id", "session_id", "ts", "state", "parent_id", "scope", F.array_join("scope_reasons", ",").alias("reasons"), "scope_parent", "measure", "work_id")


# --- scalars, choices and facts that only larger jobs used


@query("""SELECT l_orderkey AS k, l_linenumber AS n, l_quantity * greatest(l_discount * 20 - 0.5, 0) AS input, l_extendedprice * greatest(l_discount * 20 - 0.5, 0) AS output, l_tax * greatest(l_discount * 20 - 0.5, 0) AS cache_read FROM lineitem""")
def token_scaling(spark: SparkSession, d: str) -> DataFrame:
    """Counters times a factor, which may be below 0."""
    zero = F.lit(0.0)
    rows = P.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("input"), F.col("l_extendedprice").alias("output"), F.col("l_tax").alias("cache_read"),
        zero.alias("reasoning"), zero.alias("cache_write"), (F.col("l_discount") * 20 - 0.5).alias("factor"),
    )
    return rows.select("k", "n", *tokens.scaled(F.col("factor"))).select("k", "n", "input", "output", "cache_read")


@query(f"""WITH {P.RESPONSES}, r AS (SELECT *, CASE pos WHEN 0 THEN message_id % 3 WHEN 1 THEN message_id % 5 END AS revision FROM responses)
SELECT message_id, pos, quality, completed FROM r QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY revision DESC NULLS LAST, (quality = 'exact') DESC, greatest(start, completed) DESC, (output > 0) DESC, pos DESC) = 1""")
def runtime_preference(spark: SparkSession, d: str) -> DataFrame:
    """The copy of each message that counts at run time: revision, quality, freshness, completeness, arrival."""
    rows = P.responses(spark, d).withColumn("revision", F.when(F.col("pos") == 0, F.col("message_id") % 3).when(F.col("pos") == 1, F.col("message_id") % 5))
    rows = rows.withColumn("first_token", F.lit(None).cast("long"))
    return precedence.runtime_preferred(rows).select("message_id", "pos", "quality", "completed")


@query("""SELECT event_id, event_type = 'purchase' OR event_id % 4 = 1 AND user_id % 3 = 0 OR event_id % 4 = 2 AS completed FROM events""")
def completed_events(spark: SparkSession, d: str) -> DataFrame:
    """Whether an event says that its message is completed: by a word in one of several places, by a flag, or by an end."""
    n, word = F.col("event_id") % 4, F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))
    properties = F.struct(
        F.when(n == 0, word).alias("status"),
        F.struct(F.when(n == 1, F.col("user_id") % 3 == 0).alias("completed"), F.when(n.isin(1, 2), F.struct(word.alias("type"))).alias("status"), F.struct(F.when(n == 2, P.millis("ts")).alias("end")).alias("time")).alias("info"),
    )
    body = F.struct(F.col("event_id").alias("id"), properties.alias("properties"), F.when(n == 3, word).alias("completed"))
    leaves = Leaves()
    done = hosts.is_completed(leaves)
    rows = as_lines(P.table(spark, d, "events"), body, "event_id")
    return leaves.over(rows).select(F.col("pos").alias("event_id"), done.alias("completed"))


@query("""SELECT 's' || user_id AS session_id, event_id::VARCHAR AS event_id, 'p' || CASE event_id % 3 WHEN 2 THEN user_id % 11 ELSE user_id % 7 END AS parent_id FROM events WHERE event_type = 'signup' OR event_id % 3 = 2""")
def event_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents that events name: explicit ones anywhere, those of entities in session events, never a message's parent."""
    n, sign = F.col("event_id") % 3, F.col("event_type") == "signup"
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    info = F.struct(text("s", F.col("user_id")).alias("id"), F.when(n == 0, text("p", F.col("user_id") % 7)).alias("parentID"), F.when(n == 1, F.struct(text("p", F.col("user_id") % 7).alias("id"))).alias("parent"))
    properties = F.struct(text("s", F.col("user_id")).alias("sessionID"), info.alias("info"), F.struct(F.when(n == 2, text("p", F.col("user_id") % 11)).alias("parentSessionId")).alias("message"))
    body = F.struct(F.when(sign, "session.updated").otherwise("message.updated").alias("type"), F.col("event_id").cast("string").alias("id"), P.millis("ts").alias("timestamp"), properties.alias("properties"))
    return hosts.older_facts(as_lines(P.table(spark, d, "events"), body, "event_id")).filter("kind = 'parent'").select("session_id", "event_id", "parent_id")


@query("""WITH o AS (SELECT o_orderkey AS k, 's' || o_custkey AS s, (epoch_us(o_orderdate) // 1000)::DOUBLE AS t0 FROM orders),
f AS (SELECT s, 'x' || k AS e, 'lifecycle' AS kind, CASE n WHEN 0 THEN 'busy' ELSE 'completed' END AS state, NULL AS work, NULL AS phase, t0 + n AS ts FROM o, (SELECT unnest([0, 5]) AS n)
UNION ALL SELECT s, 'x' || k, 'work', NULL, CASE WHEN n IN (1, 4) THEN 'm' ELSE 't' END || k, CASE WHEN n IN (1, 2) THEN 'start' ELSE 'end' END, t0 + n FROM o, (SELECT unnest([1, 2, 3, 4]) AS n))
SELECT s AS session_id, e AS execution_id, kind, state, work AS work_id, phase, ts FROM f""")
def event_work(spark: SparkSession, d: str) -> DataFrame:
    """Facts of executions with a step and a tool inside it, from events that are delivered twice and in any order."""
    key = F.col("o_orderkey").cast("string")
    kinds = ["execution.started", "step.started", "tool.called", "tool.success", "step.ended", "execution.succeeded"]
    rows = spread(P.table(spark, d, "orders")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("at", P.millis("o_orderdate"))
    n = F.col("k")
    data = F.struct(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("sessionID"), F.when(n.between(1, 4), F.concat(F.lit("m"), key)).alias("assistantMessageID"), F.when(n.isin(2, 3), F.concat(F.lit("t"), key)).alias("id"))
    body = F.struct(
        F.concat(F.lit("session."), F.element_at(F.array(*map(F.lit, kinds)), n + 1)).alias("type"), F.concat(F.element_at(F.array(*map(F.lit, "xabcde")), n + 1), key).alias("id"), (F.col("at") + n).alias("created"),
        F.struct((F.col("o_orderkey") * 6 + n).alias("seq")).alias("durable"), data.alias("data"),
    )
    return hosts.newer_facts(twice(as_lines(rows, body, "o_orderkey", dealt=True))).select("session_id", "execution_id", "kind", "state", "work_id", "phase", "ts")


@query(f"""WITH {P.RESPONSES} SELECT l.message_id, r.pos, l.output IS NOT DISTINCT FROM r.output AND l.model IS NOT DISTINCT FROM r.model AND CASE WHEN l.message_id % 2 = 0 THEN 'exact' ELSE l.quality END = r.quality AS same
FROM responses l JOIN responses r USING (message_id) WHERE l.pos = 0""")
def record_equality(spark: SparkSession, d: str) -> DataFrame:
    """Records compared field by field; a missing quality is an exact one."""
    rows = P.responses(spark, d)
    left = rows.filter("pos = 0").withColumn("quality", F.when(F.col("message_id") % 2 == 1, F.col("quality"))).alias("l")
    met = left.join(rows.alias("r"), F.col("l.message_id") == F.col("r.message_id"))
    return met.select(F.col("l.message_id").alias("message_id"), F.col("r.pos").alias("pos"), layers.same_record(["output", "model", "quality"]).alias("same"))


@query("""SELECT o_orderkey AS id, sha256('{"customer":{"n":false,"v":"' || o_custkey || '"},"priority":{' || CASE WHEN o_custkey % 3 = 0 THEN '"n":true' ELSE '"n":false,"v":"' || o_orderpriority || '"' END || '}}') AS mark FROM orders""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Marks of rows over their canonical form, in which names are in order and nulls differ from empty texts."""
    rows = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_custkey").alias("customer"))
    return rows.select("id", shown.fingerprint("priority", "customer").alias("mark"))


@query(f"""WITH {P.FACTS}, x AS (SELECT *, 'x' || (event_id % 3) AS execution FROM facts), c AS (SELECT * FROM x WHERE event_id % 7 <> 0), l AS (SELECT * FROM x WHERE event_id % 2 = 0),
missing AS (SELECT DISTINCT session_id, instance_id, execution FROM l WHERE event_id % 7 = 0), ended AS (SELECT DISTINCT session_id, instance_id, execution FROM c WHERE state IN ('completed', 'failed')),
done AS (SELECT * FROM ended EXCEPT SELECT * FROM missing), fl AS (SELECT l.* FROM l ANTI JOIN done USING (session_id, instance_id, execution)), oc AS (SELECT c.* FROM c ANTI JOIN (SELECT DISTINCT session_id, instance_id, execution FROM fl) USING (session_id, instance_id, execution))
SELECT event_id::VARCHAR AS event_id, session_id FROM oc UNION ALL SELECT event_id::VARCHAR, session_id FROM fl""")
def canonical_and_live(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a canonical source and a live one: a live execution hides the canonical one until that is over and has all of it."""
    facts = P.facts(spark, d, 3)
    return activity.reconciled(facts.filter("pos % 7 <> 0"), facts.filter("pos % 2 = 0")).select("event_id", "session_id")


@query(SQL["root_task_time"])
def full_replay(spark: SparkSession, d: str) -> DataFrame:
    """Task time from a log in which every fact stands twice."""
    facts = P.facts(spark, d)
    again = facts.withColumn("pos", F.col("pos") + 1_000_000_000)
    out = activity.replay(facts.unionByName(again), P.shallow_links(spark, d))
    return out.select("id", F.col("direct").cast("long"), F.col("including").cast("long"))


@query("""WITH o AS (SELECT o_orderkey AS k, 's' || o_custkey AS s, floor(o_totalprice) AS v, o_orderkey % 4 AS was, o_orderkey % 5 AS came FROM orders),
a AS (SELECT *, was = 2 AS legacy, CASE WHEN was = 2 THEN false ELSE came = 4 END AS gone, was <> 2 AND (came = 1 AND was = 1 OR came = 2 OR came = 3 AND was <> 3) AS replaced FROM o),
t AS (SELECT s, -1 AS n, -v AS x FROM a WHERE NOT legacy AND (gone OR replaced) UNION ALL SELECT CASE came WHEN 2 THEN 'moved' ELSE s END, 1, CASE came WHEN 3 THEN v + 7 ELSE v * 2 END FROM a WHERE replaced AND NOT gone)
SELECT s AS session_id, sum(n)::BIGINT AS calls, sum(x)::DOUBLE AS output FROM t GROUP BY s HAVING sum(n) <> 0 OR sum(x) <> 0""")
def contribution_transitions(spark: SparkSession, d: str) -> DataFrame:
    """What session sums change by when records meet open, provisional, marked and updated contributions: provisional ones, moves by
    update, corrections without one, and exclusions."""
    key, value = F.col("o_orderkey"), F.floor("o_totalprice").cast("double")
    was, came = key % 4, key % 5
    none, text = F.lit(None), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    update = lambda n: F.struct(F.lit("i").alias("instance"), F.lit(n).alias("sequence"), F.lit(n).alias("received_at"), none.cast("double").alias("revision"), F.lit(str(n)).alias("fingerprint"), F.array().cast("array<string>").alias("seen")).cast(UPDATE_STRUCT)
    orders = P.table(spark, d, "orders")
    session = text("s", F.col("o_custkey"))
    held = orders.select(
        text("m", key).alias("message_id"), session.alias("session_id"), F.when(was == 0, "open").otherwise("settled").alias("status"), F.when(was == 1, "provisional").otherwise("exact").alias("quality"), value.alias("output"),
        F.when(was == 3, update(1.0)).alias("update"), (was == 2).alias("legacy"), F.lit(False).alias("excluded"), F.lit(False).alias("backfill"),
    )
    told = orders.filter(came > 0).select(
        text("m", key).alias("message_id"), F.when(came == 2, "moved").otherwise(session).alias("session_id"), F.when(came == 1, "provisional").otherwise("exact").alias("quality"),
        F.when(came == 3, value + 7).otherwise(value * 2).alias("output"), F.when(came == 2, update(2.0)).alias("update"), F.when(came == 4, "excluded_item").alias("scope"), key.alias("pos"),
    )
    return ledger.applied(held, told, ["output"])[1]


# --- streams


TREE_TIME = f"""WITH {PLAIN}, {P.SHALLOW}, {IDS}, {CLOSURE}, s AS (SELECT c.ancestor AS id, a.start, a."end" FROM active a JOIN closure c ON c.id = a.session_id), {union_sql('s', 'id', 'i')}, {union_sql('active', 'session_id')}
SELECT i.id, coalesce(max(o.direct), 0)::BIGINT AS direct, sum(i."end" - i.start)::BIGINT AS including
FROM i LEFT JOIN (SELECT session_id, sum("end" - start) AS direct FROM u GROUP BY 1) o ON o.session_id = i.id GROUP BY i.id"""


@query(TREE_TIME)
def tree_time_stream(spark: SparkSession, d: str) -> DataFrame:
    """Time of every session alone and with all below it, from the streams of `trees`: facts with odd ids come first, then
    those with even ids, and every seventh comes twice."""
    at = folder(spark, "tree-time")
    rows, half = P.facts(spark, d), F.col("event_id").cast("long") % 2
    parts = [rows.filter(half == 1), rows.filter((half == 0) | (F.col("seq") % 7 == 0))]
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        facts = spark.readStream.schema(part.schema).parquet(f"{at}/in")
        trees.keep_task_time(facts, f"{at}/store", f"{at}/checkpoint", P.shallow_links(spark, d), slab=7 * 24 * trees.HOUR)
    return trees.read_task_time(spark, f"{at}/store").select("id", F.col("direct").cast("long"), F.col("including").cast("long"))
