"""The queries, and for each the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as shown
from ..functions import tokens
from ..operators import activity, forest, intervals, ledger, metrics, precedence, scope
from ..schema import EXCLUDED_SESSION, PENDING, USER
from . import projections as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def union_sql(source: str, keys: str, name: str = "u") -> str:
    """CTEs for the union of the intervals of a CTE."""
    return f"""{name}0 AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE "end" > start),
{name}1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM {name}0),
{name} AS (SELECT {keys}, min(start) AS start, max("end") AS "end" FROM {name}1 GROUP BY {keys}, island)"""


def sweep_sql(layers: dict[str, str], keys: str, keep: str, name: str = "w") -> str:
    points = " UNION ALL ".join(
        f'SELECT {keys}, {point} AS pt, {", ".join(f"{sign if other == layer else 0} AS {other}" for other in layers)} FROM ({source}) WHERE "end" > start'
        for layer, source in layers.items()
        for point, sign in (("start", 1), ('"end"', -1))
    )
    return f"""{name}p AS ({points}), {name}s AS (SELECT {keys}, pt, {", ".join(f"sum({x}) AS {x}" for x in layers)} FROM {name}p GROUP BY {keys}, pt),
{name}g AS (SELECT {keys}, pt AS start, lead(pt) OVER (PARTITION BY {keys} ORDER BY pt) AS "end", {", ".join(f"sum({x}) OVER (PARTITION BY {keys} ORDER BY pt) AS {x}" for x in layers)} FROM {name}s),
{name}k AS (SELECT {keys}, start, "end" FROM {name}g WHERE "end" IS NOT NULL AND {keep}), {union_sql(f"{name}k", keys, name)}"""


MEASURED = 'session_id, count(*)::BIGINT AS n, sum("end" - start)::BIGINT AS length'


def measured(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("length"))


# --- usage


@query(f"""WITH {P.RESPONSES}, {P.PREFERRED}, {P.COUNTERS}, r AS (SELECT p.*, c.input, c.cache_read, c.cache_write, c.reasoning FROM preferred p JOIN counters c USING (message_id))
SELECT session_id, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(reasoning)::BIGINT AS reasoning, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write,
  sum(cost)::BIGINT AS cost, count(*)::BIGINT AS calls, sum(input + output + reasoning + cache_read + cache_write)::BIGINT AS total, sum(output + reasoning)::BIGINT AS generated,
  round(sum(cache_read)::DOUBLE / nullif(sum(input) + sum(cache_read) + sum(cache_write), 0)::DOUBLE, 6) AS cache_hit_rate FROM r GROUP BY session_id""")
def usage_by_session(spark: SparkSession, d: str) -> DataFrame:
    """Per session: tokens, cost, calls and cache hit rate after replays and provisional copies are taken out."""
    rows = precedence.preferred(P.responses(spark, d)).join(P.counters(spark, d), "message_id")
    return metrics.session_usage(rows).withColumn("cache_hit_rate", F.round("cache_hit_rate", 6))


@query(f"""WITH {P.COUNTERS} SELECT message_id, round(CASE WHEN input + cache_read + cache_write > 0 THEN cache_read::DOUBLE / (input + cache_read + cache_write) END, 6) AS rate FROM counters""")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    rate = tokens.cache_hit_rate(F.col("cache_read"), F.col("input"), F.col("cache_write"))
    return P.counters(spark, d).select("message_id", F.round(rate, 6).alias("rate"))


@query(f"WITH {P.RESPONSES}, {P.PREFERRED} SELECT message_id, session_id, quality, output, completed FROM preferred")
def dedupe_preferred(spark: SparkSession, d: str) -> DataFrame:
    return precedence.preferred(P.responses(spark, d)).select("message_id", "session_id", "quality", "output", "completed")


@query(f"""WITH {P.RESPONSES}, e AS (SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY (quality = 'exact') DESC, pos DESC) = 1)
SELECT session_id, sum(output)::BIGINT AS output, count(*)::BIGINT AS calls FROM e GROUP BY session_id""")
def contribution_corrections(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("struct<instance:string,sequence:double,received_at:double,revision:double,fingerprint:string,seen:array<string>>")
    rows = P.responses(spark, d).withColumn("update", none).withColumn("scope", F.lit(USER))
    return ledger.contributions(rows).groupBy("session_id").agg(F.sum("output").alias("output"), F.count("*").alias("calls"))


@query(f"WITH {P.RESPONSES}, {P.PREFERRED} SELECT message_id, session_id, completed FROM preferred ORDER BY completed DESC, pos DESC, message_id LIMIT 24")
def recent_responses(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recent(precedence.preferred(P.responses(spark, d))).select("message_id", "session_id", "completed")


@query(f"WITH {P.RESPONSES}, {P.PREFERRED} SELECT session_id, arg_max(model, (completed, pos, model)) AS model FROM preferred GROUP BY session_id")
def latest_model(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latest_model(precedence.preferred(P.responses(spark, d)))


@query(f"""WITH {P.RESPONSES}, r AS (SELECT session_id, output, (completed - start)::DOUBLE AS took, CASE WHEN message_id % 3 = 0 THEN (message_id % 1000)::DOUBLE WHEN message_id % 3 = 1 THEN (message_id % 77)::DOUBLE END AS delay FROM responses),
s AS (SELECT *, CASE WHEN took > 0 THEN output * 1000 / took END AS speed FROM r)
SELECT session_id, count(*)::BIGINT AS calls, floor(coalesce(avg(speed), 0) * 10000)::BIGINT AS avg_speed, floor(coalesce(max(speed), 0) * 10000)::BIGINT AS max_speed, floor(coalesce(min(speed), 0) * 10000)::BIGINT AS min_speed, floor(coalesce(avg(delay), 0) * 10000)::BIGINT AS avg_delay, floor(coalesce(max(delay), 0) * 10000)::BIGINT AS max_delay, floor(coalesce(min(delay), 0) * 10000)::BIGINT AS min_delay,
  floor(avg(took) * 10000)::BIGINT AS avg_duration, floor(max(took) * 10000)::BIGINT AS max_duration, floor(min(took) * 10000)::BIGINT AS min_duration FROM s GROUP BY session_id""")
def response_stats(spark: SparkSession, d: str) -> DataFrame:
    """Speeds, delays (by first response, reported, or unknown) and durations of all records of a session."""
    key, none = F.col("message_id"), F.lit(None).cast("double")
    rows = P.responses(spark, d).withColumns({"first_response": F.when(key % 3 == 0, F.col("start") + key % 1000), "ttft": F.when(key % 3 == 1, (key % 77).cast("double")), "first_token": none, "duration": none})
    # in ten-thousandths: the engines round halves differently; the SQL adds up each kind of copy alone
    out = metrics.response_stats(rows, part="pos")
    return out.select("session_id", "calls", *(F.floor(F.col(c) * 10000).cast("long").alias(c) for c in out.columns[2:]))


@query(f"""WITH {P.RESPONSES}, r AS (SELECT session_id, output AS tokens, completed - start AS ms, quality <> 'exact' AS estimated FROM responses WHERE completed > start)
SELECT session_id, sum(tokens)::BIGINT AS tokens, sum(ms)::BIGINT AS ms, sum(estimated::INT)::BIGINT AS estimates, round(sum(tokens) * 1000.0::DOUBLE / sum(ms), 6) AS rate FROM r GROUP BY session_id""")
def session_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = P.responses(spark, d).withColumn("start_missing", F.lit(False)).withColumn("reasoning", F.lit(0).cast("long"))
    return metrics.session_rate(metrics.response_rate(rows)).withColumn("rate", F.round("rate", 6))


@query("""WITH s AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, floor(l_quantity)::BIGINT AS weight, (l_orderkey % 97)::BIGINT AS target FROM lineitem),
t AS (SELECT *, weight * target / sum(weight) OVER (PARTITION BY key)::DOUBLE AS exact FROM s), f AS (SELECT *, floor(exact)::BIGINT AS low FROM t),
p AS (SELECT *, target - sum(low) OVER (PARTITION BY key) AS left_, row_number() OVER (PARTITION BY key ORDER BY exact - low DESC, pos) AS place FROM f)
SELECT key, pos::BIGINT AS pos, (low + CASE WHEN place <= left_ THEN 1 ELSE 0 END)::BIGINT AS share FROM p""")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """A whole target shared out by weight: largest remainders first."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("long")
    rows = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), pos.alias("pos"), F.floor("l_quantity").cast("long").alias("weight"), (F.col("l_orderkey") % 97).alias("target"))
    return metrics.calibrated(rows).select("key", "pos", "share")


@query("SELECT conv_id, round(sum(strlen(coalesce(text, '')) / 5.5::DOUBLE), 4) AS estimate, count(*)::BIGINT AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = P.table(spark, d, "conversations").filter("role = 'assistant'")
    return rows.groupBy("conv_id").agg(F.round(F.sum(tokens.estimate(F.col("text"))), 4).alias("estimate"), F.count("*").alias("n"))


@query("SELECT lang, array_to_string(list_sort(list_distinct(list(source))), ',') AS agents FROM documents WHERE source IS NOT NULL GROUP BY lang")
def agent_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = P.table(spark, d, "documents").filter("source is not null")
    return rows.groupBy("lang").agg(F.array_join(shown.agent_set(shown.agent_name(F.col("source"))), ",").alias("agents"))


@query(f"""WITH {P.RESPONSES}, {P.PREFERRED}, last AS (SELECT * FROM preferred ORDER BY message_id DESC LIMIT 1000)
SELECT message_id FROM last UNION SELECT message_id FROM preferred WHERE message_id % 501 = 0""")
def retention_window(spark: SparkSession, d: str) -> DataFrame:
    """The last thousand by admission, and protected ones."""
    rows = precedence.preferred(P.responses(spark, d)).withColumn("pos", F.col("message_id"))
    return precedence.newest(rows, 1000, rows.filter("message_id % 501 = 0")).select("message_id")


# --- intervals


@query(f"WITH b AS ({P.busy_sql()}), {union_sql('b', 'session_id')} SELECT {MEASURED} FROM u GROUP BY session_id")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return measured(intervals.union(P.busy(spark, d), ["session_id"]))


BASE, REMOVED = ("click", "view", "error"), ("purchase", "signup")
PAIR = {"base": P.busy_sql(*BASE), "removed": P.busy_sql(*REMOVED)}


@query(f"WITH {sweep_sql(PAIR, 'session_id', 'base > 0 AND removed = 0')} SELECT {MEASURED} FROM w GROUP BY session_id")
def interval_subtract(spark: SparkSession, d: str) -> DataFrame:
    return measured(intervals.subtract(P.busy(spark, d, *BASE), P.busy(spark, d, *REMOVED), ["session_id"]))


@query(f"WITH {sweep_sql(PAIR, 'session_id', 'base > 0 AND removed > 0')} SELECT {MEASURED} FROM w GROUP BY session_id")
def interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    return measured(intervals.intersect(P.busy(spark, d, *BASE), P.busy(spark, d, *REMOVED), ["session_id"]))


LAYERS = {"busy": P.busy_sql("click", "view"), "maintenance": P.busy_sql("error", "purchase"), "normal": P.busy_sql("signup")}


@query(f"WITH {sweep_sql(LAYERS, 'session_id', 'busy > 0 AND (maintenance = 0 OR normal > 0)')} SELECT {MEASURED} FROM w GROUP BY session_id")
def maintenance_subtract(spark: SparkSession, d: str) -> DataFrame:
    return measured(intervals.eligible(P.busy(spark, d, "click", "view"), P.busy(spark, d, "error", "purchase"), P.busy(spark, d, "signup"), ["session_id"]))


# --- activity

ROWS = """rows AS (SELECT *, max(CASE WHEN latch AND state IN ('completed', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, instance_id, execution ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done,
  lead(ts) OVER (PARTITION BY session_id, instance_id, execution ORDER BY ts, seq) AS next FROM x),
active AS (SELECT session_id, instance_id, execution, ts AS start, next AS "end" FROM rows WHERE state IN ('busy', 'retry') AND coalesce(done, 0) = 0 AND next > ts)"""
PLAIN = f"{P.FACTS}, x AS (SELECT *, '' AS execution, false AS latch FROM facts), {ROWS}"


@query(f"WITH {PLAIN}, {union_sql('active', 'session_id')} SELECT {MEASURED} FROM u GROUP BY session_id")
def lifecycle_time(spark: SparkSession, d: str) -> DataFrame:
    return measured(intervals.union(activity.lifecycle_intervals(P.facts(spark, d)), ["session_id"]))


@query(f"WITH {P.FACTS}, x AS (SELECT *, 'x' || (event_id % 40) AS execution, true AS latch FROM facts), {ROWS}, {union_sql('active', 'session_id')} SELECT {MEASURED} FROM u GROUP BY session_id")
def lifecycle_executions(spark: SparkSession, d: str) -> DataFrame:
    """With executions, whose first terminal state ends them."""
    return measured(intervals.union(activity.lifecycle_intervals(P.facts(spark, d, 40)), ["session_id"]))


@query(f"""WITH {P.FACTS} SELECT session_id, instance_id, least(CASE WHEN instance_id = 0 THEN 1704500000000.0::DOUBLE END, CASE WHEN session_id % 3 = 0 THEN 1704200000000.0::DOUBLE END, max(CASE WHEN session_id % 2 = 0 THEN ts END)::DOUBLE) AS proof, max(ts)::DOUBLE AS latest
FROM facts GROUP BY session_id, instance_id""")
def lifecycle_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Where open tails may end: a cutoff for a trusted instance, named ends, last observations."""
    facts = P.facts(spark, d).withColumn("last_observed", F.when(F.col("session_id") % 2 == 0, F.col("ts")).cast("double"))
    trusted = facts.filter("instance_id = 0").select("instance_id").distinct()
    named = facts.filter("session_id % 3 = 0").select("session_id", "instance_id", F.lit(1704200000000.0).alias("end")).distinct()
    ends = activity.boundaries(facts, trusted, 1704500000000.0, named)
    latest = facts.groupBy("session_id", "instance_id").agg(F.max("ts").cast("double").alias("latest"))
    return ends.join(latest, ["session_id", "instance_id"]).select("session_id", "instance_id", F.when(F.col("proved"), F.col("boundary")).alias("proof"), "latest")


@query(f"""WITH {P.FACTS}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id, instance_id ORDER BY ts DESC, seq DESC) AS k FROM facts)
SELECT session_id, instance_id, 'stopped' AS state, ts::DOUBLE AS ts FROM l WHERE k = 1 AND state IN ('busy', 'retry') AND instance_id = 0""")
def open_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Streams without an execution id; those of older instances that are open are stopped."""
    facts = P.facts(spark, d)
    return activity.recovery_facts(facts, facts.filter("instance_id = 0").select("instance_id")).select("session_id", "instance_id", "state", "ts")


@query(f"""WITH {P.FACTS}, a AS (SELECT *, state IN ('busy', 'retry') AS active, coalesce(lag(state IN ('busy', 'retry')) OVER (PARTITION BY session_id ORDER BY ts, seq), false) AS was FROM facts),
e AS (SELECT *, sum(CASE WHEN active AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS epoch FROM a)
SELECT session_id, epoch::BIGINT AS epoch, min(ts) AS start, coalesce(max(CASE WHEN NOT active THEN ts END), min(ts)) AS "end", max(CASE WHEN NOT active THEN ts END) IS NULL AS is_open FROM e WHERE epoch > 0 AND (active OR was) GROUP BY session_id, epoch""")
def run_epochs(spark: SparkSession, d: str) -> DataFrame:
    return activity.run_epochs(P.facts(spark, d)).select("session_id", "epoch", "start", F.coalesce("end", "start").alias("end"), F.col("end").isNull().alias("is_open"))


@query(f"""WITH {P.SPANS}, b AS (SELECT DISTINCT session_id, 0::BIGINT AS start, 100::BIGINT AS "end" FROM spans),
{sweep_sql({"busy": "SELECT * FROM b", "maintenance": 'SELECT session_id, start, "end" FROM spans WHERE maintenance', "normal": 'SELECT session_id, start, "end" FROM spans WHERE normal'}, "session_id", "busy > 0 AND (maintenance = 0 OR normal > 0)")} SELECT {MEASURED} FROM w GROUP BY session_id""")
def work_span_time(spark: SparkSession, d: str) -> DataFrame:
    """Executions of a hundred units less maintenance spans, normal ones restored."""
    facts = P.spans(spark, d)
    work = activity.work_spans(facts, F.col("flag") == "R", F.col("flag") == "A")
    busy = facts.select(*activity.EXECUTION).distinct().select("*", F.lit(0).cast("long").alias("start"), F.lit(100).cast("long").alias("end"))
    return measured(activity.eligible_time(busy, work))


@query(f"""WITH {P.SPANS} SELECT session_id FROM spans WHERE session_id % 3 = 0 GROUP BY session_id HAVING bool_and(maintenance) AND max("end") <= 100 AND min(start) >= 0""")
def pure_certificate(spark: SparkSession, d: str) -> DataFrame:
    """Executions whose certificate holds: all of their work is maintenance inside their own time."""
    facts = P.spans(spark, d)
    own = facts.select(*activity.EXECUTION).distinct()
    states = own.withColumn("state", F.lit("busy")).withColumn("ts", F.lit(0)).unionByName(own.withColumn("state", F.lit("idle")).withColumn("ts", F.lit(100))).withColumn("pos", F.col("ts"))
    none = F.lit(None).cast("double")
    states = states.withColumn("ended_at", none).withColumn("last_observed", none)
    work = activity.work_spans(facts, F.col("flag") == "R", F.col("flag") == "A")
    return activity.pure_maintenance(states, work, own.filter("session_id % 3 = 0"), activity.boundaries(states)).select("session_id")


CLOSURE = "closure AS (WITH RECURSIVE c(id, ancestor) AS (SELECT id, id FROM ids UNION SELECT c.id, l.parent FROM c JOIN links l ON l.child = c.ancestor WHERE l.parent IS NOT NULL) SELECT * FROM c)"
IDS = "ids AS (SELECT child AS id FROM links UNION SELECT parent FROM links WHERE parent IS NOT NULL)"


@query(f"""WITH {PLAIN}, {P.SHALLOW}, {IDS}, {CLOSURE}, s AS (SELECT c.ancestor AS id, a.start, a."end" FROM active a JOIN closure c ON c.id = a.session_id), {union_sql('s', 'id', 'i')}, {union_sql('active', 'session_id')}
SELECT i.id, coalesce(max(o.direct), 0)::BIGINT AS direct, sum(i."end" - i.start)::BIGINT AS including FROM i LEFT JOIN (SELECT session_id, sum("end" - start) AS direct FROM u GROUP BY 1) o ON o.session_id = i.id GROUP BY i.id""")
def root_task_time(spark: SparkSession, d: str) -> DataFrame:
    """Time of every session alone, and with all below it, parallel work counted once."""
    return activity.task_time(activity.lifecycle_intervals(P.facts(spark, d)), P.shallow_links(spark, d)).select("id", F.col("direct").cast("long"), F.col("including").cast("long"))


@query(f"WITH {P.FACTS} SELECT session_id, count(*)::BIGINT AS n, max(seq) AS last FROM facts WHERE NOT (session_id % 5 = 0 AND instance_id = 1) GROUP BY session_id")
def stream_visibility(spark: SparkSession, d: str) -> DataFrame:
    facts = P.facts(spark, d)
    hidden = facts.filter("session_id % 5 = 0 and instance_id = 1").select(*activity.EXECUTION).distinct().withColumn("mode", F.lit("hidden"))
    return activity.visible(facts, hidden).groupBy("session_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


# --- forest


@query(f"WITH {P.CYCLIC}, {IDS}, {CLOSURE} SELECT id, min(CASE WHEN ancestor < 5 THEN ancestor END) AS root FROM closure GROUP BY id")
def root_resolution_cycles(spark: SparkSession, d: str) -> DataFrame:
    return forest.roots(P.cyclic_links(spark, d))


COSTS = "t AS (SELECT 'c' || o_custkey AS id, round(o_totalprice * 100)::BIGINT AS cost, 1 AS calls FROM orders)"


def costs(spark: SparkSession, d: str) -> DataFrame:
    return P.table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"), F.lit(1).cast("long").alias("calls"))


ROLLUP = """SELECT c.ancestor AS id, coalesce(sum(CASE WHEN c.id = c.ancestor THEN cost END), 0)::BIGINT AS direct_cost, coalesce(sum(CASE WHEN c.id = c.ancestor THEN calls END), 0)::BIGINT AS direct_calls,
  coalesce(sum(cost), 0)::BIGINT AS including_cost, coalesce(sum(calls), 0)::BIGINT AS including_calls FROM closure c LEFT JOIN t ON t.id = c.id GROUP BY c.ancestor"""


@query(f"WITH {P.REGIONS}, {IDS}, {CLOSURE}, {COSTS} {ROLLUP}")
def subtree_rollup(spark: SparkSession, d: str) -> DataFrame:
    return forest.rollup(costs(spark, d), P.region_links(spark, d), ["cost", "calls"])


@query(f"""WITH l0 AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
gone AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY' OR c_nationkey = 3 UNION SELECT 'n3'),
links AS (SELECT * FROM l0 WHERE child NOT IN (SELECT id FROM gone) AND parent NOT IN (SELECT id FROM gone)), t AS (SELECT 'c' || o_custkey AS id, round(o_totalprice * 100)::BIGINT AS cost, 1 AS calls FROM orders WHERE 'c' || o_custkey NOT IN (SELECT id FROM gone)),
ids AS (SELECT child AS id FROM links UNION SELECT parent FROM links UNION SELECT id FROM t), {CLOSURE} {ROLLUP}""")
def eligible_usage(spark: SparkSession, d: str) -> DataFrame:
    """The rollup without excluded sessions and all below them."""
    marked = P.table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    nation = P.table(spark, d, "nation").filter("n_nationkey = 3").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    return forest.rollup(costs(spark, d), P.region_links(spark, d), ["cost", "calls"], marked.unionByName(nation))


@query(f"WITH {P.SHALLOW}, {IDS}, {CLOSURE} SELECT DISTINCT id FROM closure WHERE ancestor IN (2, 5, 13)")
def inherited_exclusion(spark: SparkSession, d: str) -> DataFrame:
    links = P.shallow_links(spark, d)
    evidence = links.select(F.col("child").alias("session_id"), F.when(F.col("child").isin(2, 5, 13), EXCLUDED_SESSION).otherwise(PENDING).alias("scope"))
    return scope.excluded_sessions(links, evidence)


LISTING = """tree AS (WITH RECURSIVE t(id, root, depth, path) AS (SELECT DISTINCT parent, parent, 0, [parent] FROM links WHERE parent LIKE 'r%'
  UNION ALL SELECT l.child, t.root, t.depth + 1, list_append(t.path, l.child) FROM links l JOIN t ON l.parent = t.id) SELECT * FROM t)"""
LONG = "a-node-with-a-rather-long-id/"


@query(f"WITH {P.REGIONS}, {LISTING} SELECT '{LONG}' || root AS root, '{LONG}' || id AS id, depth::INT AS depth, row_number() OVER (PARTITION BY root ORDER BY path) AS place FROM tree")
def tree_listing(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with ids of thirty characters and more, in pre-order."""
    return forest.listing(P.region_links(spark, d, LONG))


@query(f"""WITH {P.REGIONS}, {LISTING}, {IDS}, {CLOSURE}, {COSTS}, r AS ({ROLLUP})
SELECT tree.root, tree.id, depth::INT AS depth, including_cost, including_calls FROM tree JOIN r ON r.id = tree.id WHERE depth > 0 AND including_calls > 0""")
def child_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nodes below each root with depth and sums, those without calls left out."""
    links = P.region_links(spark, d)
    rolled = forest.rollup(costs(spark, d), links, ["cost", "calls"])
    return forest.listing(links).filter("depth > 0").join(rolled, "id").filter("including_calls > 0").select("root", "id", "depth", "including_cost", "including_calls")


@query(f"WITH {P.SHALLOW} SELECT parent, array_to_string(list_sort(list_distinct(list(child))), ',') AS children FROM links WHERE parent IS NOT NULL AND parent <> child GROUP BY parent")
def direct_children(spark: SparkSession, d: str) -> DataFrame:
    return forest.children(P.shallow_links(spark, d)).select("parent", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


# --- ledgers and evidence


@query(f"""WITH {P.RESPONSES} SELECT session_id, sum(CASE WHEN message_id % 35 = 0 THEN 0 WHEN message_id % 15 = 0 AND message_id % 2 = 1 THEN output + 9 ELSE output END)::BIGINT AS output, sum(CASE WHEN message_id % 35 = 0 THEN 0 ELSE cost END)::BIGINT AS cost FROM orders0 GROUP BY session_id""")
def ledger_union(spark: SparkSession, d: str) -> DataFrame:
    """Two ledgers that share every fifth message of odd id, each message counting once: an excluded copy shuts out the other, a
    provisional one yields, and of exact ones that with the newer update wins, though its sequence is the only thing newer."""
    base = P.responses(spark, d).filter("pos = 0")
    key = F.col("message_id")
    update = lambda n: F.struct(F.lit("i").alias("instance"), F.lit(float(n)).alias("sequence"), F.lit(1.0).alias("received_at"), F.lit(None).cast("double").alias("revision"), F.lit(str(n)).alias("fingerprint"), F.array().cast("array<string>").alias("seen"))
    first = base.filter((key % 2 == 0) | (key % 5 == 0)).withColumns({"ledger": F.lit("a"), "update": update(1), "excluded": key % 35 == 0})
    other = base.filter(key % 2 == 1).withColumns({"ledger": F.lit("b"), "update": update(2), "excluded": F.lit(False)})
    other = other.withColumn("quality", F.when((key % 5 == 0) & (key % 3 != 0), "provisional").otherwise("exact")).withColumn("output", F.when(key % 5 == 0, F.col("output") + 9).otherwise(F.col("output")))
    copies = first.unionByName(other)
    sums = copies.groupBy("ledger", "session_id").agg(*(F.sum(F.when(F.col("excluded"), 0).otherwise(F.col(c))).alias(c) for c in ("output", "cost")))
    return ledger.ledger_union(copies, sums, ["output", "cost"])


@query(f"""WITH {P.RESPONSES}, {P.PREFERRED} SELECT session_id, sum(output)::BIGINT AS output FROM preferred GROUP BY session_id""")
def overlay_terms(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of first copies, with the history's newer records laid over it."""
    rows = P.responses(spark, d)
    first = rows.filter("pos = 0 and message_id % 3 <> 0")
    totals = first.groupBy("session_id").agg(F.sum("output").alias("output"))
    return ledger.overlay(totals, first, precedence.preferred(rows), ["output"])


@query(f"""WITH {P.FACTS}, e AS (SELECT session_id, seq AS pos, CASE state WHEN 'failed' THEN 'excluded_item' WHEN 'completed' THEN 'pending' ELSE 'user' END AS scope FROM facts),
m AS (SELECT session_id, max(CASE WHEN scope = 'excluded_item' THEN 1 ELSE 0 END) AS hit, max(CASE WHEN scope = 'user' THEN 1 ELSE 0 END) AS named, min(pos) AS first FROM e GROUP BY session_id)
SELECT session_id, CASE WHEN hit = 1 THEN 'excluded_item' WHEN named = 1 THEN 'user' ELSE 'pending' END AS scope FROM m""")
def scope_merge(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("state") == "failed", "excluded_item").when(F.col("state") == "completed", PENDING).otherwise(USER)
    evidence = P.facts(spark, d).select("session_id", "pos", kind.alias("scope"), F.array("state").alias("reasons"), F.lit(None).cast("long").alias("parent"))
    return scope.merged(evidence).select("session_id", "scope")


# --- clocks, latencies, freezing

CUTOFF = 1704300000000


@query(f"""WITH {P.FACTS}, x AS (SELECT *, '' AS execution, false AS latch FROM facts WHERE instance_id <> 0 OR ts <= {CUTOFF}), {ROWS.rpartition("active AS")[0]}
active AS (SELECT session_id, ts AS start, coalesce(next, CASE WHEN instance_id = 0 THEN {CUTOFF} END) AS "end" FROM rows WHERE state IN ('busy', 'retry') AND coalesce(next, CASE WHEN instance_id = 0 THEN {CUTOFF} END) > ts), {union_sql('active', 'session_id')}
SELECT session_id, count(*)::BIGINT AS n, sum("end" - start)::BIGINT AS length FROM u GROUP BY session_id""")
def cutoff_time(spark: SparkSession, d: str) -> DataFrame:
    """Active time until a cutoff that one trusted instance may be extended to."""
    facts = P.facts(spark, d)
    ends = activity.boundaries(facts, facts.filter("instance_id = 0").select("instance_id").distinct(), float(CUTOFF))
    return measured(intervals.union(activity.lifecycle_intervals(facts, ends), ["session_id"]))


@query(f"""WITH {P.RESPONSES}, {P.PREFERRED}, last AS (SELECT message_id FROM preferred ORDER BY message_id DESC LIMIT 1000)
SELECT CASE WHEN quality = 'exact' AND message_id NOT IN (SELECT message_id FROM last) THEN 'settled' ELSE 'open' END AS status, count(*)::BIGINT AS n, sum(output)::BIGINT AS output FROM preferred GROUP BY 1""")
def ledger_freeze(spark: SparkSession, d: str) -> DataFrame:
    """Contributions that left the history's window are settled; the sums stay."""
    rows = precedence.preferred(P.responses(spark, d)).withColumn("pos", F.col("message_id"))
    return ledger.frozen(rows, precedence.newest(rows, 1000)).groupBy("status").agg(F.count("*").alias("n"), F.sum("output").alias("output"))


@query("""WITH r AS (SELECT o_orderkey AS message_id, 1000.0::DOUBLE AS start, CASE WHEN o_orderkey % 3 = 0 THEN 1000.0 + o_orderkey % 50 - 10 END AS first_response, CASE WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 40 - 5)::DOUBLE END AS ttft, 1000.0 + o_orderkey % 60 - 8 AS first_token FROM orders)
SELECT message_id, greatest(0.0, CASE WHEN first_response >= start THEN first_response - start WHEN ttft IS NOT NULL THEN ttft ELSE first_token - start END)::DOUBLE AS delay FROM r""")
def first_response_delay(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds to the first response by the best evidence there is."""
    key = F.col("o_orderkey")
    rows = P.table(spark, d, "orders").select(
        key.alias("message_id"), F.lit(1000.0).alias("start"), F.when(key % 3 == 0, 1000.0 + key % 50 - 10).alias("first_response"), F.when(key % 3 == 1, (key % 40 - 5).cast("double")).alias("ttft"), (1000.0 + key % 60 - 8).alias("first_token"),
    )
    return rows.select("message_id", metrics.first_token_delay().alias("delay"))


@query("""WITH e AS (SELECT l_orderkey AS message_id, count(*)::BIGINT AS observations, sum(l_quantity)::DOUBLE AS total_units, min(l_quantity)::DOUBLE AS first_batch, (sum(l_partkey) % 3000)::DOUBLE AS span_ms, sum(l_suppkey)::DOUBLE AS usage FROM lineitem GROUP BY 1)
SELECT message_id, round(usage * ((total_units - first_batch) / total_units) * 1000 / span_ms, 6) AS rate FROM e WHERE observations >= 2 AND first_batch < total_units AND first_batch > 0 AND span_ms >= 1000""")
def observed_generation_rate(spark: SparkSession, d: str) -> DataFrame:
    """Rates that stored evidence proves; no clock is declared, so spans under a second prove nothing."""
    rows = P.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("message_id")).agg(
        F.count("*").alias("observations"), F.sum("l_quantity").alias("total_units"), F.min("l_quantity").alias("first_batch"), (F.sum("l_partkey") % 3000).cast("double").alias("span_ms"), F.sum("l_suppkey").cast("double").alias("usage"),
    )
    none, lit = F.lit(None), F.lit
    e = F.struct(
        lit(3).alias("version"), lit("complete").alias("coverage"), lit(True).alias("from_start"), lit("receive-monotonic").alias("time_source"), lit("v2").alias("stream"), lit("s").alias("step_id"), lit(0.0).alias("start"), lit(1.0).alias("end"),
        lit(0.0).alias("first_receive"), F.col("span_ms").alias("last_receive"), "observations", none.cast("string").alias("clock_source"), none.cast("double").alias("clock_resolution_ms"), none.cast("string").alias("quality"),
        F.col("total_units").cast("long").alias("output_bytes"), F.col("first_batch").cast("long").alias("output_first"), F.col("usage").alias("output_usage"), lit(True).alias("output_observed"),
        lit(0).cast("long").alias("reasoning_bytes"), lit(0).cast("long").alias("reasoning_first"), lit(0.0).alias("reasoning_usage"), lit(False).alias("reasoning_observed"),
    )
    measured_ = rows.withColumn("evidence", e).select("message_id", metrics.interval_measure().alias("m")).filter("m is not null")
    return measured_.select("message_id", F.round(F.col("m.tokens") * 1000 / F.col("m.ms"), 6).alias("rate"))


@query(f"""WITH {P.FACTS}, f AS (SELECT session_id, arg_max(CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id % 10 END, (ts, event_id)) AS parent FROM facts WHERE state = 'retry' GROUP BY 1),
c AS (SELECT DISTINCT user_id AS session_id, 7::BIGINT AS parent FROM events WHERE user_id % 6 = 0), p AS (SELECT DISTINCT user_id AS session_id, 9::BIGINT AS parent FROM events)
SELECT p.session_id, coalesce(CAST(CASE WHEN c.session_id IS NOT NULL THEN c.parent WHEN f.session_id IS NOT NULL THEN nullif(f.parent, -1) ELSE p.parent END AS VARCHAR), 'none') AS parent FROM p LEFT JOIN c USING (session_id) LEFT JOIN f USING (session_id)""")
def parent_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Given links first, then the last parent fact, which may clear the link, then what evidence names."""
    facts = P.facts(spark, d).filter("state = 'retry'").withColumn("kind", F.lit("parent")).withColumn("parent_id", F.when(F.col("seq") % 4 != 0, F.col("seq") % 10))
    users = P.table(spark, d, "events").select(F.col("user_id").alias("child")).distinct()
    context = users.filter("child % 6 = 0").withColumn("parent", F.lit(7).cast("long"))
    proof = users.withColumn("parent", F.lit(9).cast("long"))
    return activity.resolved_parents(facts, context, proof).select(F.col("child").alias("session_id"), F.coalesce(F.col("parent").cast("string"), F.lit("none")).alias("parent"))


@query("SELECT l_orderkey, count(*)::BIGINT AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem) GROUP BY 1")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    """Facts of several sources that overlap, each payload once."""
    rows = P.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_linenumber").cast("long").alias("pos"))
    return precedence.distinct_facts(rows.unionByName(rows.filter("l_partkey % 3 = 0"))).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(f"WITH {P.RESPONSES} SELECT message_id, session_id, output FROM responses QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY pos DESC) = 1")
def retired_copies(spark: SparkSession, d: str) -> DataFrame:
    """The newest copy of each message: optimistic ones stand until the ledger has the same or a later revision."""
    rows = P.responses(spark, d).withColumn("revision", F.col("pos"))
    known = rows.filter("pos = 0")
    ahead = precedence.best(ledger.retired(rows.filter("pos > 0"), known), ["message_id"], F.col("revision").desc())
    stand = known.join(ahead.select("message_id"), "message_id", "left_anti")
    return ahead.select("message_id", "session_id", "output").unionByName(stand.select("message_id", "session_id", "output"))
