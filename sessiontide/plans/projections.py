"""The driver tables seen as telemetry: the same projection in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    return F.expr(f"unix_micros(cast({column} as timestamp)) div 1000")


STATE = {"click": "busy", "view": "busy", "signup": "retry", "purchase": "completed", "error": "failed"}


def facts(spark: SparkSession, d: str, executions: int = 0) -> DataFrame:
    """Lifecycle facts; with `executions`, so many executions with ids in each stream, else none."""
    state = F.lit(None).cast("string")
    for kind, name in STATE.items():
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    execution = F.concat(F.lit("x"), (F.col("event_id") % executions).cast("string")) if executions else F.lit(None).cast("string")
    none = F.lit(None).cast("double")
    return table(spark, d, "events").select(
        F.lit("lifecycle").alias("kind"), F.col("event_id").cast("string").alias("event_id"), F.col("user_id").alias("session_id"), (F.col("event_id") % 2).alias("instance_id"), execution.alias("execution_id"),
        millis("ts").alias("ts"), F.col("event_id").alias("seq"), F.lit(None).cast("long").alias("source_sequence"), state.alias("state"), none.alias("ended_at"), none.alias("last_observed"), F.col("event_id").alias("pos"),
    )


FACTS = """facts AS (SELECT event_id, user_id AS session_id, event_id % 2 AS instance_id, epoch_us(ts) // 1000 AS ts, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'busy' WHEN 'view' THEN 'busy' WHEN 'signup' THEN 'retry' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS state FROM events)"""


def busy(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    rows = table(spark, d, "events")
    rows = rows.filter(F.col("event_type").isin(*kinds)) if kinds else rows
    start = millis("ts")
    return rows.select(F.col("user_id").alias("session_id"), start.alias("start"), (start + F.floor(F.col("value") * 1e6).cast("long")).alias("end"))


def busy_sql(*kinds: str) -> str:
    where = f" WHERE event_type IN ({', '.join(repr(k) for k in kinds)})" if kinds else ""
    return f"SELECT user_id AS session_id, epoch_us(ts) // 1000 AS start, epoch_us(ts) // 1000 + floor(value * 1e6)::BIGINT AS \"end\" FROM events{where}"


def shallow_links(spark: SparkSession, d: str) -> DataFrame:
    """User u below u div 10; 0 is a root."""
    return table(spark, d, "events").select(F.col("user_id").alias("child")).distinct().select("child", F.expr("case when child > 0 then child div 10 end").alias("parent"))


SHALLOW = "links AS (SELECT DISTINCT user_id AS child, CASE WHEN user_id > 0 THEN user_id // 10 END AS parent FROM events)"


def cyclic_links(spark: SparkSession, d: str) -> DataFrame:
    """Users 0 to 4 in a cycle, all others below u div 10."""
    return table(spark, d, "events").select(F.col("user_id").alias("child")).distinct().select("child", F.expr("case when child < 5 then (child + 1) % 5 else child div 10 end").alias("parent"))


CYCLIC = "links AS (SELECT DISTINCT user_id AS child, CASE WHEN user_id < 5 THEN (user_id + 1) % 5 ELSE user_id // 10 END AS parent FROM events)"


def region_links(spark: SparkSession, d: str, prefix: str = "") -> DataFrame:
    """Customers below nations below regions; ids may get a prefix."""
    text = lambda p, c: F.concat(F.lit(prefix + p), F.col(c).cast("string"))
    customers = table(spark, d, "customer").select(text("c", "c_custkey").alias("child"), text("n", "c_nationkey").alias("parent"))
    return customers.unionByName(table(spark, d, "nation").select(text("n", "n_nationkey").alias("child"), text("r", "n_regionkey").alias("parent")))


REGIONS = "links AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def responses(spark: SparkSession, d: str) -> DataFrame:
    """One response per order, with replays: a later provisional one of every seventh, a later exact one of every eleventh.
    One scan: each order is spread to its copies."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("message_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("session_id"),
        F.floor("o_totalprice").cast("long").alias("output"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"), millis("o_orderdate").alias("completed"), F.col("o_orderpriority").alias("model"),
    )
    copy = lambda test, quality, output, later, pos: F.when(test, F.struct(F.lit(quality).alias("quality"), output.cast("long").alias("output"), (F.col("completed") + later).alias("completed"), F.lit(pos).cast("long").alias("pos")))
    key = F.col("message_id")
    copies = F.array(copy(F.lit(True), "exact", F.col("output"), 0, 0), copy(key % 7 == 0, "provisional", F.col("output") * 2, 3_600_000, 1), copy(key % 11 == 0, "exact", F.expr("output div 2"), 7_200_000, 2))
    spread = orders.select("message_id", "session_id", "cost", F.col("completed").alias("start"), "model", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c"))
    return spread.select("message_id", "session_id", "c.quality", "c.output", "cost", "c.completed", "start", "model", "c.pos")


RESPONSES = """orders0 AS (SELECT o_orderkey AS message_id, 'c' || o_custkey AS session_id, floor(o_totalprice)::BIGINT AS output, round(o_totalprice * 100)::BIGINT AS cost,
  epoch_us(o_orderdate) // 1000 AS completed, o_orderpriority AS model FROM orders), responses AS (
  SELECT message_id, session_id, 'exact' AS quality, output, cost, completed, completed AS start, model, 0 AS pos FROM orders0
  UNION ALL SELECT message_id, session_id, 'provisional', output * 2, cost, completed + 3600000, completed, model, 1 FROM orders0 WHERE message_id % 7 = 0
  UNION ALL SELECT message_id, session_id, 'exact', output // 2, cost, completed + 7200000, completed, model, 2 FROM orders0 WHERE message_id % 11 = 0)"""
PREFERRED = """preferred AS (SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY (quality = 'exact') DESC, completed DESC, pos DESC) = 1)"""


def counters(spark: SparkSession, d: str) -> DataFrame:
    """Token counters of each order, from its lines."""
    whole = lambda e: F.sum(F.floor(F.expr(e)).cast("long"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("message_id")).agg(
        whole("l_quantity").alias("input"), whole("l_extendedprice * l_discount").alias("cache_read"), whole("l_extendedprice * l_tax").alias("cache_write"),
        F.sum(F.expr("case when l_returnflag = 'R' then 1 else 0 end")).alias("reasoning"),
    )


COUNTERS = """counters AS (SELECT l_orderkey AS message_id, sum(floor(l_quantity)::BIGINT)::BIGINT AS input, sum(floor(l_extendedprice * l_discount)::BIGINT)::BIGINT AS cache_read,
  sum(floor(l_extendedprice * l_tax)::BIGINT)::BIGINT AS cache_write, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS reasoning FROM lineitem GROUP BY 1)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Work facts of executions (orders): starts and ends of line numbers, with a class by return flag."""
    line = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.lit(0).alias("instance_id"), F.lit("e").alias("execution_id"), F.lit("step").alias("source"), F.lit(None).cast("string").alias("step_id"), F.col("l_linenumber").cast("string").alias("work_id"),
        (F.col("l_partkey") % 80).alias("at"), F.floor("l_quantity").cast("long").alias("took"), F.col("l_returnflag").alias("flag"),
    )
    return line.withColumn("phase", F.lit("start")).withColumn("ts", F.col("at")).unionByName(line.withColumn("phase", F.lit("end")).withColumn("ts", F.col("at") + F.col("took"))).drop("at", "took")


SPANS = """spans AS (SELECT l_orderkey AS session_id, l_linenumber AS work_id, min(l_partkey % 80)::BIGINT AS start, max(l_partkey % 80 + floor(l_quantity)::BIGINT)::BIGINT AS "end",
  bool_or(l_returnflag = 'R') AS maintenance, bool_or(l_returnflag = 'A') AS normal FROM lineitem GROUP BY 1, 2)"""
