"""Active time of sessions and of all above them, kept up with a stream of facts.

Three streams follow each other; each can also run for itself, as long as it likes:
- spans: facts are kept in slabs of time, with what bounds each execution. New facts change the busy time of their own slabs,
  and what comes out are signed intervals: those that no longer hold and those that hold now.
- moves: signed intervals go to the session itself and to every node above it, cut at the ends of slabs, as signed sums of end
  points. If links or exclusions changed, the sessions at or below a changed link take their time out of the old ancestors and
  into the new ones.
- lengths: where a batch's end points fall, the length of the union is found anew, by node and slab of time.

All of it is joins, sums and sorts of rows in tables of the store; nothing runs key by key. Tables are sorted by slab, and a batch
reads the slabs that its facts touch, never a session's or a tree's whole history; of executions it reads the bounds, one
row a slab and batch. A hot session or root is spread over its slabs. Intervals that are stored are only read again
for sessions below a link that changed. Links and exclusions are tables of one row a session and are compared whole.
"""

from __future__ import annotations

import bisect
import json
import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import activity, forest, precedence
from ..plans.lineage import cut
from ..schema import ACTIVE, TERMINAL
from ..sources import store as stores
from .jobs import arrival

HOUR = 3_600_000.0
SPANS = "session_id {id}, start double, end double, sign long"
MOVES = "kind string, node {id}, slab long, at double, net long, batch long"
#: So many slabs of a batch are named when tables are read; with more, these are read from the first to the last slab.
NAMED_SLABS = 1000


class ExecutionSpans(StatefulProcessor):
    """Busy time of one execution, for `span_changes`. `head` holds what bounds it and the first time stamp of each slab that has facts; `slabs`
    holds a slab's facts as [time stamp, facts], a fact as [its place in order, active, hash of its payload]."""

    def __init__(self, slab: float):
        self.slab = slab

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "value string")
        self.slabs = handle.getMapState("slabs", "slab long", "points string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rows = [r for part in rows for r in part.to_dict("records")]
        session, out = rows[0]["session_id"], Counter()
        head = json.loads(self.head.get()[0]) if self.head.exists() else {"n": 0, "firsts": [], "ended": None, "observed": None, "latest": None, "terminal": None}
        old = {**head, "firsts": list(head["firsts"])}
        facts = sorted((json.loads(r["fact"]) | {"place": r["place"], "same": r["same"]} for r in rows if r["fact"]), key=lambda f: f["place"])
        fresh: dict[int, list[dict]] = {}
        for f in facts:
            fresh.setdefault(math.floor(f["ts"] / self.slab), []).append(f)
        was, now = {}, {}
        for s, new in fresh.items():
            was[s] = self._points(s)
            points = {ts: list(own) for ts, own in was[s]}
            for f in new:
                own = points.setdefault(f["ts"], [])
                if all(p[2] != f["same"] for p in own):  # a payload counts once, when it first came
                    head["n"] += 1
                    own.append([self._order(f, head["n"]), f["state"] in ACTIVE, f["same"]])
                    self._bound(head, f)
            now[s] = sorted([ts, own] for ts, own in points.items())
        firsts = dict(old["firsts"]) | {s: points[0][0] for s, points in now.items()}
        head["firsts"] = sorted([s, ts] for s, ts in firsts.items())
        for s in self._touched(old, head, set(fresh)):
            before, after = was.get(s), now.get(s)
            if before is None:
                before = after = self._points(s)
            out.subtract(self._segments(before, self._then(old, s), self._cut(old)))
            out.update(self._segments(after, self._then(head, s), self._cut(head)))
        for s, points in now.items():
            if points != was[s]:
                self.slabs.updateValue((s,), (json.dumps(points),))
        if facts:
            self.head.update((json.dumps(head),))
        found = [(session, *span, sign) for span, sign in sorted(out.items()) if sign]
        if not found and len(facts) < len(rows):
            found = [(session, None, None, 0)]  # only tells that a link may have changed
        yield pd.DataFrame(found, columns=["session_id", "start", "end", "sign"])

    def _points(self, slab: int) -> list:
        return json.loads(self.slabs.getValue((slab,))[0]) if self.slabs.containsKey((slab,)) else []

    @staticmethod
    def _order(f: dict, n: int) -> list:
        given = lambda x: [0, 0] if x is None else [1, x]
        return [*given(f.get("source_sequence")), *given(f.get("seq")), n]

    @staticmethod
    def _bound(head: dict, f: dict) -> None:
        for name, value, pick in (
            ("ended", f.get("ended_at"), min), ("observed", f.get("last_observed"), max), ("latest", f["ts"], max),
            ("terminal", f["ts"] if f["state"] in TERMINAL and f.get("execution_id") is not None else None, min),
        ):
            if value is not None:
                head[name] = value if head[name] is None else pick(head[name], value)

    @staticmethod
    def _cut(head: dict) -> float:
        """Nothing is busy from here on: a terminal state, or the boundary."""
        proved = [head[c] for c in ("ended", "observed") if head[c] is not None]
        boundary = min(proved) if proved else head["latest"]
        ends = [x for x in (boundary, head["terminal"]) if x is not None]
        return min(ends) if ends else -math.inf

    @staticmethod
    def _then(head: dict, slab: int) -> float:
        """The first time stamp after a slab."""
        k = bisect.bisect_right(head["firsts"], slab, key=lambda x: x[0])
        return head["firsts"][k][1] if k < len(head["firsts"]) else math.inf

    def _touched(self, old: dict, new: dict, fresh: set[int]) -> set[int]:
        """Slabs with new facts, those before them, and all whose time lies between the old cut and the new one."""
        order = [s for s, _ in new["firsts"]]
        out = set(fresh)
        for s in fresh:
            k = bisect.bisect_left(order, s)
            out |= set(order[max(k - 1, 0) : k])
        lo, hi = sorted((self._cut(old), self._cut(new)))
        if lo < hi:
            first = 0 if lo == -math.inf else max(bisect.bisect_left(order, math.floor(lo / self.slab)) - 1, 0)
            out |= set(order[first : bisect.bisect_right(order, math.floor(hi / self.slab))])
        return out

    @staticmethod
    def _segments(points: list, then: float, cut_: float) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for k, (ts, own) in enumerate(points):
            end = min(points[k + 1][0] if k + 1 < len(points) else then, cut_)
            if max(own)[1] and end > ts:
                if out and out[-1][1] == ts:
                    out[-1] = (out[-1][0], end)
                else:
                    out.append((ts, end))
        return out

    def close(self) -> None:
        pass


def span_changes(stream: DataFrame, slab: float = HOUR) -> DataFrame:
    """(session_id, start, end, sign): busy time that comes and goes with a stream of facts, delivered any number of times and
    in any order, as a stream without a store: state is held by execution, at a call of Python for each one in a batch, so
    `keep_spans` is for much data. Facts without a session or a time stamp are left out; those that are no lifecycle facts pass as sign 0."""
    kind = stream.schema["session_id"].dataType.simpleString()
    own = [c for c in ("state", "ts", "seq", "source_sequence", "execution_id", "ended_at", "last_observed") if c in stream.columns]
    number = lambda c: F.col(c).cast("double").alias(c) if c in ("ts", "ended_at", "last_observed") else F.col(c)
    rows = stream.filter("session_id is not null and ts is not null").select(
        F.to_json(F.struct(*activity.EXECUTION), {"ignoreNullFields": "false"}).alias("execution"), "session_id",
        arrival(stream.schema).alias("place"), F.xxhash64(*(c for c in stream.columns if c != "pos")).cast("string").alias("same"),
        F.when(F.col("kind") == "lifecycle", F.to_json(F.struct(*map(number, own)))).alias("fact"),
    )
    return rows.groupBy("execution").transformWithStateInPandas(ExecutionSpans(slab), SPANS.format(id=kind), "append", "None")


# --- spans from tables


def _in_slabs(table: DataFrame, touched: DataFrame) -> DataFrame:
    """The rows of a table in the slabs that stand in another; readers skip the pages of other slabs."""
    named = [r["slab"] for r in touched.select("slab").distinct().limit(NAMED_SLABS + 1).collect()]
    if len(named) <= NAMED_SLABS:
        return table.filter(F.col("slab").isin(named))
    first, last = touched.agg(F.min("slab"), F.max("slab")).first()
    return table.filter(F.col("slab").between(first, last))


def _as_placed(batch: DataFrame, number: int, slab: float) -> DataFrame:
    """The lifecycle facts of a batch as they are stored, with their slab and what orders and bounds them."""
    given = lambda c: F.col(c) if c in batch.columns else F.lit(None).cast("double").alias(c)
    terminal = F.col("state").isin(*TERMINAL) & F.col("execution_id").isNotNull()
    ts = F.col("ts").cast("double")
    return batch.filter("kind = 'lifecycle'").select(
        *activity.EXECUTION, F.floor(ts / F.lit(slab)).alias("slab"), ts.alias("ts"), given("source_sequence"), given("seq"),
        F.struct(F.lit(number).cast("long").alias("batch"), arrival(batch.schema).alias("place")).alias("arrival"), F.xxhash64(*(c for c in batch.columns if c != "pos")).alias("same"),
        F.coalesce(F.col("state").isin(*ACTIVE), F.lit(False)).alias("active"), given("ended_at").cast("double").alias("ended"), given("last_observed").cast("double").alias("observed"), F.when(terminal, ts).alias("terminal"),
    )


BOUNDS = {"first": F.min, "ended": F.min, "observed": F.max, "latest": F.max, "terminal": F.min}


def _heads(facts: DataFrame) -> DataFrame:
    """(execution, slab, first, ended, observed, latest, terminal): what facts say of an execution, by slab."""
    return facts.withColumns({"first": F.col("ts"), "latest": F.col("ts")}).groupBy(*activity.EXECUTION, "slab").agg(*(f(c).alias(c) for c, f in BOUNDS.items()))


def _touched(held: DataFrame, new: DataFrame) -> DataFrame:
    """(execution, slab, then_old, cut_old, then_new, cut_new): slabs whose busy time new heads may change. `then` is the first time stamp after
    the slab; from `cut` on, a terminal state or the boundary, nothing is busy.

    These are slabs with new facts, those before them, and all whose time lies between the old cut and the new one.
    """
    rows = held.select(*activity.EXECUTION, "slab", *BOUNDS, F.lit(False).alias("fresh")).unionByName(new.select(*activity.EXECUTION, "slab", *BOUNDS, F.lit(True).alias("fresh")))
    was = lambda c: F.when(~F.col("fresh"), F.col(c))
    slabs = rows.groupBy(*activity.EXECUTION, "slab").agg(*(f(was(c)).alias(f"{c}_old") for c, f in BOUNDS.items()), *(f(c).alias(f"{c}_new") for c, f in BOUNDS.items()), F.max("fresh").alias("fresh"))
    whole = Window.partitionBy(*activity.EXECUTION)
    later = whole.orderBy(F.col("slab").desc()).rowsBetween(Window.unboundedPreceding, -1)
    for v in ("old", "new"):
        bound = {c: f(f"{c}_{v}").over(whole) for c, f in BOUNDS.items()}
        cut_ = F.least(F.coalesce(F.least(bound["ended"], bound["observed"]), bound["latest"]), bound["terminal"])
        slabs = slabs.withColumns({f"then_{v}": F.min(f"first_{v}").over(later), f"cut_{v}": cut_})
    between = (F.col("cut_old") != F.col("cut_new")) & (F.greatest("cut_old", "cut_new") > F.col("first_new")) & F.coalesce(F.least("cut_old", "cut_new") < F.col("then_new"), F.lit(True))
    changed = F.col("fresh") | ~F.col("then_old").eqNullSafe(F.col("then_new")) | F.coalesce(between, F.lit(False))
    return slabs.filter(changed).select(*activity.EXECUTION, "slab", "then_old", "cut_old", "then_new", "cut_new")


def _span_changes(facts: DataFrame, touched: DataFrame, number: int) -> DataFrame:
    """(session_id, start, end, sign): busy time in touched slabs before a batch, as no longer held, and with it; what is the same in both
    falls out. `facts` are all facts of these slabs."""
    key = [*activity.EXECUTION, "slab"]
    # a payload counts once, when it first came; of all at one time stamp the last one in order holds
    once = facts.groupBy(*key, "ts", "same", "source_sequence", "seq", "active").agg(F.min("arrival").alias("arrival"))
    order = F.struct("source_sequence", "seq", "arrival", "active")
    points = once.groupBy(*key, "ts").agg(F.max(F.when(F.col("arrival.batch") < number, order)).getField("active").alias("old"), F.max(order).getField("active").alias("new"))
    version = F.explode(F.array(*(F.struct(F.lit(sign).alias("sign"), F.col(v).alias("active")) for v, sign in (("old", -1), ("new", 1)))))
    states = points.select(*key, "ts", version.alias("v")).select(*key, "ts", "v.sign", "v.active").filter("active is not null")
    by = Window.partitionBy(*key, "sign").orderBy("ts")
    turns = states.withColumn("was", F.lag("active", 1, False).over(by)).filter("active <> was").withColumn("next", F.lead("ts").over(by))
    bounded = activity.joined(turns.filter("active"), touched, key, "inner")
    then, cut_ = (F.when(F.col("sign") < 0, F.col(f"{c}_old")).otherwise(F.col(f"{c}_new")) for c in ("then", "cut"))
    spans = bounded.select(*key, F.col("ts").alias("start"), F.least(F.coalesce("next", then), cut_).alias("end"), "sign").filter(F.col("end") > F.col("start"))
    return spans.groupBy(*key, "start", "end").agg(F.sum("sign").alias("sign")).filter("sign <> 0").select("session_id", "start", "end", "sign")


# --- links and exclusions


def _version(spark: SparkSession, store: str, before: int) -> int | None:
    """The last version of links and exclusions that was stored before a batch."""
    found = [int(p.rsplit("=", 1)[1]) for p in stores.children(spark, f"{store}/places")]
    return max((n for n in found if n < before), default=None)


def _place(spark: SparkSession, store: str, version: int, name: str) -> DataFrame:
    return spark.read.parquet(f"{store}/places/version={version}/{name}")


def _store_places(links: DataFrame, evidence: DataFrame, store: str, version: int) -> None:
    outer, of = forest.contracted(links)
    for name, df in {"links": links, "evidence": evidence, "outer": outer, "of": of, "gone": forest.excluded(links, evidence)}.items():
        df.write.mode("overwrite").parquet(f"{store}/places/version={version}/{name}")


def _moved(spark: SparkSession, store: str, version: int, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id): those whose link or evidence is another than in a version."""
    one = links.select("child", F.col("parent").alias("new"))
    other = _place(spark, store, version, "links").select("child", F.col("parent").alias("old"))
    moved = one.join(other, "child", "full").filter(~F.col("new").eqNullSafe(F.col("old"))).select(F.col("child").alias("id"))
    known = _place(spark, store, version, "evidence")
    return moved.union(evidence.join(known, "id", "left_anti")).union(known.join(evidence, "id", "left_anti")).distinct()


def _points(spans: DataFrame, spark: SparkSession, store: str, version: int, slab: float, sign: int = 1) -> DataFrame:
    """Signed end points by session and by each node at or above it, cut at the ends of slabs; nothing for excluded sessions."""
    ids = spans.select(F.col("session_id").alias("id")).distinct().join(_place(spark, store, version, "gone"), "id", "left_anti")
    heads = cut(ids.join(_place(spark, store, version, "of"), "id", "left").select("id", F.coalesce("node", "id").alias("node")))
    above = forest.ancestors(heads.select(F.col("node").alias("id")).distinct(), _place(spark, store, version, "outer"))
    nodes = heads.select("id", F.lit("direct").alias("kind"), F.col("id").alias("node")).unionByName(
        heads.join(above.withColumnRenamed("id", "node"), "node").select("id", F.lit("including").alias("kind"), F.col("ancestor").alias("node"))
    )
    width = F.lit(slab)
    pieces = spans.withColumn("slab", F.explode(F.sequence(F.floor(F.col("start") / width), F.ceil(F.col("end") / width) - 1)))
    pieces = pieces.select("session_id", "slab", "sign", F.greatest("start", F.col("slab") * width).alias("start"), F.least("end", (F.col("slab") + 1) * width).alias("end"))
    end: list[Column] = [F.struct(F.col(c).alias("at"), (F.col("sign") * (s * sign)).alias("net")) for c, s in (("start", 1), ("end", -1))]
    own = pieces.select("session_id", "slab", F.explode(F.array(*end)).alias("p")).groupBy("session_id", "slab", "p.at").agg(F.sum("p.net").alias("net")).filter("net <> 0")
    return own.join(nodes.withColumnRenamed("id", "session_id"), "session_id").select("kind", "node", "slab", "at", "net")


# --- the streams


def keep_spans(stream: DataFrame, store: str, checkpoint: str, slab: float = HOUR) -> StreamingQuery:
    """Stores facts by slab and writes by which busy time a batch changes what was stored before it; equal payloads count once, whenever they come.
    Facts without a session or a time stamp are left out; sessions with others than lifecycle facts pass as sign 0."""
    kind = stream.schema["session_id"].dataType.simpleString()

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        done = f"{store}/spans/batch={number}"
        if stores.exists(session, done):
            return
        rows = batch.filter("session_id is not null and ts is not null")
        _as_placed(rows, number, slab).sortWithinPartitions("slab").write.mode("overwrite").parquet(f"{store}/facts/batch={number}")
        placed = session.read.parquet(f"{store}/facts/batch={number}")
        _heads(placed).sortWithinPartitions("session_id").write.mode("overwrite").parquet(f"{store}/heads/batch={number}")
        stored = lambda name: session.read.schema(session.read.parquet(f"{store}/{name}/batch={number}").schema.add("batch", "long")).parquet(f"{store}/{name}")
        heads = session.read.parquet(f"{store}/heads/batch={number}")
        held = activity.joined(stored("heads").filter(F.col("batch") < number), heads.select(*activity.EXECUTION).distinct(), activity.EXECUTION, "left_semi")
        touched = cut(_touched(held, heads))
        facts = _in_slabs(stored("facts").filter(F.col("batch") <= number), touched)
        changes = _span_changes(activity.joined(facts, touched, [*activity.EXECUTION, "slab"], "left_semi"), touched, number)
        others = rows.filter("not kind <=> 'lifecycle'").select("session_id", F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(0).cast("long").alias("sign")).distinct()
        changes.unionByName(others).write.mode("overwrite").parquet(f"{store}/spans-new/batch={number}")
        stores.move(session, f"{store}/spans-new/batch={number}", done)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/spans").trigger(availableNow=True).start()


def keep_moves(spark: SparkSession, store: str, checkpoint: str, links: DataFrame, without: DataFrame | None = None, slab: float = HOUR) -> StreamingQuery:
    """Sends signed intervals up the links as they stand: `links` (child, parent), one a child, and `without` (id), sessions that
    are left out with all below them. A change of either takes effect with the next batch. A batch's end points appear by one
    rename, and a batch that is run again finds them there."""
    proper = forest.edges(links)
    evidence = (without.select("id") if without is not None else proper.select(F.col("child").alias("id")).limit(0)).filter("id is not null").distinct()

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        done = f"{store}/moves/batch={number}"
        if stores.exists(session, done):
            return
        batch.filter("sign <> 0").write.mode("overwrite").parquet(f"{store}/seen/batch={number}")
        spans = session.read.schema(batch.schema).parquet(f"{store}/seen/batch={number}")
        prior = _version(session, store, number)
        if prior is None:
            _store_places(proper, evidence, store, number)
            out = _points(spans, session, store, number, slab)
        else:
            out = _points(spans, session, store, prior, slab)
            moved = cut(_moved(session, store, prior, proper, evidence))
            if not moved.isEmpty():
                _store_places(proper, evidence, store, number)
                below = [forest.excluded(_place(session, store, v, "links"), moved) for v in (prior, number)]
                affected = cut(below[0].union(below[1]).distinct())
                seen = session.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).parquet(f"{store}/seen")
                held = seen.filter(F.col("batch") <= number).join(affected.withColumnRenamed("id", "session_id"), "session_id", "left_semi")
                held = cut(held.groupBy("session_id", "start", "end").agg(F.sum("sign").alias("sign")).filter("sign <> 0"))
                out = out.unionByName(_points(held, session, store, prior, slab, -1)).unionByName(_points(held, session, store, number, slab))
        summed = out.groupBy("kind", "node", "slab", "at").agg(F.sum("net").alias("net")).filter("net <> 0")
        summed.sortWithinPartitions("slab").write.mode("overwrite").parquet(f"{store}/moves-new/batch={number}")
        stores.move(session, f"{store}/moves-new/batch={number}", done)

    kind = spark.read.parquet(f"{store}/spans").schema["session_id"].dataType.simpleString()
    stream = spark.readStream.schema(SPANS.format(id=kind)).parquet(f"{store}/spans/batch=*")
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/moves").trigger(availableNow=True).start()


def _lengths(moves: DataFrame) -> DataFrame:
    """(kind, node, slab, length): length of the union of all that is busy at or below a node in a slab, from signed end points."""
    key = ["kind", "node", "slab"]
    points = moves.repartition(*key).groupBy(*key, "at").agg(F.sum("net").alias("net")).filter("net <> 0")
    by = Window.partitionBy(*key).orderBy("at")
    opened = points.withColumn("open", F.sum("net").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(by))
    return opened.groupBy(*key).agg(F.sum(F.when(F.col("open") > 0, F.col("next") - F.col("at")).otherwise(0.0)).alias("length"))


def keep_lengths(spark: SparkSession, store: str, checkpoint: str) -> StreamingQuery:
    """Writes the length of each node and slab that a batch's end points touch, from all end points there; the last one counts."""
    kind = spark.read.parquet(f"{store}/spans").schema["session_id"].dataType.simpleString()
    schema = MOVES.format(id=kind)

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        touched = cut(batch.groupBy("kind", "node", "slab").agg(F.max("batch").alias("last")))
        last = touched.agg(F.max("last")).first()[0]
        if last is None:
            return
        moves = _in_slabs(session.read.schema(schema).parquet(f"{store}/moves").filter(F.col("batch") <= last), touched)
        found = _lengths(moves.join(touched, ["kind", "node", "slab"], "left_semi"))
        # where all time is gone, no end point is left
        out = touched.join(found, ["kind", "node", "slab"], "left").select("kind", "node", "slab", F.coalesce("length", F.lit(0.0)).alias("length"))
        out.write.mode("overwrite").parquet(f"{store}/lengths/batch={number}")

    stream = spark.readStream.schema(schema).option("basePath", f"{store}/moves").parquet(f"{store}/moves/batch=*")
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/lengths").trigger(availableNow=True).start()


def keep_task_time(stream: DataFrame, store: str, checkpoint: str, links: DataFrame, without: DataFrame | None = None, slab: float = HOUR) -> None:
    """All three streams over what is there now. `read_task_time` gives what they add up to: that of `activity.task_time` over
    the busy time of all facts so far, with links and exclusions as they stood at the last batch. The width of slabs is fixed for a store."""
    spark = stream.sparkSession
    keep_spans(stream, store, checkpoint, slab).awaitTermination()
    if stores.exists(spark, f"{store}/spans"):
        keep_moves(spark, store, checkpoint, links, without, slab).awaitTermination()
    if stores.exists(spark, f"{store}/moves"):
        keep_lengths(spark, store, checkpoint).awaitTermination()


def read_task_time(spark: SparkSession, store: str) -> DataFrame:
    """(id, root, direct, including) of all sessions with active time at or below them."""
    version = _version(spark, store, 1 << 62)
    lasting = spark.read.parquet(f"{store}/lengths").groupBy("kind", "node", "slab").agg(F.max_by("length", "batch").alias("length"))
    sums = lasting.groupBy("kind", "node").agg(F.sum("length").alias("length")).filter("length <> 0")
    direct = sums.filter("kind = 'direct'").select(F.col("node").alias("id"), F.col("length").alias("direct"))
    of = _place(spark, store, version, "of")
    of = of.unionByName(direct.join(of, "id", "left_anti").select("id", F.col("id").alias("node")))
    whole = sums.filter("kind = 'including'").select("node", F.col("length").alias("including"))
    found = of.join(whole, "node").join(direct, "id", "left")
    roots = forest.roots(_place(spark, store, version, "links"), of.select("id"))
    return found.join(roots, "id", "left").select("id", "root", F.coalesce("direct", F.lit(0.0)).alias("direct"), "including")


def task_time(facts: DataFrame, links: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """The same as one batch job."""
    busy = activity.lifecycle_intervals(precedence.distinct_facts(facts.filter("kind = 'lifecycle' and session_id is not null")))
    return activity.task_time(busy, links, without)
