"""Streams of facts and responses. Late rows may come at any time. Usage is kept as state by message, from which signed changes
of session sums follow; active time is computed anew for what a batch touches. A stream ends with the same numbers as a batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pyspark.sql.types import StructType

from ..operators import activity, intervals, ledger, precedence
from ..schema import ACTIVE, EXCLUDED_ITEM, EXCLUDED_SESSION, TERMINAL, TOKENS
from ..sources import store as stores

BUCKETS = 64


def bucket(column: str = "session_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def session_time(facts: DataFrame) -> DataFrame:
    """(session_id, n, length) of active time."""
    facts = facts.filter("kind = 'lifecycle'")
    own = intervals.union(activity.lifecycle_intervals(precedence.distinct_facts(facts)), ["session_id"])
    return own.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("length"))


def keep(stream: DataFrame, store: str, checkpoint: str, key: str, compute: dict[str, Callable[[DataFrame], DataFrame]], buckets: int = BUCKETS) -> StreamingQuery:
    """Stores a stream's rows by bucket of a key under the batch's number, and computes anew what a batch's buckets hold.

    A batch that is run again overwrites its own files, so each row is stored once per delivery and replays change nothing.
    Rows may be as late as they like; the order of rows is by batch, then as they stand in it.
    `compute` names tables and says how they follow from all rows of a bucket; with more
    buckets a batch reads less of what is stored, so their number is to grow with the history. It is fixed for a store.
    A bucket for which nothing is left any more loses its rows.
    """
    place = bucket(key, buckets)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = F.struct(F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row"))
        batch.withColumn("pos", order).withColumn("bucket", place).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/rows/batch={number}")
        touched = [r["bucket"] for r in batch.select(place.alias("bucket")).distinct().collect()]  # `buckets` at most
        if not touched:
            return
        rows = spark.read.option("basePath", f"{store}/rows").parquet(f"{store}/rows").filter(F.col("bucket").isin(touched) & (F.col("batch") <= number))
        for name, job in compute.items():
            out = job(rows.drop("batch", "bucket")).withColumn("bucket", place)
            for b in touched:
                stores.remove(spark, f"{store}/{name}/bucket={b}")
            out.write.mode("append").partitionBy("bucket").parquet(f"{store}/{name}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_session_time(stream: DataFrame, store: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Active time of sessions from a stream of facts."""
    return keep(stream, store, checkpoint, "session_id", {"time": session_time}, buckets)


class UsageState(StatefulProcessor):
    """What one message contributes. Its records come in order of arrival and are folded with what is held; what comes out
    are signed differences: the contribution that no longer holds is taken back from its session, the new one is added to its own."""

    def __init__(self, measures: tuple[str, ...]):
        self.measures = measures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = json.loads(self.held.get()[0]) if self.held.exists() else {"effective": None, "record": None, "gone": False}
        before = state["effective"]
        new = [json.loads(r) for r in pd.concat(list(rows)).sort_values("place")["record"]]
        gone = state["gone"] or any(r["scope"] in (EXCLUDED_ITEM, EXCLUDED_SESSION) for r in new)
        after = None if gone else ledger.fold([*([before] if before else []), *new])
        record = ledger.fold_history([*([state["record"]] if state["record"] else []), *new])
        self.held.update((json.dumps({"effective": after, "record": record, "gone": gone}),))
        out = [(key[0], "record", record["session_id"], 0, json.dumps(record), *(0.0 for _ in self.measures))]
        amounts = lambda r: (r["session_id"], *((r[c] or 0.0) for c in self.measures))
        if (amounts(before) if before else None) != (amounts(after) if after else None):
            for sign, r in ((-1, before), (1, after)):
                if r:
                    out.append((key[0], "sum", r["session_id"], sign, None, *(sign * (r[c] or 0.0) for c in self.measures)))
        yield pd.DataFrame(out, columns=["message_id", "kind", "session_id", "calls", "record", *self.measures])

    def close(self) -> None:
        pass


MEASURES = (*TOKENS, "cost")
#: State in RocksDB lives on local disks and in the checkpoint, not in the executors' heap.
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrival(schema: StructType) -> Column:
    """A batch's order as text, from a `pos` that is a number or a place in a file."""
    if isinstance(schema["pos"].dataType, StructType):
        return F.to_json(F.struct(F.struct(F.col("pos.file"), F.format_string("%020d", F.col("pos.at"))).alias("p")))
    return F.format_string("%020d", F.col("pos"))


def usage_changes(stream: DataFrame) -> DataFrame:
    """Signed changes of session sums, and each message's record, from a stream of responses whose `pos` orders the rows of a batch."""
    rows = stream.select("message_id", arrival(stream.schema).alias("place"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record")).filter("message_id is not null")
    schema = f"message_id string, kind string, session_id string, calls long, record string, {', '.join(f'{c} double' for c in MEASURES)}"
    return rows.groupBy("message_id").transformWithStateInPandas(UsageState(MEASURES), schema, "append", "None")


def keep_usage(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """History and session sums from a stream of responses. State is held by message, so a batch touches its own messages
    only: one that moves to another session or is excluded later takes its amounts back. Each batch's changes overwrite
    their own files, so replays and restarts change nothing. `read_totals` and `read_history` give what they add up to."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{store}/changes/batch={number}")

    return usage_changes(stream).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _changes(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.option("basePath", f"{store}/changes").parquet(f"{store}/changes")


def read_totals(spark: SparkSession, store: str) -> DataFrame:
    """(session_id, calls, tokens, cost): the sums of all changes; sessions to which no call belongs any more have none."""
    summed = _changes(spark, store).filter("kind = 'sum'").groupBy("session_id").agg(*(F.sum(c).alias(c) for c in ("calls", *MEASURES)))
    return summed.filter("calls <> 0")


def read_history(spark: SparkSession, store: str, schema: StructType | str) -> DataFrame:
    """The history: each message's record of the last batch that had one."""
    last = _changes(spark, store).filter("kind = 'record'").groupBy("message_id").agg(F.max_by("record", "batch").alias("record"))
    return last.select(F.from_json("record", schema).alias("r")).select("r.*")


def read_session_time(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/time").drop("bucket")


class LifecycleState(StatefulProcessor):
    """Opens and closes busy time per execution as its facts come in order; emits each closed interval once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "opened double, ended boolean, last double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        opened, ended, last = self.held.get() if self.held.exists() else (None, False, None)
        out = []
        facts = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for ts, state in zip(facts["ts"], facts["state"], strict=True):
            if last is not None and ts < last:
                continue  # the exact job takes late facts
            last = ts
            if state in ACTIVE and not ended:
                opened = ts if opened is None else opened
            elif opened is not None and state not in ACTIVE:
                out.append((*key, opened, ts))
                opened = None
            ended = ended or (state in TERMINAL and key[2] is not None)
        self.held.update((opened, ended, last))
        yield pd.DataFrame(out, columns=["session_id", "instance_id", "execution_id", "start", "end"])

    def close(self) -> None:
        pass


def interval_stream(stream: DataFrame) -> DataFrame:
    """Closed busy intervals with low delay; needs the RocksDB state store."""
    return stream.filter("kind = 'lifecycle'").groupBy("session_id", "instance_id", "execution_id").transformWithStateInPandas(
        LifecycleState(), "session_id string, instance_id string, execution_id string, start double, end double", "append", "None"
    )
