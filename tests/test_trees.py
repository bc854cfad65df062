"""Time of trees kept up with a stream ends as the batch, whatever comes late, twice, or moves."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from sessiontide.operators import forest
from sessiontide.sources import activity
from sessiontide.streaming import trees


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def listed(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def random_facts(rng, n):
    rows = []
    for k in range(n):
        row = {"sessionID": f"s{min(rng.randrange(7), rng.randrange(7))}", "timestamp": rng.randrange(400), "seq": k, "state": rng.choice(["busy", "busy", "retry", "idle", "idle", "completed"] if k % 9 == 0 else ["busy", "busy", "retry", "idle"])}
        if k % 3:
            row |= {"executionID": f"e{rng.randrange(3)}", "instanceID": f"i{rng.randrange(2)}"}
        if rng.random() < 0.04:
            row["instanceEndedAt"] = rng.randrange(200, 500)
        if rng.random() < 0.04:
            row["lastObservedAt"] = rng.randrange(200, 500)
        rows.append(row)
    return rows


def test_tree_time_ends_as_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = random_facts(rng, 150)
    chain = [("s1", "s0"), ("s2", "s1"), ("s3", "s1"), ("s5", "s4"), ("s6", None)]
    moved = [("s1", "s5"), ("s2", "s1"), ("s3", "s3"), ("s5", "s4"), ("s6", "s2")]
    ring = [("s1", "s2"), ("s2", "s1"), ("s3", "s1"), ("s5", "s4"), ("s6", "s2")]
    steps = [
        (rows[:90], chain, []),
        (rows[90:] + rows[:20], moved, ["s4"]),  # some are delivered twice; s1 and all below it come under an excluded session
        ([{"sessionID": "s6", "timestamp": 1, "parentSessionID": "s2"}], ring, ["s3", "s9"]),  # a cycle, and no new time
    ]
    store, check, folder = (str(tmp_path / x) for x in ("store", "check", "in"))
    for k, (part, links, gone) in enumerate(steps):
        put(tmp_path / "in" / f"{k}.jsonl", part)
        links = spark.createDataFrame(links, "child string, parent string")
        gone = spark.createDataFrame([(g,) for g in gone], "id string")
        trees.keep_task_time(activity.stream(spark, folder), store, check, links, gone, 25.0)
        if k == 0:
            continue
        facts = activity.read(spark, folder).withColumn("pos", F.col("seq"))
        want = trees.task_time(facts, links, gone)
        got = trees.read_task_time(spark, store)
        assert listed(got, "id", "direct", "including") == listed(want, "id", "direct", "including")
        assert want.count() > 1
    roots = dict(listed(forest.roots(links, facts.select("session_id")), "id", "root"))
    assert all(r["root"] == roots[r["id"]] for r in got.collect())
    # a batch reads what it touches: the time of sessions that did not move is not sent again
    sent = spark.read.parquet(f"{store}/moves").groupBy("batch", "kind").agg(F.countDistinct("node").alias("n"))
    first = {r["batch"]: r["n"] for r in sent.filter("kind = 'direct'").collect()}
    assert first[0] >= 5 and len(first) == len(steps)


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    touched = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        self.touched += 1
        return self[key]

    def updateValue(self, key, value):
        self[key] = value


def test_late_facts_touch_their_slabs_only():
    state = trees.ExecutionSpans(10.0)
    state.head, state.slabs = Value(), Map()

    def send(*facts):
        rows = pd.DataFrame([{"session_id": "s", "fact": json.dumps(f), "place": f"{k:03}", "same": json.dumps(f)} for k, f in enumerate(facts)])
        return [tuple(r) for part in state.handleInputRows(("k",), iter([rows]), None) for r in part.itertuples(index=False)]

    fact = lambda ts, s: {"ts": float(ts), "state": s, "execution_id": "e"}
    send(*(fact(t, "busy" if t % 2 else "idle") for t in range(1001)))
    state.slabs.touched = 0
    assert send(fact(500.5, "busy")) == [("s", 500.5, 502.0, 1), ("s", 501.0, 502.0, -1)]
    assert state.slabs.touched <= 3
    assert send(fact(500.5, "busy")) == []
    gone = send(fact(900.5, "completed"))
    assert gone and all(sign == -1 or end <= 900.5 for _, _, end, sign in gone) and min(start for _, start, _, _ in gone) <= 901
    assert send(fact(1200, "busy")) == []
