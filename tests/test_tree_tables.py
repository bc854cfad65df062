"""Time of trees by tables: nothing is kept or called key by key, and late facts change their own slabs only."""

import contextlib
import io
import json
import random
from collections import Counter

import pandas as pd

from sessiontide.sources import activity
from sessiontide.streaming import trees

from test_trees import Map, Value, put, random_facts


def plan(frame):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        frame.explain()
    return out.getvalue()


def test_streams_hold_no_state_by_key(spark, tmp_path):
    store, check, folder = (str(tmp_path / x) for x in ("store", "check", "in"))
    fact = lambda ts, s: {"sessionID": "s", "executionID": "e", "timestamp": ts, "state": s}
    steps = [[fact(t, "busy" if t % 2 else "idle") for t in range(201)], [fact(100.5, "busy")], [fact(100.5, "busy")], [fact(150.5, "completed")], [fact(300, "busy")]]
    links = spark.createDataFrame([("s", "r")], "child string, parent string")
    sent = []
    for k, part in enumerate(steps):
        put(tmp_path / "in" / f"{k}.jsonl", part)
        trees.keep_spans(activity.stream(spark, folder), store, check, 10.0).awaitTermination()
        sent.append(sorted(tuple(r) for r in spark.read.parquet(f"{store}/spans/batch={k}").collect()))
        if k < 2:
            trees.keep_moves(spark, store, check, links, slab=10.0).awaitTermination()
            trees.keep_lengths(spark, store, check).awaitTermination()
    assert len(sent[0]) == 100
    assert sent[1] == [("s", 100.5, 102.0, 1), ("s", 101.0, 102.0, -1)]
    assert sent[2] == sent[4] == []
    assert all(sign == -1 or end <= 150.5 for _, _, end, sign in sent[3]) and min(start for _, start, _, _ in sent[3]) == 151.0
    last = spark.read.parquet(f"{store}/lengths").filter("batch = 1")
    assert sorted((r["kind"], r["node"], r["slab"], r["length"]) for r in last.collect()) == [("direct", "s", 10, 5.5), ("including", "r", 10, 5.5), ("including", "s", 10, 5.5)]
    assert not list((tmp_path / "check").glob("*/state"))  # of which Python is called for each key
    assert "Python" not in plan(trees._lengths(spark.read.parquet(f"{store}/moves")))


def test_tables_and_state_send_the_same(spark, tmp_path):
    rows = random_facts(random.Random(11), 240)
    batches = [rows[:80], rows[60:160] + rows[:9], rows[160:]]
    store, check, folder = (str(tmp_path / x) for x in ("store", "check", "in"))
    names = ("sessionID", "instanceID", "executionID")
    states = {}
    for k, part in enumerate(batches):
        put(tmp_path / "in" / f"{k}.jsonl", part)
        trees.keep_spans(activity.stream(spark, folder), store, check, 25.0).awaitTermination()
        told = {}
        for n, r in enumerate(part):
            own = {"ts": float(r["timestamp"]), "state": r["state"], "seq": r["seq"], "execution_id": r.get("executionID"), "ended_at": r.get("instanceEndedAt"), "last_observed": r.get("lastObservedAt")}
            told.setdefault(tuple(r.get(c) for c in names), []).append({"session_id": r["sessionID"], "fact": json.dumps(own), "place": f"{n:05}", "same": json.dumps(r)})
        want = Counter()
        for key, facts in told.items():
            if key not in states:
                states[key] = trees.ExecutionSpans(25.0)
                states[key].head, states[key].slabs = Value(), Map()
            for out in states[key].handleInputRows(key, iter([pd.DataFrame(facts)]), None):
                for s, start, end, sign in out.itertuples(index=False):
                    want[s, start] += sign
                    want[s, end] -= sign
        got = Counter()
        for s, start, end, sign in spark.read.parquet(f"{store}/spans/batch={k}").collect():
            got[s, start] += sign
            got[s, end] -= sign
        assert {p: n for p, n in got.items() if n} == {p: n for p, n in want.items() if n} != {}
