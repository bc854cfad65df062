"""Results that don't depend on how rows are dealt to tasks, and plans whose work grows with their rows."""

import contextlib
import io
import random

from sessiontide.operators import ledger, metrics, pending
from sessiontide.sources import events, history


def plan(frame):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        frame.explain()
    return out.getvalue()


def test_sums_of_fractions_have_an_order(spark):
    rng = random.Random(1)
    rows = [(f"s{k % 3}", k, k % 2, rng.randrange(1, 10**6), 0.0, float(rng.randrange(1, 9999))) for k in range(600)]
    want = {}
    for s in ("s0", "s1", "s2"):
        parts = [0.0, 0.0]
        own = [r for r in rows if r[0] == s]
        for r in own:
            parts[r[2]] += r[3] * 1000 / r[5]
        want[s] = (len(own), (parts[0] + parts[1]) / len(own))
    schema = "session_id string, message_id long, pos long, output long, start double, completed double"
    for seed, tasks in ((1, 1), (2, 3), (3, 7)):
        mixed = random.Random(seed).sample(rows, len(rows))
        frame = spark.createDataFrame(mixed, schema).repartition(tasks).selectExpr("*", "cast(null as double) as first_response", "cast(null as double) as ttft", "cast(null as double) as first_token", "cast(null as double) as duration")
        got = metrics.response_stats(frame, part="pos").collect()
        assert {r["session_id"]: (r["calls"], r["avg_speed"]) for r in got} == want
        assert all(r["avg_delay"] == r["min_delay"] == 0.0 for r in got)


def test_names_are_looked_up_in_one_pass(spark):
    fields = "session_id string, message_id string, pos long, completes boolean"
    frame = spark.createDataFrame([("s", None, 1, False), ("s", "m", 2, True), ("s", None, 3, False), ("s", "m", 4, False), ("s", "n", 5, False), ("s", None, 6, False)], fields)
    owned = pending.named(frame)
    assert [(r["pos"], r["owner"], r["taken"]) for r in owned.orderBy("pos").collect()] == [(1, "m", True), (2, "m", False), (3, "n", True), (4, "m", False), (5, "n", False), (6, None, False)]
    assert "unboundedfollowing" not in plan(owned).lower()  # such a frame is gone through once for each of its rows


def test_events_are_dealt_once(spark):
    line = '{"type": "session.step.%s", "id": "%s", "created": %d, "data": {"sessionID": "s", "assistantMessageID": "m", "agent": "%s", "tokens": {"input": 1, "output": 2, "reasoning": 3}}}'
    told = [(line % ("started", "a", 5, "first"), 1), (line % ("ended", "b", 9, "late"), 4), (line % ("ended", "b", 9, "early"), 3), (line % ("started", "a", 5, "first"), 2)]
    frame = spark.createDataFrame(told, "value string, pos long").repartition(3)
    (one,) = events.newer_responses(frame).collect()
    assert (one["agent"], one["start"], one["completed"], one["pos"]) == ("early", 5.0, 9.0, 3)  # the copy that came first, however rows are dealt
    assert len(events.newer_facts(frame).collect()) == 2
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (events.newer_facts(frame), events.newer_responses(frame)):
            assert plan(made).count("Exchange hashpartitioning") == 1
        assert "cacheRead" not in plan(events.newer_facts(frame))  # counters are read for responses alone
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_histories_read_their_lines_once(spark):
    line = '{"version": 1, "messageID": "%s", "sessionID": "s", "quality": "exact", "time": {"start": 1, "completed": %d}%s}'
    live = ', "update": {"source": "live", "instanceID": "i", "sequence": %d, "receivedAt": %d, "fingerprint": "%s", "seenFingerprints": []}'
    told = [(line % ("once", 2, live % (1, 1, "f")), 1), (line % ("plain", 2, ""), 2), (line % ("plain", 9, ""), 3), (line % ("live", 2, live % (1, 1, "f")), 4), (line % ("live", 3, live % (2, 2, "g")), 5), (line % ("live", 4, live % (1, 1, "h")), 6)]
    frame = spark.createDataFrame(told, "value string, pos long").repartition(3)
    kept = ledger.history(history.responses(frame))
    first = plan(kept)
    assert first.count("Exchange hashpartitioning") == first.count("Exchange RoundRobin") == 1
    assert sorted((r["message_id"], r["completed"], r["pos"]) for r in kept.collect()) == [("live", 3.0, 4), ("once", 2.0, 1), ("plain", 9.0, 2)]
