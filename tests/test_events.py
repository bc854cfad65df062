"""Host events as facts and responses, and folds of histories."""

import json
import random

from pyspark.sql import functions as F

from sessiontide.functions.leaves import Leaves
from sessiontide.operators import ledger
from sessiontide.sources import events


def rows(spark, items):
    df = spark.createDataFrame([(json.dumps(x), k) for k, x in enumerate(items)], "t string, pos long")
    return df.select(F.col("t").alias("value"), "pos")


def ev(kind, seq, **data):
    return {"type": f"session.{kind}", "id": f"e{seq}", "created": 100.0 * seq, "durable": {"seq": seq}, "data": {"sessionID": "s", **data}}


STORY = [
    ev("created", 1, parentID="p"),
    ev("execution.started", 2),
    ev("step.started", 3, assistantMessageID="m", agent="build", model={"id": "x"}, started=250),
    ev("tool.called", 4, assistantMessageID="m", id="t"),
    ev("tool.success", 5, assistantMessageID="m", id="t"),
    ev("step.ended", 6, assistantMessageID="m", tokens={"input": 5, "output": 3, "cache": {"read": 2, "write": 1}}, cost=0.25),
    ev("execution.succeeded", 7),
    ev("execution.started", 8),
    ev("step.failed", 9, assistantMessageID="n"),
    ev("execution.interrupted", 10),
    {"type": "session.text.delta", "id": "c", "data": {"sessionID": "s"}},
]


def test_newer_events(spark):
    order = STORY + STORY[3:7]
    random.Random(1).shuffle(order)
    facts = events.newer_facts(rows(spark, order)).collect()
    life = sorted((r["ts"], r["state"], r["execution_id"]) for r in facts if r["kind"] == "lifecycle")
    assert life == [(200, "busy", "e2"), (700, "completed", "e2"), (800, "busy", "e8"), (1000, "aborted", "e8")]
    work = sorted((r["ts"], r["source"], r["work_id"], r["phase"], r["execution_id"], r["step_id"]) for r in facts if r["kind"] == "work")
    assert work == [(250, "step", "m", "start", "e2", None), (400, "tool", "t", "start", "e2", "m"), (500, "tool", "t", "end", "e2", "m"), (600, "step", "m", "end", "e2", None), (900, "step", "n", "end", "e8", None)]
    assert [r["parent_id"] for r in facts if r["kind"] == "parent"] == ["p"]
    (one,) = events.newer_responses(rows(spark, order)).collect()
    assert (one["message_id"], one["agent"], one["model"], one["input"], one["output"], one["cache_read"], one["cache_write"], one["cost"], one["start"], one["completed"]) == ("m", "build", "x", 5, 3, 2, 1, 0.25, 250, 600)


def test_older_events(spark):
    items = [
        {"type": "session.status", "timestamp": 1, "properties": {"sessionID": "s", "status": {"type": "busy"}}},
        {"type": "session.idle", "timestamp": 2, "properties": {"sessionID": "s"}},
        {"type": "session.status", "timestamp": 3, "replay": True, "properties": {"sessionID": "s", "status": {"type": "busy"}}},
        {"type": "session.updated", "timestamp": 4, "properties": {"info": {"id": "s", "parentID": "p"}}},
        {"type": "message.updated", "timestamp": 5, "properties": {"info": {"id": "m", "sessionID": "s", "parentID": "not a session", "completed": True}}},
        {"type": "message.part.delta", "timestamp": 6, "properties": {"sessionID": "s"}},
    ]
    got = sorted((r["ts"], r["kind"], r["state"], r["parent_id"]) for r in events.older_facts(rows(spark, items)).collect())
    assert got == [(1, "lifecycle", "busy", None), (2, "lifecycle", "idle", None), (4, "parent", None, "p")]
    leaves = Leaves()
    completed = events.is_completed(leaves)
    assert [r["c"] for r in leaves.over(rows(spark, items)).select(completed.alias("c")).collect()] == [False] * 4 + [True, False]


def test_history_folds():
    def record(pos, quality, output, update=None, agent=None, completed=None, **more):
        return {"message_id": "m", "pos": pos, "quality": quality, "output": output, "update": update, "agent": agent, "completed": completed, "start": None, "first_token": None, "ttft": None, "model": None, "samples": None, "scope": None, "scope_reasons": None, "scope_parent": None} | more

    up = lambda n: {"instance": "i", "sequence": n, "received_at": n, "revision": None, "fingerprint": str(n), "seen": []}
    assert ledger.fold_history([record(0, "exact", 1, agent="a"), record(1, "provisional", 2), record(2, "exact", 3, completed=5)]) == record(0, "exact", 3, agent="a", completed=5, scope_reasons=[])
    # a record that loses still lends the agent and the evidence that it has
    lent = ledger.fold_history([record(0, "exact", 1, scope="user", scope_reasons=["x"]), record(1, "provisional", 2, agent="b", scope="excluded_item", scope_reasons=["y"], scope_parent="p")])
    assert (lent["output"], lent["agent"], lent["scope"], lent["scope_reasons"], lent["scope_parent"]) == (1, "b", "excluded_item", ["x", "y"], "p")
    assert ledger.fold_history([record(0, "exact", 1, up(2)), record(1, "exact", 2), record(2, "exact", 3, up(1)), record(3, "exact", 4, up(3)), record(4, "provisional", 5, up(4))])["output"] == 4


def test_folds_by_message_equal_plain_ones(spark):
    rng = random.Random(2)
    schema = "message_id string, session_id string, pos long, quality string, output long, scope string, update struct<instance:string,sequence:double,received_at:double,revision:double,fingerprint:string,seen:array<string>>"
    data = [(f"m{rng.randrange(9)}", "s", k, rng.choice(["exact", "provisional", None]), rng.randrange(90), rng.choice([None, None, None, "excluded_item"]), (rng.choice("ij"), float(rng.randrange(5)), float(k), None, str(rng.randrange(9)), []) if rng.random() < 0.5 else None) for k in range(60)]
    df = spark.createDataFrame(data, schema)
    got = {r["message_id"]: r["pos"] for r in ledger.contributions(df).collect()}
    own = {}
    for r in df.orderBy("pos").collect():
        own.setdefault(r["message_id"], []).append(r.asDict(True))
    assert got == {m: f["pos"] for m, rs in own.items() if (f := ledger.fold(rs))}


def test_histories_equal_folds(spark):
    """With and without live updates, ties in rank, lent agents and evidence."""
    rng = random.Random(5)
    schema = "message_id string, session_id string, pos long, quality string, output double, cost double, agent string, start double, first_token double, completed double, ttft double, duration double, model string, parent_id string, samples array<double>, scope string, scope_reasons array<string>, scope_parent string, update struct<instance:string,sequence:double,received_at:double,revision:double,fingerprint:string,seen:array<string>>"
    some = lambda *x: rng.choice([None, *x])
    data = []
    for k in range(400):
        m = rng.randrange(60)
        update = (rng.choice("ij"), float(rng.randrange(5)), float(k), None, str(rng.randrange(9)), []) if m < 20 and rng.random() < 0.3 else None
        data.append((f"m{m}", "s", k, some("exact", "provisional"), float(rng.randrange(2)), 0.0, some("a", "b"), some(1.0, 2.0), None, some(1.0, 3.0), some(1.0), None, some("x"), None, some([1.0]), some("user", "pending", "excluded_item", "excluded_session") if m % 3 else some("user", "pending"), some(["r"], ["q", "r"]), some("p", "o"), update))
    df = spark.createDataFrame(data, schema)
    own = {}
    for r in df.orderBy("pos").collect():
        own.setdefault(r["message_id"], []).append(r.asDict(True))
    want = {m: ledger.fold_history(rs) for m, rs in own.items()}
    got = {r["message_id"]: r.asDict(True) for r in ledger.history(df).collect()}
    none = lambda r: r | {"scope_reasons": r["scope_reasons"] or []}
    assert {m: none(r) for m, r in got.items()} == {m: none(r) for m, r in want.items()}


def test_only_exact_types_name_states(spark):
    items = [{"type": t, "timestamp": k, "properties": {"sessionID": "s"}} for k, t in enumerate(["message.error", "todo.completed", "permission.cancelled", "session.error", "SESSION.Aborted", "session.next.step.failed", "x.status"])]
    status = lambda where: {"type": "session.status", "timestamp": 50, **where}
    items += [status({"properties": {"sessionID": "s"}, "session": {"state": {"status": {"type": "Done"}}}}), status({"properties": {"sessionID": "s", "event": {"status": {"name": "cancel"}}, "info": {"state": "busy"}}}), status({"sessionID": "s", "status": {"other": "busy"}})]
    got = sorted((r["ts"], r["state"]) for r in events.older_facts(rows(spark, items)).collect())
    assert got == [(3, "failed"), (4, "aborted"), (5, "failed"), (50, "busy"), (50, "completed")]


def test_response_quality(spark):
    told = [{"input": 1, "output": 2}, {"input": 1, "output": 2, "reasoning": 0}, {"output": 2}, {"inputTokens": 1, "outputTokens": 5, "reasoning": 3}, {}]
    items = [ev("step.ended", k, assistantMessageID=f"m{k}", tokens=t) for k, t in enumerate(told)]
    got = {r["message_id"]: r["quality"] for r in events.newer_responses(rows(spark, items)).collect()}
    assert got == {"m0": "exact", "m1": "exact", "m2": "provisional", "m3": "exact", "m4": "provisional"}


def test_status_words_of_any_depth(spark):
    """Words nested in status objects count however deep they lie, those under other keys never."""
    deep = "Busy"
    for k in range(40):
        deep = {("status", "state", "type", "name")[k % 4]: deep}
    aside = {"type": {"other": {"name": "busy"}}, "name": ["busy"], "state": {"name": {"type": "Stop"}}}
    items = [{"type": "session.status", "timestamp": k, "properties": {"sessionID": "s", "status": s}} for k, s in enumerate([deep, aside, "{{{", {}, {"name": "{"}])]
    got = sorted((r["ts"], r["state"]) for r in events.older_facts(rows(spark, items)).collect())
    assert got == [(0, "busy"), (1, "stopped")]


def test_plans_stay_small(spark):
    """However many paths are read, a plan grows with what is written, not with how often a value is used."""
    frame = rows(spark, STORY)
    from sessiontide.sources import activity, history

    for made in (events.newer_responses(frame), events.newer_facts(frame), events.older_facts(frame), history.responses(frame), activity.facts(frame)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 50_000, len(plan)


def test_transitions_of_contributions(spark):
    """Every way in which a record meets what a ledger holds, and sums that follow."""
    up = lambda n: ("i", float(n), float(n), None, str(n), [])
    stored = [
        ("open", "a", "open", "exact", 5.0, None, False, False, False), ("provisional", "a", "open", "provisional", 5.0, None, False, False, False), ("settled", "a", "settled", "exact", 5.0, None, False, False, False),
        ("same", "a", "settled", "exact", 5.0, None, False, False, False), ("mark", None, "settled", None, None, None, True, False, False), ("gone", "a", "settled", "exact", 5.0, None, False, True, False),
        ("updated", "a", "settled", "exact", 5.0, up(3), False, False, False), ("filled", "a", "open", "exact", 5.0, None, False, False, True), ("moved", "a", "open", "exact", 5.0, up(1), False, False, False),
        ("leaves", "a", "open", "exact", 5.0, None, False, False, False), ("untold", "z", "settled", "exact", 9.0, None, False, False, False),
    ]
    records = [
        ("open", "a", "provisional", 9.0, None, None), ("provisional", "a", None, 7.0, None, None), ("settled", "a", "exact", 6.0, None, None), ("same", "a", "exact", 5.0, None, None), ("mark", "a", "exact", 8.0, None, None),
        ("gone", "a", "exact", 8.0, up(9), None), ("updated", "a", "exact", 8.0, up(2), None), ("updated", "a", "exact", 8.0, None, None), ("filled", "a", "exact", 8.0, None, None), ("moved", "b", "exact", 8.0, up(2), None),
        ("leaves", "a", "exact", 5.0, None, "excluded_item"), ("leaves", "a", "exact", 5.0, up(8), None), ("new", "c", "exact", 2.0, None, None), ("never", "c", "exact", 2.0, None, "excluded_session"), ("never", "c", "exact", 2.0, None, None),
        ("filled", "a", "exact", 4.0, up(1), None),
    ]
    update = "update struct<instance:string,sequence:double,received_at:double,revision:double,fingerprint:string,seen:array<string>>"
    old = spark.createDataFrame(stored, f"message_id string, session_id string, status string, quality string, output double, {update}, legacy boolean, excluded boolean, backfill boolean")
    new = spark.createDataFrame([(*r, k) for k, r in enumerate(records)], f"message_id string, session_id string, quality string, output double, {update}, scope string, pos long")
    after, changes = ledger.applied(old, new, ["output"])
    got = {r["message_id"]: (r["status"], r["output"] if not r["legacy"] else None, r["excluded"]) for r in after.collect()}
    assert got == {
        "open": ("open", 5, False), "provisional": ("open", 7, False), "settled": ("open", 6, False), "same": ("settled", 5, False), "mark": ("settled", None, False), "gone": ("settled", 5, True),
        "updated": ("settled", 5, False), "filled": ("open", 4, False), "moved": ("open", 8, False), "leaves": ("settled", 5, True), "untold": ("settled", 9, False), "new": ("open", 2, False), "never": ("settled", None, True),
    }
    assert {r["session_id"]: (r["calls"], r["output"]) for r in changes.collect()} == {"a": (-2, 2 + 1 - 1 - 5 - 5), "b": (1, 8), "c": (1, 2)}
