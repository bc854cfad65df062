"""Files with bad lines, round trips, and streams that end as batches do."""

import json
import random

from pyspark.sql import functions as F

from sessiontide.operators import ledger
from sessiontide.sources import activity, history, totals
from sessiontide.streaming import jobs


PROOF = {"version": 1, "sourceScope": "user", "reasons": ["normal-agent"]}


def put(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_history(spark, tmp_path):
    good = {"version": 1, "messageID": "m1", "sessionID": "s", "tokens": {"input": 5, "output": 2}, "cost": 0.5, "time": {"start": 1, "completed": 9}, "quality": "provisional"}
    later = good | {"quality": "exact", "tokens": {"input": 6, "output": 2}}
    put(tmp_path / "h" / "a.jsonl", ["﻿" + json.dumps(good), "", "{broken", later, good | {"messageID": 7}, good | {"messageID": ""}, good | {"messageID": "m2", "version": 2}, good | {"messageID": "m3", "cost": "1", "version": None} | {"time": {"start": "x"}}])
    got = {r["message_id"]: r for r in history.read(spark, str(tmp_path / "h")).collect()}
    assert set(got) == {"m1"} or set(got) == {"m1", "m3"}
    assert got["m1"]["input"] == 6 and got["m1"]["quality"] == "exact" and got["m1"]["completed"] == 9
    history.write(history.read(spark, str(tmp_path / "h")), str(tmp_path / "out"))
    again = {r["message_id"]: r for r in history.read(spark, str(tmp_path / "out")).collect()}
    assert {k: (r["input"], r["quality"], r["completed"]) for k, r in again.items()} == {k: (r["input"], r["quality"], r["completed"]) for k, r in got.items()}


def test_facts(spark, tmp_path):
    base = {"sessionID": "s", "timestamp": 1.5}
    put(tmp_path / "f" / "a.jsonl", [base | {"state": "busy"}, base | {"state": "busy"}, base | {"state": "odd"}, base | {"parentSessionID": None}, base | {"kind": "work", "executionID": "e", "source": "step", "phase": "start", "workID": "w", "measurementScope": PROOF}, base | {"kind": "work"},
        base | {"kind": "work", "executionID": "e", "source": "step", "phase": "start", "workID": "w"}, base | {"kind": "work", "executionID": "e", "source": "step", "phase": "start", "workID": "w", "measurementScope": PROOF, "version": 1},
        base | {"kind": "execution-scope", "executionID": "e", "classification": "pure-maintenance"}, base | {"parentSessionID": 7}, base | {"version": 3, "state": "busy"}, {"sessionID": 4, "timestamp": 1, "state": "busy"}, "[]"])
    got = activity.read(spark, str(tmp_path / "f")).collect()
    assert sorted(r["kind"] for r in got) == ["lifecycle", "parent", "work"]
    assert all(r["ts"] == 1.5 and r["observed_at"] == 1.5 and r["instance_id"] == "default" for r in got)


def test_totals(spark, tmp_path):
    tokens = {"input": 1.0, "output": 2.0, "reasoning": 0.0, "cacheRead": 4.0, "cacheWrite": 0.0}
    proof = {"version": 1, "sourceScope": "magic-message", "reasons": ["message-agent"]}
    body = {"sessionID": "s", "quality": "exact", "tokens": tokens, "cost": 1.0, "update": {"source": "live", "instanceID": "i", "sequence": 2, "receivedAt": 3, "fingerprint": "f", "seenFingerprints": ["g"]}}
    doc = {"version": 1, "generationBasisVersion": 3, "sessions": {"s": {"tokens": tokens, "cost": 2.0, "responseCount": 3}}, "open": {"o": body}, "settled": {"m": True, "x": body | {"excluded": proof}}, "sessionAgents": {"s": ["a"]}, "sessionScopes": {"s": {"version": 1, "sourceScope": "user", "reasons": []}, "u": {"version": 1, "sourceScope": "odd"}}, "messageScopes": {"m": proof}}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    one = totals.document(spark, str(tmp_path / "t.json"))
    first = totals.sessions(one).first()
    assert (first["calls"], first["cache_read"], first["basis"]) == (3, 4, 3) and totals.agents(one).count() == 1
    got = {r["message_id"]: r for r in totals.contributions(one).collect()}
    assert got["m"]["legacy"] and not got["m"]["excluded"] and got["x"]["excluded"] and got["o"]["update"]["seen"] == ["g"] and got["o"]["output"] == 2 and got["x"]["status"] == "settled"
    assert [(r["id"], r["scope"]) for r in totals.scopes(one).collect()] == [("s", "user")] and [(r["id"], r["scope"]) for r in totals.scopes(one, "message").collect()] == [("m", "excluded_item")]
    bad = [doc | {"version": 2}, doc | {"sessions": {"s": {"tokens": tokens, "cost": -1, "responseCount": 3}}}]
    for k, wrong in enumerate(bad):
        (tmp_path / f"u{k}.json").write_text(json.dumps(wrong))
        try:
            totals.sessions(totals.document(spark, str(tmp_path / f"u{k}.json"))).collect()
            raise AssertionError("an invalid ledger was read")
        except Exception as error:
            assert "invalid" in str(error)


MEASURE = {"generatedTokens": 6.0, "durationMs": 2000.0, "estimated": True, "coverageGeneratedTokens": 8.0, "observationQuality": "standard"}
SPEED = {
    "generation": MEASURE, "response": {"generatedTokens": 8.0, "durationMs": 9.0, "estimated": False}, "generationCoverage": {"status": "gap", "reasons": ["retry", "odd"]},
    "generationEvidence": {"version": 3, "coverage": "complete", "fromCurrentStart": True, "timeSource": "receive-monotonic", "selectedStream": "v2", "stepID": "s", "start": 0, "end": 1, "firstReceiveMono": 0, "lastReceiveMono": 2000, "observationCount": 3, "outputObserved": True, "reasoningObserved": False, "bytes": {"output": {"total": 40, "firstBatch": 10}, "reasoning": {"total": 0, "firstBatch": 0}}, "usage": {"output": 8, "reasoning": 0}},
}


def test_speeds_come_back(spark, tmp_path):
    """In histories and in ledgers, with sums, contributions, evidence and agents."""
    line = {"messageID": "m", "sessionID": "s", "tokens": {"output": 8}, "time": {"start": 1, "completed": 9}}
    lines = [line | {"speed": SPEED}, line | {"messageID": "n", "speed": {"generation": MEASURE | {"durationMs": "2"}}}, line | {"messageID": "o"}]
    rows = history.responses(spark.createDataFrame([(json.dumps(r), k) for k, r in enumerate(lines)], "value string, pos long"), speeds=True)
    again = history.responses(rows.select(F.to_json(history.body(rows.columns)).alias("value"), "pos"), speeds=True)
    for read in (rows, again):
        got = {r["message_id"]: r["speed"] and r["speed"].asDict(True) for r in read.collect()}
        assert got["n"] is None and got["o"] is None
        m = got["m"]
        assert (m["generation"]["tokens"], m["response"]["estimated"], m["evidence"]["output_first"], m["coverage"]) == (6, False, 10, {"status": "gap", "reasons": ["retry"]})
    tokens = {"input": 1.0, "output": 8.0, "reasoning": 0.0, "cacheRead": 4.0, "cacheWrite": 0.0}
    sums = {"generatedTokens": 6, "durationMs": 2000, "responseCount": 1, "estimatedResponseCount": 1, "coverageGeneratedTokens": 8, "shortResponseCount": 0}
    body = {"sessionID": "s", "quality": "exact", "tokens": tokens, "cost": 1.0, "speed": SPEED}
    doc = {"version": 1, "sessions": {"s": {"tokens": tokens, "cost": 2.0, "responseCount": 3, "speed": {"generation": sums, "response": sums}}}, "open": {"o": body}, "settled": {}, "sessionAgents": {"s": ["a", "b"]}, "sessionScopes": {"s": {"version": 1, "sourceScope": "user", "reasons": ["normal-agent"]}}}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    one = totals.document(spark, str(tmp_path / "t.json"))
    parts = {"sessions": totals.sessions(one), "contributions": totals.contributions(one), "session_scopes": totals.scopes(one), "agents": totals.agents(one)}
    totals.write(f"file://{tmp_path}/ledger", **parts)
    back = totals.read_tables(spark, f"file://{tmp_path}/ledger")
    assert {n: sorted(map(str, t.collect())) for n, t in back.items()} == {n: sorted(map(str, t.collect())) for n, t in parts.items()}
    first, kept = back["sessions"].first(), back["contributions"].first()["speed"]
    assert (first["generation_tokens"], first["response_short"], kept["evidence"]["output_usage"], kept["coverage"]["reasons"]) == (6, 0, 8, ["retry"])
    for wrong in ({"sessions": {"s": {"tokens": tokens, "cost": 2.0, "responseCount": 3, "speed": {"generation": sums | {"durationMs": -1}}}}}, {"open": {"o": body | {"speed": {"generation": {"estimated": True}}}}}):
        (tmp_path / "u.json").write_text(json.dumps(doc | wrong))
        bad = totals.document(spark, str(tmp_path / "u.json"))
        try:
            totals.sessions(bad).collect() if "sessions" in wrong else totals.contributions(bad).collect()
            raise AssertionError("an invalid ledger was read")
        except Exception as error:
            assert "invalid" in str(error)


def test_orphans_come_last_and_records_come_back_whole(spark, tmp_path):
    line = lambda out, **more: {"version": 1, "messageID": "m", "sessionID": "s", "tokens": {"output": out}, "time": {"start": 1, "completed": 9}, **more}
    big = [line(k, messageID=f"filler{k}") for k in range(2000)]
    put(tmp_path / "h" / "history.jsonl", [line(1, agent=" a ")])
    put(tmp_path / "h" / ".history.jsonl.77.300.x.tmp", [line(3)])
    put(tmp_path / "h" / ".history.jsonl.99.200.y.tmp", [*big, line(2)])  # the greatest file is read first
    from sessiontide.sources import store

    for _ in range(2):  # the second time the files have their new names
        got = {r["message_id"]: r for r in store.recover(spark, f"file://{tmp_path}/h/history.jsonl").collect()}
    assert got["m"]["output"] == 3 and got["m"]["agent"] == "a" and len(got) == 2001
    update = {"source": "live", "instanceID": "i", "sequence": 2, "receivedAt": 3, "revision": 4, "fingerprint": "f", "seenFingerprints": ["x", "y"]}
    scope = {"version": 1, "sourceScope": "magic-session", "reasons": ["session-title", "odd"], "parentSessionID": "p"}
    put(tmp_path / "w" / "a.jsonl", [line(5, update=update, scope=scope, samples=[{"timestamp": 1, "tokens": -2, "kind": "output", "bytes": 7}, {"tokens": 1}], quality="exact"), line(1, messageID="n", scope={"version": 1, "sourceScope": "hidden-session"}, update=update | {"sequence": -1})])
    kept = history.read(spark, str(tmp_path / "w"))
    history.write(kept, str(tmp_path / "out"))
    for rows in (kept, history.read(spark, str(tmp_path / "out"))):
        r = {x["message_id"]: x.asDict(True) for x in rows.collect()}
        assert r["m"]["update"] == {"instance": "i", "sequence": 2.0, "received_at": 3.0, "revision": 4.0, "fingerprint": "f", "seen": ["x", "y"]} and r["n"]["update"] is None and r["n"]["scope"] is None
        assert (r["m"]["scope"], r["m"]["scope_reasons"], r["m"]["scope_parent"]) == ("excluded_session", ["session-title"], "p")
        assert r["m"]["samples"] == [{"timestamp": 1.0, "tokens": 0.0, "estimatedTokens": None, "bytes": 7.0, "kind": "output"}]
    assert "magic-session" in (next((tmp_path / "out").glob("part-*"))).read_text() + "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_activity_logs_come_back_and_shrink(spark, tmp_path):
    rows = [{"sessionID": "s", "timestamp": 1.5, "state": "busy", "sourceSequence": 4, "lastObservedAt": 9}, {"kind": "work", "sessionID": "s", "timestamp": 2, "executionID": "e", "source": "step", "phase": "start", "workID": "w", "stepID": "x", "measurementScope": PROOF}, {"sessionID": "s", "timestamp": 3, "parentSessionID": None},
        {"sessionID": "s", "timestamp": 4, "state": "idle", "scope": {"version": 1, "sourceScope": "magic-session", "reasons": ["session-title"], "parentSessionID": "p"}, "sourceEventID": "q"},
        {"kind": "execution-scope", "sessionID": "s", "timestamp": 5, "executionID": "e", "classification": "pure-maintenance", "coverage": "complete", "scope": {"version": 1, "sourceScope": "pending", "reasons": []}}]
    put(tmp_path / "log" / "a.jsonl", [*rows, *rows])
    path = f"file://{tmp_path}/log"
    before = activity.read(spark, path).drop("pos").collect()
    activity.compact(spark, path)
    assert spark.read.text(path).count() == 5
    assert {(r["scope"], r["measure"], r["scope_parent"], tuple(r["scope_reasons"] or ())) for r in before if r["scope"] or r["measure"]} == {("excluded_session", None, "p", ("session-title",)), ("pending", None, None, ()), (None, "user", None, ())}
    assert sorted(map(str, activity.read(spark, path).drop("pos").collect())) == sorted(map(str, before))


def test_usage_stream_ends_as_batch(spark, tmp_path):
    """Messages move between sessions, are corrected, and are excluded late; batches are repeated and queries restarted."""
    rng = random.Random(3)
    rows = []
    for k in range(120):
        live = {"source": "live", "instanceID": "i", "sequence": k, "receivedAt": k, "fingerprint": str(k), "seenFingerprints": []}
        m = rng.randrange(20)
        out = {"scope": {"version": 1, "sourceScope": "magic-message", "reasons": ["message-agent"]}} if k > 60 and m < 3 else {}
        rows.append({"messageID": f"m{m}", "sessionID": f"s{rng.randrange(4)}", "tokens": {"output": rng.randrange(50)}, "cost": 1, "time": {"start": 1, "completed": k}, "quality": rng.choice(["exact", "provisional"]), **out, **({"update": live} if rng.random() < 0.4 else {})})
    rows += [{"messageID": m, "sessionID": s, "tokens": {"output": 5}, **x} for m, s, x in [("x", "sA", {}), ("y", "sZ", {}), ("x", "sB", {}), ("y", "sZ", {"scope": {"version": 1, "sourceScope": "magic-session", "reasons": []}})]]
    (tmp_path / "in").mkdir()
    cuts = [0, 40, 41, 100, 122, 124]
    for a, b in zip(cuts, cuts[1:], strict=False):
        with (tmp_path / "in" / "log.jsonl").open("a") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows[a:b]))
        for _ in range(2 if b == 100 else 1):  # the second run finds nothing new
            jobs.keep_usage(history.tail(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    batch = history.responses(spark.createDataFrame([(json.dumps(r), k) for k, r in enumerate(rows)], "value string, pos long"))
    own = {}
    for r in batch.orderBy("pos").collect():
        own.setdefault(r["message_id"], []).append(r.asDict(True))
    folded = {m: ledger.fold_history(rs)["output"] for m, rs in own.items()}
    sums = {}
    for rs in own.values():
        if f := ledger.fold(rs):
            n, out = sums.get(f["session_id"], (0, 0))
            sums[f["session_id"]] = (n + 1, out + f["output"])
    assert "sA" not in sums and "sZ" not in sums and sums["sB"] == (1, 5)
    kept = jobs.read_history(spark, str(tmp_path / "store"), batch.drop("pos").schema)
    assert {r["message_id"]: r["output"] for r in kept.collect()} == folded
    assert {r["session_id"]: (r["calls"], r["output"]) for r in jobs.read_totals(spark, str(tmp_path / "store")).collect()} == sums


def test_tail_reads_what_was_added(spark, tmp_path):
    """Appends go on where a file stood, a line without its end waits, and truncated or rewritten files are read anew."""
    from sessiontide.sources import tail

    folder, seen = tmp_path / "in", []
    folder.mkdir()
    log, other = folder / "a.log", folder / "b.log"

    def run(piece=tail.PIECE):
        got = []
        keep = lambda batch, _: got.extend(tuple(r) for r in batch.orderBy("file", "at").select("value", "reset").collect())
        tail.stream(spark, str(folder), piece).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        seen.extend(got)
        return got

    log.write_text("one\ntwo\nhal")
    assert run() == [("one", False), ("two", False)]
    assert run() == []
    log.write_text("one\ntwo\nhalf\nlast\n")
    other.write_text("x" * 50 + "\n" + "é\n" * 40)
    assert run(7) == [("half", False), ("last", False), ("x" * 50, False), *[("é", False)] * 40]
    log.write_text("new\n")
    assert run() == [("new", True)]
    log.write_text("newer\nthan\nthat\n")
    assert run() == [("newer", True), ("than", True), ("that", True)]
    with log.open("a") as f:
        f.write("end\n")
    assert run() == [("end", False)]


def test_stream_ends_as_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"sessionID": f"s{rng.randrange(6)}", "timestamp": rng.randrange(1000), "seq": k, "state": rng.choice(["busy", "busy", "idle", "completed"])} for k in range(120)]
    for part in range(4):
        put(tmp_path / "in" / f"{part}.jsonl", rows[part::4] + rows[:10])
    facts = activity.stream(spark, str(tmp_path / "in"), 1)
    for _ in range(2):  # the second run finds nothing new
        jobs.keep_session_time(facts, str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    want = jobs.session_time(activity.read(spark, str(tmp_path / "in")))
    got = jobs.read_session_time(spark, str(tmp_path / "store"))
    assert sorted(map(tuple, got.select("session_id", "n", "length").collect())) == sorted(map(tuple, want.select("session_id", "n", "length").collect()))
    assert want.count() == 6 and want.agg(F.sum("length")).first()[0] > 0


def test_interval_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("busy", 1), ("retry", 3), ("idle", 7), ("busy", 9), ("completed", 12), ("busy", 20), ("idle", 30)]
    for k, (state, ts) in enumerate(rows):
        put(tmp_path / "in" / f"{k}.jsonl", [{"sessionID": "s", "executionID": "e", "timestamp": ts, "seq": k, "state": state}])
    query = jobs.interval_stream(activity.stream(spark, str(tmp_path / "in"), 100)).writeStream.format("memory").queryName("spans").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["start"], r["end"]) for r in spark.table("spans").collect()) == [(1.0, 7.0), (9.0, 12.0)]


def test_history_store(spark, tmp_path):
    from sessiontide.sources import store

    update = "struct<instance:string,sequence:double,received_at:double,revision:double,fingerprint:string,seen:array<string>>"
    schema = f"message_id string, session_id string, pos long, quality string, input double, output double, reasoning double, cache_read double, cache_write double, cost double, agent string, start double, first_token double, completed double, ttft double, model string, scope string, update {update}"

    def batch(*items):
        return spark.createDataFrame([(m, "s", k, q, 1.0, out, 0.0, 0.0, 0.0, 0.5, None, 1.0, None, 2.0, None, None, None, None) for k, (m, q, out) in enumerate(items)], schema)

    path = store.paths(f"file://{tmp_path}")["history"]
    store.upsert(batch(("a", "provisional", 9.0), ("b", "exact", 2.0)), path, 2)
    store.upsert(batch(("a", "exact", 3.0), ("c", "exact", 4.0)), path, 2, batch(("a", None, 0.0)))
    got = {r["message_id"]: r["output"] for r in spark.read.parquet(path).collect()}
    assert got == {"a": 3.0, "b": 2.0, "c": 4.0}
    store.rebuild_totals(f"{path}-totals", spark.read.parquet(path))
    assert spark.read.parquet(f"{path}-totals").first()["output"] == 9.0
    aside = store.quarantine(spark, f"{path}-totals")
    assert store.exists(spark, aside) and not store.exists(spark, f"{path}-totals")


def test_history_store_parts(spark, tmp_path):
    """The last records, clearing, pruning by age, and totals that are seeded once."""
    from sessiontide.sources import store

    path = store.paths(home=f"file://{tmp_path}")["history"]
    lines = [{"messageID": f"m{k}", "sessionID": "s", "tokens": {"output": k}, "time": {"start": 1, "completed": k}} for k in range(6)]
    put(tmp_path / "in" / "a.jsonl", lines[:4])
    put(tmp_path / "more" / "a.jsonl", lines[4:])
    store.upsert(history.read(spark, str(tmp_path / "in")), path)
    store.upsert(history.read(spark, str(tmp_path / "more")), path)
    names = lambda rows: sorted(r["message_id"] for r in rows.collect())
    assert names(store.last(spark, path, 3)) == ["m3", "m4", "m5"]
    store.prune(spark, path, 3.0, spark.createDataFrame([("m1",)], "message_id string"))
    assert names(spark.read.parquet(path)) == ["m1", "m3", "m4", "m5"]
    assert store.seed_totals(f"{path}-totals", spark.read.parquet(path)) and not store.seed_totals(f"{path}-totals", spark.read.parquet(path).limit(0))
    assert spark.read.parquet(f"{path}-totals").first()["output"] == 13.0
    store.clear(spark, path)
    assert names(spark.read.parquet(path)) == []
