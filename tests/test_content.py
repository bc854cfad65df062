"""Content progress in batches and as a stream, proofs of generation rates, speeds of records, and state without a name."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sessiontide.operators import content, metrics, pending, speed
from sessiontide.streaming import content as live

COLUMNS = [c.split(" ")[0] for c in content.OBSERVATION.split(", ")]


def seen(message, pos, kind, **more):
    return {c: None for c in COLUMNS} | {"message_id": message, "pos": pos, "kind": kind} | more


def delta(message, pos, text, mono, **more):
    return seen(message, pos, "delta", **{"part_id": "p", "part_type": "text", "text": text, "stream": "v2", "event_id": f"e{pos}", "received_at": 1000.0 + mono, "received_mono": mono, "clock_source": "performance.now", "clock_resolution_ms": 5.0, **more})


def clean(message, text="hello world", more=()):
    """A response observed from its start, in two deltas 2 s apart, and what is to be changed in it."""
    return [seen(message, 0, "begin", from_start=True), seen(message, 1, "step", step_id="s"), delta(message, 2, text[:4], 10.0), delta(message, 3, text[4:], 2010.0), seen(message, 9, "snapshot", part_id="p", part_type="text", text=text, final=True), *more]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], content.OBSERVATION)


def without(rows, *places):
    return [r for r in rows if r["pos"] not in places]


def changed(rows, pos, **more):
    return [r | more if r["pos"] == pos else r for r in rows]


CASES = {
    "complete": (clean("m"), {}),
    "missing-content-observation": ([], {}),
    "not-observed-from-current-start": (without(clean("m"), 0), {}),
    "retry": (clean("m", more=[seen("m", 5, "taint", reason="retry")]), {}),
    "unknown-final-usage": (clean("m"), {"usage_exact": False}),
    "unknown-reasoning-usage": (clean("m"), {"reasoning_known": False}),
    "unknown-or-multiple-step-identities": (without(clean("m"), 1), {}),
    "unknown-step-identity": (changed(clean("m"), 1, step_id=" "), {}),
    "multiple-step-identities": (clean("m", more=[seen("m", 5, "step", step_id="t")]), {}),
    "unfinished-response": (clean("m"), {"completed": None}),
    "tool-usage-uncertain": (clean("m", more=[seen("m", 5, "snapshot", part_id="t", part_type="tool")]), {}),
    "missing-comparable-final-snapshot": (changed(clean("m"), 9, final=False), {}),
    "snapshot-delta-gap": (without(clean("m"), 3), {}),
    "snapshot-delta-mismatch": (changed(clean("m"), 9, text="hello"), {}),
    "missing-receive-observations": ([*clean("m")[:2], seen("m", 9, "snapshot", part_id="p", part_type="text", text="", final=True)], {}),
    "insufficient-receive-span": (changed(clean("m"), 3, received_mono=60.0), {}),
    "unknown-receive-clock": (changed(changed(clean("m"), 3, received_mono=600.0), 2, clock_source=None), {}),
    "hidden-reasoning": (clean("m"), {"reasoning": 3.0}),
    "unobserved-output": ([r | {"part_type": "reasoning"} if r["part_type"] else r for r in clean("m")], {"reasoning": 3.0}),
    "invalid-receive-clock": (changed(clean("m"), 3, received_mono=-1.0), {}),
    "nonmonotonic-receive-clock": (clean("m", "hello world!", [delta("m", 4, "?", 5.0)]), {}),
    "mixed-streams": (changed(clean("m"), 3, stream="legacy"), {}),
    "anonymous-snapshot": (clean("m", more=[seen("m", 5, "snapshot", part_type="text")]), {}),
    "part-kind-changed": (clean("m", more=[seen("m", 5, "snapshot", part_id="p", part_type="reasoning")]), {}),
    "anonymous-delta": (changed(clean("m"), 3, part_id=None), {}),
    "white space": (changed(clean("m", "hello world  \n"), 9, text="hello world"), {}),
    "twice": (clean("m") + clean("m")[2:4], {}),
}


def test_every_reason(spark):
    rows, asked = [], []
    for name, (case, more) in CASES.items():
        rows += [r | {"message_id": name} for r in case]
        asked.append(tuple(({"m": name, "output": 7.0, "reasoning": 0.0, "completed": 5000.0, "usage_exact": True, "reasoning_known": True} | more).values()))
    responses = spark.createDataFrame(asked, "message_id string, output double, reasoning double, completed double, usage_exact boolean, reasoning_known boolean")
    got = {r["message_id"]: r for r in content.proof(content.progress(frame(spark, rows)), responses).select("*", metrics.interval_measure().alias("m")).collect()}
    fine = {"complete", "white space", "twice"}
    for name, r in got.items():
        reasons = r["coverage"]["reasons"]
        assert (not reasons and r["coverage"]["status"] == "complete" and r["evidence"]) if name in fine else (name in reasons and r["evidence"] is None), (name, r)
        assert (r["coverage"]["status"] == "gap") == ("snapshot-delta" in name), name
    assert len(got) == len(CASES)
    m = got["complete"]["m"]
    assert (m["tokens"], m["ms"], m["coverage"], m["quality"]) == (7 * (7 / 11), 2000, 7, "standard")


def randoms(seed):
    rng = random.Random(seed)
    rows = []
    for pos in range(300):
        m, kind = f"m{rng.randrange(12)}", rng.choice(["begin", "step", "delta", "delta", "delta", "delta", "snapshot", "taint"])
        part = rng.choice(["p", "q", "r", None]) if rng.random() < 0.1 else rng.choice("pq")
        kind_of = {"p": "text", "q": "reasoning"}.get(part, "tool") if rng.random() < 0.97 else rng.choice(["text", "output", None])
        if kind == "delta":
            rows.append(delta(m, pos, rng.choice(["a", "é ", " \n", "", "xyz", " "]), float(pos + rng.choice([0, 0, 0, -9])), part_id=part, part_type=kind_of, event_id=rng.choice([f"e{pos}", f"e{pos}", f"e{rng.randrange(9)}", None]), stream=rng.choice(["v2"] * 30 + ["legacy"]), clock_source=rng.choice(["performance.now"] * 9 + [None])))
        else:
            rows.append(seen(m, pos, kind, from_start=rng.random() < 0.9, step_id=rng.choice(["s"] * 9 + ["t", "", None]), reason="retry" if rng.random() < 0.05 else "", part_id=part, part_type=kind_of, text=rng.choice(["a", "aé", "", None]), final=rng.random() < 0.5))
    return [r for r in rows if r["kind"] != "taint" or r["reason"]]


@pytest.mark.parametrize("seed", range(2))
def test_stream_ends_as_batch(spark, tmp_path, seed):
    """Deliveries are shuffled within their batches."""
    rows = randoms(seed)
    want = content.progress(frame(spark, rows))
    for k in range(3):
        own = rows[100 * k : 100 * k + 100]
        random.Random(k).shuffle(own)
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in own))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(content.OBSERVATION).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = {}
    keep = lambda batch, _: got.update({r["message_id"]: r.asDict(True) for r in batch.collect()})
    live.progress_stream(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows_of = want.collect()
    names = [c for c in live.SCHEMA.replace(",", "").split(" ")[::2]]
    plain = lambda r: {c: (r[c] if r[c] == r[c] else None) for c in names}
    left, right = {r["message_id"]: plain(r.asDict(True)) for r in rows_of}, {m: plain(r) for m, r in got.items()}
    assert {(m, c): (left[m][c], right[m][c]) for m in left for c in names if left[m][c] != right[m][c]} == {}
    assert len(got) == 12


def test_appended_texts_compare_however_cut():
    rng = random.Random(4)
    text = "".join(rng.choice("ab é\n漢") for _ in range(500))
    held = (0, 0)
    while text_left := text[held[0] :] if not held[0] else None:
        held = live.appended(held, text_left)
    cuts = sorted(rng.sample(range(500), 30))
    pieces = (0, 0)
    for a, b in zip([0, *cuts], [*cuts, 500], strict=True):
        pieces = live.appended(pieces, text[a:b])
    assert pieces == held and live.appended((0, 0), text[:-1] + "x") != held


# speeds

EV = {"version": 3, "coverage": "complete", "from_start": True, "time_source": "receive-monotonic", "stream": "v2", "step_id": "s", "start": 0.0, "end": 1.0, "first_receive": 0.0, "last_receive": 2000.0, "observations": 3, "clock_source": None, "clock_resolution_ms": None, "quality": None, "output_bytes": 40, "output_first": 10, "output_usage": 8.0, "output_observed": True, "reasoning_bytes": 0, "reasoning_first": 0, "reasoning_usage": 0.0, "reasoning_observed": False}
GEN = {"tokens": 6.0, "ms": 2000.0, "estimated": True, "coverage": 8.0, "quality": "standard"}


def speeds(spark, rows, schema):
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_stored_speeds(spark):
    whole = {"generation": GEN, "response": GEN | {"quality": None}, "evidence": EV, "coverage": {"status": "gap", "reasons": ["retry", "odd", "retry"]}}
    old = EV | {"version": 2, "start": 5.0, "end": 2005.0, "coverage": "gap"}
    rows = [whole, whole | {"generation": GEN | {"ms": 0.0}}, whole | {"generation": GEN | {"quality": "odd"}, "response": None, "coverage": None}, whole | {"evidence": old}, whole | {"evidence": old | {"end": 9.0}}, whole | {"coverage": {"status": "odd", "reasons": []}}, None]
    data = speeds(spark, [{"id": k, "speed": r} for k, r in enumerate(rows)], f"id int, speed {speed.SPEED}")
    got = [r["speed"] and r["speed"].asDict(True) for r in speed.coerced(data).orderBy("id").collect()]
    assert got[0] == whole | {"coverage": {"status": "gap", "reasons": ["retry"]}}
    assert got[1]["generation"] is None and got[1]["evidence"] is None and got[1]["response"]
    assert got[2] is None and got[6] is None
    assert (got[3]["evidence"]["version"], got[3]["evidence"]["coverage"], got[3]["evidence"]["output_bytes"]) == (2, "gap", None) and got[4]["evidence"] is None
    assert got[5]["coverage"] is None


def test_measures_of_records(spark):
    base = {"output": 8.0, "reasoning": 0.0, "start": 100.0, "completed": 1100.0, "usage_exact": True, "timing_exact": True, "evidence": EV, "coverage": None}
    rows = [base, base | {"usage_exact": False}, base | {"completed": 50.0}, base | {"evidence": EV | {"observations": 1}}, base | {"evidence": None, "coverage": {"status": "gap", "reasons": ["snapshot-delta-gap"]}}, base | {"reasoning": 2.0}, base | {"output": 16.0}]
    data = speeds(spark, [r | {"id": k} for k, r in enumerate(rows)], f"id int, output double, reasoning double, start double, completed double, usage_exact boolean, timing_exact boolean, evidence {speed.EVIDENCE}, coverage {speed.COVERAGE}")
    got = [r["speed"].asDict(True) for r in speed.measured(data).orderBy("id").collect()]
    assert got[0] == {"generation": GEN, "response": {"tokens": 8.0, "ms": 1000.0, "estimated": False, "coverage": None, "quality": None}, "evidence": EV, "coverage": None}
    invalid = {"status": "unknown", "reasons": ["invalid-v3-evidence"]}
    assert got[1]["generation"] is None and got[1]["response"]["estimated"] and got[1]["coverage"] == invalid
    assert got[2]["response"] is None and got[2]["generation"] == GEN
    assert got[3]["coverage"] == invalid and got[5]["coverage"] == invalid
    assert got[4]["coverage"] == {"status": "gap", "reasons": ["snapshot-delta-gap"]}
    assert got[6]["generation"]["tokens"] == 12.0 and got[6]["evidence"]["output_usage"] == 16.0
    shown = [(r["available"], r["rate"], r["basis"]) for r in speed.primary_rate(speed.measured(data)).orderBy("id").collect()]
    assert shown[0] == (True, 3.0, "generation") and shown[1] == (False, None, None) and shown[2] == (True, 3.0, "generation")


def test_corrections_of_speeds(spark):
    held = {"generation": GEN, "response": None, "evidence": EV, "coverage": None}
    none = {"generation": None, "response": None, "evidence": None, "coverage": None}
    why = lambda *reasons, status="unknown": {"status": status, "reasons": list(reasons)}
    base = {"output": 8.0, "reasoning": 0.0, "completed": 9.0, "speed": none, "prior": held, "generation_status": "unobserved"}
    rows = [
        (base, GEN, None),
        (base | {"output": 4.0}, GEN | {"tokens": 3.0, "coverage": 4.0}, None),
        (base | {"reasoning": 1.0}, None, why("hidden-reasoning")),
        (base | {"completed": None}, None, None),
        (base | {"speed": held, "prior": none}, GEN, None),
        (base | {"speed": held, "prior": none, "output": 9.0}, None, None),
        (base | {"generation_status": "invalidated"}, None, why("generation-invalidated")),
        (base | {"generation_status": "invalidated", "prior": none | {"coverage": why("retry", status="gap")}}, None, why("retry", status="gap")),
        (base | {"prior": held | {"generation": GEN | {"tokens": 5.0}}, "speed": none | {"coverage": why("recovery")}}, None, why("recovery")),
        (base | {"prior": None, "speed": None}, None, None),
        (base | {"prior": held | {"evidence": EV | {"output_bytes": 0, "output_first": 0, "output_usage": 0.0, "output_observed": False, "reasoning_bytes": 40, "reasoning_first": 10, "reasoning_usage": 8.0, "reasoning_observed": True}}}, None, why("unobserved-output")),
    ]
    data = speeds(spark, [r | {"id": k} for k, (r, _, _) in enumerate(rows)], f"id int, output double, reasoning double, completed double, speed {speed.SPEED}, prior {speed.SPEED}, generation_status string")
    got = [r["speed"].asDict(True) for r in speed.corrected(data).orderBy("id").collect()]
    assert [(g["generation"], g["coverage"]) for g in got] == [(g, c) for _, g, c in rows]


def test_content_arrival(spark):
    base = {"start": 10.0, "completed": 90.0, "first_content": None, "first_token": None, "first_response": None, "first_response_source": None, "first_response_time_source": None, "first_response_estimated": None, "at": 20.0}
    rows = [base, base | {"at": 95.0}, base | {"first_token": 15.0}, base | {"first_response": 12.0, "first_response_source": "thinking", "first_response_time_source": "part-start", "first_response_estimated": False}, base | {"first_content": 5.0, "completed": None}]
    data = speeds(spark, [r | {"id": k} for k, r in enumerate(rows)], "id int, start double, completed double, first_content double, first_token double, first_response double, first_response_source string, first_response_time_source string, first_response_estimated boolean, at double")
    got = [tuple(r["c"]) for r in data.orderBy("id").select(metrics.content_arrival().alias("c")).collect()]
    assert got[0] == (20, 20, 20, "content", "arrival", True) and got[1] == (None,) * 6 and got[2][:3] == (15, 15, 15)
    assert got[3] == (20, 20, 12, "thinking", "part-start", False) and got[4][:3] == (20, 20, 20)


def fold_pending(rows):
    """The plain fold: state without a name waits under its session and is merged into the next message that is named."""
    waiting, held, done = {}, {}, set()
    for r in sorted(rows, key=lambda r: r["pos"]):
        m, s = r["message_id"], r["session_id"]
        if m is None:
            waiting.setdefault(s, []).append(r)
            continue
        own = held.setdefault(m, ([], []))
        if m not in done:
            own[1].extend(waiting.pop(s, []))
        own[0].append(r)
        if r["completes"]:
            done.add(m)
    first = lambda rs, c: next((r[c] for r in rs if r[c] is not None), None)
    out = {}
    for m, (own, taken) in held.items():
        rows_ = own + taken
        last = lambda c: first(own[::-1] + taken[::-1], c)  # noqa: E731, B023
        out[m] = (min(r["ts"] for r in rows_), first(rows_, "model"), first(rows_, "agent"), last("output"), max((r["cache_read"] for r in rows_ if r["cache_read"] is not None), default=None), len(rows_), all(r["from_start"] for r in rows_))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_state_without_a_name(spark, seed):
    rng = random.Random(seed)
    some = lambda *x: rng.choice([None, *x])
    rows = [{"session_id": f"s{(k := rng.randrange(9)) % 3}", "message_id": some(f"m{k}"), "pos": p, "completes": rng.random() < 0.2, "ts": float(rng.randrange(99)), "first_token": None, "live": True, "from_start": rng.random() < 0.9, "model": some("x", "y"), "agent": some("a", "b"), "cost": None, "input": None, "output": some(1.0, 2.0), "reasoning": None, "cache_read": some(1.0, 5.0), "cache_write": None} for p in range(150)]
    schema = "session_id string, message_id string, pos long, completes boolean, ts double, first_token double, live boolean, from_start boolean, model string, agent string, cost double, input double, output double, reasoning double, cache_read double, cache_write double"
    got = pending.merged(pending.named(speeds(spark, rows, schema)))
    assert {r["message_id"]: tuple(r[c] for c in ("start", "model", "agent", "output", "cache_read", "observations", "from_start")) for r in got.collect()} == fold_pending(rows)
    assert got.filter(F.col("message_id").isNull()).isEmpty()
