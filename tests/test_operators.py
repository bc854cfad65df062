"""Hand cases and models of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from sessiontide.functions import text as shown
from sessiontide.functions import tokens
from sessiontide.operators import activity, forest, intervals, ledger, metrics, precedence, scope
from sessiontide.schema import EXCLUDED_ITEM, EXCLUDED_SESSION

FACT = "session_id string, instance_id string, execution_id string, ts double, state string, ended_at double, last_observed double, event_id string"


def spans(spark, pairs, key=1):
    return spark.createDataFrame([(key, float(a), float(b)) for a, b in pairs], "k int, start double, end double")


def listed(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def facts(spark, rows):
    df = spark.createDataFrame([(*(r + (None,) * (8 - len(r))),) for r in rows], FACT)
    return df.withColumns({"seq": F.lit(None).cast("long"), "source_sequence": F.lit(None).cast("long"), "pos": F.monotonically_increasing_id()})


def test_interval_algebra(spark):
    pairs = [(3, 9), (9, 12), (11, 20), (30, 31), (5, 5)]
    assert listed(intervals.union(spans(spark, pairs), ["k"])) == [(3, 20), (30, 31)]
    assert intervals.length(intervals.union(spans(spark, pairs), ["k"]), ["k"]).first()["length"] == 18
    assert listed(intervals.normalized(spans(spark, [(9, 3), (8, 10)]), ["k"])) == [(3, 10)]
    cut = intervals.subtract(spans(spark, [(0, 50)]), spans(spark, [(10, 20), (15, 25), (49, 60)]), ["k"])
    assert listed(cut) == [(0, 10), (25, 49)]
    assert listed(intervals.intersect(spans(spark, [(0, 10), (20, 40)]), spans(spark, [(5, 25)]), ["k"])) == [(5, 10), (20, 25)]
    assert listed(intervals.eligible(spans(spark, [(0, 200)]), spans(spark, [(30, 150)]), spans(spark, [(90, 120)]), ["k"])) == [(0, 30), (90, 120), (150, 200)]
    assert intervals.union(spans(spark, []), ["k"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_sweeps_equal_sets_of_points(spark, seed):
    rng = random.Random(seed)
    layers = [[(a, a + rng.randrange(0, 9)) for a in (rng.randrange(60) for _ in range(8))] for _ in range(3)]
    a, b, c = ({t for x, y in own for t in range(x, y)} for own in layers)
    points = lambda df: {t for x, y in listed(df) for t in range(int(x), int(y))}
    x, y, z = (spans(spark, own) for own in layers)
    assert points(intervals.union(x, ["k"])) == a
    assert points(intervals.subtract(x, y, ["k"])) == a - b and points(intervals.intersect(x, y, ["k"])) == a & b
    assert points(intervals.eligible(x, y, z, ["k"])) == (a - b) | (a & c)


def test_lifecycle(spark):
    rows = [("s", "i", None, t, s) for t, s in ((7.0, "busy"), (12.0, "retry"), (30.0, "idle"), (41.0, "busy"), (44.0, "busy"))]
    one = facts(spark, rows)
    total = lambda df: sum(b - a for a, b in listed(intervals.union(df, ["session_id"])))
    assert total(activity.lifecycle_intervals(one)) == 26
    trusted = spark.createDataFrame([("i",)], "instance_id string")
    assert total(activity.lifecycle_intervals(one, activity.boundaries(one, trusted, 60.0))) == 42
    assert total(activity.lifecycle_intervals(one, None, 50.0, trusted)) == 32
    latch = [(1.0, "busy"), (5.0, "completed"), (8.0, "busy"), (9.0, "idle")]
    assert total(activity.lifecycle_intervals(facts(spark, [("s", "i", "e", *x) for x in latch]))) == 4
    assert total(activity.lifecycle_intervals(facts(spark, [("s", "i", None, *x) for x in latch]))) == 5
    assert total(activity.lifecycle_intervals(facts(spark, [("s", "i", None, *x) for x in latch[::-1]]))) == 5


def test_recovery_and_reconciliation(spark):
    rows = facts(spark, [("s", "i", "e", 1.0, "busy", None, None, "a"), ("s", "i", "e", 4.0, "busy", None, 6.0, "b"), ("s", "j", "f", 1.0, "busy", None, None, "c")])
    got = activity.recovery_facts(rows, spark.createDataFrame([("i",)], "instance_id string")).collect()
    assert [(r["instance_id"], r["state"], r["ts"], r["event_id"]) for r in got] == [("i", "stopped", 6.0, "recovered/s/i/e")]
    canonical = facts(spark, [("s", "i", "e", 1.0, "busy", None, None, "a"), ("s", "i", "e", 5.0, "completed", None, None, "z")])
    live = facts(spark, [("s", "i", "e", 1.0, "busy", None, None, "a")])
    assert {r["event_id"] for r in activity.reconciled(canonical, live).collect()} == {"a", "z"}
    ahead = facts(spark, [("s", "i", "e", 1.0, "busy", None, None, "a"), ("s", "i", "e", 3.0, "idle", None, None, "q")])
    assert {r["event_id"] for r in activity.reconciled(canonical, ahead).collect()} == {"a", "q"}


def links(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def test_forest(spark):
    cyclic = links(spark, [("d", "c"), ("c", "b"), ("b", "c"), ("x", None), ("y", "y"), ("z", "")])
    got = {r["id"]: r["root"] for r in forest.roots(cyclic, spark.createDataFrame([("x",), ("y",)], "id string")).collect()}
    assert {k: got[k] for k in "dcb"} == {"d": "b", "c": "b", "b": "b"} and got["x"] == "x" and got["y"] == "y"
    chain = links(spark, [(f"n{k:04}", f"n{k - 1:04}") for k in range(1, 300)])
    assert {r["root"] for r in forest.roots(chain).collect()} == {"n0000"}
    totals = spark.createDataFrame([("r", 2), ("a", 5), ("x", 40), ("y", 300)], "id string, v long")
    tree = links(spark, [("a", "r"), ("x", "a"), ("y", "x")])
    gone = spark.createDataFrame([("x",)], "id string")
    assert {r["id"]: (r["direct_v"], r["including_v"]) for r in forest.rollup(totals, tree, ["v"], gone).collect()} == {"r": (2, 7), "a": (5, 5)}
    assert {r["id"]: r["including_v"] for r in forest.rollup(totals, tree, ["v"]).collect()} == {"r": 347, "a": 345, "x": 340, "y": 300}
    loop = forest.rollup(totals, links(spark, [("a", "r"), ("r", "a"), ("x", "a")]), ["v"])
    assert {r["id"]: r["including_v"] for r in loop.collect()} == {"r": 47, "a": 47, "x": 40, "y": 300}
    special = links(spark, [("__proto__", "constructor")])
    assert {r["id"]: r["root"] for r in forest.roots(special).collect()} == {"__proto__": "constructor", "constructor": "constructor"}
    assert [r["id"] for r in forest.listing(links(spark, [("b", "a"), ("d", "b"), ("c", "a")])).orderBy("place").collect()] == ["a", "b", "d", "c"]


def test_scope(spark):
    rows = [("u", 1, "user", "p"), ("u", 2, "excluded_session", None), ("u", 3, "user", "q"), ("v", 1, "user", None), ("v", 2, "pending", None), ("w", 1, "pending", None)]
    evidence = spark.createDataFrame([(s, k, sc, [sc], p) for s, k, sc, p in rows], "session_id string, pos long, scope string, reasons array<string>, parent string")
    got = {r["session_id"]: (r["scope"], r["reasons"], r["parent"]) for r in scope.merged(evidence).collect()}
    assert got == {"u": (EXCLUDED_SESSION, ["user", "excluded_session"], "q"), "v": ("user", ["user", "pending"], None), "w": ("pending", ["pending"], None)}
    meta = spark.createDataFrame([("hid", "archivist", None, None), ("hid", "other", None, None), (None, None, "keeper", None), (None, None, None, "Maintain: x"), (None, None, "build", None), (None, None, None, None)], "flag string, role string, agent string, title string")
    assert [r["c"] for r in meta.select(scope.session_class(["keeper"], ["Maintain:"], [], "hid", ["archivist"]).alias("c")).collect()] == ["excluded_session", "pending", "excluded_session", "excluded_session", "user", "pending"]
    explicit = links(spark, [("a", None)])
    proof = links(spark, [("a", "m"), ("b", "m")])
    assert {tuple(r) for r in scope.parents(explicit, proof).collect()} == {("a", None), ("b", "m")}


def test_precedence_and_folds(spark):
    record = lambda k, q, out, sc=None, up=None: {"message_id": "m", "pos": k, "quality": q, "output": out, "scope": sc, "update": up}
    seq = [record(0, "provisional", 50), record(1, "exact", 20), record(2, "exact", 20), record(3, "provisional", 90)]
    assert ledger.fold(seq)["output"] == 20
    assert ledger.fold([*seq, record(4, "exact", 1, EXCLUDED_ITEM), record(5, "exact", 9)]) is None
    up = lambda n, f, seen=(), i="i": {"instance": i, "sequence": n, "received_at": n, "revision": None, "fingerprint": f, "seen": list(seen)}
    assert ledger.fold([record(0, "exact", 5, None, up(2, "a")), record(1, "exact", 6, None, up(1, "b")), record(2, "exact", 7)])["output"] == 5
    assert ledger.fold([record(0, "exact", 5, None, up(2, "b", ["a"])), record(1, "exact", 6, None, up(3, "a")), record(2, "exact", 0, None, up(3, "c"))])["output"] == 0
    df = spark.createDataFrame([("m", "s", "exact", 1), ("m", "s", "exact", 1), ("m", "s", "other", 1)], "event_id string, session_id string, state string, ts int").withColumn("pos", F.monotonically_increasing_id())
    assert precedence.distinct_facts(df).count() == 2


COPY = "ledger string, message_id string, session_id string, quality string, update struct<instance:string,sequence:double,received_at:double,revision:double,fingerprint:string,seen:array<string>>, output long, excluded boolean, legacy boolean"


def united(spark, rows):
    copies = spark.createDataFrame(rows, COPY)
    sums = copies.filter("not excluded").groupBy("session_id").agg(F.sum("output").alias("output"))
    return {r["session_id"]: r["output"] for r in ledger.ledger_union(copies, sums, ["output"]).collect()}


def test_ledger_union_by_dominance(spark):
    up = lambda sequence, f, i="i", at=1.0: (i, float(sequence), at, None, f, [])
    copy = lambda ledger_, update, output, quality="exact", excluded=False, legacy=False, session="s": (ledger_, "m", session, quality, update, output, excluded, legacy)
    assert united(spark, [copy("a", None, 5), copy("b", None, 5)]) == {"s": 5}
    assert united(spark, [copy("a", up(1, "x"), 5), copy("b", up(2, "y"), 7)]) == {"s": 7}
    assert united(spark, [copy("a", up(2, "x"), 5), copy("b", None, 7)]) == {"s": 5}
    assert united(spark, [copy("a", None, 9, "provisional"), copy("b", None, 7)]) == {"s": 7}
    assert united(spark, [copy("a", None, 9, excluded=True), copy("b", None, 7)]) == {"s": 0}
    # a third copy settles what two others leave open, in another session's favour
    assert united(spark, [copy("a", up(1, "x", "i", 5.0), 5), copy("b", up(1, "y", "j", 5.0), 6), copy("c", up(1, "z", "k", 9.0), 8, session="t")]) == {"s": 0, "t": 8}
    for rows in ([copy("a", None, 5), copy("b", None, 6)], [copy("a", up(1, "x", "i", 5.0), 5), copy("b", up(1, "y", "j", 5.0), 6)], [copy("a", None, 5), copy("b", None, 5, legacy=True)]):
        with pytest.raises(Exception, match="can't be merged"):
            united(spark, rows)


def test_null_executions_and_clocks(spark):
    rows = facts(spark, [("s", "i", None, 1.0, "busy", None, None, "a"), ("s", "j", None, 1.0, "busy", None, None, "b"), ("s", "k", "e", 1.0, "idle", None, None, "c")])
    older = spark.createDataFrame([("i",), ("k",)], "instance_id string")
    assert [(r["instance_id"], r["execution_id"], r["ts"]) for r in activity.recovery_facts(rows, older).collect()] == [("i", None, 1.0)]
    canonical = facts(spark, [("s", "i", None, 1.0, "busy", None, None, "a"), ("s", "i", None, 5.0, "completed", None, None, "z")])
    live = facts(spark, [("s", "i", None, 1.0, "busy", None, None, "a")])
    assert {r["event_id"] for r in activity.reconciled(canonical, live).collect()} == {"a", "z"}
    two = facts(spark, [("s", "i", "e", 1.0, "busy"), ("s", "i", "f", 3.0, "busy"), ("s", "i", "f", 4.0, "busy"), ("s", "i", "g", 9.0, "idle")])
    trusted = spark.createDataFrame([("i",)], "instance_id string")
    assert [tuple(r) for r in activity.latest_executions(two).collect()] == [("s", "i", "f")]
    got = activity.lifecycle_intervals(two, None, 50.0, trusted).collect()
    assert sorted((r["execution_id"], r["start"], r["end"]) for r in got) == [("f", 3.0, 4.0), ("f", 4.0, 50.0)]
    ends = {r["execution_id"]: (r["boundary"], r["proved"]) for r in activity.boundaries(two, trusted, 20.0).collect()}
    assert ends == {"e": (1.0, False), "f": (20.0, True), "g": (9.0, False)}


def test_gaps_open_new_instances(spark):
    rows = facts(spark, [("s", "i", None, 1.0, "busy", None, None, "a"), ("s", "i", None, 9.0, "busy", None, None, "b"), ("t", "i", None, 1.0, "idle", None, None, "c")])
    gaps = spark.createDataFrame([("s", "i", 5.0), ("t", "i", 5.0)], "session_id string, instance_id string, at double")
    got = sorted((r["session_id"], r["instance_id"], r["ts"], r["state"]) for r in activity.split_at_gaps(rows, gaps).collect())
    assert got == [("s", "i", 1.0, "busy"), ("s", "i", 1.0, "stopped"), ("s", "i#1", 9.0, "busy"), ("t", "i", 1.0, "idle")]


@pytest.mark.parametrize("seed", [0, 2])
def test_rollup_and_exclusion_equal_walks(spark, seed):
    """Random forests with cycles against walking up from every node."""
    rng = random.Random(seed)
    n = 40
    parent = {k: (rng.randrange(n) if seed == 2 else rng.randrange(-1, k)) for k in range(n)}
    pairs = [(str(k), str(p) if p >= 0 else None) for k, p in parent.items()]
    value = {k: rng.randrange(100) for k in range(n) if rng.random() < 0.8}

    def above(k):
        seen = []
        while k >= 0 and k not in seen:
            seen.append(k)
            k = parent[k] if parent[k] != k else -1
        return seen

    marked = {k for k in range(n) if rng.random() < 0.1}
    tree, totals = links(spark, pairs), spark.createDataFrame([(str(k), v) for k, v in value.items()], "id string, v long")
    ids = {x for p in pairs for x in p if x and p[1] and p[0] != p[1]} | {str(k) for k in value}
    want = {str(k): sum(v for x, v in value.items() if k in above(x)) for k in range(n)}
    assert {r["id"]: r["including_v"] for r in forest.rollup(totals, tree, ["v"]).collect()} == {k: v for k, v in want.items() if k in ids}
    gone = forest.excluded(tree, spark.createDataFrame([(str(k),) for k in marked], "id string"))
    assert {r["id"] for r in gone.collect()} == {str(k) for k in range(n) if marked & set(above(k))}


def test_long_chains_and_long_ids(spark):
    n = 4000
    chain = links(spark, [(f"{k:05}", f"{k - 1:05}") for k in range(1, n)])
    totals = spark.createDataFrame([(f"{k:05}", 1) for k in range(n)], "id string, v long")
    got = {r["id"]: r["including_v"] for r in forest.rollup(totals, chain, ["v"]).collect()}
    assert len(got) == n and got["00000"] == n and got["03999"] == 1
    long = "a-name-of-more-than-twenty-characters/"
    tree = links(spark, [(long + x, long + y) for x, y in (("b2", "a"), ("b1", "a"), ("c", "b1"), ("d", "b2"))])
    assert [r["id"][len(long) :] for r in forest.listing(tree).orderBy("place").collect()] == ["a", "b1", "c", "b2", "d"]


def test_completeness_of_records(spark):
    from sessiontide.schema import AMOUNT_WEIGHTS, FIELD_WEIGHTS

    row = {"parent_id": "p", "model": "m", "first_token": 1.0, "completed": 2.0, "ttft": None, "duration": 0.0, "input": 1.0, "output": 0.0, "reasoning": None, "cache_read": 3.0, "cache_write": 0.0, "cost": 0.5}
    df = spark.createDataFrame([tuple(row.values()) + ([1, 2, 3],)], ", ".join(f"{c} {'string' if c in ('parent_id', 'model') else 'double'}" for c in row) + ", samples array<int>")
    assert set(row) == {*FIELD_WEIGHTS, *AMOUNT_WEIGHTS}
    assert df.select(precedence.completeness(df.columns).alias("c")).first()["c"] == ledger.completeness(row | {"samples": [1, 2, 3]}) == 2 + 2 + 1 + 3 + 1 + 3 + 5


def test_counters_and_shown_values(spark):
    texts = ['{"inputTokens": 90, "cachedInputTokens": 25, "cacheWriteTokens": 15, "outputTokens": 33, "reasoningTokens": 8}', '{"input": 3, "output": "7", "cache": {"read": 2.5, "write": -1}}', "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").alias("value"))
    got = [tuple(r["c"]) for r in tokens.read(df).select(tokens.counters().alias("c")).collect()]
    assert got == [(50, 25, 8, 25, 15), (3, 0, 0, 2.5, 0), (0, 0, 0, 0, 0)]
    assert [tuple(r["c"]) for r in tokens.read(df).select(tokens.partial(tokens.counters()).alias("c")).collect()][2] == (None,) * 5
    one = spark.range(1)
    cell = lambda c: one.select(c.alias("c")).first()["c"]
    assert cell(tokens.cache_hit_rate(F.lit(60), F.lit(30), F.lit(10))) == 0.6 and cell(tokens.cache_hit_rate(F.lit(0), F.lit(0), F.lit(0))) is None
    assert cell(shown.agent_name(F.lit(" a b "))) == "a b" and cell(shown.agent_name(F.lit("compaction"))) is None and cell(shown.agent_name(F.lit("a\x07"))) is None
    compact = {0.4: "0", -12.5: "-13", 999.0: "999", 1234.0: "1.2k", 2000.0: "2k", 99_960.0: "100k", 123_456.0: "123k", 1_234_567.0: "1.2M", 2e6: "2.0M", 7.26e9: "7.3B"}
    assert {x: cell(shown.shown_compact(F.lit(x))) for x in compact} == compact
    times = {950.4: "950ms", 1000.0: "1s", 12_460.0: "12.5s", 185_000.0: "3m 05s", 3_725_000.0: "1h 02m 05s", -3.0: "0ms"}
    assert {x: cell(shown.shown_duration(F.lit(x))) for x in times} == times
    numbers = {1234.5: "1,234.5", 1234.0: "1,234", 100.0: "100", 0.126: "0.13", 0.005: "0.01"}
    assert {x: cell(shown.shown_number(F.lit(x))) for x in numbers} == numbers and cell(shown.shown_tokens(F.lit(1234.5))) == "1,235"
    assert cell(shown.shown_clock(F.lit(3_725_000.0))) == "01:02:05" and cell(shown.shown_clock(F.lit(0.0))) == "--:--:--" and cell(shown.shown_cost(F.lit(1234.56789))) == "$1,234.5679"
    assert cell(shown.shortened(F.lit("abcdefghij"), 5)) == "a...j" and cell(shown.shortened(F.lit(""), 5)) == "-" and cell(shown.short_tail(F.lit("abcdefghij"), 7)) == "...ghij"
    assert cell(shown.shown_percent(F.lit(0.1256))) == "13%" and cell(shown.shown_percent(F.lit(None).cast("double"))) == "--" and cell(shown.shown_percent(F.lit(7.0))) == "100%"
    record = spark.createDataFrame([(3_725_000.0, 1.0, "session-number-1", "a-model-with-a-name", 1200.0, 34.0, 0.25)], "completed double, start double, session_id string, model string, output double, reasoning double, cost double")
    assert record.select(shown.history_row().alias("c")).first()["c"] == "01:02:05 ...number-1 a-mode...-name  1,200/34     $0.25"
    weights = spark.createDataFrame([(1, k, 1.0, 5) for k in range(3)], "key int, pos int, weight double, target int")
    assert [r["share"] for r in metrics.calibrated(weights).orderBy("pos").collect()] == [2, 2, 1]


def preorder(parent):
    """Plain listing of a forest given as {child: parent}."""
    below = {}
    for c, p in sorted(parent.items()):
        below.setdefault(p, []).append(c)
    out = {}
    for root in sorted(set(parent.values()) - set(parent)):
        todo, place = [(root, 0)], 0
        while todo:
            node, depth = todo.pop()
            place += 1
            out[node] = (root, depth, place)
            todo += [(c, depth + 1) for c in reversed(below.get(node, []))]
    return out


@pytest.mark.parametrize("shape", ["chain", "star", "random", "comb"])
def test_listing_without_closure(spark, shape):
    rng = random.Random(7)
    parent = {
        "chain": {k: k - 1 for k in range(1, 300)},
        "star": {k: 0 for k in range(1, 5000)},
        "random": {k: rng.randrange(k) for k in range(1, 400) if k % 90},
        "comb": {k: (k - 2 if k % 2 else k - 1) if k > 1 else 0 for k in range(1, 200)},
    }[shape]
    got = forest.listing(spark.createDataFrame(list(parent.items()), "child long, parent long"))
    want = preorder(parent)
    assert {r["id"]: (r["root"], r["depth"], r["place"]) for r in got.collect()} == want
    ranks = {r["child"]: r["rank"] for r in forest.ordered_edges(spark.createDataFrame(list(parent.items()), "child long, parent long")).collect()}
    assert ranks == {c: want[p][1] for c, p in parent.items()}
