"""Exact duplicates, centroid clustering and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from fixtures import SMALL, docs, odd_rows, prose

from sessiontide.llm import centroids, exact, variants


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sql_rows(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = con.sql(sql)
    return got.columns, sorted(got.fetchall(), key=repr)


# exact duplicates


def equal_plainly(rows, largest):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    least = lambda i: (i is not None, i or 0)
    out = []
    for text, ids in groups.items():
        stays = (max if largest else min)(ids, key=least)
        left = 1
        for i in ids:
            own, left = (i == stays and left > 0), left - (i == stays)
            out.append((i, stays, len(ids), own, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_query_equals_sql(spark):
    got = exact.op13_exact_dedup(spark, SMALL)
    columns, want = sql_rows(exact.EXACT_SQL, "documents")
    assert rows_of(got.select(*columns)) == want


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("parts", [1, 3, 12])
def test_exact_groups_over_many_ranges(spark, keep, parts):
    """A third of the rows are one text, others share a long beginning, some repeat id and text."""
    rng = random.Random(parts)
    start = prose(40, 1)
    rows = [(i, rng.choice([start, start, start + rng.choice("abc"), prose(5, rng.randrange(9)), "", None])) for i in range(400)] + [(7, start)] * 60 + [(None, start), (None, None)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(exact.equal_groups(docs(spark, rows).repartition(5), keep=keep)) == equal_plainly(rows, keep == "largest")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exact_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()]
    assert rows_of(exact.equal_groups(docs(spark, odd_rows()), keep="largest")) == equal_plainly(rows, True)
    assert rows_of(exact.equal_groups(docs(spark, []))) == []


def test_exact_with_a_normal_form(spark):
    from pyspark.sql import functions as F

    got = exact.equal_groups(docs(spark, [(1, "A b"), (2, "a B"), (3, "c")]), normalise=F.lower("text"))
    assert [r[:4] for r in rows_of(got)] == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)]


@pytest.mark.parametrize("cut", [1, 2, 3, 50])
def test_colliding_hashes_stay_apart(cut):
    """Different texts under one key: neighbours are compared whole, however the batches are cut."""
    import pyarrow as pa

    rows = [("a", 1, "a1", 1), ("a", 1, "a1", 4), ("a", 1, "a2", 2), ("b", 5, "b", 3), ("b", 5, "b", 6), ("c", 1, "c1", 7), ("c", 1, "c2", 5), ("c", 1, "c2", 8)]
    schema = pa.schema([("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("kept", pa.bool_()), ("text_sha256", pa.string()), ("part", pa.int32()), ("run", pa.int64()), ("text", pa.string())])
    walk, out = exact._Range(9, schema, True), []
    for k in range(0, len(rows), cut):
        head, mixed, text, ids = zip(*rows[k : k + cut], strict=True)
        out += walk.add(pa.record_batch([pa.array(ids), pa.array(text), pa.array(head), pa.array(mixed)], ["doc_id", "text", "head", "mixed"]))
    out += walk.end()
    found = [r for b in out for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["part"] is not None) for r in found if r["text"] is None) == [
        (1, 4, 2, True), (2, 2, 1, True), (3, 6, 2, False), (4, 4, 2, True), (5, 8, 2, True), (6, 6, 2, False), (7, 7, 1, True), (8, 8, 2, True)
    ]
    assert sorted((r["text"], r["group_size"]) for r in found if r["text"]) == [("a1", 2), ("a2", 1), ("c1", 1), ("c2", 2)]


# centroid clustering


def lloyd(rows, k=8, rounds=10, dims=64):
    """Plain version with Python's integers."""
    kept = [(i, [int(np.floor(1024.0 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        member = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), m in zip(kept, member, strict=True) if m == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, d, j in got:
        total[j] += d
    return sorted(((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in got), key=repr)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, v string, pivot string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "v", "p", "c") for i, v in rows], EMBEDDINGS)


def test_centroid_query_equals_sql(spark):
    columns, want = sql_rows(centroids.CENTROID_SQL, "embeddings")
    assert rows_of(centroids.op11_centroid_clustering(spark, SMALL).select(*columns)) == want


def test_centroids_equal_plain_version_on_odd_rows(spark):
    """Ties, repeats, nulls, infinite and short vectors, and far too few different ones for eight centroids."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 64).astype(float).tolist()) for i in range(60)] + [(5, [0.5] * 64)] * 9 + [(None, [0.25] * 64)]
    odd = [(90, None), (91, []), (92, [1.0] * 63), (93, [1.0] * 65), (94, [None] + [1.0] * 63), (95, [float("nan")] * 64), (96, [float("inf")] + [0.0] * 63)]
    assert rows_of(centroids.cluster(vectors(spark, rows + odd))) == lloyd(rows + odd)
    few = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-1.0] * 64)]
    assert rows_of(centroids.cluster(vectors(spark, few))) == lloyd(few)
    assert rows_of(centroids.cluster(vectors(spark, odd))) == []


def test_pivots_rule_centroids_out_without_changing_the_answer():
    rng = np.random.default_rng(1)
    middle = rng.integers(-9000, 9000, (8, 64))
    v = (middle[rng.integers(0, 8, 4000)] + rng.integers(-300, 300, (4000, 64))).astype(np.int64)
    cents = np.concatenate([middle[:7], middle[:1]]).astype(np.int64)  # the last ties with the first
    fixed = centroids.choose_pivots(v[:500], 8)
    found, best, exact_ones = centroids.nearest(v, centroids.distances(v, fixed), cents, centroids.distances(cents, fixed))
    all_d = ((v[:, None] - cents[None]) ** 2).sum(2)
    assert (found == all_d.argmin(1)).all() and (best == all_d.min(1)).all()
    assert exact_ones < 0.5 * all_d.size
    large = np.array([[1 << 27] * 64, [-(1 << 27)] * 64], np.int64)
    assert centroids.nearest(large, centroids.distances(large, fixed), large[::-1], centroids.distances(large[::-1], fixed))[0].tolist() == [1, 0]


# spelling variants


def variants_plainly(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        others = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for k in (0, 1) for i in range(len(w) + 1 - k) for c in letters}
        near[w] = [o for o in others if o in n and o != w]
    form = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def test_variants_of_the_small_table_equal_plain_version(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    assert rows_of(variants.op12_spelling_variants(spark, SMALL)) == variants_plainly(list(zip(t["doc_id"], t["text"], strict=True)))


@pytest.mark.parametrize("filter_bytes", [1 << 20, 64])
def test_variants_in_one_pass_and_in_many(spark, filter_bytes):
    rng = random.Random(2)
    letters = "aabcé×ÿ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 8))) for _ in range(60)]
    words += [w[:i] + rng.choice(letters) + w[i + rng.randrange(2) :] for w in words for i in [rng.randrange(len(w))]]
    rows = [(d, " ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(200)) + " É-x") for d in range(30)]
    assert rows_of(variants.variant_groups(docs(spark, rows), filter_bytes=filter_bytes)) == variants_plainly(rows)


def test_variants_of_odd_rows(spark):
    long = "ab" * 3000
    rows = [(1, f"{long} {long} {long}x {long}x"), (2, f"{long} {long}x {long[:-1]} {long[:-1]} {long[:-1]}"), *((r[0], r[1]) for r in odd_rows() if r[0] != 7), (3, "chain " * 3 + "chains " * 6 + "chaints " * 12)]
    assert rows_of(variants.variant_groups(docs(spark, rows))) == variants_plainly(rows)
    assert rows_of(variants.variant_groups(docs(spark, []))) == []
