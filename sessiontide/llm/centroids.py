"""Lloyd's clustering over integer vectors with a pivot table.

Each vector's distances to a few fixed pivots are computed once and stored beside it. By the triangle inequality the
difference of two distances to a pivot is a lower bound of the distance between vector and centroid, so in every round the
stored distances rule out most centroids; only those whose bound does not exceed the best distance so far get an exact
distance, over integers. Bounds are floats, lowered by more than their rounding error, so they never rule out a nearest
centroid or one that ties with it. A round is one pass over the stored table: tasks send one row of integer sums a centroid.

Vectors are kept if they have exactly `dims` components, none null, NaN or infinite, and none whose magnitude exceeds `LARGEST`, beyond which
a squared distance need not fit a long. Of equal hashes the smaller id starts first, then the smaller vector; a null id
hashes as an empty one. Rows that repeat an id are vectors of their own. With fewer kept vectors than centroids each is one;
without any there are no rows. Only id and vector are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE = 1024
#: Of a component before scaling: 64 squares of differences of twice its 1024-fold fit a long.
LARGEST = float(1 << 17)
#: Pivots, and the vectors from which they are chosen, farthest first. They change the work, never the result.
PIVOTS, PIVOT_SAMPLE = 8, 1024
#: More than the relative rounding error of a square root and a difference.
ROUNDING = 1e-12


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(vec_id, v) of the kept vectors: v holds floor(1024 * component)."""
    raw = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("raw"))
    fine = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return raw.filter((F.size("raw") == dims) & fine).select("vec_id", F.transform("raw", lambda x: F.floor(x * F.lit(float(SCALE))).cast("int")).alias("v"))


def _first(kept: DataFrame, salt: str, rows: int) -> np.ndarray:
    """The vectors with the smallest hashes of salt and id."""
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    got = kept.select(hashed.alias("hash"), "vec_id", "v").orderBy("hash", "vec_id", "v").limit(rows).collect()
    return np.array([r["v"] for r in got], np.int64)


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Of the sample, the first vector and then always the one farthest from those chosen."""
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < pivots and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Float distances of all vectors to all points."""
    return np.sqrt(np.stack([((vectors - p) ** 2).sum(1) for p in points], 1).astype(np.float64))


def nearest(vectors: np.ndarray, stored: np.ndarray, centroids: np.ndarray, bounds_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid and its squared distance, ties to the smaller number, and how many exact distances that took.
    `stored` are the vectors' distances to the pivots, `bounds_at` the centroids'."""
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(stored.shape[1]):
        a, b = stored[:, p, None], bounds_at[None, :, p]
        np.maximum(bound, np.abs(a - b) - ROUNDING * (a + b), out=bound)
    start = bound.argmin(1)
    best, found, exact = ((vectors - centroids[start]) ** 2).sum(1), start.copy(), len(vectors)
    for j in range(len(centroids)):
        left = np.flatnonzero((bound[:, j] <= np.sqrt(best.astype(np.float64)) * (1 + ROUNDING)) & (start != j))
        d = ((vectors[left] - centroids[j]) ** 2).sum(1)
        better = (d < best[left]) | ((d == best[left]) & (j < found[left]))
        best[left[better]], found[left[better]] = d[better], j
        exact += len(left)
    return found, best, exact


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def _sums(stored: DataFrame, centroids: np.ndarray, bounds_at: np.ndarray) -> list:
    """Count and componentwise sums by nearest centroid; one row a centroid reaches the driver."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), np.int64)
            found, _, _ = nearest(v, _matrix(batch.column(1), np.float64), centroids, bounds_at)
            count += np.bincount(found, minlength=k)
            for j in range(k):
                total[j] += v[found == j].sum(0)
        had = np.flatnonzero(count)
        yield pa.record_batch([pa.array(had.astype(np.int32)), pa.array(count[had]), pa.array(list(total[had]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = stored.select("v", "pivot").mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dims))).collect()


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3:", pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept vector.

    The centroids start as the k vectors with the smallest lowercase-hex sha256 of salt and id, become the exact floors
    of their vectors' means in each round, and stay where they are while they have none.
    """
    if not 1 <= dims <= 64:
        raise ValueError("squared distances of more than 64 components need not fit a long")
    kept = integer_vectors(vectors, id_col, vector_col, dims)
    kind = kept.schema["vec_id"].dataType.simpleString()
    centroids, sample = _first(kept, salt, k), _first(kept, f"pivot:{salt}", PIVOT_SAMPLE)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    fixed = choose_pivots(sample, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = distances(_matrix(batch.column(1), np.int64), fixed)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(to), pa.list_(pa.float64()))], ["vec_id", "v", "pivot"])

    stored = written(kept.mapInArrow(measure, f"vec_id {kind}, v array<int>, pivot array<double>"), "pivot-table")
    for _ in range(rounds):
        for r in _sums(stored, centroids, distances(centroids, fixed)):
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    bounds_at = distances(centroids, fixed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, best, _ = nearest(_matrix(batch.column(1), np.int64), _matrix(batch.column(2), np.float64), centroids, bounds_at)
            yield pa.record_batch([batch.column(0), pa.array(found.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    assigned = written(stored.mapInArrow(assign, f"vec_id {kind}, cluster int, distance bigint"), "assigned", instead_of=stored)
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    of = lambda values, kind: F.array(*(F.lit(x).cast(kind) for x in values))[F.col("cluster")]
    return assigned.withColumns(
        {
            "cluster_inertia": of([inertia.get(j, 0) for j in range(len(centroids))], "bigint"),
            "inertia": F.lit(sum(inertia.values())).cast("bigint"),
            "centroid_sha256": of([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], "string"),
        }
    )


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


_ROUND = """
a{r} as materialized (
    select k.rid, k.vec_id, k.v,
           min({{d: list_sum([(k.v[i] - c.v[i]) * (k.v[i] - c.v[i]) for i in range(1, 65)])::bigint, c: c.c}}) as m
    from kept k, c{r} c group by all
),"""
_MOVE = """
s{r} as (select m.c as c, i, sum(v[i])::hugeint as s, count(*)::hugeint as n from a{r}, (select unnest(range(1, 65)) as i) group by all),
m{r} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from s{r} group by c),
c{next} as materialized (select c, coalesce(m{r}.v, c{r}.v) as v from c{r} left join m{r} using (c)),"""

CENTROID_SQL = (
    """
with kept as materialized (
    select row_number() over () as rid, vec_id, [floor(1024 * x::double)::bigint for x in embedding] as v
    from embeddings
    where len(embedding) = 64 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
),
c0 as materialized (
    select (row_number() over (order by sha256('3:' || vec_id), vec_id) - 1)::int as c, v
    from kept qualify row_number() over (order by sha256('3:' || vec_id), vec_id) <= 8
),"""
    + "".join(_ROUND.format(r=r) + _MOVE.format(r=r, next=r + 1) for r in range(10))
    + _ROUND.format(r=10).rstrip(",")
    + """
select vec_id, m.c as cluster, m.d as distance,
       (sum(m.d) over (partition by m.c))::bigint as cluster_inertia,
       (sum(m.d) over ())::bigint as inertia,
       sha256(array_to_string(c10.v, ',')) as centroid_sha256
from a10 join c10 on c10.c = a10.m.c
"""
)
