"""Near-duplicate documents by DartMinHash signatures.

The elements of a document are its runs of five words (a shorter text is one run), weighed by how often they occur. Each
element owns a region of its weight, into which darts are thrown by a hash: the same darts in every document. A document
keeps, for each of its `BANDS * ROWS` coordinates, the dart of earliest rank that lands inside its elements' regions; two
documents agree in a coordinate with the probability of their weighted Jaccard similarity, the sum of the smaller weights
over that of the larger ones. `weighting="set"` weighs every different run 1. To verify pairs, the second, third ...
occurrence of a run counts as an element of its own, so the same similarity is that of two sets.

Documents that agree in a band share a bucket. Copies of one word sequence are represented by the least id before that.
In each bucket the member of least hash is compared with the others by the exact similarity. Members that this leaves in
different components are then compared with all of their bucket, in blocks, by the members that hold each element: those
outside the largest component with all others, no pair as a row, and only links come out. So no link between two texts of a bucket is lost, and large groups of nearly equal
texts are mostly done with after the first step. At similarity 0.8 a pair misses all buckets with a probability of 3e-6.

A null or empty text is in a class of its own, as is a row with a null id (its class is null). Rows that repeat an id
share a class; if their texts differ, the greatest text is compared with those that share a bucket with any of them. An empty table gives no
rows. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, slices, table, written
from .components import components

WORDS, BANDS, ROWS, SIMILARITY = 5, 32, 5, 0.8
#: Elements of a bucket's members that make a block.
BLOCK = 1 << 18
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, and where each text's words begin (with the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(text, "")))
    flat = lists.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()] or [0], np.uint64)
    empty = pc.equal(pc.binary_length(flat.dictionary), 0).to_numpy(zero_copy_only=False)
    numbers, starts = flat.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    if empty.any():  # an empty text is split into one empty word
        keep = ~empty[numbers]
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        numbers = numbers[keep]
    return hashes[numbers], starts


def shingles(hashes: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The runs of words as hashes, with the row of each; a shorter text is one run."""
    n = np.diff(starts)
    out, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(hashes) >= words:
        run = sum(hashes[k : len(hashes) - words + 1 + k] * (ODD[k % 5] + np.uint64(2 * (k // 5))) for k in range(words))
        row = np.repeat(np.arange(len(n)), n)
        inside = row[: len(run)] == row[words - 1 :]
        out.append(mixed(run[inside]))
        rows.append(row[: len(run)][inside])
    for r in np.flatnonzero((n > 0) & (n < words)):
        own = hashes[starts[r] : starts[r + 1]]
        out.append(mixed(np.array([sum(int(h) * int(o) for h, o in zip(own, ODD, strict=False)) + len(own) & (1 << 64) - 1], np.uint64)))
        rows.append(np.array([r]))
    return np.concatenate(out), np.concatenate(rows)


def counted(elements: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's different elements, in order of row, and how often they occur in it."""
    order = np.lexsort((elements, rows))
    elements, rows = elements[order], rows[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(rows), 1), bool), (elements[1:] != elements[:-1]) | (rows[1:] != rows[:-1])]))
    return elements[starts], rows[starts], np.diff(np.append(starts, len(rows)))


def occurrences(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A different hash for each occurrence of an element, the element's own for its first."""
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.repeat(elements, counts)
    later = nth > 0
    out[later] = mixed(out[later] + nth[later].astype(np.uint64) * ODD[1])
    return out


def dart_signatures(elements: np.ndarray, weights: np.ndarray, rows: np.ndarray, count: int, k: int) -> np.ndarray:
    """(count, k) darts; a row without elements has zeros. An element may occur twice in a row: its darts are the same.

    An element's region is cut at weights 1, 2, 4 and so on; each part has its own series of darts in order of rank, with
    exponential steps. A row is searched to the rank where its coordinates are all but surely filled, and on while not.
    """
    parts = np.maximum(0, np.ceil(np.log2(np.maximum(weights, 1)))).astype(int)
    element = np.repeat(np.arange(len(elements)), parts + 1)
    part = np.arange(len(element)) - np.repeat(np.cumsum(parts + 1) - parts - 1, parts + 1)
    low = np.where(part > 0, 2.0 ** (part - 1), 0.0)
    width = np.where(part > 0, low, 1.0)
    seed = mixed(elements[element] + part.astype(np.uint64) * ODD[0])
    row, reach = rows[element], (weights[element] - low) / width
    total = np.bincount(rows, weights, count)
    limit = k * (np.log(k) + 4) / np.maximum(total, 1e-300)
    best, sig = np.full(count * k, np.inf), np.zeros(count * k, np.uint64)
    rank = np.zeros(len(element))
    step = np.zeros(len(element), np.uint64)
    active = np.flatnonzero(reach > 0)
    unit = 1.0 / (1 << 53)
    waiting_rank, waiting = np.full(len(element), -1.0), np.zeros(len(element), np.uint64)
    while True:
        stopped = []
        while len(active):
            fresh = waiting_rank[active] < 0
            h = np.where(fresh, mixed(seed[active] + (step[active] + np.uint64(1)) * ODD[1]), waiting[active])
            at = np.where(fresh, rank[active] - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * unit) / width[active], waiting_rank[active])
            near = at <= limit[row[active]]
            late = active[~near]  # kept for a further search
            waiting_rank[late], waiting[late] = at[~near], h[~near]
            stopped.append(late)
            active, at, h = active[near], at[near], h[near]
            rank[active], waiting_rank[active] = at, -1.0
            step[active] += np.uint64(1)
            g = mixed(h + ODD[2])
            hit = (g >> np.uint64(11)).astype(float) * unit < reach[active]
            dart = mixed(g + ODD[3])
            place = row[active] * k + (dart % np.uint64(k)).astype(np.int64)
            place, when, dart = place[hit], at[hit], dart[hit]
            np.minimum.at(best, place, when)
            won = best[place] == when
            sig[place[won]] = dart[won]
        lacking = (np.isinf(best).reshape(count, k).any(1)) & (total > 0)
        if not lacking.any():
            return sig.reshape(count, k)
        limit = np.where(lacking, limit * 2, -1.0)
        active = np.concatenate(stopped) if stopped else np.zeros(0, np.int64)
        active = active[lacking[row[active]]]
        if not len(active):
            return sig.reshape(count, k)


def signatures(docs: DataFrame, weighting: str = "count") -> DataFrame:
    """(doc_id, copy_key, buckets): the key is equal for equal word sequences; no buckets without words."""
    rows = id_text(docs).filter("doc_id is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            hashes, starts = word_hashes(batch.column(1))
            elements, row, count = counted(*shingles(hashes, starts))
            weights = count.astype(float) if weighting == "count" else np.ones(len(elements))
            sig = dart_signatures(elements, weights, row, batch.num_rows, BANDS * ROWS).reshape(-1, BANDS, ROWS)
            band = sum(mixed(sig[:, :, r] + ODD[r % 5]) * (ODD[r % 5] + np.uint64(2 * r)) for r in range(ROWS))
            bucket = mixed(band + np.arange(1, BANDS + 1, dtype=np.uint64) * ODD[0]).view(np.int64)
            some = np.diff(starts) > 0
            keys = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if b > a else None for a, b in zip(starts[:-1], starts[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(bucket[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), lists], ["doc_id", "copy_key", "buckets"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"doc_id {kind}, copy_key binary, buckets array<bigint>")


def element_sets(docs: DataFrame, weighting: str = "count") -> DataFrame:
    """(doc_id, elements): the occurrences of its runs of words, or each different run once."""
    rows = id_text(docs)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            elements, row, count = counted(*shingles(*word_hashes(batch.column(1))))
            if weighting == "count":
                elements, row = occurrences(elements, count), np.repeat(row, count)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "elements"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sets, f"doc_id {kind}, elements array<bigint>")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sets have the Jaccard similarity asked for, or more."""
    of = lambda end, name: sets.select(F.col("doc_id").alias(end), F.col("elements").alias(name))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    return met.filter(both >= F.lit(threshold) * (F.size("x") + F.size("y") - both)).select("a", "b")


def linked(sets: list[np.ndarray], roots: list, threshold: float) -> list[tuple[int, int]]:
    """Pairs of members that are similar enough and join two components; those that only join what is joined are left out.

    Counts what a member shares with all others at once, by lists of the members that hold each element. One of a pair from
    two components is not in the group's largest, so only those are counted for.
    """
    number: dict = {}
    up = [number.setdefault(r, k) for k, r in enumerate(roots)]
    largest = Counter(up).most_common(1)[0][0]

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    member = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(codes.max() + 2))
    holders, counts, ends = member[order], np.diff(starts), np.cumsum(sizes)
    out = []
    for m in [k for k, r in enumerate(up) if r != largest]:
        own = codes[ends[m] - sizes[m] : ends[m]]
        n = counts[own]
        places = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(holders[places], minlength=len(sets))
        for k in np.flatnonzero(both >= threshold * (sizes[m] + sizes - both)):
            x, y = top(m), top(int(k))
            if x != y:
                up[x] = y
                out.append((m, int(k)))
    return out


def _across(rest: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components yet, all of them compared.

    One of such a pair is outside the bucket's largest component. The largest one and what is outside are cut into blocks of
    about `BLOCK` elements by a hash of the member, and a group of rows is a block of each, or two blocks from outside: a
    task holds two blocks however large the bucket, and where most members are in one component, each of them is sent once
    for every block of the few others. Only links come out.
    """
    placed = rest.join(roots, rest["rep"] == roots["id"], "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    several = written(placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bucket"), "several")
    held = written(placed.join(several, "bucket").join(sets.select(F.col("doc_id").alias("rep"), "elements"), "rep"), "rest")
    of_root = held.groupBy("bucket", "root").agg(F.sum(F.size("elements")).alias("n"))
    sides = of_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sides = written(sides.select("bucket", F.col("top.root").alias("largest"), blocks(F.col("top.n")).alias("inner"), blocks(F.col("all") - F.col("top.n")).alias("outer")), "sides")
    cut = held.join(sides, "bucket").withColumn("inside", F.col("root") == F.col("largest"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("rep", "bucket"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    with_inner = F.transform(upto("inner"), lambda k: F.xxhash64("bucket", F.lit(0), k, "own"))
    with_outer = F.transform(F.filter(upto("outer"), lambda k: k != F.col("own")), lambda k: F.xxhash64("bucket", F.lit(1), F.least(k, F.col("own")), F.greatest(k, F.col("own"))))
    groups = F.when(F.col("inside"), F.transform(upto("outer"), lambda k: F.xxhash64("bucket", F.lit(0), "own", k))).otherwise(F.concat(with_inner, with_outer))
    keyed = cut.select(F.explode(groups).alias("key"), "rep", F.xxhash64("root").alias("root"), "elements")
    kind = sets.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, roots_, held_ = None, [], [], []
        kind_ = None

        def found() -> pa.RecordBatch:
            pairs = linked(held_, roots_, threshold) if len(set(roots_)) > 1 else []
            ends = [sorted((reps[m], reps[k])) for m, k in pairs]
            return pa.RecordBatch.from_arrays([pa.array([e[n] for e in ends], kind_) for n in (0, 1)], ["a", "b"])

        for batch in batches:
            kind_ = batch.schema.field(1).type
            flat, cuts = batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
            cuts = cuts - cuts[0] if len(cuts) else cuts
            for n, (k, rep, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if k != key and reps:
                    yield found()
                    reps, roots_, held_ = [], [], []
                key = k
                reps.append(rep)
                roots_.append(root)
                held_.append(flat[cuts[n] : cuts[n + 1]])
        if reps:
            yield found()

    return keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(compare, f"a {kind}, b {kind}")


def near_classes(docs: DataFrame, threshold: float = SIMILARITY, weighting: str = "count") -> DataFrame:
    """(doc_id, class_id): one row per document; class_id is the least id of the documents linked to it, itself included."""
    signed = written(signatures(docs, weighting), "signed")
    copies = signed.filter("copy_key is not null").groupBy("copy_key").agg(F.min("doc_id").alias("rep"), F.first("buckets").alias("buckets"))
    copies = written(copies, "copies")
    reps = copies.select("rep", F.explode("buckets").alias("bucket"))
    order = F.struct(F.xxhash64("rep").alias("h"), F.col("rep"))
    shared = reps.groupBy("bucket").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    shared = written(shared.select("bucket", F.col("first.rep").alias("centre")), "buckets")  # so that adaptive execution can split hot buckets in the join
    members = written(reps.join(shared, "bucket").select("bucket", "rep", "centre"), "members")
    kind = signed.schema["doc_id"].dataType.simpleString()
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = id_text(docs).join(involved, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    sets = written(element_sets(texts, weighting), "sets")
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    links = written(_similar(members.filter("rep <> centre").select(*ends("rep", "centre")).distinct(), sets, threshold), "similar")
    roots = written(components(links), "roots")
    rest = members.filter("rep <> centre").select("bucket", "rep")
    links = links.unionByName(_across(rest, roots, sets, threshold))
    roots = components(links)
    named = copies.join(roots, copies["rep"] == roots["id"], "left").select("copy_key", F.coalesce("root", "rep").alias("class_id"))
    own = signed.select("doc_id", "copy_key").join(named, "copy_key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    without = id_text(docs).filter("doc_id is null").select("doc_id", F.lit(None).cast(kind).alias("class_id"))
    return own.unionByName(without)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without those that have an earlier one in their class."""
    later = near_classes(docs).filter("class_id <> doc_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
