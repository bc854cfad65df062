"""Quality rules: rule statistics of every text, and an isolation forest over them.

Each tree of the forest splits a small draw of all labelled rows, as the method has it, at random features and values; the
draws are the smallest hashes of a row and the tree. Documents that random splits set apart after few steps are anomalous. The
threshold on the anomaly score is calibrated on all labelled rows: it rejects the most of bad quality, a good one lost weighing
`WORTH` times as much. Statistics, draws, scores and running counts are Spark jobs; the driver gets the draws alone.

Null and empty texts have no words and fail the base rules, as all texts under 20 words do. Without labelled rows
there is no forest and the base rules decide alone. Repeated rows and rows with a null id get a row each, texts with equal
statistics the same verdict, an empty table no rows. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, slices, table, written

TREES, DRAW, SEED = 100, 256, 6
#: A good document lost weighs as many bad ones kept, in shares of their kinds.
WORTH = 4.0
#: Shares of repeated lines and words that say nothing.
USUAL_DUPS, USUAL_REPEATS = 0.3, 0.15
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = b"#*$%&|<>"
SPACE = bytes([32, 9, 10, 11, 12, 13])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols", "capitals", "others", "variety", "dup_lines", "repeats")


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    if len(codes) == n:
        return 0
    for step in (1, 2, 4):  # names of runs of 2, 4, then 8 words
        names = int(ids.max()) + 1
        _, ids, counts = np.unique(ids[:-step] * names + ids[step:], return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0
    starts = np.flatnonzero(counts[ids] > 1)
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + WINDOW, minlength=n + 1)
    return int((np.cumsum(edges) > 0).sum())


def rule_stats(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts, and the features of the forest."""
    data = (text or "").encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = int(seen[:128].sum() + seen[192:].sum())
    spaces = int(seen[list(SPACE)].sum())
    symbols = int(seen[list(SYMBOLS)].sum())
    dups, repeats, n = len(lines) - len(set(lines)), repeated_words(words), len(words)
    letters = int(seen[65:91].sum() + seen[97:123].sum() + seen[192:].sum())
    per = max(n, 1)
    # shares of all counts; repetition only beyond what good documents often have, which would set them apart too
    features = [
        (chars - spaces) / per,
        symbols / per,
        int(seen[65:91].sum()) / max(letters, 1),
        (chars - spaces - letters) / max(chars, 1),
        len(set(words)) / per**0.85,
        max(0.0, dups / max(len(lines), 1) - USUAL_DUPS),
        max(0.0, repeats / per - USUAL_REPEATS),
    ]
    return [n, chars - spaces, symbols, dups, repeats], features


def fails_base(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


def usual_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n leaves."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees as arrays: feature (-1 at a leaf), split value, first child, and the path length that a leaf stands for."""

    def __init__(self, rows: np.ndarray | None, trees: int = TREES, draw: int = DRAW, seed: int = SEED, draws: list[np.ndarray] | None = None):
        """From rows, of which each tree draws some, or from the draws, which are equally long."""
        rng = np.random.default_rng(seed)
        self.draw = len(draws[0]) if draws else min(draw, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.draw, 2)))))
        self.trees = [self._grow(own, rng) for own in draws or (rows[rng.choice(len(rows), self.draw, replace=False)] for _ in range(trees))]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, value, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, held, depth = todo.pop()
            low, high = held.min(0), held.max(0)
            open_ = np.flatnonzero(high > low)
            if depth >= self.depth or len(held) < 2 or not len(open_):
                path[node] = depth + usual_path(len(held))
                continue
            f = int(rng.choice(open_))
            v = float(rng.uniform(low[f], high[f]))
            left = held[:, f] <= v
            feature[node], value[node], child[node] = f, v, len(feature)
            for side in (held[left], held[~left]):
                todo.append((len(feature), side if len(side) else held[:1], depth + 1))
                for column, start in ((feature, -1), (value, 0.0), (child, 0), (path, 0.0)):
                    column.append(start)
        return np.array(feature), np.array(value), np.array(child), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; near 1 for what few splits set apart."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, value, child, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                step = child[node] + (rows[each, np.maximum(f, 0)] > value[node])
                node = np.where(inner, step, node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(usual_path(self.draw), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, worth: float) -> float:
    """The threshold with the greatest share of bad rows above it, less `worth` times the share of good ones; the highest of equals."""
    if good.all() or not good.any():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    bad_above, good_above = np.cumsum(~good[order]) / (~good).sum(), np.cumsum(good[order]) / good.sum()
    gain = np.where(np.diff(scores[order], append=-1.0) < 0, bad_above - worth * good_above, -1.0)
    best = int(gain.argmax())
    if gain[best] <= 0:
        return float("inf")
    below = scores[order[best + 1]] if best + 1 < len(order) else 0.0
    return float((scores[order[best]] + below) / 2)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the five counts, the features) of every text."""
    rows = id_text(docs, id_col, text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [rule_stats(t) for t in batch.column(1).to_pylist()]
            counts, features = np.array([c for c, _ in got], np.int64), np.array([f for _, f in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts.T), *map(pa.array, features.T)], ["doc_id", *COUNTS, *FEATURES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, {', '.join(f'{f} double' for f in FEATURES)}")


def columns_of(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names])


def tree_draws(labelled: DataFrame, trees: int = TREES, draw: int = DRAW, seed: int = SEED) -> list[np.ndarray]:
    """For each tree the features of the rows of smallest hash; a partition names its own smallest ones, and of these the smallest stay."""
    rows = labelled.select(F.xxhash64("doc_id", *FEATURES, F.lit(seed)).alias("hash"), *FEATURES)
    step, odd, mix = 0x9E3779B97F4A7C15, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64), np.empty((0, len(FEATURES)))) for _ in range(trees)]
        for batch in batches:
            marks, features = batch.column(0).to_numpy().view(np.uint64), columns_of(batch, FEATURES)
            for t, (own, kept) in enumerate(held):
                h = (marks + np.uint64(step * (t + 1) % 2**64)) * mix
                h = (h ^ (h >> np.uint64(29))) * odd
                h = np.concatenate([own, (h ^ (h >> np.uint64(32))).view(np.int64)])
                first = np.argsort(h, kind="stable")[:draw]
                held[t] = h[first], np.concatenate([kept, features])[first]
        for t, (own, kept) in enumerate(held):
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(own), *map(pa.array, kept.T)], ["tree", "hash", *FEATURES])

    named = rows.mapInArrow(smallest, f"tree int, hash bigint, {', '.join(f'{f} double' for f in FEATURES)}")
    place = F.row_number().over(Window.partitionBy("tree").orderBy("hash", *FEATURES))
    got = named.withColumn("place", place).filter(F.col("place") <= draw).orderBy("tree", *FEATURES).toPandas()
    return [own[list(FEATURES)].to_numpy() for _, own in got.groupby("tree")]


def threshold(scored: DataFrame, worth: float = WORTH) -> float:
    """`calibrate` over a table (score, label) of any size: counts by score, dealt by ranges of scores, and running sums within them."""
    counted = scored.groupBy("score").agg(F.count(F.when(F.col("label") != 1, 1)).alias("bad"), F.count(F.when(F.col("label") == 1, 1)).alias("good"))
    points = written(counted.repartitionByRange(F.desc("score")).withColumn("range", F.spark_partition_id()), "scores")
    sums = points.groupBy("range").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).orderBy("range").collect()
    bad, good = (sum(r[c] for r in sums) for c in ("bad", "good"))
    if not bad or not good:
        return float("inf")
    before = [(r["range"], sum(x["bad"] for x in sums[:k]), sum(x["good"] for x in sums[:k])) for k, r in enumerate(sums)]
    starts = scored.sparkSession.createDataFrame(before, "range int, bad0 long, good0 long")
    upto = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = {c: F.sum(c).over(upto) + F.col(f"{c}0") for c in ("bad", "good")}
    gains = points.join(starts, "range").select("score", (above["bad"] / F.lit(bad) - F.lit(worth) * (above["good"] / F.lit(good))).alias("gain"))
    best = gains.orderBy(F.desc("gain"), F.desc("score")).first()
    if best["gain"] <= 0:
        return float("inf")
    below = points.filter(F.col("score") < best["score"]).agg(F.max("score")).first()[0]
    return float((best["score"] + (below or 0.0)) / 2)


def fit_forest(docs: DataFrame, labels: DataFrame, worth: float = WORTH, stats: DataFrame | None = None) -> tuple[Forest, float] | None:
    """Forest and threshold from all labelled rows that pass the base rules; `stats` are the documents' statistics, if known."""
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    stats = statistics(docs) if stats is None else stats
    passed = (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words"))
    labelled = written(stats.filter(passed).join(known, "doc_id").select("doc_id", "label", *FEATURES), "labelled")
    draws = tree_draws(labelled)
    if not draws or len(draws[0]) < 2:
        return None
    forest = Forest(None, draws=draws)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(columns_of(batch, FEATURES)))], ["label", "score"])

    return forest, threshold(labelled.select("label", *FEATURES).mapInArrow(score, "label int, score double"), worth)


def verdicts(stats: DataFrame, model: tuple[Forest, float] | None) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept, anomaly) from statistics; kept is base-passed and not anomalous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = fails_base(columns_of(batch, COUNTS))
            score = model[0].score(columns_of(batch, FEATURES)) if model else np.zeros(batch.num_rows)
            kept = ~failed & (score <= model[1] if model else True)
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(COUNTS)], pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, kept boolean, anomaly double")


def judge(docs: DataFrame, model: tuple[Forest, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`verdicts` on every text, in one pass without a shuffle."""
    return verdicts(statistics(docs, id_col, text_col), model)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = written(statistics(docs), "statistics")  # texts are read once
    return verdicts(stats, fit_forest(docs, table(spark, sf_dir, "labels"), stats=stats))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with all their columns. Null and empty texts go, rows that repeat
    an id or have none are judged by their own text, and an empty table gives none."""
    model = fit_forest(docs, table(spark, sf_dir, "labels"))
    columns = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [rule_stats(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            counts, features = np.array([c for c, _ in got], np.int64), np.array([f for _, f in got])
            kept = ~fails_base(counts) & (model[0].score(features) <= model[1] if model else True)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, columns)
