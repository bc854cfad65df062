"""Benchmark decontamination: word runs find passages, Smith-Waterman alignment of words scores them.

1. Every run of three words of a test item is a seed, so three words left in place are enough, however common they are;
   an item of one or two words is one run. A copy with no three words in a row left is not looked for.
2. Documents are searched for seeds; around them passages as long as an alignment over the threshold may need are cut
   out, overlapping ones as one up to a few times that length. Items are searched for by classes of length, each within a factor of
   two, so a long item does not lengthen the passages of short ones. A bit table of bounded size for each class spares all
   other runs; what passes it by chance finds no partner in the join.
3. Passage and item are joined on the seed and aligned: a word that agrees counts 2, one that differs or is left out
   costs 1. The score is the best local alignment's share of what the whole item would count. Pairs are spared the
   alignment only if the words they share cannot reach the threshold in any order.

Words are compared in lower case without the punctuation around them. Null and empty texts, items without a word and
items with a null id match nothing, and an empty table on either side gives no rows. A document with a null id is aligned
like any other. Rows that repeat an id count as one document, with the best score of any; of equal scores the earliest
place counts. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, slices, table, written

RUN, THRESHOLD = 3, 0.4
#: Bits of the search tables: of each at least, and of all together at most (16 MB), however large the benchmark.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 27
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡«»“”‘’„…–—"
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def plain(text: str | None) -> list[str]:
    return [w for x in (text or "").split() if (w := x.strip(EDGE).lower())]


def word_places(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """The hash of each place's word, the rows' starts, the different words, and the number of each place's word."""
    lists = pc.utf8_split_whitespace(pc.fill_null(text, ""))
    flat = lists.flatten().dictionary_encode()
    words = [w.strip(EDGE).lower() for w in flat.dictionary.to_pylist()]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in words] or [0], np.uint64)
    number, starts = flat.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    keep = np.array([bool(w) for w in words] or [False])[number]
    starts, number = np.concatenate([[0], np.cumsum(keep)])[starts], number[keep]
    return hashes[number], starts, words, number


def word_runs(h: np.ndarray, starts: np.ndarray, length: int = RUN) -> np.ndarray:
    """Hash of the run of so many words that begins at each place, 0 where the text ends before."""
    runs = np.zeros(len(h), np.uint64)
    if len(h) >= length:
        mixed = sum(h[k : len(h) - length + 1 + k] * FACTORS[k] for k in range(length)) + np.uint64(RUN - length)
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        whole = row[: len(mixed)] == row[length - 1 :]
        runs[: len(mixed)] = np.where(whole, mixed ^ (mixed >> np.uint64(29)), 0)
    return runs


def item_runs(items: DataFrame) -> DataFrame:
    """(item_id, run, size) of the benchmark's items; an item of fewer than `RUN` words has one run."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, starts, _, _ = word_places(batch.column(1))
            n = np.diff(starts)
            row = np.repeat(np.arange(batch.num_rows), n)
            for length in range(1, RUN + 1):
                some = (n[row] >= RUN) if length == RUN else (n[row] == length)
                runs = word_runs(h, starts, length)
                some &= runs != 0
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[some])), pa.array(runs[some].view(np.int64)), pa.array(n[row][some].astype(np.int32))], ["item_id", "run", "size"])

    kind = items.schema["doc_id"].dataType.simpleString()
    return items.mapInArrow(emit, f"item_id {kind}, run bigint, size int")


class Sieve:
    """Bits set for a bounded number of runs; gathered as their words, at most MOST_BITS / 64 rows."""

    def __init__(self, runs: DataFrame, count: int, most: int = MOST_BITS, least: int = LEAST_BITS):
        self.bits = min(least, most)
        while self.bits < min(32 * count, most):
            self.bits *= 2
        self.table = np.zeros(self.bits // 64, np.uint64)
        word = F.shiftrightunsigned("run", 6).bitwiseAND(F.lit(self.bits // 64 - 1))
        bit = F.expr("shiftleft(1L, cast(run & 63 as int))")
        got = runs.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        self.table[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)

    def passes(self, runs: np.ndarray) -> np.ndarray:
        word = self.table[((runs >> np.uint64(6)) & np.uint64(self.bits // 64 - 1)).astype(np.int64)]
        return ((word >> (runs & np.uint64(63))) & np.uint64(1)).astype(bool) & (runs != 0)


@dataclass(frozen=True)
class Search:
    """What documents are searched for on behalf of the items of one class of length."""

    sieve: Sieve
    reach: int
    lengths: tuple[int, ...]

    def parts(self, runs: dict[int, np.ndarray], starts: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(row, start, end, runs) of the parts within `reach` words of a run that passes."""
        passed = [np.flatnonzero(self.sieve.passes(runs[n])) for n in self.lengths]
        places = np.concatenate(passed)
        if not len(places):
            return
        found = np.concatenate([runs[n][p] for n, p in zip(self.lengths, passed, strict=True)])
        order = np.argsort(places, kind="stable")
        places, found, reach = places[order], found[order].view(np.int64), self.reach
        rows = np.searchsorted(starts, places, "right") - 1
        edges = np.flatnonzero((np.diff(rows) != 0) | (np.diff(places) > 2 * reach + RUN)) + 1
        for x, y in zip([0, *edges], [*edges, len(places)], strict=True):
            r = rows[x]
            a, b = max(starts[r], places[x] - reach), min(starts[r + 1], places[y - 1] + RUN + reach)
            for c in range(a, max(a + 1, b - reach), reach) if b - a > 3 * reach else (a,):
                d = min(b, c + 2 * reach) if b - a > 3 * reach else b
                m, n = np.searchsorted(places[x:y], [c, d]) + x
                if n > m:
                    yield r, c, d, np.unique(found[m:n])


def passages(docs: DataFrame, searches: dict[int, Search]) -> DataFrame:
    """(doc_id, at, class, words, runs): parts of documents near a run that passes for a class of items, and those runs. A part is at
    most three times the class's reach long; longer ones are cut so that any `reach` words in a row are whole in one of them."""
    lengths = sorted({n for s in searches.values() for n in s.lengths})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            h, starts, words, number = word_places(batch.column(1))
            ids, out = batch.column(0).to_pylist(), []
            runs = {n: word_runs(h, starts, n) for n in lengths}
            for k, search in searches.items():
                out += [(ids[r], int(c - starts[r]), k, " ".join(words[w] for w in number[c:d]), near.tolist()) for r, c, d, near in search.parts(runs, starts)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["doc_id", "at", "class", "words", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"doc_id {kind}, at int, class int, words string, runs array<bigint>")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the item and passage places where that alignment ends (exclusive)."""
    best, where = 0, (0, 0)
    place = np.arange(len(passage) + 1)
    above = np.zeros(len(passage) + 1, np.int64)
    for i, w in enumerate(item):
        row = np.zeros(len(passage) + 1, np.int64)
        row[1:] = np.maximum(np.maximum(above[:-1] + np.where(passage == w, 2, -1), above[1:] - 1), 0)
        above = np.maximum.accumulate(row + place) - place  # words of the passage left out
        j = int(above.argmax())
        if above[j] > best:
            best, where = int(above[j]), (i + 1, j)
    return best, *where


def alignment(item: str, passage: str) -> tuple[float, int, int]:
    """Score from 0 to 1, and the aligned places [start, end) in the passage."""
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(w, len(codes)) for w in t.split()], np.int64) for t in (item, passage))
    best, i, j = align(a, b)
    if not best:
        return 0.0, 0, 0
    back = align(a[:i][::-1], b[:j][::-1])  # the same alignment from its end
    return best / (2 * len(a)), j - back[2], j


def most(words: list[str], held: frozenset[str], passage: list[str]) -> int:
    """No local alignment scores more: each word of its part of the passage counts 2 if the item holds it, else costs 1,
    and each word of the item counts 2 once."""
    total = np.concatenate([[0], np.cumsum(np.where([w in held for w in passage], 2, -1))])
    both = held.intersection(passage)
    return min(int((total - np.minimum.accumulate(total)).max()), 2 * sum(w in both for w in words))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start, end): the best passage of each document for each item it holds; places are words."""
    rows, items = id_text(docs), id_text(benchmark, "item_id", "text").filter("doc_id is not null")
    kind = F.floor(F.log2(F.col("size").cast("double"))).cast("int").alias("class")
    of_items = written(item_runs(items).select("*", kind), "item-runs")
    sizes = of_items.groupBy("class").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.collect_set(F.least("size", F.lit(RUN))).alias("lengths")).collect()  # 31 at most
    kinds = rows.schema["doc_id"].dataType.simpleString(), items.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, start int, end int"
    if not sizes:
        return docs.sparkSession.createDataFrame([], schema)
    seeds = of_items.select("item_id", "class", "run").distinct()
    share = 1 << (MOST_BITS // len(sizes)).bit_length() - 1
    searches = {}
    for s in sizes:
        reach = int((3 - 2 * threshold) * s["size"])  # words of a passage that an alignment over the threshold spans at most
        sieve = Sieve(seeds.filter(F.col("class") == s["class"]).select("run").distinct(), s["n"], share)
        searches[s["class"]] = Search(sieve, max(reach, RUN), tuple(sorted(s["lengths"])))
    # a number of its own for each passage, as rows may repeat an id or have none
    found = written(passages(rows, searches).withColumn("passage", F.monotonically_increasing_id()), "passages")
    pairs = found.select("passage", "class", F.explode("runs").alias("run")).join(seeds, ["class", "run"]).select("passage", "item_id").distinct()
    texts = items.select(F.col("doc_id").alias("item_id"), F.col("text").alias("item"))
    both = pairs.join(found.select("passage", "doc_id", "at", "words"), "passage").join(texts, "item_id").select("doc_id", "item_id", "at", "words", "item")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(1 << 10)
        def of(item: str) -> tuple[list[str], frozenset[str]]:
            return (words := plain(item)), frozenset(words)

        def rated(item: str, passage: str) -> tuple[float, int, int]:
            words, held = of(item)
            if most(words, held, passage.split()) / (2 * len(words)) < threshold:
                return -1.0, 0, 0
            return alignment(" ".join(words), passage)

        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            out = [rated(i, w) for i, w in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            at = batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.float64()), *(pa.array((np.array([o[k] for o in out], np.int64) + at).astype(np.int32)) for k in (1, 2))], ["doc_id", "item_id", "score", "start", "end"])

    scored = both.mapInArrow(score, schema).filter(F.col("score") >= threshold)
    best = F.max(F.struct("score", (-F.col("start")).alias("early"), "end")).alias("best")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", (-F.col("best.early")).alias("start"), "best.end")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no test item. Null and empty texts hold none, and rows with a null id stay as
    they can't be named; rows that repeat an id go together. An empty table or benchmark takes nothing away."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)
