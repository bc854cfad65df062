"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the frequent form of each.

Words are counted over all documents. Every word's neighbourhood (its deletions and the replacements of its letters; an
insertion is a deletion seen from the longer word) is generated as hashes and probed against blocked Bloom filters, one for
each word length, laid out in one row of blocks. A probe reads a block of 64 bytes. Only hits are shuffled, as two hashes each: a join
with the vocabulary finds the words under the hash, and comparing the words themselves takes false hits and colliding hashes out.

The filters are broadcast in pieces of at most `FILTER_BYTES`: a vocabulary whose filters are larger is probed in as many
passes, so no broadcast grows with the input and filters never fill up. Hashes of edits follow from the word's own hash by one
multiplication, so a long word's edits are never written out.

Null and empty texts have no words. A null id counts as an empty one. Rows that repeat an id count each. Words are compared by
code points; forms that tie in number go by code-point order. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, slices, table, written

#: A run of letters in UTF-8, A-Z in lower case: a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Fixed by the contract: runs that lose a letter, least length and least count of a word, how much more frequent its form is.
SLIPS, MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 97, 5, 3, 2
LETTERS = 26 + 64
#: Different words a task counts before it sends them on.
HELD_WORDS = 200_000
#: Of one broadcast piece; a word takes 16 bits.
FILTER_BYTES, BITS_A_WORD, PROBES = 32 << 20, 16, 6
BLOCK_BITS = 512
#: Longer words share one filter.
LONGEST = 64
#: Edits hashed at once; arrays of this size stay in a core's cache.
EDITS = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
VALUES = np.random.default_rng(12).integers(1, 1 << 63, LETTERS, np.uint64) * np.uint64(2) + np.uint64(1)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = SLIPS) -> DataFrame:
    """(word, n): lower-cased runs of letters of at least five letters by their number; a run whose hash with the document's
    id is divisible by `slips` loses one letter first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)

        def send() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall(text.lower())).items():
                    mixed = zlib.crc32(word, seed)
                    if not mixed % slips:
                        letters = word.decode()
                        at = mixed % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    if len(word) >= MIN_LENGTH and len(word) - word.count(b"\xc3") >= MIN_LENGTH:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield send()
        yield send()

    found = id_text(docs, id_col, text_col).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a hash over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes_of(words: list[str], length: int) -> np.ndarray:
    """The words' letters as numbers from 0, a row each."""
    points = np.array(words, f"<U{length}").view(np.uint32).reshape(len(words), length)
    return np.where(points < 128, points - 97, points - 0xC0 + 26).astype(np.int64)


def powers(length: int) -> np.ndarray:
    out = np.full(length, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def keyed(raw: np.ndarray, length: int) -> np.ndarray:
    """The hash of words of one length."""
    return mix(raw + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64)))


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of the words of each length, cut so that their letters are few."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, EDITS // length)
        for k in range(0, len(places), step):
            yield length, places[k : k + step]


class Layout:
    """Where the filter of each length lies: `first` block and number of blocks by length, LONGEST for all longer ones."""

    def __init__(self, counts: dict[int, int]):
        self.blocks = np.zeros(LONGEST + 1, np.int64)
        for length, n in counts.items():
            self.blocks[length] = -(-n * BITS_A_WORD // BLOCK_BITS)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        self.total = int(self.first[-1])

    def address(self, key: np.ndarray, length: int) -> np.ndarray | None:
        """The block of each key; None if there are no words of this length."""
        shard = min(length, LONGEST)
        if not self.blocks[shard]:
            return None
        return (((key >> np.uint64(32)) * np.uint64(self.blocks[shard])) >> np.uint64(32)).astype(np.int64) + int(self.first[shard])


def bit_places(key: np.ndarray) -> np.ndarray:
    """PROBES places from 0 to 511 in a key's block, packed nine bits each."""
    return mix(key ^ np.uint64(0xA0761D6478BD642F))


def edits(codes: np.ndarray, raw: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row, hash) of all deletions, and of replacements by letters later in the alphabet: the word with the earlier letter
    finds the pair. A piece holds about EDITS hashes."""
    n, length = codes.shape
    power = powers(length)
    terms = VALUES[codes] * power
    if length > MIN_LENGTH:
        before = np.cumsum(terms, 1, dtype=np.uint64)
        shorter = (before - terms) + (before[:, -1:] - before) * BASE_INVERSE
        differs = np.ones(codes.shape, bool)
        differs[:, 1:] = codes[:, 1:] != codes[:, :-1]
        yield length - 1, np.nonzero(differs)[0], keyed(shorter[differs], length - 1)
    wide = max(1, EDITS // (len(alphabet) * n))
    for k in range(0, length, wide):
        part = codes[:, k : k + wide, None]
        later = alphabet[None, None, :] > part
        changed = raw[:, None, None] + (VALUES[alphabet][None, None, :] - VALUES[part]) * power[None, k : k + wide, None]
        yield length, np.nonzero(later)[0], keyed(changed[later], length)


def keyed_vocabulary(counts: DataFrame) -> DataFrame:
    """(word, n, key, shard, low, high): the word's hash, its filter, and its letters as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            key, shard = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int32)
            low, high = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for length, at in by_length(words):
                codes = codes_of([words[i] for i in at], length)
                key[at] = keyed((VALUES[codes] * powers(length)).sum(1, dtype=np.uint64), length)
                shard[at] = min(length, LONGEST)
                low[at] = np.bitwise_or.reduce(np.where(codes < 45, np.int64(1) << np.minimum(codes, 45), 0), 1)
                high[at] = np.bitwise_or.reduce(np.where(codes >= 45, np.int64(1) << np.maximum(codes - 45, 0), 0), 1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(key.view(np.int64)), pa.array(shard), pa.array(low), pa.array(high)], ["word", "n", "key", "shard", "low", "high"])

    return counts.select("word", "n").mapInArrow(run, "word string, n bigint, key bigint, shard int, low bigint, high bigint")


def filter_blocks(vocabulary: DataFrame, layout: Layout) -> DataFrame:
    """(block, b0 .. b7): the Bloom filters' blocks, put together from partial ones by bitwise or."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            shard = batch.column(1).to_numpy()
            if not len(key):
                continue
            block = np.empty(len(key), np.int64)
            for s in np.unique(shard).tolist():
                block[shard == s] = layout.address(key[shard == s], s)
            names, at = np.unique(block, return_inverse=True)
            bits, rows = np.zeros((len(names), 8), np.uint64), bit_places(key)
            for i in range(PROBES):
                place = (rows >> np.uint64(9 * i)) & np.uint64(511)
                np.bitwise_or.at(bits, (at, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
            yield pa.record_batch([pa.array(names), *(pa.array(bits[:, i].view(np.int64)) for i in range(8))], ["block", *(f"b{i}" for i in range(8))])

    parts = vocabulary.select("key", "shard").mapInArrow(run, "block bigint, " + ", ".join(f"b{i} bigint" for i in range(8)))
    return parts.groupBy("block").agg(*(F.expr(f"bit_or(b{i})").alias(f"b{i}") for i in range(8)))


def _hits(vocabulary: DataFrame, blocks: DataFrame, layout: Layout, alphabet: np.ndarray, start: int, end: int) -> DataFrame:
    """(a, b): hashes of words and of edits of them that the filters' blocks from `start` to `end` may hold."""
    spark = vocabulary.sparkSession
    piece = np.zeros((end - start, 8), np.uint64)
    got = blocks.filter((F.col("block") >= start) & (F.col("block") < end)).toArrow()
    if got.num_rows:
        piece[got.column("block").to_numpy() - start] = np.stack([got.column(f"b{i}").to_numpy() for i in range(8)], 1).view(np.uint64)
    sent = spark.sparkContext.broadcast(piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value

        def probe(length: int, row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            block = layout.address(key, length)
            if block is None:
                return row[:0], key[:0]
            left = np.flatnonzero((block >= start) & (block < end))
            places = bit_places(key[left])
            for i in range(PROBES):
                place = (places >> np.uint64(9 * i)) & np.uint64(511)
                word = bits[block[left] - start, (place >> np.uint64(6)).astype(np.int64)]
                hit = (word >> (place & np.uint64(63))) & np.uint64(1) > 0
                left, places = left[hit], places[hit]
            return row[left], key[left]

        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, at in by_length(words):
                step = max(1, EDITS // (length * len(alphabet)))
                for k in range(0, len(at), step):
                    codes = codes_of([words[i] for i in at[k : k + step]], length)
                    raw = (VALUES[codes] * powers(length)).sum(1, dtype=np.uint64)
                    own = keyed(raw, length)
                    for longer, row, key in edits(codes, raw, alphabet):
                        row, key = probe(longer, row, key)
                        if len(row):
                            yield pa.record_batch([pa.array(own[row].view(np.int64)), pa.array(key.view(np.int64))], ["a", "b"])

    return vocabulary.select("word").mapInArrow(run, "a bigint, b bigint")


def near_words(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, near, near_n), both ways: all pairs of the vocabulary that one edit parts."""
    shape = vocabulary.groupBy("shard").agg(F.count("*").alias("n"), F.expr("bit_or(low)").alias("low"), F.expr("bit_or(high)").alias("high")).collect()
    layout = Layout({r["shard"]: r["n"] for r in shape})
    low, high = (functools.reduce(int.__or__, (r[c] for r in shape), 0) for c in ("low", "high"))
    alphabet = np.array([i for i in range(LETTERS) if (low | high << 45) >> i & 1], np.int64)
    words = vocabulary.select("word", "n", "key")
    size = max(1, filter_bytes * 8 // BLOCK_BITS)
    if layout.total > size:  # several passes read them
        blocks = written(filter_blocks(vocabulary, layout), "filters")
    else:
        blocks = filter_blocks(vocabulary, layout)
    passes = [_hits(vocabulary, blocks, layout, alphabet, k, min(k + size, layout.total)) for k in range(0, layout.total, size)]
    if not passes:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    hits = functools.reduce(DataFrame.unionByName, passes)
    found = hits.join(words.select(F.col("key").alias("b"), F.col("word").alias("right"), F.col("n").alias("right_n")), "b")
    pairs = found.join(words.select(F.col("key").alias("a"), F.col("word").alias("left"), F.col("n").alias("left_n")), "a")
    true = pairs.filter(F.levenshtein("left", "right", 1) == 1).select("left", "left_n", "right", "right_n").distinct()
    ways = F.array(
        F.struct(F.col("left").alias("word"), F.col("right").alias("near"), F.col("right_n").alias("near_n")),
        F.struct(F.col("right").alias("word"), F.col("left").alias("near"), F.col("left_n").alias("near_n")),
    )
    return true.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a written table (word, form): forms followed to the last one. A form is at least twice as frequent as its word,
    so there are no cycles, and every round doubles the steps taken. A round's table has at most a file for each core."""
    cores = forms.sparkSession.sparkContext.defaultParallelism
    now, before, moved = forms.select("word", F.col("form").alias("root")), None, True
    while moved:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        before = written(step.coalesce(cores), "roots", instead_of=before)
        now, moved = before.select("word", "root"), not before.filter("moved").isEmpty()
    return now


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES, slips: int = SLIPS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least five letters that occurs at least three times."""
    vocabulary = written(keyed_vocabulary(word_counts(docs, id_col, text_col, slips).filter(F.col("n") >= MIN_COUNT)), "vocabulary")
    near = near_words(vocabulary, filter_bytes).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    enough = -F.col("top.less") >= FORM_FACTOR * F.col("n")
    formed = written(
        vocabulary.select("word", "n")
        .join(near, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("top.near")).alias("form"), F.when(enough, -F.col("top.less")).alias("form_n")),
        "forms",
    )
    last = roots(formed.filter("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(table(spark, sf_dir, "documents"))
