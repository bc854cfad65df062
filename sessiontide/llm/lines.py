"""Line deduplication by pairwise alignment.

A run of lines is as short as `MIN_WORDS` words allow: it begins or ends at a line and takes in only as many more as it
needs. Its owner is the earliest document that holds it. A document is compared with the owner of every run that it shares
with earlier ones, so a group of thousands of copies is compared with its first document, pair by pair, and no two of its
members with one another; there are never more pairs than shared runs. Every block of that many words is made of such runs,
one beginning or ending at each of its lines, so each of its lines is in a run that the document's pairs cover.

A document and an owner are aligned by patience diff: lines that occur once in both, in the longest increasing order, are
anchors, between which the search goes on. Aligned blocks of at least `MIN_WORDS` words are deleted from the later document.
If shared lines are left, a suffix automaton of the owner finds all other blocks as long: those without an anchor, out of
order, or standing several times in either document. So a line goes if and only if it stands in a block of that many words
that an earlier document holds too. The earliest copy of every block stays.

Lines are compared without the white space around them; blank lines belong to no block and stay. Null texts stay null,
empty ones empty; rows with a null id are left as they are, and an empty table gives none. Rows that repeat an id are one
document: they lose what earlier ones hold, each from its own text, and nothing for one another's sake. Other columns
pass through; names that begin with two underscores and one of this module's own are taken.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import id_text, slices, table, written

MIN_WORDS = 8
COUNTS = ("__lines", "__lines_removed")


def shortest_runs(hashes: list[int], words: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """A hash for each shortest run of enough words that begins or ends at a line; blank lines (0) are passed over."""
    mine = [k for k, h in enumerate(hashes) if h]
    out: set[int] = set()
    upto = [0, *accumulate(words[k] for k in mine)]

    def add(first: int, end: int) -> None:
        h = hashes[mine[first]]
        for k in range(first + 1, end):
            h = (h * 0x9E3779B97F4A7C15 + hashes[mine[k]] + 1) & (1 << 64) - 1
        out.add(h if h < 1 << 63 else h - (1 << 64))

    for k in range(len(mine)):
        if words[mine[k]] >= min_words:
            out.add(hashes[mine[k]])
            continue
        end = bisect_left(upto, upto[k] + min_words, k + 1)
        if end < len(upto):
            add(k, end)
        first = bisect_right(upto, upto[k + 1] - min_words, 0, k + 1) - 1
        if first >= 0:
            add(first, k + 1)
    return list(out)


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, part, lines, words, runs): a hash and the number of words for each line, 0 for a blank one, and the hashes
    of the shortest runs; `part`, a hash of the text, keeps rows apart that share an id only."""
    rows = id_text(docs).filter("doc_id is not null").select("doc_id", F.hash("text").alias("part"), "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            split = [[line.strip() for line in t.encode().split(b"\n")] if t else [] for t in batch.column(2).to_pylist()]
            hashes = [[(xxhash.xxh3_64_intdigest(line) or 1) - (1 << 63) if line else 0 for line in doc] for doc in split]
            words = [[len(line.split()) for line in doc] for doc in split]
            runs = [shortest_runs(h, w, min_words) for h, w in zip(hashes, words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(runs, pa.list_(pa.int64()))], ["doc_id", "part", "lines", "words", "runs"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(emit, f"doc_id {kind}, part int, lines array<bigint>, words array<int>, runs array<bigint>")


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails, at, before = [], [], []
    for k, p in enumerate(places):
        d = bisect_left(tails, p)
        tails[d : d + 1], at[d : d + 1] = [p], [k]
        before.append(at[d - 1] if d else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: k for k, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        once = [(k, place[x]) for k, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in place]
        anchors = [once[k] for k in increasing([p for _, p in once])]
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        if anchors:
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends[:-1], ends[1:], strict=True)]
    return sorted(out)


def common_blocks(a: list[int], words: list[int], b: list[int], min_words: int) -> set[int]:
    """Places of `a` in blocks of enough words that stand anywhere in `b`, in time linear in both: the automaton of `b`
    gives the longest block that ends at each place, which holds all shorter ones that end there."""
    in_a, in_b = set(a), set(b)
    b = [x if x in in_a else 0 for x in b]  # no line of `a` is 0
    steps, link, size = [{}], [-1], [0]
    last = 0
    for k, x in enumerate(b):
        if k and not x and not b[k - 1]:
            continue
        new = len(steps)
        steps.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and x not in steps[p]:
            steps[p][x] = new
            p = link[p]
        if p >= 0:
            q = steps[p][x]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and steps[p].get(x) == q:
                    steps[p][x] = copy
                    p = link[p]
        last = new
    upto = [0, *accumulate(words)]
    at = held = done = 0
    out = set()
    for k, x in enumerate(a):
        if x not in in_b:
            at = held = 0
            continue
        while x not in steps[at]:
            at = link[at]
            held = size[at]
        at, held = steps[at][x], held + 1
        if upto[k + 1] - upto[k + 1 - held] >= min_words:
            out.update(range(max(done, k + 1 - held), k + 1))
            done = k + 1
    return out


def repeated_lines(later: list[int], words: list[int], earlier: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Places of the later document's lines in blocks of enough words that the earlier one holds."""
    mine, theirs = [k for k, h in enumerate(later) if h], [h for h in earlier if h]
    own, held = [later[k] for k in mine], set(theirs)
    pairs = patience(own, theirs)
    out, block = [], []
    for k, (x, y) in enumerate(pairs):
        block.append(mine[x])
        if k + 1 == len(pairs) or pairs[k + 1] != (x + 1, y + 1):
            if sum(words[p] for p in block) >= min_words:
                out += block
            block = []
    gone = set(out)
    if any(h in held for h, p in zip(own, mine, strict=True) if p not in gone):
        return sorted(mine[x] for x in common_blocks(own, [words[p] for p in mine], theirs, min_words))
    return out


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, part, removed): the places of the lines that go, for texts that lose any."""
    lines = written(line_table(docs, min_words), "lines")
    kind = lines.schema["doc_id"].dataType.simpleString()
    own = lines.select("doc_id", "part", F.explode("runs").alias("run"))
    held = own.groupBy("run").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner <> last").drop("last")
    held = written(held, "owners")  # so that the join's sides are plain shuffles, of which adaptive execution splits hot runs
    pairs = own.join(held, "run").filter("owner < doc_id").select("doc_id", "part", "owner").distinct()
    of = lines.groupBy("doc_id", "part").agg(F.first("lines").alias("lines"), F.first("words").alias("words"))  # once, if rows are repeated
    theirs = lines.select(F.col("doc_id").alias("owner"), F.col("lines").alias("theirs"))
    met = written(pairs, "pairs").join(of, ["doc_id", "part"]).join(theirs, "owner").select("doc_id", "part", "lines", "words", "theirs")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [repeated_lines(*r, min_words) for r in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "part", "removed"])

    found = met.mapInArrow(align, f"doc_id {kind}, part int, removed array<int>").filter(F.size("removed") > 0)
    return found.groupBy("doc_id", "part").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents with `text` less those lines, and two columns more under names that can't clash: how many lines there were and went."""
    gone = removed.select(F.col("doc_id").alias("__id"), F.col("part").alias("__part"), F.col("removed").alias("__removed"))
    mine = (F.col("doc_id") == F.col("__id")) & (F.hash(F.col("text").cast("string")) == F.col("__part"))
    joined = docs.join(gone, mine, "left").select(*docs.columns, "__removed")
    names = joined.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, gone = batch.column(names.index("text")).to_pylist(), batch.column(len(names) - 1).to_pylist()
            total, kept = [], []
            for t, g in zip(texts, gone, strict=True):
                lines = t.split("\n") if t is not None else []
                drop = set(g or ())
                total.append(len(lines))
                kept.append("\n".join(line for k, line in enumerate(lines) if k not in drop) if drop else t)
            columns = [pa.array(kept, pa.string()) if n == "text" else batch.column(k) for k, n in enumerate(names[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array([len(g or ()) for g in gone], pa.int64())], [*names[:-1], *COUNTS])

    return joined.mapInArrow(cut, StructType([*docs.schema, *(StructField(c, LongType()) for c in COUNTS)]))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    return without_lines(docs, removed_lines(docs)).select("doc_id", F.col(COUNTS[0]).alias("n_lines"), F.col(COUNTS[1]).alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents less repeated lines; one that loses every line with a word goes. Null and empty texts,
    rows with a null id and an empty table stay as they are, and rows that repeat an id are treated alike."""
    cut = without_lines(docs, removed_lines(docs)).filter((F.col(COUNTS[1]) == 0) | F.col("text").rlike(r"[^\s]")).drop(*COUNTS)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut
