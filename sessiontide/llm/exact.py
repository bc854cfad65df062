"""Exact duplicates by a content sort.

Rows are dealt by sampled splitters into ranges of (leading characters, hash of the whole text, id, place of the row), and each
range is sorted by Spark's external sort, whole texts compared before ids. Equal texts so become neighbours, and one pass over
a range compares each text with the one before it, byte by byte. Splitters hold short keys only, never whole texts, and may
fall inside a group of equal texts, so a group as large as the table is spread over many tasks. The first and the last key of
a range may go on in the next one: their groups are put together by their whole texts, a row for each range, and only their
members are joined with the outcome.

Null texts count as empty, so all null and empty texts are one group. Null ids are less than any other. Rows that repeat both
id and text are members of their own, and one of them stays. An empty table gives no rows. Only id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, slices, table, written

#: Leading characters that the splitters see.
HEAD_CHARS = 32
#: Runs of a range's first key are numbered from 0, those of its last key from here.
LAST_KEY = 1 << 40


class _Range:
    """Neighbouring comparisons over one sorted range. Rows of the current key wait until the key ends, without their texts
    but for the first of each run of equal ones."""

    def __init__(self, part: int, schema: pa.Schema, largest: bool):
        self.part, self.schema, self.largest = part, schema, largest
        self.before: pa.RecordBatch | None = None
        self.first = True
        self.ids: list[pa.Array] = []
        self.starts: list[np.ndarray] = []
        self.texts: list[str] = []

    def _differs(self, batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
        """True for rows that differ from the row before them in one of the columns."""
        out = np.zeros(batch.num_rows, bool)
        out[0] = self.before is None or any(batch.column(c)[0] != self.before.column(c)[0] for c in columns)
        for c in columns:
            values = batch.column(c)
            out[1:] |= pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
        return out

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, run = self._differs(batch, ["head", "mixed"]), self._differs(batch, ["text"])
        run |= key
        self.before = batch.slice(batch.num_rows - 1)
        cuts = np.flatnonzero(key)
        ids, texts = batch.column("doc_id"), batch.column("text")
        took = lambda a, b: (ids.slice(a, b - a), run[a:b], texts.slice(a, b - a).filter(pa.array(run[a:b])).to_pylist())
        if not len(cuts):
            self._wait(*took(0, batch.num_rows))
            return
        self._wait(*took(0, cuts[0]))
        yield from self._flush(False)
        done = cuts[0]
        if self.first and len(cuts) > 1 and not self.ids:  # the range's first key
            self._wait(*took(done, cuts[1]))
            done = cuts[1]
            yield from self._flush(False)
        if cuts[-1] > done:
            yield self._rows(*took(done, cuts[-1]), None)
        self._wait(*took(cuts[-1], batch.num_rows))

    def _wait(self, ids: pa.Array, starts: np.ndarray, texts: list[str]) -> None:
        if len(ids):
            self.ids.append(ids)
            self.starts.append(starts)
            self.texts += texts

    def _flush(self, at_end: bool) -> Iterator[pa.RecordBatch]:
        if self.ids:
            edge = 0 if self.first else LAST_KEY if at_end else None
            yield self._rows(pa.concat_arrays(self.ids), np.concatenate(self.starts), self.texts, edge)
            self.first, self.ids, self.starts, self.texts = False, [], [], []

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._flush(True)

    def _rows(self, ids: pa.Array, starts: np.ndarray, texts: list[str], edge: int | None) -> pa.RecordBatch:
        """A row for each document; for runs at an edge also one for each run, with its text."""
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], len(starts)) - 1
        run, sizes = np.cumsum(starts) - 1, ends - at + 1
        stays = ends if self.largest else at
        digests = np.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], object)
        own = np.zeros(len(ids), bool)
        own[stays] = True
        n = len(ids)
        columns = {
            "doc_id": ids,
            "keep_id": ids.take(pa.array(stays[run])),
            "group_size": pa.array(sizes[run], pa.int64()),
            "kept": pa.array(own),
            "text_sha256": pa.array(digests[run], pa.string()),
            "part": pa.nulls(n, pa.int32()) if edge is None else pa.array(np.full(n, self.part, np.int32)),
            "run": pa.nulls(n, pa.int64()) if edge is None else pa.array(run + edge, pa.int64()),
            "text": pa.nulls(n, pa.string()),
        }
        out = pa.record_batch([columns[f.name] for f in self.schema], schema=self.schema)
        if edge is None:
            return out
        k = len(at)
        columns = {
            "doc_id": pa.nulls(k, ids.type),
            "keep_id": ids.take(pa.array(stays)),
            "group_size": pa.array(sizes, pa.int64()),
            "kept": pa.nulls(k, pa.bool_()),
            "text_sha256": pa.nulls(k, pa.string()),
            "part": pa.array(np.full(k, self.part, np.int32)),
            "run": pa.array(np.arange(k) + edge, pa.int64()),
            "text": pa.array(texts, pa.string()),
        }
        more = pa.record_batch([columns[f.name] for f in self.schema], schema=self.schema)
        return pa.Table.from_batches([out, more]).combine_chunks().to_batches()[0]


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Column | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs`, dropped ones too.

    Of equal texts the row with the smallest id stays, or with keep="largest" that with the largest. `normalise` is an
    expression over the column `text`, applied before anything is compared; without it texts are equal when identical.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is 'smallest' or 'largest', not {keep!r}")
    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    if normalise is not None:
        rows = rows.withColumn("text", F.coalesce(normalise, F.lit("")))
    # the place of a row parts rows that repeat id and text, which no splitter could part otherwise
    keyed = rows.select("doc_id", "text", F.substring("text", 1, HEAD_CHARS).alias("head"), F.xxhash64("text").alias("mixed"), F.monotonically_increasing_id().alias("place"))
    ranged = keyed.repartitionByRange("head", "mixed", "doc_id", "place").sortWithinPartitions("head", "mixed", "text", "doc_id", "place")
    kind = rows.schema["doc_id"].dataType.simpleString()
    largest = keep == "largest"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in slices(batches):
            if walk is None:
                kind = batch.schema.field("doc_id").type
                ints = {"group_size": pa.int64(), "run": pa.int64(), "part": pa.int32(), "kept": pa.bool_(), "doc_id": kind, "keep_id": kind}
                names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256", "part", "run", "text")
                walk = _Range(TaskContext.get().partitionId(), pa.schema([(c, ints.get(c, pa.string())) for c in names]), largest)
            yield from walk.add(batch)
        if walk is not None:
            yield from walk.end()

    made = written(
        ranged.select("doc_id", "text", "head", "mixed").mapInArrow(
            compare, f"doc_id {kind}, keep_id {kind}, group_size bigint, kept boolean, text_sha256 string, part int, run bigint, text string"
        ),
        "content-sort",
    )
    # one text's runs at the edges of several ranges: ids grow with the ranges, so the outermost run has the one that stays
    outermost = F.max("part") if largest else F.min("part")
    chosen = F.max_by("keep_id", "part") if largest else F.min_by("keep_id", "part")
    edges = (
        made.filter("part is not null and text is not null")
        .groupBy("text")
        .agg(F.sum("group_size").alias("whole"), outermost.alias("outermost"), chosen.alias("chosen"), F.collect_list(F.struct("part", "run")).alias("places"))
        .select("whole", "outermost", "chosen", F.explode("places").alias("at"))
        .select(F.col("at.part").alias("part"), F.col("at.run").alias("run"), "whole", "outermost", "chosen")
    )
    at_edges = made.filter("part is not null and text is null").drop("text", "keep_id", "group_size").join(edges, ["part", "run"])
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    inner = made.filter("part is null").select(columns)
    return inner.unionByName(
        at_edges.select(
            "doc_id", F.col("chosen").alias("keep_id"), F.col("whole").alias("group_size"), (F.col("kept") & (F.col("part") == F.col("outermost"))).alias("kept"), "text_sha256"
        )
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_groups(table(spark, sf_dir, "documents"), keep="largest")


EXACT_SQL = """
select doc_id,
       max(doc_id) over same as keep_id,
       count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""
