"""Helpers that several of the operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session that runs in one process may go without; it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Cuts the lineage: the rows as a compressed table in the shared folder. `instead_of` is a table written before that nothing
    else reads any more; it is removed once the new one is complete. What is left goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not _left:
        atexit.register(_remove_all, spark)
    _left[id(out)] = (out, path)
    if instead_of is not None and id(instead_of) in _left:
        _remove(spark, _left.pop(id(instead_of))[1])
    return out


#: Tables written by this process, kept by their DataFrames so that an id stays its own.
_left: dict[int, tuple[DataFrame, str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _remove_all(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session can't remove anything
        for _, path in _left.values():
            _remove(spark, path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that no other column can clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about `limit` bytes of text, or one longer row."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        for k, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += int(size)
        if batch.num_rows > start:
            yield batch.slice(start)


def held_out(id_col: str = "doc_id"):
    """True for the rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents, picked by a hash of the id; only the picked ids are broadcast."""
    picked = (
        labels.filter(F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(rows)
    )
    return id_text(docs).join(F.broadcast(picked), "doc_id")
