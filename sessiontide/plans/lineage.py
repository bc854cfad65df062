"""Cutting the lineage of iterative plans through the shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this process, kept by their DataFrames so that an id stays its own.
_left: dict[int, tuple[DataFrame, str]] = {}


def shared(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. Only a session that runs in one process may go without; it gets a
    temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="lineage-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the process ends."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(lambda: [_remove(spark, p) for p in _folders if spark.sparkContext._jsc is not None])
    _folders.append(path)
    return path


#: Folders that hold a stream's store and checkpoint.
_folders: list[str] = []


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The rows as a table in the folder that the session names for checkpoints: computed once, and kept when an executor is
    lost. `instead_of` is a table cut before that nothing else reads any more; it is removed once the new one is complete.
    What is left goes when the process ends."""
    spark = df.sparkSession
    path = f"{shared(spark)}/lineage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not _left:
        atexit.register(_remove_all, spark)
    _left[id(out)] = (out, path)
    if instead_of is not None and id(instead_of) in _left:
        _remove(spark, _left.pop(id(instead_of))[1])
    return out


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _remove_all(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session can't remove anything
        for _, path in _left.values():
            _remove(spark, path)
