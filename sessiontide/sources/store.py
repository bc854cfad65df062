"""Places of ledgers, and replacing them: rows are written beside the old ones and put in their place by a rename."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, precedence
from ..schema import TOKENS
from . import history


#: Under a home folder, where ledgers are kept if no folder is named.
DEFAULT_FOLDER = ".local/share/sessiontide"


def paths(folder: str | None = None, home: str | None = None) -> dict[str, str]:
    """The ledgers of a folder, else of the default one under a home folder (a URI on a cluster)."""
    if folder is None and home is None:
        raise ValueError("name the ledgers' folder, or a home folder for the default one")
    folder = folder if folder is not None else f"{home.rstrip('/')}/{DEFAULT_FOLDER}"
    return {name: f"{folder.rstrip('/')}/{name}" for name in ("history", "activity", "totals")}


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it does not exist."""
    fs, place = _fs(spark, path)
    return [str(status.getPath()) for status in fs.listStatus(place)] if fs.exists(place) else []


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, place = _fs(spark, old)
    target = _fs(spark, new)[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(place, target):
        raise OSError(f"{old} could not be moved to {new}")


def left_behind(spark: SparkSession, path: str) -> list[str]:
    """The temporary files of a ledger that a writer left beside it (`.name.process.time.mark.tmp`), by time.

    Spark lists no hidden files, so they lose the dot in front; then they can be read after the ledger itself.
    """
    fs, place = _fs(spark, path)
    name = re.compile(re.escape("." + place.getName()) + r"\.[0-9]+\.([0-9]+)\.[^./]+\.tmp")
    found = []
    for status in fs.listStatus(place.getParent()):
        own = status.getPath()
        for hidden, text in ((True, own.getName()), (False, "." + own.getName())):
            if match := name.fullmatch(text):
                shown = f"{own.getParent()}/{text[1:]}"
                if hidden:
                    move(spark, str(own), shown)
                found.append((int(match[1]), shown))
    return [p for _, p in sorted(found)]


def recover(spark: SparkSession, path: str) -> DataFrame:
    """The history of a ledger and of what was left behind beside it."""
    return history.read(spark, [path, *left_behind(spark, path)])


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Puts what is at `new` in the place of `path`; a failure before the last rename leaves the old one beside it."""
    aside = f"{path}.old-{uuid.uuid4().hex}"
    if exists(spark, path):
        move(spark, path, aside)
    move(spark, new, path)
    remove(spark, aside)


def replace(df: DataFrame, path: str) -> None:
    """The rows as the table at `path`."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    swap(df.sparkSession, new, path)


def quarantine(spark: SparkSession, path: str) -> str:
    """Moves an invalid ledger aside and returns its new place; what it held is rebuilt from the history."""
    aside = f"{path}.invalid-{int(time.time() * 1000)}"
    move(spark, path, aside)
    return aside


def upsert(records: DataFrame, path: str, keep: int = 1000, protected: DataFrame | None = None) -> None:
    """Folds new records into a stored history and keeps the last `keep` by admission, and protected messages. What is stored
    stands before what comes: `pos` is a struct of the upsert's number and the place in it."""
    spark = records.sparkSession
    number, old = 0, None
    if exists(spark, path):
        old = spark.read.parquet(path)
        number = old.agg(F.coalesce(F.max("pos.upsert"), F.lit(-1)) + 1).first()[0]
    merged = records.withColumn("pos", F.struct(F.lit(number).cast("long").alias("upsert"), F.col("pos").alias("at")))
    if old is not None:
        merged = old.unionByName(merged, allowMissingColumns=True)
    replace(precedence.newest(ledger.history(merged), keep, protected), path)


def last(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The last records of a stored history by admission, a top-k without a full sort."""
    return precedence.newest(spark.read.parquet(path), rows)


def clear(spark: SparkSession, path: str) -> None:
    """An empty history in the place of a stored one."""
    replace(spark.read.parquet(path).limit(0), path)


def prune(spark: SparkSession, path: str, before: float, protected: DataFrame | None = None) -> None:
    """Drops records completed (else started) before a time, but for protected messages."""
    rows = spark.read.parquet(path)
    young = rows.filter(F.coalesce("completed", "start") >= before)
    if protected is not None:
        old = rows.filter(~F.coalesce(F.coalesce("completed", "start") >= before, F.lit(False)))
        young = young.unionByName(old.join(protected.select("message_id").distinct(), "message_id", "left_semi").select(rows.columns))
    replace(young, path)


def sums(records: DataFrame) -> DataFrame:
    """Session sums of the records that count."""
    effective = ledger.contributions(records)
    return effective.groupBy("session_id").agg(*(F.sum(c).alias(c) for c in (*TOKENS, "cost")), F.count("*").alias("calls"))


def rebuild_totals(path: str, records: DataFrame) -> None:
    """Session sums from the history's effective records, replacing what was there."""
    replace(sums(records), path)


def seed_totals(path: str, records: DataFrame) -> bool:
    """The same, but only if there is no ledger yet; says whether it was written."""
    if exists(records.sparkSession, path):
        return False
    rebuild_totals(path, records)
    return True
