"""A corpus pipeline of five operators: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessiontide.llm.common import table, written
from sessiontide.llm.decontam import keep_uncontaminated
from sessiontide.llm.lines import cut_lines
from sessiontide.llm.neardup import keep_one
from sessiontide.llm.packing import pack
from sessiontide.llm.quality import keep_good


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, without their ids. Null and empty texts are one id each, rows that repeat an
    id or have none are packed each by itself, and an empty table gives no pieces."""
    return pack(docs, with_ids=False)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", cut_lines),
    ("near-duplicates", keep_one),
    ("decontamination", keep_uncontaminated),
    ("packing", pack_sequences),
]

#: A forest, alignments and best-fit packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`, each written and read again before the next; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), instead_of=docs)
    return docs
