"""Tails of growing logs as a streaming source: each query run reads the bytes that were added since the last one.

An offset holds, for every file of a folder, how many bytes of whole lines it had, and hashes of its first and last bytes up to
there. A file that grew and whose old bytes still have these hashes goes on where it stood; one that was truncated or rewritten is
read from its start, its rows marked `reset`. A last line without a line feed waits until it is whole. What is planned follows
from the two offsets alone, so a batch that is run again reads the same bytes.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes at either end of a file's known part that must not have changed.
GUARD = 16 * 1024
#: Of a file that one task reads.
PIECE = 64 << 20
SCHEMA = "value string, file string, at bigint, reset boolean"


@dataclass
class Piece(InputPartition):
    """Lines that begin from `start` up to `end`, which is not beyond `size`."""

    file: str
    start: int
    end: int
    size: int
    reset: bool


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.piece = options["path"], int(options.get("pieceBytes", PIECE))

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """{file: {"size", "head", "tail"}} of all files that have a whole line."""
        system, folder = self._place()
        out = {}
        for info in sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
            if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
                with system.open_input_file(info.path) as f:
                    if size := self._whole(f, info.size):
                        out[info.path] = {"size": size, "head": self._hash(f, 0, min(GUARD, size)), "tail": self._hash(f, max(0, size - GUARD), size)}
        return out

    @staticmethod
    def _hash(f: pa.NativeFile, start: int, end: int) -> str:
        f.seek(start)
        return hashlib.sha256(f.read(end - start)).hexdigest()

    @staticmethod
    def _whole(f: pa.NativeFile, size: int) -> int:
        """Bytes up to the last line feed."""
        while size:
            start = max(0, size - GUARD)
            f.seek(start)
            at = f.read(size - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            size = start
        return 0

    def _goes_on(self, f: pa.NativeFile, old: dict, new: dict) -> bool:
        """Whether the part that was known is still there."""
        size = old["size"]
        return size <= new["size"] and self._hash(f, 0, min(GUARD, size)) == old["head"] and self._hash(f, max(0, size - GUARD), size) == old["tail"]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, _ = self._place()
        out: list[InputPartition] = []
        for file, new in sorted(end.items()):
            old = start.get(file)
            if old == new:
                continue
            with system.open_input_file(file) as f:
                on = old is not None and self._goes_on(f, old, new)
            first = old["size"] if on else 0
            out += [Piece(file, k, min(k + self.piece, new["size"]), new["size"], old is not None and not on) for k in range(first, new["size"], self.piece)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = self._place()
        with io.BufferedReader(system.open_input_file(partition.file), 1 << 20) as f:
            at = partition.start
            if at:  # a line that began before belongs to the piece before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            held: list[tuple[int, bytes]] = []
            weight = 0
            while at < partition.end and (line := f.readline()):
                held.append((at, line))
                at, weight = at + len(line), weight + len(line)
                if weight > 4 << 20:
                    yield self._batch(partition, held)
                    held, weight = [], 0
            if held:
                yield self._batch(partition, held)

    @staticmethod
    def _batch(partition: Piece, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        texts = [line.rstrip(b"\n").decode("utf-8", "replace") for _, line in held]
        n = len(held)
        return pa.record_batch(
            [pa.array(texts), pa.array([partition.file] * n), pa.array([at for at, _ in held], pa.int64()), pa.array([partition.reset] * n)], ["value", "file", "at", "reset"]
        )


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines-tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def stream(spark: SparkSession, folder: str, piece_bytes: int = PIECE) -> DataFrame:
    """(value, file, at, reset): lines of a folder's files as they are added; `at` is the byte where a line begins."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("lines-tail").option("pieceBytes", piece_bytes).load(folder)
