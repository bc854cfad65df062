"""Bounded-space online packing of tokenized documents into sequences.

Every partition keeps at most `windows` open sequences. A document's tokens go whole into the open one that they fill
best; if they fit in none and no further may be opened, the fullest is topped up with the beginning of them, unless
its gap is under `min_piece`, and emitted, and the rest is placed anew. What is longer than a sequence fills sequences of its own first. What
the partitions leave open is merged sixteen partitions at a time, over and over, until one group is left, whose last
sequences are filled up in order; the very last tokens go to sequences of powers of two, which need no padding.

A task holds its open sequences and one slice of texts. A null or empty text has only the closing id; a text may be longer
than a slice. Repeated rows are packed each, as are rows that share an id or have none. Of open sequences that fit equally
well the first counts. An empty table gives no pieces. Only id and text are read, so other columns can't clash. Sequence ids
are unique, not dense.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, slices, table, written

SIZE, WINDOWS, MIN_PIECE, END_ID, FAN_IN = 4096, 64, 8, 2, 16
#: Words that a Python worker remembers the ids of, over all its tasks.
REMEMBERED = 1_200_000
#: A word that ends in signs: its ids are those of what is before and of the signs, if the tokenizer parts the two. Only Latin
#: letters whose small and composed forms are one letter stand before them, as a mark would join the signs.
SIGNED = re.compile(r"(.*[A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u024f])([.,;:!?%#)]+)", re.S)


class Tokens:
    """Ids of texts by way of their words: white space parts words and leaves no token, so each word is encoded once. A word
    with signs behind it is put together from its parts, and one with ASCII capitals is looked up without them, where the
    tokenizer says that it does so itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        splits, lowers = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        self.parts = splits is not None and all([x for x, _ in splits.pre_tokenize_str(f"ab{c}")] == ["ab", c] for c in (".", "!?", "%%%", "),"))
        self.lowers = lowers is not None and lowers.normalize_str("AbZ") == "abz"
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def learn(self, words: list[str]) -> None:
        """Words that are not known yet: the parts of signed ones and small forms first, then what is left."""
        place, plain, signed, capital = self.place, {}, [], []
        for w in words:
            if self.lowers and w.isascii() and (low := w.lower()) != w:
                capital.append((w, low))
                w = low
                if w in place:
                    continue
            if self.parts and (m := SIGNED.fullmatch(w)):
                signed.append((w, m[1], m[2]))
                for part in m.groups():
                    if part not in place:
                        plain[part] = None
            else:
                plain[w] = None
        self.coded(list(plain))
        for w, *parts in signed:
            if w not in place:
                for k in [place[x] for x in parts]:
                    self.ids.extend(self.ids[self.ends[k] : self.ends[k + 1]])
                place[w] = len(self.ends) - 1
                self.ends.append(len(self.ids))
        for w, low in capital:
            place[w] = place[low]

    def coded(self, words: list[str]) -> None:
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            coded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in some])
            own = np.searchsorted(starts, np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded.ids)), "right") - 1
            counts = np.bincount(own, minlength=len(some))
            for k, w in enumerate(some, len(self.ends) - 1):
                self.place[w] = k
            self.ids.extend(coded.ids)
            self.ends.extend((self.ends[-1] + np.cumsum(counts)).tolist())

    def encode(self, text: pa.Array, end_id: int) -> list[np.ndarray]:
        if len(self.place) > REMEMBERED:
            self.forget()
        lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        self.learn([w for w in words if w not in self.place])
        ids, ends = np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32), np.frombuffer(self.ends, np.int64)
        place = np.array([self.place[w] for w in words], np.int64)[flat.indices.to_numpy(zero_copy_only=False)] if words else np.zeros(0, np.int64)
        size = ends[place + 1] - ends[place]
        before = np.concatenate([[0], np.cumsum(size)])
        out = ids[np.repeat(ends[place] - before[:-1], size) + np.arange(before[-1])]
        cuts = before[lists.offsets.to_numpy()]
        end = np.array([end_id], np.uint32)
        got = [np.concatenate([out[a:b], end]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        del ids, ends
        return got


@lru_cache(1)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


class Packer:
    """Open sequences as lists of (doc_id, start, ids, doc_tokens), with the tokens they still take."""

    def __init__(self, size: int, windows: int, min_piece: int):
        self.size, self.windows, self.min_piece = size, windows, min_piece
        self.open: list[list] = []
        self.gaps: list[int] = []
        self.closed: list[list] = []

    def put(self, doc, start: int, ids: np.ndarray, tokens: int) -> None:
        while len(ids):
            if len(ids) >= self.size:
                self.closed.append([(doc, start, ids[: self.size], tokens)])
                start, ids = start + self.size, ids[self.size :]
                continue
            fits = [(g, k) for k, g in enumerate(self.gaps) if g >= len(ids)]
            if not fits and len(self.open) < self.windows:
                self.open.append([])
                self.gaps.append(self.size)
                fits = [(self.size, len(self.open) - 1)]
            if fits:
                gap, k = min(fits)
                self.open[k].append((doc, start, ids, tokens))
                self.gaps[k] = gap - len(ids)
                if not self.gaps[k]:
                    self.emit(k)
                return
            gap, k = min((g, k) for k, g in enumerate(self.gaps))
            if gap >= self.min_piece:
                self.open[k].append((doc, start, ids[:gap], tokens))
                start, ids = start + gap, ids[gap:]
            self.emit(k)

    def emit(self, k: int) -> None:
        self.closed.append(self.open.pop(k))
        self.gaps.pop(k)

    def finish(self) -> None:
        """Fills the last open sequences up in order and cuts the tail at powers of two."""
        pieces = [p for _, w in sorted(zip(self.gaps, self.open, strict=True), key=lambda x: x[0]) for p in w]
        self.open, self.gaps = [], []
        left = sum(len(p[2]) for p in pieces)
        window, room = [], 0
        for doc, start, ids, tokens in pieces:
            while len(ids):
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                    window = []
                    self.closed.append(window)
                n = min(room, len(ids))
                window.append((doc, start, ids[:n], tokens))
                start, ids, room, left = start + n, ids[n:], room - n, left - n

    def rows(self, first: int, part: int, with_ids: bool, last: bool) -> tuple[list[tuple], int]:
        """What is to be written now: the closed sequences, and with `last` those still open."""
        out = []
        for open_, held in ((False, self.closed), (True, self.open if last else [])):
            for window in held:
                at = 0
                for doc, start, ids, tokens in window:
                    data = ids.astype("<u4").tobytes()
                    out.append((doc, start, len(ids), zlib.crc32(data), tokens, first, at, open_, part, data if with_ids or open_ else None))
                    at += len(ids)
                first += 1
        self.closed = []
        return out, first


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open", "part", "ids")
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())


def _batch(rows: list[tuple], doc_kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (doc_kind, *KINDS), strict=True)], list(COLUMNS))


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, windows: int = WINDOWS, min_piece: int = MIN_PIECE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (unsigned 32 bits, little-endian).

    `tokenizer` is the path of a tokenizer file that every executor has; by default the public word tokenizer.
    """
    rows = id_text(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        part = TaskContext.get().partitionId()
        tokens, packer, n = tokens_of(tokenizer or public_tokenizers.path("word_bpe_49k.json")), Packer(size, windows, min_piece), part << 32
        doc_kind = pa.int64()
        for batch in slices(batches, 2 << 20):
            doc_kind = batch.schema.field(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1), end_id), strict=True):
                packer.put(doc, 0, ids, len(ids))
            out, n = packer.rows(n, part, with_ids, False)
            yield _batch(out, doc_kind)
        yield _batch(packer.rows(n, part, with_ids, True)[0], doc_kind)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, part int, ids binary"
    def merger(level: int, final: bool):
        def merge(batch):
            group = batch.column("part")[0].as_py() // FAN_IN
            held = sorted(batch.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist(), key=lambda r: (-len(r["ids"]), r["doc_id"] is None, r["doc_id"] or 0, r["start"]))
            packer = Packer(size, windows, min_piece)
            for r in held:
                packer.put(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
            if final:
                packer.finish()
            out, _ = packer.rows(level << 56 | group << 32, group, with_ids, True)
            return pa.Table.from_batches([_batch(out, batch.schema.field("doc_id").type)])

        return merge

    done = written(rows.mapInArrow(first, schema), "packed")
    closed, level = [done.filter("not open")], 0
    while True:
        level += 1
        left = done.filter("open")
        most = left.agg(F.max("part")).first()[0]
        if most is None:
            break
        final = most < FAN_IN

        done = written(left.groupBy((F.col("part") / FAN_IN).cast("int")).applyInArrow(merger(level, final), schema), "packed")
        closed.append(done.filter("not open"))
        if final:
            break
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.drop("open", "part", *([] if with_ids else ["ids"]))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
