"""Removal of repeated byte strings, by interval expansion on Burrows-Wheeler transforms.

Strings of `LENGTH` bytes are judged. To bring equal ones together without shuffling all of them, each belongs to the
run of `GRAM` bytes in it that has the least hash, its anchor: equal strings have the same anchor at the same place.
Successive strings of a document with one anchor make a context, the bytes that they cover. Then

1. contexts are dealt by their anchor's hash and read in order. Of equal contexts the earliest goes on; the strings of
   the others are repeats. An anchor that stands in one context only can have no others.
2. Contexts of an anchor that occurs in several are fetched from their documents, dealt by anchor again and indexed in
   groups of bounded size: a Burrows-Wheeler transform of the contexts, and from it the ends of the intervals of
   suffixes with a common prefix of 0, 1, 2 ... bytes, by breadth-first backward extension that stops below `LENGTH`.
   What is not parted then has that many bytes in common; all but the earliest string of such an interval are repeats.
3. The repeats' ranges are gathered by document, merged and cut out.

A document is its text's UTF-8 bytes, none if null. Order is by doc_id, then by place. Rows with a null id lose nothing.
Rows that repeat an id stand in one document, at the same places: a string is a repeat only if an equal one has a smaller
id or, under the same id, an earlier start, so equal rows of one id lose what a single one of them would lose. An empty
table gives no rows. Only id and text are read, so other columns can't clash.

Longest of all groups, an anchor with more than `MOST_CONTEXTS` different contexts is taken apart into its strings, whose
earliest places are found by partial aggregates of their hashes, so no task holds an anchor or a string whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, slices, table, written

LENGTH, GRAM = 100, 24
#: Text whose equal contexts are combined before they are dealt.
COMBINED = 32 << 20
#: Bytes that one index takes up, and the most different contexts of an anchor that may be in one.
INDEX_BYTES, MOST_CONTEXTS = 256 << 10, 5_000
NAMES = ["anchor", "context", "doc_id", "part", "at", "more", "again"]
A, B, C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: the first and last start of each context's strings, and its anchor's hash."""
    n, span = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, size, factor = data.astype(np.uint64) * A + C, 1, int(B)
    done, total, parts = None, 0, gram
    while True:  # hashes of runs of 1, 2, 4 ... bytes, joined to one of `gram`
        if parts & 1:
            done = h if done is None else done[: n - total - size + 1] * np.uint64(factor) + h[total : total + n - total - size + 1]
            total += size
        parts >>= 1
        if not parts:
            break
        h = h[: len(h) - size] * np.uint64(factor) + h[size:]
        size, factor = size * 2, factor * factor % (1 << 64)
    h = done
    h ^= h >> np.uint64(31)
    h *= A
    h ^= h >> np.uint64(29)
    # the hash's upper bits, then the place: the leftmost of equal ones is least
    bits = np.uint64(int(n).bit_length())
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(place) + 1, np.int64)  # starts of strings that end in their own text
    some = ends - starts >= length
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, ends[some] - length + 1, -1)
    valid = np.cumsum(inside)[:-1] > 0
    text = np.searchsorted(ends, np.arange(len(place)), "right")
    new = np.concatenate([[True], (np.diff(place) != 0) | (np.diff(text) != 0)])
    first = np.flatnonzero(new & valid)
    edge = np.concatenate([np.flatnonzero(new), [len(place)]])
    last = edge[np.searchsorted(edge, first, "right")] - 1
    last = np.minimum(last, ends[text[first]] - length)
    return first, last, h[place[first]]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols or more, by prefix doubling."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key * 258
        key[: n - k] += symbols[k:]
    known = 7
    while True:
        order = np.argsort(key)  # how equal ones stand makes no difference below `depth`
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if known >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        later = np.zeros(n, np.int64)
        later[: n - known] = rank[known:] + 1
        key = rank * (n + 1) + later
        known *= 2


def shared_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and at which places of it a suffix has less than `length` symbols in common with the one before.

    Intervals of suffixes with a common prefix of l symbols are extended backward by one symbol each, for l = 0, 1, 2 ...
    An extended interval whose end is not known yet has l symbols in common with what follows it; it goes on to the
    next round. One whose end is known adds nothing and is dropped, so every place is settled once.
    """
    n = len(symbols)
    order = suffix_order(symbols, length + 1)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt.astype(np.uint16), kind="stable")  # counts, as there are few symbols
    forward = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    forward[by_symbol] = np.arange(n)
    following = np.full(n, n)  # the next place with the same symbol, and the one before
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    before = np.full(n, -1)
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    parted = np.zeros(n + 1, bool)
    parted[0] = parted[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        size = high - low
        each = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        first = forward[each[before[each] < np.repeat(low, size)]]
        last = forward[each[following[each] >= np.repeat(high, size)]] + 1
        first.sort()
        last.sort()
        new = ~parted[last]
        low, high = first[new], last[new]
        parted[high] = True
    return order, parted


def repeats(contexts: list[bytes], place: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, in order of occurrence, which of its strings occur earlier in another or the same context.

    `place` is each context's first byte in its document, with the document's rank in the second row.
    """
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    symbols = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[ends - 1] = 0  # parts the contexts
    order, parted = shared_prefixes(symbols, length)
    group = np.cumsum(parted[:-1])
    context = np.searchsorted(ends, order, "right")
    offset = order - starts[context]
    whole = offset + length <= sizes[context]
    several = np.bincount(group[whole], minlength=group[-1] + 1) > 1
    some = np.flatnonzero(whole & several[group])
    at, doc = place[0][context[some]] + offset[some], place[1][context[some]]
    by = np.lexsort((at, doc, group[some]))
    g, d, p = group[some][by], doc[by], at[by]
    lead = np.concatenate([[True], g[1:] != g[:-1]])
    began = np.maximum.accumulate(np.where(lead, np.arange(len(g)), 0))
    again = some[by[(d != d[began]) | (p != p[began])]]  # the same place seen in two contexts is no repeat
    out = [np.zeros(max(0, s - length + 1), bool) for s in sizes]
    for c, o in zip(context[again], offset[again], strict=True):
        out[c][o] = True
    return out


def _anchor_rows(texts: DataFrame, kind: str) -> DataFrame:
    """(anchor, context, doc_id, part, at, more, again): hashes of anchor and context, the first start and how many follow.

    `again`: an earlier one of equal contexts is among the same `COMBINED` bytes of text, so this one is a repeat at once
    and needs no company; a context that a third of all rows holds goes on once for each such piece of text.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def combined() -> pa.RecordBatch:
            anchor, context, at, more, part = (np.concatenate([h[k] for h in held]) for k in range(5))
            docs = pa.concat_arrays([h[5] for h in held])
            rank = np.unique(docs.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            both = context ^ (anchor * A)
            order = np.lexsort((part, at, rank, both))
            o_both, o_rank, o_at, o_part = both[order], rank[order], at[order], part[order]
            like = np.concatenate([[False], o_both[1:] == o_both[:-1]])  # as the row before
            head = np.maximum.accumulate(np.where(like, 0, np.arange(len(order))))
            placed = (o_rank == o_rank[head]) & (o_at == o_at[head])
            same = like & np.concatenate([[False], (o_rank[1:] == o_rank[:-1]) & (o_at[1:] == o_at[:-1]) & (o_part[1:] == o_part[:-1])])
            again = np.zeros(len(at), bool)
            again[order] = ~placed
            keep = np.zeros(len(at), bool)
            keep[order] = ~same  # a row that occurs twice is one document
            columns = [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), docs, pa.array(part), pa.array(at.astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(again)]
            return pa.RecordBatch.from_arrays(columns, NAMES).filter(pa.array(keep))

        for batch in slices(batches, 1 << 20):
            text = batch.column(batch.schema.get_field_index("text"))
            data = b"".join(t.encode() for t in text.to_pylist())
            ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)).astype(np.int64)
            first, last, anchor = anchors(np.frombuffer(data, np.uint8), ends)
            row = np.searchsorted(ends, first, "right")
            context = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)], np.uint64)
            part = batch.column(1).to_numpy(zero_copy_only=False)[row]
            held.append((anchor, context, first - np.concatenate([[0], ends[:-1]])[row], last - first, part, batch.column(0).take(pa.array(row))))
            size += len(data)
            if size >= COMBINED:
                yield combined()
                held, size = [], 0
        if held:
            yield combined()

    return texts.mapInArrow(emit, f"anchor bigint, context bigint, doc_id {kind}, part int, at int, more int, again boolean")


def _read_groups(rows: DataFrame, kind: str) -> DataFrame:
    """Equal contexts and their anchors, read in order: `again` is true for those that stand later than the first of
    equal contexts; the others come out if their anchor has several. Rows are held no longer than until the next one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first of the last context, while nothing else of its anchor has come
        anchor = context = first = last = None  # of the rows before: the first place of the context, and the last row's
        for whole in batches:
            known = whole.column(6)
            yield whole.filter(known)
            batch = whole.filter(pc.invert(known))
            n = batch.num_rows
            if not n:
                continue
            anchors_, contexts_, ats, parts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 4, 3))
            # ranks of ids in this batch alone; -1 stands for the row before it
            ids = batch.column(2).dictionary_encode()
            number = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            before = lambda place: -1 if place is None else pc.index(ids.dictionary, pa.scalar(place[0], ids.dictionary.type)).as_py()
            one = np.concatenate([[anchor == anchors_[0]], anchors_[1:] == anchors_[:-1]])
            equal = one & np.concatenate([[context == contexts_[0]], contexts_[1:] == contexts_[:-1]])
            lead = np.maximum.accumulate(np.where(equal, -1, np.arange(n)))  # the context's first row, -1 if before
            head_id = np.where(lead < 0, before(first), number[lead])
            head_at = np.where(lead < 0, -1 if first is None else first[1], ats[lead])
            repeat = equal & ((number != head_id) | (ats != head_at))
            twice = np.concatenate([[last is not None and equal[0] and (before(last), last[1], last[2]) == (number[0], ats[0], parts[0])], equal[1:] & (number[1:] == number[:-1]) & (ats[1:] == ats[:-1]) & (parts[1:] == parts[:-1])])
            # a context whose anchor has another one before or after it; equal ones at one place count as others
            starts = np.flatnonzero(~repeat & ~twice)
            joins = one[starts]
            several = joins.copy()
            several[:-1] |= joins[1:]
            if held is not None and len(starts):
                if joins[0]:
                    yield held
                held = None
            out = repeat.copy()
            out[starts[several]] = True
            if len(starts) and not several[-1]:
                held = batch.slice(int(starts[-1]), 1)
            k = int(lead[-1])
            if k >= 0:
                first = (ids.dictionary[int(number[k])].as_py(), int(ats[k]))
            last = (ids.dictionary[int(number[-1])].as_py(), int(ats[-1]), int(parts[-1]))
            anchor, context = anchors_[-1], contexts_[-1]
            keep = pa.array(out)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(keep) for k in range(6)), pa.array(repeat[out])], NAMES)

    # what is a repeat already may go anywhere
    place = F.when(F.col("again"), F.xxhash64("doc_id", "at")).otherwise(F.col("anchor"))
    dealt = rows.repartition(place).sortWithinPartitions("again", "anchor", "context", "doc_id", "at", "part")
    return dealt.mapInArrow(read, f"anchor bigint, context bigint, doc_id {kind}, part int, at int, more int, again boolean")


def _fetched(texts: DataFrame, firsts: DataFrame, kind: str) -> DataFrame:
    """(key, apart, doc_id, part, at, bytes) of contexts that share their anchor; those of a very frequent anchor string
    by string, and only the strings' hashes."""
    wanted = firsts.groupBy("doc_id", "part").agg(F.collect_list(F.struct("anchor", "at", "more", "apart")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            out: list[tuple] = []
            for doc, part, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode()
                for w in wanted:
                    a, b = w["at"], w["at"] + w["more"] + LENGTH
                    if w["apart"]:
                        out += [(xxhash.xxh3_64_intdigest(data[p : p + LENGTH]) - (1 << 63), True, doc, part, p, xxhash.xxh64_digest(data[p : p + LENGTH])) for p in range(a, b - LENGTH + 1)]
                    else:
                        out.append((w["anchor"], False, doc, part, a, data[a:b]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.bool_(), batch.schema.field(0).type, pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "apart", "doc_id", "part", "at", "bytes"])

    met = texts.join(wanted.hint("merge"), ["doc_id", "part"]).select("doc_id", "part", "text", "wanted")
    return met.mapInArrow(cut, f"key bigint, apart boolean, doc_id {kind}, part int, at int, bytes binary")


def _indexed(contexts: DataFrame, kind: str) -> DataFrame:
    """(doc_id, part, start, end): ranges of the repeats among contexts, by an index for every so many bytes of whole keys."""

    def judge(keys: list, docs: list, parts: list, at: list, data: list) -> list[tuple]:
        unique = sorted(set(docs))
        rank = {d: k for k, d in enumerate(unique)}
        order = sorted(range(len(keys)), key=lambda k: (rank[docs[k]], at[k]))
        found = repeats([data[k] for k in order], np.array([[at[k] for k in order], [rank[docs[k]] for k in order]]))
        out: list[tuple] = []
        for k, hit in zip(order, found, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            out += [(docs[k], parts[k], at[k] + int(a), at[k] + int(b) - 1 + LENGTH) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size, doc_kind = 0, None

        def flush() -> pa.RecordBatch:
            out = judge(*held) if held[0] else []
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [doc_kind, pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "part", "start", "end"])

        for batch in batches:
            doc_kind = batch.schema.field(1).type
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if size >= INDEX_BYTES and row[0] != held[0][-1]:
                    yield flush()
                    held, size = [[], [], [], [], []], 0
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                size += len(row[4])
        if held[0]:
            yield flush()

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"doc_id {kind}, part int, start int, end int")


def _by_string(strings: DataFrame) -> DataFrame:
    """(doc_id, part, start, end) of strings that stand earlier too, known by two hashes of 64 bits: the least place of
    each is found by partial aggregates and joined back, so that no task holds all places of a string."""
    least = written(strings.groupBy("key", "bytes").agg(F.min(F.struct("doc_id", "at")).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "least")
    again = strings.join(least, ["key", "bytes"]).filter((F.col("doc_id") != F.col("least.doc_id")) | (F.col("at") != F.col("least.at")))
    return again.select("doc_id", "part", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text): `part`, a hash of the text, keeps rows apart that share an id only."""
    return id_text(docs).select("doc_id", F.hash("text").alias("part"), "text")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, part, ranges): ranges of bytes, in order of their starts, that repeated strings of `LENGTH` bytes cover."""
    texts = _texts(docs).filter("doc_id is not null and text is not null")
    kind = texts.schema["doc_id"].dataType.simpleString()
    groups = written(_read_groups(_anchor_rows(texts, kind), kind), "contexts")
    firsts = groups.filter("not again")
    many = written(firsts.groupBy("anchor").count().filter(F.col("count") > MOST_CONTEXTS).select("anchor", F.lit(True).alias("apart")), "frequent")
    found = groups.filter("again").select("doc_id", "part", F.col("at").alias("start"), (F.col("at") + F.col("more") + LENGTH).alias("end"))
    if many.isEmpty():
        fetched = _fetched(texts, firsts.withColumn("apart", F.lit(False)), kind)
    else:
        fetched = written(_fetched(texts, firsts.join(many, "anchor", "left").fillna(False, ["apart"]), kind), "fetched")
        found = found.unionByName(_by_string(fetched.filter("apart")))
    found = found.unionByName(_indexed(fetched.filter("not apart").select("key", "doc_id", "part", "at", "bytes"), kind))
    return found.groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for r in ranges or ():
        if out and r["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["end"]))
        else:
            out.append((r["start"], r["end"]))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): the bytes that stay, joined."""
    texts = _texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, counts = [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, at, parts, gone = (text or "").encode(), 0, [], merged(ranges)
                for start, end in gone:
                    parts.append(data[at:start])
                    at = end
                parts.append(data[at:])
                kept.append(b"".join(parts))
                counts.append((len(data), len(data) - len(kept[-1]), len(gone)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    # without the hints a small table would be broadcast, though both grow with the input
    joined = texts.join(repeated_ranges(docs).hint("merge"), ["doc_id", "part"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, f"doc_id {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
