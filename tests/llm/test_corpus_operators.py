"""Packing, decontamination, line, substring and near-duplicate operators against brute force."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import SMALL, docs, odd_rows, prose

import corpus_pipeline
from sessiontide.llm import components, decontam, lines, neardup, packing, quality, substrings


@pytest.mark.parametrize("partitions", [5, 20])
def test_packing_round_trip(spark, partitions):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(k, t) for k, t in [(r[0], r[1]) for r in odd_rows()] if k != 7] + [(20, "It's <|endoftext|> ÀÉ́ don't x ¼ ﬁ"), (21, prose(9000, 3))]
    source = docs(spark, rows).repartition(partitions)
    pieces = packing.pack(source, size=256, windows=4).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] > 0
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert sorted(p["doc_id"] for p in packing.pack(docs(spark, [(1, "a b"), (1, "a b"), (1, "c"), (None, None), (None, None)])).collect() if p["start"] == 0 and p["doc_id"]) == [1, 1, 1]
    assert sum(p["length"] for p in packing.pack(docs(spark, [(None, None), (None, ""), (3, "")])).collect()) == 3
    for doc, text in rows:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[doc], key=lambda p: p["start"])
        assert np.frombuffer(b"".join(p["ids"] for p in own), "<u4").tolist() == want
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        assert {p["doc_tokens"] for p in own} == {len(want)}
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda p: p["offset"])
        used = sum(p["length"] for p in own)
        assert used <= 256 and [p["offset"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        padding += 256 - used if used & (used - 1) else 0
    assert padding < 0.04 * sum(p["length"] for p in pieces)
    assert packing.pack(source.limit(0)).count() == 0


def test_ids_by_words_equal_ids_of_texts():
    import pyarrow as pa
    import public_tokenizers

    tokens = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    assert tokens.parts and tokens.lowers
    rng = random.Random(17)
    bits = ["a", "the", "Don't", "É", "é", "\u0301", "ß", "Σ", "İ", "1", "½", ".", ",", "!?", "%%%", "'s", "'", "-", "_", "漢", "ﬁ", ")", "WORD", "word", "\u00a0", "<|endoftext|>", " ", " ", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    got = [g.tolist() for k in range(0, 3000, 500) for g in tokens.encode(pa.array(texts[k : k + 500]), 2)]
    assert got == [[*tokens.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def plain_alignment(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        best = max(best, h[i, j])
    return best


def test_alignment_equals_plain_one():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 14))] for _ in range(2))
        score, start, end = decontam.alignment(" ".join(a), " ".join(b))
        assert round(score * 2 * len(a)) == plain_alignment(a, b) == plain_alignment(a, b[start:end])


def test_leaks_are_found_and_others_left(spark):
    items = [(k, prose(40, 100 + k)) for k in range(6)] + [(6, None), (7, ""), (8, "two words")]
    rng = random.Random(5)

    def edited(text):
        return " ".join(w if rng.random() > 0.12 else "other" for w in text.split())

    rows = [(k, prose(200, k)) for k in range(20)] + [(50 + k, f"{prose(50, 60 + k)} {items[k][1]} {prose(50, 70 + k)}") for k in range(6)]
    rows += [(80 + k, f"{prose(50, 90 + k)}\n{edited(items[k][1]).upper()}. {prose(50, 295 + k)}") for k in range(6)]
    rows += [(k, items[0][1]) for k in range(200, 260)] + [r for r in odd_rows() if r[0] not in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs(spark, rows), benchmark).collect()}
    assert set(got) == {(50 + k, k) for k in range(6)} | {(80 + k, k) for k in range(6)} | {(k, 0) for k in range(200, 260)}
    assert got[50, 0]["score"] == 1 and (got[50, 0]["start"], got[50, 0]["end"]) == (50, 90)
    assert decontam.contaminated(docs(spark, []), benchmark).count() == 0
    assert decontam.contaminated(docs(spark, rows), benchmark.limit(0)).count() == 0


def test_short_items_repeated_ids_and_ties(spark):
    items = [(1, "Zebra!"), (2, "quick zebra"), (3, prose(20, 1)), (4, ""), (5, None), (None, "lone")]
    rows = [(1, "a zebra."), (2, "the QUICK, zebra ran"), (3, "quick brown zebra"), (4, prose(30, 9)), (5, None), (6, "")]
    rows += [(7, "x y"), (7, f"{prose(5, 4)} {prose(20, 1)} {prose(5, 5)} {prose(20, 1)}"), (7, "zebra"), (None, "lone zebra")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["start"], r["end"]) for r in decontam.contaminated(docs(spark, rows), benchmark).collect()}
    assert got == {(1, 1): (1.0, 1, 2), (2, 1): (1.0, 2, 3), (2, 2): (1.0, 1, 3), (3, 1): (1.0, 2, 3), (7, 1): (1.0, 0, 1), (7, 3): (1.0, 5, 25), (None, 1): (1.0, 1, 2)}


def test_long_passages_are_cut_without_loss(spark):
    """A text full of common runs, so that its passages would be one, with copies anywhere in it."""
    rng = random.Random(21)
    items = [(k, " ".join(["of the and"] + prose(14, 60 + k).split() + ["of the and"])) for k in range(8)]
    text = []
    for _ in range(60):
        text += ["of", "the", "and"] + (items[rng.randrange(8)][1].split() if rng.random() < 0.2 else prose(rng.randrange(1, 9), rng.randrange(10**6)).split())
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["item_id"]: r["score"] for r in decontam.contaminated(docs(spark, [(1, " ".join(text))]), benchmark).collect()}
    want = {k: plain_alignment(t.split(), text) / (2 * len(t.split())) for k, t in items}
    assert got == {k: v for k, v in want.items() if v >= 0.4} and 1.0 in got.values()


def test_no_alignment_scores_more_than_most():
    rng = random.Random(13)
    for _ in range(400):
        a, b = ([rng.choice("abcdefgh"[: rng.choice([3, 8])]) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        assert plain_alignment(a, b) <= decontam.most(a, frozenset(a), b)


def test_edited_copies_are_found(spark):
    """Every item against every document: all that have three words in a row left and score enough are found."""
    rng = random.Random(14)
    items = [(k, prose(30, 400 + k)) for k in range(6)]
    texts = []
    for _, item in items:
        words = item.split()
        texts += [[w if (j + 1) % n else f"x{j}" for j, w in enumerate(words)] for n in (4, 5, 6)]
        texts += [[w if rng.random() > p else f"y{j}" for j, w in enumerate(words)] for p in (0.2, 0.25, 0.3, 0.4)]
        texts.append([x for j, w in enumerate(words) for x in ([w] if j % 3 else [f"z{j}", w])])
    rows = [(k, " ".join([prose(60, 800 + k), *t, prose(60, 900 + k)])) for k, t in enumerate(texts)] + [(500, items[0][1])]
    want = {}
    for (doc, text), (item, words) in itertools.product(rows, items):
        a, b = words.split(), text.split()
        score = plain_alignment(a, b) / (2 * len(a))
        if score >= 0.4 and {tuple(a[k : k + 3]) for k in range(len(a) - 2)} & {tuple(b[k : k + 3]) for k in range(len(b) - 2)}:
            want[doc, item] = score
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(docs(spark, rows), benchmark).collect()}
    assert got == want and len(want) > 40 and all((8 * k + j, k) in want for k in range(6) for j in range(3))


def test_patience_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(1, 12) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        pairs = lines.patience(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
    assert lines.patience([1, 2, 3, 4], [1, 2, 9, 3, 4]) == [(0, 0), (1, 1), (2, 3), (3, 4)]


def test_repeated_blocks_go_from_later_documents(spark):
    block = [prose(9, k) for k in range(10, 15)]
    own = lambda k: [prose(9, 1000 * k + j) for j in range(4)]
    texts = {1: own(1) + block, 2: own(2)[:2] + block[1:4] + own(2)[2:], 3: own(3) + ["of"] + block[:1], 4: own(1) + block, 5: ["of", *own(5)], 6: own(6)}
    rows = [(k, "\n".join(t)) for k, t in texts.items()] + [(9, None), (10, ""), (None, "\n".join(block)), (11, "\n\n"), (6, "\n".join(texts[6]))]
    source = docs(spark, rows)
    got = {}
    for r in lines.without_lines(source, lines.removed_lines(source)).collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[1] == ["\n".join(texts[1])] and got[5] == ["\n".join(texts[5])] and got[6] == ["\n".join(texts[6])] * 2
    assert got[2] == ["\n".join(own(2))] and got[4] == [""] and got[3] == ["\n".join(own(3) + ["of"])]
    assert got[9] == [None] and got[10] == [""] and got[11] == ["\n\n"] and got[None] == ["\n".join(block)]
    stage = lines.cut_lines(spark, source, SMALL)
    assert stage.columns == source.columns and {r["doc_id"] for r in stage.collect()} == {1, 2, 3, 5, 6, 9, 10, 11, None}
    empty = source.limit(0)
    assert lines.without_lines(empty, lines.removed_lines(empty)).count() == 0


def test_every_shared_line_names_its_owner(spark):
    hot, rare = prose(9, 1), [prose(9, 10 + k) for k in range(8)]
    rows = [(1, hot)] + [(2 + k, f"{prose(9, 100 + k)}\n{r}") for k, r in enumerate(rare)] + [(20 + k, f"{prose(9, 200 + k)}\n{hot}") for k in range(30)]
    rows += [(60, "\n".join([hot, prose(9, 300), *(f"{r}\n{prose(9, 310 + k)}" for k, r in enumerate(rare))]))]
    source = docs(spark, rows)
    got = {r["doc_id"]: r["removed"] for r in lines.removed_lines(source).collect()}
    assert got == {20 + k: [1] for k in range(30)} | {60: [0, 2, 4, 6, 8, 10, 12, 14, 16]}


def plain_blocks(later, words, earlier, min_words):
    """Every pair of places: lines in runs of enough words that stand in both."""
    mine, theirs = [k for k, h in enumerate(later) if h], [h for h in earlier if h]
    out = set()
    for x, y in itertools.product(range(len(mine)), range(len(theirs))):
        block = []
        for k, h in zip(mine[x:], theirs[y:]):
            if later[k] != h:
                break
            block.append(k)
            if sum(words[p] for p in block) >= min_words:
                out |= set(block)
    return sorted(out)


def test_repeated_lines_equal_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        n = rng.choice([2, 4, 9])
        a, b = ([rng.randrange(0, n) for _ in range(rng.randrange(0, 22))] for _ in range(2))
        size = [0, *(rng.randrange(1, 10) for _ in range(n))]
        words = [size[h] for h in a]
        assert lines.repeated_lines(a, words, b) == plain_blocks(a, words, b, 8)
    assert lines.repeated_lines([5, 7, 5, 8, 5], [9] * 5, [1, 5, 2, 5]) == [0, 2, 4]
    assert lines.repeated_lines([6, 3, 5], [9] * 3, [5, 4, 6]) == [0, 2]


@pytest.mark.parametrize("seed", range(3))
def test_lines_equal_brute_force(spark, seed):
    """Every document against every earlier one: lines of one to twelve words, blocks that only several lines make long enough."""
    rng = random.Random(seed)
    pool = [prose(n, 500 + k) for k, n in enumerate([1, 2, 3, 4, 5, 5, 7, 8, 9, 12] * 2)]
    blocks = [[rng.choice(pool) for _ in range(rng.randrange(1, 6))] for _ in range(8)]
    texts = {}
    for k in range(45):
        own = []
        for j in range(rng.randrange(1, 7)):
            own += rng.choice(blocks) if rng.random() < 0.5 else [rng.choice([*pool, "", prose(9, 1000 + 50 * k + j), prose(2, 9000 + 50 * k + j)])]
        texts[k] = own
    rows = [(k, "\n".join(t)) for k, t in texts.items()] + [(44, "\n".join(texts[44])), (44, "\n".join(texts[43] + texts[44])), (None, "\n".join(texts[3]))]
    want = {}
    for doc, text in rows:
        later = [x or 0 for x in text.split("\n")]
        gone = set()
        for earlier, other in rows:
            if doc is not None and earlier is not None and earlier < doc:
                gone |= set(plain_blocks(later, [len(x.split()) if x else 0 for x in later], [x or 0 for x in other.split("\n")], 8))
        if gone:
            want[doc, text] = sorted(gone)
    source = docs(spark, rows).repartition(3)
    hashed = source.selectExpr("doc_id", "hash(text) as part", "text").distinct()
    got = {(r["doc_id"], r["text"]): r["removed"] for r in lines.removed_lines(source).join(hashed, ["doc_id", "part"]).collect()}
    assert got == want and len(want) > 20
    assert sum(r["__lines_removed"] for r in lines.without_lines(source, lines.removed_lines(source)).collect()) == sum(len(want.get(r, [])) for r in rows)


def test_short_lines_make_a_block():
    """Two lines of five words whose lines stand singly in earlier documents still name the document that holds both."""
    a, b = 11, 12
    assert set(lines.shortest_runs([a, b], [5, 5])) & set(lines.shortest_runs([3, a, b, 4], [9, 5, 5, 1]))
    assert lines.shortest_runs([a, 0, b], [3, 0, 4]) == []
    assert lines.shortest_runs([a], [8]) == [a]


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def plain_classes(rows, weighting="count"):
    sets = {}
    for doc, text in rows:
        w = (text or "").split()
        runs = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
        sets[doc] = runs if weighting == "count" else Counter(set(runs))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 5 * (sets[a] & sets[b]).total() >= 4 * (sets[a] | sets[b]).total():
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, prose(150, k)) for k in range(30)] + [(40, None), (41, ""), (42, " \n"), (43, "a b"), (44, "a  b"), (45, "a c")]
    for k in range(50, 110):  # one group of near copies, and some on the border
        words = prose(150, 3).split()
        for _ in range(rng.choice([1, 2, 3])):
            words[rng.randrange(150)] = f"new{rng.random()}"
        rows.append((k, " ".join(words)))
    source = docs(spark, rows).repartition(3)
    want = plain_classes(rows)
    assert dict(neardup.near_classes(source).collect()) == want
    kept = {r["doc_id"] for r in neardup.keep_one(spark, source, SMALL).collect()}
    assert kept == {d for d, c in want.items() if c == d}
    odd = neardup.near_classes(docs(spark, odd_rows())).collect()
    assert len(odd) == len(odd_rows()) and {(r["doc_id"], r["class_id"]) for r in odd} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 6), (7, 7), (None, None), (8, 8)}
    assert neardup.near_classes(source.limit(0)).count() == 0


@pytest.mark.parametrize("weighting", ["count", "set"])
def test_repeated_runs_weigh(spark, weighting):
    """Pairs that only the sets, or only the counts, make similar enough; equal sets with other counts."""
    base, line = prose(120, 1), prose(12, 2)
    rows = [(1, base), (2, f"{base} " + f"{line} " * 12), (3, f"{base} " + f"{line} " * 2), (4, f"{base} " + f"{line} " * 13), (5, prose(120, 3))]
    got = dict(neardup.near_classes(docs(spark, rows), weighting=weighting).collect())
    assert got == plain_classes(rows, weighting)
    assert got == ({1: 1, 2: 2, 3: 1, 4: 2, 5: 5} if weighting == "count" else {1: 1, 2: 1, 3: 1, 4: 1, 5: 5})


def test_recall_of_near_copies(spark):
    """All documents of a table: what the exact similarity of all pairs that share a run says, by an inverted list."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain_classes(rows)
    got = dict(neardup.near_classes(docs(spark, rows)).collect())
    assert got == want and sum(d != c for d, c in want.items()) > 5


def test_links_of_a_group_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        base = [rng.permutation(60)[:20] for _ in range(3)]
        sets = [np.unique(np.concatenate([base[rng.integers(3)][: rng.integers(14, 21)], rng.integers(100, 130, rng.integers(0, 4))])).astype(np.int64) for _ in range(rng.integers(2, 14))]
        roots = [int(rng.integers(0, 5)) for _ in sets]

        def merged(pairs, roots=roots):
            up = {r: r for r in roots}
            find = lambda x: x if up[x] == x else find(up[x])
            for a, b in pairs:
                up[find(roots[a])] = find(roots[b])
            return {frozenset(k for k, r in enumerate(roots) if find(r) == x) for x in map(find, roots)}

        alike = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
        got = neardup.linked(sets, roots, 0.8)
        assert {tuple(sorted(p)) for p in got} <= set(alike) and merged(got) == merged(alike)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """A chain of texts, each near the next, in blocks of few members."""
    monkeypatch.setattr(neardup, "BLOCK", 400)
    rng = random.Random(31)
    words = prose(150, 3).split()
    rows = []
    for k in range(90):
        if k % 3 == 0:
            words[rng.randrange(150)] = f"drift{k}"
        copy = list(words)
        copy[rng.randrange(150)] = f"own{k}"
        rows.append((k, " ".join(copy)))
    got = dict(neardup.near_classes(docs(spark, rows).repartition(3)).collect())
    assert got == plain_classes(rows)


def test_darts_agree_as_often_as_weights_do():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    x, y = rng.integers(0, 9, 60).astype(float), rng.integers(0, 9, 60).astype(float)
    sig = neardup.dart_signatures(np.concatenate([keys, keys]), np.concatenate([x, y]), np.repeat([0, 1], 60), 3, 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.03
    assert (sig[:2] != 0).all() and (sig[2] == 0).all()


def plain_removed(rows, length):
    """For each row: its bytes under a string that has an equal one at a smaller (doc_id, start)."""
    first, out = {}, []
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    for doc, data in texts:
        for p in range(len(data) - length + 1):
            if doc is not None:
                first[data[p : p + length]] = min(first.get(data[p : p + length], (doc, p)), (doc, p))
    for doc, data in texts:
        hits = [p for p in range(len(data) - length + 1) if doc is not None and first[data[p : p + length]] < (doc, p)]
        out.append({k for p in hits for k in range(p, p + length)})
    return out


def test_repeats_of_a_group_equal_brute_force():
    rng = random.Random(6)
    for length in (3, 8):
        for _ in range(60):
            contexts = ["".join(rng.choice("ab") for _ in range(rng.randrange(length, 20))).encode() for _ in range(5)]
            place = np.array([[0] * 5, range(5)])
            seen = set()
            for got, c in zip(substrings.repeats(contexts, place, length), contexts, strict=True):
                for p in range(len(c) - length + 1):
                    assert got[p] == (c[p : p + length] in seen)
                    seen.add(c[p : p + length])


def as_removed(rows, gone):
    kept = [bytes(b for k, b in enumerate((t or "").encode()) if k not in g) for (_, t), g in zip(rows, gone, strict=True)]
    return sorted(((d, k, len((t or "").encode()), len(g), sum(x - 1 not in g for x in g)) for (d, t), k, g in zip(rows, kept, gone, strict=True)), key=repr)


@pytest.mark.parametrize("apart", [False, True])
def test_substrings_equal_brute_force(spark, monkeypatch, apart):
    if apart:
        monkeypatch.setattr(substrings, "MOST_CONTEXTS", 1)
    rng = random.Random(9)
    base = [prose(60, k) for k in range(4)]
    rows = [(k, " ".join(base[j] if rng.random() < 0.7 else base[j][rng.randrange(50) :] for j in rng.sample(range(4), 2)) + prose(8, k)) for k in range(30)]
    rows += [(40, "ab" * 400), (41, "é" * 200), (42, None), (43, ""), (44, "x" * 99), (45, base[0])]
    # rows that repeat an id: equal ones, ones with other texts, and ones that hold the other's text later on
    own = [prose(60, 90 + k) for k in range(3)]
    rows += [(50, own[0])] * 3 + [(51, own[1]), (51, prose(9, 77) + own[1]), (51, own[1] + own[2])] + [(52, own[2])] * 2 + [(None, own[0])] * 2
    got = sorted((tuple(r) for r in substrings.without_repeats(docs(spark, rows).repartition(3)).collect()), key=repr)
    assert got == as_removed(rows, plain_removed(rows, 100))


@pytest.mark.parametrize("most", [1, 5000])
def test_a_string_in_very_many_contexts_is_cut_apart(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST_CONTEXTS", most)
    monkeypatch.setattr(substrings, "INDEX_BYTES", 1 << 12)
    passage = prose(18, 3)
    rows = [(k, f"{prose(6, 100 + k)} {passage} {prose(6, 400 + k)}") for k in range(300)]
    got = sorted((tuple(r) for r in substrings.without_repeats(docs(spark, rows).repartition(5)).collect()), key=repr)
    assert got == as_removed(rows, plain_removed(rows, 100)) and sum(r[3] > 90 for r in got) == 299


def test_substrings_of_odd_rows(spark):
    rows = [r[:2] for r in odd_rows() if r[0] != 7] + [(7, prose(300, 7))] * 2
    got = sorted((tuple(r) for r in substrings.without_repeats(docs(spark, rows)).collect()), key=repr)
    assert got == as_removed(rows, plain_removed(rows, 100)) and [r[3] for r in got if r[0] == 7] == [0, 0]
    assert len(substrings.without_repeats(docs(spark, odd_rows())).collect()) == len(odd_rows())
    assert substrings.without_repeats(docs(spark, [])).count() == 0


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "sequence_id", "length"} <= set(got.columns) and got.count() > 50
    for name, stage in corpus_pipeline.STAGES:
        odd = stage(spark, docs(spark, odd_rows()), SMALL)
        if name != "packing":
            assert odd.columns == docs(spark, []).columns and odd.count() <= len(odd_rows())
        else:
            assert sum(r["length"] for r in odd.collect()) >= len(odd_rows())
        assert stage(spark, docs(spark, []), SMALL).count() == 0


def test_pipeline_equals_plain_stages(spark):
    """Each stage against a plain version, over what the one before it kept."""
    import public_tokenizers
    from tokenizers import Tokenizer

    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    before = texts(source)
    good = stages["quality rules"](spark, source, SMALL)
    model = quality.fit_forest(source, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {r["doc_id"] for r in quality.judge(source, model).collect() if r["kept"]}
    after = texts(good)
    assert set(after) == want and all(after[k] == before[k] for k in want) and 0.5 * len(before) < len(want) < len(before)

    cut = stages["line dedup"](spark, good, SMALL)
    split = {k: [x.strip() for x in (t or "").split("\n")] for k, t in after.items()}
    plain, runs = {}, {}
    for k in sorted(after):
        mine = [j for j, x in enumerate(split[k]) if x]
        gone = set()
        for a, b in itertools.combinations(range(len(mine) + 1), 2):
            block = tuple(split[k][j] for j in mine[a:b])
            if sum(len(x.split()) for x in block) >= 8 and runs.setdefault(block, k) < k:
                gone |= set(mine[a:b])
        plain[k] = "\n".join(x for j, x in enumerate((after[k] or "").split("\n")) if j not in gone)
    assert texts(cut) == {k: t for k, t in plain.items() if t.strip() or t == after[k]}

    one = stages["near-duplicates"](spark, cut, SMALL)
    classes = plain_classes(sorted(texts(cut).items()))
    assert texts(one) == {k: t for k, t in texts(cut).items() if classes[k] == k}

    clean = stages["decontamination"](spark, one, SMALL)
    items = [decontam.plain(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaks = set()
    for k, t in texts(one).items():
        words = decontam.plain(t)
        held = {tuple(words[j : j + 3]) for j in range(len(words) - 2)}
        for item in items:
            if {tuple(item[j : j + 3]) for j in range(len(item) - 2)} & held:
                codes = {w: c for c, w in enumerate(set(words) | set(item))}
                if decontam.align(np.array([codes[w] for w in item]), np.array([codes[w] for w in words]))[0] >= 0.4 * 2 * len(item):
                    leaks.add(k)
    assert set(texts(clean)) == set(texts(one)) - leaks

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for p in stages["packing"](spark, clean, SMALL).collect():
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in texts(clean).items()}


def test_edited_copies_are_found(spark):
    """Of all pairs whose plain alignment reaches the threshold, copies with 20 to 40 % of the words replaced among them, nine in
    ten at least are found; and a very long item changes nothing for the short ones."""
    rng = random.Random(6)
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(12).collect()]
    rows = []
    for k in range(72):
        words = decontam.plain(items[k % 12])
        edited = [f"zz{rng.randrange(999)}" if rng.random() < (0.2, 0.3, 0.4)[k // 24] else w for w in words]
        rows.append((k, prose(30, k) + " " + " ".join(edited) + " " + prose(30, k + 500)))
    benchmark = [(k, t) for k, t in enumerate(items)]
    want = set()
    for d, t in rows:
        for i, item in benchmark:
            a, b = decontam.plain(item), decontam.plain(t)
            codes = {w: c for c, w in enumerate({*a, *b})}
            if decontam.align(np.array([codes[w] for w in a]), np.array([codes[w] for w in b]))[0] >= 0.4 * 2 * len(a):
                want.add((d, i))
    found = lambda more: {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, rows), spark.createDataFrame(benchmark + more, "item_id long, text string")).collect()}
    got = found([])
    assert got <= want and len(want) > 40 and len(got) >= 0.9 * len(want), (len(got), len(want))
    print(f"recall {len(got) / len(want):.3f} of {len(want)}")
    assert found([(99, prose(3000, 77))]) == got
