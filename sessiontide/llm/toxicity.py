"""Toxicity scores of restored text, by noisy-channel deobfuscation.

1. A trigram model of characters is counted over every document; its table is bounded by the alphabet.
2. A suspicious token (digits or symbols among or around letters, letters held down, letters set apart) becomes a lattice:
   a symbol may stand for the letters it resembles, a run for one or two letters, a separator for nothing, and between spaced letters a word may end. Viterbi takes the path of least channel cost and greatest model
   probability. Tokens of over `PIECE` characters are decoded in pieces that overlap, so the work grows with their length and no word of
   up to `OVERLAP` characters is cut. Neighbours
   that a word of the lexicon was split into are joined if the model finds the word likelier than the pieces.
3. Words and beginnings of words in the restored text that labelled rows show to be toxic make a lexicon; a logistic
   model over the strongest of them in a text gives the score. Lexicon and model learn from separate halves of a
   bounded sample of the rows that may be learned from.

Null and empty texts have no words and get the score that the model gives to none. Without labels of both kinds
every score is 0. Repeated rows and rows with a null id get a row each, an empty table none, and texts are read to their
end however long they are. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, id_text, labelled_sample, slices, table, written

#: Labelled rows that lexicon and model may learn from, and the most lexicon entries.
SAMPLE_ROWS, LEXICON = 16000, 20000
#: The letters of the model, and the letters that a symbol may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
RESEMBLES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz"}
SEPARATORS = set(".-_*'~^/\\,:; ")
SIZE = len(LETTERS) + 1
CODE = {c: k + 1 for k, c in enumerate(LETTERS)}
#: Channel costs in nats: a symbol for a letter, a run of three or more, a doubled letter meant once, a dropped sign, a symbol that is nothing.
SYMBOL, HELD, DOUBLED, DROPPED, LOST = 0.7, 0.5, 3.0, 0.3, 4.0
EDGE = ".,;:!?\"'()[]{}<>*#%&$@|-_~^/\\`=+"
SYMBOLS = "@$!|+(€£*#"
DIGIT_OR_SYMBOL = re.compile(r"[0-9@$!|+(€£*#]")
HELD_DOWN = re.compile(r"(.)\1(?:\1|(.)\2)")
SET_APART = re.compile(r"\w[.\-_*'~^/]\w[.\-_*'~^/]\w")
PIECES = re.compile(r"[^\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")
BEGINNINGS = (4, 5, 6, 7)
SHOWN = 5  # strongest words of a text that the model sees
#: Characters of a token that are decoded at once, and of those that are remembered; joined neighbours have two letters at least.
PIECE, OVERLAP, REMEMBERED, LEAST_PART = 256, 64, 64, 2


def _codes() -> np.ndarray:
    codes = np.zeros(0x180, np.uint8)
    for c, k in CODE.items():
        codes[ord(c)] = k
    return codes


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of (two letters before, letter), 0 standing for all that is no letter; summed by Spark over all documents."""
    rows = id_text(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = _codes(), np.zeros(SIZE**3, np.int64)
        for batch in slices(batches):
            text = "  ".join(t for t in batch.column(1).to_pylist() if t).lower() + "  "
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            c = codes[np.minimum(points, 0x17F)].astype(np.int32)
            total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["code", "n"])

    counts = np.zeros(SIZE**3)
    got = rows.mapInArrow(count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # SIZE**3 rows at most
    counts[got["code"].to_numpy()] = got["n"].to_numpy()
    return counts.reshape(SIZE, SIZE, SIZE)


def log_model(counts: np.ndarray) -> list[float]:
    """Interpolated log probabilities, as a flat list for quick reading."""
    two, one = counts.sum(0), counts.sum((0, 1))
    share = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1)
    mixed = 0.8 * share(counts) + 0.15 * share(two)[None] + 0.04 * share(one)[None, None] + 0.01 / SIZE
    return np.log(mixed).ravel().tolist()


def decode(text: str, model: list[float], spaced: bool = False) -> str:
    """The likeliest words behind an obfuscated text; with `spaced`, words may end between any two letters."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    at = 0
    while at < len(text):
        ch, end = text[at], at + 1
        while end < len(text) and text[end] == ch:
            end += 1
        run, at = end - at, end
        meant = [(ch, 0.0)] if ch in CODE else [(c, SYMBOL * run) for c in RESEMBLES.get(ch, "")]
        if len(meant) > 2 and text[max(0, end - run - 1) : end - run] not in CODE and text[end : end + 1] not in CODE:
            meant = []  # a masked letter stands beside a known one
        lost = None if ch in CODE else DROPPED if ch in SEPARATORS else LOST * min(run, 2)
        times = ((1, 0.0),) if run == 1 else ((1, DOUBLED), (2, 0.0)) if run == 2 else ((1, HELD), (2, HELD))
        if spaced and run == 2:
            times = ((1, DOUBLED / 2), (2, 0.0))
        new: dict[tuple[int, int], tuple[float, str]] = {}
        if spaced:
            for (p, q), (s, out) in list(states.items()):
                if q:
                    to, score = (q, 0), s + model[(p * SIZE + q) * SIZE]
                    if to not in states or score > states[to][0]:
                        states[to] = (score, out + " ")
        for (p, q), (s, out) in states.items():
            for c, cost in meant:
                k = CODE[c]
                for n, more in times:
                    a, b, score = p, q, s - cost - more
                    for _ in range(n):
                        score += model[(a * SIZE + b) * SIZE + k]
                        a, b = b, k
                    if (a, b) not in new or score > new[a, b][0]:
                        new[a, b] = (score, out + c * n)
            if lost is not None and ((p, q) not in new or s - lost > new[p, q][0]):
                new[p, q] = (s - lost, out)
        states = new or states
    return max((s + model[(p * SIZE + q) * SIZE], out) for (p, q), (s, out) in states.items())[1]


def suspicious(core: str) -> bool:
    return bool(DIGIT_OR_SYMBOL.search(core) and LETTER.search(core) or HELD_DOWN.search(core) or SET_APART.search(core))


def cuts(token: str) -> list[str]:
    """The token in pieces that overlap, so that every part of OVERLAP characters is whole in one of them."""
    return [token[k : k + PIECE] for k in range(0, max(1, len(token) - OVERLAP), PIECE - OVERLAP)]


def restored(token: str, model: list[float]) -> list[str]:
    """The words that a lower-case token holds, obfuscated ones restored."""
    core = token.strip(EDGE)
    words = [core] if core.isalpha() else PIECES.findall(core)
    if core and suspicious(core):
        for piece in cuts(core):
            words += PIECES.findall(decode(piece, model))
    # signs around the core that may be letters: the whole is decoded too
    start = token.find(core) if core else 0
    lead, tail = token[:start], token[start + len(core) :]
    lead = lead[next((k for k, c in enumerate(lead) if c in SYMBOLS), len(lead)) :]
    tail = tail[: len(tail) - next((k for k, c in enumerate(reversed(tail)) if c in SYMBOLS), len(tail))]
    if core and (lead or tail) and LETTER.search(core):
        for piece in cuts(lead + core + tail):
            words += PIECES.findall(decode(piece, model))
    return words


def features(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in BEGINNINGS if len(word) > k)]


class Reader:
    """Splits texts into tokens, column by column, and looks each different token up once. With a lexicon, neighbours that
    one of its words was split into are found too."""

    def __init__(self, model: list[float], of_words, lexicon: dict[str, float] | None = None):
        self.model = model
        look = lambda token: of_words(restored(token, model))
        remembered = lru_cache(1 << 18)(look)
        self.value = lambda token: remembered(token) if len(token) <= REMEMBERED else look(token)
        self.spaced = lambda letters: [w for piece in cuts(letters) for w in decode(piece, model, True).split()]
        self.of_words = of_words
        whole = [w for w in lexicon or () if w[0] != "^"]
        self.parts = {(w[:k], w[k:]): w for w in whole for k in range(LEAST_PART, len(w) - LEAST_PART + 1)}
        self.first = {a for a, _ in self.parts}

    def log(self, text: str) -> float:
        codes = [0, 0, *(CODE.get(c, 0) for c in text), 0]
        return sum(self.model[(a * SIZE + b) * SIZE + c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    def read(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, list, list]:
        """Row and number of each token, the values by number, and (row, value) of runs of single letters and of joined neighbours."""
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(text, "")))
        flat = lists.flatten().dictionary_encode()
        number = flat.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        tokens = flat.dictionary.to_pylist()
        runs = []
        if not tokens:
            return row, number, [], runs
        single = np.array([len(t) == 1 and (t in CODE or t in RESEMBLES) for t in tokens], bool)[number]
        step = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
        for a, b in zip(step[::2], step[1::2], strict=True):
            for r in np.unique(row[a:b]) if b - a >= 3 else ():  # a run ends with its document
                own = number[a:b][row[a:b] == r]
                if len(own) >= 3:
                    runs.append((int(r), self.of_words(self.spaced("".join(tokens[k] for k in own)))))
        if self.parts:
            cores = [t.strip(EDGE) for t in tokens]
            for k in np.flatnonzero(np.array([c in self.first for c in cores], bool)[number[:-1]] & (row[1:] == row[:-1])):
                a, b = cores[number[k]], cores[number[k + 1]]
                word = self.parts.get((a, b))
                if word and self.log(word) > self.log(a) + self.log(b):
                    runs.append((int(row[k]), self.of_words([word])))
        return row, number, [self.value(t) for t in tokens], runs


def lexicon_of(sample: DataFrame, model: list[float]) -> dict[str, float]:
    """Log odds of features that occur far more often in toxic rows; counted per document by Spark."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, lambda words: {f for w in words for f in features(w)})
        for batch in slices(batches):
            row, number, values, runs = reader.read(batch.column(0))
            found: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for r, k in set(zip(row.tolist(), number.tolist(), strict=True)):
                found[r] |= values[k]
            for r, v in runs:
                found[r] |= v
            label = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array([f for s in found for f in s], pa.string()), pa.array(label.astype(np.int32))], ["feature", "label"])

    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}
    t, c = F.col("t"), F.col("c")
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    gain = 2 * (t * F.log(t / ((t + c) * toxic / (toxic + clean))) + F.when(c > 0, c * F.log(c / ((t + c) * clean / (toxic + clean)))).otherwise(0.0))
    rows = (
        sample.select("text", "label").mapInArrow(emit, "feature string, label int")
        .groupBy("feature")
        .agg(F.sum("label").cast("double").alias("t"), F.sum(1 - F.col("label")).cast("double").alias("c"))
        .filter("t >= 3")
        .select("feature", odds.alias("odds"), gain.alias("gain"))
        .filter("odds > 1.5 and gain > 12")
        .orderBy(F.desc("gain"), "feature")
        .limit(LEXICON)
    )
    return {r["feature"]: r["odds"] for r in rows.collect()}


def evidence(text: pa.Array, reader: Reader) -> np.ndarray:
    """Per text: its `SHOWN` greatest word weights, the number of words that weigh, and that number per root of all."""
    row, number, values, runs = reader.read(text)
    weights = np.array(values, float)[number] if len(values) else np.zeros(0)
    some = np.flatnonzero(weights > 0)
    rows = np.concatenate([row[some], np.array([r for r, _ in runs], int)])
    held = np.concatenate([weights[some], np.array([w for _, w in runs], float)])
    rows, held = rows[held > 0], held[held > 0]
    out = np.zeros((len(text), SHOWN + 2))
    order = np.lexsort((-held, rows))
    rows, held = rows[order], held[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    out[rows[place < SHOWN], place[place < SHOWN]] = held[place < SHOWN]
    out[:, SHOWN] = np.log1p(np.bincount(rows, minlength=len(text)))
    out[:, SHOWN + 1] = np.bincount(rows, held, len(text)) / np.sqrt(1 + np.bincount(row, minlength=len(text)))
    return out


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge; the last weight is the constant. Evidence may not speak against toxicity: columns
    whose weight would be negative are left out, the most negative first."""
    used = np.append(np.ones(x.shape[1], bool), True)
    x = np.column_stack([x, np.ones(len(x))])
    while True:
        own, w = x[:, used], np.zeros(int(used.sum()))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            hess = (own * (p * (1 - p))[:, None]).T @ own + decay * np.eye(len(w))
            step = np.linalg.solve(hess, own.T @ (p - y) + decay * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        full = np.zeros(len(used))
        full[used] = w
        if full[:-1].min() >= 0:
            return full
        used[int(full[:-1].argmin())] = False


def heaviest(lexicon: dict[str, float]):
    return lambda words: max((lexicon.get(f, 0.0) for w in words for f in features(w)), default=0.0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[float], dict[str, float], np.ndarray] | None:
    model = log_model(count_trigrams(docs))
    sample = written(labelled_sample(docs, labels.filter(~held_out()), "toxic", rows, 1), "labelled")  # read three times
    half = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(3))
    lexicon = lexicon_of(sample.filter(half < 2), model)
    if not lexicon:
        return None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, heaviest(lexicon), lexicon)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(evidence(batch.column(0), reader).tolist(), pa.list_(pa.float64()))], ["label", "x"])

    got = sample.filter(half == 2).select("text", "label").mapInArrow(measure, "label int, x array<double>").toPandas()
    if got["label"].nunique() < 2:
        return None
    x, y = np.array(got["x"].tolist()), got["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    return model, lexicon, logistic(x[order], y[order])


def score(docs: DataFrame, fitted: tuple[list[float], dict[str, float], np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) over whole texts, in one pass without a shuffle."""
    rows = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(fitted[0], heaviest(fitted[1]), fitted[1]) if fitted else None
        for batch in slices(batches):
            p = np.zeros(batch.num_rows)
            if fitted:
                x = evidence(batch.column(1), reader)
                p = 1 / (1 + np.exp(-np.clip(x @ fitted[2][:-1] + fitted[2][-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
