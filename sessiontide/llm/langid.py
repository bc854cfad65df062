"""Language identification by a small byte convolutional network.

A text is cut into windows of `WIDTH` bytes, the last one padded with zeros. Filters of widths 2, 3 and 4 slide over the
bytes; each filter's greatest response in the window, above zero, goes to a softmax layer. The logarithms of the
windows' probabilities are averaged over the whole text, weighted by bytes. Training is numpy on the driver over a
bounded sample of labelled passages, balanced over the languages; scoring is one pass over all rows without a shuffle.

Null texts, and texts without a letter (Unicode category L), are ``und`` with score 0, and so is everything if nothing is
labelled. Rows with a null language teach nothing. Ties go to the language first in order of name. Repeated rows and rows
with a null id get a row each, an empty table none. Only id, text and, to learn, the language are read, so other columns
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, id_text, slices, table

#: Passages of `PASSAGE` characters that training may see: of a language, and of all, if there are so many languages.
PER_LANGUAGE, PASSAGE, MOST_PASSAGES = 1500, 600, 600_000
WIDTH, FILTERS, WIDTHS, STEPS = 192, 8, (2, 3, 4), 1000
PLACES = WIDTH - max(WIDTHS) + 1


class ByteNet:
    def __init__(self, languages: list[str], seed: int = 4):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)

    def train(self, windows: np.ndarray, target: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the cross entropy. A pooled value passes its gradient to the bytes under its greatest response alone."""
        rng = np.random.default_rng(seed)
        values = [*self.filters, self.bias, self.dense, self.offset]
        mean, square, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        while step < steps:
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                x, y = windows[order[at : at + batch]], target[order[at : at + batch]]
                rows = np.arange(len(x))[:, None]
                pooled, best = [], []
                for w, f in zip(WIDTHS, self.filters, strict=True):
                    s = sum(f[k][x[:, k : k + PLACES]] for k in range(w))
                    best.append(s.argmax(1))
                    pooled.append(np.take_along_axis(s, best[-1][:, None], 1)[:, 0])
                raw = np.concatenate(pooled, 1) + self.bias
                hidden = np.maximum(raw, 0)
                z = hidden @ self.dense + self.offset
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(x)), y] -= 1
                p /= len(x)
                back = (p @ self.dense.T) * (raw > 0)
                grads = []
                for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    g, part = np.zeros_like(f), back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        np.add.at(g[k], (x[rows, best[i] + k], np.arange(FILTERS)[None]), part)
                    grads.append(g)
                grads += [back.sum(0), hidden.T @ p, p.sum(0)]
                step += 1
                for v, g, m, q in zip(values, grads, mean, square, strict=True):
                    m += 0.1 * (g - m)
                    q += 0.001 * (g * g - q)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)

    def tables(self) -> tuple[np.ndarray, ...]:
        """The filters summed over pairs of bytes, so that a place costs three lookups."""
        two, three, four = self.filters
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        return np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], 1), three[2], pair(four[2], four[3])

    def log_probs(self, windows: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        first, third, last = tables
        out = []
        for at in range(0, len(windows), 512):
            x = windows[at : at + 512]
            pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
            s = first.take(pairs[:, :PLACES], axis=0)
            s[..., FILTERS : 2 * FILTERS] += third.take(x[:, 2 : 2 + PLACES], axis=0)
            s[..., 2 * FILTERS :] += last.take(pairs[:, 2 : 2 + PLACES], axis=0)
            z = np.maximum(s.max(1) + self.bias, 0) @ self.dense + self.offset
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out)


def cut(data: bytes) -> np.ndarray:
    return np.frombuffer(data.ljust(-(-max(len(data), 1) // WIDTH) * WIDTH, b"\0"), np.uint8).reshape(-1, WIDTH)


def fit(docs: DataFrame, lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> ByteNet | None:
    """The passages are picked by a hash of the id, so many for each language, from anywhere in the text."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    counts = dict(known.groupBy("lang").count().toArrow().to_pandas().itertuples(index=False))  # a row a language
    if not counts:
        return None
    per_language = max(1, min(per_language, MOST_PASSAGES // len(counts)))
    known = known.join(F.broadcast(docs.sparkSession.createDataFrame(list(counts.items()), "lang string, number long")), "lang")
    key = (F.xxhash64("doc_id", F.lit(4)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) * F.col("number")
    start = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.greatest(F.length("text") - PASSAGE // 2, F.lit(1))) + 1
    rows = known.select("doc_id", "lang", key.alias("key"), F.substring("text", start.cast("int"), F.lit(PASSAGE)).alias("passage"))
    # the key is even from 0 to the language's count: below the number wanted there are about so many
    picked = rows.filter(F.col("key") < per_language).collect()
    picked = sorted(picked, key=lambda r: (r["key"], r["lang"], r["passage"]))[: 2 * per_language * len(counts)]
    languages = sorted(counts)
    rng = np.random.default_rng(7)
    windows, target = [], []
    for r in picked:
        data = r["passage"].encode()
        for size in (WIDTH, int(rng.integers(8, WIDTH))):  # also short ones
            at = int(rng.integers(0, max(1, len(data) - size)))
            windows.append(cut(data[at : at + size])[0])
            target.append(languages.index(r["lang"]))
    net = ByteNet(languages)
    net.train(np.stack(windows), np.array(target))
    return net


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) over whole texts."""
    rows = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in slices(batches, 1 << 20):
            texts = batch.column(1).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            some = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net else []
            if some:
                parts = [texts[k].encode() for k in some]
                windows = [cut(p) for p in parts]
                logs = net.log_probs(np.concatenate(windows), tables)
                ends = np.cumsum([len(w) for w in windows])
                weight = np.full(len(logs), float(WIDTH))
                weight[ends - 1] = [len(p) - (len(w) - 1) * WIDTH for p, w in zip(parts, windows, strict=True)]
                starts = np.concatenate([[0], ends[:-1]])
                z = np.add.reduceat(logs * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                score[some] = p[np.arange(len(some)), best]
                for k, b in zip(some, best, strict=True):
                    lang[k] = net.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
