"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree after another, a feature at a time, on the binned features; the trees
of a feature add up to a lookup table. Then the pairs of features that explain most of what is left get
tables of their own. A score is the sum of the tables' values at a text's bins, through a logistic curve.

Fitted on at most `most` labelled rows (those with the least id hash); scored on whole texts of all rows,
in one pass without a shuffle. Tables and bins are some thousands of numbers at any input size.

Defined results: null and empty texts have features of zero and are scored like others. Labels other than 0
and 1 are left out; a document labelled both is learned as both. Of several rows that share a labelled id one
is learned. Without labels every score is 0.5, with one class alone its smoothed share. Repeated documents get
a row each. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import kernels as K
from ripplegraph.llm.base import by_batch, remainder, sampled

FEATURES = ("bytes", "words", "word_bytes", "upper", "digits", "marks", "symbols", "shouts", "pipes", "lines", "line_repeats", "echo", "distinct", "phrase_repeats", "top_word", "beyond_ascii")
_CLASSES = {
    "upper": K.byte_set((65, 90)),
    "lower": K.byte_set((97, 122)),
    "digits": K.byte_set((48, 57)),
    "marks": K.byte_set((0x22, 0x22), (0x27, 0x29), (0x2C, 0x2E), (0x3A, 0x3B)),
    "symbols": K.byte_set((0x23, 0x26), (0x2A, 0x2B), (0x2F, 0x2F), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E)),
    "shouts": K.byte_set((0x21, 0x21), (0x3F, 0x3F)),
    "pipes": K.byte_set((0x7C, 0x7C)),
    "space": K.byte_set((0x20, 0x20), (0x09, 0x0D)),
    "newline": K.byte_set((0x0A, 0x0A)),
    "beyond": K.byte_set((0x80, 0xFF)),
}
_LINE = ~_CLASSES["newline"]


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, at = K.texts_of(column)
    parts = [_features(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in K.pieces(at)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)


def _repeats(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's hashes, how many are different, and how often the most frequent one occurs."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])) if len(h) else np.zeros(0, np.int64)
    runs = np.diff(np.append(new, len(h)))
    distinct = np.bincount(t[new], minlength=len(first) - 1)
    top = np.zeros(len(first) - 1, np.int64)
    np.maximum.at(top, t[new], runs)
    return distinct, top


def _features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = {k: K.sums(c[data].astype(np.int64), at) for k, c in _CLASSES.items()}
    size = np.diff(at)
    starts, ends, first = K.words(data, at, K.SPACED_WORD)
    hashes, words = K.word_hashes(data, starts, ends), np.diff(first)
    text = np.repeat(np.arange(len(words)), words)
    distinct, top = _repeats(hashes, first)
    echo = np.bincount(text[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])], minlength=len(words)) if len(text) else words
    grams = K.gram_hashes(hashes, 3)
    inside = text[2:] == text[: len(grams)] if len(grams) else np.zeros(0, bool)
    phrases = np.bincount(text[: len(grams)][inside], minlength=len(words))
    different, _ = _repeats(grams[inside], np.concatenate([[0], np.cumsum(phrases)]))
    a, b, line_first = K.words(data, at, _LINE)
    lines = np.diff(line_first)
    line_distinct, _ = _repeats(K.word_hashes(data, a, b), line_first)
    some, letters = np.maximum(size, 1), np.maximum(n["upper"] + n["lower"], 1)
    per_word, per_line = np.maximum(words, 1), np.maximum(lines, 1)
    return np.stack(
        [np.log1p(size), np.log1p(words), (size - n["space"]) / per_word, n["upper"] / letters, n["digits"] / some, n["marks"] / some, n["symbols"] / some, n["shouts"] / some, n["pipes"] / per_word,
         n["newline"] / some, (lines - line_distinct) / per_line, echo / per_word, distinct / per_word, (phrases - different) / np.maximum(phrases, 1), top / per_word, n["beyond"] / some], axis=1
    ).astype(np.float32)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Additive:
    """Lookup tables of single features and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, pairs: int = 6, bins: int = 48, pair_bins: int = 8, rate: float = 0.15):
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        n = len(y)
        share = (y.sum() + 0.5) / (n + 1)
        self.base, self.singles, self.pairs = float(np.log(share / (1 - share))), [], []
        if not 0 < y.sum() < n:
            return
        cut = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k))
        cuts = [cut(x[:, j], bins) for j in range(x.shape[1])]
        at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
        tables, f = [np.zeros(len(c) + 1) for c in cuts], np.full(n, self.base)
        for _ in range(rounds):
            for j, own in enumerate(at):
                g, h = _gradients(f, y)
                step = rate * shallow_tree(np.bincount(own, g, len(tables[j])), np.bincount(own, h, len(tables[j])))
                tables[j] += step
                f += step[own]
        self.singles = list(zip(cuts, tables))
        rough = [cut(x[:, j], pair_bins) for j in range(x.shape[1])]
        cell = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(rough)]
        g, h = _gradients(f, y)

        def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
            shape = len(rough[i]) + 1, len(rough[j]) + 1
            return np.bincount(cell[i] * shape[1] + cell[j], v, shape[0] * shape[1]).reshape(shape)

        gains = sorted(((-cross_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i, j in itertools.combinations(range(x.shape[1]), 2)))
        chosen = [(i, j) for gain, i, j in gains[:pairs] if gain < 0]
        grids = [np.zeros((len(rough[i]) + 1, len(rough[j]) + 1)) for i, j in chosen]
        for _ in range(pair_rounds):
            for (i, j), own in zip(chosen, grids):
                g, h = _gradients(f, y)
                step = rate * cross_tree(grid(i, j, g), grid(i, j, h))[0]
                own += step
                f += step[cell[i], cell[j]]
        self.pairs = [(i, j, rough[i], rough[j], t) for (i, j), t in zip(chosen, grids)]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(self.singles):
            f += values[np.searchsorted(cuts, x[:, j], "right")]
        for i, j, a, b, values in self.pairs:
            f += values[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return _logistic(f)


def _gradients(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _logistic(f)
    return y - p, p * (1 - p)


def _leaf(g, h, damp: float = 1.0):
    return g / (h + damp)


def _gain(g, h, damp: float = 1.0):
    return g * g / (h + damp)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of depth two over ordered bins."""
    out = np.zeros(len(g))

    def split(a: int, b: int, depth: int) -> None:
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if depth and b - a > 1:
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
            best = int(np.argmax(gain))
            if gain[best] > _gain(cg[-1], ch[-1]) + 1e-9:
                split(a, a + best + 1, depth - 1)
                split(a + best + 1, b, depth - 1)
                return
        out[a:b] = _leaf(cg[-1], ch[-1])

    split(0, len(g), 2)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values by cell of the best cut into four quadrants, and its gain."""
    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quads = [(c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]) for c in (cg, ch)]
    gain = sum(_gain(a, b) for a, b in zip(*quads))
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    v = [_leaf(a[i, j], b[i, j]) for a, b in zip(*quads)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j] - _gain(cg[-1, -1], ch[-1, -1]))


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int) -> DataFrame:
    """doc_id, text and y of at most `most` labelled ids of each class that may be learned from.

    A document labelled both 0 and 1 is in both classes. An id that several rows of docs share comes as often.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & allowed).select("doc_id", F.col(label).alias("y")).distinct()
    none, some = (sampled(usable.where(F.col("y") == y), F.col("doc_id"), most) for y in (0, 1))
    return docs.select("doc_id", "text").join(F.broadcast(none.unionByName(some)), "doc_id").select("doc_id", "text", "y")  # at most `most` rows a class


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = 15_000) -> Additive:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = features(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(rows), pa.list_(pa.float32())), batch.column("y").cast(pa.int32())], ["doc_id", "x", "y"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = by_batch(labelled(docs, labels, "quality", allowed, most), work, f"doc_id {kind}, x array<float>, y int")
    rows = each.groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()  # one row for an id and class, however many rows share it
    rows.sort(key=lambda r: (str(r.doc_id), r.y, r.x))
    return Additive(np.array([r.x for r in rows], np.float32).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows]))


def scored(docs: DataFrame, model: Additive, text: str = "text") -> DataFrame:
    """docs with quality, a double from 0 to 1, in place of a column of that name."""
    docs = docs.drop("quality")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.round(model.score(features(batch.column(text))), 6)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, "quality"])

    return by_batch(docs, work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", quality double")


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The scores of all documents by a model that learned from rows of remainder 0 and 2 modulo 3."""
    model = fit(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"))
