"""Benchmark decontamination by winnowing.

The minimum k-gram hash of each sliding window is a text's fingerprint. A shared span of `span` words
shares all k-grams of one window, and so its minimum: every such span is found. Fingerprints of training
texts are joined with those of the benchmark, and each hit is extended along its alignment and checked
word by word. Benchmark items shorter than `span` words are looked up whole, by grams of their own length.

The benchmark goes to the workers in blocks of at most `block_mb` of text (one block, as a rule); with
several blocks the training texts pass once for each, so memory stays bounded at any benchmark size and
no training text is shuffled.

Defined results: a null text and one without words have no words, no hits and no items. A null item_id
counts as the empty id; items that repeat an id count once. Repeated documents get a row each. An empty
benchmark contaminates nothing. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import kernels as K
from ripplegraph.llm.base import by_batch, settle

FLAGS = 1 << 20


class Index:
    """Fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], span: int, k: int):
        self.span, self.k, self.ids = span, k, [i for i, _ in items]
        data, at = K.texts_of(pa.array([t for _, t in items], pa.large_string()))
        data = K.lower_ascii(data)
        starts, ends, first = K.words(data, at, K.PLAIN_WORD)
        hashes = K.word_hashes(data, starts, ends)
        self.words = [[data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
        self.hashes = [hashes[a:b] for a, b in zip(first, first[1:])]
        found, short = defaultdict(set), defaultdict(lambda: defaultdict(set))
        for i, own in enumerate(self.hashes):
            if len(own) >= span:
                grams = K.gram_hashes(own, k)
                for q in np.unique(selected(grams, np.arange(len(own) - span + 1), span - k + 1)):
                    found[int(grams[q])].add((i, int(q)))
            elif len(own):
                short[len(own)][int(K.gram_hashes(own, len(own))[0])].add((i, 0))
        #: For each gram length: places by hash, sorted hashes, and flags of their low bits.
        self.tables = {n: (t, np.array(sorted(t), np.uint64), flags(t)) for n, t in [(0, found), *short.items()] if t}


def flags(hashes) -> np.ndarray:
    out = np.zeros(FLAGS, bool)
    out[[h & (FLAGS - 1) for h in hashes]] = True
    return out


def lowest(grams: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of `width` grams."""
    n = len(grams) - width + 1
    out = grams[:n].copy()
    for j in range(1, width):
        np.minimum(out, grams[j : j + n], out=out)
    return out


def selected(grams: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """The place of the rightmost minimum in each of the given windows."""
    best = windows.copy()
    for j in range(1, width):
        best = np.where(grams[windows + j] <= grams[best], windows + j, best)
    return best


def known(values: np.ndarray, table: tuple) -> np.ndarray:
    """Where values are in the table: flags first, then the sorted hashes."""
    _, ordered, flag = table
    near = np.flatnonzero(flag[values & np.uint64(FLAGS - 1)])
    if not len(near):
        return near
    place = np.minimum(np.searchsorted(ordered, values[near]), len(ordered) - 1)
    return near[ordered[place] == values[near]]


def hits(index: Index, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set]]:
    """Number of words of each text, hit flags of all words, first words, and items of each text."""
    data = K.lower_ascii(data)
    starts, ends, first = K.words(data, at, K.PLAIN_WORD)
    hit, items = np.zeros(len(starts), bool), [set() for _ in at[1:]]
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    hashes = K.word_hashes(data, starts, ends)
    tried = set()
    for length, table in index.tables.items():
        size, span = length or index.k, length or index.span
        if len(hashes) < span:
            continue
        grams = K.gram_hashes(hashes, size)
        low = lowest(grams, span - size + 1)
        windows = known(low, table)
        windows = windows[text[windows] == text[windows + span - 1]]
        for p in np.unique(selected(grams, windows, span - size + 1)):
            d = int(text[p])
            for i, q in table[0].get(int(grams[p]), ()):
                if (alignment := (d, i, int(p) - q)) not in tried:
                    tried.add(alignment)
                    extend(index, data, starts, ends, hashes, (int(first[d]), int(first[d + 1])), alignment, span, hit, items)
    return np.diff(first), hit, first, items


def extend(index, data, starts, ends, hashes, bounds, alignment, span, hit, items) -> None:
    """Mark all runs of at least `span` equal words along one alignment of a text and an item."""
    d, i, shift = alignment
    own = index.hashes[i]
    a, b = max(bounds[0], shift), min(bounds[1], shift + len(own))
    same = np.concatenate([[False], hashes[a:b] == own[a - shift : b - shift], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    for s, e in zip(edge[::2], edge[1::2]):
        if e - s >= span and [data[x:y].tobytes() for x, y in zip(starts[a + s : a + e], ends[a + s : a + e])] == index.words[i][a + s - shift : a + e - shift]:
            hit[a + s : a + e] = True
            items[d].add(index.ids[i])


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", span: int = 10, k: int = 5, block_mb: int = 32) -> DataFrame:
    """docs with n_words, hit_words (numbers of hit words from 0) and items (ids of items that occur), a row for each row.

    Columns of these names give way. Items that repeat both id and text are one.
    """
    docs = docs.drop("n_words", "hit_words", "items")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / (block_mb * 2**20)))
    out = docs
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in own.collect()], span, k))  # at most about block_mb
        out = by_batch(out, _pass(index, text, bool(block)), _schema(out, bool(block)))
        if blocks > 1:
            out = settle(out)
    return out


def _schema(df: DataFrame, again: bool) -> str:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return columns if again else f"{columns}, n_words bigint, hit_words array<int>, items array<string>"


def _pass(index, text: str, again: bool):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = K.texts_of(batch.column(text))
        n_words, hit_words, items = [], [], []
        for a, b in K.pieces(at):
            n, hit, first, found = hits(index.value, data[at[a] : at[b]], at[a : b + 1] - at[a])
            n_words.append(n)
            items += map(list, found)
            hit_words += [np.flatnonzero(hit[x:y]) if f else () for f, x, y in zip(found, first, first[1:])]
        columns, names = list(batch.columns), list(batch.schema.names)
        if again:
            old_hit, old_items = columns[-2].to_pylist(), columns[-1].to_pylist()
            hit_words = [sorted({*o, *map(int, h)}) for o, h in zip(old_hit, hit_words)]
            items = [sorted({*o, *i}) for o, i in zip(old_items, items)]
            columns, names = columns[:-3], names[:-3]
        columns += [pa.array(np.concatenate(n_words), pa.int64()), pa.array(hit_words, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, [*names, *("n_words", "hit_words", "items")])

    return work


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of contamination(): a row for each document."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )
