"""A hidden Markov language model.

Latent states emit classes: each of the `own` most frequent tokens is a class, the others share classes by
their last two bytes, and a token's share of its class follows from its smoothed count. Baum-Welch starts from
a bounded sample and then runs over all training documents: each partition's forward-backward pass emits its
expected transitions and emissions, and they are summed across partitions. Scoring is the scaled forward
recursion over the whole text, so a score is the exact log10 likelihood under the model.

Token counts cover all training documents and stay a table. The `near` most frequent tokens' counts go to the
workers (a bounded table); a document's other tokens are joined with the count table, one row for each
document and token. Frequent tokens, the only hot keys, so never reach that join: short ones are among the
`near`, and longer than 64 bytes those that are a thousandth of all tokens.

Documents of a batch step through time together, longest first. Batches hold a bounded number of tokens, or
one document.

Defined results: null and blank texts are one end token. Repeated documents are counted and scored each. With no
training documents counts are zero, a token's base probability is 1 (one unseen kind of token) and states are
alike. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.base import by_batch, remainder, sampled, settle, small_batches

#: The end token; words hold no white space.
END = b"\n"
SHAPES = 61
#: Distinct tokens counted in a worker before they are handed on.
HELD = 300_000
#: Tokens of the documents that step through time together.
TOGETHER = 250_000
#: Rows of an Arrow batch here; their tokens are encoded document by document.
ROWS = 4000


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def shape(token: bytes) -> int:
    return int.from_bytes(token[-2:], "big") % SHAPES


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """token (its bytes) and c, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "c"])
            held.clear()
            return batch

        for batch in batches:
            for t in batch.column(text).to_pylist():
                held.update(tokens_of(t))
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    return small_batches(docs.select(text)).mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


class Ids(dict):
    """Numbers of tokens; -1 for any other."""

    def __missing__(self, token: bytes) -> int:
        return -1


class Lexicon:
    """The most frequent tokens: their counts and classes, and the totals of classes of shapes."""

    def __init__(self, counts: dict[bytes, int], own: int, total: int, kinds: int, shape_total: np.ndarray, shape_kinds: np.ndarray):
        """counts: by falling count. shape_total, shape_kinds: of all tokens of each shape."""
        counts = counts if END in counts else counts | {END: 0}
        self.ids, self.total, self.kinds = Ids((t, i) for i, t in enumerate(counts)), total, kinds
        #: Tokens that are a class of their own.
        self.classes = {END: 0} | {t: i + 1 for i, t in enumerate([t for t in counts if t != END][:own])}
        self.first_shape = len(self.classes)
        self.n_classes = self.first_shape + SHAPES
        shapes = np.fromiter(map(shape, counts), np.int32, len(counts))
        self.count = np.fromiter(counts.values(), np.int64, len(counts))
        self.class_of = np.fromiter((self.classes.get(t, -1) for t in counts), np.int32, len(counts))
        alone = self.class_of >= 0
        self.shape_total = shape_total - np.bincount(shapes[alone], self.count[alone], SHAPES)
        self.shape_kinds = shape_kinds - np.bincount(shapes[alone & (self.count > 0)], minlength=SHAPES)
        #: log10 of a shape class's whole weight, of a token's smoothed count, and of its share of its class.
        self.shape_log = np.log10(self.shape_total + 0.5 * (self.shape_kinds + 1))
        self.log_count = np.log10(self.count + 0.5)
        self.log_share = np.where(alone, 0.0, self.log_count - self.shape_log[shapes])
        self.class_of = np.where(alone, self.class_of, self.first_shape + shapes).astype(np.int32)

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, tokens), np.int32, len(tokens))

    def encode(self, tokens: list[bytes], numbers: np.ndarray | None = None) -> np.ndarray:
        """The tokens' classes."""
        numbers = self.numbers(tokens) if numbers is None else numbers
        out = self.class_of[numbers]
        for i in np.flatnonzero(numbers < 0).tolist():
            out[i] = self.first_shape + shape(tokens[i])
        return out

    def prior(self) -> np.ndarray:
        """Smoothed shares of the classes."""
        weight = np.full(self.n_classes, 0.5)
        for t, i in self.classes.items():
            weight[i] += self.count[self.ids[t]]
        weight[self.first_shape :] += self.shape_total
        return weight / weight.sum()


def lexicon(counts: DataFrame, near: int, own: int) -> Lexicon:
    """The at most `near` most frequent short tokens are found by a bound on the count, from a table of its logarithms."""
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # Long tokens too where they are frequent: at most a thousand reach a thousandth of all tokens.
    short = counts.where((F.octet_length("token") <= 64) | (F.col("c") > F.lit(total / 1000)))
    step = F.floor(F.log2("c") * 32).cast("int")
    least, held = None, 0
    for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect():  # 32 rows for each doubling of the count
        held += r.n
        if held > near:
            break
        least = r.least
    rows = short.where(F.col("c") >= least).collect() if least is not None else []
    top = {bytes(r.token): r.c for r in sorted(rows, key=lambda r: (-r.c, bytes(r.token)))}
    if END not in top and (end := counts.where(F.col("token") == F.lit(END)).first()):  # its real count, however many tokens are above it
        top[END] = end.c
    shape_total, shape_kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    of = F.conv(F.hex(F.substring("token", -2, 2)), 16, 10).cast("long") % SHAPES
    for s, c, n in counts.groupBy(of.alias("s")).agg(F.sum("c"), F.count("*")).collect():
        shape_total[s], shape_kinds[s] = c, n
    return Lexicon(top, own, total, kinds, shape_total, shape_kinds)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class, state

    @staticmethod
    def rough(prior: np.ndarray, states: int, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        emit = prior[:, None] * rng.uniform(0.5, 1.5, (len(prior), states))
        move = rng.uniform(0.5, 1.5, (states, states)) + states * np.eye(states)
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray, strength: float = 20.0) -> Model:
        emit = emit + strength * prior[:, None]
        move, start = move + 1.0, start + 1.0
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def packed(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes by time and then document, longest document first; where each time begins; the documents' order."""
    size = np.array([len(s) for s in sequences])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    time = np.concatenate([np.arange(n) for n in size])
    doc = np.repeat(np.arange(len(size)), size)
    place = np.lexsort((doc, time))
    flat = np.concatenate([sequences[i] for i in order])[place]
    return flat, np.concatenate([[0], np.cumsum(np.bincount(time))]), order


def forward(model: Model, flat: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """log10 likelihoods in packed order; with keep, the scaled forward values and the scales of all places."""
    kept, scale = (np.empty((len(flat), len(model.start))) if keep else None), np.empty(len(flat))
    e, low, high = None, 0, 0
    for t in range(len(at) - 1):
        x, y = at[t], at[t + 1]
        if y > high:  # emissions by stretches, so that a very long text needs no table of all its own
            low, high = x, max(y, min(len(flat), x + TOGETHER))
            e = model.emit[flat[low:high]]
        a = ((a[: y - x] @ model.move) if t else model.start) * e[x - low : y - low]
        s = a.sum(1)
        a = a / s[:, None]
        scale[x:y] = s
        if keep:
            kept[x:y] = a
    log = np.log10(scale)
    total = np.zeros(at[1])
    time_n = np.diff(at)
    np.add.at(total, np.arange(len(flat)) - np.repeat(at[:-1], time_n), log)
    return total, kept, scale


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (class, state) of the sequences."""
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape)
    for group in groups(sequences):
        flat, at, _ = packed([sequences[i] for i in group])
        _, alpha, scale = forward(model, flat, at, keep=True)
        e, gamma = model.emit[flat], np.empty_like(alpha)
        beta = np.ones((at[1], states))
        for t in range(len(at) - 2, -1, -1):
            x, y = at[t], at[t + 1]
            if t < len(at) - 2:
                z = at[t + 2]
                ahead = beta[: z - y] * e[y:z] / scale[y:z, None]
                move += alpha[x : x + z - y].T @ ahead
                beta[: z - y] = ahead @ model.move.T
            gamma[x:y] = alpha[x:y] * beta[: y - x]
        start += gamma[: at[1]].sum(0)
        for s in range(states):
            emit[:, s] += np.bincount(flat, gamma[:, s], len(emit))
    return start, move * model.move, emit


def groups(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Sequences of like length together, so that few steps run for the long ones alone."""
    group, n = [], 0
    for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
        if group and n + len(sequences[i]) > TOGETHER:
            yield group
            group, n = [], 0
        group.append(i)
        n += len(sequences[i])
    if group:
        yield group


def train(docs: DataFrame, lex: Lexicon, states: int = 8, most: int = 1200, warm: int = 8, passes: int = 2, text: str = "text") -> Model:
    """Baum-Welch: `warm` rounds on at most `most` documents, then `passes` rounds over all of docs."""
    prior = lex.prior()
    model = Model.rough(prior, states)
    some = [lex.encode(tokens_of(r[0])) for r in sampled(docs.select("doc_id", text), F.col("doc_id"), most).select(text).toLocalIterator()]
    some.sort(key=lambda s: (len(s), s.tobytes()))
    for _ in range(warm if some else 0):
        model = Model.from_counts(*expected(model, some), prior)
    for _ in range(passes if some else 0):
        shared = docs.sparkSession.sparkContext.broadcast((lex, model))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, now = shared.value
            total = [np.zeros(states), np.zeros((states, states)), np.zeros(now.emit.shape)]
            for batch in batches:
                for x, y in zip(total, expected(now, [own.encode(tokens_of(t)) for t in batch.column(text).to_pylist()])):
                    x += y
            rows = np.concatenate([total[0][None], total[1], total[2]])
            used = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(rows[used, s]) for s in range(states))], ["k", *(f"s{s}" for s in range(states))])

        columns = [f"s{s}" for s in range(states)]
        sums = small_batches(docs.select(text), ROWS).mapInArrow(run, "k int, " + ", ".join(f"{c} double" for c in columns)).groupBy("k").agg(*[F.sum(c).alias(c) for c in columns]).collect()  # a row for each class and state
        rows = np.zeros((1 + states + lex.n_classes, states))
        for r in sums:
            rows[r[0]] = r[1:]
        model = Model.from_counts(rows[0], rows[1 : states + 1], rows[states + 1 :], prior)
    return model


def scored(docs: DataFrame, counts: DataFrame, lex: Lexicon, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, base_score and score."""
    kept = [f for f in docs.schema.fields if f.name != text]
    shared = docs.sparkSession.sparkContext.broadcast((lex, model))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, now = shared.value
        sequences, n, n_known, base, within, rare = [], [], [], [], [], []
        for t in batch.column(text).to_pylist():
            tokens = tokens_of(t)
            numbers = own.numbers(tokens)
            sequences.append(own.encode(tokens, numbers))
            held = numbers[numbers >= 0]
            others = Counter(tokens[i] for i in np.flatnonzero(numbers < 0).tolist())
            n.append(len(tokens))
            n_known.append(int((own.count[held] > 0).sum()))
            base.append(float(own.log_count[held].sum()))
            within.append(float(own.log_share[held].sum() - sum(k * own.shape_log[shape(token)] for token, k in others.items())))
            rare.append([{"token": token, "k": k} for token, k in others.items()])
        likely = np.empty(len(sequences))
        for group in groups(sequences):
            flat, at, order = packed([sequences[i] for i in group])
            likely[np.array(group)[order]] = forward(now, flat, at)[0]
        arrays = [pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(likely + np.array(within)), pa.array(rare, RARE)]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *arrays], [*(f.name for f in kept), "n_tokens", "_known", "_base", "_score", "_rare"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    rows = settle(by_batch(docs, work, f"{columns}, n_tokens bigint, _known bigint, _base double, _score double, _rare array<struct<token: binary, k: bigint>>", ROWS).withColumn("_row", F.monotonically_increasing_id()))
    rare = rows.select("_row", F.explode("_rare").alias("r")).select("_row", "r.token", "r.k").join(counts, "token", "left")
    c = F.coalesce("c", F.lit(0))
    found = rare.groupBy("_row").agg(F.sum(F.col("k") * F.log10(c + 0.5)).alias("_more"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("_seen"))
    more = F.coalesce("_more", F.lit(0.0))
    whole = math.log10(lex.total + 0.5 * (lex.kinds + 1))
    return (
        rows.drop("_rare")
        .join(found, "_row", "left")
        .select(
            *[F.col(f"`{f.name}`") for f in kept],
            "n_tokens",
            (F.col("_known") + F.coalesce("_seen", F.lit(0))).cast("long").alias("n_known"),
            F.round(F.col("_base") + more - F.col("n_tokens") * F.lit(whole), 6).alias("base_score"),
            F.round(F.col("_score") + more, 6).alias("score"),
        )
    )


RARE = pa.list_(pa.struct([("token", pa.binary()), ("k", pa.int64())]))


def language_model(docs: DataFrame, allowed: Column, near: int = 200_000, own: int = 4096, **options) -> tuple[DataFrame, Lexicon, Model]:
    """Counts, lexicon and model of the rows that may be learned from."""
    learned = docs.where(allowed)
    counts = settle(token_counts(learned))
    lex = lexicon(counts, near, own)
    return counts, lex, train(learned, lex, **options)


def op7(docs: DataFrame) -> DataFrame:
    """The scores of all documents by a model that learned from rows of remainder 0 and 2 to 4 modulo 5."""
    docs = docs.select("doc_id", "text")
    counts, lex, model = language_model(docs, remainder(F.col("doc_id"), 5) != 1)
    found = scored(docs, counts, lex, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(lex.total).cast("long").alias("train_tokens"), "base_score", "score")
