"""Language identification by hierarchical discrimination.

First the language family is predicted, then one-versus-one linear support vector machines separate the
languages within it; a family with one language needs none. Families are told apart by one-versus-one
machines as well. Votes decide, then the sum of margins, then the name. A text is described by the shares of
its hashed letter trigrams (of UTF-8 bytes, lower-cased, ASCII other than letters taken as a blank), so a linear
margin is a sum over the text: whole texts are scored in one vectorised pass, without a shuffle.

Fitted on at most `most` texts a language and `in_all` of all (those with the least id hash). Languages and families are those of
the labels; a language missing from FAMILIES is a family of its own. Weights are integers, so that a score
does not depend on how texts are batched.

Defined results: `und` with score 0 for a null text, for one without a letter, and where nothing could be
learned. Null labels are not learned from. Repeated documents get a row each. Columns besides the id, the text
and, for fitting, the label are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import kernels as K
from ripplegraph.llm.base import by_batch, remainder, sampled

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa sa si ur",
    "semitic": "am ar he mt",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BUCKETS = 1 << 14
SCALE = 1 << 20
_BLANK = ~K.byte_set((0x61, 0x7A), (0x80, 0xFF))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def trigrams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at each byte; BUCKETS where a text ends first or all is blank."""
    letters = np.where(_BLANK[data], np.uint8(32), data).astype(np.uint32)
    out = np.full(len(data), BUCKETS, np.int32)
    if len(data) > 2:
        code = (letters[:-2] << np.uint32(16)) | (letters[1:-1] << np.uint32(8)) | letters[2:]
        hashed = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32)
        hashed[(letters[:-2] == 32) & (letters[1:-1] == 32)] = BUCKETS
        out[:-2] = hashed
    ends = at[1:][np.diff(at) > 0]
    out[ends - 1] = BUCKETS
    out[np.maximum(ends - 2, 0)] = BUCKETS
    return out


def machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 120) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge, accelerated gradient steps); y is -1 or 1."""
    n = len(y)
    lipschitz = np.float32(1 + 2 * cost * float((x * x).sum(1).max()))
    w = z = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - (z - np.float32(2 * cost / n) * ((y * slack) @ x)) / lipschitz
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


class Hierarchy:
    """Machines among families, and among the languages of each."""

    def __init__(self, samples: dict[str, np.ndarray]):
        """samples: for each language a matrix of trigram shares."""
        members: dict[str, list[str]] = {}
        for lang in sorted(samples):
            members.setdefault(family_of(lang), []).append(lang)
        self.levels = []  # names and pairs of names, first of the families
        weights = []
        groups = [{f: np.concatenate([samples[m] for m in own]) for f, own in sorted(members.items())}]
        groups += [{m: samples[m] for m in own} for _, own in sorted(members.items())]
        for group in groups:
            names, pairs = list(group), []
            for a, b in itertools.combinations(range(len(names)), 2):
                x = np.concatenate([group[names[a]], group[names[b]]])
                y = np.concatenate([np.ones(len(group[names[a]]), np.float32), -np.ones(len(group[names[b]]), np.float32)])
                share = np.where(y > 0, len(y) / 2 / (y > 0).sum(), len(y) / 2 / (y < 0).sum())
                weights.append(machine(x * share.astype(np.float32)[:, None] ** 0.5, y))
                pairs.append((a, b, len(weights) - 1))
            self.levels.append((names, pairs))
        self.families = sorted(members)
        table = np.zeros((BUCKETS + 1, len(weights)), np.int64)
        if weights:
            table[:BUCKETS] = np.round(np.array(weights).T * SCALE)
        self.table = table

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each text, each machine's margin."""
        grams = trigrams(data, at)
        n = np.maximum(K.sums((grams != BUCKETS).astype(np.int64), at), 1)
        out = np.empty((len(at) - 1, self.table.shape[1]))
        for j in range(out.shape[1]):
            out[:, j] = K.sums(self.table[:, j][grams], at) / n * (NORM / SCALE)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.families:
            return ["und"] * len(column), np.zeros(len(column))
        data, at = K.texts_of(column, lower=True)
        m = np.concatenate([self.margins(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in K.pieces(at)])
        family, sure = self._vote(0, m)
        langs, score = np.empty(len(m), object), np.zeros(len(m))
        for i in range(len(self.families)):
            own = np.flatnonzero(family == i)
            best, within = self._vote(i + 1, m[own])
            langs[own] = np.array(self.levels[i + 1][0], object)[best]
            score[own] = sure[own] * within
        langs[~letters], score[~letters] = "und", 0.0
        return langs.tolist(), np.round(score, 6)

    def _vote(self, level: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner of each row, and how sure: the curve of its least margin."""
        names, pairs = self.levels[level]
        votes, total, least = np.zeros((len(m), len(names))), np.zeros((len(m), len(names))), np.full((len(m), len(names)), np.inf)
        for a, b, j in pairs:
            d = m[:, j]
            votes[:, a] += d >= 0
            votes[:, b] += d < 0
            total[:, a] += d
            total[:, b] -= d
            least[:, a] = np.minimum(least[:, a], d)
            least[:, b] = np.minimum(least[:, b], -d)
        best = np.argmax(votes + 0.4 * np.tanh(total / 50), axis=1)
        edge = least[np.arange(len(m)), best]
        return best, 1 / (1 + np.exp(-np.clip(3 * edge, -30, 30))) if pairs else np.ones(len(m))


#: Shares are multiplied by this, which brings their length near 1.
NORM = 10.0


def shares(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, its trigrams' buckets and shares."""
    data, at = K.texts_of(column, lower=True)
    out = []
    for a, b in K.pieces(at):
        grams = trigrams(data[at[a] : at[b]], at[a : b + 1] - at[a])
        for x, y in zip(at[a:b] - at[a], at[a + 1 : b + 1] - at[a]):
            where, n = np.unique(grams[x:y], return_counts=True)
            n, where = n[where != BUCKETS], where[where != BUCKETS]
            out.append((where.astype(np.int16), (n / max(n.sum(), 1) * NORM).astype(np.float32)))
    return out


def fit(docs: DataFrame, allowed: Column, lang: str = "lang", text: str = "text", most: int = 300, in_all: int = 12_000) -> Hierarchy:
    """Learned on at most `most` texts a language, fewer where there are so many languages that it were more than `in_all`."""
    n_langs = docs.where(F.col(lang).isNotNull() & allowed).select(lang).distinct().count()
    most = max(1, min(most, in_all // max(n_langs, 1)))
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & allowed).select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = shares(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([w for w, _ in rows], pa.list_(pa.int16())), pa.array([v for _, v in rows], pa.list_(pa.float32()))], ["doc_id", "lang", "at", "share"])

    chosen = sampled(usable, F.col("doc_id"), most, ["lang"]).select("doc_id", "lang", "text")
    rows = by_batch(chosen, work, f"doc_id {kind}, lang string, at array<smallint>, share array<float>").collect()  # at most `most` a language
    rows.sort(key=lambda r: (r.lang, str(r.doc_id), r.at))
    samples = {}
    for name, own in itertools.groupby(rows, key=lambda r: r.lang):
        own = list(own)
        samples[name] = np.zeros((len(own), BUCKETS), np.float32)
        for row, r in zip(samples[name], own):
            row[np.array(r.at, np.int64)] = r.share
    return Hierarchy(samples)


def identified(docs: DataFrame, model: Hierarchy, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, in place of columns of these names."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, score = shared.value.predict(batch.column(text))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return by_batch(docs, work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lang_pred string, score double")


def op1(docs: DataFrame) -> DataFrame:
    """The languages of all documents by machines that learned from rows of remainder 1 to 4 modulo 5."""
    model = fit(docs, remainder(F.col("doc_id"), 5) != 0)
    return identified(docs.select("doc_id", "text"), model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
