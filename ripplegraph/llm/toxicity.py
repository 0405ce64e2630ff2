"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library's trainer on at most `most` labelled documents a class and
`most_bytes` of text in all:
one on pieces of ordinary texts, one on what toxic texts say beyond these, i.e. their words that recur among
toxic texts and are far rarer in ordinary ones. Both are loaded as full dictionaries with their entropy tables;
the toxic side holds the ordinary dictionary too, so that a window's two compressed lengths differ by what
toxic text adds and by nothing else. The share of the length that the toxic dictionary saves is its distance.
A text is described by how many of its windows reach each threshold of savings, absolutely and as a share of
all, and by its best windows; a logistic curve over these is calibrated on labelled texts that no dictionary saw.

Windows are short (`width` words): marks of toxicity are single words, and in windows of dozens of words the
noise of zstandard's parse, which shifts with each match, outweighs them (the README has figures). A short block
that does not shrink is stored as it is, so each window is led by a run that both dictionaries hold; then its
own marginal length counts. A saving may also come from where a match happens to start, so windows with one are
compressed again, more thoroughly, behind another lead, and shifted by a word. Windows cover the whole text.
All rows are scored in one pass without a shuffle; dictionaries are some KB at any input size. Words are
lower-cased (A-Z).

Defined results: null and blank texts have one empty window. Labels other than 0 and 1 are left out; a document
labelled both is learned as both, and of several rows that share a labelled id one is. Without labels every score is 0.5, with one class alone its smoothed share.
Repeated documents get a row each. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.base import by_batch, remainder, settle
from ripplegraph.llm.quality import labelled

#: Savings in bytes from which a window counts, each a feature.
STEPS = (1, 2, 3, 4, 6)
#: The first bytes of a trained dictionary (a fixed value of the format).
MAGIC = b"\x37\xa4\x30\xec"
#: Windows whose savings a worker remembers.
MEMORY = 400_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "ignore").lower().split()


def trained(pieces: list[bytes], size: int, **cover: int) -> bytes:
    """A full zstandard dictionary of the pieces, or their last bytes where they are too few to train on.

    cover: lengths k of the segments and d of the runs that the trainer counts; it tries some itself if not given.
    """
    pieces = sorted(pieces)
    random.Random(0).shuffle(pieces)  # the trainer holds the last of them out, which must not be whole texts
    try:
        return zs.train_dictionary(size, pieces, **cover).as_bytes()
    except zs.ZstdError:
        return b" ".join(pieces)[-size:]


def ordinary_dictionary(texts: list[list[bytes]], size: int) -> bytes:
    return trained([b" ".join(ws[i : i + 16]) for ws in texts for i in range(0, len(ws), 16)], size, k=64, d=8)


def toxic_dictionary(toxic: list[list[bytes]], ordinary: list[list[bytes]], size: int, odds: float = 2.5) -> bytes:
    """Trained on pieces of the words by which toxic texts differ: recurring ones, `odds` (a logarithm) likelier there."""
    in_toxic, in_ordinary = (Counter(w for ws in texts for w in set(ws)) for texts in (toxic, ordinary))
    least = max(2, min(20, len(toxic) // 50))
    rarely = lambda w, n: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((in_ordinary[w] + 0.5) / (len(ordinary) + 1)) > odds
    own = {w for w, n in in_toxic.items() if n >= least and rarely(w, n)}
    told = [[w for w in ws if w in own] for ws in toxic]
    return trained([b" " + b" ".join(ws[i : i + 4]) + b" " for ws in told for i in range(0, len(ws), 4)], size, k=24, d=6)


class Distance:
    """Two dictionaries and what a window saves with the toxic one."""

    def __init__(self, ordinary: bytes, toxic: bytes, width: int):
        self.ordinary, self.toxic, self.width = ordinary, toxic, width

    def open(self) -> None:
        self.known, self.sure = {}, {}
        self.quick = self._pair(zs.STRATEGY_LAZY, 4)
        self.thorough = self._pair(zs.STRATEGY_BTULTRA, 3)
        self.leads = self.ordinary[-64:], self.ordinary[-160:-32]

    def _pair(self, strategy: int, match: int) -> list:
        """Compressors with the ordinary and the toxic dictionary."""
        parameters = zs.ZstdCompressionParameters(strategy=strategy, min_match=match, search_log=6, target_length=64, hash_log=14, chain_log=14, window_log=17, write_checksum=0, write_content_size=0, write_dict_id=0)
        out = []
        for content in (self.ordinary, self.ordinary + self.toxic):  # a dictionary's content is its end
            full = self.ordinary.startswith(MAGIC)
            d = zs.ZstdCompressionDict(content if len(content) >= 8 else b" " * 8 + content, dict_type=zs.DICT_TYPE_FULLDICT if full else zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=parameters)
            out.append(zs.ZstdCompressor(dict_data=d, compression_params=parameters).compress)
        return out

    def saved(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves on a window, by a quick search for matches."""
        if (v := self.known.get(window)) is None:
            padded = self.leads[0] + b" " + window + b" "
            v = len(self.quick[0](padded)) - len(self.quick[1](padded))
            if len(self.known) < MEMORY:
                self.known[window] = v
        return v

    def confirmed(self, window: bytes) -> int:
        """The lesser of the quick and a thorough search, behind another lead."""
        if (v := self.sure.get(window)) is None:
            v = self.saved(window)
            if v >= STEPS[0]:
                padded = self.leads[1] + b" " + window + b" "
                v = min(v, len(self.thorough[0](padded)) - len(self.thorough[1](padded)))
            if len(self.sure) < MEMORY:
                self.sure[window] = v
        return v

    def features(self, text: str | None) -> list[float]:
        """Of windows' savings as found, as confirmed, and as confirmed in a window shifted by one word as well."""
        ws, width = words_of(text), self.width
        found, sure, shifted = [], [], []
        for i in range(0, len(ws) or 1, width):
            window = b" ".join(ws[i : i + width])
            v = s = both = self.saved(window)
            if v >= STEPS[0]:
                s = both = self.confirmed(window)
                if s >= STEPS[0]:
                    before, after = ws[max(0, i - 1) : i - 1 + width], ws[i + 1 : i + 1 + width]
                    both = min(s, max(self.confirmed(b" ".join(before)), self.confirmed(b" ".join(after))))
            found.append(v), sure.append(s), shifted.append(both)
        return [f for d in (found, sure, shifted) for f in described(np.array(d))]


def described(d: np.ndarray) -> list[float]:
    best = np.sort(d)[::-1][:3]
    n = [int((d >= s).sum()) for s in STEPS]
    return [float(best[0]), float(best.sum()), *(math.log1p(k) for k in n), *(100 * k / (len(d) + 10) for k in n)]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Calibration:
    """A logistic curve over standardised features, by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        n = len(y)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if n else (0.0, 1.0)
        share = (y.sum() + 0.5) / (n + 1)
        width = x.shape[1] + 1
        self.w = np.zeros(width)
        self.w[0] = math.log(share / (1 - share))
        if not 0 < y.sum() < n:
            return
        z = self._with_one(x)
        keep = np.diag([1e-6, *[ridge] * (width - 1)])
        for _ in range(30):
            p = _logistic(z @ self.w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ self.w)
            self.w += step * min(1, 4 / (np.abs(step).max() + 1e-12))

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.scale], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self._with_one(x) @ self.w)


def learned(docs: DataFrame, labels: DataFrame, allowed: Column, most: int, most_bytes: int) -> list[tuple[bool, int, str, str]]:
    """half, y, text and id of the labelled sample, by id: at most `most` documents a class and `most_bytes` of text.

    Documents come in by the hash of their ids; one longer than what is left of the bytes is passed over.
    """
    each = labelled(docs, labels, "toxic", allowed, most).groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    half = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("/half"))) % 3 == 0
    sample = settle(each.select(F.col("doc_id").cast("string").alias("id"), "y", F.coalesce("text", F.lit("")).alias("text"), half.alias("half")))
    left, long = most_bytes, []
    for r in sorted(sample.select("id", "y", F.octet_length("text").alias("n"), F.xxhash64("id", F.lit("sample")).alias("spot")).collect(), key=lambda r: (r.spot, r.id, r.y)):
        if r.n <= left:
            left -= r.n
        else:
            long.append((r.id, r.y))
    if long:
        passed = docs.sparkSession.createDataFrame(long, "id string, y int")
        sample = sample.join(F.broadcast(passed), ["id", "y"], "left_anti")  # at most `most` rows a class
    return sorted(((r.half, r.y, r.text, r.id) for r in sample.toLocalIterator()), key=lambda r: (r[3], r[1]))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = 4000, most_bytes: int = 64 << 20, width: int = 2, ordinary_size: int = 8192, toxic_size: int = 768) -> tuple[Distance, Calibration]:
    """Dictionaries from two thirds of the sample and calibration from the rest, so that it sees unlearned texts."""
    rows = learned(docs, labels, allowed, most, most_bytes)
    texts = [[words_of(t) for half, y, t, _ in rows if not half and y == k] for k in (0, 1)]
    distance = Distance(ordinary_dictionary(texts[0] or texts[1], ordinary_size), toxic_dictionary(texts[1], texts[0], toxic_size), width)
    distance.open()
    rest = [r for r in rows if r[0]]
    if len({r[1] for r in rest}) < 2:
        rest = rows
    x = np.array([distance.features(t) for _, _, t, _ in rest], float).reshape(len(rest), 3 * (2 + 2 * len(STEPS)))
    calibration = Calibration(x, np.array([y for _, y, _, _ in rest], float))
    return Distance(distance.ordinary, distance.toxic, width), calibration


def scored(docs: DataFrame, model: tuple[Distance, Calibration], text: str = "text") -> DataFrame:
    """docs with toxicity, a double from 0 to 1, in place of a column of that name."""
    docs = docs.drop("toxicity")
    distance, calibration = model

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _opened(distance)
        x = np.array([own.features(t) for t in batch.column(text).to_pylist()], float)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(calibration.score(x), 6))], [*batch.schema.names, "toxicity"])

    return by_batch(docs, work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", toxicity double")


_OPEN: dict[tuple, Distance] = {}


def _opened(distance: Distance) -> Distance:
    """The worker's own compressors for these dictionaries; the last ones are kept."""
    key = distance.ordinary, distance.toxic, distance.width
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Distance(*key)
        _OPEN[key].open()
    return _OPEN[key]


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The scores of all documents by a model that learned from rows of remainder 1 to 4 modulo 5."""
    model = fit(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
