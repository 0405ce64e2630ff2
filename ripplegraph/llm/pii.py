"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans: the four base kinds (email, ip, card, phone) and looser forms of personal data. On each
proposal labelers vote for, against or not at all: the base pattern's own test, a gazetteer (top-level
domains, calling codes, card issuers), words of context before the span, words and shapes that speak against
it, and the variety of its digits. Votes are counted by pattern of votes, a table bounded by the number of
labelers; expectation-maximisation on it estimates how reliable each labeler is and how likely each pattern of
votes is personal data. With these as soft labels a naive Bayes classifier of spans is trained on counts of
span features (kind and length, characters around, digits). Base spans always stay; a proposal that overlaps
none of them stays where the classifier is for it.

A text's spans are found in its own row: pieces between matches give their places, so nothing is shuffled but
the counts. Places are in code points, the end exclusive.

Defined results: a null text counts as the empty one and has no spans. Texts without a proposal have the digest
of the empty text. Repeated documents get a row each. Without any proposal the classifier keeps base spans
alone. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.base import settle

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "account")
BASE = KINDS[:4]
_LOCAL = "A-Za-z0-9._%+-"
#: Patterns, and a cheap test that a text without a match fails. Possessive and anchored where that changes no match.
PATTERNS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "."),
    # Whole runs of digits with single separators; those of other lengths are consumed without a match.
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
LOOSE = {
    "email": (r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63}){1,8}", "at"),
    "phone": (r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", None),
    "secret": (r"(?i)\b(?:token|password|passwd|secret|api[_-]?key|access[_-]?key)\x20?[=:]\x20?\"?[A-Za-z0-9_/+-]{8,128}\"?", None),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}\b", None),
    "account": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-"),
}
DOMAINS = "com org net edu gov mil int info biz io ai co dev app de fr es it uk us eu ru cn jp in br ca au nl ch at be se no dk fi pl pt ie nz mx ar example test"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
CUES = {
    "email": "mail|contact|write|from|to:",
    "ip": r"\bip\b|host|addr|server|client|login",
    "card": "card|visa|master|amex|credit|payment|pay",
    "phone": "phone|tel|call|mobile|fax|cell|contact",
    "secret": "token|password|secret|key",
    "iban": "iban|bank|account|transfer",
    "account": "ssn|social|security|account",
}
AGAINST = r"version|isbn|order|invoice|page|section|chapter|build|revision|serial"
VOTES, FEATURES = 5, 4
_SPAN = "array<struct<s:int,e:int,v:string,before:string,after:string>>"
_CHUNK = 200


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def placed(matches: Column, pieces: Column) -> Column:
    """Places, text and neighbourhood of the matches, from the pieces of text around them; long lists by chunks, so that time stays near-linear.

    before: at most 24 code points back to the last match. after: the code point behind, unless a match begins there.
    """
    parts = F.transform(
        matches,
        lambda v, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(v).alias("n"), v.alias("v"), F.right(F.get(pieces, i), F.lit(24)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("after")),
    )

    def of_chunk(chunk: Column, at: Column) -> Column:
        span = lambda acc, x: F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["n"]).alias("e"), x["v"].alias("v"), x["before"].alias("before"), x["after"].alias("after"))
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(span(acc, x))).alias("out"))
        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])

    def chunked(parts: Column) -> Column:
        length = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, x: n + x["gap"] + x["n"])
        starts = lambda chunks: F.aggregate(chunks, F.array(F.lit(0)), lambda acc, chunk: F.concat(acc, F.array(F.element_at(acc, -1) + length(chunk))))
        return bound(in_chunks(parts), lambda c: bound(starts(c), lambda at: F.flatten(F.transform(c, lambda chunk, i: of_chunk(chunk, F.get(at, i))))))

    return bound(parts, lambda p: F.when(F.size(p) <= _CHUNK, of_chunk(p, F.lit(0))).otherwise(chunked(p)))


def in_chunks(values: Column) -> Column:
    """The values of an array that isn't empty, cut into arrays of _CHUNK."""
    return F.transform(F.sequence(F.lit(1), F.size(values), F.lit(_CHUNK)), lambda k: F.slice(values, k, _CHUNK))


def matches(text: Column, pattern: str, needs: str | None) -> Column:
    """All leftmost matches with their places."""
    none = F.array().cast(_SPAN)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs:
        found = F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast("array<string>"))
    return bound(found, lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m, F.split(text, pattern, -1))))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when((n - i) % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def passes(kind: str, v: Column) -> Column:
    """The base kind's own test of a match."""
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda part: F.regexp_replace(part, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(digits(v))
    if kind == "phone":
        return F.length(digits(v)).between(8, 15)
    return F.lit(True)


def gazetteer(kind: str, v: Column) -> Column:
    vote = lambda test: F.when(test, 1).otherwise(-1)
    if kind == "email":
        return vote(F.lower(F.regexp_extract(v, r"([A-Za-z]+)$", 1)).isin(DOMAINS.split()))
    if kind == "phone":
        d = digits(v)
        return vote(F.substring(d, 1, 1).isin(CALLING.split()) | F.substring(d, 1, 2).isin(CALLING.split()) | ~v.startswith("+"))
    if kind == "card":
        return vote(digits(v).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"))
    if kind == "ip":
        return vote(~v.rlike(r"^0+\."))
    return F.lit(0)


def around(c: Column) -> Column:
    return F.when(c == "", "edge").when(c.rlike(r"^\s$"), "blank").when(c.rlike("^[0-9]$"), "digit").when(c.rlike(r"^[.,;:!?]$"), "stop").when(c.rlike(r"^[\x21-\x7E]$") & ~c.rlike("^[A-Za-z]$"), "mark").otherwise("letter")


def described(kind: str, spans: Column, base: bool) -> Column:
    """Proposals with their votes and features."""

    def one(x: Column) -> Column:
        v, before = x["v"], F.lower(x["before"])
        good = passes(kind, v) if base else F.lit(False)
        different = F.size(F.array_distinct(F.split(digits(v), "")))
        votes = [
            F.when(good, 1).otherwise(-1) if base else F.lit(0),
            gazetteer(kind, v),
            F.when((F.lower(v) if kind == "secret" else before).rlike(CUES[kind]), 1).otherwise(0),
            F.when(before.rlike(AGAINST), -1).otherwise(0),
            F.when(different > 3, 1).when(F.length(digits(v)) > 5, -1).otherwise(0),
        ]
        features = [
            F.concat(F.lit(f"{kind}{'' if base else '~'}:"), F.least(F.length(v) / 6, F.lit(8)).cast("int").cast("string")),
            F.concat(F.lit("before:"), around(F.right(x["before"], F.lit(1)))),
            F.concat(F.lit("after:"), around(x["after"])),
            F.concat(F.lit("digits:"), F.least(different, F.lit(8)).cast("string")),
        ]
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), good.alias("base"), F.array(*votes).alias("votes"), F.array(*features).alias("features"))

    return F.transform(spans, one)


def proposals(text: Column) -> Column:
    """All proposed spans of a text. A match that fails its base test is a proposal still, but no base span."""
    text = F.coalesce(text, F.lit(""))
    parts = [described(kind, matches(text, *PATTERNS[kind]), True) for kind in PATTERNS]
    parts += [described(kind, matches(text, *LOOSE[kind]), False) for kind in LOOSE]
    return bound(F.concat(*parts), without_overlaps)


def without_overlaps(proposed: Column) -> Column:
    """The base spans, and the proposals that overlap none of them; many are compared by chunks of neighbours."""
    meets = lambda x, y: (y["s"] < x["e"]) & (x["s"] < y["e"])

    def among(base: Column) -> Column:
        chunks = F.transform(in_chunks(base), lambda c: F.struct(F.get(c, F.lit(0))["s"].alias("s"), F.array_max(F.transform(c, lambda y: y["e"])).alias("e"), c.alias("own")))
        near = lambda c: F.filter(proposed, lambda x: x["base"] | ~F.exists(c, lambda chunk: meets(x, chunk) & F.exists(chunk["own"], lambda y: meets(x, y))))
        one_by_one = F.filter(proposed, lambda x: x["base"] | ~F.exists(base, lambda y: meets(x, y)))
        return F.when(F.size(base) == 0, proposed).when(F.size(base) <= _CHUNK, one_by_one).otherwise(bound(chunks, near))

    return bound(F.array_sort(F.transform(F.filter(proposed, lambda x: x["base"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))), among)


class SpanModel:
    """Log-odds of span features, learned from votes."""

    def __init__(self, prior: float = -1.0, weights: dict[str, float] | None = None, reliability: dict[tuple[int, int], tuple[float, float]] | None = None):
        self.prior, self.weights, self.reliability = prior, weights or {}, reliability or {}

    def odds(self, features: Column) -> Column:
        if not self.weights:
            return F.lit(self.prior)
        known = F.create_map(*[F.lit(x) for pair in sorted(self.weights.items()) for x in pair])
        return F.aggregate(features, F.lit(self.prior), lambda total, f: total + F.coalesce(known[f], F.lit(0.0)))


def train(counts: list[tuple[int, tuple[int, ...], tuple[str, ...], int]], rounds: int = 40) -> SpanModel:
    """counts: kind, votes, features and number of proposals. Votes are taken as independent given the truth."""
    if not counts:
        return SpanModel()
    likely = {(k, v): min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for k, v, _, _ in counts}
    total = defaultdict(int)
    for k, v, _, n in counts:
        total[k, v] += n
    rates, priors = {}, {}
    for _ in range(rounds):
        seen, yes, of_kind = defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: [1.0, 1.0])
        for (k, v), n in total.items():
            p = likely[k, v]
            of_kind[k][0] += n * (1 - p)
            of_kind[k][1] += n * p
            for i, vote in enumerate(v):
                for y, q in ((0, 1 - p), (1, p)):
                    yes[i, vote][y] += n * q
                    seen[i][y] += n * q
        # Starting each labeler slightly better than chance keeps the two classes from changing places.
        rates = {(i, vote): tuple((c[y] + (2.0 if (vote > 0) == (y == 1) and vote else 0.0)) / (seen[i][y] + 4) for y in (0, 1)) for (i, vote), c in yes.items()}
        priors = {k: c[1] / sum(c) for k, c in of_kind.items()}
        for k, v in total:
            odds = math.log(priors[k] / (1 - priors[k])) + sum(math.log(rates[i, vote][1] / rates[i, vote][0]) for i, vote in enumerate(v))
            likely[k, v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    mass, all_of = defaultdict(lambda: [0.5, 0.5]), [1.0, 1.0]
    for k, v, features, n in counts:
        for y, q in ((0, 1 - likely[k, v]), (1, likely[k, v])):
            all_of[y] += n * q
            for f in features:
                mass[f][y] += n * q
    weights = {f: math.log(m[1] / all_of[1]) - math.log(m[0] / all_of[0]) for f, m in mass.items()}
    return SpanModel(math.log(all_of[1] / all_of[0]), weights, rates)


def fit(proposed: DataFrame, column: str = "proposed") -> SpanModel:
    """A model of the proposals in a column of all rows. The count table is bounded by kinds, votes and features."""
    each = proposed.select(F.explode(column).alias("x"))
    counts = each.groupBy("x.k", "x.votes", "x.features").count().collect()
    return train(sorted((r[0], tuple(r[1]), tuple(r[2]), r[3]) for r in counts))


def kept(proposed: Column, model: SpanModel) -> Column:
    """The spans that stay, by kind and then start."""
    return F.array_sort(F.transform(F.filter(proposed, lambda x: x["base"] | (model.odds(x["features"]) >= 0)), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"))))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping ones, replaced by its kind in angle brackets.

    Spans are taken by chunks, each of which cuts its own stretch of the text once.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def walked(stretch: Column, chunk: Column, begin: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            out = F.concat(acc["out"], F.substring(stretch, acc["at"] - begin + 1, x["s"] - acc["at"]), F.get(names, x["k"]))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], out).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(begin.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def whole(chunks: Column) -> Column:
        last = lambda chunk: F.array_max(F.transform(chunk, lambda x: x["e"]))
        ends = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, chunk: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), last(chunk)))))

        def pieces(ends: Column) -> Column:
            stretch = lambda i: F.substring(text, F.get(ends, i) + 1, F.get(ends, i + 1) - F.get(ends, i))
            parts = F.transform(chunks, lambda chunk, i: bound(stretch(i), lambda own: walked(own, chunk, F.get(ends, i))))
            return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

        return bound(ends, pieces)

    by_place = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    return F.when(F.size(spans) > 0, bound(by_place, lambda own: bound(in_chunks(own), whole))).otherwise(text)


def op2(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of all documents."""
    proposed = settle(docs.select("doc_id", proposals(F.col("text")).alias("proposed")))
    model = fit(proposed)
    found = proposed.select("doc_id", kept(F.col("proposed"), model).alias("spans"))
    base = F.filter("spans", lambda x: x["base"])
    of_kind = lambda i: F.filter("spans", lambda x: x["base"] & (x["k"] == i))
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
