"""Operators that learn, against held-out accuracy or brute force, and their defined results."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard as zs
from pyspark.sql import functions as F

from ripplegraph.llm import hmm, langid, quality, toxicity

SYLLABLES = {"en": "the ing tion and ou th", "de": "sch ung keit der ich ß", "fr": "eau oi é ment le que", "es": "ción ado ñ os la ez"}


def prose(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def table(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("score", "quality", "toxicity", "lang_pred", "y", "_n", "token"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def out(i, mod, held):
    return (zlib.crc32(("" if i is None else str(i)).encode()) % mod == held)


ODD = [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 -- 456", "en", "s"), (903, "the " * 100_000, None, "s"), (904, "ÉÉ", None, None), (None, "the and the", "en", "s"), (905, "a", None, "s"), (905, "a", None, "s")]


def test_languages(spark):
    rows = [(i, prose(lang := "en de fr es".split()[i % 4], i, 60), lang, "s") for i in range(240)] + ODD
    found = langid.op1(table(spark, rows)).collect()
    assert len(found) == len(rows)
    true = {i: lang for i, _, lang, _ in rows if i is not None}
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert held and sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == out(r.doc_id, 5, 0) for r in found) and all(0 <= r.score <= 1 for r in found)
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert und == {900, 901, 902} and all(r.score == 0 for r in found if r.lang_pred == "und")


def test_languages_of_little(spark):
    assert langid.op1(table(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.op1(table(spark, [(1, "the", None, "s")])).collect()} == {"und"}
    one = [(i, "the and", "xx", "s") for i in range(10)]
    assert {(r.lang_pred, r.score) for r in langid.op1(table(spark, one)).collect()} == {("xx", 1.0)}


def test_margin_of_a_long_text_is_that_of_its_pieces():
    model = langid.Hierarchy({lang: np.stack([_dense(prose(lang, i, 50)) for i in range(20)]) for lang in SYLLABLES})
    long, short = prose("fr", 1, 400_000), prose("fr", 1, 50)
    assert model.predict(pa.array([long, short, None, ""]))[0] == ["fr", "fr", "und", "und"]


def _dense(t):
    (at, share), row = langid.shares(pa.array([t]))[0], np.zeros(langid.BUCKETS, np.float32)
    row[at] = share
    return row


def quality_case():
    rows, labels = [], []
    for i in range(300):
        good = i % 4 > 0
        t = prose("en", i, 80)
        if not good:
            t = " ".join(w + "$$$" for w in t.split()) if i % 8 else "\n".join(["the same line again"] * 30)
        rows.append((i, t, "en", "s"))
        labels.append((i, int(good), int(i % 3 == 0)))
    return rows + ODD, labels + [(900, None, None), (None, 1, 1), (5, 7, 7)]


def test_quality(spark):
    rows, labels = quality_case()
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    found = quality.op5(table(spark, rows), df).collect()
    assert len(found) == len(rows) and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found)
    true = {i: q for i, q, _ in labels}
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert all(r.held_out == out(r.doc_id, 3, 1) for r in found)
    assert held and sum(r.predicted == true[r.doc_id] for r in held) >= 0.97 * len(held)


def test_scores_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = table(spark, ODD)
    for op in (quality.op5, toxicity.op8):
        assert {r.score for r in op(rows, none).collect()} == {0.5}
        assert op(rows.limit(0), none).count() == 0
        ones = spark.createDataFrame([(i, 1, 1) for i in range(900, 906)], "doc_id long, quality int, toxic int")
        assert all(r.score > 0.5 for r in op(rows, ones).collect())


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (4000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.Additive(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert {(i, j) for i, j, *_ in model.pairs} >= {(0, 1)}


def test_features_by_hand():
    t = "Ab ab AB!\nx | 12\nx | 12"
    f = dict(zip(quality.FEATURES, quality.features(pa.array([None, t, ""]))[1]))
    assert f["words"] == np.float32(math.log(10)) and np.isclose(f["distinct"], 6 / 9) and np.isclose(f["line_repeats"], 1 / 3)
    assert np.isclose(f["upper"], 3 / 8) and np.isclose(f["top_word"], 2 / 9) and np.isclose(f["echo"], 0) and np.isclose(f["phrase_repeats"], 1 / 7)
    assert not quality.features(pa.array([None, ""])).any()


def test_toxicity(spark):
    rows, labels, bad = [], [], "worthless idiot clown pathetic loser".split()
    for i in range(600):
        ws, rng = prose("en", i, 70).split(), random.Random(i)
        if i % 4 == 0:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        rows.append((i, " ".join(ws), "en", "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    df = spark.createDataFrame([*labels, (900, None, None)], "doc_id long, quality int, toxic int")
    found = toxicity.op8(table(spark, rows + ODD), df).collect()
    assert len(found) == len(rows) + len(ODD) and all(r.held_out == out(r.doc_id, 5, 0) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)


def likelihood_by_hand(model, classes):
    """Summed over all state sequences."""
    a = model.start * model.emit[classes[0]]
    for c in classes[1:]:
        a = (a @ model.move) * model.emit[c]
    return math.log10(a.sum())


def test_forward_and_expected_counts_are_exact():
    rng = np.random.default_rng(4)
    model = hmm.Model.rough(rng.dirichlet(np.ones(9)), 3)
    sequences = [rng.integers(0, 9, n).astype(np.int32) for n in (5, 1, 7, 5, 2)]
    flat, at, order = hmm.packed(sequences)
    got = np.empty(5)
    got[order] = hmm.forward(model, flat, at)[0]
    assert np.allclose(got, [likelihood_by_hand(model, s) for s in sequences])
    start, move, emit = hmm.expected(model, sequences)
    assert np.isclose(start.sum(), 5) and np.isclose(move.sum(), 15) and np.allclose(emit.sum(1), np.bincount(np.concatenate(sequences), minlength=9))
    # Against all paths of one short sequence.
    import itertools

    s, total, by = sequences[0][:3], 0.0, np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=3):
        p = model.start[path[0]] * np.prod([model.emit[c, k] for c, k in zip(s, path)]) * np.prod([model.move[a, b] for a, b in zip(path, path[1:])])
        total += p
        for a, b in zip(path, path[1:]):
            by[a, b] += p
    assert np.allclose(hmm.expected(model, [s])[1], by / total)


def test_training_does_not_lower_the_likelihood():
    rng = np.random.default_rng(8)
    sequences = [np.concatenate([rng.integers(0, 4, 20), rng.integers(4, 8, 20)]).astype(np.int32) for _ in range(60)]
    prior = np.full(8, 1 / 8)
    model, last = hmm.Model.rough(prior, 2), -math.inf
    for _ in range(10):
        flat, at, _ = hmm.packed(sequences)
        now = hmm.forward(model, flat, at)[0].sum()
        assert now > last - 1e-6
        model, last = hmm.Model.from_counts(*hmm.expected(model, sequences), prior, strength=1e-3), now
    assert last / 2400 > math.log10(1 / 8) + 0.2


def test_language_model(spark):
    rows = [(i, prose("en de".split()[i % 2], i, 40).upper(), "en", "s") for i in range(60)] + ODD
    df = table(spark, rows).select("doc_id", "text")
    words = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split() + ["\n"]
    c = Counter(w for i, t, *_ in rows if not out(i, 5, 1) for w in words(t))
    n, v = sum(c.values()), len(c)
    counts, lex, model = hmm.language_model(df, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1, near=20, own=8, states=3, most=20)
    found = hmm.scored(df, counts, lex, model).collect()
    assert lex.total == n and lex.kinds == v
    want = sorted((-1 if i is None else i, len(words(t)), sum(c[w] > 0 for w in words(t)), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 4)) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in found) == want
    for r in found:
        t = next(t for i, t, *_ in rows if i == r.doc_id)
        if r.n_tokens < 100:
            tokens = hmm.tokens_of(t)
            shapes = [(hmm.shape(w.encode()), k) for w, k in c.items() if w.encode() not in lex.classes]
            within = sum(math.log10((c[w.decode()] + 0.5) / (sum(k for s, k in shapes if s == hmm.shape(w)) + 0.5 * (sum(s == hmm.shape(w) for s, _ in shapes) + 1))) for w in tokens if w not in lex.classes)
            assert math.isclose(r.score, likelihood_by_hand(model, lex.encode(tokens)) + within, abs_tol=1e-4)


def test_language_model_of_nothing(spark):
    assert hmm.op7(table(spark, [])).count() == 0
    r = hmm.op7(table(spark, [(i, "x", "en", "s") for i in range(40) if out(i, 5, 1)])).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0


@pytest.mark.parametrize("near, most", [(2, 40), (2, 5)])
def test_the_end_keeps_its_count_below_the_bound(spark, near, most):
    rows = [(f"w{i}".encode(), most) for i in range(6)] + [(hmm.END, 5)]
    lex = hmm.lexicon(spark.createDataFrame(rows, "token binary, c bigint"), near=near, own=4)
    assert lex.count[lex.ids[hmm.END]] == 5 and lex.total == 6 * most + 5
    assert (lex.shape_kinds >= 0).all() and lex.shape_total.sum() == lex.total - lex.count[lex.class_of < lex.first_shape].sum()


def test_dictionaries_learn_of_all_texts_and_of_whole_words():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(7)) for _ in range(3000)]
    first = [[rng.choice(words) for _ in range(16 * 60_000)]]
    later = [[rng.choice(b"zyxwvuts rqponmlk".split() + words[:40]) for _ in range(40_000)]]  # behind 60,000 pieces of the first
    assert b"zyxwvuts" in toxicity.ordinary_dictionary(first + later, 4096)
    far = [b"a" * 80 + b"vilemark"]
    toxic = [far + [rng.choice(words) for _ in range(8)] for _ in range(600)]
    assert b"vilemark" in toxicity.toxic_dictionary(toxic, [[b"a" * 80 + b"kindly", rng.choice(words)] for _ in range(600)], 2000)


def test_windows_are_compressed_as_by_plain_calls():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad = b"wretched scoundrel".split()
    ordinary = [[rng.choice(words) for _ in range(60)] for _ in range(300)]
    toxic = [[rng.choice(words + bad * 20) for _ in range(60)] for _ in range(300)]
    own = toxicity.Distance(toxicity.ordinary_dictionary(ordinary, 4096), toxicity.toxic_dictionary(toxic, ordinary, 512), 2)
    own.open()
    assert own.ordinary.startswith(toxicity.MAGIC) and own.toxic.startswith(toxicity.MAGIC)
    parameters = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_LAZY, min_match=4, search_log=6, target_length=64, hash_log=14, chain_log=14, window_log=17, write_checksum=0, write_content_size=0, write_dict_id=0)
    both = [zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_FULLDICT), compression_params=parameters) for d in (own.ordinary, own.ordinary + own.toxic)]
    saved = []
    for ws in toxic[:5] + ordinary[:5]:
        plain = []
        for i in range(0, len(ws), 2):
            data = own.ordinary[-64:] + b" " + b" ".join(ws[i : i + 2]) + b" "
            plain.append(len(both[0].compress(data)) - len(both[1].compress(data)))
        assert plain == [own.saved(b" ".join(ws[i : i + 2])) for i in range(0, len(ws), 2)]
        f = own.features(b" ".join(ws).decode())
        assert f[0] == max(plain) and np.isclose(f[2], math.log1p(sum(v >= toxicity.STEPS[0] for v in plain)))
        saved.append(sum(plain))
    assert min(saved[:5]) > max(saved[5:])


def test_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 60)] + [(2, 1, 1), (2, 1, 1), (None, 1, 1), (3, 7, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.learned(docs, labels, F.lit(True), 10, 1 << 20)
    assert sorted(r[1] for r in rows) == [0] * 10 + [1] * 10 and len({(r[3], r[1]) for r in rows}) == 20
    few = toxicity.learned(docs, labels, F.lit(True), 1000, 100)
    assert 0 < sum(len(r[2]) for r in few) <= 100 and {r[1] for r in toxicity.learned(docs, labels, F.col("doc_id") == 2, 9, 100)} == {0, 1}
    assert len(quality.labelled(docs, labels, "quality", F.lit(True), 1000).groupBy("doc_id", "y").count().collect()) == 60


def test_scores_are_sums_of_the_tables():
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (800, 4))
    model = quality.Additive(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float), rounds=20, pair_rounds=20, pairs=2)
    assert model.pairs
    for row, got in zip(x[:50], model.score(x[:50])):
        f = model.base
        for j, (cuts, values) in enumerate(model.singles):
            f += values[sum(row[j] >= c for c in cuts)]
        for i, j, a, b, values in model.pairs:
            f += values[sum(row[i] >= c for c in a)][sum(row[j] >= c for c in b)]
        assert abs(got - 1 / (1 + math.exp(-f))) < 1e-12
