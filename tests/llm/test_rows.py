"""Personal data, mixing, quotations and the pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ripplegraph.llm import mixing, pii, quotes

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def by_hand(t):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if passes(k, m.group())] for k, p in PATTERNS]


def strange_texts():
    rng = random.Random(11)
    fixed = ["a@b.c_d@e.f", "x@y.z.@w.q", "1.2.3.4.5.6.7.8", "300.1.1.1 0255.1.1.1 1.2.3.256", "4111 1111 1111 1111", "4111-1111-1111-1111 1", "4111  1111 1111 1111", "+1 (555) 123-4567x +12 +1-2", "é😀 +49 30 1234567 😀 a@b.co", "4111111111111111 5500005555555559", "12345678901234567890123", "mail a(at)b(dot)com token = \"24be64439e3e49cf46b2\"", "1-2 3-4 5", "@@a@b@c.d", "++1 23 45678 9"]
    alphabet = "0123456789" * 3 + " -.+@ab_()%\né"
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300)] + ["a@b.co 4111111111111111 " * 3000, "1" * 50_000 + "@", "a" * 100_000]


def test_spans_are_brute_force(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(strange_texts())] + [(1000, None, "x", "y"), (1001, "", "x", "y"), (5, "a@b.co", "x", "y"), (None, "a@b.co", "x", "y")]
    found = pii.op2(spark.createDataFrame(rows, "doc_id long, text string, spans string, proposed string")).collect()
    want = sorted((-1 if i is None else i, *map(len, s := by_hand(t)), hashlib.sha256(",".join(sum(s, [])).encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == want
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    for r in found:
        assert any(set(sum(by_hand(t), [])) <= set(r.spans.split(",")) for t in texts[r.doc_id] if r.spans or True) or not r.spans
    assert pii.op2(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_votes_find_more_than_the_base(spark):
    rows = [(i, f"write to me{i}@mail.com or password = Xy{i}9aBcD3eF") for i in range(50)] + [(100 + i, f"order 4{i:03d} 1111 1111 1112") for i in range(50)]
    found = {r.doc_id: r.spans for r in pii.op2(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("secret:" in found[i] for i in range(50)) and not any("card" in found[100 + i] for i in range(50) if not by_hand(rows[50 + i][1])[2])


def test_reliability_of_a_good_and_a_bad_labeler():
    counts = [(0, (1, 1, 0, 0, 1), ("a",), 500), (0, (-1, -1, 0, -1, 0), ("b",), 500), (0, (1, -1, 0, 0, 1), ("a",), 50), (0, (-1, 1, 0, -1, 0), ("b",), 50)]
    model = pii.train(counts)
    assert model.weights["a"] > 1 and model.weights["b"] < -1
    assert model.reliability[0, 1][1] > model.reliability[1, 1][1] > model.reliability[1, 1][0]


def test_redaction(spark):
    t = "😀 a@b.co and 4111 1111 1111 1111, bye"
    df = spark.createDataFrame([(t,), ("none",), (None,)], "text string").withColumn("s", pii.kept(pii.proposals(F.col("text")), pii.SpanModel()))
    assert [r[0] for r in df.select(pii.redacted(F.col("text"), F.col("s"))).collect()] == ["😀 <EMAIL> and <CARD>, bye", "none", None]


def test_redaction_of_many_spans(spark):
    t = "".join(f"{'é' * (i % 3)} a{i}@b.co, 4111 1111 1111 1111; " for i in range(700))
    df = spark.createDataFrame([(t,)], "text string").withColumn("s", pii.kept(pii.proposals(F.col("text")), pii.SpanModel()))
    got, spans = df.select(pii.redacted(F.col("text"), F.col("s")), "s").first()
    assert got == re.sub(r"a\d+@b\.co", "<EMAIL>", t).replace("4111 1111 1111 1111", "<CARD>")
    assert all(re.fullmatch(r"a\d+@b\.co|4111 1111 1111 1111", t[x.s : x.e]) for x in spans) and len(spans) == 1400


def test_proposals_over_base_spans_go_as_by_brute_force(spark):
    rng = random.Random(9)
    spans = sorted({(s := rng.randrange(3000), s + rng.randint(1, 6), rng.random() < 0.4) for _ in range(900)})
    df = spark.createDataFrame([([(s, e, b) for s, e, b in spans],), ([(1, 3, False)],), ([],)], "p array<struct<s:int,e:int,base:boolean>>")
    want = [x for x in spans if x[2] or not any(y[2] and y[0] < x[1] and x[0] < y[1] for y in spans)]
    got = [[tuple(x) for x in r[0]] for r in df.select(pii.without_overlaps(F.col("p"))).collect()]
    assert got == [want, [(1, 3, False)], []] and sum(x[2] for x in spans) > pii._CHUNK


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = sum(w for s, w in weight.items() if s not in capped)
        level = (full - sum(2 * sizes[s] for s in capped)) / rest if rest else 0
        more = {s for s in names if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= more


@pytest.mark.parametrize("slices", [4096, 3])
def test_mix(spark, monkeypatch, slices):
    monkeypatch.setattr(mixing, "SLICES", slices)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "é", "b", "hot", "hot", "hot", "Z", None])) for i in range(400)]
    rows += [(1, "x y", "a"), (1, "x y", "a"), (None, "n\x0bn\x1cn", "b"), (2, None, "b"), (3, "", "empty"), (4, None, "empty"), (5, "long " * 50_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("n", F.lit("y")).withColumn("target", F.lit("z"))
    found = mixing.curriculum(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])
    want = targets_by_hand(dict(sizes))
    assert len(found) == len(rows)
    for r in found:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    key = lambda r: (str(r.doc_id), r.size, r.taken, r.position or -1)
    assert sorted(map(key, mixing.curriculum(df.repartition(7)).collect())) == sorted(map(key, found))
    assert mixing.op6(df.limit(0)).count() == 0


def test_each_tenth_of_training_has_its_share_of_words(spark):
    rows = [(i, "w " * (1 + i % 7), s) for s, n in (("a", 3000), ("b", 3000), ("c", 3000)) for i in range(n)]
    mix = mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    each = mixing.schedule(mix).collect()
    assert [r.position for r in each] == sorted(r.position for r in each)
    for rank, source in enumerate("abc"):
        own, slope = [r for r in each if r.source == source], mixing.SLOPES[rank]
        target, size = own[0].target, own[0].source_size
        assert abs(sum(r.words for r in own) - target) <= 0.5 and all(r.taken <= 2 * r.size for r in own)
        if target > 1.5 * size:
            assert max(r.position for r in own) > 0.9  # a second pass has positions of its own
        for tenth in range(10):
            a, b = tenth / 10, (tenth + 1) / 10
            due = target * ((b + slope * (b * b - b)) - (a + slope * (a * a - a)))
            assert abs(sum(r.words for r in own if a <= r.position < b) - due) <= 20
    assert any(len(r.passes) == 2 for r in mix.collect())
    assert all(r.taken == sum(p.words for p in r.passes) and (r.position is None) == (not r.passes) for r in mix.collect())


def test_demand_is_inverted(spark):
    df = spark.range(11).select((F.col("id") / 10).alias("share"))
    for slope in (-0.6, 0.0, 0.6):
        t = df.select("share", mixing.demand_time(F.col("share"), F.lit(slope)).alias("t")).collect()
        assert all(abs(r.t + slope * (r.t**2 - r.t) - r.share) < 1e-9 for r in t)


MESSAGES = [
    (1, 0, "user", "Hello all.\nI think the plan is fine.\n\nSecond paragraph here."),
    (1, 1, "bob", "On Monday A wrote:\n> Hello all.\n> I think the plan is fine.\n\nI agree."),
    (1, 2, "eve", "On Tue bob wrote:\n> > I think the plan is fine.\n> I agree.\nNo way"),
    (1, 3, "x", "> No way\nreally?"), (1, 4, "y", "unrelated"), (1, 5, "z", "> Second   paragraph HERE.\r\nyes"),
    (2, 0, "a", None), (2, 1, "b", ""), (None, 1, "c", "> hi"), (2, None, "d", "> hello\nhey"), (3, 0, "e", "> later words\nhm"), (3, 1, "f", "later words"), (3, 1, "f", "later words"),
]


def test_quotations(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumn("body", F.lit("x")).withColumn("depth", F.lit("y"))
    found = sorted(quotes.linked(df).collect(), key=lambda r: (r.conv_id or 0, r.position))
    assert [(r.turn, r.parent_turn, r.root_turn, r.depth, r.body) for r in found if r.conv_id == 1] == [
        (0, None, 0, 0, "Hello all.\nI think the plan is fine.\n\nSecond paragraph here."), (1, 0, 0, 1, "I agree."), (2, 1, 0, 2, "No way"), (3, 2, 0, 3, "really?"), (5, 0, 0, 1, "yes"), (4, None, 4, 0, "unrelated"),
    ]
    assert [(r.turn, r.parent_turn, r.body) for r in found if r.conv_id == 3] == [(0, None, "hm"), (1, None, "later words"), (1, None, "later words")]
    assert len(found) == len(MESSAGES) and sorted(r.position for r in found if r.conv_id == 2) == [0, 1, 2]
    assert quotes.op10(df.limit(0)).count() == 0


def test_long_threads(spark):
    rows = [(7, i, "u", f"message {i}" if i == 0 else f"> message {i - 1}\nmessage {i}") for i in range(70)]
    found = quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.root_turn == 0 and r.depth == r.turn == r.position and r.body == f"message {r.turn}" for r in found)
