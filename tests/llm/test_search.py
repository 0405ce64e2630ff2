"""Operators on pairs and windows, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ripplegraph.llm import decontam, simhash, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, hit_words string, component_id string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z") for i, t in rows], DOCS)


def text(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(n))


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def hits_by_hand(document, items):
    words = WORD.findall(lower(document))
    hit, found = set(), set()
    for item_id, item in items:
        own = WORD.findall(lower(item))
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add("" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(found)


def contamination_case():
    items = [(1, text(1, 40)), (12, text(2, 14)), (2, text(3, 10)), (3, "Kurz und Klein"), (4, None), (5, ""), (6, "a a a a a a a a a a a a"), (None, text(9, 12)), (2, text(3, 10))]
    one, two = items[0][1].split(), items[1][1].split()
    rows = [
        (1, text(50, 30) + " " + " ".join(one[5:25]).upper() + "! " + text(51, 30)),
        (2, " ".join(one[:9]) + " " + text(52, 9)),
        (3, "..." .join(two) + " kurz, und -- klein " + items[2][1]),
        (4, None), (5, ""), (6, " \n\t"), (7, "a " * 500), (7, "a " * 500), (None, " ".join(two)),
        (8, text(53, 20000) + " " + items[7][1] + " " + text(54, 20000)), (9, "kurz und"),
    ]
    return items, rows


@pytest.mark.parametrize("block_mb", [32, 0.0002])
def test_decontamination_is_brute_force(spark, block_mb):
    items, rows = contamination_case()
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit("x"))
    found = decontam.contamination(docs(spark, rows).select("doc_id", "text"), benchmark, block_mb=block_mb)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, len(r.hit_words), sorted(set(r.items))) for r in found.collect())
    assert got == sorted((-1 if i is None else i, *hits_by_hand(t, items)) for i, t in rows)


def test_decontamination_digest_and_empty_tables(spark):
    items, rows = contamination_case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    r = decontam.op4(docs(spark, rows), benchmark).where("doc_id = 3").first()
    assert r.contaminated and r.items_sha256 == hashlib.sha256(",".join(hits_by_hand(rows[2][1], items)[2]).encode()).hexdigest()
    assert decontam.op4(docs(spark, rows), benchmark.limit(0)).where("contaminated").count() == 0
    assert decontam.op4(docs(spark, []), benchmark).count() == 0


def print_by_hand(t):
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower(t)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_is_brute_force(spark):
    base = text(7, 300).split()
    rows = [(1, text(1, 50)), (2, text(1, 50)), (2, text(1, 50)), (3, None), (4, ""), (5, "  "), (6, "one"), (7, "one two"), (8, "One TWO three É"), (None, text(1, 50)), (9, text(3, 50000))]
    for i in range(60):
        own = list(base)
        own[i * 4] = f"x{i}"
        if i % 3 == 0:
            own[i + 1] = "y"
        rows.append((100 - i, " ".join(own)))
    found = simhash.near_duplicates(docs(spark, rows)).collect()
    by_text = {t: print_by_hand(t) for _, t in rows}
    ids = [i for i, _ in rows]
    root = components_by_hand([by_text[t] for _, t in rows])
    least = {r: min(i for i, s in zip(ids, root) if s == r and i is not None) for r in root}
    want = sorted((-1 if i is None else i, by_text[t], least[r]) for (i, t), r in zip(rows, root))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})  # some are linked


def test_fingerprint_chain_is_one_component(spark):
    prints = [0]
    for bit in range(0, 64, 2):
        prints.append(prints[-1] | (3 << bit))
    rng = random.Random(5)
    prints += [rng.getrandbits(64) for _ in range(50)]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {roots.get(p[0], p[0]) for p in signed[:33]} == {min(p[0] for p in signed[:33])}
    assert all(p[0] not in roots for p in signed[33:])


@pytest.mark.parametrize("segments", [(19, 20, 25), (32, 32), (16, 16, 16, 16), (8,) * 8])
def test_every_pair_within_two_bits_is_linked(spark, segments):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), k)) for c in centres for k in (0, 1, 1, 2, 2, 3, 3, 4)} | {rng.getrandbits(64) for _ in range(60)}
    prints |= {centres[0] ^ (1 << a) ^ (1 << b) for a, b in ((0, 1), (0, 18), (18, 19), (38, 39), (0, 63), (39, 63), (20, 60))}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp long")
    want = {(a[0], b[0]) for a in signed for b in signed if a < b and bin((a[0] ^ b[0]) % (1 << 64)).count("1") <= 2}
    assert {tuple(r) for r in simhash.links(df, segments).collect()} == want and len(want) > 50
    asked = df.select(simhash.probes(F.col("fp"), segments).alias("p"), simhash.entries(F.col("fp"), segments).alias("e")).first()
    assert len(asked.e) == len(segments) and (segments != simhash.SEGMENTS or len(asked.p) + len(asked.e) < 65)


def test_one_fingerprint_of_most_rows(spark):
    rows = [(i, text(1, 50)) for i in range(400)] + [(1000 + i, text(20 + i, 50)) for i in range(20)] + [(None, text(1, 50))]
    found = simhash.op9(docs(spark, rows)).collect()
    assert len(found) == len(rows) and {r.component_id for r in found if r.doc_id is None or r.doc_id < 1000} == {0}


def test_simhash_of_nothing(spark):
    assert simhash.op9(docs(spark, [])).count() == 0


def best_by_hand(vectors, k=5):
    usable = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in usable:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 1024), (37, 3)])
def test_top_k_is_brute_force(spark, blocks):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(220)]
    vectors += [(300 + i, [0.25] * 8) for i in range(30)] + [(400, [0.25] * 8), (400, [0.25] * 8), (450, [0.0] * 8), (500, [1.0, 2.0]), (501, [float("nan"), 1.0]), (502, [float("inf"), 1.0]), (503, None), (504, [None, 1.0]), (None, [1.0] * 8), (550, [5.0]), (-50, [-0.5] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("q", F.lit("x")).withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(df, 5, 50, *blocks).collect())
    assert got == best_by_hand(vectors)


def test_top_k_of_nothing(spark):
    assert topk.op3(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
