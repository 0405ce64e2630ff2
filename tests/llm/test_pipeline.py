"""The pipeline's stages on small tables with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["the", "ing", "and", "tion", "ou", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, prose(i), "en", f"src{i % 3}") for i in range(120)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in prose(5000 + i).split()), "en", "src0") for i in range(60)]
    copies = [(2000 + i, prose(3), "en", "src1") for i in range(5)] + [(2100, None, None, None), (2101, "", "en", None), (7, prose(7), "en", "src1")]
    item = prose(777, 40)
    leaks = [(3000 + i, f"{prose(6000 + i)} {item} {prose(7000 + i)}", "en", "src2") for i in range(4)]
    private = [(4000 + i, f"{prose(8000 + i)} write to name{i}@mail.com {prose(9000 + i)}", "en", "src2") for i in range(6)]
    docs = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows + junk + copies + leaks + private]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, prose(888, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 1000 or i >= 2000), 0) for i, *_ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids, columns = {}, docs.columns
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        assert name == "mixing" or out.columns == columns
        path = f"{folder}/out-{name.replace(' ', '-')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert not any(1000 <= i < 2000 for i in ids["quality"]) and set(range(120)) <= set(ids["quality"])
    near = ids["near duplicates"]
    assert len(near) == len(set(near)) and set(range(120)) <= set(near) and not any(2000 <= i < 2100 for i in near)
    assert not any(3000 <= i < 4000 for i in ids["decontamination"]) and set(range(120)) <= set(ids["decontamination"])
    private = spark.read.parquet(f"{folder}/out-personal-data")
    texts = [r.text for r in private.where("doc_id >= 4000").collect()]
    assert len(texts) == 6 and all("<EMAIL>" in t and "@" not in t for t in texts)
    assert private.where("doc_id < 120").join(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id", "text", "n_chars"]).count() >= 120
    assert sorted(ids["mixing"]) == sorted(ids["personal data"])


def test_run_and_empty_documents(spark, folder, tmp_path):
    assert cp.run(spark, folder).where("taken > 0").count() > 100
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, folder).count() == 0


def similarity(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def edited(text, at):
    words = text.split()
    return " ".join("edited" if i in at else w for i, w in enumerate(words))


def test_near_copies_leave_one_text(spark, folder):
    base = {i: prose(100_000 + i) for i in range(30)}
    texts = {10 * i: t for i, t in base.items()}
    texts |= {10 * i + 1: edited(t, {40}) for i, t in base.items()}  # one word amid 80: 71 of 81 shingles stay
    texts |= {10 * i + 2: edited(t, {0, 79}) for i, t in base.items()}
    texts |= {10 * i + 3: edited(t, {20, 40, 60}) for i, t in base.items()}  # below 0.8 of any other: stays
    assert all(similarity(t, texts[10 * i + k]) >= 0.8 for i, t in base.items() for k in (1, 2))
    assert all(similarity(texts[10 * i + k], texts[10 * i + 3]) < 0.8 for i in base for k in range(3))
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts.items()], COLUMNS)
    kept = sorted(r.doc_id for r in cp.one_of_each_group(spark, docs, folder).collect())
    assert kept == sorted(10 * i + k for i in base for k in (0, 3))


def test_a_band_of_chains_is_linked_as_by_brute_force():
    import numpy as np

    from ripplegraph.llm import near

    rng = random.Random(5)
    for _ in range(40):
        pool = list(range(60))
        sets = [np.array(sorted(rng.sample(pool[k : k + 24], 20)), np.uint64) for k in (rng.choice((0, 3, 30)) for _ in range(30))]
        own = lambda pairs: {frozenset(g) for g in groups(len(sets), pairs)}
        pairs = [(i, j) for i in range(30) for j in range(i) if len(set(sets[i]) & set(sets[j])) * 5 >= 4 * len(set(sets[i]) | set(sets[j]))]
        assert own(near.linked(sets)) == own(pairs)


@pytest.mark.parametrize("block_sets, block_shingles", [(1024, 1 << 21), (4, 1 << 21), (1024, 60)])
def test_groups_cut_into_blocks_are_linked_as_by_brute_force(spark, block_sets, block_shingles):
    from ripplegraph.llm import near

    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):  # chains along a long text: neighbours alike, ends not
        at = rng.choice((0, 100, 200)) + rng.randint(0, 12)
        texts.append(" ".join(words[at : at + 44]))
    texts += [" ".join(words[k : k + 44]) for k in (300, 303, 306, 340)]
    texts = list(dict.fromkeys(texts))
    rows = [(i, t) for i, t in enumerate(texts)]
    keys = [(i, key, 40) for i in range(len(texts)) for key in (7, 8 + i % 2)]  # one group of all, and two
    roots = near.searched(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(keys, "id long, key long, size long"), block_sets, block_shingles)
    found = {r.node: r.root for r in roots.collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    want = {frozenset(g) for g in groups(len(texts), pairs)}
    assert {frozenset(j for j in range(len(texts)) if found.get(j, j) == r) for r in {found.get(i, i) for i in range(len(texts))}} == want
    assert 1 < len(want) < len(texts)


def groups(n, pairs):
    of = [{i} for i in range(n)]
    for i, j in pairs:
        if of[i] is not of[j]:
            of[i] |= of[j]
            for k in of[j]:
                of[k] = of[i]
    return of


def test_null_and_repeated_ids_keep_a_row_of_each_group(spark, folder):
    rows = [(None, prose(300 + i)) for i in range(20)] + [(5, prose(400 + i)) for i in range(20)]
    rows += [(9, prose(500)), (8, prose(500)), (None, prose(500)), (8, prose(500)), (None, prose(300))]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], COLUMNS)
    kept = [(r.doc_id, r.text) for r in cp.one_of_each_group(spark, docs, folder).collect()]
    assert len(kept) == 41 and {t for _, t in kept} == {t for _, t in rows}
    assert [i for i, t in kept if t == prose(500)] == [8] and sum(i is None for i, _ in kept) == 20


def test_mixing_is_range_sorted_by_position(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.position is None, r.position or 0.0) for r in cp.mixed(spark, docs, folder).collect()]
    assert rows == sorted(rows) and len(rows) == docs.count()


CLASHES = "quality toxicity items hit_words n_words size target taken position passes source_size _row _root _set _bands _proposed _spans id key other5 a.b".split()


def test_columns_of_any_name_and_odd_rows(spark, folder):
    rows = [(i, prose(i)) for i in range(40)] + [(None, prose(900)), (None, prose(901)), (3, prose(902)), (3, prose(3)), (50, None), (51, ""), (52, " \n"), (None, None), (53, prose(903, 60_000))]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], COLUMNS)
    docs = docs.withColumns({c: F.col("doc_id") for c in CLASHES})
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/odd-{name.replace(' ', '-')}"
        out.write.option("compression", "none").parquet(path)
        back = spark.read.parquet(path)
        if name != "mixing":
            assert out.columns == docs.columns
            docs = back if name != "quality" else docs
        assert all(r["a.b"] == r.doc_id for r in back.select("doc_id", "`a.b`").collect())
    kept = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(kept) == 44 + 1 and {(None, prose(900)), (None, prose(901)), (3, prose(902)), (3, prose(3))} <= set(kept)


def test_reruns_agree(spark, folder):
    once, again = (sorted(map(str, cp.run(spark, folder).collect())) for _ in range(2))
    assert once == again
