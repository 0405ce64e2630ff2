"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts of equal shingle sets are one set before the search. Candidates are the sets of a SimHash component
(simhash.near_duplicates() over five-word shingles) and, because pairs at 0.8 differ in ten of 64 bits on
average, far beyond what a search of Hamming balls can list, the sets that agree in a band of a MinHash
signature. A pair at a similarity of exactly 0.8 agrees in none of the 30 bands of 5 with a probability of
(1 - 0.8^5)^30, about 7 in a million; pairs above are missed less often still. Component and bands are both
called groups here; groups of the same members are searched once.

Every candidate is checked by its complete sets. A group is dealt into blocks of bounded size, differently for
each group, and within a block neighbours are compared first and then each set outside the block's largest
component against all of the block. Across blocks, each set outside the group's largest component so far is
compared with the other blocks' sets. So no pair of different components stays unchecked, a tight group costs
little, and a group of any size needs a block's memory in a task; only links come out.

Defined results: null, empty and blank texts have the empty set and are one group. A text of fewer than five
words is one shingle. Case of A-Z doesn't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.base import by_batch, settle, small_batches
from ripplegraph.llm.simhash import components, near_duplicates
from ripplegraph.operators.lineage import scratch

SHINGLE, BANDS, ROWS = 5, 30, 5
#: Sets and shingles of one block, on average; a larger set is alone with few others.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 21
#: Shingles that are hashed at a time, so that a very long text needs no more memory.
STEP = 1 << 13
_random = np.random.default_rng(42)
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's different word shingles."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    n, line = max(1, len(words) - SHINGLE + 1), b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *(ends[: n - 1]).tolist()]
    stops = (ends[len(words) - n :] - 1).tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b]) for a, b in zip(begins, stops)), np.uint64, n))


def bands(own: np.ndarray) -> list[int]:
    """A key for each band of the set's signature."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), STEP):
        np.minimum(least, (own[i : i + STEP, None] * FACTORS + TERMS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(part.tobytes(), j) for j, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def alike(common: np.ndarray | int, a: np.ndarray | int, b: int) -> np.ndarray | bool:
    """Whether sets of sizes a and b with so many common members have a similarity of 0.8 or more, in whole numbers."""
    return 9 * common >= 4 * (a + b)


def similar(sets: list[np.ndarray], asked: list[int]) -> Iterator[tuple[int, list[int]]]:
    """For each place asked for, the places of all sets similar to its own, itself included."""
    n, size = len(sets), np.array([len(s) for s in sets])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(number, kind="stable")
    owner = np.repeat(np.arange(n), size)[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(number))])
    first = np.concatenate([[0], np.cumsum(size)])
    for i in asked:
        common = np.zeros(n, np.int64)
        own = number[first[i] : first[i + 1]]
        for k in range(0, len(own), 256):
            common += np.bincount(np.concatenate([owner[starts[t] : starts[t + 1]] for t in own[k : k + 256]]), minlength=n)
        yield i, np.flatnonzero(alike(common, size, size[i])).tolist()


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places of similar sets that connect all sets which similar ones connect."""
    n = len(sets)
    up, out = list(range(n)), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            up[a] = b
            out.append((i, j))

    for i in range(1, n):
        if alike(len(np.intersect1d(sets[i], sets[i - 1], assume_unique=True)), len(sets[i]), len(sets[i - 1])):
            join(i, i - 1)
    roots = [root(i) for i in range(n)]
    main = int(np.bincount(roots).argmax())
    rest = [i for i in range(n) if roots[i] != main]
    if n > 2 and rest:
        for i, found in similar(sets, rest):
            for j in found:
                join(i, j)
    return out


def crossed(asked: list[np.ndarray], held: list[np.ndarray], asked_roots: list[int], held_roots: list[int]) -> list[tuple[int, int]]:
    """Places of an asked and a held set that are similar and of different roots, one pair for each two roots."""
    n, out = len(asked), {}
    for i, found in similar(asked + held, list(range(n))):
        for j in found:
            if j >= n and asked_roots[i] != held_roots[j - n]:
                out.setdefault((asked_roots[i], held_roots[j - n]), (i, j - n))
    return list(out.values())


def _table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = [sorted(p) for p in pairs]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each run of equal first columns: what follows the keys, the last (a text) as its set."""
    last, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:-1]]
        for *values, text in zip(*columns, batch.columns[-1].cast(pa.binary()).to_pylist()):
            if values[:keys] != last:
                if rows:
                    yield rows
                last, rows = values[:keys], []
            rows.append((*values[keys:], shingles(text or b"")))
    if rows:
        yield rows


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, block, id, text by key and block: the links a < b inside each block."""
    for rows in _blocks(batches, 2):
        yield _table([(rows[i][0], rows[j][0]) for i, j in linked([r[-1] for r in rows])])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, block, other, held, id, root, text by the first three: links between sets asked for and held ones."""
    for rows in _blocks(batches, 3):
        asked, held = ([r for r in rows if r[0] == side] for side in (False, True))
        if asked and held:
            found = crossed([r[-1] for r in asked], [r[-1] for r in held], [r[2] for r in asked], [r[2] for r in held])
            yield _table([(asked[i][1], held[j][1]) for i, j in found])


def searched(texts: DataFrame, groups: DataFrame, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """node and root of all sets in reach of each other; texts: id, text; groups: id, key, size (of the set)."""
    sizes = groups.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.expr("bit_xor(xxhash64(id))").alias("x"))
    # A group of the same members as another has the same links.
    different = sizes.where("n > 1").groupBy("n", "shingles", "x").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("n") / block_sets), F.ceil(F.col("shingles") / block_shingles)).cast("int")
    different = settle(different.select("key", blocks.alias("blocks")))
    place = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int").alias("block")
    members = groups.select("id", "key").join(different, "key").select("id", "key", "blocks", place)
    of_id = members.groupBy("id").agg(F.collect_list(F.struct("key", "block")).alias("places"))
    dealt = texts.join(of_id, "id").select(F.explode("places").alias("p"), "id", "text").select("p.key", "p.block", "id", "text")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "id")
    links = settle(small_batches(dealt).mapInArrow(_within, "a bigint, b bigint").distinct())
    roots = settle(components(links))

    if different.where("blocks > 1").isEmpty():
        return roots
    split = members.where("blocks > 1").join(roots, F.col("id") == F.col("node"), "left").select("key", "block", "id", F.coalesce("root", "id").alias("root"))
    counted = split.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = counted.groupBy("key").agg(F.max(F.struct("n", "root")).root.alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main")
    split = settle(split.join(main, "key"))
    asking = split.where("root <> main").groupBy("key", F.col("block").alias("from")).agg(F.count("*").alias("_"))
    if asking.isEmpty():
        return roots
    # Each block's sets outside the main component go to the key's other blocks, whose sets are held there.
    others = split.select("key", "block").distinct()
    places = asking.select("key", "from").join(others.withColumnRenamed("block", "to"), "key").where("from <> to")
    columns = ["key", "from", "to", "held", "id", "root"]
    asked = split.where("root <> main").withColumnRenamed("block", "from").join(places, ["key", "from"]).withColumn("held", F.lit(False)).select(columns)
    held = split.withColumnRenamed("block", "to").join(places, ["key", "to"]).withColumn("held", F.lit(True)).select(columns)
    of_id = asked.unionByName(held).groupBy("id", "root").agg(F.collect_list(F.struct("key", "from", "to", "held")).alias("places"))
    dealt = texts.join(of_id, "id").select(F.explode("places").alias("p"), "id", "root", "text").select("p.*", "id", "root", "text")
    dealt = dealt.repartition("key", "from", "to").sortWithinPartitions("key", "from", "to", "held", "id")
    more = small_batches(dealt).mapInArrow(_across, "a bigint, b bigint").distinct()
    stars = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
    return settle(components(stars.unionByName(more)))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with _row, different for each row, and the table of _row and _root, the same for a group of near copies.

    The names of docs' columns must not begin with an underscore.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingles(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary())
        sizes = pa.array([len(s) for s in own], pa.int64())
        found = pa.array([bands(s) for s in own], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns, digests, sizes, found], [*batch.schema.names, "_set", "_size", "_bands"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = settle(by_batch(docs, work, f"{kinds}, _set binary, _size bigint, _bands array<bigint>").withColumn("_row", F.monotonically_increasing_id()))
    with scratch(docs.sparkSession) as keep:
        sets = settle(rows.groupBy("_set").agg(F.min("_row").alias("_id"), F.max("_size").alias("size")))
        close = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), shingle=SHINGLE)
        component = F.array(F.xxhash64("component_id", F.lit("component")))
        keys = rows.select(F.col("_row").alias("id"), F.col("_bands").alias("keys")).unionByName(close.select(F.col("doc_id").alias("id"), component.alias("keys")))
        own = sets.where("size > 0").select(F.col("_id").alias("id"), "size")  # texts without words are one set already
        groups = settle(keys.join(own, "id").select("id", "size", F.explode("keys").alias("key")))
        roots = searched(rows.select(F.col("_row").alias("id"), "text"), groups)
        of_set = sets.join(roots, sets._id == roots.node, "left").select("_set", F.coalesce("root", "_id").alias("_root"))
        of_row = keep(rows.select("_row", "_set").join(of_set, "_set").select("_row", "_root"))
    return rows.drop("_set", "_size", "_bands"), of_row
