"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments, and there is a table for each segment but one that it leaves free: its key
is a segment together with the others but the free one, which keep the rows of a common segment value apart. Of
two fingerprints within two bits at most two segments differ. Where both bits lie in one segment, the pair
shares the key of the table that leaves it free. Where they lie in two, the table that leaves the later one free
is asked for each member of the Hamming ball of radius 1 around the earlier one. Every match of a table is then
verified by its complete distance. So each fingerprint stands in a table once, asks for little more than the
bits of its segments (64 rows in all for segments of 19, 20 and 25 bits), and a key's fingerprints differ in its
free segment alone, however many copies or near copies there are.

Exact copies are one fingerprint before the search. Groups of linked fingerprints come from alternating
large-star and small-star steps over the links, written to the shared folder after each round.

Defined results: a null, empty or blank text has fingerprint zero, which links like any other. Repeated rows
get a row each. A null doc_id is no component id unless no other is there. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.base import by_batch, settle

BITS = 64
#: Widths of the segments, from the lowest bit; the last, whose bits are never asked for one by one, is the widest.
SEGMENTS = (19, 20, 25)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n, line = max(1, len(words) - shingle + 1), b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *(ends[: n - 1]).tolist()]
    stops = (ends[len(words) - n :] - 1).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(begins, stops)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """docs without the text, with fp long (the fingerprint's 64 bits)."""
    kept = [f for f in docs.schema.fields if f.name != text]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(t or b"", shingle) for t in batch.column(text).cast(pa.binary()).to_pylist()]
        columns = [batch.column(f.name) for f in kept]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.array(values, np.uint64).view(np.int64))], [*(f.name for f in kept), "fp"])

    return by_batch(docs, work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "fp bigint"]))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def masks(segments: tuple[int, ...]) -> list[int]:
    """The bits of each segment."""
    if sum(segments) != BITS or len(segments) < 2:
        raise ValueError(f"segments must be two or more and have {BITS} bits in all")
    return [((1 << n) - 1) << sum(segments[:j]) for j, n in enumerate(segments)]


def entries(fp: Column, segments: tuple[int, ...] = SEGMENTS) -> Column:
    """t and key: where a fingerprint stands, once in each table."""
    all_bits = (1 << BITS) - 1
    return F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(all_bits ^ own))).alias("key")) for t, own in enumerate(masks(segments))])


def probes(fp: Column, segments: tuple[int, ...] = SEGMENTS) -> Column:
    """t and key: what a fingerprint asks of each table, its own key and the balls around the segments before the free one."""
    own = masks(segments)
    at = lambda t, value: F.struct(F.lit(t).alias("t"), value.bitwiseAND(F.lit(_signed(((1 << BITS) - 1) ^ own[t]))).alias("key"))
    balls = []
    for t in range(1, len(own)):
        bits = F.array(*[F.lit(_signed(1 << i)).cast("long") for i in range(sum(segments[:t]))])
        balls.append(F.transform(bits, partial(lambda t, bit: at(t, fp.bitwiseXOR(bit)), t)))
    return F.concat(entries(fp, segments), *balls)


def links(prints: DataFrame, segments: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """Pairs a < b of different fingerprints within two bits, all of them."""
    held = prints.select(F.col("fp").alias("b"), F.explode(entries(F.col("fp"), segments)).alias("e")).select("b", "e.t", "e.key")
    asked = prints.select(F.col("fp").alias("a"), F.explode(probes(F.col("fp"), segments)).alias("p")).select("a", "p.t", "p.key")
    # Each pair is found from both sides; one is enough.
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    return asked.join(held, ["t", "key"]).where(near).select("a", "b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root: for each node of the edges (a, b), but the roots, the least node of its component, in few rounds.

    A large-star step joins each node's greater neighbours to its least one; a small-star step does so with the
    lesser ones. Stars are what is left when nothing changes. A node's least neighbour is aggregated before the
    shuffle and joined to its edges; the edges of a hub are rows of one key there, which AQE splits.
    """
    edges = settle(edges)
    last = None
    for _ in range(most):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        edges = settle(small.select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == last:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        last = state
    raise RuntimeError(f"components did not settle in {most} rounds")


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id within reach, itself included), a row for each row."""
    prints = settle(fingerprints(docs.select("doc_id", text), text, shingle))
    least = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = settle(components(links(least.select("fp"))))
    # Fingerprints without a link are their own component: only linked ones are grouped.
    joined = least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = settle(joined.select("fp", "root").join(of_root, "root").select("fp", "component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def op9(docs: DataFrame) -> DataFrame:
    """The digest of near_duplicates(): a row for each document."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
