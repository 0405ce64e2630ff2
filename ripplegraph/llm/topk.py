"""Exact top-k search by Fagin's threshold algorithm.

Vectors are quantised to integers. Candidates are dealt into blocks by id hash, and each block sorts its
candidates once per dimension. A query walks all dimensions' lists together, from the end that its component's
sign favours; every candidate met gets its whole inner product; the values at the current depth bound all
candidates not met yet. The walk stops when that bound is below the kth score (at a tie it goes on, as a
smaller id would win). A block's best k of each query go on, and the best k of all blocks are the result.

Queries are dealt into blocks too, and each pair of a query block and a candidate block is one task group of
bounded size, whatever the number of vectors; no vector is broadcast. Scores are integers throughout.

Defined results: a vector that is null, or holds a null or a non-finite number, and a row without vec_id take
no part. Rows that repeat both id and vector are one; a query's own id is no candidate of it. Vectors meet
those of their own length only. A query without candidates has no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm.base import settle


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and q, the floors of scale * x."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("q")).distinct()


def threshold_search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """query id, candidate id and score of each query's k best candidates (ids and x: by candidate)."""
    n, dims = x.shape
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    lists = np.argsort(x, axis=0, kind="stable")
    exact = dims == 0 or float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dims < 2**53
    values = x.astype(np.float64) if exact else x.astype(object)
    columns = np.arange(dims)
    for query_id, q in zip(query_ids, queries):
        up = q > 0
        live = np.flatnonzero(q)
        weights = q.astype(np.float64) if exact else q.astype(object)
        met = ids == query_id
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, values.dtype)
        depth, step = 0, max(8, n // 512)
        while True:
            end = min(n, depth + step)
            places = np.arange(depth, end)[:, None]
            seen = lists[np.where(up, n - 1 - places, places), columns][:, live] if len(live) else np.zeros((0, 0), np.int64)
            fresh = np.zeros(n, bool)
            fresh[seen.ravel()] = True
            if not len(live) or end == n:
                fresh[:] = True
            fresh = np.flatnonzero(fresh & ~met)
            met[fresh] = True
            best_ids = np.concatenate([best_ids, ids[fresh]])
            best = np.concatenate([best, values[fresh] @ weights if dims else np.zeros(len(fresh))])
            if len(best) > k:
                kth = np.partition(best, len(best) - k)[len(best) - k]
                close = np.flatnonzero(best >= kth)
                chosen = close[np.lexsort((best_ids[close], -best[close]))][:k]
                best, best_ids = best[chosen], best_ids[chosen]
            if end == n or not len(live):
                break
            depth, step = end, step * 2
            at = lists[np.where(up, n - depth, depth - 1), columns]
            bound = (values[at, columns] * weights)[live].sum()
            if len(best) >= k and bound < best.min():
                break
        for i in np.lexsort((best_ids, -best))[:k]:
            yield int(query_id), int(best_ids[i]), int(best[i])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, candidate_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each vector whose id is divisible by `every`."""
    own = settle(quantised(vectors).withColumn("dims", F.size("q")))
    is_query = F.col("vec_id") % every == 0
    n, n_queries = own.agg(F.count("*"), F.coalesce(F.sum(is_query.cast("long")), F.lit(0))).first()
    blocks, query_blocks = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(n_queries / query_block))
    block = lambda name, count: F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(count)).cast("int")
    every_block = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = own.withColumn("cb", block("c", blocks)).withColumn("qb", every_block(query_blocks))
    queries = own.where(is_query).withColumn("qb", block("q", query_blocks)).withColumn("cb", every_block(blocks))
    keys = ["dims", "qb", "cb"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids = t.column("vec_id").to_numpy()
            flat = t.column("q").combine_chunks().flatten().to_numpy() if len(ids) else np.zeros(0, np.int64)
            return ids, flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.int64)

        (ids, x), (query_ids, q) = matrix(left), matrix(right)
        rows = list(threshold_search(ids, x, query_ids, q, k)) if len(ids) and len(query_ids) else []
        columns = zip(*rows) if rows else ((), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(vectors: DataFrame) -> DataFrame:
    return top_k(vectors)
