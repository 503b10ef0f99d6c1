"""Exact top-k by inner product: aggregation without random access.

Candidates and queries are dealt into tiles (a block of each). Within a tile every dimension is a sorted list of its
candidates, read from the top for queries with a positive weight there and from the bottom for negative ones, all lists to
the same depth. What was read gives each candidate a lower bound (unread entries at the list's end value) and an upper
bound (unread entries at the value last read). Reading stops when at most a fraction of the candidates can still reach the k-th
lower bound; only for these the final scores are resolved. Bounds are exact integers, and ties stay in play to the end.
A tile's k best go on; a window keeps the k best of all tiles.

Cases: vectors that are null or hold a null or non-finite component take no part; rows that repeat an id
are all candidates (no query's own id), of queries that repeat one the smallest vector asks; missing components count as 0; with fewer than k candidates all are returned; ties go to the smaller id; an
empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERIES_PER_TILE, CANDIDATES_PER_TILE = 1024, 4096
_STEPS = (0.02, 0.06, 0.15, 0.3, 0.5, 0.75)
_LIMIT = 2**63 - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and the components floor(scale * x), without the vectors that take no part."""
    v = F.col(vector_col).cast("array<double>")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(whole & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _matrix(t: pa.Table, width: int, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids ascending and their rows, zero-filled; of equal ids the smallest vector only if `once`."""
    ids, rows = t.column("vec_id").to_numpy(), t.column("v").combine_chunks()
    out = np.zeros((len(ids), width), np.int64)
    offsets, flat = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[at[:, None], np.arange(n)] = flat[offsets[at][:, None] + np.arange(n)]
    order = np.lexsort([*out.T[::-1], ids]) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, out = ids[order], out[order]
    if not once:
        return ids, out
    first = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
    return ids[first], out[first]


def tile_topk(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best candidates of the tile, its own id left out."""
    n, width = c.shape
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width
    out: list[tuple[int, int, int]] = []
    if most >= 2**53:  # no exact bounds in doubles: the lists are read to the end
        exact = np.clip(q.astype(object) @ c.astype(object).T, -_LIMIT - 1, _LIMIT) if most >= 2**62 else q @ c.T
        for i, qid in enumerate(qids):
            alive = np.flatnonzero(cids != qid)
            best = sorted(alive, key=lambda j: (-exact[i, j], cids[j]))[:k]
            out += [(int(qid), int(cids[j]), int(exact[i, j])) for j in best]
        return out
    up, x = np.sort(c, axis=0).astype(float), c.astype(float)
    rank = np.empty((n, width), np.int64)
    np.put_along_axis(rank, np.argsort(c, axis=0, kind="stable"), np.arange(n)[:, None], axis=0)
    plus, minus = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    waiting, alive = np.arange(len(qids)), None
    for step in (*_STEPS, 1.0):
        depth = min(n, max(k + 1, int(n * step)))
        high, low = rank >= n - depth, rank < depth  # read from the top, from the bottom
        p, m = plus[waiting], minus[waiting]
        seen = p @ np.where(high, x, 0).T + m @ np.where(low, x, 0).T
        upper = seen + (p * up[n - depth]) @ ~high.T + (m * up[depth - 1]) @ ~low.T
        lower = seen + (p * up[0]) @ ~high.T + (m * up[n - 1]) @ ~low.T
        mine = cids[None, :] == qids[waiting][:, None]
        lower[mine] = upper[mine] = -np.inf
        kth = np.partition(lower, n - min(k, n), axis=1)[:, n - min(k, n)]
        open_ = upper >= kth[:, None]
        stop = (open_.sum(axis=1) <= max(4 * k, n // 16)) | (depth == n)
        for r in np.flatnonzero(stop):
            alive = np.flatnonzero(open_[r])
            alive = alive[~mine[r][alive]]
            score = c[alive] @ q[waiting[r]]
            best = np.lexsort([cids[alive], -score])[:k]
            out += [(int(qids[waiting[r]]), int(cids[alive[j]]), int(score[j])) for j in best]
        waiting = waiting[~stop]
        if not len(waiting):
            break
    return out


def _tile(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list = []
        if candidates.num_rows and queries.num_rows:
            width = max(1, *(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max()) for t in (candidates, queries)))
            (cids, c), (qids, q) = _matrix(candidates, width, False), _matrix(queries, width, True)
            rows = tile_topk(qids, q, cids, c, k)
        cols = list(zip(*rows)) or [()] * 3
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in cols], schema=schema)

    return run


def topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates among all rows but its own.

    A tile meets at most about QUERIES_PER_TILE queries and CANDIDATES_PER_TILE candidates, so memory is bounded; each block of the stated query
    set meets each block of rows once."""
    rows = quantised(vectors, id_col, vector_col)
    queries = quantised(vectors.where(is_query), id_col, vector_col)
    n_c, n_q = rows.count(), queries.count()
    c_blocks, q_blocks = -(-max(n_c, 1) // CANDIDATES_PER_TILE), -(-max(n_q, 1) // QUERIES_PER_TILE)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", block(c_blocks).alias("c"), every(q_blocks).alias("q"))
    right = queries.select("vec_id", "v", block(q_blocks).alias("q"), every(c_blocks).alias("c"))
    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(_tile(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
