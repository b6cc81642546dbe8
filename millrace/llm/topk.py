"""Exact top-k search by inner product over multi-resolution segment statistics.

Every vector is cut into 1, 4, ... equal segments; a segment keeps its mean and deviation. With the negated inner product
as distance, a pair's distance is at least minus the sum over segments of length * (mean * mean + deviation * deviation)
(Cauchy-Schwarz on what the means leave). Bounds are taken coarse to fine, each for the pairs that the last one left against
the query's k-th best score so far, and exact integer scores are computed for the survivors alone.

Plan: a fixed grid. Queries and candidates are hashed into blocks of bounded rows; a cell is one query block against one
candidate group, joined on its number, so neither side is broadcast or collected. A cell streams its candidates in blocks and
gives its k best per query, and a window over those gives the result.

Edge cases: a vector that is null or holds a null or non-finite component takes no part, nor does a null id; an empty
vector scores 0; of unequal lengths the shorter counts as padded with zeros; rows of equal id are candidates of their own
(a query's own row is every row of its id); ties go to the smaller id; fewer candidates than k give all. Components are
whole numbers after scaling; scores past 2**53 are computed in Python integers, and those past 64 bits saturate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import fields
from millrace.session import ship

QUERY_BLOCK, GROUP_ROWS, TILE = 4096, 16_384, 1024
LEVELS = (1, 4, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(length) * means and deviations: the inner product of two such rows bounds that of the vectors from above."""
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    root = [np.sqrt(p.shape[1]) for p in parts]
    return np.concatenate([np.stack([p.mean(1) * r for p, r in zip(parts, root)], 1), np.stack([p.std(1) * r for p, r in zip(parts, root)], 1)], 1)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query number, id, score) of each query's k best rows, and the number of exact scores computed."""
    exact = 0
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    n = len(queries)
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if limit >= 2.0**53:  # doubles would round
        a, b = ([[int(v) for v in x] for x in m] for m in (queries, rows))
        top = 2**63 - 1
        found = []
        for i, q in enumerate(a):
            scores = sorted((-max(-top, min(top, sum(x * y for x, y in zip(q, r)))), int(j)) for r, j in zip(b, ids) if j != query_ids[i])[:k]
            found += [(i, j, -s) for s, j in scores]
        return *(np.array([f[c] for f in found], np.int64) for c in range(3)), n * len(rows)
    top = np.full((n, k), -np.inf)
    top_id = np.full((n, k), np.iinfo(np.int64).max)
    q_stats = [statistics(queries, s) for s in LEVELS]
    for a in range(0, len(rows), TILE):
        tile, tile_ids = rows[a : a + TILE], ids[a : a + TILE]
        for c in range(0, n, TILE):
            part = slice(c, min(n, c + TILE))
            need = top[part, -1]
            slack = 1e-9 * limit + 1e-6
            q_at = np.arange(part.start, part.stop)
            t_at = np.arange(len(tile))
            # a pair survives a level if its bound reaches the k-th best score; rows without survivors go
            for stats, level in zip(q_stats, LEVELS):
                bound = stats[q_at] @ statistics(tile[t_at], level).T
                alive = bound + slack >= need[q_at - part.start][:, None]
                q_keep, t_keep = alive.any(1), alive.any(0)
                alive = alive[q_keep][:, t_keep]
                q_at, t_at = q_at[q_keep], t_at[t_keep]
                if not len(q_at):
                    break
            if not len(q_at):
                continue
            if alive.mean() > 0.1:
                scores = queries[q_at] @ tile[t_at].T
                scores[~alive] = -np.inf
                exact += scores.size
            else:
                i, j = np.nonzero(alive)
                scores = np.full(alive.shape, -np.inf)
                for s in range(0, len(i), 1 << 16):
                    x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    scores[x, y] = np.einsum("ij,ij->i", queries[q_at[x]], tile[t_at[y]])
                exact += len(i)
            scores[query_ids[q_at][:, None] == tile_ids[t_at][None, :]] = -np.inf
            # of equal scores the smaller id stands first: ids ascend over tiles and within one
            both = np.concatenate([top[q_at], scores], 1)
            both_ids = np.concatenate([top_id[q_at], np.broadcast_to(tile_ids[t_at], scores.shape)], 1)
            if both.shape[1] > 4 * k + k:
                cut = np.partition(both, both.shape[1] - k, axis=1)[:, -k][:, None]
                width = int((both >= cut).sum(1).max())
                pick = np.argsort(np.where(both >= cut, 0, 1), axis=1, kind="stable")[:, :width]
                both, both_ids = np.take_along_axis(both, pick, 1), np.take_along_axis(both_ids, pick, 1)
            pick = np.argsort(-both, axis=1, kind="stable")[:, :k]
            top[q_at], top_id[q_at] = np.take_along_axis(both, pick, 1), np.take_along_axis(both_ids, pick, 1)
    i, j = np.nonzero(np.isfinite(top))
    return i, top_id[i, j], top[i, j].astype(np.int64), exact


def _floored(x: Column) -> Column:
    """A double's floor; from 2 ** 53 on every double is whole, where a cast to long would saturate."""
    return F.when(F.abs(x) < float(2**53), F.floor(x).cast("double")).otherwise(x)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id long, rank int, vec_id long, score long: for the rows that ``is_query`` (over vec_id) names, the k best others by integer inner product of floor(scale * component)."""
    ship(vectors.sparkSession)
    d = fields(vectors, vec_id=id_col, embedding=vector_col)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~bad)
    d = d.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: _floored(x.cast("double") * scale)).alias("x"))
    q = d.where(is_query)
    n, nq = d.count(), q.count()
    groups, blocks = max(1, -(-n // GROUP_ROWS)), max(1, -(-nq // QUERY_BLOCK))
    group = F.expr(f"cast(pmod(xxhash64(vec_id, 1), {groups}) as int)")
    block = F.expr(f"cast(pmod(xxhash64(vec_id, 2), {blocks}) as int)")
    left = q.withColumn("b", block).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = d.withColumn("g", group).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def matrix(table: pa.Table, width: int) -> np.ndarray:
        lists = table.column("x").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        out = np.zeros((len(sizes), width))
        out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
        return out

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        width = max(1, *(max(t.column("x").combine_chunks().value_lengths().to_pylist()) for t in (a, b)))
        ids = a.column("vec_id").to_numpy()
        i, found, score, _ = best(matrix(a, width), ids, matrix(b, width), b.column("vec_id").to_numpy(), k)
        return pa.table([pa.array(ids[i]), pa.array(found.astype(np.int64)), pa.array(score)], names=names)

    r = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return r.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 5
"""
