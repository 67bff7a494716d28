"""Exact top-k inner products with multi-resolution segment statistics."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from geoquarry.llm.common import table

#: Segments per vector, coarse to fine; candidates and queries of a block; candidates compared at once.
LEVELS, CANDIDATES, QUERIES, TILE = (1, 4, 16), 8192, 8192, 1024
TOP, SCALE, EVERY = 20, 64.0, 20


def segments(vectors, level):
    """Per vector the weighted means and deviations of ``level`` segments.

    For two vectors, mean * mean + deviation * deviation, added up over the
    segments, is at least their inner product, and a finer cut comes nearer.
    """
    edges = np.linspace(0, vectors.shape[1], min(level, vectors.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(vectors, edges[:-1], axis=1) / size
    square = np.add.reduceat(vectors * vectors, edges[:-1], axis=1)
    deviation = np.sqrt(np.maximum(square - size * mean * mean, 0))
    return np.hstack([mean * np.sqrt(size), deviation])


def best_of(queries, query_ids, candidates, candidate_ids, top=TOP, levels=LEVELS):
    """The ``top`` best candidates of each query, exactly: arrays (query row, candidate row, score).

    Whole-number vectors.  Candidates come in tiles, those of largest norm first.
    A tile is bounded at each resolution in turn and only the pairs that may still
    enter a query's list are carried on, in the end to exact scores.  Ties go to
    the smaller id; a query is no candidate of its own.
    """
    order = np.argsort(-np.einsum("ij,ij->i", candidates, candidates), kind="stable")
    candidates, candidate_ids = candidates[order], candidate_ids[order]
    mine = [segments(queries, level) for level in levels]
    slack = 1e-6 * np.linalg.norm(queries, axis=1) + 1e-6
    floor = np.full(len(queries), -np.inf)
    kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    exact = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(1, queries.shape[1]) < 2.0**52
    for at in range(0, len(candidates), TILE):
        tile = candidates[at : at + TILE]
        limit = floor - slack * (np.linalg.norm(tile, axis=1).max(initial=0) + 1)
        rows, cols = np.arange(len(queries)), np.arange(len(tile))
        for own, level in zip(mine, levels):
            # queries and candidates with no open pair left drop out before the next, finer bound
            maybe = own[rows] @ segments(tile[cols], level).T >= limit[rows, None]
            r, c = maybe.any(1), maybe.any(0)
            rows, cols, maybe = rows[r], cols[c], maybe[np.ix_(r, c)]
            if not len(rows):
                break
        if not len(rows):
            continue
        x, y = queries[rows], tile[cols]
        score = x @ y.T if exact else x.astype(np.int64) @ y.astype(np.int64).T
        maybe &= query_ids[rows][:, None] != candidate_ids[at + cols][None, :]
        least = floor[rows].copy()
        fresh = np.isneginf(least)
        if fresh.any() and len(cols) > top:
            # without a list yet, only this tile's own best can enter
            part = np.where(maybe[fresh], score[fresh], -np.inf)
            least[fresh] = np.partition(part, len(cols) - top, axis=1)[:, len(cols) - top]
        q, c = np.nonzero(maybe & (score >= least[:, None]))
        new = rows[q], at + cols[c], score[q, c].astype(np.int64)
        q, c, score = (np.concatenate(pair) for pair in zip(kept, new))
        rank = np.lexsort((candidate_ids[c], -score, q))
        q, c, score = q[rank], c[rank], score[rank]
        first = np.searchsorted(q, np.arange(len(queries)))
        within = (np.arange(len(q)) - first[q]) < top
        kept = q, c, score = q[within], c[within], score[within]
        low = np.full(len(queries), np.inf)
        np.minimum.at(low, q, score.astype(np.float64))
        floor = np.where(np.bincount(q, minlength=len(queries)) >= top, low, -np.inf)
    return kept[0], order[kept[1]], kept[2]


def whole_vectors(vectors, id_col="vec_id", vector_col="embedding", scale=SCALE):
    """Vectors of whole numbers, floor(scale * x) in double; null, empty or non-finite ones are left out."""
    number = F.col(vector_col).cast("array<double>")
    bad = F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).alias("vec_id"), number.alias("_x")).where(
        F.col("vec_id").isNotNull() & F.col("_x").isNotNull() & (F.size("_x") > 0) & ~bad
    ).select("vec_id", F.transform("_x", lambda x: F.floor(x * scale).cast("double")).alias("_x"), F.size("_x").alias("_dim"))


def top_k(vectors, top=TOP, every=EVERY, id_col="vec_id", vector_col="embedding", scale=SCALE):
    """For each vector whose id ``every`` divides, the ``top`` highest inner products with all other rows.

    Query blocks and candidate blocks of bounded size meet once each; a meeting
    keeps at most ``top`` rows a query, and the lists of a query are merged by
    rank.  Output: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    Vectors of different lengths are not compared.  Rows without an id take no
    part; repeated ids are candidates as often as they come, but not for their own query
    id, and queries of one id share a list; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, id_col, vector_col, scale)
    counts = whole.groupBy("_dim").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("vec_id") % every == 0, 1).otherwise(0)).alias("_q")
    )
    # one row for each vector length
    sizes = {r["_dim"]: (-(-r["_n"] // CANDIDATES), -(-r["_q"] // QUERIES)) for r in counts.collect() if r["_q"]}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    known = F.broadcast(spark.createDataFrame([(d, int(c), int(q)) for d, (c, q) in sizes.items()], "_dim int, _cs int, _qs int"))
    blocked = whole.join(known, "_dim").withColumn("_h", F.xxhash64("vec_id"))
    asked = (
        blocked.where(F.col("vec_id") % every == 0)
        .withColumn("_qb", F.pmod("_h", F.col("_qs")).cast("int"))
        .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.col("_cs") - 1)))
    )
    held = blocked.withColumn("_cb", F.pmod(F.shiftright("_h", 20), F.col("_cs")).cast("int")).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.col("_qs") - 1))
    )
    keys = ["_dim", "_qb", "_cb"]
    left, right = (d.select(*keys, "vec_id", "_x").toDF(*keys, "vec_id", "_x") for d in (asked, held))

    def meet(a, b):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not a.num_rows or not b.num_rows:
            return empty
        x, y = (
            t["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (a, b)
        )
        ai, bi = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        q, c, score = best_of(x, ai, y, bi, top)
        return pa.table({"query_id": ai[q], "vec_id": bi[c], "score": score})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, folder):
    return top_k(table(spark, folder, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
