"""Operator 10, exact top-k inner-product search with multi-resolution segment statistics.

Vectors are cut into segments. With means and deviations of the segments,
q.x <= sum over segments of (len * mean_q * mean_x + dev_q * dev_x), by
Cauchy-Schwarz; for a fixed query this is a lower bound of the distance.
Bounds come coarse to fine; what cannot reach the k-th best score so far is
dropped, and survivors get the exact integer product.

Queries and rows are dealt into blocks by a hash of the id; each pair of
blocks is one group of bounded size, and groups send k rows per query.

Contract cases: null vectors and ones holding null or non-finite components
take no part, nor do rows without an id or empty vectors; a query meets only
vectors of its own length; rows that repeat an id are candidates of all
queries but those with that id; repeated query rows count once; fewer
candidates than k give fewer rows. Products are exact below 2^63.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table

QUERY_BLOCK = 1024
ROW_BLOCK = 8192
LEVELS = (1, 4, 16)


def quantised(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id long, v array<long> of floor(256 * x); unusable rows are gone."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = emb.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(ok).select("id", F.transform("v", lambda x: F.floor(x * 256.0).cast("long")).alias("v"))


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose products bound the inner products from above."""
    out = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        mean = part.mean(1)
        out += [mean * np.sqrt(part.shape[1]), np.sqrt(((part - mean[:, None]) ** 2).sum(1))]
    return np.stack(out, 1)


def best(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """k best (query_id, vec_id, score) of int64 rows for each query, ties to the smaller id."""
    qf, xf = queries.astype(np.float64), rows.astype(np.float64)
    levels = [s for s in LEVELS if s <= rows.shape[1]]
    fq, fx = [features(qf, s) for s in levels], [features(xf, s) for s in levels]
    out = []
    exact = np.abs(qf).max(initial=0) * np.abs(xf).max(initial=0) * rows.shape[1] < 2**52
    a, b = (qf, xf) if exact else (queries, rows)
    for i in range(len(queries)):
        own = ids != q_ids[i]
        bound = fx[0] @ fq[0][i]
        bound[~own] = -np.inf
        live = np.flatnonzero(own)
        if not len(live):
            continue
        first = live[np.argpartition(-bound[live], min(4 * k, len(live)) - 1)[: 4 * k]]
        floor = np.sort(b[first] @ a[i])[::-1][: k][-1] if len(first) >= k else -np.inf
        for level, (xs, qs) in enumerate(zip(fx, fq, strict=True)):
            upper = bound[live] if not level else xs[live] @ qs[i]
            live = live[upper + 1e-6 * (np.abs(upper) + 1) >= floor]
        score = (b[live] @ a[i]).astype(np.int64)
        top = np.lexsort((ids[live], -score))[:k]
        out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[live][top], "score": score[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})


def _block(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf.is_query], pdf[~pdf.is_query]
        if not len(q) or not len(x):
            return best(np.zeros((0, 1), np.int64), np.zeros(0, np.int64), np.zeros((0, 1), np.int64), np.zeros(0, np.int64), k)
        return best(np.stack(q.v.to_numpy()), q.id.to_numpy(), np.stack(x.v.to_numpy()), x.id.to_numpy(), k)

    return run


def topk(rows: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score from frames (id long, v array<long>)."""
    nq, nr = -(-queries.count() // query_block) or 1, -(-rows.count() // row_block) or 1
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n - 1})"))
    left = queries.distinct().select("id", "v", F.lit(True).alias("is_query"), block(nq).alias("qb"), every(nr).alias("rb"))
    right = rows.select("id", "v", F.lit(False).alias("is_query"), every(nq).alias("qb"), block(nr).alias("rb"))
    found = left.unionByName(right).groupBy("qb", "rb", F.size("v").alias("dim")).applyInPandas(_block(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    rows = quantised(read_table(spark, sf_dir, "embeddings"))
    return topk(rows, rows.where("id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, x.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT id, v FROM v WHERE id % 50 = 0) q JOIN v x ON q.id <> x.id AND len(q.v) = len(x.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
