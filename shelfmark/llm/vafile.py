"""Exact top-k search by inner product with vector-approximation files.

Rows and queries meet in blocks of bounded size. In each block every component is
quantised to one of 16 cells whose edges are the least and largest value inside, so a scan
of the cells bounds each score from both sides. The k-th largest lower bound drops most
rows; the exact vectors of the others are read by falling upper bound until no unread row
can reach the k-th score. Blocks return k rows a query, merged by rank.

Defined cases: vectors that are null or hold null or non-finite components take no part;
vectors of different lengths don't score with each other; an empty table gives no rows;
repeated rows are each a candidate, those with the query's own id are not, and a repeated
query is answered once; equal scores go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Rows and queries that meet in one task; cells a component.
ROWS, QUERIES_AT_ONCE, CELLS = 16_384, 4_096, 16


def cells(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each component, the least and the largest value in its cell."""
    n, d = data.shape
    low, high = np.empty((n, d)), np.empty((n, d))
    for j in range(d):
        x = data[:, j]
        least, most = x.min(), x.max()
        code = np.minimum((x - least) * CELLS // (most - least + 1), CELLS - 1).astype(np.int64)
        lo, hi = np.full(CELLS, np.iinfo(np.int64).max), np.full(CELLS, np.iinfo(np.int64).min)
        np.minimum.at(lo, code, x)
        np.maximum.at(hi, code, x)
        low[:, j], high[:, j] = lo[code], hi[code]
    return low, high


def search(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """For each query (its place, ids, scores) of the k best rows, exact and in order."""
    if not len(data):
        return
    peak = float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, data.shape[1])
    kind = np.float32 if peak < 2**24 else np.float64
    whole = peak < 2**53  # otherwise rounding could break the bounds: every row is read
    low, high = (x.astype(kind) for x in cells(data))
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
        most = up @ high.T + down @ low.T
        least = up @ low.T + down @ high.T
        for i in range(len(q)):
            other = ids != own[at + i]
            take = min(k, int(other.sum()))
            if not take:
                continue
            floor = np.partition(least[i][other], -take)[-take] if whole else -np.inf
            left = np.flatnonzero(other & (most[i] >= floor))
            left = left[np.argsort(-most[i][left], kind="stable")]
            kept = np.zeros(0, np.int64)
            score = np.zeros(0, np.int64)
            for j in range(0, len(left), 4 * k):
                if whole and len(kept) == take and most[i][left[j]] < score[-1]:
                    break
                new = left[j : j + 4 * k]
                kept, score = np.concatenate([kept, new]), np.concatenate([score, data[new] @ q[i]])
                best = np.lexsort((ids[kept], -score))[:take]
                kept, score = kept[best], score[best]
            yield at + i, ids[kept], score


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding", rows: int = ROWS, queries: int = QUERIES_AT_ONCE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` rows of largest score."""
    x = F.col("x")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    data = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"), is_query.alias("asks")).filter(x.isNotNull() & good)
    data = data.select("id", "asks", F.transform(x, lambda v: F.floor(v * scale)).alias("q"), F.size(x).alias("dim"))
    n, asking = data.agg(F.count("*"), F.count_if("asks")).first()
    n_rows, n_queries = max(1, -(-n // rows)), max(1, -(-asking // queries))
    block = lambda many, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = data.select("dim", block(n_rows, 1).alias("r"), every(n_queries).alias("b"), "id", "q")
    right = data.filter("asks").dropDuplicates(["id", "q"]).select("dim", every(n_rows).alias("r"), block(n_queries, 2).alias("b"), "id", "q")

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, own = rows.column("id").to_numpy(), asked.column("id").to_numpy()
        found = list(search(_matrix(rows, "q"), ids, _matrix(asked, "q"), own, k)) if len(own) and len(ids) else []
        who = [np.full(len(i), own[j]) for j, i, _ in found]
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(cat(who), pa.int64()), "vec_id": pa.array(cat([i for _, i, _ in found]), pa.int64()), "score": pa.array(cat([s for *_, s in found]), pa.int64())})

    keys = ("dim", "r", "b")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


QUERIES = {"op2_exact_top_k": op2}
SQL = {
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
