"""Embedding near-dedup and exact top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import hnsw, vafile
from shelfmark.llm.graph import components

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def rows(n=300, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.normal(size=dim)
        if i % 3 == 1:
            v = np.array(out[-1][1]) + rng.normal(scale=0.03, size=dim)
        out.append((i, [float(np.float32(x)) for x in v], i % 2 if i % 11 else None, "x"))
    out += [(n, None, 0, "x"), (n + 1, [], 0, "x"), (n + 2, [0.0] * dim, 0, "x"), (n + 3, [float("nan")] + [1.0] * (dim - 1), 0, "x"), (n + 4, [None] + [1.0] * (dim - 1), 0, "x")]
    out += [(n + 5 + k, out[2][1], out[2][2], "x") for k in range(5)] + [out[4]]  # copies, and a repeated row
    return out


def usable(r):
    return r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])


def brute(data, least):
    distinct = list({r[0]: r for r in data}.values())
    good = [r for r in data if usable(r)]
    unit = {id(r): np.array(r[1]) / np.linalg.norm(r[1]) for r in good}
    links = {r[0]: 0 for r in distinct}
    near = {r[0]: {r[0]} for r in distinct}
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[id(a)] @ unit[id(b)] >= least:
                links[a[0]] += 1
                links[b[0]] += 1
                near[a[0]].add(b[0])
                near[b[0]].add(a[0])
    comp = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = start
                todo += near[x]
    return links, comp


@pytest.mark.parametrize("shard", [16_384, 40])
def test_near_duplicates(spark, shard):
    data = rows()
    links, comp = brute(data[:-1], 0.98)
    made = hnsw.near_duplicates(spark.createDataFrame(data, SCHEMA), shard=shard).collect()
    got = {r.vec_id: r for r in made}
    assert len(made) == len(data) and made.count(got[data[-1][0]]) == 2  # a repeated row counts once and comes twice
    for r in data:
        assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (links[r[0]], comp[r[0]], comp[r[0]] == r[0])


def test_near_duplicates_edges(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hnsw.near_duplicates(spark.createDataFrame(rows(), SCHEMA)).count() == len(rows())


def test_dense_cluster_keeps_every_link():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=32) + rng.normal(scale=0.02, size=(700, 32)), rng.normal(size=(900, 32))])
    shard = hnsw.Shard(np.arange(len(x)), np.ones(len(x), int), x)
    found, _, recall = shard.linked(shard.x, 0.98)
    a, _ = hnsw.both_ways(found, found)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = (u @ u.T >= 0.98).sum(1)
    assert recall >= hnsw.RECALL and np.bincount(a, minlength=len(x)).tolist() == truth.tolist()


def test_links_between_shards_count_at_both_ends(spark):
    """Groups of near copies over several shards: every count and component, and the audits' recall."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=16) + rng.normal(scale=s, size=(n, 16)) for n, s in [(2, 0.03)] * 300 + [(30, 0.06)] * 20 + [(900, 0.08)]] + [rng.normal(size=(1500, 16))]).astype(np.float32)
    data = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    frame = spark.createDataFrame(data, SCHEMA)
    got = {r.vec_id: r for r in hnsw.near_duplicates(frame, shard=1000).collect()}
    links = near.sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= hnsw.RECALL * links.sum()
    told = hnsw.audits(frame, shard=1000).collect()
    assert len(told) == 10 and min(r.recall for r in told) >= hnsw.RECALL
    low = np.arange(len(x))
    while True:
        least = np.array([low[n].min() for n in near])
        if (least == low).all():
            break
        low = least
    assert sum(got[i].component_id != low[i] for i in range(len(x))) <= 0.001 * len(x)


@pytest.mark.parametrize(("block_rows", "block_queries"), [(16_384, 4096), (50, 7)])
def test_top_k(spark, block_rows, block_queries):
    data = rows(200, 6)
    df = spark.createDataFrame(data, SCHEMA)
    got = {}
    for r in vafile.top_k(df, F.col("vec_id") % 20 == 0, k=5, rows=block_rows, queries=block_queries).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(r[0], [math.floor(64 * x) for x in r[1]]) for r in data if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    for q, v in good:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:5]
            assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_top_k_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vafile.top_k(empty, F.col("vec_id") % 20 == 0).count() == 0
    huge = spark.createDataFrame([(0, [3e9, 1.0], 0, ""), (1, [3e9, 2.0], 0, ""), (2, [-3e9, 2.0], 0, "")], SCHEMA)
    exact = [r.vec_id for r in vafile.top_k(huge, F.col("vec_id") == 0, scale=1, k=2).orderBy("rank").collect()]
    assert exact == [1, 2]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40) if i % 10] + [(5, 5), (100, 40), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got[10] == 1 and got[20] == 11 and got[100] == got[40] == 31 and 5 in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_agree_with_sql(agree):
    agree(vafile.op2, vafile.SQL["op2_exact_top_k"])
    agree(hnsw.op1, hnsw.SQL["op1_embedding_near_dedup"])
