"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Vectors of one label are dealt into shards of bounded size, and each shard's graph is built
once, layer by layer, and written. A task holds two shards of a label (or one twice): it
searches either's graph for every vector of the other, so each vector queries every shard of
its label, and a link found from one end counts at both. From the beam's links a flood over
the bottom layer, along links and against them, gathers the rest of a dense neighbourhood.
Some queries are compared with a full scan of the shard, and the beam is doubled until the
mean recall of spread and that of dense queries passes (at the shard's size the scan takes
over, so it always does); :func:`audits` returns both. Links are verified by cosine in double
precision. Tasks return a count for each vector and a spanning forest of their links;
components are the union of the forests.

Defined cases: a null label, or a vector that is null, empty, zero or holds null or
non-finite components, links with nothing and is kept as its own component; equal vectors
of one label are searched once and count as links of each other; vectors of different
lengths have no links; repeated rows count once and each get the row of their id; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components

#: Vectors in a shard and in a block of queries; links a node keeps; beam to begin with.
SHARD, LINKS, BEAM = 16_384, 12, 32
#: Queries that an audit compares with a full scan, and the recall it asks for.
AUDIT, RECALL = 96, 0.999
#: Cosines within this of the threshold are taken up for verification.
SLACK = 1e-4


class Graph:
    """Layered proximity graph over unit vectors; a layer holds the first ``sizes[l]`` rows."""

    def __init__(self, x: np.ndarray, links: int = LINKS, beam: int = BEAM, seed: int = 5) -> None:
        level = np.floor(-np.log(np.random.default_rng(seed).random(len(x))) / np.log(links)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.x = np.ascontiguousarray(x[self.order], np.float32)
        top = int(level.max(initial=0))
        self.sizes = [int((level >= l).sum()) for l in range(top + 1)]
        self.links = [np.full((n, links * (2 if l == 0 else 1)), -1, np.int32) for l, n in enumerate(self.sizes)]
        for layer in range(top, -1, -1):
            self._fill(layer, beam)
        target = self.links[0].ravel()
        source = np.repeat(np.arange(len(x)), self.links[0].shape[1])[target >= 0]
        target = target[target >= 0]
        self.into = source[np.argsort(target, kind="stable")]
        self.into_at = np.searchsorted(np.sort(target), np.arange(len(x) + 1))

    def _fill(self, layer: int, beam: int) -> None:
        links, n, done = self.links[layer], self.sizes[layer], 0
        while done < n:
            new = np.arange(done, min(n, done + max(64, min(done, 512))))
            near = self.x[new] @ self.x[new].T
            np.fill_diagonal(near, -np.inf)
            width = min(links.shape[1], len(new) - 1)
            cand = new[np.argpartition(-near, width - 1, 1)[:, :width]] if width > 0 else np.zeros((len(new), 0), np.int64)
            if done:
                found, _ = self._beam(self.x[new], self._enter(self.x[new], layer, done), layer, beam)
                cand = np.concatenate([found, cand], 1)
            chosen = self._select(new, cand, links.shape[1])
            links[new, : chosen.shape[1]] = chosen
            self._back(layer, new, chosen)
            done = int(new[-1]) + 1

    def _enter(self, q: np.ndarray, layer: int, done: int) -> np.ndarray:
        """An entry node for each query, by greedy descent through the layers above."""
        at = np.zeros((len(q), 1), np.int64)
        for above in range(len(self.sizes) - 1, layer, -1):
            at = self._beam(q, at, above, 1)[0]
        return np.where((at >= 0) & (at < done), at, 0)

    def _beam(self, q: np.ndarray, entry: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        links, n = self.links[layer], len(q)
        seen = np.zeros((n, self.sizes[layer]), bool)
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf, np.float32)
        ids[:, 0], sims[:, 0] = entry[:, 0], np.einsum("nd,nd->n", self.x[entry[:, 0]], q)
        seen[np.arange(n), ids[:, 0]] = True
        todo = ids >= 0
        act = np.arange(n)
        while len(act):
            best = np.where(todo[act], sims[act], -np.inf).argmax(1)
            live = todo[act, best]
            act, best = act[live], best[live]
            if not len(act):
                break
            todo[act, best] = False
            near = links[ids[act, best]]
            fresh = (near >= 0) & ~seen[act[:, None], near]
            seen[act[:, None], np.where(near >= 0, near, ids[act, best][:, None])] = True
            some = fresh.any(1)
            act_on = act[some]
            if not len(act_on):
                continue
            near, fresh = near[some], fresh[some]
            s = np.where(fresh, np.einsum("amd,ad->am", self.x[near], q[act_on]), -np.inf)
            all_s, all_i = np.concatenate([sims[act_on], s], 1), np.concatenate([ids[act_on], np.where(fresh, near, -1)], 1)
            all_t = np.concatenate([todo[act_on], fresh], 1)
            top = np.argpartition(-all_s, width - 1, 1)[:, :width]
            rows = np.arange(len(act_on))[:, None]
            sims[act_on], ids[act_on], todo[act_on] = all_s[rows, top], all_i[rows, top], all_t[rows, top]
        return ids, sims

    def _select(self, of: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates: spread out first, then the nearest left."""
        n, c = cand.shape
        if not c:
            return np.full((n, 0), -1)
        bad = (cand < 0) | (cand == of[:, None])
        order = np.argsort(cand, 1, kind="stable")
        ranked = np.take_along_axis(cand, order, 1)
        again = np.zeros_like(bad)
        np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        bad |= again
        pts = self.x[np.maximum(cand, 0)]
        sim = np.where(bad, -np.inf, np.einsum("ncd,nd->nc", pts, self.x[of]))
        among = np.einsum("ncd,ned->nce", pts, pts)
        open_, rows = ~bad, np.arange(n)
        rank = np.full((n, c), 2.0)
        rank[bad] = 9
        for turn in range(min(most, c)):
            best = np.where(open_, sim, -np.inf).argmax(1)
            ok = open_[rows, best]
            if not ok.any():
                break
            rank[rows[ok], best[ok]] = turn / most
            open_ &= ~(among[rows, best] > sim) | ~ok[:, None]
            open_[rows, best] = False
        take = np.lexsort((-sim, rank), axis=1)[:, :most]
        out = np.take_along_axis(cand, take, 1)
        return np.where(np.take_along_axis(bad, take, 1), -1, out)

    def _back(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        """Links from the chosen nodes back to the new ones."""
        links = self.links[layer]
        source = np.repeat(new, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        sim = np.einsum("nd,nd->n", self.x[source], self.x[target])
        order = np.lexsort((-sim, target))
        source, target = source[order], target[order]
        first = np.r_[True, target[1:] != target[:-1]]
        place = np.arange(len(target)) - np.maximum.accumulate(np.where(first, np.arange(len(target)), 0))
        keep = place < 32  # nearest new neighbours of a node in one batch
        uniq, row = np.unique(target[keep], return_inverse=True)
        cand = np.full((len(uniq), 32), -1, np.int64)
        cand[row, place[keep]] = source[keep]
        for at in range(0, len(uniq), 512):
            part = uniq[at : at + 512]
            both = np.concatenate([links[part], cand[at : at + 512]], 1)
            links[part] = self._select(part, both, links.shape[1])

    def near(self, q: np.ndarray, least: float, beam: int, own: bool = False) -> list[np.ndarray]:
        """Places of rows with similarity of ``least`` or more found for each query.

        With ``own``, the queries are the graph's rows: each flood starts at its row too.
        """
        out, n = [], len(self.x)
        if beam >= n:
            for at in range(0, len(q), 256):
                out += [np.flatnonzero(s >= least) for s in q[at : at + 256] @ self.x.T]
            return [self.order[o] for o in out]
        place = np.argsort(self.order)
        step = max(16, min(512, 16_000_000 // n))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            ids, sims = self._beam(part, self._enter(part, 0, n), 0, beam)
            for j, (v, i, s) in enumerate(zip(part, ids, sims, strict=True), at):
                hit = i[s >= least]
                if own:
                    hit = np.union1d(hit, place[j])
                out.append(self._flood(v, hit, least) if len(hit) > 1 - own else hit)
        return [self.order[o] for o in out]

    def _flood(self, q: np.ndarray, hit: np.ndarray, least: float) -> np.ndarray:
        seen = np.zeros(len(self.x), bool)
        seen[hit] = True
        found, front = [hit], hit
        while len(front):
            near = self.links[0][front].ravel()
            start, size = self.into_at[front], self.into_at[front + 1] - self.into_at[front]
            back = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
            near = np.unique(np.concatenate([near[near >= 0], self.into[back]]))
            near = near[~seen[near]]
            seen[near] = True
            front = near[self.x[near] @ q >= least]
            found.append(front)
        return np.concatenate(found)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


class Shard:
    """The vectors of a shard, in double precision and unit length, and their graph."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.n, self.x = ids, n, unit(x)
        self.graph = Graph(self.x.astype(np.float32))

    def linked(self, queries: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[list[np.ndarray], int, float]:
        """For each query (of unit length) the places with cosine of at least ``threshold``; the beam and the recall it had."""
        q, own = queries.astype(np.float32), queries is self.x
        spread = np.unique(np.linspace(0, len(q) - 1, AUDIT).astype(int))

        def verified(found: list[np.ndarray], of: np.ndarray) -> list[np.ndarray]:
            return [f[self.x[f] @ v >= threshold] if len(f) else f for f, v in zip(found, of, strict=True)]

        def recall(found: list[np.ndarray], at: np.ndarray) -> float:
            """Mean share of a query's links that were found, over the queries ``at`` that have any."""
            truth = [np.flatnonzero(self.x @ queries[i] >= threshold) for i in at]
            shares = [len(np.intersect1d(found[i], t)) / len(t) for i, t in zip(at, truth, strict=True) if len(t)]
            return float(np.mean(shares)) if shares else 1.0

        while True:
            found = verified(self.graph.near(q, threshold - SLACK, beam, own), queries)
            dense = np.argsort([-len(f) for f in found], kind="stable")[: AUDIT // 4]
            least = min(recall(found, spread), recall(found, dense))
            if least >= RECALL or beam >= len(self.x):
                return found, beam, least
            beam *= 2


def both_ways(rows: list[np.ndarray], columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the links found from the rows' end or the columns', each once."""
    flat = lambda found: (np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64))
    (a, b), (d, c) = flat(rows), flat(columns)
    width = max(1, len(columns))
    pairs = np.unique(np.concatenate([a * width + b, c * width + d]))
    return pairs // width, pairs % width


def _joined(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) of a spanning forest of the links between ``nodes[a]`` and ``nodes[b]``; a root is its tree's smallest."""
    low = nodes.copy()
    while True:
        least = np.minimum(low[a], low[b])
        if (low[a] == least).all() and (low[b] == least).all():
            return [(int(x), int(y)) for x, y in zip(nodes, low, strict=True) if x != y]
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)


_FOUND = "node long, links long, root long, label string, s int, b int, beam int, recall double"


def _usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, k, label, x, usable: ``k`` names equal vectors of a label."""
    x = F.col("x")
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    # null and unusable vectors get a key of their own, so they never pile up under one
    rows = rows.withColumn("usable", F.coalesce(good & F.col("label").isNotNull(), F.lit(False)))
    return rows.withColumn("k", F.when(F.col("usable"), F.sha2(F.to_json(F.struct("label", "x")), 256)).otherwise(F.concat(F.lit("-"), F.col("id").cast("string"))))


def _search(rows: DataFrame, threshold: float, shard: int, n: int) -> tuple[DataFrame, DataFrame]:
    """The different vectors (k, rep, n), and what the tasks found (rows of _FOUND)."""
    rows = rows.filter("usable")
    ids = rows.select("k", "id").distinct().groupBy("k").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = rows.groupBy("k").agg(F.first("label").alias("label"), F.first("x").alias("x")).join(ids, "k")
    reps = common.table(reps.withColumn("dim", F.size("x")), n * 8)
    sizes = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("s", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    kind = rows.schema["label"].dataType.simpleString()

    def build(data: pa.Table) -> pa.Table:
        data = data.sort_by("rep").combine_chunks()
        x = data.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(data.num_rows, -1)
        made = pickle.dumps(Shard(data.column("rep").to_numpy(), data.column("n").to_numpy(), x), protocol=5)
        return pa.table([*(data.column(c).slice(0, 1) for c in ("label", "dim", "s", "shards")), pa.array([made], pa.binary())], ["label", "dim", "s", "shards", "g"])

    graphs = dealt.select("label", "dim", "s", "shards", "rep", "n", "x").groupBy("label", "dim", "s").applyInArrow(build, f"label {kind}, dim int, s int, shards int, g binary")
    graphs = common.table(graphs)
    left = graphs.select("label", "dim", "s", F.explode(F.sequence("s", F.col("shards") - 1)).alias("b"), "g")
    right = graphs.select("label", "dim", F.explode(F.sequence(F.lit(0), "s")).alias("o"), F.col("s").alias("b"), "g").withColumnRenamed("o", "s")

    def run(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        label, _, s, b = (k.as_py() for k in key)
        p = pickle.loads(one.column("g")[0].as_buffer())
        q = p if s == b else pickle.loads(two.column("g")[0].as_buffer())
        there, beam, least = p.linked(q.x, threshold)  # q's vectors in p's graph
        back, wide, low = (there, beam, least) if q is p else q.linked(p.x, threshold)
        i, j = both_ways(back, there)  # of p and of q
        other = p.ids[i] != q.ids[j]
        i, j = i[other], j[other]
        counts = [(p.ids, np.bincount(i, q.n[j], len(p.ids)))] + ([] if q is p else [(q.ids, np.bincount(j, p.n[i], len(q.ids)))])
        nodes = np.unique(np.concatenate([p.ids, q.ids]))
        forest = _joined(nodes, np.searchsorted(nodes, p.ids[i]), np.searchsorted(nodes, q.ids[j]))
        rows = [(x, m, None, None) for ids, c in counts for x, m in zip(ids.tolist(), c.astype(np.int64).tolist(), strict=True)]
        rows += [(x, 0, r, None) for x, r in forest] + [(None, 0, None, (str(label), s, b, max(beam, wide), min(least, low)))]
        columns = [[r[k] for r in rows] for k in range(3)] + [[r[3] and r[3][k] for r in rows] for k in range(5)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])

    keys = ("label", "dim", "s", "b")
    return reps, common.table(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _FOUND), n)


def audits(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", shard: int = SHARD) -> DataFrame:
    """label, s, b, beam, recall: for each two shards of a label the widest beam and the lowest recall of the audits."""
    found = _search(_usable(vectors, key, vector, label), threshold, shard, vectors.count())[1]
    return found.filter("node is null").select("label", "s", "b", "beam", "recall")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    rows, n = _usable(vectors, key, vector, label), vectors.count()
    reps, found = _search(rows, threshold, shard, n)
    groups = components(found.filter("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")), rows=n)
    counts = found.filter("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.select("k", "rep", "n").join(counts, counts["node"] == reps["rep"], "left").drop("node")
    known = common.cut(known.join(groups, groups["node"] == F.col("rep"), "left").select("k", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), n)
    out = rows.select("id", "k").join(known, "k", "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES = {"op1_embedding_near_dedup": op1}
SQL = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
r(node, reached) AS (
  SELECT a, a FROM (SELECT DISTINCT a FROM l) UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node),
n AS (SELECT a, count(DISTINCT b) AS links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.links, 0)::BIGINT AS n_links, coalesce(c.component, e.vec_id) AS component_id,
       coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
}
