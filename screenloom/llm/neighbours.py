"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the neighbour graph is cut into balanced partitions, and a small network
learns from a vector in which partitions its neighbours lie. Every row is then indexed in the
partition that the network holds most probable, and a query is sent to the several most
probable ones; their rows are ranked by the exact inner product in double precision. The
number of partitions tried is measured, not guessed: one pass over the index finds the true
neighbours of ``PROBES`` queries among all rows, and the least number of partitions that holds
``TARGET`` of them is taken for all queries. The number of partitions grows with the square
root of the table up to ``MOST``; larger partitions are ranked in more blocks.

Of equal vectors, only the first K + 1 by id can be among K nearest; the others are never
candidates, which is exact, and keeps a vector that fills much of the table harmless.

Vectors of one length meet those of the same length only, as no inner product joins two lengths:
every length with more than ``RARE`` rows has a router and an index of its own; the rows of a rarer
length are one partition, ranked whole against the queries of that length, which is exact.

Defined cases: null or zero vectors and those with null or non-finite components take no part;
of rows that repeat an id one counts, that of the smallest vector, as query and as candidate; ties
go to the smaller id; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenloom.llm.common import scratch, staged

K = 20
#: Sample vectors of a partition; partitions are the table's square root over SHRINK, MOST at most.
SAMPLE_PART, SHRINK, MOST = 128, 8, 128
GRAPH = 16
HIDDEN = 128
#: Share of true neighbours to find, and how many queries it is measured on.
TARGET, PROBES = 0.92, 512
#: Rows of a block of the ranking, on either side.
BLOCK = 8192
#: A length of vectors with more rows gets an index, and so does the commonest.
RARE = 16_384


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of every row by inner product."""
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Parts of near equal size that cut few edges.

    Starts from nearest seeds filled up to capacity, then moves the vertices that gain most
    edges to parts with room, round by round.
    """
    n = len(x)
    room = int(np.ceil(1.05 * n / parts))
    label = np.full(n, -1)
    seeds = x[rng.choice(n, parts, replace=False)]
    order = np.argsort(-(x @ seeds.T), axis=1)
    size = np.zeros(parts, np.int64)
    for v in rng.permutation(n):
        for p in order[v]:
            if size[p] < room:
                label[v], size[p] = p, size[p] + 1
                break
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    for _ in range(30):
        count = np.bincount(src * parts + label[dst], minlength=n * parts).reshape(n, parts)
        best = count.argmax(axis=1)
        gain = count[np.arange(n), best] - count[np.arange(n), label]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if best[v] != label[v] and size[best[v]] < room:
                size[label[v]] -= 1
                size[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if moved < n // 500 + 1:
            break
    return label


class Router:
    """A network of one hidden layer from a vector to the probability of each partition."""

    def __init__(self, dim: int, parts: int, rng: np.random.Generator):
        self.shift, self.scale = np.zeros(dim), 1.0
        self.w = [rng.normal(0, np.sqrt(2 / dim), (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return h, e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.shift) * self.scale)[1]

    def fit(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 40, rate: float = 2e-3) -> None:
        """Cross entropy against the share of neighbours in each partition, by Adam."""
        self.shift, self.scale = x.mean(axis=0), 1 / max(float(x.std()), 1e-12)
        x = (x - self.shift) * self.scale
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 256):
                at = order[a : a + 256]
                h, p = self._forward(x[at])
                dz = (p - target[at]) / len(at)
                dh = (dz @ self.w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((x[at].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                    g = g + 1e-4 * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def fit(sample: np.ndarray, parts: int, seed: int = 7) -> Router:
    """A router to ``parts`` balanced partitions of a sample of distinct vectors' neighbour graph."""
    rng = np.random.default_rng(seed)
    n = len(sample)
    router = Router(sample.shape[1], parts, rng)
    if parts > 1:
        graph = neighbour_graph(sample, min(GRAPH, n - 1))
        label = balanced_partitions(sample, graph, parts, rng)
        share = np.zeros((n, parts))
        np.add.at(share, (np.arange(n)[:, None], label[graph]), 1.0)
        router.fit(sample, share / share.sum(axis=1, keepdims=True), rng)
    return router


def neighbour_parts(index: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(id, v, part) -> probe, part: where each given query's k true neighbours lie among all rows.

    A task keeps its k best of every query only, so k rows a query and task are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, part = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int32)
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, q.shape[1])
            own, to = b.column("id").to_numpy(), b.column("part").to_numpy()
            for a in range(0, len(x), 2048):
                s = q @ x[a : a + 2048].T
                s[ids[:, None] == own[a : a + 2048]] = -np.inf
                s = np.concatenate([score, s], axis=1)
                p = np.concatenate([part, np.broadcast_to(to[a : a + 2048], (len(q), s.shape[1] - k))], axis=1)
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                score, part = np.take_along_axis(s, best, axis=1), np.take_along_axis(p, best, axis=1)
        probe, at = np.nonzero(np.isfinite(score))
        yield pa.record_batch([pa.array(probe.astype(np.int32)), pa.array(score[probe, at]), pa.array(part[probe, at])], names=["probe", "score", "part"])

    near = index.mapInArrow(run, "probe int, score double, part int")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "part")
    return near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select("probe", "part")


def least_tries(router: Router, index: DataFrame, asked: DataFrame, k: int) -> int:
    """The least number of partitions to try that finds TARGET of the neighbours of some queries."""
    parts = len(router.w[3])
    # the sample takes the first ids by hash, these the last
    probes = asked.select("id", "v").orderBy(F.desc(F.xxhash64("id")), "id").limit(PROBES).collect() if parts > 1 else []
    if not probes:
        return 1
    q = np.array([r.v for r in probes])
    near = neighbour_parts(index, np.array([r.id for r in probes]), q, k).collect()  # PROBES * k rows at most
    if not near:
        return parts
    place = np.argsort(np.argsort(-router.probabilities(q), axis=1, kind="stable"), axis=1)
    needed = np.sort([place[r.probe, r.part] + 1 for r in near])
    return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))) - 1)])


def vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (double) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(F.coalesce(fine, F.lit(False)))


def rank_block(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """Each query's k nearest of a block; equal vectors score equally wherever they stand."""
    out = []
    for a in range(0, len(q), 512):
        scores = q[a : a + 512] @ x.T
        keep = min(k + 1, len(ids))
        least = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
        for i in range(len(scores)):
            near = np.flatnonzero(scores[i] >= least[i] - 1e-9 * max(1.0, abs(least[i])))
            near = near[ids[near] != query_ids[a + i]]
            exact = (x[near] * q[a + i]).sum(axis=1)
            best = np.lexsort((ids[near], -exact))[:k]
            out.append((np.full(len(best), query_ids[a + i]), ids[near][best], exact[best]))
    return out


def one_a_row(rows: DataFrame) -> DataFrame:
    """Of rows that repeat an id, the smallest vector."""
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def routed(rows: DataFrame, router: Router, dim: int, several: int) -> DataFrame:
    """(id, v) of one length to id, v, dim, part: a row for each of the most probable partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            p = router.probabilities(x) if b.num_rows else np.zeros((0, 1))
            to = np.argsort(-p, axis=1, kind="stable")[:, :several]
            at = pa.array(np.repeat(np.arange(b.num_rows), to.shape[1]))
            yield pa.record_batch(
                [b.column("id").take(at), b.column("v").take(at), pa.array(np.full(len(at), dim, np.int32)), pa.array(to.ravel().astype(np.int32))],
                names=["id", "v", "dim", "part"],
            )

    return rows.mapInArrow(run, "id long, v array<double>, dim int, part int")


def placed(rows: DataFrame, asked: DataFrame, dim: int, n: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows and queries of a length in their partitions, by a router that is fitted to the length."""
    rows, asked = rows.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    parts = int(max(1, min(MOST, n**0.5 / SHRINK)))
    sample = rows.filter("copy = 1").orderBy(F.xxhash64("id"), "id").limit(parts * SAMPLE_PART).select("v").collect()
    sample = np.array([r.v for r in sample])
    router = fit(sample, max(1, min(parts, len(sample) // 64)))
    index = staged(routed(rows.select("id", "v"), router, dim, 1), "index")
    return index, routed(asked, router, dim, least_tries(router, index, asked, k))


def search(df: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding", rare: int = RARE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest rows but itself, nearest first; staged."""
    with scratch(df.sparkSession) as keep:
        equal = Window.partitionBy("v").orderBy("id")
        rows = one_a_row(vectors(df, id_col, vector)).withColumn("copy", F.row_number().over(equal)).filter(F.col("copy") <= k + 1)
        rows, asked = staged(rows, "vectors"), staged(one_a_row(vectors(queries, id_col, vector)), "asked")
        lengths = sorted(((r.n, r.dim) for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        whole = lambda d: d.withColumn("dim", F.size("v")).withColumn("part", F.lit(0)).select("id", "v", "dim", "part")
        common = [dim for i, (n, dim) in enumerate(lengths) if n > rare or not i]
        other = ~F.size("v").isin(common) if common else F.lit(True)
        index, tried = whole(rows.filter(other)), whole(asked.filter(other))
        for n, dim in lengths:
            if dim in common:
                a, b = placed(rows, asked, dim, n, k)
                index, tried = index.union(a), tried.union(b)
        return keep(ranked(index, staged(tried, "routed"), k), "nearest")


def ranked(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Blocks of a partition's rows against blocks of its queries: (dim, part, row block, query block)."""
    own = ["dim", "part"]
    count = lambda d, c: d.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(c))
    blocks = count(index, "nr").join(count(asked, "nq"), own)  # one row a partition
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(F.broadcast(blocks), own).select(*own, block("nr").alias("r"), every_block("nq").alias("q"), "id", "v")
    right = asked.join(F.broadcast(blocks), own).select(*own, every_block("nr").alias("r"), block("nq").alias("q"), "id", "v")

    def best(rows_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        if rows_.empty or asked_.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = rank_block(asked_["id"].to_numpy(), np.stack(asked_["v"].to_list()), rows_["id"].to_numpy(), np.stack(rows_["v"].to_list()), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    key = [*own, "r", "q"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    nth = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return nth.select("query_id", "rank", "vec_id", "score")
