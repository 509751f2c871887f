"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Vectors are dealt into cells by the nearest of a few centroids, and cells over twice the intended size are split
by hash, so that no shard grows with the table. The task of a shard builds its graph in
flat neighbour arrays (one integer matrix for each layer). A query goes to the shards of the cells whose
centroids suit it best, and the shards' best are merged. Insertion and search go over whole batches of vectors
at once: a step takes the best open candidates of every vector in the batch and scores all their neighbours in
one matrix product.

How many cells a query visits is measured, not set: for a bounded sample of queries the exact neighbours among
all vectors are worked out, and as many cells are visited as it takes to hold ``CELL_RECALL`` of these. Where
vectors have no structure that comes to all cells, and the search is slow but not wrong.

Equal vectors are one node: only the ``k + 1`` smallest ids of each can be among the ``k`` nearest of
anything (ties go to the smaller id, and a query leaves out itself), so the rest is never needed and no
group of copies can shut itself off in the graph. Nearness is the inner product; graphs work in single
precision, everything that a search finds is scored in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import discard, materialize

K = 20
#: Different vectors that a cell is meant to hold; a shard holds at most twice as many (or, in tables that would have
#: more than ``MAX_CELLS`` cells, twice the mean of that many cells). 100,000 of 64 dimensions take about 120 MB.
CELL_VECTORS = 8192
#: Bounds the centroids, which every task that deals vectors out is given (8 MB at 64 dimensions).
MAX_CELLS = 16384
#: Rows that centroids are fitted on, and queries that the number of visited cells is measured on.
FIT_ROWS, FIT_QUERIES = 50_000, 200
CELL_RECALL = 0.985
M = 24
EF_CONSTRUCTION = 100
EF_SEARCH = 160
_BATCH = 512
_OPEN = 4


class Hnsw:
    """One shard's graph: ``near[layer]`` is a matrix of neighbours by node, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, m: int = M, ef: int = EF_CONSTRUCTION, seed: int = 7) -> None:
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        self.m, self.ef = m, ef
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 6)
        if n:
            self.level[0] = max(self.level.max(), 0)  # the entry point is on every layer
        self.near = [np.full((n, 2 * m if layer == 0 else m), -1, np.int32) for layer in range(int(self.level.max(initial=0)) + 1)]
        # The node that a search had found nearest when this one came; it keeps its link to it, so every node can be reached.
        self.parent = [np.full(n, -1, np.int32) for _ in self.near]
        done = 1
        while done < n:
            # A batch sees the graph that stood before it and, by one product, itself.
            stop = min(n, done + max(1, min(_BATCH, done)))
            self._insert(np.arange(done, stop))
            done = stop

    def _insert(self, nodes: np.ndarray) -> None:
        entry = np.zeros((len(nodes), 1), np.int32)
        own = self.x[nodes] @ self.x[nodes].T
        for layer in range(len(self.near) - 1, -1, -1):
            member = self.level[nodes] >= layer
            ids, _ = self._search(self.x[nodes], entry, layer, self.ef if member.any() else 8)
            entry = ids[:, : min(8, ids.shape[1])]
            if not member.any():
                continue
            at = np.flatnonzero(member)
            inside = own[np.ix_(at, at)]
            np.fill_diagonal(inside, -np.inf)
            width = min(self.ef, inside.shape[1])
            top = np.argpartition(-inside, width - 1, axis=1)[:, :width]
            pool = np.concatenate([ids[at], np.where(np.take_along_axis(inside, top, 1) > -np.inf, nodes[at][top], -1)], axis=1)
            chosen = self._diverse(nodes[at], pool, self.m)
            self.parent[layer][nodes[at]] = ids[at, 0]
            self._link(nodes[at], chosen, layer)

    def _scores(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        s = np.einsum("bd,bkd->bk", queries, self.x[ids], optimize=False) if ids.shape[1] < 4 else np.matmul(self.x[ids], queries[:, :, None])[:, :, 0]
        return np.where(ids >= 0, s, -np.inf)

    def _diverse(self, nodes: np.ndarray, pool: np.ndarray, most: int) -> np.ndarray:
        """Of each node's pool, nearest first, those that are nearer to the node than to any one taken before; then the nearest of the rest."""
        s = self._scores(self.x[nodes], pool)
        order = np.argsort(-s, axis=1, kind="stable")[:, : 3 * most]
        pool, s = np.take_along_axis(pool, order, 1), np.take_along_axis(s, order, 1)
        between = np.matmul(self.x[pool], self.x[pool].transpose(0, 2, 1))
        taken = np.zeros(pool.shape, bool)
        for j in range(pool.shape[1]):
            blocked = (taken & (between[:, j] > s[:, j : j + 1])).any(axis=1)
            taken[:, j] = ~blocked & (s[:, j] > -np.inf)
        rank = np.argsort(~taken * 1e3 - np.where(s > -np.inf, s, -1e6), axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(s, rank, 1) > -np.inf, np.take_along_axis(pool, rank, 1), -1)

    def _link(self, nodes: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        near = self.near[layer]
        near[nodes, : chosen.shape[1]] = chosen
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        source, target = np.r_[source[target >= 0], nodes], np.r_[target[target >= 0], self.parent[layer][nodes]]
        # Links back: each target's old and new neighbours, the nearest of which stay.
        touched = np.unique(target)
        old = near[touched]
        have = old >= 0
        a = np.concatenate([np.repeat(touched, have.sum(axis=1)), target])
        b = np.concatenate([old[have], source])
        a, b = np.unique(np.stack([a, b], 1), axis=0).T
        s = np.einsum("nd,nd->n", self.x[a], self.x[b]) + 4 * (self.parent[layer][b] == a) * np.abs(self.x[a]).sum(axis=1) * np.abs(self.x[b]).max(axis=1)
        order = np.lexsort((-s, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        stay = rank < near.shape[1]
        near[touched] = -1
        near[a[stay], rank[stay]] = b[stay]

    def _search(self, queries: np.ndarray, entry: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest found of each query, nearest first, and their scores."""
        n, near = len(queries), self.near[layer]
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column takes what is no node
        ids = entry.astype(np.int32)
        seen[rows, ids] = True
        score = self._scores(queries, ids)
        closed = np.zeros(ids.shape, bool)
        alive = np.arange(n)
        best_ids, best_score = np.full((n, ef), -1, np.int32), np.full((n, ef), -np.inf, np.float32)
        while len(alive):
            open_score = np.where(closed, -np.inf, score)
            width = min(_OPEN, ids.shape[1])
            pick = np.argpartition(-open_score, width - 1, axis=1)[:, :width]
            going = np.take_along_axis(open_score, pick, 1) > -np.inf
            np.put_along_axis(closed, pick, True, 1)
            found = np.where(going[:, :, None], near[np.take_along_axis(ids, pick, 1)], -1).reshape(len(alive), -1)
            found = np.where(seen[alive[:, None], found], -1, found)
            seen[alive[:, None], found] = True
            seen[:, -1] = False
            # The same node from two picks counts once.
            found = -np.sort(-found, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found = -np.sort(-found, axis=1)
            keep = int((found >= 0).sum(axis=1).max(initial=0))
            found = found[:, :keep]
            all_ids = np.concatenate([ids, found], 1)
            all_score = np.concatenate([score, self._scores(queries[alive], found)], 1) if keep else score
            all_closed = np.concatenate([closed, np.zeros(found.shape, bool)], 1)
            if all_ids.shape[1] > ef:
                top = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
                all_ids, all_score, all_closed = (np.take_along_axis(v, top, 1) for v in (all_ids, all_score, all_closed))
            ids, score, closed = all_ids, all_score, all_closed
            over = ~((~closed) & (score > -np.inf)).any(axis=1)
            if over.any():
                best_ids[alive[over], : ids.shape[1]], best_score[alive[over], : ids.shape[1]] = ids[over], score[over]
                alive, ids, score, closed = alive[~over], ids[~over], score[~over], closed[~over]
        best_ids[best_score == -np.inf] = -1
        order = np.argsort(-best_score, axis=1, kind="stable")
        return np.take_along_axis(best_ids, order, 1), np.take_along_axis(best_score, order, 1)

    def nearest(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """Node numbers of the ``ef`` nearest found of each query, -1 where there are fewer."""
        out = []
        for i in range(0, len(queries), _BATCH):
            q = np.ascontiguousarray(queries[i : i + _BATCH], np.float32)
            entry = np.zeros((len(q), 1), np.int32)
            for layer in range(len(self.near) - 1, 0, -1):
                entry = self._search(q, entry, layer, 8)[0][:, :1]
            out.append(self._search(q, entry, 0, ef)[0])
        return np.concatenate(out) if out else np.zeros((0, ef), np.int32)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part: not null, not zero, every component finite."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return x.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))


def _places(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` cells that suit each vector best, best first."""
    out = np.zeros((len(vectors), n), np.int64)
    for i in range(0, len(vectors), 512):  # bounds the matrix of scores
        s = vectors[i : i + 512] @ centroids.T
        out[i : i + 512] = s.argmax(axis=1)[:, None] if n == 1 else np.argsort(-s, axis=1, kind="stable")[:, :n]
    return out


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Directions of ``cells`` centroids: means of what lies nearest by angle, worked out on ``sample``."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    at = x[np.random.default_rng(5).permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = _places(x, at, 1)[:, 0]
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), at)
    return at


def _dealt(batches: Iterator[pd.DataFrame], centroids: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    """Nodes with the cell that each belongs to."""
    for batch in batches:
        cell = np.zeros(len(batch), np.int64)
        for dim, rows in batch.reset_index(drop=True).groupby(batch["v"].map(len).to_numpy()):
            v = np.stack(rows["v"].to_numpy())
            scale = np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows
            cell[rows.index] = _places(v / scale, centroids[dim], 1)[:, 0]
        yield batch.assign(cell=cell)


def _truth(batches: Iterator[pd.DataFrame], queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pd.DataFrame]:
    """The ``k`` nearest of each sampled query among the nodes of this task, by dimension."""
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for dim, rows in batch.groupby(batch["v"].map(len).to_numpy()):
            own, q = queries[dim]
            s = q @ np.stack(rows["v"].to_numpy()).T
            s[own[:, None] == rows["first"].to_numpy()[None, :]] = -np.inf
            c = np.broadcast_to(rows["cell"].to_numpy(), s.shape)
            if dim in best:
                s, c = np.concatenate([best[dim][0], s], 1), np.concatenate([best[dim][1], c], 1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            best[dim] = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
    for dim, (s, c) in best.items():
        q = np.repeat(np.arange(len(s)), s.shape[1])
        ok = s.ravel() > -np.inf
        yield pd.DataFrame({"dim": dim, "q": q, "score": s.ravel(), "cell": c.ravel()})[ok]


def _fit(nodes: DataFrame, k: int, cell_vectors: int) -> tuple[dict[int, np.ndarray], dict[int, tuple[np.ndarray, np.ndarray]], dict[int, int]]:
    """By dimension: centroids, sampled queries (their ids and vectors) and the most vectors to a shard."""
    sizes = {r.dim: r["count"] for r in nodes.groupBy(F.size("v").alias("dim")).count().collect()}
    centroids, queries, most = {}, {}, {}
    for dim, n in sizes.items():
        cells = min(MAX_CELLS, -(-n // cell_vectors))
        of_dim = nodes.where(F.size("v") == dim)
        every = max(1, n // FIT_ROWS)
        # Least hashes of the ids: a fixed sample, bounded by its limit.
        drawn = of_dim.where(F.pmod(F.xxhash64("first"), F.lit(every)) == 0).orderBy(F.xxhash64("first"), "first").limit(FIT_ROWS).select("first", "v").collect()
        v = np.array([r.v for r in drawn])
        scaled = v / np.abs(v).max(axis=1, keepdims=True)
        centroids[dim] = fit_centroids(scaled, cells)
        queries[dim] = np.array([r["first"] for r in drawn[:FIT_QUERIES]], np.int64), v[:FIT_QUERIES]
        most[dim] = 2 * max(cell_vectors, -(-n // MAX_CELLS))
    return centroids, queries, most


def _visits(nodes: DataFrame, centroids: dict[int, np.ndarray], queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> dict[int, int]:
    """By dimension: how many cells hold ``CELL_RECALL`` of the exact neighbours of the sampled queries."""
    found = nodes.mapInPandas(lambda it: _truth(it, queries, k), "dim int, q long, score double, cell long")
    nearest = Window.partitionBy("dim", "q").orderBy(F.col("score").desc(), "cell")
    # At most FIT_QUERIES times k rows for each dimension.
    rows = found.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k).select("dim", "q", "cell").toPandas()
    out = {}
    for dim, c in centroids.items():
        order = _places(queries[dim][1], c, len(c))
        place = np.argsort(order, axis=1)
        mine = rows[rows["dim"] == dim]
        at = np.sort(place[mine["q"].to_numpy(int), mine["cell"].to_numpy(int)])
        out[dim] = int(at[int(np.ceil(CELL_RECALL * len(at))) - 1]) + 1 if len(at) else len(c)
    return out


_INDEX = "shard long, dim int, n int, ids array<array<long>>, vectors binary, level binary, near array<binary>"


def _build(rows: pd.DataFrame, m: int, ef: int) -> pd.DataFrame:
    rows = rows.sort_values("first")
    v = np.stack(rows["v"].to_numpy())
    g = Hnsw(v.astype(np.float32), m, ef)
    one = {"shard": rows["shard"].iloc[0], "dim": v.shape[1], "n": len(v), "ids": [list(map(list, rows["ids"]))], "vectors": v.astype("<f8").tobytes(), "level": g.level.astype("<i4").tobytes(), "near": [[x.astype("<i4").tobytes() for x in g.near]]}
    return pd.DataFrame(one)


@dataclass
class Index:
    """A written index: ``graphs`` has one row for each shard with its flat arrays; the rest says where a query goes."""

    graphs: DataFrame
    centroids: dict[int, np.ndarray]
    shards: dict[int, list[list[int]]]
    visits: dict[int, int]


def build_index(vectors: DataFrame, k: int = K, m: int = M, ef: int = EF_CONSTRUCTION, cell_vectors: int = CELL_VECTORS) -> Index:
    """``vectors`` is what ``usable`` returns. Every vector is indexed; equal ones share a node that holds their ``k + 1`` smallest ids."""
    first = Window.partitionBy("v").orderBy("id")
    # The limit on the rank is applied in the map tasks already, so a group of copies never travels whole.
    ranked = vectors.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    nodes = ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("first"))
    nodes = materialize(nodes, "nodes")
    centroids, queries, most = _fit(nodes, k, cell_vectors)
    dealt = materialize(nodes.mapInPandas(lambda it: _dealt(it, centroids), "v array<double>, ids array<long>, first long, cell long"), "dealt")
    discard(nodes)
    # One row for each cell, of which there are at most MAX_CELLS.
    numbers, shards = [], {dim: [[] for _ in c] for dim, c in centroids.items()}
    for r in sorted(dealt.groupBy(F.size("v").alias("dim"), "cell").count().collect()):
        parts = -(-r["count"] // most[r.dim])
        start = numbers[-1][2] + numbers[-1][3] if numbers else 0
        numbers.append((r.dim, r.cell, start, parts))
        shards[r.dim][r.cell] = list(range(start, start + parts))
    spark = vectors.sparkSession
    at = spark.createDataFrame(numbers, "c_dim int, c_cell long, start long, parts int")
    placed = dealt.join(F.broadcast(at), (F.size("v") == F.col("c_dim")) & (F.col("cell") == F.col("c_cell")))
    placed = placed.select("v", "ids", "first", (F.col("start") + F.pmod(F.xxhash64("first"), F.col("parts"))).alias("shard"))
    graphs = materialize(placed.groupBy("shard").applyInPandas(lambda rows: _build(rows, m, ef), _INDEX), "graphs")
    visits = _visits(dealt, centroids, queries, k)
    discard(dealt)
    return Index(graphs, centroids, shards, visits)


class _Shard:
    """A graph read back from its flat arrays."""

    def __init__(self, row) -> None:
        n = int(row.n)
        self.ids = [np.asarray(x, np.int64) for x in row.ids]
        self.exact = np.frombuffer(row.vectors, "<f8").reshape(n, int(row.dim))
        g = self.graph = Hnsw.__new__(Hnsw)
        g.x = self.exact.astype(np.float32)
        g.near = [np.frombuffer(b, "<i4").reshape(n, -1) for b in row.near]

    def answer(self, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> tuple[list, list, list]:
        found = self.graph.nearest(queries, max(ef, k + 1))
        owners, ids, scores = [], [], []
        for own, q, nodes in zip(query_ids.tolist(), queries, found, strict=True):
            nodes = nodes[nodes >= 0]
            s = self.exact[nodes] @ q
            order = np.argsort(-s, kind="stable")
            # The nodes that can hold the k nearest: the first k + 1, and what ties with the last of them.
            order = order[s[order] >= s[order[min(k, len(order) - 1)]]]
            best = sorted((-x, i) for x, node in zip(s[order].tolist(), nodes[order].tolist(), strict=True) for i in self.ids[node].tolist() if i != own)
            best = sorted((x, i) for i, x in dict((i, x) for x, i in reversed(best)).items())[:k]  # an id once, at its best
            owners += [own] * len(best)
            ids += [i for _, i in best]
            scores += [-x for x, _ in best]
        return owners, ids, scores


def _answer(batches: Iterator[pd.DataFrame], k: int, ef: int) -> Iterator[pd.DataFrame]:
    """Graph rows come before the queries of their place; only one graph is held."""
    held, shard = None, None
    for batch in batches:
        for place, rows in batch.groupby("place", sort=True):
            graph = rows[rows["n"].notna()]
            if len(graph):
                held, shard = None, None
                held, shard = _Shard(graph.iloc[0]), place
            asked = rows[rows["n"].isna()]
            if len(asked) and held is not None and shard == place:
                owners, ids, scores = held.answer(asked["query_id"].to_numpy(np.int64), np.stack(asked["v"].to_numpy()), k, ef)
                yield pd.DataFrame({"query_id": owners, "vec_id": ids, "score": scores})


def _routed(batches: Iterator[pd.DataFrame], index: Index) -> Iterator[pd.DataFrame]:
    """One row for each query and shard that it visits."""
    for batch in batches:
        ids, vs, places = [], [], []
        for dim, rows in batch.groupby(batch["v"].map(len).to_numpy()):
            v = np.stack(rows["v"].to_numpy())
            cells = _places(v / np.abs(v).max(axis=1, keepdims=True), index.centroids[dim], index.visits[dim])
            for own, vector, mine in zip(rows["id"].tolist(), rows["v"], cells.tolist(), strict=True):
                at = [s for c in mine for s in index.shards[dim][c]]
                ids += [own] * len(at)
                vs += [vector] * len(at)
                places += at
        yield pd.DataFrame({"shard": pd.array(places, "int64"), "query_id": pd.array(ids, "int64"), "v": vs})


#: Queries that one task answers; a shard's graph is sent to as many tasks as that takes.
TASK_QUERIES = 50_000


def nearest(vectors: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", m: int = M, ef_construction: int = EF_CONSTRUCTION, ef: int = EF_SEARCH, cell_vectors: int = CELL_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every vector whose id is divisible by ``every``.

    The query itself is left out; there are fewer rows where there are fewer candidates. Ties go to the
    smaller id. Vectors that are null, zero or hold a null or non-finite component, and rows with a null
    id, take no part; vectors of another dimension are no candidates. Repeated rows count once. An id with
    several vectors is found, and asks, by each of them, and every other id counts once, at its best. An
    empty table gives an empty result.
    """
    x = usable(vectors, id_col, vector_col)
    index = build_index(x, k, m, ef_construction, cell_vectors)
    route = Index(None, index.centroids, index.shards, index.visits)
    queries = x.where(F.col("id") % every == 0).distinct()
    asked = materialize(queries.mapInPandas(lambda it: _routed(it, route), "shard long, query_id long, v array<double>"), "asked")
    # A shard with many queries is answered by several tasks, each with a copy of its graph.
    copies = asked.groupBy(F.col("shard").alias("s")).agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).cast("int").alias("copies"))
    placed = asked.join(copies, F.col("shard") == F.col("s")).select(F.struct("shard", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int").alias("copy")).alias("at"), "query_id", "v")
    graphs = index.graphs.join(copies, F.col("shard") == F.col("s")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    graphs = graphs.select(F.struct("shard", "copy").alias("at"), *[c.split()[0] for c in _INDEX.split(", ")[1:]])
    both = graphs.unionByName(placed, allowMissingColumns=True).withColumn("place", F.concat_ws("/", "at.shard", "at.copy")).drop("at")
    shards = sum(len(s) for cells in index.shards.values() for s in cells)
    both = both.repartition(max(1, shards), "place").sortWithinPartitions("place", F.col("n").isNull())
    found = both.mapInPandas(lambda it: _answer(it, k, ef), "query_id long, vec_id long, score double").repartition("query_id")
    once = Window.partitionBy("query_id", "vec_id").orderBy(F.col("score").desc())
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("again", F.row_number().over(once)).where(F.col("again") == 1)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
