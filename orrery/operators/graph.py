"""Approximate search by layered proximity graphs, one per shard, kept as an ordinary table.

A row of ids is hashed to a shard; a shard's graph is built by itself in insertion order (its rows have to
fit a worker; the number of shards grows with the rows). A search walks every shard's graph and merges the
candidates by (distance, id). What the graphs find is what is returned: there is no exact fallback.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.errors import DimensionMismatch, DuplicateId, IndexFull, InvalidParameter, NotFound
from orrery.functions.metrics import TINY, Metric, distances
from orrery.operators.bulk import Nearest, _near, each_block, matrix, ranked
from orrery.operators.validate import check_batch, check_dim, check_duplicates, check_query

NODES = "shard int, node int, ordinal bigint, id bigint, level int, vector array<float>, neighbors array<array<int>>"
MOST_LEVELS = 32
SHARD_ROWS = 50_000
#: Nodes inserted at once; nodes that they are compared to at once; pairs measured at once.
TILE, COLUMNS, PAIRS = 64, 4096, 4096


@dataclass(frozen=True)
class GraphConfig:
    """dim and metric; capacity in rows; m links per node and level (2m on the lowest); beam widths; seed."""

    dim: int
    metric: Metric = Metric.L2
    capacity: int = 100_000
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    seed: int = 42
    shards: int = 1

    def checked(self) -> GraphConfig:
        check_dim(self.dim)
        if self.capacity <= 0:
            raise InvalidParameter("capacity must be > 0")
        if self.m < 2:
            raise InvalidParameter("M must be >= 2")
        return replace(self, metric=Metric(self.metric), ef_construction=max(self.ef_construction, self.m))


def level_of(seed: int, ordinal: int, m: int) -> int:
    """A level with P(level >= L) = m ** -L, from a hash of seed and ordinal: no generator state to save."""
    x = (seed * 0x9E3779B97F4A7C15 + ordinal * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFFFFFFFFFF
    r = ((x ^ (x >> 31)) >> 11) / 2.0**53
    return min(MOST_LEVELS, int(-math.log(max(r, 1e-9)) / math.log(m)))


def _copies(vectors: np.ndarray) -> np.ndarray:
    """How many equal rows come before each."""
    flat = np.ascontiguousarray(vectors + 0.0)  # one zero
    same = np.unique(flat.view(np.dtype((np.void, flat.itemsize * flat.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.argsort(same, kind="stable")
    same = same[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.searchsorted(same, same)
    return out


def _near_each(metric: Metric, v: np.ndarray) -> np.ndarray:
    """Distances between the rows of each matrix of a stack, up to rounding."""
    product = v @ v.swapaxes(1, 2)
    if metric is Metric.DOT:
        return -product
    norms = np.einsum("ijk,ijk->ij", v, v)
    if metric is Metric.L2:
        product *= -2
        product += norms[:, :, None]
        product += norms[:, None]
        return np.maximum(product, 0, out=product)
    norms = norms[:, :, None] * norms[:, None]
    return np.where(norms < TINY, 1.0, 1 - np.clip(product / np.sqrt(np.maximum(norms, TINY)), -1, 1))


class ProximityGraph:
    """The graph of one shard."""

    def __init__(self, config: GraphConfig, rows: int):
        self.c, self.n, self.entry, self.top = config, 0, -1, -1
        self.vectors = np.zeros((rows, config.dim))
        self.levels, self.ids, self.ordinals = [], [], []
        self.links: list[list[list[int]]] = []
        self.seen, self.walks = np.zeros(rows, np.int64), 0  # the last walk that met each node

    def _to(self, q: np.ndarray, nodes) -> np.ndarray:
        v = self.vectors[nodes]
        if self.c.metric is Metric.L2:
            d = v - q
            return np.einsum("ij,ij->i", d, d)
        product = v @ q
        if self.c.metric is Metric.DOT:
            return -product
        norms = np.einsum("ij,ij->i", v, v) * (q @ q)
        return np.where(norms < TINY, 1.0, 1 - np.clip(product / np.sqrt(np.maximum(norms, TINY)), -1, 1))

    def _descend(self, q, node, near, high, low):
        """The nearest node that greedy steps reach on levels high to low + 1."""
        for level in range(high, low, -1):
            while (around := self.links[node][level]) and (d := self._to(q, around)).min() < near:
                i = int(d.argmin())
                node, near = around[i], float(d[i])
        return node, near

    def _beam(self, q, node, near, ef, level) -> list[tuple[float, int]]:
        """Up to ef nodes near q on a level, by (distance, node)."""
        self.walks += 1
        seen, walk = self.seen, self.walks
        seen[node] = walk
        todo, best = [(near, node)], [(-near, -node)]
        while todo:
            d, at = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            fresh = [x for x in self.links[at][level] if seen[x] != walk]
            if not fresh:
                continue
            seen[fresh] = walk
            for d, x in zip(self._to(q, fresh).tolist(), fresh, strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-d, -x))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, -x))
                else:
                    continue
                heapq.heappush(todo, (d, x))
        return sorted((-d, -x) for d, x in best)

    def extend(self, ids, vectors: np.ndarray) -> None:
        """Inserts rows one after the other; the same graph in one batch or in several.

        A node's candidates on a level are the ef_construction nearest of the earlier nodes there. As they don't
        depend on links, they are found by matrix products in tiles of bounded size, and links are made afterwards.
        On the lowest level a node's first link is its parent, an earlier node, and the two always keep their links
        to each other: every node can be reached from every other.
        """
        start, n = self.n, self.n + len(ids)
        if start == n:
            return
        self.n = n
        self.vectors[start:n] = vectors
        self.ids += [int(x) for x in ids]
        self.ordinals += range(start, n)
        self.levels += [level_of(self.c.seed, x, self.c.m) for x in range(start, n)]
        self.links += [[[] for _ in range(level + 1)] for level in self.levels[start:]]
        levels = np.array(self.levels)
        if self.entry < 0:
            self.entry, self.top = 0, self.levels[0]
        for node in (start + np.flatnonzero(levels[start:] > self.top)).tolist():
            if self.levels[node] > self.top:
                self.entry, self.top = node, self.levels[node]
        copy = _copies(self.vectors[:n])
        for level in range(levels[start:].max() + 1):
            there = np.flatnonzero(levels >= level)
            fresh = there[there >= max(start, 1)]
            may = there[copy[there] < self.c.ef_construction]  # a later copy is nobody's candidate: as many come before it
            touched = set()
            children = self._children(start) if level == 0 else None
            for a in range(0, len(fresh), TILE):
                part = fresh[a : a + TILE]
                found, d = self._candidates(part, may)
                chosen = self._diverse(found, d)
                for node, mine, all_ in zip(part.tolist(), chosen, found, strict=True):
                    if children is not None:
                        mine = self._with_parent(node, mine, all_, children)
                    self.links[node][level] = mine
                    for x in mine:
                        self.links[x][level].append(node)
                    touched.update(mine)
            cap = 2 * self.c.m if level == 0 else self.c.m
            for x in touched:
                if len(self.links[x][level]) > cap:
                    self.links[x][level] = self._pruned(x, level, cap)

    def _candidates(self, part: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node of part, by (distance, node), the ef_construction nearest of the earlier nodes in may; filled up with -1."""
        ef = self.c.ef_construction
        may = may[: np.searchsorted(may, part[-1])]
        near = np.concatenate([_near(self.c.metric, self.vectors[part], self.vectors[may[a : a + COLUMNS]]) for a in range(0, len(may), COLUMNS)], 1) if len(may) else np.zeros((len(part), 0))
        earlier = np.searchsorted(may, part)
        near[np.arange(len(may)) >= earlier[:, None]] = np.inf
        limit = np.partition(near, ef - 1, 1)[:, ef - 1] if len(may) > ef else np.full(len(part), np.inf)
        slack = 1e-9 * (1 + 2 * np.abs(self.vectors[: part[-1] + 1]).max() ** 2 * self.c.dim)
        row, col = np.nonzero(~(near > (limit + slack)[:, None]) & (np.arange(len(may)) < earlier[:, None]))
        d = np.concatenate([self._pairs(part[row[a : a + PAIRS]], may[col[a : a + PAIRS]]) for a in range(0, len(row), PAIRS)]) if len(row) else np.zeros(0)
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(part)))[row]
        keep = place < ef
        found, far = np.full((len(part), ef), -1), np.full((len(part), ef), np.inf)
        found[row[keep], place[keep]] = may[col[keep]]
        far[row[keep], place[keep]] = d[keep]
        return found, far

    def _pairs(self, a, b) -> np.ndarray:
        """Distances of paired nodes, the same in any batch."""
        return distances(self.c.metric, self.vectors[a], self.vectors[b])

    def _diverse(self, found: np.ndarray, d: np.ndarray) -> list[list[int]]:
        """m of the candidates of each row: those nearer to the new node than to any chosen one, then the nearest others."""
        m, rows = self.c.m, np.arange(len(found))
        there = found >= 0
        v = self.vectors[found]  # -1 reads some row; it is never alive
        left, apart = there.copy(), _near_each(self.c.metric, v)
        chosen = np.zeros_like(there)
        for _ in range(m):
            first = left.argmax(1)
            some = left[rows, first]
            if not some.any():
                break
            chosen[rows[some], first[some]] = True
            left[rows, first] = False
            left &= ~(apart[rows, first] < d) | ~some[:, None]
        rank = np.argsort(np.where(chosen, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :m]
        picked = np.where(there.sum(1)[:, None] <= m, found[:, :m], found[rows[:, None], rank])
        return [[x for x in row if x >= 0] for row in picked.tolist()]

    def _children(self, before: int) -> list[int]:
        """The number of children of each node, by the nodes before one."""
        return np.bincount([x[0][0] for x in self.links[1:before] if x[0]], minlength=self.n).tolist()

    def _with_parent(self, node: int, chosen: list[int], found: np.ndarray, children: list[int]) -> list[int]:
        """The links with the parent in front: the first of them, or else of all candidates, with fewer than m children; or else the node before."""
        parent = next((x for x in chosen if children[x] < self.c.m), None)
        if parent is None:
            parent = next((x for x in found.tolist() if x >= 0 and children[x] < self.c.m), node - 1)
        children[parent] += 1
        return [parent] + [x for x in chosen if x != parent][: self.c.m - 1]

    def _pruned(self, node: int, level: int, cap: int) -> list[int]:
        """A node's links, down to the nearest; on the lowest level its parent stays in front, and its children stay."""
        links = np.array(self.links[node][level])
        d = self._pairs(np.full(len(links), node), links)
        front = level == 0 and node > 0
        kept = np.zeros(len(links), bool)
        if level == 0:
            kept = np.array([x > node and self.links[x][0][0] == node for x in links.tolist()])
            kept[:1] |= front
        order = np.argsort(d, kind="stable")
        others = order[~kept[order]]
        kept[others[: max(0, cap - int(kept.sum()))]] = True
        order = order[kept[order]]
        if front:
            order = np.concatenate([[0], order[order != 0]])
        return links[order].tolist()

    def search(self, query, k: int, ef: int) -> list[tuple[int, float]]:
        """Up to k (id, distance), measured again in index order."""
        if self.entry < 0:
            return []
        q = np.asarray(query, np.float32).astype(float)
        at, near = self._descend(q, self.entry, float(self._to(q, [self.entry])[0]), self.top, 0)
        nodes = [x for _, x in self._beam(q, at, near, max(ef, k), 0)]
        exact = distances(self.c.metric, q, self.vectors[nodes])
        return sorted(((self.ids[x], float(d)) for x, d in zip(nodes, exact, strict=True)), key=lambda r: (r[1], r[0]))[:k]

    def reached(self, node: int, back: bool = False) -> np.ndarray:
        """Whether links of the lowest level lead from a node to each; back: from each to the node."""
        size = np.array([len(x[0]) for x in self.links])
        a, b = np.repeat(np.arange(self.n), size), np.fromiter((y for x in self.links for y in x[0]), np.int64, size.sum())
        if back:
            order = np.argsort(b, kind="stable")
            a, b = b[order], a[order]
        ends = np.searchsorted(a, np.arange(self.n + 1))
        seen, at = np.zeros(self.n, bool), np.array([node])
        seen[node] = True
        while len(at):
            size = ends[at + 1] - ends[at]
            around = b[np.repeat(ends[at] - (size.cumsum() - size), size) + np.arange(size.sum())]
            at = np.unique(around[~seen[around]])
            seen[at] = True
        return seen

    def search_all(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What `search` finds for each query with a beam as wide as the graph, as (place of the query, id, distance).

        Such a beam leaves out no node that its start leads to, so those are compared with all queries at once.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if self.entry < 0 or not len(queries):
            return none
        queries = np.asarray(queries, np.float32).astype(float)
        ids, start = np.array(self.ids), np.full(len(queries), self.entry)
        if not (self.reached(self.entry).all() and self.reached(self.entry, back=True).all()):  # a dump's graph may have parts
            start = np.array([self._descend(q, self.entry, float(self._to(q, [self.entry])[0]), self.top, 0)[0] for q in queries])
        out = [none]
        for node in np.unique(start):
            mine, nodes = np.flatnonzero(start == node), np.flatnonzero(self.reached(node))
            nearest = Nearest(self.c.metric, queries[mine], k)
            nearest.add(ids[nodes], self.vectors[nodes])
            row, found, d = nearest.rows()
            out.append((mine[row], found, d))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    @classmethod
    def load(cls, config: GraphConfig, rows: pa.Table, room: int = 0) -> ProximityGraph:
        rows = rows.sort_by("node").combine_chunks()
        g = cls(config, len(rows) + room)
        g.n = len(rows)
        if g.n:
            g.vectors[: g.n] = matrix(rows["vector"])
        g.levels, g.ids, g.ordinals = (rows[x].to_pylist() for x in ("level", "id", "ordinal"))
        lists = rows["neighbors"].combine_chunks()
        inner = lists.flatten()
        flat, ends = inner.flatten().to_pylist(), np.cumsum(inner.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        inner = [flat[a:b] for a, b in zip([0, *ends], ends)]
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        g.links = [inner[a:b] for a, b in zip([0, *ends], ends)]
        for i, level in enumerate(g.levels):  # the entry moves only to a strictly higher node
            if level > g.top:
                g.entry, g.top = i, level
        return g

    def rows(self, shard: int) -> pa.Table:
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(self.n + 1) * self.c.dim, pa.int32()), pa.array(self.vectors[: self.n].astype(np.float32).ravel()))
        whole = lambda x: pa.array(x, pa.int32())
        return pa.table({"shard": whole(np.full(self.n, shard)), "node": whole(np.arange(self.n)), "ordinal": pa.array(self.ordinals, pa.int64()), "id": pa.array(self.ids, pa.int64()), "level": whole(self.levels), "vector": vectors, "neighbors": pa.array(self.links, pa.list_(pa.list_(pa.int32())))})


def by_shard(nodes: DataFrame, config: GraphConfig) -> DataFrame:
    """Dealt so that every shard has a task of its own; by a hash some tasks would get several, others none."""
    return nodes.repartitionById(config.shards, F.col("shard"))


class GraphIndex:
    """An immutable index over its node table; add and add_batch return a new one."""

    def __init__(self, nodes: DataFrame, config: GraphConfig, next_ordinal: int):
        self.nodes, self.config, self.next_ordinal = nodes, config, next_ordinal

    @classmethod
    def empty(cls, spark, config: GraphConfig) -> GraphIndex:
        return cls(spark.createDataFrame([], NODES), config.checked(), 0)

    @classmethod
    def build(cls, batch: DataFrame, config: GraphConfig) -> GraphIndex:
        return cls.empty(batch.sparkSession, config).add_batch(batch)

    @staticmethod
    def shards_for(rows: int, least: int = 500, few: int = 8) -> int:
        """Shards of at least `least` rows, `few` of them until they hold SHARD_ROWS each; the same on any cluster."""
        return max(1, min(few, rows // least), -(-rows // SHARD_ROWS))

    def add(self, id: int, vector: Sequence[float]) -> GraphIndex:
        if len(vector) != self.config.dim:
            raise DimensionMismatch(self.config.dim, len(vector))
        if self.next_ordinal >= self.config.capacity:
            raise IndexFull
        if self.contains(id):
            raise DuplicateId(id)
        return self._grown(self.nodes.sparkSession.createDataFrame([(id, [float(x) for x in vector])], "id bigint, vector array<float>"), 1)

    def add_batch(self, batch: DataFrame) -> GraphIndex:
        """All rows of (id, vector) or none, inserted by ascending id after what is there."""
        batch = batch.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        n = check_batch(batch, self.config.dim)
        if self.next_ordinal + n > self.config.capacity:
            raise IndexFull
        check_duplicates(batch, self.nodes)
        return self._grown(batch, n) if n else self

    def _grown(self, batch: DataFrame, n: int) -> GraphIndex:
        config, start = self.config, self.next_ordinal
        shard = F.pmod(F.xxhash64("id"), F.lit(config.shards)).cast("int")
        new = batch.select(shard.alias("shard"), F.lit(-1).alias("node"), F.lit(-1).cast("bigint").alias("ordinal"), "id", F.lit(-1).alias("level"), "vector", F.lit(None).cast("array<array<int>>").alias("neighbors"))

        def grow(key: tuple, rows: pa.Table) -> pa.Table:
            old, fresh = rows.filter(pc.field("node") >= 0), rows.filter(pc.field("node") < 0).sort_by("id")
            g = ProximityGraph.load(config, old, len(fresh))
            if len(fresh):
                g.extend(fresh["id"].to_pylist(), matrix(fresh["vector"]))
            return g.rows(key[0].as_py())

        return GraphIndex(by_shard(self.nodes.unionByName(new), config).groupBy("shard").applyInArrow(grow, NODES), config, start + n)

    def cached(self) -> GraphIndex:
        """The index with its node table kept in memory or on disk, so that it is built once.

        It is dealt by shard before it is kept: a search reads every shard where it lies and shuffles no node.
        """
        return GraphIndex(by_shard(self.nodes, self.config).persist(), self.config, self.next_ordinal)

    def release(self) -> None:
        """Give up what `cached` keeps."""
        self.nodes.unpersist()

    def with_ef_search(self, ef: int) -> GraphIndex:
        return GraphIndex(self.nodes, replace(self.config, ef_search=ef), self.next_ordinal)

    def search(self, query: Sequence[float], k: int, ef: int | None = None) -> DataFrame:
        """Up to k (id, distance) by (distance, id)."""
        check_query(query, self.config.dim, k)
        sc = self.nodes.sparkSession.sparkContext
        return self._walk(sc.broadcast(np.zeros(1, np.int64)), sc.broadcast(np.array([query], float)), k, ef).select("id", "distance").orderBy("distance", "id").limit(k)

    def search_batch(self, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        """(query_id, id, distance, rank) for (query_id, vector), in blocks of bounded bytes."""
        check_batch(queries, self.config.dim)
        check_query([0.0] * self.config.dim, self.config.dim, k)
        return each_block(queries, lambda ids, q: ranked(self._walk(ids, q, k, ef), k))

    def _walk(self, ids, queries, k, ef) -> DataFrame:
        config, width = self.config, ef or self.config.ef_search

        def walk(rows: pa.Table) -> pa.Table:
            g = ProximityGraph.load(config, rows)
            if max(width, k) >= g.n:
                place, found, d = g.search_all(queries.value, k)
                return pa.table({"query_id": ids.value[place], "id": found, "distance": d})
            found = [(q, id, d) for q, v in zip(ids.value.tolist(), queries.value, strict=True) for id, d in g.search(v, k, width)]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            return pa.table({"query_id": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "distance": pa.array(columns[2], pa.float64())})

        return self.nodes.groupBy("shard").applyInArrow(walk, "query_id bigint, id bigint, distance double")

    def lookup(self, id: int) -> DataFrame:
        return self.nodes.where(F.col("id") == id).select("id", "vector")

    def contains(self, id: int) -> bool:
        return not self.lookup(id).isEmpty()

    def get_vector(self, id: int) -> list[float]:
        row = self.lookup(id).first()
        if row is None:
            raise NotFound(id)
        return list(row["vector"])

    def __len__(self) -> int:
        return self.next_ordinal

    def info(self) -> dict:
        c = asdict(self.config)
        return c | {"metric": int(c["metric"]), "m_max": c["m"], "m_max0": 2 * c["m"], "size": self.next_ordinal}


def recall(approximate: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, id) pairs that are found."""
    found = approximate.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    hits, n = exact.select("query_id", "id").join(found, ["query_id", "id"], "left").agg(F.count("hit"), F.count("*")).first()
    return hits / max(1, n)
