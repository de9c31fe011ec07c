"""k-nearest-neighbour joins: a stated set of queries against every row, in blocks.

Each task keeps the best k rows of every query of the block, so what is shuffled is queries x k x tasks
rows, never pairs. Candidates are picked by a matrix product and measured again in index order, so results
equal the SQL form's to the bit; every row within rounding of the k-th is kept until then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.metrics import TINY, Metric, cosine_of, distance, distances, inner_product
from orrery.sources.files import written

#: Bytes of query vectors that the driver holds and every executor gets at once; more queries are more blocks.
BLOCK_BYTES = 8 << 20
#: Vectors of more elements are compared as arrays. A pass of the join by expressions takes so many times the rows of the one before; the first has at most FEW x k.
MOST_UNROLLED, SHARE, FEW = 128, 16, 64
_PAIRS = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def matrix(column) -> np.ndarray:
    """A list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _near(metric, q, v):
    """Distances by matrix product: right up to rounding."""
    with np.errstate(all="ignore"):
        product = q @ v.T
        if metric is Metric.DOT:
            return -product
        qq, vv = (q * q).sum(1)[:, None], (v * v).sum(1)[None]
        if metric is Metric.L2:
            return np.maximum(qq + vv - 2 * product, 0)
        return np.where(qq * vv < 2 * TINY, 1.0, 1 - np.clip(product / np.sqrt(np.maximum(qq * vv, TINY)), -1, 1))


class Nearest:
    """The k nearest rows of every query, of rows that come in parts.

    Queries and rows meet in tiles of QUERIES x ROWS, so that memory doesn't depend on how many there are; beside
    them k rows a query are kept. In a tile the matrix product picks, by the k-th distance so far or the tile's own,
    and only what is picked is measured again.
    """

    QUERIES, ROWS, PAIRS = 512, 4096, 4096

    def __init__(self, metric: Metric, queries: np.ndarray, k: int):
        self.metric, self.k, self.q = metric, k, queries
        self.scale = 1 + np.abs(queries).max(initial=0) ** 2 * queries.shape[1]
        self.tiles = [_Tile(min(self.QUERIES, len(queries) - a)) for a in range(0, len(queries), self.QUERIES)]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(ids), self.ROWS):
            part, part_ids = vectors[a : a + self.ROWS], ids[a : a + self.ROWS]
            slack = 1e-9 * (self.scale + np.abs(part).max(initial=0) ** 2 * part.shape[1])
            for t, tile in enumerate(self.tiles):
                self._meet(tile, self.q[t * self.QUERIES : (t + 1) * self.QUERIES], part_ids, part, slack)

    def _meet(self, tile, q, ids, v, slack):
        near, limit = _near(self.metric, q, v), tile.kth
        if self.k < len(v) and not np.isfinite(limit).all():
            limit = np.fmin(limit, np.partition(near, self.k - 1, 1)[:, self.k - 1])
        row, col = np.nonzero(~(near > (limit + slack)[:, None]))
        if len(row):
            d = np.concatenate([distances(self.metric, q[row[a : a + self.PAIRS]], v[col[a : a + self.PAIRS]]) for a in range(0, len(row), self.PAIRS)])
            tile.put(row, ids[col], d, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, distance), by query and then by (distance, id)."""
        none = np.zeros(0, np.int64)
        parts = [(tile.row + t * self.QUERIES, tile.ids, tile.d) for t, tile in enumerate(self.tiles)] or [(none, none, np.zeros(0))]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class _Tile:
    """What some queries have found so far: rows by (query, distance, id), and the k-th distance where there are k."""

    def __init__(self, n: int):
        self.row, self.ids, self.d, self.kth = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(n, np.inf)

    def put(self, row, ids, d, k) -> None:
        row, ids, d = np.concatenate([self.row, row]), np.concatenate([self.ids, ids]), np.concatenate([self.d, d])
        order = np.lexsort((ids, d, row))
        row = row[order]
        first = np.searchsorted(row, np.arange(len(self.kth) + 1))
        place = np.arange(len(row)) - first[row]
        keep = place < k
        kth = np.flatnonzero(place == k - 1)
        d = d[order]
        self.kth[row[kth]] = d[kth]
        self.row, self.ids, self.d = row[keep], ids[order][keep], d[keep]


def _best(metric, ids, queries, k):
    def run(batches):
        nearest = Nearest(metric, queries.value, k)
        for batch in batches:
            for a in range(0, batch.num_rows, Nearest.ROWS):
                part = batch.slice(a, Nearest.ROWS)
                nearest.add(part.column(0).to_numpy(), matrix(part.column(1)))
        row, found, d = nearest.rows()
        for a in range(0, len(row), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(ids.value[row[a : a + 65_536]]), pa.array(found[a : a + 65_536]), pa.array(d[a : a + 65_536])], schema=_PAIRS)

    return run


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, id, distance) for each query, with their rank as BIGINT."""
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows by id over as many tasks as the cluster runs at once: every query meets every row, so work is far more than reading."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "id")


def in_blocks(queries: DataFrame, most: int = BLOCK_BYTES) -> list[DataFrame]:
    """(query_id, vector) in parts of about `most` bytes of doubles each."""
    queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"))
    one = queries.select(F.size("vector")).first()
    n = 1 if one is None else max(1, -(-queries.count() * one[0] * 8 // most))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def each_block(queries: DataFrame, join) -> DataFrame:
    """The union of join(ids, matrix) over blocks of queries.

    `join` takes two broadcasts. The driver holds one block at a time: with several, each one's result is
    written before the next block is fetched, and its broadcasts are freed.
    """
    sc, blocks, out = queries.sparkSession.sparkContext, in_blocks(queries), None
    for block in blocks:
        got = block.toArrow()
        shared = sc.broadcast(got.column(0).to_numpy()), sc.broadcast(matrix(got.column(1)))
        found = join(*shared)
        if len(blocks) > 1:
            found = written(found)
            for b in shared:
                b.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def knn_join(queries: DataFrame, base: DataFrame, k: int, metric: Metric) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of base (id, vector) for each query (query_id, vector)."""
    rows = spread(base.select(F.col("id").cast("bigint").alias("id"), "vector"))
    return each_block(queries, lambda ids, q: ranked(rows.mapInArrow(_best(metric, ids, q, k), "query_id bigint, id bigint, distance double"), k))


def _dimension(*tables: DataFrame) -> int | None:
    """The dimension that all vectors have, if they have one of at most MOST_UNROLLED and no element is null."""
    size = F.when(F.forall("vector", F.isnotnull), F.size("vector"))
    seen = [t.agg(F.min(size), F.max(size), F.count("*"), F.count(size)).first() for t in tables]
    sizes = {x for least, most, _, _ in seen for x in (least, most) if x is not None}
    return sizes.pop() if len(sizes) == 1 and max(sizes) <= MOST_UNROLLED and all(n == whole for _, _, n, whole in seen) else None


def _unrolled(rows: DataFrame, by: str, dim: int) -> DataFrame:
    """A column for each element, and the square of the norm; what the expressions over arrays compute, but compiled."""
    kept = [c for c in rows.columns if c != "vector"]
    elements = [F.coalesce(F.get("vector", F.lit(i)).cast("double"), F.lit(float("nan"))).alias(f"{by}{i}") for i in range(dim)]
    return rows.select(*kept, F.coalesce(inner_product("vector", "vector"), F.lit(float("nan"))).alias(f"{by}_norm"), *elements)


def _unrolled_distance(metric: Metric, dim: int):
    """`distance` between what `_unrolled` has made by "q" and by "v": the same terms in the same order."""
    term = (lambda x, y: (x - y) * (x - y)) if metric is Metric.L2 else (lambda x, y: x * y)
    total = F.lit(0.0)
    for i in range(dim):
        total = total + term(F.col(f"q{i}"), F.col(f"v{i}"))
    if metric is Metric.L2:
        return total
    return -total + F.lit(0.0) if metric is Metric.DOT else cosine_of(total, F.col("q_norm") * F.col("v_norm"))


def knn_join_expression(queries: DataFrame, base: DataFrame, k: int, metric: Metric) -> DataFrame:
    """The same by SQL expressions alone: each block of queries is sent to every task of base.

    Every pair is measured, but few are sorted: the k-th distance over a share of the rows bounds that over all of
    them, so a pass over a share precedes, and the next one drops in its join what is beyond the bound. The rank's
    limit is applied in every task before anything moves.
    """
    rows = base.select(F.col("id").cast("bigint").alias("id"), "vector")
    dim, shares = _dimension(queries, base), [1]
    if dim:
        far, rows = _unrolled_distance(metric, dim), _unrolled(rows, "v", dim)
    else:
        far = distance(metric, "__query", "vector")
    n = base.count()
    while n // shares[-1] > FEW * k:
        shares.append(shares[-1] * SHARE)
    rows, out = spread(rows), None
    for block in in_blocks(queries):
        block = _unrolled(block, "q", dim) if dim else block.withColumnRenamed("vector", "__query")
        bounded = block.withColumn("bound", F.lit(None).cast("double"))
        for share in reversed(shares):
            part = rows if share == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
            pairs = part.join(F.broadcast(bounded), F.lit(True)).withColumn("distance", far).where(F.coalesce(F.col("distance") <= F.col("bound"), F.lit(True)))
            found = ranked(pairs.select("query_id", "id", "distance"), k)
            if share > 1:
                bounded = block.join(written(found.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))), "query_id", "left")
        out = found if out is None else out.unionByName(found)
    return out


def bulk_distances(base: DataFrame, query, metric: Metric) -> DataFrame:
    """(id, distance) of one query to every row, by Arrow batches."""
    q = np.asarray(query, np.float32).astype(float)
    schema = pa.schema([("id", pa.int64()), ("distance", pa.float64())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(distances(metric, q, matrix(b.column(1))))], schema=schema)

    return base.select(F.col("id").cast("bigint"), "vector").mapInArrow(run, "id bigint, distance double")
