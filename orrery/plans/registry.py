"""Queries of the vector engine over the `embeddings` table, and their SQL.

The query vector is that of vec_id 0. Oracle SQL folds in index order in double, as the engine does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.metrics import Metric, inner_product, vector_literal
from orrery.operators.bulk import bulk_distances, knn_join_expression
from orrery.operators.graph import GraphConfig, GraphIndex, recall
from orrery.operators.store import VectorStore
from orrery.sources.files import work_path
from orrery.sources.snapshot import Snapshot, load_graph, save_graph
from orrery.sources.vndb import open_vndb, write_vndb

K, DIM = 10, 64
METRICS = {"l2": Metric.L2, "cosine": Metric.COSINE, "dot": Metric.DOT}


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _store(spark, sf_dir, metric=Metric.L2):
    return VectorStore(_vectors(spark, sf_dir), DIM, metric)


def _query(spark, sf_dir):
    return _vectors(spark, sf_dir).where("id = 0").first()["vector"]


def _queries(spark, sf_dir):
    return _vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def _named(df):
    return df.withColumnRenamed("id", "vec_id")


def _index(spark, sf_dir, metric=Metric.L2, rows=None, room=None):
    """An index of rows (all of them, if none are given), with shards and capacity for `room` rows in all."""
    rows = _vectors(spark, sf_dir) if rows is None else rows
    n = rows.count() if room is None else room
    config = GraphConfig(DIM, metric, capacity=max(100_000, 2 * n), shards=GraphIndex.shards_for(n))
    return GraphIndex.build(rows, config).cached()


def _wide(index):
    """A beam as wide as the index: exact where every node can be reached."""
    return max(len(index), 1)


def _distance(metric):
    return lambda s, d: _named(_store(s, d, metric).distances(_query(s, d)))


def _knn(metric, k=K):
    return lambda s, d: _named(_store(s, d, metric).search(_query(s, d), k))


def _join(metric):
    return lambda s, d: _named(_store(s, d, metric).search_batch(_queries(s, d), K))


def _join_expression(s, d):
    return _named(knn_join_expression(_queries(s, d), _store(s, d).df, K, Metric.L2))


def _inner(s, d):
    return _named(_vectors(s, d).select("id", inner_product(vector_literal(_query(s, d)), "vector").alias("distance")))


def _added(s, d):
    base = _store(s, d).df
    store = VectorStore(base.where("id <> 7"), DIM)
    return _named(store.add(7, base.where("id = 7").first()["vector"]).search(_query(s, d), K))


def _added_batch(s, d):
    base = _store(s, d).df
    return _named(VectorStore(base.where("id % 3 <> 0"), DIM).add_batch(base.where("id % 3 = 0")).search(_query(s, d), K))


def _removed(s, d):
    store = _store(s, d).remove(0)
    return _named(store.remove_all(store.df.where("id % 5 = 0")).search(_query(s, d), K))


def _snapshot(s, d):
    path = work_path(s)
    Snapshot.write(_vectors(s, d), path, DIM)
    return Snapshot.open(s, path)


def _vndb(s, d):
    root = work_path(s)
    local = f"{root.removeprefix('file:')}.vndb" if root.startswith("file:/") and not root.startswith("file://") else f"{root}.vndb"
    write_vndb(_vectors(s, d), local, DIM)
    return _named(open_vndb(s, local).search(_query(s, d), K))


def _graph_knn(metric, exact=True):
    def run(s, d):
        index = _index(s, d, metric)
        return _named(index.search(_query(s, d), K, _wide(index) if exact else None))

    return run


def _graph_join(s, d):
    index = _index(s, d)
    return _named(index.search_batch(_queries(s, d), K, _wide(index)))


def _graph_saved(s, d):
    path = work_path(s)
    save_graph(_index(s, d), path)
    index = load_graph(s, path)
    return _named(index.search(_query(s, d), K, _wide(index)))


def _graph_added(s, d):
    rows = _vectors(s, d)
    index = _index(s, d, rows=rows.where("id < 300"), room=rows.count()).add_batch(rows.where("id >= 300")).cached()
    return _named(index.search(_query(s, d), K, _wide(index)))


def _graph_info(s, d):
    info = _index(s, d).info()
    keys = ("dim", "metric", "m", "m_max", "m_max0", "ef_construction", "ef_search", "seed", "size", "capacity")
    return s.createDataFrame([tuple(int(info[k]) for k in keys)], ", ".join(f"{k} bigint" for k in keys))


def _graph_recall(s, d):
    index = _index(s, d)
    share = recall(index.search_batch(_queries(s, d), K), _store(s, d).search_batch(_queries(s, d), K))
    return s.createDataFrame([(share >= 0.9,)], "recall_ok boolean")


def _get(of):
    return lambda s, d: of(s, d).lookup(3).select(F.posexplode("vector").alias("pos", "value")).select(F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))


def _contains(s, d):
    ids = s.range(0, 1000, 7).select("id")
    return _named(_store(s, d).contains_all(ids))


def _graph_contains(s, d):
    return _named(VectorStore(_index(s, d).nodes.select("id", "vector"), DIM).contains_all(s.range(0, 1000, 7).select("id")))


def queries():
    q = {}
    for name, m in METRICS.items():
        q |= {f"distance_{name}": _distance(m), f"knn_{name}": _knn(m), f"knn_join_{name}": _join(m), f"graph_knn_{name}": _graph_knn(m)}
    return q | {
        "knn_join_expression_l2": _join_expression,
        "inner_product": _inner,
        "distances_bulk": lambda s, d: _named(bulk_distances(_vectors(s, d), _query(s, d), Metric.L2)),
        "knn_k_gt_n": _knn(Metric.L2, 1_000_000),
        "store_get": _get(_store),
        "store_contains": _contains,
        "store_len": lambda s, d: _store(s, d).df.agg(F.count("*").alias("n")),
        "store_info": lambda s, d: s.createDataFrame([(_store(s, d).dimension, int(_store(s, d).metric))], "dim bigint, metric bigint"),
        "store_add_knn": _added,
        "store_add_batch_knn": _added_batch,
        "store_remove_knn": _removed,
        "snapshot_get": _get(_snapshot),
        "snapshot_roundtrip_knn": lambda s, d: _named(_snapshot(s, d).search(_query(s, d), K)),
        "vndb_roundtrip_knn": _vndb,
        "graph_knn_join_l2": _graph_join,
        "graph_save_load_knn": _graph_saved,
        "graph_add_batch_knn": _graph_added,
        "graph_get": _get(_index),
        "graph_contains": _graph_contains,
        "graph_info": _graph_info,
        "graph_recall": _graph_recall,
        "graph_knn_l2_ef50": _graph_knn(Metric.L2, exact=False),
        "graph_levels": lambda s, d: _index(s, d).nodes.groupBy("level").agg(F.count("*").alias("nodes")),
    }


def _fold(expr, a="q.v", b="e.embedding"):
    return f"list_reduce(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: {expr}), lambda x, y: x + y)"


_DOT = _fold("z[1] * z[2]")
_NORMS = f"({_fold('z[1] * z[2]', 'q.v', 'q.v')} * {_fold('z[1] * z[2]', 'e.embedding', 'e.embedding')})"
_SQL = {
    "l2": _fold("(z[1] - z[2]) * (z[1] - z[2])"),
    "dot": f"(-{_DOT} + 0.0::DOUBLE)",
    "cosine": f"CASE WHEN {_NORMS} < 1e-12 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_DOT} / sqrt({_NORMS}))) END",
}


def _all(name, where="true"):
    return f"SELECT e.vec_id, {_SQL[name]} AS distance FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q WHERE {where}"


def _top(name, k=K, where="true"):
    return f"SELECT * FROM ({_all(name, where)}) ORDER BY distance, vec_id LIMIT {k}"


def _join_sql(name):
    pairs = f"SELECT q.id AS query_id, e.vec_id, {_SQL[name]} AS distance FROM embeddings e, (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0) q"
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS BIGINT) AS rank FROM ({pairs})) WHERE rank <= {K}"


def oracle_sql():
    get = "SELECT CAST(i - 1 AS BIGINT) AS pos, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id = 3)"
    contains = "SELECT r.id AS vec_id, e.vec_id IS NOT NULL AS found FROM (SELECT unnest(range(0, 1000, 7)) AS id) r LEFT JOIN embeddings e ON e.vec_id = r.id"
    out = {}
    for name in METRICS:
        out |= {f"distance_{name}": _all(name), f"knn_{name}": _top(name), f"knn_join_{name}": _join_sql(name), f"graph_knn_{name}": _top(name)}
    return out | {
        "inner_product": f"SELECT e.vec_id, {_DOT} AS distance FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q",
        "distances_bulk": _all("l2"),
        "knn_k_gt_n": _all("l2"),
        "knn_join_expression_l2": _join_sql("l2"),
        "store_get": get,
        "snapshot_get": get,
        "graph_get": get,
        "store_contains": contains,
        "graph_contains": contains,
        "store_len": "SELECT count(*) AS n FROM embeddings",
        "store_info": "SELECT 64::BIGINT AS dim, 0::BIGINT AS metric",
        "store_add_knn": _top("l2"),
        "store_add_batch_knn": _top("l2"),
        "store_remove_knn": _top("l2", where="e.vec_id % 5 <> 0"),
        "snapshot_roundtrip_knn": _top("l2"),
        "vndb_roundtrip_knn": _top("l2"),
        "graph_knn_join_l2": _join_sql("l2"),
        "graph_save_load_knn": _top("l2"),
        "graph_add_batch_knn": _top("l2"),
        "graph_info": "SELECT 64::BIGINT AS dim, 0::BIGINT AS metric, 16::BIGINT AS m, 16::BIGINT AS m_max, 32::BIGINT AS m_max0, 200::BIGINT AS ef_construction, 50::BIGINT AS ef_search, 42::BIGINT AS seed, count(*) AS size, CAST(greatest(100000, 2 * count(*)) AS BIGINT) AS capacity FROM embeddings",
        "graph_recall": "SELECT true AS recall_ok",
    }
