"""Durable read-only snapshots: a Parquet table and a metadata file that is written last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.errors import EngineIOError
from orrery.functions.metrics import Metric
from orrery.operators.graph import MOST_LEVELS, NODES, GraphConfig, GraphIndex
from orrery.operators.store import SCHEMA, VectorStore
from orrery.operators.validate import check_batch, check_dim, check_duplicates
from orrery.sources.files import delete, read_json, write_json

VERSION = 1


def _commit(df: DataFrame, path: str, meta: dict) -> None:
    spark = df.sparkSession
    data = f"data-{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{path}/{data}")
    except Exception:
        delete(spark, f"{path}/{data}")
        raise
    write_json(spark, f"{path}/snapshot.json", meta | {"version": VERSION, "data": data})


def _meta(spark: SparkSession, path: str, kind: str) -> dict:
    meta = read_json(spark, f"{path}/snapshot.json")
    if meta.get("kind") != kind:
        raise EngineIOError(f"not a {kind} snapshot")
    if meta.get("version") != VERSION:
        raise EngineIOError(f"unsupported version: {meta.get('version')}")
    return meta


class Snapshot:
    """Builder and reader of a store's snapshot."""

    @staticmethod
    def write(batch: DataFrame, path: str, dim: int, metric: Metric = Metric.L2) -> None:
        """Check (id, vector) and write it: ordered by id, so that a lookup reads few row groups."""
        check_dim(dim)
        n = check_batch(batch, dim)
        check_duplicates(batch, None)
        _commit(batch.select("id", "vector").repartitionByRange("id").sortWithinPartitions("id"), path, {"kind": "vectors", "dim": dim, "metric": int(metric), "n": n})

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorStore:
        meta = _meta(spark, path, "vectors")
        if meta["dim"] == 0 and meta["n"]:
            raise EngineIOError("dimension 0 with vectors")
        return VectorStore(spark.read.schema(SCHEMA).parquet(f"{path}/{meta['data']}"), meta["dim"], Metric.from_code(meta["metric"]))


def save_graph(index: GraphIndex, path: str) -> None:
    info = index.info()
    _commit(index.nodes, path, {"kind": "graph", **{k: info[k] for k in ("dim", "metric", "capacity", "m", "ef_construction", "ef_search", "seed", "shards")}, "count": index.next_ordinal})


def load_graph(spark: SparkSession, path: str) -> GraphIndex:
    """The index as saved; inserts go on as if it had never been saved. Broken tables are an I/O error."""
    meta = _meta(spark, path, "graph")
    nodes = spark.read.schema(NODES).parquet(f"{path}/{meta['data']}")
    config = GraphConfig(**{k: meta[k] for k in ("dim", "metric", "capacity", "m", "ef_construction", "ef_search", "seed", "shards")})
    Metric.from_code(meta["metric"])
    if config.dim == 0 or config.capacity == 0 or meta["count"] > config.capacity:
        raise EngineIOError("corrupt index header")
    per_shard = nodes.groupBy("shard").agg(F.count("*").alias("shard_rows"), F.max("node").alias("last_node"))
    checks = nodes.join(per_shard, "shard").selectExpr(
        "count(*) AS n",
        "count(DISTINCT id) AS ids",
        f"coalesce(max(level), 0) <= {MOST_LEVELS} AND coalesce(min(level), 0) >= 0 AS levels",
        f"coalesce(bool_and(size(vector) = {config.dim}), true) AS vectors",
        "coalesce(bool_and(size(neighbors) = level + 1), true) AS lists",
        "coalesce(bool_and(forall(flatten(neighbors), x -> x >= 0 AND x < shard_rows)), true) AS links",
        "coalesce(bool_and(last_node = shard_rows - 1), true) AS dense",
    ).first()
    if checks["n"] != meta["count"] or checks["ids"] != checks["n"]:
        raise EngineIOError("corrupt index: counts disagree")
    for what in ("levels", "vectors", "lists", "links", "dense"):
        if not checks[what]:
            raise EngineIOError(f"corrupt index: {what}")
    return GraphIndex(nodes, config.checked(), meta["count"])
