"""Feeding a store from a stream: each micro-batch is a checked, all-or-nothing add_batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orrery.functions.metrics import Metric
from orrery.operators.store import SCHEMA, VectorStore
from orrery.sources.files import delete, read_all_json, write_json


class SnapshotSink:
    """`stream.writeStream.foreachBatch(SnapshotSink(path, dim))`: a batch is one more segment of files.

    A segment counts once a commit file of its batch names it, so that readers see all of a batch or none of it.
    What was there before is never written again; of it only the ids are read, to
    find duplicates. A batch that was taken before (a restart repeats the last one) is passed over, by its number;
    one with a wrong dimension or a known id fails the query and leaves the store as it was.
    """

    def __init__(self, path: str, dim: int, metric: Metric = Metric.L2):
        self.path, self.dim, self.metric = path, dim, metric

    def _segments(self, spark: SparkSession) -> list[list]:
        """[epoch, folder] of every batch taken so far, in order."""
        return sorted([c["epoch"], c["folder"]] for c in read_all_json(spark, f"{self.path}/commit-*.json"))

    def latest(self, spark: SparkSession, before: int) -> VectorStore | None:
        """The store of all batches whose number is below `before`."""
        folders = [f"{self.path}/{folder}" for epoch, folder in self._segments(spark) if epoch < before]
        return VectorStore(spark.read.schema(SCHEMA).parquet(*folders), self.dim, self.metric) if folders else None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        taken = self._segments(spark)
        if taken and taken[-1][0] >= epoch:
            return
        store = self.latest(spark, epoch) or VectorStore.empty(spark, self.dim, self.metric)
        store.add_batch(batch)  # checks it
        folder = f"segment-{epoch}-{uuid.uuid4().hex}"
        try:
            batch.selectExpr("cast(id AS bigint) AS id", "cast(vector AS array<float>) AS vector").write.parquet(f"{self.path}/{folder}")
        except Exception:
            delete(spark, f"{self.path}/{folder}")
            raise
        write_json(spark, f"{self.path}/commit-{epoch}.json", {"epoch": epoch, "folder": folder})
