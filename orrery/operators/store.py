"""An immutable vector store over a DataFrame (id BIGINT, vector ARRAY<FLOAT>)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.errors import DimensionMismatch, DuplicateId, NotFound
from orrery.functions.metrics import Metric, distance, vector_literal
from orrery.operators.bulk import knn_join
from orrery.operators.validate import check_batch, check_dim, check_duplicates, check_query

SCHEMA = "id BIGINT, vector ARRAY<FLOAT>"


class VectorStore:
    """Mutations check everything first and return a new store, so a failed batch changes nothing.

    A store that is changed often grows a long plan: prefer add_batch, or write a snapshot now and then.
    """

    def __init__(self, df: DataFrame, dim: int, metric: Metric = Metric.L2):
        check_dim(dim)
        self.df, self.dimension, self.metric = df.select(F.col("id").cast("bigint").alias("id"), "vector"), dim, metric

    @classmethod
    def empty(cls, spark: SparkSession, dim: int, metric: Metric = Metric.L2) -> VectorStore:
        return cls(spark.createDataFrame([], SCHEMA), dim, metric)

    @classmethod
    def from_batch(cls, batch: DataFrame, dim: int, metric: Metric = Metric.L2) -> VectorStore:
        """A store of a checked batch (id, vector)."""
        check_dim(dim)
        check_batch(batch, dim)
        check_duplicates(batch, None)
        return cls(batch, dim, metric)

    def _with(self, df: DataFrame) -> VectorStore:
        return VectorStore(df, self.dimension, self.metric)

    def add(self, id: int, vector: Sequence[float]) -> VectorStore:
        if len(vector) != self.dimension:
            raise DimensionMismatch(self.dimension, len(vector))
        if self.contains(id):
            raise DuplicateId(id)
        row = self.df.sparkSession.createDataFrame([(id, [float(x) for x in vector])], SCHEMA)
        return self._with(self.df.unionByName(row))

    def add_batch(self, batch: DataFrame) -> VectorStore:
        """All rows of (id, vector) or none."""
        batch = batch.select(F.col("id").cast("bigint").alias("id"), "vector")
        check_batch(batch, self.dimension)
        check_duplicates(batch, self.df)
        return self._with(self.df.unionByName(batch))

    def remove(self, id: int) -> VectorStore:
        if not self.contains(id):
            raise NotFound(id)
        return self._with(self.df.where(F.col("id") != id))

    def remove_all(self, ids: DataFrame) -> VectorStore:
        """The store without the ids of a DataFrame (id); ids that aren't there are passed over."""
        return self._with(self.df.join(ids.select("id"), "id", "left_anti"))

    def lookup(self, id: int) -> DataFrame:
        return self.df.where(F.col("id") == id)

    def get(self, id: int) -> list[float]:
        row = self.lookup(id).first()
        if row is None:
            raise NotFound(id)
        return list(row["vector"])

    def contains(self, id: int) -> bool:
        return not self.lookup(id).isEmpty()

    def contains_all(self, ids: DataFrame) -> DataFrame:
        """(id, found) for a DataFrame of ids."""
        mine = self.df.select("id", F.lit(True).alias("found"))
        return ids.select("id").join(mine, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def distances(self, query: Sequence[float]) -> DataFrame:
        """(id, distance) to every vector."""
        if len(query) != self.dimension:
            raise DimensionMismatch(self.dimension, len(query))
        return self.df.select("id", distance(self.metric, vector_literal(query), "vector").alias("distance"))

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """The min(k, n) nearest as (id, distance), by (distance, id): partial top-k in every task, merged."""
        check_query(query, self.dimension, k)
        return self.distances(query).orderBy("distance", "id").limit(k)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, distance, rank) for a DataFrame (query_id, vector)."""
        check_batch(queries, self.dimension)
        check_query([0.0] * self.dimension, self.dimension, k)
        return knn_join(queries, self.df, k, self.metric)
