"""Eager checks, in the order in which their errors count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.errors import DimensionMismatch, DuplicateId, EmptyVector, InvalidK


def check_dim(dim: int) -> None:
    if dim <= 0:
        raise EmptyVector


def check_query(query: Sequence[float], dim: int, k: int) -> None:
    if len(query) != dim:
        raise DimensionMismatch(dim, len(query))
    if k <= 0:
        raise InvalidK


def check_batch(batch: DataFrame, dim: int) -> int:
    """Rows of a batch whose vectors all have the dimension (null counts as none); one aggregate job."""
    n, floats, odd = batch.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(F.size("vector"), F.lit(0))), F.lit(0)), F.coalesce(F.sum(F.when(F.coalesce(F.size("vector"), F.lit(0)) != dim, 1)), F.lit(0))).first()
    if odd:
        raise DimensionMismatch(n * dim, floats)
    return n


def check_duplicates(batch: DataFrame, existing: DataFrame | None) -> None:
    """The smallest id that the batch repeats or that is there already is an error."""
    twice = batch.groupBy("id").count().where("count > 1").select("id")
    if existing is not None:
        twice = twice.unionByName(batch.select("id").join(existing.select("id"), "id", "left_semi"))
    least = twice.agg(F.min("id")).first()[0]
    if least is not None:
        raise DuplicateId(least)
