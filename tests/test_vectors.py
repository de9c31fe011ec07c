"""Hand values, small searches, error texts and their precedence, bulk against SQL, properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery import errors as E
from orrery.functions import metrics as M
from orrery.functions.metrics import Metric
from orrery.operators.store import VectorStore

L2, COS, DOT = Metric.L2, Metric.COSINE, Metric.DOT
VALUES = [
    (L2, [1, 2, 3], [1, 2, 3], 0), (L2, [1, 0, 0], [0, 1, 0], 2), (L2, [3], [7], 16), (L2, [1, 2, 3], [4, 5, 6], 27),
    (COS, [1, 2, 3], [1, 2, 3], 0), (COS, [1, 0], [0, 1], 1), (COS, [1, 0], [-1, 0], 2), (COS, [0, 0, 0], [1, 2, 3], 1),
    (COS, [1e-4, 0], [1e-4, 0], 1), (DOT, [1, 2, 3], [4, 5, 6], -32), (DOT, [1, 0], [0, 1], 0),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id bigint, vector array<float>")


def store(spark, rows, dim, metric=L2):
    return VectorStore.from_batch(frame(spark, rows), dim, metric)


def found(df):
    return [r["id"] for r in df.collect()]


def test_hand_values_by_sql_and_numpy(spark):
    row = spark.range(1).select(*[M.distance(m, M.vector_literal(a), M.vector_literal(b)) for m, a, b, _ in VALUES], M.inner_product(M.vector_literal([1, 2, 3, 4]), M.vector_literal([1, 2, 3, 5]))).first()
    for (m, a, b, want), got in zip(VALUES, row, strict=False):
        assert got == pytest.approx(want, abs=1e-6)
        assert M.distances(m, np.array(a, np.float32), np.array([b], np.float32))[0] == got
    assert row[-1] == 34 and math.copysign(1, row[10]) == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(-100, 100), st.floats(-100, 100)), min_size=1, max_size=64))
def test_properties(pairs):
    a, b = (np.array(x, float) for x in zip(*pairs, strict=True))
    for m in Metric:
        assert M.distances(m, a, b[None])[0] == pytest.approx(M.distances(m, b, a[None])[0])
    assert M.distances(L2, a, b[None])[0] >= 0 and M.distances(L2, a, a[None])[0] == 0
    assert 0 <= M.distances(COS, a, b[None])[0] <= 2


def test_metric_names_and_codes():
    assert Metric.parse("Cosine") is COS and Metric.parse("dot") is DOT
    with pytest.raises(E.InvalidParameter):
        Metric.parse("L2 ")
    assert Metric.from_code(9, strict=False) is L2
    with pytest.raises(E.EngineIOError, match="I/O error: invalid metric in file"):
        Metric.from_code(99)


def test_error_texts():
    assert str(E.DimensionMismatch(768, 512)) == "dimension mismatch: expected 768, got 512"
    assert str(E.NotFound(42)) == "vector not found: 42" and str(E.IndexFull()) == "index is full"
    assert issubclass(E.InvalidK, ValueError)


def test_small_searches(spark):
    s = store(spark, [(1, [0, 0]), (2, [1, 0]), (3, [10, 10])], 2)
    assert found(s.search([0, 0.1], 2)) == [1, 2] and found(s.search([0, 0.1], 99)) == [1, 2, 3]
    assert found(store(spark, [(1, [1, 0]), (2, [0, 1]), (3, [-1, 0])], 2, COS).search([0.9, 0.1], 1)) == [1]
    assert found(store(spark, [(9, [1, 1]), (4, [1, 1]), (7, [1, 1])], 2).search([1, 1], 2)) == [4, 7]  # ties by id
    empty = VectorStore.empty(spark, 2)
    assert found(empty.search([0, 0], 5)) == [] and empty.is_empty() and len(empty) == 0
    with pytest.raises(E.InvalidK):
        empty.search([0, 0], 0)
    with pytest.raises(E.DimensionMismatch):
        s.search([0], 0)  # the dimension comes first


def test_store_changes(spark):
    s = store(spark, [(1, [1, 1, 1]), (2, [2, 2, 2])], 3)
    assert len(s.add(3, [3, 3, 3])) == 3 and s.get(2) == [2, 2, 2] and s.contains(1) and not s.contains(5)
    assert len(s.remove(1)) == 1 and len(s) == 2
    assert len(s.add_batch(frame(spark, []))) == 2
    for call, error in (
        (lambda: VectorStore.empty(spark, 0), E.EmptyVector),
        (lambda: s.add(1, [1, 2]), E.DimensionMismatch),
        (lambda: s.add(1, [1, 2, 3]), E.DuplicateId),
        (lambda: s.get(42), E.NotFound),
        (lambda: s.remove(42), E.NotFound),
        (lambda: s.add_batch(frame(spark, [(8, [1, 2, 3]), (9, [1, 2])])), E.DimensionMismatch),
        (lambda: s.add_batch(frame(spark, [(8, [1, 2, 3]), (8, [1, 2, 3])])), E.DuplicateId),
        (lambda: s.add_batch(frame(spark, [(8, [1, 2, 3]), (2, [1, 2, 3])])), E.DuplicateId),
    ):
        with pytest.raises(error):
            call()
    with pytest.raises(E.DimensionMismatch, match="expected 6, got 5"):
        s.add_batch(frame(spark, [(8, [1, 2, 3]), (9, [1, 2])]))
    assert found(s.contains_all(spark.createDataFrame([(1,), (5,)], "id bigint")).where("found")) == [1]


@pytest.mark.parametrize("metric", list(Metric))
def test_join_equals_searches_with_many_ties(spark, metric):
    rows = [(i, [((i % 40) * 31 + d * 7) % 1000 / 100 for d in range(8)]) for i in range(400)]
    s = store(spark, rows, 8, metric)
    queries = [(j, [((17 * j + 13 * d) % 1000) / 100 for d in range(8)]) for j in range(3)]
    q = frame(spark, queries).withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in s.search_batch(q, 15).collect()}
    for j, v in queries:
        assert [got[j, i + 1] for i in range(15)] == [tuple(r) for r in s.search(v, 15).collect()]


def test_join_by_expressions_equals_the_bulk_join(spark, monkeypatch):
    from orrery.operators import bulk

    rows = frame(spark, [(i, [((31 * i + 7 * d) % 50) / 10 for d in range(6)]) for i in range(90)])
    queries = rows.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    for metric in Metric:
        one = sorted(map(tuple, bulk.knn_join(queries, rows, 7, metric).collect()))
        assert one == sorted(map(tuple, bulk.knn_join_expression(queries, rows, 7, metric).collect())) and len(one) == 70
    monkeypatch.setattr(bulk.in_blocks, "__defaults__", (100,))
    assert sorted(map(tuple, bulk.knn_join(queries, rows, 7, metric).collect())) == one  # in several blocks
    assert sorted(map(tuple, bulk.knn_join_expression(queries, rows, 7, metric).collect())) == one


def test_join_by_expressions_is_compiled_and_sorts_few_pairs(spark, monkeypatch):
    from orrery.operators import bulk

    rows = frame(spark, [(i, [((31 * i + 7 * d) % 53) / 10 for d in range(6)]) for i in range(300)] + [(900 + i, [0.0] * 6) for i in range(20)])
    queries = rows.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(bulk, "FEW", 2, raising=False)  # in several passes
    for metric in Metric:
        got = bulk.knn_join_expression(queries, rows, 7, metric)
        joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join Inner" in x]
        assert joins and all("bound" in x and "lambda" not in x for x in joins)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bulk.knn_join(queries, rows, 7, metric).collect()))
    monkeypatch.setattr(bulk, "MOST_UNROLLED", 5, raising=False)  # as arrays
    assert sorted(map(tuple, bulk.knn_join_expression(queries, rows, 7, metric).collect())) == sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("metric", list(Metric))
def test_memory_of_the_bulk_join_is_bounded(metric):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    import pyarrow.compute as pc

    from orrery.operators import bulk

    v = np.random.default_rng(1).normal(size=(8000, 8)).astype(np.float32)
    v[100:600], v[7000] = v[5], np.nan
    batch = pa.record_batch({"id": np.arange(len(v)), "vector": pa.array(list(v), pa.list_(pa.float32()))})
    q = v[:4096].astype(float)
    tracemalloc.start()
    found = pa.Table.from_batches(bulk._best(metric, SimpleNamespace(value=np.arange(len(q))), SimpleNamespace(value=q), 3)([batch]))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 250  # a whole part against all queries: 134 MB for each step of its distances
    for i in (0, 5, 101, 4095):
        d = M.distances(metric, q[i], v)
        want = np.lexsort((np.arange(len(v)), d))[:3]
        mine = found.filter(pc.field("query_id") == i)
        assert mine["id"].to_pylist() == want.tolist() and mine["distance"].to_pylist() == d[want].tolist()
