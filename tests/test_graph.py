"""The graph index: recall, batch and serial inserts, save and load, limits, broken tables."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import errors as E
from orrery.functions.metrics import Metric
from orrery.operators.graph import GraphConfig, GraphIndex, ProximityGraph, level_of, recall
from orrery.operators.store import VectorStore
from orrery.plans import registry
from orrery.sources.graph_file import read_graph
from orrery.sources.snapshot import load_graph, save_graph
from tests.test_vectors import frame, found


def base(n, dim):
    return [(i, [((31 * i + 7 * d) % 1000) / 100 for d in range(dim)]) for i in range(n)]


def nodes(index):
    return sorted(map(str, index.nodes.select("shard", "node", "id", "level", "neighbors").collect()))


@pytest.mark.parametrize("shards", [1, 3])
def test_recall_on_the_formula_data(spark, shards):
    df = frame(spark, base(500, 32))
    q = frame(spark, [(j, [((17 * j + 13 * d) % 1000) / 100 for d in range(32)]) for j in range(10)]).withColumnRenamed("id", "query_id")
    index = GraphIndex.build(df, GraphConfig(32, shards=shards)).cached()
    assert recall(index.search_batch(q, 10, 100), VectorStore(df, 32).search_batch(q, 10)) >= 0.8


def test_recall_at_the_default_beam(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    q = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = GraphIndex.build(rows, GraphConfig(64, shards=2)).cached()
    assert recall(index.search_batch(q, 10), VectorStore(rows, 64).search_batch(q, 10)) >= 0.9
    plan = index.search([0.0] * 64, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(shard" not in plan.split("InMemoryRelation")[0]  # the kept nodes aren't shuffled
    index.release()


def test_batch_equals_serial_also_after_saving(spark, tmp_path):
    rows = [(i, [((31 * i + 17 * j) % 97) / 97 for j in range(8)]) for i in range(60)]
    config = GraphConfig(8, m=4, ef_construction=30, seed=7)
    whole = GraphIndex.build(frame(spark, rows), config)
    half = GraphIndex.build(frame(spark, rows[:40]), config)
    save_graph(half, f"file://{tmp_path}/g")
    later = load_graph(spark, f"file://{tmp_path}/g").add_batch(frame(spark, rows[40:58])).cached().add(58, rows[58][1]).add(59, rows[59][1])
    assert nodes(later) == nodes(whole)


def test_limits_and_lookups(spark):
    two = [(1, [1, 0, 0]), (2, [0, 1, 0]), (3, [-1, 0, 0])]
    index = GraphIndex.build(frame(spark, two), GraphConfig(3, Metric.COSINE, capacity=4)).cached()
    assert found(index.search([0.9, 0.1, 0], 1)) == [1] and index.get_vector(2) == [0, 1, 0] and index.contains(3)
    for call, error in (
        (lambda: index.add_batch(frame(spark, [(7, [1, 1, 1]), (8, [1, 1, 1])])), E.IndexFull),
        (lambda: index.add(1, [1, 1]), E.DimensionMismatch),
        (lambda: index.add(1, [1, 1, 1]), E.DuplicateId),
        (lambda: index.get_vector(9), E.NotFound),
        (lambda: index.search([1, 1, 1], 0), E.InvalidK),
        (lambda: GraphConfig(3, m=1).checked(), E.InvalidParameter),
        (lambda: GraphConfig(3, capacity=0).checked(), E.InvalidParameter),
        (lambda: GraphConfig(0).checked(), E.EmptyVector),
    ):
        with pytest.raises(error):
            call()
    empty = GraphIndex.empty(spark, GraphConfig(3))
    assert found(empty.search([1, 1, 1], 5)) == [] and empty.info()["m_max0"] == 32
    assert GraphConfig(3, m=300).checked().ef_construction == 300


def test_levels():
    drawn = [level_of(42, i, 16) for i in range(20000)]
    assert 0.05 < sum(x >= 1 for x in drawn) / len(drawn) < 0.075 and max(drawn) <= 7


def test_levels_of_an_index_follow_the_rule(spark):
    rows = GraphIndex.build(frame(spark, base(200, 4)), GraphConfig(4, m=3, shards=2, seed=5)).nodes.collect()
    assert all(r["level"] == level_of(5, r["ordinal"], 3) == len(r["neighbors"]) - 1 for r in rows) and len({r["level"] for r in rows}) > 2
    assert sorted((r["shard"], r["ordinal"]) for r in rows) == [(s, i) for s in (0, 1) for i in range(sum(r["shard"] == s for r in rows))]


def test_broken_index_is_refused(spark, tmp_path):
    path = f"{tmp_path}/g"
    save_graph(GraphIndex.build(frame(spark, base(20, 4)), GraphConfig(4)), f"file://{path}")
    meta = json.load(open(f"{path}/snapshot.json"))
    for change in ({"version": 999}, {"metric": 99}, {"count": 21}, {"dim": 5}, {"kind": "other"}):
        json.dump(meta | change, open(f"{path}/snapshot.json", "w"))
        (tmp_path / "g/.snapshot.json.crc").unlink(missing_ok=True)
        with pytest.raises(E.EngineIOError):
            load_graph(spark, f"file://{path}")
    with pytest.raises(E.EngineIOError):
        load_graph(spark, f"file://{tmp_path}/none")


def numbers(kind, *values):
    return struct.pack(f"<Q{len(values)}{kind}", len(values), *values)


def dump(version=2, magic=b"HNSW", room=2, **changes):
    """A graph of two rows, (10, [1, 0]) and (20, [0, 1]), in a capacity of four."""
    p = {"dim": 2, "metric": 0, "capacity": 4, "m": 16, "above": 16, "lowest": 32, "built": 200, "ef": 50, "factor": 0.36, "seed": 42, "n": 2, "entry": 0, "top": 0}
    p |= {"vectors": [1.0, 0.0, 0.0, 1.0] + [0.0] * (2 * room - 4), "ids": [10, 20] + [0] * (room - 2), "levels": [0] * room, "links": [[[1]], [[0]]] + [[]] * (room - 2), "map": [(20, 1), (10, 0)]} | changes
    out = magic + struct.pack("<I", version) + struct.pack("<QIQQQQQQdQQ", *list(p.values())[:11])
    out += b"\0" if p["entry"] is None else struct.pack("<BQ", 1, p["entry"])
    out += struct.pack("<i", p["top"]) + numbers("f", *p["vectors"]) + numbers("Q", *p["ids"]) + numbers("i", *p["levels"])
    out += struct.pack("<Q", len(p["links"])) + b"".join(struct.pack("<Q", len(node)) + b"".join(numbers("Q", *x) for x in node) for node in p["links"])
    return out + struct.pack("<Q", len(p["map"])) + b"".join(struct.pack("<QQ", *x) for x in p["map"])


@pytest.mark.parametrize("data", [dump(), dump(version=1, room=4)])
def test_binary_dump_is_read(spark, tmp_path, data):
    (tmp_path / "g.bin").write_bytes(data)
    index = read_graph(spark, str(tmp_path / "g.bin"))
    assert (len(index), index.config.capacity, index.config.metric, index.get_vector(10)) == (2, 4, Metric.L2, [1.0, 0.0])
    assert found(index.search([1, 0.1], 1)) == [10]
    assert found(index.add(30, [0.5, 0.5]).search([0.5, 0.5], 3)) == [30, 10, 20]  # room is left
    (tmp_path / "none.bin").write_bytes(dump(n=0, entry=None, top=-1, vectors=[], ids=[], levels=[], links=[], map=[]))
    assert found(read_graph(spark, str(tmp_path / "none.bin")).search([1, 0], 3)) == []


@pytest.mark.parametrize(
    "data,what",
    [
        (dump(magic=b"WSNH"), "magic"),
        (dump(version=999), "version"),
        (b"HNS", "small"),
        (dump()[:8] + b"\xff" * 32, "truncated"),
        (dump()[:-3], "end"),
        (dump(room=4), "length"),
        (dump(version=1), "length"),
        (dump(metric=7), "metric"),
        (dump(dim=0), "dimension"),
        (dump(capacity=0), "capacity"),
        (dump(capacity=1), "capacity"),
        (dump(top=33), "level"),
        (dump(top=-1), "entry"),
        (dump(entry=2), "entry"),
        (dump(entry=None), "entry"),
        (dump(map=[(10, 0)]), "map"),
        (dump(map=[(10, 0), (20, 2)]), "map"),
        (dump(map=[(10, 0), (21, 1)]), "map"),
        (dump(links=[[[2]], [[0]]]), "neighbour"),
        (dump(links=[[[1]] + [[]] * 33, [[0]]]), "levels"),
        (dump(levels=[1, 0]), "levels"),
        (dump(ids=[10]), "length"),
    ],
)
def test_broken_binary_dump_is_refused(spark, tmp_path, data, what):
    (tmp_path / "g.bin").write_bytes(data)
    with pytest.raises(E.EngineIOError, match=what):
        read_graph(spark, str(tmp_path / "g.bin"))


def clustered(n, dim=8):
    """Vectors in clusters, and copies of one."""
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(20, dim))[rng.integers(0, 20, n)] * 5 + rng.normal(size=(n, dim))).astype(np.float32).astype(float)
    v[rng.random(n) < 0.3] = v[0]
    return v


def whole(n, metric=Metric.L2, **config):
    g = ProximityGraph(GraphConfig(8, metric, **config).checked(), n)
    g.extend(range(n), clustered(n))
    return g


@pytest.mark.parametrize("metric", list(Metric))
def test_every_node_is_reached_and_links_are_bounded(metric):
    g = whole(900, metric, m=4, ef_construction=20)
    for start in (0, g.entry, 899):
        seen, todo = {start}, [start]
        while todo:
            fresh = set(g.links[todo.pop()][0]) - seen
            seen |= fresh
            todo += fresh
        assert len(seen) == 900
    assert max(len(x[0]) for x in g.links) <= 8 and all(len(y) <= 4 for x in g.links for y in x[1:])


def test_one_batch_equals_several_with_copies():
    v, one = clustered(300), whole(300, m=4, ef_construction=20)
    g = ProximityGraph(one.c, 300)
    g.extend(range(130), v[:130])
    g = ProximityGraph.load(one.c, g.rows(0), 170)
    g.extend(range(130, 290), v[130:290])
    for i in range(290, 300):
        g.extend([i], v[i : i + 1])
    assert g.links == one.links and (g.entry, g.top) == (one.entry, one.top)


def test_a_beam_as_wide_as_the_graph_is_the_same_all_at_once():
    g = whole(200, m=4, ef_construction=20)
    for cut in (False, True):
        if cut:  # parts, as in a dump: no link from the first half to the second
            g.links = [[[y for y in level if y < 100 or node >= 100] for level in x] for node, x in enumerate(g.links)]
        place, ids, d = g.search_all(clustered(200)[:40] + 0.01, 7)
        for i, q in enumerate(clustered(200)[:40] + 0.01):
            assert list(zip(ids[place == i].tolist(), d[place == i].tolist(), strict=True)) == g.search(q, 7, 200)


def test_every_shard_has_its_task_and_a_wide_join_is_exact(spark):
    rows = frame(spark, list(enumerate(clustered(200).tolist())))
    index = GraphIndex.build(rows, GraphConfig(8, shards=3)).cached()
    assert index.nodes.select("shard", F.spark_partition_id().alias("task")).distinct().agg(F.countDistinct("shard"), F.countDistinct("task")).first() == (3, 3)
    q = rows.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    assert sorted(map(tuple, index.search_batch(q, 5, 200).collect())) == sorted(map(tuple, VectorStore(rows, 8).search_batch(q, 5).collect()))
    index.release()


def test_an_index_that_grows_is_sized_for_all_rows(spark, monkeypatch):
    sized, shards_for = [], GraphIndex.shards_for
    monkeypatch.setattr(GraphIndex, "shards_for", staticmethod(lambda n: sized.append(n) or shards_for(n)))
    assert registry.queries()["graph_add_batch_knn"](spark, "/root/testdata/sf0.01").count() == 10
    assert sized == [500]
