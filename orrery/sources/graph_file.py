"""The binary dump of a single-process graph, read into an index of one shard.

Such a dump has been one process's memory and is read whole by the driver; the index it gives is an ordinary
node table. Both versions are read: version 1 holds room for every row up to the capacity, version 2 only the
rows there are. All is little-endian: eight bytes of magic and version, the parameters, then the vectors, ids,
levels, neighbour lists and the map from ids to places, each list after its length.

Later inserts draw their levels by this engine's own rule, not by the generator of the process that wrote the dump.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from orrery.errors import EngineIOError, InvalidParameter
from orrery.functions.metrics import Metric
from orrery.operators.graph import MOST_LEVELS, NODES, GraphConfig, GraphIndex
from orrery.sources.vndb import open_file

# Fixed values of the format.
MAGIC, VERSIONS = b"HNSW", (1, 2)
HEAD = struct.Struct("<4sI")
PARAMETERS = struct.Struct("<QIQQQQQQdQQ")  # dim, metric, capacity, m, links above, links on the lowest level, ef when built, ef when searched, level factor, seed, rows


class _Cursor:
    """Takes values off the front of the dump; past its end is an I/O error."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def one(self, layout: str):
        return self.several(struct.Struct("<" + layout))[0]

    def several(self, layout: struct.Struct) -> tuple:
        if self.at + layout.size > len(self.data):
            raise EngineIOError("graph file is truncated")
        self.at += layout.size
        return layout.unpack_from(self.data, self.at - layout.size)

    def array(self, kind: str) -> np.ndarray:
        """A length and as many numbers."""
        n, size = self.one("Q"), np.dtype(kind).itemsize
        if n * size > len(self.data) - self.at:
            raise EngineIOError("graph file is truncated")
        self.at += n * size
        return np.frombuffer(self.data, kind, n, self.at - n * size)


def _refuse(broken: bool, what: str) -> None:
    if broken:
        raise EngineIOError(f"corrupt graph file: {what}")


def _neighbours(c: _Cursor) -> list[list[np.ndarray]]:
    nodes = c.one("Q")
    _refuse(nodes * 8 > len(c.data) - c.at, "neighbours beyond the end")
    out = []
    for _ in range(nodes):
        levels = c.one("Q")
        _refuse(levels * 8 > len(c.data) - c.at, "levels beyond the end")
        out.append([c.array("<u8") for _ in range(levels)])
    return out


def read_graph(spark: SparkSession, path: str) -> GraphIndex:
    """The index in a dump, checked: lengths, ranges of levels, links and entry, and ids that agree with their map."""
    try:
        with open_file(path) as f:
            data = f.read()
    except OSError as e:
        raise EngineIOError(str(e)) from e
    if len(data) < HEAD.size:
        raise EngineIOError("file too small")
    magic, version = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise EngineIOError("invalid magic")
    if version not in VERSIONS:
        raise EngineIOError(f"unsupported version: {version}")
    c = _Cursor(data, HEAD.size)
    dim, code, capacity, m, above, lowest, ef_built, ef, _, seed, n = c.several(PARAMETERS)
    tag = c.one("B")
    _refuse(tag > 1, "entry")
    entry = c.one("Q") if tag else None
    top = c.one("i")
    vectors, ids, levels = c.array("<f4"), c.array("<u8"), c.array("<i4")
    links = _neighbours(c)
    places = c.one("Q")
    _refuse(places * 16 > len(data) - c.at, "map beyond the end")
    pairs = np.frombuffer(data, "<u8", 2 * places, c.at).reshape(-1, 2)

    metric = Metric.from_code(code)
    _refuse(not dim, "dimension 0")
    _refuse(not capacity, "capacity 0")
    _refuse(n > capacity, "more rows than its capacity")
    _refuse(top > MOST_LEVELS, "highest level")
    _refuse(entry is None and n > 0, "rows without an entry")
    _refuse(entry is not None and (entry >= n or top < 0), "entry")
    room = capacity if version == 1 else n
    _refuse(len(links) != room, f"length of neighbours {len(links)}, expected {room}")
    _refuse(len(vectors) != room * dim, f"length of vectors {len(vectors)}, expected {room * dim}")
    _refuse(len(ids) != room or len(levels) != room, f"length of ids or levels, expected {room}")
    vectors, ids, levels, links = vectors.reshape(room, dim)[:n], ids[:n], levels[:n], links[:n]
    _refuse(places != n or bool((pairs[:, 1] >= n).any()), "map of ids")
    _refuse(not np.array_equal(ids[pairs[:, 1].astype(np.int64)], pairs[:, 0]) or len(set(ids.tolist())) != n, "map of ids")
    _refuse(any(len(x) > MOST_LEVELS + 1 for x in links), "too many levels of neighbours")
    _refuse(any(len(x) and int(x.max()) >= n for node in links for x in node), "a neighbour out of range")
    _refuse(any(len(x) != level + 1 for x, level in zip(links, levels.tolist(), strict=True)), "levels and neighbours disagree")
    if n and int(ids.max()) >= 1 << 63:
        raise InvalidParameter("an id is above 2**63 - 1")

    if (above, lowest) != (m, 2 * m):
        raise InvalidParameter("links per node other than M, and 2 M on the lowest level")
    config = GraphConfig(dim, metric, capacity, m, ef_built, ef, seed).checked()
    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(vectors.ravel(), pa.float32()))
    lists = pa.array([[x.tolist() for x in node] for node in links], pa.list_(pa.list_(pa.int32())))
    columns = {"shard": pa.array(np.zeros(n, np.int32)), "node": pa.array(np.arange(n, dtype=np.int32)), "ordinal": pa.array(np.arange(n)), "id": pa.array(ids.astype(np.int64)), "level": pa.array(levels, pa.int32()), "vector": flat, "neighbors": lists}
    return GraphIndex(spark.createDataFrame(pa.table(columns), NODES), config, n)
