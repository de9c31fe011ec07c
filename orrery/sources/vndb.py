"""The flat binary vector file: 32 bytes of header, the ids, then the vectors; all little-endian.

Reading is a Spark data source: the header is checked on the driver and tasks read byte ranges. Tasks write
their ranges of ids as parts in the shared folder, ids and vectors apart; the driver then joins the parts into
the one file by copying blocks, since the ids of all rows stand before the first vector.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orrery.errors import EngineIOError, InvalidParameter
from orrery.functions.metrics import Metric
from orrery.operators.store import VectorStore
from orrery.operators.validate import check_batch, check_dim, check_duplicates
from orrery.sources.files import delete, work_path

# Fixed values of the format.
MAGIC, VERSION, HEADER = 0x564E4442, 1, struct.Struct("<IIQQII")
#: Rows that a task reads.
ROWS = 1 << 18
#: Bytes that the driver copies at once.
COPY_BYTES = 8 << 20


def _open(path: str):
    path = path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def open_file(path: str):
    """A file of any file system that Arrow knows, to be read."""
    fs, name = _open(path)
    return fs.open_input_file(name)


def read_header(path: str) -> tuple[int, int, Metric]:
    """(dim, n, metric), with the file's length checked against them."""
    try:
        fs, name = _open(path)
        size = fs.get_file_info(name).size
        if size is None:
            raise EngineIOError(f"cannot open {path}")
        with fs.open_input_file(name) as f:
            head = f.read(32)
    except OSError as e:
        raise EngineIOError(str(e)) from e
    if len(head) < 32:
        raise EngineIOError("file too small")
    magic, version, dim, n, metric, _ = HEADER.unpack(head)
    if magic != MAGIC:
        raise EngineIOError("invalid magic")
    if version != VERSION:
        raise EngineIOError(f"unsupported version: {version}")
    metric = Metric.from_code(metric)
    if dim == 0 and n:
        raise EngineIOError("dimension 0 with vectors")
    if 32 + n * 8 + n * dim * 4 > size:  # Python's integers don't overflow
        raise EngineIOError("file is truncated")
    return dim, n, metric


class _Range(InputPartition):
    def __init__(self, first: int, rows: int):
        self.first, self.rows = first, rows


class _Reader(DataSourceReader):
    def __init__(self, path):
        self.path = path
        self.dim, self.n, _ = read_header(path)

    def partitions(self):
        return [_Range(a, min(ROWS, self.n - a)) for a in range(0, self.n, ROWS)] or [_Range(0, 0)]

    def read(self, part):
        if not part.rows:
            return
        fs, name = _open(self.path)
        with fs.open_input_file(name) as f:
            for a in range(part.first, part.first + part.rows, 8192):
                rows = min(8192, part.first + part.rows - a)
                ids = np.frombuffer(f.read_at(rows * 8, 32 + 8 * a), "<u8")
                if len(ids) and int(ids.max()) >= 1 << 63:
                    raise InvalidParameter("an id is above 2**63 - 1")
                vectors = np.frombuffer(f.read_at(rows * self.dim * 4, 32 + 8 * self.n + 4 * self.dim * a), "<f4")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * self.dim, pa.int32()), pa.array(vectors))
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), lists], names=["id", "vector"])


class VndbSource(DataSource):
    """`spark.read.format("vndb").load(path)` gives (id, vector)."""

    @classmethod
    def name(cls):
        return "vndb"

    def schema(self):
        return "id bigint, vector array<float>"

    def reader(self, schema):
        return _Reader(self.options["path"])


def open_vndb(spark: SparkSession, path: str) -> VectorStore:
    dim, _, metric = read_header(path)
    spark.dataSource.register(VndbSource)
    return VectorStore(spark.read.format("vndb").load(path), max(dim, 1), metric)


def write_vndb(batch: DataFrame, path: str, dim: int, metric: Metric = Metric.L2) -> None:
    """Check (id, vector) and write it by ascending id, under another name until it is complete."""
    check_dim(dim)
    n = check_batch(batch, dim)
    check_duplicates(batch, None)
    if n and batch.where("id < 0").limit(1).count():
        raise InvalidParameter("an id is negative")
    parts = work_path(batch.sparkSession)
    rows = batch.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector")).repartitionByRange("id").sortWithinPartitions("id")
    made = rows.mapInArrow(_parts(parts), "place int, part string").collect()  # a row per task
    fs, name = _open(path)
    beside = name + ".new"
    with fs.open_output_stream(beside) as out:
        out.write(HEADER.pack(MAGIC, VERSION, dim, n, int(metric), 0))
        for kind in ("ids", "vectors"):
            for r in sorted(made):
                with open_file(f"{r['part']}.{kind}") as f:
                    while block := f.read(COPY_BYTES):
                        out.write(block)
    fs.move(beside, name)
    delete(batch.sparkSession, parts)


def _parts(folder: str):
    """Tasks write the ids and the vectors of their range of ids, each in a file of its own, named by place and attempt."""

    def run(batches):
        task = TaskContext.get()
        part = f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}"
        fs, name = _open(part)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{name}.ids") as ids, fs.open_output_stream(f"{name}.vectors") as vectors:
            for b in batches:
                ids.write(b.column(0).to_numpy().astype("<u8").tobytes())
                vectors.write(b.column(1).flatten().to_numpy().astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([part])], names=["place", "part"])

    return run
