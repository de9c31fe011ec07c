"""What several corpus operators share: work tables, bounded Arrow batches, word hashing, components."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold; bounds a Python worker's memory, never what is processed.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Bytes of text that the numpy kernels work on at once.
SLICE_BYTES = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one if all is on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or "file://" + os.path.join(tempfile.gettempdir(), "orrery-work")).rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors.

    The shuffle files of the write go when it ends, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove work tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._work_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, so that a run of long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give the memory that a Python worker has freed back to the system, where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def frees(run):
    """`run`, a function of Arrow batches, that releases its worker's memory when the task ends.

    Workers outlive their tasks and wait beside the JVM of the next stages, whose heap is full by then.
    """

    def freed(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return freed


def utf8(col: Column | str) -> Column:
    """Text as bytes; null is empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def byte_slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes as uint8, offsets) for runs of rows of a binary or string column, of about `most` bytes.

    Nulls are empty. A single longer text is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.binary(), pa.string()):
        column = column.cast(pa.binary())
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null(b"" if column.type == pa.binary() else "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, and each row's offsets in them."""
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    at = np.flatnonzero(inside)
    begin = np.flatnonzero(starts[at])
    rows = np.searchsorted(at[begin], offsets) if len(begin) else np.zeros(len(offsets), np.int64)
    if not len(begin):
        return np.zeros(0, _U), rows
    lengths = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at), dtype=np.int64) - np.repeat(begin, lengths)
    x = _LOWER[data[at]].astype(_U) + (place.astype(_U) << _U(8)) + _U(0x9E3779B97F4A7C15)
    sums = np.add.reduceat(mix(x), begin)
    return mix(sums + lengths.astype(_U) * _U(0xD6E8FEB86659FD93)), rows


_POWERS = [_U(1), _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5), _U(0x85EBCA77C2B2AE63)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int):
    """For each row the sorted distinct 64-bit hashes of its shingles of `words` words (fewer words: one, of all)."""
    h, rows = word_hashes(data, offsets)
    full = np.zeros(0, _U)
    if len(h) >= words:
        n = len(h) - words + 1
        full = h[:n].copy()
        for j in range(1, words):
            full += h[j : j + n] * _POWERS[j] + _U(j)
        full = mix(full)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(full[a : b - words + 1])
        elif b > a:
            x = np.array([b - a], dtype=_U)
            for j in range(a, b):
                x = mix(h[j : j + 1] + x * _POWERS[1])
            yield x
        else:
            yield np.zeros(0, _U)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: (id, component), component the least id reachable; for ids on an edge only.

    Alternating large and small stars (Kiveris et al.): every round is two partial aggregations and two
    joins, so a hub is pre-aggregated before it moves and its join can be split; nothing is collected but
    a count and a checksum. Null ids and loops are ignored.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, mark = saved(e, "stars"), None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = saved(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = saved(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "stars")
        discard(now, large)
        now = nxt
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = out.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out._work_path = now._work_path
    return out


def _scored(postings: DataFrame, band=None) -> DataFrame:
    sizes = postings.groupBy("key").agg(F.count("*").alias("size"))
    score = postings.join(sizes, "key").groupBy("id").agg(F.sum("size").alias("score"))
    return postings.withColumn("band", F.lit(0) if band is None else band).join(score, "id")


def central(postings: DataFrame, band=None) -> DataFrame:
    """Of rows (key, id, n), the most central id of each key that several hold: (key, band, lead), lead a struct (score, id, n).

    Central is an id whose keys are held by most rows in sum: in a group of edited copies the original,
    which links with every copy when the copies don't link with each other. With `band`, an expression of
    n, ids lead within their band only.
    """
    lead = _scored(postings, band).groupBy("key", "band").agg(F.max(F.struct("score", "id", "n")).alias("lead"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    return lead.where("lo <> hi").select("key", "band", "lead")


def leads(postings: DataFrame, band=None) -> DataFrame:
    """Of rows (key, id, n), candidates (a, na, b, nb, shared): every id with the most central id of each of its keys.

    One pair a row at most. `shared` counts the keys.
    """
    p = postings.withColumn("band", F.lit(0) if band is None else band)
    pairs = p.join(central(postings, band), ["key", "band"]).where("id <> lead.id").select(F.col("lead.id").alias("a"), F.col("lead.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb"))
    return pairs.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("shared"))


def bridges(postings: DataFrame, parts: DataFrame, percent: int, enough: str) -> DataFrame:
    """Of rows (key, id, n), the pairs (a, na, b, nb) that share enough keys but not a component.

    `parts` has (id, component); other ids are their own. `enough` is SQL over na, nb and shared, the number of
    keys that both have. Keys with the same most central id are one group, in which an id stands once: a pair
    is met once a group, not once a key. A group's components are paired first and their members joined on
    afterwards, so that a group of one large component costs nothing; ids that are a component by themselves are
    met directly. Only pairs with sizes n that a similarity
    of `percent` allows and with enough shared keys come out. The members of a group that link with nothing else
    in it are still compared with each other, which grows with the square of their number.
    """
    heads = central(postings).select("key", F.col("lead.id").alias("lead"))
    p = postings.join(heads, "key").join(parts, "id", "left").select("lead", "id", "n", F.coalesce("component", "id").alias("c"))
    mixed = p.groupBy("lead").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("lead")
    p = p.join(mixed, "lead", "left_semi").distinct()
    p = saved(p.join(postings.groupBy("id").agg(F.collect_list("key").alias("keys")), "id"), "mixed")
    kc = p.groupBy("lead", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("m"))
    x, y = kc.alias("x"), kc.alias("y")
    cc = x.join(y, F.expr(f"x.lead = y.lead and x.c < y.c and x.m + y.m > 2 and 100 * least(x.hi, y.hi) >= {percent} * greatest(x.lo, y.lo)"))
    few, many = F.expr("if(x.m <= y.m, x.c, y.c)"), F.expr("if(x.m <= y.m, y.c, x.c)")
    cc = cc.select("x.lead", few.alias("few"), many.alias("many"))  # those of few members are joined first
    alone = p.join(kc.where("m = 1").select("lead", "c"), ["lead", "c"], "left_semi")
    side = lambda df, i: df.select(F.col("lead").alias(f"l{i}"), F.col("c").alias(f"c{i}"), F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("keys").alias(f"k{i}"))
    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {enough.replace('shared', 'size(array_intersect(ka, kb))')}"
    out = cc.join(side(p, "a"), F.expr("lead = la and few = ca")).join(side(p, "b"), F.expr(f"lead = lb and many = cb and {near}"))
    singles = side(alone, "a").join(side(alone, "b"), F.expr(f"la = lb and a < b and {near}"))
    out = out.select("a", "na", "b", "nb").unionByName(singles.select("a", "na", "b", "nb"))
    one, other = F.struct("a", "na"), F.struct(F.col("b").alias("a"), F.col("nb").alias("na"))
    out = out.select(F.least(one, other).alias("o"), F.greatest(one, other).alias("p")).select("o.a", "o.na", F.col("p.a").alias("b"), F.col("p.na").alias("nb")).distinct()
    out._work_path = p._work_path
    return out
