"""Sharding along a Hilbert curve over quantised metadata, in DataFrame and SQL functions only.

Source, language and size are quantised to `BITS` bits each by their corpus-wide quantiles (order
preserving, so files of a run have narrow minima and maxima in every dimension; strings by their whole value,
from a count of the documents that have each). The cell's index on the
Hilbert curve orders the documents, and the order is cut into runs of equal length (law `rows`).

The global position of a row is the number of rows in earlier buckets plus its rank in its own. A bucket
is a cell, or one of several hash ranges of a cell that holds more than `BUCKET_ROWS`: a hot source or a
mass of copies is spread over as many windows as it needs, and no window takes all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import saved, table

BITS, DIMENSIONS = 4, 3
#: Rows that one window ranks, about.
BUCKET_ROWS = 20_000


def hilbert_index(cell: tuple[int, ...], bits: int) -> int:
    """Position of an integer cell on the Hilbert curve of its dimension (Skilling's transposed form)."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def _curve(dimensions: list[Column]) -> Column:
    """The curve index by a table of all cells, built by rule: 2 ** (BITS * DIMENSIONS) entries."""
    side = 1 << BITS
    places = [hilbert_index((i // side // side, i // side % side, i % side), BITS) for i in range(side**DIMENSIONS)]
    cell = dimensions[0] * side * side + dimensions[1] * side + dimensions[2]
    return F.element_at(F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>"), cell + 1)


def _levels(df: DataFrame, col: str, total: int) -> DataFrame:
    """(col, <col>_level) for every value of a string column: the part of the documents in code point order that its middle lies in.

    Null comes first. Values are summed by their first bytes, and in order among those of the same first bytes:
    what one window orders is a row per value or per beginning, never per document.
    """
    begin = F.coalesce(F.hex(F.substring(F.col(col).cast("binary"), 1, 3)), F.lit("-"))
    n = df.groupBy(col).agg(F.count("*").alias("__n")).withColumn("__begin", begin)
    sums = n.groupBy("__begin").agg(F.sum("__n").alias("__s"))
    starts = sums.select("__begin", (F.sum("__s").over(Window.orderBy("__begin")) - F.col("__s")).alias("__start"))
    upto = F.sum("__n").over(Window.partitionBy("__begin").orderBy(F.col(col).cast("binary")))
    middle = F.col("__start") + F.col("__upto") - F.col("__n") / 2
    level = F.least(F.lit((1 << BITS) - 1), F.floor(middle * (1 << BITS) / F.lit(float(max(total, 1)))))
    return n.withColumn("__upto", upto).join(starts, "__begin").select(F.col(col).alias("__value"), level.cast("int").alias(f"{col}_level"))


def _quantised(value: Column, cuts: list) -> Column:
    """How many of the corpus's cut points lie below or at the value: 0 to 2 ** BITS - 1."""
    return sum((F.when(value >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)) if cuts else F.lit(0)


def ranked(df: DataFrame, first: str, ties: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df with `rank`, 0 to rows - 1, in the order of the integer column `first`, then hash, then ties."""
    sizes = df.groupBy(first).agg(F.count("*").alias("__n"))
    parts = sizes.select(first, F.ceil(F.col("__n") / F.lit(bucket_rows)).alias("__parts"))
    h = F.xxhash64(*ties)
    inside = df.withColumn("__h", h).join(parts, first).withColumn("__b", F.floor((F.shiftright("__h", 32).cast("double") + 2.0**31) * F.col("__parts") / 2.0**32).cast("long"))
    inside = inside.drop("__parts")
    counts = inside.groupBy(first, "__b").agg(F.count("*").alias("__n"))
    starts = counts.select(first, "__b", (F.sum("__n").over(Window.orderBy(first, "__b")) - F.col("__n")).alias("__start"))
    w = Window.partitionBy(first, "__b").orderBy("__h", *ties)
    out = inside.withColumn("__r", F.row_number().over(w)).join(starts, [first, "__b"])
    return out.withColumn("rank", F.col("__start") + F.col("__r") - 1).drop("__h", "__b", "__r", "__start")


def hilbert_shards(docs: DataFrame, shards: int = 40, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, source, lang, cell, law, shard, slot, grown_shard), a row per document.

    size is the text's UTF-8 bytes (null: 0) plus 16, text_crc32 that of its bytes (null: none, 0). Law
    `rows`: shard counts differ by one at most; slot counts from 0 in each shard without gaps, in curve
    order; grown_shard is null. Null ids, sources and languages come first in their dimension. Repeated
    rows get places of their own. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    have = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *have, (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    narrow = saved(narrow, "shard-meta")
    at = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    found = narrow.agg(F.count("*").alias("n"), F.percentile_approx("size", at, 10_000).alias("size")).first()
    for c in ("source", "lang"):
        levels = _levels(narrow, c, found["n"])
        narrow = narrow.join(levels, narrow[c].eqNullSafe(levels["__value"])).drop("__value")
    dims = [F.col("source_level"), F.col("lang_level"), _quantised(F.col("size"), sorted(set(found["size"] or [])))]
    placed = ranked(narrow.withColumn("cell", _curve(dims)).drop("source_level", "lang_level"), "cell", ["text_crc32", "size", "doc_id"], bucket_rows)
    total = max(found["n"], 1)
    shard = F.expr(f"rank * {shards} div {total}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    out = placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - first)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell", "source", "lang")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """docs as Parquet under path, one folder per shard, in slot order; for ids without repeats.

    A reader prunes files by the narrow ranges of source, lang and size that a run of the curve has.
    """
    places = placed.where("doc_id is not null").select("doc_id", "size", "shard", "slot")
    out = docs.drop("size", "shard", "slot").join(places, "doc_id")
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir):
    return hilbert_shards(table(spark, sf_dir, "documents"))
