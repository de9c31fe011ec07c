"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1 (piecewise linear, given by knots). The
schedule's integral, scaled to the source's target, is its cumulative demand for words. The documents of a
source stand in an order drawn by hash; the words before a document (and before each of its repeats) are
looked up in the inverse of the demand, which gives the training position. Sorting by range of the
position makes the training order: no shuffle of one source waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import saved, table

WEIGHTS = (5.0, 2.0, 1.0)
#: Schedules of the sources in turn: heavy sources fade, light ones grow.
KNOTS = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Rows that one window sums, about.
BUCKET_ROWS = 20_000


def word_count(text: Column | str) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " "), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = 3) -> DataFrame:
    """(key, source_size, place, target) from (key, missing, source_size), a row per source.

    The weights go round the sources in code point order, null last. Shares of all words by weight; a
    target above repeats * source_size stops there and the excess is shared again by weight. In closed
    form: sources stop in the order of (limit / weight), and the water level over the others is the least
    that fits. Orders one row per source, not per document.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(Window.orderBy("missing", "key")) - 1).withColumn("w", w).withColumn("limit", F.col("source_size") * float(repeats))
    by = Window.orderBy(F.col("limit") / F.col("w"), "place")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
    fits = F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), "place", "level"))
    level = F.min(fits).over(every)["level"]
    return s.withColumn("target", F.coalesce(F.least("limit", level * F.col("w")), "limit")).select("key", "source_size", "place", "target")


def _demand(knots) -> tuple[list[float], list[float], list[float]]:
    """Knot times, weights scaled to an integral of 1, and the integral up to each knot."""
    t, w = [float(a) for a, _ in knots], [float(b) for _, b in knots]
    if t[0] != 0 or t[-1] != 1 or any(a >= b for a, b in zip(t, t[1:], strict=False)) or min(w) < 0 or max(w) <= 0:
        raise ValueError("a schedule runs from 0 to 1 with weights that are not negative")
    upto = [0.0]
    for i in range(len(t) - 1):
        upto.append(upto[-1] + (w[i] + w[i + 1]) / 2 * (t[i + 1] - t[i]))
    return t, [x / upto[-1] for x in w], [x / upto[-1] for x in upto]


def position(place: Column, share: Column, schedules=KNOTS) -> Column:
    """Training time at which a source in that place has used that share (0 to 1) of its target."""
    out = None
    for i, knots in enumerate(schedules):
        t, w, upto = _demand(knots)
        expr = F.lit(1.0)
        for j in reversed(range(len(t) - 1)):
            slope, rest = (w[j + 1] - w[j]) / (t[j + 1] - t[j]), share - upto[j]
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w[j] ** 2) + 2 * slope * rest))
            step = 2 * rest / F.greatest(F.lit(1e-300), F.lit(w[j]) + root)
            expr = F.when(share < upto[j + 1], F.lit(t[j]) + step).otherwise(expr)
        out = F.when(place % len(schedules) == i, expr) if out is None else out.when(place % len(schedules) == i, expr)
    return out


def plan_mix(docs: DataFrame, weights=WEIGHTS, schedules=KNOTS, repeats: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, row, size, source_size, target, taken, positions), a row per row of docs.

    size counts words (null text: 0); `row` is a hash of id, source and text. A source takes its documents
    in hash order, again from the start when it ends, until floor(target) words are taken; the last one is
    taken in part. `positions` has a training time from 0 to 1 for each repeat of the document, none when
    nothing is taken. Null sources are one source, in the last place. Reruns agree.
    """
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    have = docs if "source" in docs.columns else docs.withColumn("source", F.lit(None).cast("string"))
    rows = have.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), word_count("text").alias("size"), F.xxhash64(F.col("doc_id").cast("long"), "source", "text").alias("row"))
    rows = saved(rows.withColumn("h", F.xxhash64("doc_id", F.lit("order"))), "mix-sizes")
    sources = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = source_targets(sources.select("key", (F.col("key") == "").alias("missing"), "source_size"), weights, repeats)
    about = saved(targets.join(sources.select("key", F.ceil(F.col("rows") / F.lit(bucket_rows)).alias("parts")), "key"), "mix-targets")
    b = F.floor((F.shiftright("h", 32).cast("double") + 2.0**31) * F.col("parts") / 2.0**32).cast("long")
    inside = rows.join(about, "key").withColumn("b", b).drop("parts")
    sums = inside.groupBy("key", "b").agg(F.sum("size").alias("s"))
    starts = sums.select("key", "b", (F.sum("s").over(Window.partitionBy("key").orderBy("b")) - F.col("s")).alias("start"))
    w = Window.partitionBy("key", "b").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("c", F.sum("size").over(w) - F.col("size")).join(starts, ["key", "b"]).withColumn("before", F.col("c") + F.col("start"))
    whole = F.floor("target")
    begins = [F.col("before") + p * F.col("source_size") for p in range(repeats)]
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), whole - x)) for x in begins), F.lit(0))
    places = F.array(*[F.when((x < whole) & (F.col("size") > 0), position(F.col("place"), x / F.col("target"), schedules)) for x in begins])
    return inside.select("doc_id", "row", "size", "source_size", "target", taken.cast("long").alias("taken"), F.array_compact(places).alias("positions"))


def mixed(docs: DataFrame, weights=WEIGHTS, schedules=KNOTS, repeats: int = 3) -> DataFrame:
    """docs as the mix takes them, whole: a row per repeat, with `position` (a column of that name goes), range-sorted by it.

    The one document per source that the target cuts is here in full. Documents that the mix doesn't take,
    and those without words, are gone. Equal rows are taken as often as all of them are, with the positions of
    all of them.
    """
    plan = plan_mix(docs, weights, schedules, repeats).select(F.col("row").alias("__mix_row"), F.explode("positions").alias("position"))
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    base = docs.drop("position").withColumn("__mix_row", F.xxhash64(F.col("doc_id").cast("long"), source, F.col("text")))
    base = base.withColumn("__mix_copy", F.row_number().over(Window.partitionBy("__mix_row").orderBy("__mix_row"))).where("__mix_copy = 1")
    out = base.join(plan, "__mix_row").drop("__mix_row", "__mix_copy")
    return in_order(out)


def in_order(df: DataFrame) -> DataFrame:
    """Range-sorted by `position` and doc_id: the files of the result follow each other in training order."""
    return df.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def query(spark, sf_dir):
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return in_order(plan.select("doc_id", "size", "source_size", "target", "taken", "positions", F.get("positions", F.lit(0)).alias("position")))
