"""Fuzzy line de-duplication by MinHash, in DataFrame and SQL functions only.

Two lines are near copies when the Jaccard similarity of their sets of character shingles (all runs of
`GRAM` characters, overlapping, in any script; a shorter line is one) is at the threshold or above.

Signature: one-permutation MinHash over runs of `WINDOW` characters. A run's hash names one of `BINS` bins
and a value, a bin keeps its least value. Every two neighbouring bins, in a circle, are one band. The runs are
longer than the shingles because random lines of one language share many short runs and few long ones, so that
bands of two values are selective; an edited character spoils at most `WINDOW` runs where it spoils `GRAM`
shingles, so that lines of a similarity of 0.8 still have a similarity of 0.56 or more in runs, and share a band
in 0.988 of all cases at worst (edits far apart, exactly at the threshold) and nearly always elsewhere. Runs
are made as rows by `explode`, not by a function over arrays: everything stays in generated code. Of a long
line only runs whose hash is low take part, some `DENSITY` a bin: the least of a bin is among them.

Lines of at most `SHORT` characters also have bands of their sorted shingle hashes, closed to a circle: so
many neighbours (`BANDS`) are one band, from every value on in lines of up to 30 shingles. A similarity of 0.8
leaves some four neighbours in both, and no pair is missed.

Lines that share a band are candidates, in two rounds. First every line with the most central line of its
bucket. Then, exhaustively, the lines of a bucket that aren't connected yet: every line's shingles are a map of
`WORDS` longs, a bit by each one's hash the parity of the shingles there, so that common ones cancel and two maps
differ in at most as many bits as the sets have members that only one holds. Pairs are told apart by their maps where they meet, and only those that may be linked leave the
join. Nothing above the threshold is lost, and buckets with the same centre are worked on as one. The members of
the centre's largest component meet the others only, so that many copies of one line cost nothing.

Candidates of the first round whose signatures agree in fewer than `AGREE` bins are passed over (at worst 0.0007
of the pairs at the threshold), those with a short line or one of few values never. All others are verified by
the exact Jaccard similarity of their shingles, made anew from the two lines' text: moving text instead of sets
moves an eighth of the bytes. Links become components by distributed union-find; the least (doc_id, position) of
a component keeps its line.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import central, components, discard, saved, table

#: Characters of a shingle, and of a run that the signature is made of.
GRAM, WINDOW = 4, 10
#: Bins of the signature, and the runs of a long line that each gets on average.
BINS, DENSITY = 16, 4
#: Bins that two lines longer than `SHORT` agree in, else they aren't compared.
AGREE = 3
#: Lines with values in fewer bins than these also have bands of their neighbouring values, whatever the bins.
FEW = 10
#: Characters of a line that has bands of sorted shingles too.
SHORT = 78
#: Values in such a band, and the most shingles of a line that makes it.
BANDS = ((4, 30), (5, SHORT - GRAM + 1))
#: Longs in the map of a line's shingles.
WORDS = 32
#: Longs of a map that a row of it holds while shingles are counted in; every shingle updates all of its row.
PART = 4
#: Parts of the range of which each first value begins a band of the second kind.
REGIONS = 20
#: What the queries take for min_chars: every line that isn't blank.
ALL_LINES = 1
#: Keys of which a copy may be sent to every executor (24 bytes each at most); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
_WHOLE_STAGE = "spark.sql.codegen.wholeStage"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once: a lambda inside body would make it anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(line: str, size: int = GRAM, ordered: bool = False) -> Column:
    """Hashes of the line's n-grams, distinct; a shorter line is its own only one.

    Only the hashes are made inside a lambda, which isn't compiled; `array_distinct` of longs outside of it is.
    """
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), 4 * (F.length(line) - size) + 1), F.lit(4))
    grams = lambda chars: F.transform(places, lambda i: F.xxhash64(F.substring(chars, i, F.lit(4 * size))))
    out = F.array_distinct(_bound(F.encode(F.col(line), "UTF-32"), grams))
    return F.sort_array(out) if ordered else out


def _bands(s: str, n: str, percent: int) -> Column:
    """Keys of the bands of a short line with the sorted shingles s, n in number."""
    region = lambda x: F.shiftright(F.shiftright(x, 40) * REGIONS, 24)
    place = lambda parts: F.transform(F.array_distinct(parts), lambda v: F.array_position(parts, v).cast("int"))
    firsts = _bound(F.transform(s, region), place)
    circle = F.concat(s, F.slice(s, 1, BANDS[-1][0] - 1))
    band = lambda rows, starts: lambda c: F.transform(starts, lambda i: F.xxhash64(F.lit(rows), F.slice(c, i, F.lit(rows))))  # noqa: E731  a second parameter would be the index
    keys, least = [], 0
    for rows, most in BANDS:
        starts = F.sequence(F.lit(1), F.col(n)) if not keys else firsts
        made = _bound(circle, band(rows, starts))
        keys.append(F.when(F.col(n).between(least, most), made).otherwise(F.array().cast("array<bigint>")))
        least = (most + 1) * percent // 100
    return F.array_distinct(F.concat(*keys))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, pos, line, id) of the lines that take part; id is a 64-bit hash of the normalised line."""
    rows = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    rows = rows.select("doc_id", "pos", F.trim("line").alias("line"))
    return rows.where(F.length("line") >= min_chars).withColumn("id", F.xxhash64("line"))


def _minima(lines: DataFrame) -> DataFrame:
    """(id, last, m0, m1, ..) from (id, line): the least value of every bin, null where it has none; one row per id.

    `last` is the place of the last run: the line's length less that of a run, or 0.

    The first few runs take part whatever their hash, so that a long line of few different runs has values
    too; they never displace a lower one.
    """
    units = lines.select("id", F.encode(F.col("line"), "UTF-16BE").alias("u"))
    units = units.withColumn("last", F.greatest(F.lit(0), F.expr("octet_length(u) div 2").cast("int") - WINDOW))
    runs = units.select("id", "u", "last", F.explode(F.expr("sequence(0, last)")).alias("i"))
    runs = runs.select("id", "i", "last", F.xxhash64(F.expr(f"substring(u, 2 * i + 1, {2 * WINDOW})")).alias("h"))
    low = F.shiftrightunsigned("h", 40) * (F.col("last") + 1).cast("long") <= F.lit(BINS * DENSITY << 24)
    runs = runs.where((F.col("i") < BINS) | low).select("id", "last", F.col("h").bitwiseAND(F.lit(BINS - 1)).alias("bin"), F.shiftrightunsigned("h", 33).cast("int").alias("v"))
    return runs.groupBy("id").agg(F.max("last").alias("last"), *[F.min(F.when(F.col("bin") == j, F.col("v"))).alias(f"m{j}") for j in range(BINS)])


def _minima_bands(minima: DataFrame) -> DataFrame:
    """(key, id): the bands of the signatures."""
    m = [F.col(f"m{j}") for j in range(BINS)]
    pairs = [F.when(m[j].isNotNull() & m[(j + 1) % BINS].isNotNull(), F.xxhash64(F.lit(j), m[j], m[(j + 1) % BINS])) for j in range(BINS)]
    every = minima.select("id", F.explode(F.array(*pairs)).alias("key")).where("key is not null").select("key", "id")
    few = minima.select("id", F.array_compact(F.array(*m)).alias("v")).where(F.size("v") < FEW)
    near = F.transform("v", lambda x, i: F.xxhash64(F.lit(-1), x, F.get("v", (i + 1) % F.size("v"))))
    return every.unionByName(few.select(F.explode(F.array_distinct(near)).alias("key"), "id"))


def _alike(pairs: DataFrame, minima: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be worth a comparison, by their signatures."""
    side = lambda x: minima.select(F.col("id").alias(x), F.col("last").alias(f"last_{x}"), *[F.col(f"m{j}").alias(f"{x}{j}") for j in range(BINS)])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    agree = sum((F.when(F.col(f"a{j}") == F.col(f"b{j}"), 1).otherwise(0) for j in range(BINS)), F.lit(0))
    filled = [sum((F.col(f"{x}{j}").isNotNull().cast("int") for j in range(BINS)), F.lit(0)) for x in "ab"]
    return both.where((F.least("last_a", "last_b") <= SHORT - WINDOW) | (F.least(*filled) < FEW) | (agree >= AGREE)).select("a", "b")


@contextmanager
def _small_methods(spark: SparkSession):
    """Within, conditions on many columns are compiled by themselves.

    In one method with their join they come near the size that the JVM doesn't compile, or does late.
    """
    before = spark.conf.get(_WHOLE_STAGE, None)
    spark.conf.set(_WHOLE_STAGE, "false")
    try:
        yield
    finally:
        spark.conf.unset(_WHOLE_STAGE) if before is None else spark.conf.set(_WHOLE_STAGE, before)


def _semi(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of df that have one of the keys, all of whose columns are df's."""
    small = keys.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if small else keys, keys.columns, "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose lines' exact Jaccard similarity reaches the threshold; `texts` has (id, line)."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    both = both.select("a", "b", _shingles("x", size).alias("x"), _shingles("y", size).alias("y"))
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("n") - F.col("common"))).select("a", "b")


def _texts(lines: DataFrame, least: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line) of the ids, each read where it stands first."""
    return _semi(lines, ids.join(least, "id").select("id", "k.doc_id", "k.pos")).select("id", "line")


def _apart(live: DataFrame, heads: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, lead, id, c, members): the lines of buckets that hold several components c beside their centre."""
    p = live.join(heads, "key").where("id <> lead").join(parts, "id", "left").select("key", "lead", "id", F.coalesce("component", "id").alias("c"))
    mixed = p.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("key", "members")
    return p.join(mixed, "key")


def _grams(lines: DataFrame, size: int) -> DataFrame:
    """(id, h) of the members of `_shingles`, as rows."""
    return lines.select("id", F.explode(_shingles("s", size)).alias("h"))


def _maps(members: DataFrame) -> DataFrame:
    """(id, n, w0, w1, ..) from distinct (id, h): the members' number and their map, the parities of those at each bit."""
    h = F.xxhash64("h")
    rows = members.select("id", F.shiftrightunsigned(h, 58).cast("int").bitwiseAND(F.lit(WORDS - 1)).alias("w"), F.expr("shiftleft(1L, cast(xxhash64(h) & 63 as int))").alias("bit"))
    xor = lambda where, bits: F.bit_xor(F.when(where, F.col(bits)).otherwise(F.lit(0).cast("long")))
    parts = rows.groupBy("id", F.expr(f"w div {PART}").alias("part")).agg(F.count("*").alias("n"), *[xor(F.col("w") % PART == j, "bit").alias(f"v{j}") for j in range(PART)])
    return parts.groupBy("id").agg(F.sum("n").alias("n"), *[xor(F.col("part") == j // PART, f"v{j % PART}").alias(f"w{j}") for j in range(WORDS)])


def _unconnected(apart: DataFrame, sets: DataFrame, percent: int, of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b) of lines (lead, id, c) with the same centre, in different components, that may reach the threshold.

    With sizes na, nb a pair is linked when its difference holds at most q * (na + nb) shingles, where
    q = (100 - percent) / (100 + percent). A bit is the parity of the members there and those of both lines cancel,
    so each bit in which the maps differ is of a shingle that one of them lacks, and no shingle has two bits: with
    more such bits the pair isn't linked, nor where the sizes alone forbid it. `sets` has (id, s), of which `of`
    makes the rows (id, h) of the set, each once; without it s is an array of them.

    No pair leaves its join before this test, and none inside a centre's largest component is made.
    """
    p = apart.select("lead", "id", "c").distinct()
    most = p.groupBy("lead", "c").agg(F.count("*").alias("m")).groupBy("lead").agg(F.max(F.struct("m", "c")).alias("most"))
    sets = sets.repartition("id")  # the maps then need no other move
    maps = _maps(of(sets) if of else sets.select("id", F.explode("s").alias("h")))
    words = [f"w{j}" for j in range(WORDS)]
    lines = saved(p.join(most, "lead").join(maps, "id").select("lead", "id", "c", (F.col("c") == F.col("most.c")).alias("most"), "n", *words), "line-maps")
    other = " + ".join(f"bit_count(x.{w} ^ y.{w})" for w in words)
    met = f"x.lead = y.lead and x.c <> y.c and (y.most or x.id < y.id) and {percent} * greatest(x.n, y.n) <= 100 * least(x.n, y.n) and {100 + percent} * ({other}) <= {100 - percent} * (x.n + y.n)"
    pairs = lines.where("not most").alias("x").join(lines.alias("y"), F.expr(met))
    with _small_methods(apart.sparkSession):
        out = saved(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "line-pairs")
    discard(lines)
    return out


def duplicate_lines(docs: DataFrame, percent: int = 80, size: int = GRAM, min_chars: int = 16) -> DataFrame:
    """(doc_id, pos, keep_doc, keep_pos) of every line that repeats another, with the line that stays.

    Positions count from 0 at newlines. Lines of fewer than min_chars characters without surrounding
    blanks (empty ones above all), null texts and rows without an id take no part. Equal lines (in lower
    case) are one class whatever their length. Rows that repeat an id are the same document.
    """
    lines = saved(_lines(docs.select("doc_id", "text"), min_chars), "line-rows")
    rows = lines.select("doc_id", "pos", "id")
    least = saved(rows.groupBy("id").agg(F.min(F.struct("doc_id", "pos")).alias("k"), F.count("*").alias("copies")), "line-least")

    minima = saved(_minima(lines.select("id", "line")), "line-minima")
    short = lines.where(F.length("line") <= SHORT).select("id", "line").dropDuplicates(["id"]).select("id", _shingles("line", size, ordered=True).alias("s"))
    short = saved(short.select("id", "s", F.size("s").alias("n")).select("id", _bands("s", "n", percent).alias("keys")), "line-short")
    posts = _minima_bands(minima).unionByName(short.select(F.explode("keys").alias("key"), "id"))
    shared = saved(posts.groupBy("key").count().where("count > 1").select("key"), "line-shared")
    live = saved(_semi(posts, shared), "line-live")
    heads = saved(central(live.withColumn("n", F.lit(0))).select("key", F.col("lead.id").alias("lead")), "line-heads")
    near = saved(live.join(heads, "key").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "line-near")
    with _small_methods(docs.sparkSession):
        first = saved(_alike(near, minima), "line-first")
    discard(minima, short, shared, near)

    texts = lambda pairs: saved(_texts(lines, least, pairs), "line-texts")
    met = texts(first.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    one = saved(_verified(first, met, percent, size), "line-links")
    discard(met, first)
    parts = components(one)
    apart = saved(_apart(live, heads, parts), "line-apart")
    met = texts(apart.select("id").distinct())
    rest = _unconnected(apart, met.withColumnRenamed("line", "s"), percent, lambda s: _grams(s, size))
    two = saved(_verified(rest, met, percent, size), "line-links")
    discard(parts, rest, live, heads, apart, met)
    parts = components(one.unionByName(two))
    discard(one, two)

    keep = saved(least.join(parts, "id", "left").where("copies > 1 or component is not null").select("id", "k", F.coalesce("component", "id").alias("component")), "line-keep")
    discard(parts, least)
    best = keep.groupBy("component").agg(F.min("k").alias("k"))
    stays = keep.select("id", "component").join(best, "component").select("id", F.col("k.doc_id").alias("keep_doc"), F.col("k.pos").alias("keep_pos"))
    return rows.join(stays, "id").where("doc_id <> keep_doc or pos <> keep_pos").select("doc_id", "pos", "keep_doc", "keep_pos")


def dedup_lines(docs: DataFrame, percent: int = 80, size: int = GRAM, min_chars: int = 16) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_lines and n_removed (columns of these names go).

    A null text stays null (no lines); an empty one is one empty line and stays.
    """
    gone = duplicate_lines(docs, percent, size, min_chars).groupBy("doc_id").agg(F.collect_set("pos").alias("__gone"))
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    base = docs.drop("n_lines", "n_removed").join(gone, "doc_id", "left").withColumn("__lines", F.when(F.col("__gone").isNotNull(), lines))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("__lines", i + 1)), "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    out = base.withColumn("n_lines", count.cast("long")).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).withColumn("text", text)
    return out.withColumn("n_removed", F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.col("n_removed")).cast("long")).drop("__gone", "__lines")


def query(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=ALL_LINES)
