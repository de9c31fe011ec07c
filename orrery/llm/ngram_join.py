"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

1. Every text becomes its set of word n-grams (64-bit hashes). Equal sets are one class, named by a
   64-bit hash of the set; only classes are joined, so copies never pair up.
2. N-grams that repeat inside a task, in different sets, are counted over the whole corpus; the `FREQUENT` most frequent
   come last in the global order, all others before them by hash. The order decides speed only.
3. A linked pair shares an n-gram among the first n - ceil(t*n) + 1 of both sets (prefix filter). Those
   postings, kept where two classes share them, give candidates in two rounds: first every class with the
   most central class of its key and length band; then, exhaustively, all pairs that share a key but are not
   connected yet, counted once for all keys with the same most central class. Links inside a component would
   not change it and are not looked for.
4. Candidates are verified exactly: the order is cut into fragments, the overlap of a pair is counted in
   each fragment by itself, and the counts are summed per pair.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, bridges, byte_slices, components, discard, frees, leads, mix, saved, shingle_sets, utf8

#: Entries of the list of frequent n-grams (16 bytes each), whatever the corpus.
FREQUENT = 1 << 18
#: The rare part of the order is cut into this many fragments; the frequent n-grams are one more.
RARE_FRAGMENTS = 7
#: Slots of the map of documents to verify.
SLOTS = 1_048_573
#: N-grams that a task gathers before it counts repeats.
COUNT_BLOCK = 3 << 20


def _sets(words):
    def run(batches):
        for batch in batches:
            for row, data, offsets in byte_slices(batch.column("text")):
                yield batch.select([c for c in batch.schema.names if c != "text"]).slice(row, len(offsets) - 1), list(shingle_sets(data, offsets, words))

    return run


def _class(s: np.ndarray) -> int:
    """The class of a set: a hash of its members' sum and number."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum() + np.uint64(len(s)) * np.uint64(0xA0761D6478BD642F)]))[0].astype(np.int64))


_STATS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("cid", pa.int64())])


def _stats(words):
    def run(batches):
        block, held, seen = [], 0, set()

        def repeats():
            h, n = np.unique(np.concatenate(block), return_counts=True)
            h, n = h[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int64()), pa.array(n), pa.array(h.view(np.int64))], schema=_STATS)

        for rows, sets in _sets(words)(batches):
            n = np.array([len(s) for s in sets], np.int64)
            cid = np.array([_class(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), rows.column("doc_id"), rows.column("text_hash"), pa.array(n), pa.array(cid)], schema=_STATS)
            for c, x in zip(cid.tolist(), sets, strict=True):
                if c not in seen:  # copies of a text count once
                    seen.add(c)
                    block.append(x)
                    held += len(x)
            if held > COUNT_BLOCK:
                yield repeats()
                block, held = [], 0
        if block:
            yield repeats()

    return run


def _ordered(s: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """A sorted set in the global order, and how many of it are rare."""
    hashes, counts = often
    if not len(hashes) or not len(s):
        return s, len(s)
    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
    known = hashes[at] == s
    if not known.any():
        return s, len(s)
    common = s[known]
    return np.concatenate([s[~known], common[np.lexsort((common, counts[at[known]]))]]), int(len(s) - known.sum())


_POSTINGS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])


def _postings(words, percent, often):
    def run(batches):
        seen: set[int] = set()
        for _, sets in _sets(words)(batches):
            keys, ids, sizes = [], [], []
            for s in sets:
                if not len(s) or (c := _class(s)) in seen:
                    continue
                seen.add(c)
                keys.append(_ordered(s, often.value)[0][: len(s) - -(-len(s) * percent // 100) + 1])
                ids.append(c)
                sizes.append(len(s))
            if keys:
                many = np.array([len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), many)), pa.array(np.repeat(np.array(sizes, np.int64), many))], schema=_POSTINGS)

    return run


def _live(posts: DataFrame) -> DataFrame:
    """The distinct postings (key, id, n) whose key two classes share.

    Most keys have one posting, so partial sums would be as large as the postings: these move once, and both
    sides of the join read the same shuffle. That takes the same columns on both: n, never negative, stands in the filter.
    """
    dealt = posts.repartition("key")
    shared = dealt.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("n").alias("n")).where("lo <> hi and n >= 0").select("key")
    return dealt.join(shared, "key").distinct()  # a semi-join would be pushed under the deal, which then isn't shared


_SEGMENTS = pa.schema([("id", pa.int64()), ("fragment", pa.int32()), ("members", pa.list_(pa.int64()))])


def _segments(words, often, slots):
    def run(batches):
        def wanted():
            for batch in batches:
                ids = batch.column("doc_id")
                take = slots.value[np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64) % SLOTS]
                if take.any():
                    yield batch.filter(pa.array(take))

        for _, sets in _sets(words)(wanted()):
            ids, fragments, members = [], [], []
            for s in sets:
                if len(s):
                    c = _class(s)
                    order, rare = _ordered(s, often.value)
                    cuts = np.searchsorted(order[:rare], np.array([(f << 64) // RARE_FRAGMENTS for f in range(1, RARE_FRAGMENTS)], np.uint64))
                    for f, part in enumerate([*np.split(order[:rare], cuts), order[rare:]]):
                        if len(part):
                            ids.append(c)
                            fragments.append(f)
                            members.append(part)
            if ids:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, members)]), pa.int32()), pa.array(np.concatenate(members).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fragments, pa.int32()), lists], schema=_SEGMENTS)

    return run


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, component_id) for every row of docs; see ngram_jaccard_components."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    stats = saved(texts.mapInArrow(frees(_stats(words)), "kind int, doc_id long, text_hash long, n long, cid long"), "ngram-stats")
    members = stats.where("kind = 0").select("doc_id", "text_hash", "n", "cid")
    top = stats.where("kind = 1").groupBy("cid").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cid").limit(FREQUENT).toPandas()
    hashes = top["cid"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hashes)
    often = spark.sparkContext.broadcast((hashes[by], top["n"].to_numpy(np.int64)[by]))

    posts = saved(texts.mapInArrow(frees(_postings(words, percent, often)), "key long, id long, n long"), "ngram-postings")
    live = saved(_live(posts), "ngram-live")
    discard(posts)

    prefix = lambda n: n - F.ceil(n * percent / 100.0 - 1e-9) + 1

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among candidates (a, na, b, nb): partial overlaps by fragment, summed per pair."""
        pairs = saved(pairs, "ngram-pairs")
        inside = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        reps = members.join(inside, "cid", "left_semi").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
        slots = np.zeros(SLOTS, bool)
        slots[reps.select(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SLOTS)).alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
        segments = texts.mapInArrow(frees(_segments(words, often, spark.sparkContext.broadcast(slots))), "id long, fragment int, members array<long>")
        segments = saved(segments.join(inside.withColumnRenamed("cid", "id"), "id", "left_semi").dropDuplicates(["id", "fragment"]), "ngram-segments")
        left = segments.select(F.col("id").alias("a"), "fragment", F.col("members").alias("x"))
        right = segments.select(F.col("id").alias("b"), "fragment", F.col("members").alias("y"))
        part = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "na", "b", "nb", F.size(F.array_intersect("x", "y")).cast("long").alias("overlap"))
        links = part.groupBy("a", "na", "b", "nb").agg(F.sum("overlap").alias("overlap")).where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap")))
        links = saved(links.select("a", "b"), "ngram-links")
        discard(pairs, segments)
        return links

    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)))
    first = leads(live, band).where(F.col("shared") >= 0.3 * prefix(F.least("na", "nb"))).drop("shared")
    links = [verified(first)]
    parts = components(links[0])

    # What both have beyond their prefixes is at most what the longer one has there.
    least = f"ceil({percent} * (na + nb) / {100.0 + percent} - 1e-9)"
    rest = bridges(live, parts, percent, f"shared + ceil(greatest(na, nb) * {percent / 100} - 1e-9) - 1 >= {least}")
    links.append(verified(rest))
    discard(live, rest, parts)
    parts = components(reduce(DataFrame.unionByName, links))

    least = members.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"))
    named = least.join(parts.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = saved(named, "ngram-named")
    low = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = named.join(low, "component").select("cid", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return members.join(classes, "cid", "left").select("doc_id", "text_hash", "n", component.alias("component_id"))


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs.

    Two texts link when 100 * |A & B| >= percent * |A | B| over their distinct word n-grams (lower-cased
    A-Z; words are runs of bytes other than ASCII white space; with fewer words the whole sequence is one
    n-gram). component_id is the least id reachable by links. Null and empty texts, and texts of white
    space, have no n-grams and link with nothing: their component is their own id. Rows with a null id are
    returned with their size and a null component unless they belong to a class with an id, and then have
    its component; repeated rows are repeated in the result. Other columns are not read.
    """
    out = _linked(docs, id_col, text_col, words, percent)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate group: that of the least (doc_id, xxhash64 of the text).

    Rows are judged by id and text, so that a repeated id loses no text of another group; rows equal in both
    are one document and stand once. Texts without words are in no group. Rows without an id are kept.
    """
    found = saved(_linked(docs, "doc_id", "text", words, percent).where("doc_id is not null and n > 0"), "ngram-found")
    best = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    gone = found.join(best, "component_id").where("doc_id <> best.doc_id or text_hash <> best.text_hash")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    own = (F.col("doc_id") == F.col("__id")) & (F.xxhash64(utf8("text")) == F.col("__hash"))
    kept = docs.join(gone, own, "left_anti").select(*docs.columns)
    again = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).count().where("count > 1").drop("count")
    if again.isEmpty():
        return kept
    return kept.join(again, own, "left_anti").unionByName(kept.join(again, own, "left_semi").dropDuplicates(["doc_id", "text"]))


def query(spark, sf_dir):
    from orrery.llm.common import table

    return ngram_jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)
