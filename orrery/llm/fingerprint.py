"""Document fingerprints by a homomorphic multiset hash, in DataFrame and SQL functions only.

A paragraph (a line) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, component by component, modulo 2**32. So paragraphs may come in any order, and one is put in or
taken out by adding or subtracting its vector. Two parts of the vector:

* `EXACT` components of 32 bits, cut from the paragraph's SHA-256. Their sums are equal for equal multisets of
  paragraphs. Sums of other multisets are equal by chance with probability 2**-256; sums modulo a power of two
  do not withstand someone who searches for a collision.
* `LANES` components that count, over the paragraph's pairs of neighbouring words, how often a bit of the
  pair's hash is set. Centred, they are a random +1/-1 projection, whose inner products estimate how many
  pairs two documents share: the likeness. Two lanes lie in one long, 32 bits each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import saved, table

EXACT, LANES = 8, 128
_MOD = 1 << 32
#: Quantiles at which ids are cut; with more ranges than these, they are cut evenly in between.
MOST_CUTS = 500
#: Each long holds the bits j and j + 32 of a pair's hash.
_PAIRED = (1 << 32) | 1


def paragraph_vectors(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, e0.., l0.., pairs): the summed vectors of the paragraphs of each row of texts; null is empty.

    Rows of the same keys are the same text.
    """
    lines = texts.select(*keys, F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("p"))
    words = F.transform(F.split("p", " "), lambda w: F.xxhash64(w))
    lines = lines.select(*keys, F.sha2(F.col("p").cast("binary"), 256).alias("digest"), words.alias("w"))
    pairs = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), F.slice("w", 1, F.size("w") - 1)), "w", lambda a, b: F.shiftleft(a, 1).bitwiseXOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(b))
    units = lines.select(*keys, "digest", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), pairs)).alias("i", "u")).withColumn("v", F.xxhash64("u", F.lit(1))).withColumn("v2", F.xxhash64("u", F.lit(2)))
    whole, zero = F.col("i") == 0, F.lit(0).cast("long")
    exact = [F.sum(F.when(whole, F.conv(F.substring("digest", 8 * j + 1, 8), 16, 10).cast("long")).otherwise(zero)) for j in range(EXACT)]
    lanes = [F.sum(F.when(whole, zero).otherwise(F.shiftrightunsigned(c, j).bitwiseAND(F.lit(_PAIRED)))) for c in ("v", "v2") for j in range(32)]
    sums = [x.alias(f"e{i}") for i, x in enumerate(exact)] + [x.alias(f"l{i}") for i, x in enumerate(lanes)]
    return units.groupBy(*keys).agg(*sums, F.sum(F.when(whole, 0).otherwise(1)).alias("pairs"))


def _print(v: str) -> Column:
    """The hexadecimal fingerprint of a struct of summed components."""
    exact = [F.lpad(F.hex(F.col(f"{v}.e{i}").bitwiseAND(F.lit(_MOD - 1))), 8, "0") for i in range(EXACT)]
    return F.lower(F.concat(*exact, *[F.lpad(F.hex(F.col(f"{v}.l{i}")), 16, "0") for i in range(LANES // 2)], F.lpad(F.hex(F.col(f"{v}.pairs")), 8, "0")))


def _lanes(v: str) -> Column:
    """Its lanes, centred."""
    longs, n = [F.col(f"{v}.l{i}") for i in range(LANES // 2)], F.col(f"{v}.pairs")
    return F.array(*[2 * F.shiftrightunsigned(x, 32) - n for x in longs], *[2 * x.bitwiseAND(F.lit(_MOD - 1)) - n for x in longs])


def likeness(fa: Column | str, a: Column | str, fb: Column | str, b: Column | str) -> Column:
    """1 for equal fingerprints, else the estimated share of word pairs in both among those in either, 0 to 1."""
    fa, a, fb, b = (F.col(x) if isinstance(x, str) else x for x in (fa, a, fb, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, t: s + t)
    shared = dot(a, b)
    either = dot(a, a) + dot(b, b) - shared
    return F.when(fa == fb, 1.0).when(either <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared / either)))


def combine(a: Column | str, b: Column | str, sign: int = 1) -> Column:
    """The fingerprint of a's paragraphs and b's together; with sign -1 that of a's without b's.

    So a paragraph is put into a document, or taken out of it, by its own fingerprint, without the text. Taking
    out what isn't there gives a fingerprint that no text has.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    part = lambda f, i: F.conv(F.substring(f, 8 * i + 1, F.lit(8)), 16, 10).cast("long")
    added = F.transform(F.sequence(F.lit(0), F.lit(EXACT + LANES)), lambda i: F.lpad(F.hex(F.pmod(part(a, i) + sign * part(b, i), F.lit(_MOD))), 8, "0"))
    return F.lower(F.array_join(added, ""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every distinct (doc_id, text); null and empty texts are one empty paragraph."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"))
    sums = paragraph_vectors(keyed, ["row", "doc_id"])
    return sums.select("doc_id", F.struct(*[c for c in sums.columns if c not in ("row", "doc_id")]).alias("v")).select("doc_id", _print("v").alias("fingerprint"))


def in_ranges(texts: DataFrame, bucket_rows: int = 2_000) -> DataFrame:
    """texts (doc_id, text, without nulls in text) with `b`, a range of ids, and `ghost`.

    Ids are cut at corpus-wide quantiles, and between two of them evenly; rows without an id get ranges below 0
    by their text. Every range has a ghost (ghost = 1): the first row, by (doc_id, text), of the range that
    follows, the last range that of the first. So each row finds the next one in its own range. Only the
    ranges' least ids are ordered together.
    """
    found = texts.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    low, high = found[1] or 0, found[2] or 0
    parts = min(MOST_CUTS, max(1, found[0] // bucket_rows))
    cuts = texts.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    edges = sorted({low, *(cuts or [])})
    fine = max(1, -(-found[0] // bucket_rows // parts))
    list_ = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<long>")
    at = F.greatest(F.lit(1), F.size(F.filter(list_, lambda c: c <= F.col("doc_id")))).cast("long")
    t = texts.withColumn("b", at)
    if fine > 1:
        ends = F.concat(list_, F.array(F.lit(high).cast("long")))
        first, last = (F.element_at(ends, F.col("b").cast("int") + i).cast("double") for i in (0, 1))
        share = (F.col("doc_id").cast("double") - first) / F.greatest(F.lit(1.0), last - first)
        t = t.withColumn("b", F.col("b") * fine + F.least(F.lit(fine - 1), F.floor(share * fine)).cast("long"))
    t = t.withColumn("b", F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(parts * fine))).otherwise(F.col("b")))
    least = saved(t.where("doc_id is not null").groupBy("b").agg(F.min("doc_id").alias("doc_id")), "fingerprint-ranges")
    firsts = t.join(least, ["b", "doc_id"]).groupBy("b").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    every = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = least.select("b", F.coalesce(F.lag("b").over(Window.orderBy("b")), F.max("b").over(every)).alias("to"))
    ghosts = firsts.join(before, "b").select("first.doc_id", "first.text", F.col("to").alias("b"), F.lit(1).alias("ghost"))
    return t.withColumn("ghost", F.lit(0)).unionByName(ghosts)


def edited_fingerprints(docs: DataFrame, bucket_rows: int = 2_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document in ascending doc_id, the last by the first. Null texts are empty. Rows that repeat an
    id stand one after the other in the order of their texts, and those equal in both are one document with a
    row for each. Rows without an id have no next document: nothing is put in, and near_next is 0.

    Texts move once, to their range of ids. The sums and the two comparisons are made where they lie.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("b").orderBy("ghost", "doc_id", "text")
    t = in_ranges(texts, bucket_rows)
    for name in ("doc_id", "text", "ghost"):
        t = t.withColumn(f"next_{name}", F.lead(name).over(order))
    t = t.withColumn("at", F.row_number().over(order))
    t = t.where("ghost = 1 or next_ghost is null or next_ghost = 1 or not (doc_id <=> next_doc_id) or text <> next_text")  # of equal rows the last
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    put = F.when(F.col("doc_id").isNotNull(), F.left("next_text", k)).otherwise(F.lit(""))
    t = t.select("b", "at", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.left("text", n - k), put).alias("edited"))
    digest = F.unhex(F.sha2(F.col("edited").cast("binary"), 256))
    own = F.struct(F.lit(0).alias("side"), F.col("text"), F.lit(None).cast("binary").alias("sha"))
    new = F.when(F.col("ghost") == 0, F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"), digest.alias("sha")))
    t = t.select("b", "at", "ghost", "doc_id", "n_chars", F.explode(F.array(own, new)).alias("x")).where("x is not null")
    keys = ["b", "at", "side", "ghost", "doc_id", "n_chars", "sha"]
    sums = paragraph_vectors(t.select("b", "at", "ghost", "doc_id", "n_chars", "x.side", "x.sha", "x.text"), keys)
    sums = sums.select(*keys, F.struct(*[c for c in sums.columns if c not in keys]).alias("a"))
    sides = Window.partitionBy("b").orderBy("at", "side")
    sums = sums.withColumn("b_", F.lead("a", 1).over(sides)).withColumn("edited_sha", F.lead("sha", 1).over(sides)).withColumn("c", F.lead("a", 2).over(sides)).withColumn("upto", F.lag("at", 2).over(sides))
    out = sums.where("side = 0 and ghost = 0").select("doc_id", "n_chars", (F.col("at") - F.coalesce("upto", F.lit(0))).alias("copies"), F.lower(F.hex("edited_sha")).alias("edited_sha256"), *[x for s, v in (("a", "a"), ("b", "b_"), ("c", "c")) for x in (_print(v).alias(f"f{s}"), _lanes(v).alias(f"l{s}"))])
    near_next = F.when(F.col("doc_id").isNull(), 0.0).otherwise(likeness("fa", "la", "fc", "lc"))
    out = out.select("doc_id", "n_chars", "edited_sha256", F.col("fa").alias("fingerprint"), F.col("fb").alias("edited_fingerprint"), likeness("fa", "la", "fb", "lb").alias("near_edited"), near_next.alias("near_next"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return out.drop("copy")


def query(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))
