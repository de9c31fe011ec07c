"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of `WIDTH` bytes slide over every byte of a document; each filter's response is rectified
and max-pooled over overlapping chunks of two blocks of `BLOCK` bytes (a chunk begins at every block); the
chunks' mean goes through a logistic unit. So the whole document counts, whatever its length.

The network is fitted on the driver on a bounded sample of labelled documents: of either class up to
`SAMPLE` documents, those least by a hash of their id, whatever their length. A document of more than
`SAMPLE_BYTES` bytes stands in the sample by as many, in blocks spread evenly from its first byte to its last.
Classes are weighed back to their share among all labels of the training folds. Scoring runs over Arrow
batches, on whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import bounded_batches, byte_slices, frees, table, utf8

WIDTH, FILTERS, BLOCK = 4, 16, 512
SAMPLE, SAMPLE_BYTES = 700, 32 * 512
EPOCHS, RATE, SEED = 14, 0.02, 7
#: Bytes that the kernel scores at once.
KERNEL_BYTES = 1 << 18


class ByteCNN:
    """Filters (WIDTH, 256, FILTERS), their bias, and the logistic unit's weights and bias."""

    def __init__(self, filters, bias, weights, offset):
        self.filters, self.bias, self.weights, self.offset = filters, bias, weights, offset

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of a run of rows; an empty row is one zero byte."""
        out = np.empty(len(offsets) - 1)
        row = 0
        while row < len(out):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + KERNEL_BYTES, side="right")) - 1)
            if end == row + 1:
                sums, n = self._long(data[offsets[row] : offsets[end]])
                logits = self._logits(sums[None], n)
            else:
                logits = self._run(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
            out[row:end] = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
            row = end
        return out

    def _logits(self, sums, chunks):
        """Of each row alone, in an order of its own: a text scores the same in any batch."""
        return (sums * self.weights).sum(1) / chunks + self.offset

    def _pooled(self, padded: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Maxima of the rectified responses from each start to the next, over padded bytes."""
        n = len(padded) - WIDTH + 1
        r = np.empty((n + 1, FILTERS), np.float32)
        np.take(self.filters[0], padded[:n], axis=0, out=r[:n], mode="clip")
        for k in range(1, WIDTH):
            r[:n] += self.filters[k][padded[k : k + n]]
        r[n] = -np.inf
        return np.maximum(np.maximum.reduceat(r, starts) + self.bias, 0)

    def _run(self, data, offsets):
        lengths = np.maximum(np.diff(offsets), 1)
        at = np.concatenate([[0], np.cumsum(lengths + WIDTH - 1)])
        padded = np.zeros(at[-1], np.uint8)
        for i in range(len(lengths)):
            padded[at[i] : at[i] + offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
        blocks = -(-lengths // BLOCK)
        doc = np.repeat(np.arange(len(lengths)), blocks)
        first = np.concatenate([[0], np.cumsum(blocks)])
        starts = at[doc] + (np.arange(first[-1]) - first[doc]) * BLOCK
        ends = np.minimum(starts + BLOCK, at[doc] + lengths[doc])
        m = self._pooled(padded, np.stack([starts, ends], 1).ravel())[::2]
        chunk = m.copy()
        same = doc[1:] == doc[:-1]
        chunk[:-1][same] = np.maximum(m[:-1][same], m[1:][same])
        keep = np.ones(len(doc), bool)
        keep[first[1:] - 1] = blocks == 1
        sums = np.add.reduceat(np.where(keep[:, None], chunk, 0).astype(float), first[:-1])
        return self._logits(sums, np.maximum(blocks - 1, 1))

    def _long(self, data):
        """Sum of the chunks' vectors and their number for one document, by pieces of bounded size."""
        step, n = KERNEL_BYTES // BLOCK * BLOCK, max(len(data), 1)
        total, chunks, before = np.zeros(FILTERS), 0, None
        for a in range(0, n, step):
            piece = np.zeros(min(step, n - a) + WIDTH - 1, np.uint8)
            piece[: len(data[a : a + len(piece)])] = data[a : a + len(piece)]
            m = self._pooled(piece, np.arange(0, min(step, n - a), BLOCK))
            if before is not None:
                total += np.maximum(before, m[0]).astype(float)
                chunks += 1
            total += np.maximum(m[:-1], m[1:]).sum(0, dtype=float)
            chunks += len(m) - 1
            before = m[-1]
        return (total, chunks) if chunks else (before.astype(float), 1)


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> ByteCNN:
    """A network fitted by Adam on whole texts; deterministic."""
    rng = np.random.default_rng(SEED)
    p = {"f": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "b": np.zeros(FILTERS, np.float32), "w": rng.normal(0, 0.3, FILTERS), "o": np.zeros(1)}
    share = float((weights * labels).sum() / max(weights.sum(), 1e-9)) if len(labels) else 0.5
    p["o"][:] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for epoch in range(EPOCHS if len(texts) else 0):
        order = rng.permutation(len(texts))
        for batch in np.array_split(order, max(1, len(order) // 32)):
            grads = _gradient(p, [texts[i] for i in batch], labels[batch], weights[batch])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in grads.items():
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p[k].dtype)
    return ByteCNN(p["f"], p["b"], p["w"], float(p["o"][0]))


def _gradient(p, texts, y, weight):
    x, valid, doc = [], [], []
    for i, t in enumerate(texts):
        t = np.frombuffer(t or b"\0", np.uint8)
        k = -(-len(t) // BLOCK)
        padded = np.zeros(k * BLOCK + WIDTH - 1, np.uint8)
        padded[: len(t)] = t
        x.append(np.lib.stride_tricks.sliding_window_view(padded, BLOCK + WIDTH - 1)[::BLOCK])
        valid.append(np.arange(k * BLOCK).reshape(k, BLOCK) < len(t))
        doc += [i] * k
    x, valid, doc = np.concatenate(x), np.concatenate(valid), np.array(doc)
    r = p["f"][0][x[:, :BLOCK]]
    for k in range(1, WIDTH):
        r += p["f"][k][x[:, k : k + BLOCK]]
    r[~valid] = -np.inf
    top = r.argmax(1)
    raw = np.take_along_axis(r, top[:, None, :], 1)[:, 0] + p["b"]
    m = np.maximum(raw, 0)
    same = np.append(doc[1:] == doc[:-1], False)
    right = np.roll(m, -1, 0)
    second = same[:, None] & (right > m)
    chunk = np.where(second, right, m)
    alone = np.bincount(doc)[doc] == 1
    keep = same | alone
    n = np.bincount(doc, keep, len(texts))
    pooled = np.zeros((len(texts), FILTERS))
    np.add.at(pooled, doc[keep], chunk[keep])
    pooled /= n[:, None]
    prob = 1 / (1 + np.exp(-np.clip(pooled @ p["w"] + p["o"][0], -50, 50)))
    d = weight * (prob - y) / weight.sum()
    dchunk = np.where(keep[:, None], (d / n)[doc][:, None] * p["w"], 0)
    dm = np.where(second, 0, dchunk) + np.roll(np.where(second, dchunk, 0), 1, 0)
    dm = np.where(raw > 0, dm, 0).astype(np.float32)
    gf = np.zeros_like(p["f"])
    rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
    for k in range(WIDTH):
        np.add.at(gf[k], (x[rows, top + k], np.broadcast_to(cols, top.shape)), dm)
    return {"f": gf, "b": dm.sum(0), "w": pooled.T @ d + 1e-4 * p["w"], "o": np.array([d.sum()])}


def held_out(doc_id):
    """Whether a row belongs to the fold that is kept from training: crc32 of the id as text mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _spread(text):
    """The bytes that a document trains with: all, or SAMPLE_BYTES of them in blocks spread over the whole."""
    blocks = SAMPLE_BYTES // BLOCK
    step = (F.octet_length(text) - BLOCK) / F.lit(float(blocks - 1))
    block = lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(BLOCK))
    parts = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: block(i)), F.lit(b""), lambda a, b: F.concat(a, b))
    return F.when(F.octet_length(text) <= SAMPLE_BYTES, text).otherwise(parts)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ByteCNN:
    """Fit on at most `sample` documents of either class from the training folds.

    Labels that are null or neither 0 nor 1, and ids without a document, are passed over; of several
    labels of an id the least counts, of several texts the least. The driver holds at most
    2 * sample * SAMPLE_BYTES bytes of text.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    ids = picked[0].unionByName(picked[1]).toPandas()
    chosen = docs.sparkSession.createDataFrame(list(zip(map(int, ids["doc_id"]), map(int, ids["quality"]), strict=True)), "doc_id long, quality int")
    texts = docs.select("doc_id", utf8("text").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", _spread(F.col("text")).alias("text")).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    found = found.toPandas().sort_values("doc_id")
    y = found["quality"].to_numpy(float)
    weight = np.array([counts.get(q, 0) / max(1, (y == q).sum()) for q in (0, 1)])[y.astype(int)] if len(y) else np.zeros(0)
    return fit([bytes(t) for t in found["text"]], y, weight)


def score(docs: DataFrame, model: ByteCNN, threshold: float = 0.3) -> DataFrame:
    """docs with `score` and `predicted` (1 if score >= threshold); columns of these names go.

    Null and empty texts score as one zero byte. Whole texts are read.
    """
    bounded_batches(docs.sparkSession)
    base = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = base.columns.index("text")

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(data, offsets) for _, data, offsets in byte_slices(batch.column(at))]
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return base.mapInArrow(frees(run), T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def text_hash():
    """What tells texts of one id apart; null is empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def rejected(docs: DataFrame, model: ByteCNN, threshold: float = 0.3) -> DataFrame:
    """(doc_id, text_hash) of the documents that score under the threshold; a row each."""
    out = score(docs.select("doc_id", "text"), model, threshold).where("predicted = 0")
    return out.select("doc_id", text_hash().alias("text_hash")).distinct()


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
