"""From raw documents to token ids, in five stages; each is written as Parquet and read by the next.

1. `quality`: documents that the byte-level network scores under its threshold go. Clean ones stay.
2. `line_dedup`: of lines that are equal or nearly so, across all documents, one stays. A document all of
   whose lines that aren't blank repeat others goes.
3. `near_duplicates`: of each group of documents linked by a Jaccard similarity of 0.8 or more over word
   5-grams, the one with the least id stays.
4. `mix`: sources are taken to their target weights along the curriculum; a document stands once for every
   time it is taken. The files that this stage writes follow each other in training order; its columns are those
   of documents, so the training position itself isn't one.
5. `tokens`: byte-level BPE ids of every whole text, with digests of the ids and of the bytes decoded; a row
   for every row of the mix, in no order.

All stages take null, empty, blank and repeated rows, columns of any other name, and empty tables: a null or
empty text is scored as an empty one, and what is kept of it passes the stages to 3 and leaves in 4, which takes
documents with words only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.llm import bpe, line_dedup, mixing, ngram_join, quality
from orrery.llm.common import saved, table

#: Rejected documents (16 bytes each) of which a copy may be sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def _quality(spark, docs, sf_dir):
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    gone = saved(quality.rejected(docs, model), "pipeline-rejected").withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (quality.text_hash() == F.col("__hash")), "left_anti")


def _line_dedup(spark, docs, sf_dir):
    out = line_dedup.dedup_lines(docs, min_chars=line_dedup.ALL_LINES)
    left = (F.col("n_removed") == 0) | (F.length(F.trim(F.replace("text", F.lit("\n"), F.lit("")))) > 0)
    length = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return out.where(left).withColumns(length).select(*docs.columns)


def _near_duplicates(spark, docs, sf_dir):
    return ngram_join.one_of_each_group(docs, words=5, percent=80)


def _mix(spark, docs, sf_dir):
    return mixing.mixed(docs).select(*docs.columns)


def _tokens(spark, docs, sf_dir):
    return bpe.encode(docs, *bpe.public_ranks())


STAGES = [("quality", _quality), ("line_dedup", _line_dedup), ("near_duplicates", _near_duplicates), ("mix", _mix), ("tokens", _tokens)]

#: SQL expresses neither a network's scores nor MinHash; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
