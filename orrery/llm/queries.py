"""The corpus operators' queries, a whole table each, and their SQL where SQL can express them."""

from orrery.llm import bpe, fingerprint, licenses, line_dedup, mixing, ngram_join, quality, sharding, warc, webp


def queries():
    return {
        "op1_ngram_jaccard_join": ngram_join.query,
        "op2_warc_record_table": warc.query,
        "op3_quality_classifier": quality.query,
        "op4_hilbert_shards": sharding.query,
        "op5_curriculum_mix": mixing.query,
        "op6_fuzzy_line_dedup": line_dedup.query,
        "op7_lossless_webp": webp.query,
        "op8_license_scan": licenses.query,
        "op9_multiset_fingerprints": fingerprint.query,
        "op10_byte_level_bpe": bpe.query,
        "pipeline": pipeline,
    }


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql():
    return {"op2_warc_record_table": warc.ORACLE_SQL}
