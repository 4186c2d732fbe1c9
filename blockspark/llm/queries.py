"""The queries of the training-data operators: op1 to op13 and the pipeline's stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import embed_dedup, filter_audit, langid, licenses, minhash, packing, pieces, pii, quality, resampling, token_counts, toxicity, url_filter
from .common import table


def crc_mod(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    filters = langid.train(docs.where(crc_mod("doc_id", 4) != 2))
    return langid.predict(docs, filters).withColumn("held_out", crc_mod("doc_id", 4) == 2)


def op10_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_quality_rules(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs.where(crc_mod("doc_id", 5) != 0), labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_embeddings(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op1_sentencepiece(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("licenses", F.array_join("licenses", ","))


def op6_token_counts(spark, sf_dir):
    return token_counts.digest(token_counts.count_sections(table(spark, sf_dir, "documents")))


def op11_importance_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.junk_urls(pages))


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op3_license_scan": op3_license_scan, "op6_token_counts": op6_token_counts, "op2_toxicity": op2_toxicity, "op8_embeddings": op8_embeddings, "pipeline": pipeline, "op9_pii": op9_pii, "op5_quality_rules": op5_quality_rules, "op10_minhash": op10_minhash, "op4_best_fit_packing": op4_best_fit_packing, "op7_language_id": op7_language_id, "op11_importance_resampling": op11_importance_resampling, "op12_filter_audit": op12_filter_audit, "op13_url_filter": op13_url_filter}
ORACLE_SQL = {"op3_license_scan": licenses.oracle_sql(), "op11_importance_resampling": resampling.oracle_sql(), "op12_filter_audit": filter_audit.oracle_sql(), "op13_url_filter": url_filter.oracle_sql()}
