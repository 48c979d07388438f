"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, decontaminate, language_id, license_scan, lm_scoring, minhash_dedup, ngram_join, packing, quality, ranked_search, suffix_dedup, whitening
from .common import held_out, shared_dir, table, written
from .oracles import ORACLES
from .sharding import ShardStore


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, ready = lm_scoring.fitted(written(lm_scoring.blocks(table(spark, sf_dir, "documents")), "blocks"))
    return lm_scoring.scored(ready, model)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs.drop("lang"), model, ("doc_id", "held_out"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.removed(table(spark, sf_dir, "documents"))
    n_kept = F.octet_length("kept").cast("long")
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - n_kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.transform("licenses", lambda x: x["template"]), ",")
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["containment"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("licenses").alias("n_licenses"), names.alias("licenses"), best.alias("best_containment"))


def op6_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_forest.search(vectors, vectors.where("vec_id % 20 = 0"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    model = quality.fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, ("doc_id", "held_out"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.verdict(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals, each compacted; what the store holds then, with a digest of each text."""
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for arrival in range(3):
        store.append(docs.where(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(3)), F.lit(0)) == arrival))
        store.compact()
        store.vacuum(grace_seconds=0)  # nobody else writes to this store
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = ranked_search.index(table(spark, sf_dir, "documents"))
    return ranked_search.search(shards, table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_best_fit_packing, op3_language_id, op4_suffix_array_dedup, op5_license_scan,
        op6_ann_forest, op7_quality_classifier, op8_decontamination, op9_minhash_near_dedup, op10_sharding,
        op11_ngram_join, op12_embedding_whitening, op13_ranked_search,
    )
}

__all__ = ["ORACLES", "QUERIES"]
