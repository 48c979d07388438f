"""A corpus pipeline of five stages. Each takes the documents its predecessor kept and returns documents; the last
returns packed sequences. Stages are written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.llm import decontaminate, minhash_dedup, packing, quality, suffix_dedup
from listloom.llm.common import DOCUMENT_COLUMNS, held_out, matching, table, written


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (predicted 0) go. Null and empty texts get the share of label 1, so they stay
    where most labels are good; equal rows have one verdict; an empty table stays empty."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    model = quality.fit(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, tuple(DOCUMENT_COLUMNS)).where("predicted = 1").select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, once; documents without an id stay."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    found = written(minhash_dedup.near_duplicates(docs), "near-duplicates")
    kept = matching(docs, found.where("kept").select("doc_id"))
    repeated = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    return matching(kept, repeated, "left_anti").union(matching(kept, repeated).dropDuplicates(["doc_id"])).select(*DOCUMENT_COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a document with a smaller id has are cut, in whole characters. A document that
    is left without text stays, empty; null text stays null."""
    docs = docs.select(*DOCUMENT_COLUMNS).withColumn("was_null", F.col("text").isNull())
    left = suffix_dedup.removed(docs, keep=("lang", "source", "was_null"), whole_characters=True, arrivals=1)
    left = left.withColumn("text", F.when(~F.col("was_null"), F.decode("kept", "UTF-8")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words go. Every row is judged on its own: rows are told
    apart by id and text, and equal rows have one verdict."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    row = F.xxhash64("doc_id", "text")
    found = decontaminate.verdict(decontaminate.scan(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")))
    hit = found.where("contaminated").select("doc_id")
    return matching(docs.withColumns({"own": F.col("doc_id"), "doc_id": row}), hit, "left_anti").withColumn("doc_id", F.col("own")).select(*DOCUMENT_COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of documents in sequences of packing.CAPACITY words; documents without words have none, equal rows never
    share a sequence, an empty table has no places."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None  # a classifier and hashed buckets have no SQL; tests/llm hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
