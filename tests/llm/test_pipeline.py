"""The pipeline's stages, each against brute force or its own operator on its own input."""

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

from listloom.llm import decontaminate, minhash_dedup, suffix_dedup
from listloom.llm.common import DOCUMENT_COLUMNS, table

from ..conftest import TEST
from .test_operators import _corpus, _table


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEST, "documents").where("doc_id < 300").cache()


def test_stage_names_and_columns():
    assert [n for n, _ in p.STAGES] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]


def test_quality_keeps_good_documents(spark):
    all_docs = table(spark, TEST, "documents")
    kept = p.classify_quality(spark, all_docs, TEST)
    assert kept.columns == DOCUMENT_COLUMNS
    labels = table(spark, TEST, "labels")
    good, bad = (labels.where(f"quality = {q}").join(kept, "doc_id", "left_semi").count() / labels.where(f"quality = {q}").count() for q in (1, 0))
    assert good > 0.98 and bad < 0.15


def test_near_duplicates(spark):
    rows = [*_corpus(2), (None, "alone"), (3, "again and again")]
    kept = p.drop_near_duplicates(spark, _table(spark, rows), TEST).collect()
    named = [(d, t) for d, t in rows if d is not None and (d, t) != (3, "again and again")]
    comp = minhash_dedup.reference(named)
    assert {r.doc_id for r in kept if r.doc_id not in (None, 3)} == {d for d, c in comp.items() if c == d and d != 3}
    assert sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 3 for r in kept) <= 1


def test_passages(spark):
    rows = _corpus(3)
    got = {r.doc_id: r for r in p.remove_repeated_passages(spark, _table(spark, rows), TEST).collect()}
    want = suffix_dedup.reference(rows)
    for d, t in rows:
        if t is None:
            assert got[d].text is None
        elif t.isascii():
            assert got[d].text.encode() == want[d][3] and got[d].n_chars == len(got[d].text)


def test_contaminated(spark, docs):
    items = [(r.item_id, r.text) for r in table(spark, TEST, "benchmark").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bad = {r[0] for r in decontaminate.reference(rows, items) if r[5]}
    nameless = spark.createDataFrame([(None, items[0][1], "en", "s", 1), (None, "clean", "en", "s", 1)], docs.schema)
    kept = p.drop_contaminated(spark, docs.union(nameless), TEST).collect()
    assert bad and {r.doc_id for r in kept} == {d for d, _ in rows} - bad | {None}
    assert [r.text for r in kept if r.doc_id is None] == ["clean"]


def test_run(spark):
    out = p.run(spark, TEST)
    assert {"doc_id", "bin_id"} <= set(out.columns)
    n = out.agg(F.count_distinct("doc_id")).first()[0]
    assert 500 < n < 1000


def test_empty_table(spark):
    docs = table(spark, TEST, "documents").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, TEST)
    assert docs.count() == 0
