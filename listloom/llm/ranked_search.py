"""Ranked lexical search: WAND over shards of documents.

`index` cuts the documents into shards of about `SHARD_BYTES` of text, each written by one task in one pass: a row for each
term of the shard (numbers of its documents in the shard, by ascending doc_id, and how often they hold it) and one row with
the shard's doc_ids and lengths. The index holds all terms and serves any number of searches.

`search` takes the items in blocks of about `BLOCK_TERMS` terms. For each block, weights come from document frequencies over
all shards; the postings of the block's terms meet by shard, and every item is run through WAND there: cursors
stand on each term's next document, sorted by it; the pivot is the first at which the sum of the terms' greatest impacts in
this shard exceeds the tenth score so far; documents before it are skipped, and so is a pivot whose own terms can't exceed
it. Shard heaps of at most k are merged by a window that keeps k rows of each item in every task before it shuffles.

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered, known by 64-bit hashes (as everywhere in this
package). Whole numbers throughout; see `weight`, `length_share` and `impact` for the score.

Defined cases: null text and text without terms count nowhere and are never found; documents of equal ids are documents of
their own; a null doc_id comes after all others of its score; rows with one item_id are one item, with the terms of all; rows
with a null item_id are no items; items without terms or without a match have no rows; texts of any length are used whole;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALPHANUMERIC, as_bytes, pieces, word_hashes, written

TOP = 10
SHARD_BYTES, SHARD_ROWS = 4 << 20, 4096
BLOCK_TERMS = 1 << 17  # of the items searched together: 1 MB of hashes for each task
INDEX = "shard long, term long, docs array<int>, counts array<int>, ids array<long>, lengths array<long>"
FOUND = "item int, doc_id long, score long"


def weight(documents: int, holding: int) -> int:
    """Of a term that `holding` of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_share(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a document's length adds to the divisor of its terms' impacts."""
    return 10 + 90 * lengths * documents // terms


def impact(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 8 * shares)


def shard_rows(ids: pa.Array, texts: list[bytes], shard: int) -> pa.RecordBatch:
    """The index rows of one shard."""
    terms, n = word_hashes(texts, ALPHANUMERIC)
    order = np.argsort(np.array([math.inf if i is None else i for i in ids.to_pylist()], object), kind="stable")
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    docs = np.repeat(place, n)
    by = np.lexsort((docs, terms))
    terms, docs = terms[by], docs[by]
    fresh = np.r_[True, (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])][: len(terms)]  # first occurrence in a document
    at = np.flatnonzero(fresh)
    counts, terms, docs = np.diff(np.r_[at, len(terms)]), terms[at], docs[at]
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]][: len(terms)])
    rows, lists = len(starts) + 1, np.r_[starts, len(terms), len(terms)]
    own = np.zeros(rows + 1, np.int32)
    own[-1] = len(n)  # only the last row, the one without a term, has ids and lengths
    as_list = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
    return pa.record_batch({
        "shard": pa.array(np.full(rows, shard), pa.int64()),
        "term": pa.array([*terms[starts].view(np.int64).tolist(), None], pa.int64()),
        "docs": as_list(lists, docs, pa.int32()), "counts": as_list(lists, counts, pa.int32()),
        "ids": pa.ListArray.from_arrays(pa.array(own), ids.take(pa.array(order)).cast(pa.int64())), "lengths": as_list(own, n[order], pa.int64()),
    })


def index(docs: DataFrame) -> DataFrame:
    """A written table of shards. A shard's number is made of its task and its place there, so a task that is run again
    writes the same shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for b in pieces(batches, "text", SHARD_BYTES, SHARD_ROWS):
            yield shard_rows(b.column("doc_id"), as_bytes(b, "text"), shard)
            shard += 1

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), "shards")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its different terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", SHARD_BYTES):
            terms, n = word_hashes(as_bytes(b, "text"), ALPHANUMERIC)
            owner = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.record_batch({"item_id": b.column("item_id").take(owner), "term": pa.array(terms.view(np.int64))})

    kind = items.schema["item_id"].dataType.simpleString()
    return items.where(F.col("item_id").isNotNull()).select("item_id", "text").mapInArrow(run, f"item_id {kind}, term long").distinct()


def wand(rows: list[int], docs: np.ndarray, scores: np.ndarray, starts: np.ndarray, most: np.ndarray, n_docs: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, -document) of one item; rows: the terms of the item that the shard has, as places in starts."""
    n = len(rows)
    following = np.full((n_docs + 1, n), n_docs, np.int32)  # for each document and term: where the cursor stands then
    impacts = np.zeros((n_docs, n), np.int64)
    for j, r in enumerate(rows):
        here = docs[starts[r] : starts[r + 1]]
        following[here, j] = here
        impacts[here, j] = scores[starts[r] : starts[r + 1]]
    following = np.ascontiguousarray(np.minimum.accumulate(following[::-1], axis=0)[::-1])
    bounds = most[rows]
    heap: list[tuple[int, int]] = []
    threshold, at = 0, 0
    while at < n_docs:
        cursors = following[at]
        order = cursors.argsort()
        nth = int(bounds[order].cumsum().searchsorted(threshold, "right"))
        if nth == n:
            break  # all terms together can't exceed the threshold
        pivot = int(cursors[order[nth]])
        if pivot == n_docs:
            break
        if bounds[following[pivot] == pivot].sum() > threshold:
            score = int(impacts[pivot].sum())
            if score > threshold:
                (heapq.heappush if len(heap) < k else heapq.heapreplace)(heap, (score, -pivot))
                threshold = heap[0][0] if len(heap) == k else 0
        at = pivot + 1
    return heap


def best_of_shard(table: pa.Table, items: list[tuple[int, np.ndarray]], weights: dict[int, int], documents: int, terms: int, k: int) -> pa.Table:
    """At most k documents of one shard for each item."""
    own = table.filter(pc.is_null(table["term"]))
    ids, lengths = own["ids"][0].values, own["lengths"][0].values.to_numpy()
    lists = table.filter(pc.is_valid(table["term"])).sort_by("term").combine_chunks()
    known, share = lists["term"].to_numpy(), length_share(lengths, documents, terms) if terms else lengths
    docs, counts = (lists[c].combine_chunks().flatten().to_numpy() for c in ("docs", "counts"))
    sizes = pc.list_value_length(lists["docs"]).to_numpy()
    starts = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    scores = impact(counts.astype(np.int64), share[docs]) * np.repeat(np.array([weights[t] for t in known.tolist()], np.int64), sizes)
    most = np.maximum.reduceat(scores, starts[:-1]) if len(known) else scores
    out: tuple[list, list, list] = ([], [], [])
    for item, own_terms in items:
        place = np.searchsorted(known, own_terms)
        rows = place[(place < len(known)) & (known[np.minimum(place, len(known) - 1)] == own_terms)] if len(known) else place[:0]
        if len(rows):
            for score, doc in wand(rows.tolist(), docs, scores, starts, most, len(lengths), k):
                out[0].append(item), out[1].append(-doc), out[2].append(score)
    return pa.table({"item": pa.array(out[0], pa.int32()), "doc_id": ids.take(pa.array(out[1], pa.int64())), "score": pa.array(out[2], pa.int64())})


def search(shards: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item in a table made by `index`."""
    spark, kind = shards.sparkSession, items.schema["item_id"].dataType.simpleString()
    wanted = written(item_terms(items), "item-terms")
    total = shards.where("term IS NULL").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + (x > 0).cast("long"))).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x)).alias("l")).first()
    documents, terms = total["n"] or 0, total["l"] or 0
    blocks = math.ceil(wanted.count() / BLOCK_TERMS) if documents else 0
    out = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for block in range(blocks):
        some = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        out = out.union(searched(shards, some, documents, terms, k))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def searched(shards: DataFrame, wanted: DataFrame, documents: int, terms: int, k: int) -> DataFrame:
    """What the shards' heaps hold for one block of items (its terms are bounded by BLOCK_TERMS and one item's)."""
    spark = shards.sparkSession
    rows = wanted.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).collect()
    names = [(i, r["item_id"]) for i, r in enumerate(rows)]
    asked = wanted.select("term").distinct()
    held = shards.where("term IS NOT NULL").select("term", F.size("docs").alias("n")).join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("n").alias("n")).collect()
    weights = {r["term"]: weight(documents, r["n"]) for r in held}
    shared = spark.sparkContext.broadcast(([(i, np.array(r["terms"], np.int64)) for i, r in enumerate(rows)], weights))

    def run(table: pa.Table) -> pa.Table:
        return best_of_shard(table, *shared.value, documents, terms, k)

    lists = shards.join(F.broadcast(asked), "term", "left_semi").unionByName(shards.where("term IS NULL"))
    found = lists.groupBy("shard").applyInArrow(run, FOUND)
    named = spark.createDataFrame(names, f"item int, item_id {wanted.schema['item_id'].dataType.simpleString()}")
    return found.join(F.broadcast(named), "item").select("item_id", "doc_id", "score")


def reference(docs: list[tuple[int | None, str | None]], items: list[tuple[object, str | None]], k: int = TOP) -> list[tuple]:
    """Brute force over small lists, for tests: every document scored for every item."""
    import re
    from collections import Counter

    def split(text: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    held = [(d, Counter(split(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, size, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(split(t))
    out = []
    for i, own in asked.items():
        scores = []
        for d, c in held:
            m = 10 + 90 * c.total() * n // size
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s:
                scores.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return out
