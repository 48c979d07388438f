"""Benchmark decontamination with a distributed positional inverted index.

`index` writes the postings of all words of all documents: for each segment (documents of a bounded number of bytes) and
each term one row with the term's positions there, ascending and packed. `search` takes the windows of the test items
through it: lists of test terms are looked up by a join on the term, the corpus counts of the terms name each window's
rarest one, and a window goes, by a second join, only to the segments that have that term. There its lists are shifted by
the term's offset in the window and intersected, beginning with the rarest. A phrase match is an occurrence of the
whole window; a proximity match has every term of the window at most len + slop - 1 words from an occurrence of its
rarest term (of equally rare ones, the first in the window).

Neither documents nor items are gathered: a segment's lists are bounded by its text (a term that a third of all words are
has a short list in each segment), and test terms are broadcast only if they are counted to be few.

Words: bytes of [0-9a-z] (A-Z lowered) and all non-ASCII characters, as maximal runs; terms are 64-bit hashes. A window is
`width` consecutive words of an item; an item with fewer words, but not none, is one window. Null has no words; an item
without words or with a null id has no windows; every row of documents is judged on its own and reported under its id,
null and repeated ids too; items with equal ids count as one; a text of any length is used whole; an empty table of items
hits nothing, an empty table of documents gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALPHANUMERIC, as_bytes, pieces, word_hashes, written

WORD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
WIDTH, SLOP, SEGMENT_BYTES = 13, 2, 4 << 20
FEW_TERMS = 1 << 20  # so many terms (8 MB) may be broadcast
INDEX = "segment long, term long, n int, positions binary, ids array<long>, words array<long>"
FOUND = "segment long, nth int, hits array<array<long>>, windows array<long>, near array<long>"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD).split()


def index(docs: DataFrame, gap: int = WIDTH + SLOP, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row for each segment and term, with the positions (int32, packed), and for each segment one row without a term:
    the ids and word counts of its documents. Documents are kept apart by `gap` positions."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for b in pieces(batches, "text", segment_bytes):
            hashes, n = word_hashes(as_bytes(b, "text"), ALPHANUMERIC)
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else order
            ends = np.r_[first, len(order)].astype(np.int32)
            positions = (order + gap * np.repeat(np.arange(len(n)), n)[order]).astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(4 * ends), pa.py_buffer(positions)])
            yield pa.record_batch({
                "segment": pa.array(np.full(len(first) + 1, segment)),
                "term": pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(ordered[first].view(np.int64))]),
                "n": pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(np.diff(ends))]),
                "positions": pa.concat_arrays([pa.nulls(1, pa.binary()), lists]),
                "ids": pa.concat_arrays([pa.array([b["doc_id"].to_pylist()], pa.list_(pa.int64())), pa.nulls(len(first), pa.list_(pa.int64()))]),
                "words": pa.concat_arrays([pa.array([n], pa.list_(pa.int64())), pa.nulls(len(first), pa.list_(pa.int64()))]),
            })
            segment += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, INDEX)


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item, terms: a row for each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, n = word_hashes(as_bytes(b, "text"), ALPHANUMERIC)
            for item, end, k in zip(b["item"].to_pylist(), np.cumsum(n).tolist(), n.tolist(), strict=True):
                own = hashes[end - k : end].view(np.int64)
                found = [own[i : i + width] for i in range(max(0, k - width) + 1 if k else 0)]
                yield pa.record_batch({"item": pa.array([item] * len(found), pa.string()), "terms": pa.array(found, pa.list_(pa.int64()))})

    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    return items.mapInArrow(run, "item string, terms array<long>").distinct()


class Lists:
    """Posting lists of one segment as one sorted array of (term's number, position)."""

    def __init__(self, terms: np.ndarray, positions: list[bytes]) -> None:
        order = np.argsort(terms)
        self.terms, lists = terms[order], [np.frombuffer(positions[i], np.int32) for i in order.tolist()]
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.keys = np.repeat(np.arange(len(lists)) << 32, self.sizes) + np.concatenate([np.empty(0, np.int32), *lists])
        self.ends = np.cumsum(self.sizes)

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of terms, or -1."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(terms.shape, -1)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of each of the terms, and which of them each belongs to."""
        n = self.sizes[numbers]
        which = np.repeat(np.arange(len(numbers)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ends[numbers] - n, n)
        return self.keys[at] & 0xFFFFFFFF, which

    def has(self, numbers: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether a term has a position from `first` to `last`."""
        key = numbers << 32
        return np.searchsorted(self.keys, key + np.maximum(first, 0)) < np.searchsorted(self.keys, key + last, "right")


def matches(windows: np.ndarray, rarest: np.ndarray, lists: Lists, slop: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Windows (rows of terms of one length) with the offsets of their rarest terms: (window, first position) of the phrase
    matches and (window, position of the rarest term) of the proximity matches. The lists of all windows are intersected at
    once, each window's in the order of their sizes in the segment."""
    n = windows.shape[1]
    numbers = lists.numbers(windows)
    whole = np.flatnonzero((numbers >= 0).all(1))
    numbers, rarest = numbers[whole], rarest[whole]
    order = np.argsort(lists.sizes[numbers], axis=1, kind="stable")
    position, which = lists.of(numbers[np.arange(len(whole)), rarest])
    phrase, near = (position - rarest[which], which), (position, which)
    for step in range(n):
        begin, which = phrase
        offset = order[which, step]
        there = lists.has(numbers[which, offset], begin + offset, begin + offset) & (begin >= 0)
        phrase = begin[there], which[there]
        place, which = near
        there = lists.has(numbers[which, order[which, step]], place - (n + slop - 1), place + n + slop - 1)
        near = place[there], which[there]
    return (whole[phrase[1]], phrase[0]), (whole[near[1]], near[0])


def search(index: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """One row for each document row of the index: doc_id, n_words, hits (array of [first, after last) word ranges,
    merged), items (phrase matches) and near_items (proximity matches), each sorted."""
    each = written(item_windows(benchmark, width), "windows")
    windows = written(each.select("terms").distinct().select(F.monotonically_increasing_id().alias("window"), "terms"), "windows")
    members = windows.join(each, "terms").select("window", "item")

    placed = windows.select("window", F.posexplode("terms").alias("offset", "term"))
    terms = written(placed.select("term").distinct(), "terms")
    postings = index.where(F.col("term").isNotNull())
    lists = postings.join(F.broadcast(terms) if terms.count() <= FEW_TERMS else terms, "term").select("segment", "term", "n", "positions")
    counts = lists.groupBy("term").agg(F.sum("n").alias("total"))
    ranked = placed.join(counts, "term").groupBy("window").agg(F.count("*").alias("known"), F.min(F.struct("total", "offset", "term")).alias("rarest"))
    rare = windows.join(ranked, "window").where(F.col("known") == F.size("terms")).select("window", "terms", "rarest.offset", "rarest.term")
    asked = rare.join(postings.select("segment", "term"), "term").select(F.col("segment").alias("of"), "window", "terms", "offset")
    ends = index.where(F.col("term").isNull()).select("segment", F.lit(None).cast("long").alias("term"), F.lit(0).alias("n"), F.lit(b"").alias("positions"), "words")
    known = lists.withColumn("words", F.lit(None).cast("array<long>")).union(ends)

    def run(segment: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.table({"segment": pa.nulls(0, pa.int64()), "nth": pa.nulls(0, pa.int32()), "hits": pa.nulls(0, pa.list_(pa.list_(pa.int64()))), "windows": pa.nulls(0, pa.list_(pa.int64())), "near": pa.nulls(0, pa.list_(pa.int64()))})
        head = segment.filter(segment["term"].is_null())
        rest = segment.filter(segment["term"].is_valid())
        n_words = head["words"].combine_chunks().flatten().to_numpy()
        begins = np.cumsum(n_words + width + slop) - (n_words + width + slop)
        lists = Lists(rest["term"].to_numpy(), rest["positions"].to_pylist())
        size = asked["terms"].combine_chunks().value_lengths().to_numpy()
        name, offset, hit, near = asked["window"].to_numpy(), asked["offset"].to_numpy().astype(np.int64), [], []
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            rows = asked["terms"].combine_chunks().take(pa.array(at)).flatten().to_numpy().reshape(-1, k)
            (w, begin), (v, place) = matches(rows, offset[at], lists, slop)
            d = np.searchsorted(begins, begin, "right") - 1
            hit.append(np.stack([d, begin - begins[d], begin - begins[d] + k, name[at[w]]]))
            near.append(np.stack([np.searchsorted(begins, place, "right") - 1, name[at[v]]]))
        hit = np.concatenate([np.empty((4, 0), np.int64), *hit], 1)
        near = np.concatenate([np.empty((2, 0), np.int64), *near], 1)
        docs = np.unique(np.r_[hit[0], near[0]])
        kind = pa.list_(pa.int64())
        return pa.table({
            "segment": pa.array(np.full(len(docs), segment["segment"][0].as_py())),
            "nth": pa.array(docs.astype(np.int32)),
            "hits": pa.array([merged(hit[1:3, hit[0] == d].T.tolist()) for d in docs], pa.list_(kind)),
            "windows": pa.array([np.unique(hit[3, hit[0] == d]) for d in docs], kind),
            "near": pa.array([np.unique(near[1, near[0] == d]) for d in docs], kind),
        })

    found = written(known.groupBy("segment").cogroup(asked.groupBy("of")).applyInArrow(run, FOUND), "found")

    def named(column: str, name: str) -> DataFrame:
        rows = found.select("segment", "nth", F.explode(column).alias("window")).join(members, "window")
        return rows.groupBy("segment", "nth").agg(F.array_sort(F.collect_set("item")).alias(name))

    docs = index.where(F.col("term").isNull()).select("segment", F.posexplode(F.arrays_zip("ids", "words")).alias("nth", "x"))
    out = docs.join(found, ["segment", "nth"], "left").join(named("windows", "items"), ["segment", "nth"], "left").join(named("near", "near_items"), ["segment", "nth"], "left")
    nothing = F.array().cast("array<string>")
    return out.select(F.col("x.ids").alias("doc_id"), F.col("x.words").alias("n_words"), F.coalesce("hits", F.array().cast("array<array<bigint>>")).alias("hits"), F.coalesce("items", nothing).alias("items"), F.coalesce("near_items", nothing).alias("near_items"))


def merged(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of docs, written, and what `search` finds in it."""
    return search(written(index(docs, width + slop, segment_bytes), "postings"), benchmark, width, slop)


def verdict(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, n_near_items, items_sha256 and contaminated: at least one word in twenty is hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return found.withColumns({"n_hit": n_hit, "n_near_items": F.size("near_items").cast("long"), "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)}).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def reference(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], width: int = WIDTH, slop: int = SLOP) -> list[tuple]:
    """Brute force over small lists, for tests: (doc_id, n_words, n_hit, n_items, sha256, contaminated, n_near_items)."""
    out, texts = [], [(d, words((text or "").encode())) for d, text in docs]
    times: dict[bytes, int] = {}
    for _, w in texts:
        for x in w:
            times[x] = times.get(x, 0) + 1
    for d, w in texts:
        hit, names, near = set(), set(), set()
        for item, t in items:
            v = words((t or "").encode())
            for i in range(max(0, len(v) - width) + 1 if v and item is not None else 0):
                x = v[i : i + width]
                for j in range(len(w) - len(x) + 1):
                    if w[j : j + len(x)] == x:
                        hit.update(range(j, j + len(x)))
                        names.add(str(item))
                rarest, reach = min(x, key=lambda y: times.get(y, 0)), len(x) + slop - 1
                if any(y == rarest and set(x) <= set(w[max(0, p - reach) : p + reach + 1]) for p, y in enumerate(w)):
                    near.add(str(item))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), len(near)))
    return out
