"""Near-duplicate documents with circulant MinHash.

Shingles are `WIDTH` consecutive words (A-Z lowered, split at ASCII white space), hashed to 64 bits. The first
permutation sends a shingle to a slot of a universe of `UNIVERSE` slots; the second is a table of the universe that is
shifted circularly by k for coordinate k, so that one row of the table holds a shingle's values for all coordinates
(C-MinHash). `BANDS` bands of `ROWS` coordinates miss a pair of similarity 0.75 with probability 5e-6. Every reported
link is confirmed on full shingle sets.

Large groups make few pairs: documents with equal shingle sets are one class. Each member of a bucket is compared with the
bucket's smallest class. In buckets that still hold several components and are too large for one block, the members are
compared with further classes, drawn by a hash, until nothing changes. Then the members of every bucket that is left with
several components are compared exactly, by matrix products of their full sets in blocks of at most `BLOCK` members and
about `BLOCK_SHINGLES` shingles; one link is kept for each two components. Only sets of like size share a block.

Defined cases: null text and text without words have no shingles, stand alone and are kept; with fewer than five words
the whole sequence is one shingle; equal rows share a class (rows with one doc_id are one document); null doc_id rows
stand alone with a null component; texts of any length are used whole; a group's smallest doc_id is kept, so there are no
ties; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mixed, pieces, rolled, word_hashes, written
from .components import components

WIDTH, BANDS, ROWS = 5, 32, 4
COORDINATES, UNIVERSE = BANDS * ROWS, 1 << 19
PERCENT = 75
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 18, 4096  # of one block; COLUMNS: shingles that are multiplied at once
PIECE_BYTES, CHUNK = 1 << 20, 1 << 12
GROUP = ["key", "step", "up", "low", "high"]
FEW_IDS = 1 << 20  # so many ids (8 MB) may be broadcast


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct 64-bit shingle hashes, sorted."""
    words, n = word_hashes(texts)
    hashes, ends = rolled(words, WIDTH), np.cumsum(n)
    found = []
    for end, k in zip(ends.tolist(), n.tolist(), strict=True):
        if k >= WIDTH:
            found.append(np.unique(hashes[end - k : end - WIDTH + 1]))
        else:
            found.append(rolled(words[end - k : end], k) if k else words[:0])
    return found


def circulant_table() -> np.ndarray:
    """Row i: the second permutation from slot i on, for as many slots as there are coordinates."""
    second = np.random.default_rng(20240611).permutation(UNIVERSE).astype(np.int32)
    return sliding_window_view(np.concatenate([second, second[: COORDINATES - 1]]), COORDINATES)


def signatures(sets: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """One row of coordinates for each set; sets are not empty."""
    out = np.full((len(sets), COORDINATES), UNIVERSE, np.int32)
    for i, s in enumerate(sets):
        slots = (s * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - UNIVERSE.bit_length() + 1)
        for k in range(0, len(slots), CHUNK):
            np.minimum(out[i], table[slots[k : k + CHUNK]].min(0), out=out[i])
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, same (digest of the shingle set; null without shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = circulant_table()
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for b in pieces(batches, "text", PIECE_BYTES):
            sets = shingles(as_bytes(b, "text"))
            some = [i for i, s in enumerate(sets) if len(s)]
            same, bands = [None] * len(sets), [None] * len(sets)
            if some:
                sig = signatures([sets[i] for i in some], table)
                keys = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = mixed((keys + sig[:, r::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
                keys = (keys ^ salt).view(np.int64)
                for i, k in zip(some, keys, strict=True):
                    same[i], bands[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), k
            yield pa.record_batch({"doc_id": b["doc_id"], "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "same": pa.array(same, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, same binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE_BYTES):
            sets = [s.view(np.int64) for s in shingles(as_bytes(b, "text"))]
            yield pa.record_batch({"doc_id": b["doc_id"], "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that share at least PERCENT of their union. Joins on a hot `a` are split by AQE."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", shared.alias("n"), F.size("x").alias("nx"), F.size("y").alias("ny"))
    return both.where(100 * F.col("n") >= PERCENT * (F.col("nx") + F.col("ny") - F.col("n"))).select("a", "b").distinct()


def _step() -> Column:
    """Sets of similarity 0.75 differ in size by a factor of 4/3 at most, so they lie in one step or in adjacent ones."""
    return F.floor(F.log("n") / math.log(100 / PERCENT) + 1e-9).cast("int")


def _parts() -> Column:
    """Into how many parts a step of a bucket is cut, from its members and shingles."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")


def blocks(members: DataFrame) -> DataFrame:
    """Members with the groups that they are compared in: each two parts of a step, and each part of a step with each of
    the next, are a group. What one group holds is bounded by two parts."""
    steps = members.withColumn("step", _step())
    sizes = written(steps.groupBy("key", "step").agg(_parts().alias("parts")), "sizes")  # read four times below
    beside = sizes.select("key", (F.col("step") - 1).alias("step"), F.col("parts").alias("above")).union(sizes.select("key", "step", F.lit(0).alias("above"))).groupBy("key", "step").agg(F.max("above").alias("above"))
    below = sizes.select("key", (F.col("step") + 1).alias("step"), F.col("parts").alias("below"))
    sizes = sizes.join(beside, ["key", "step"]).join(below, ["key", "step"], "left").fillna({"below": 0})
    dealt = steps.join(sizes, ["key", "step"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))

    def with_others(n: str, place: Callable[[Column], Column]) -> Column:
        return F.transform(F.expr(f"IF({n} > 0, sequence(0, {n} - 1), array())"), place)

    step, part = F.col("step"), F.col("part")
    own = with_others("parts", lambda o: F.struct(step.alias("step"), F.lit(0).alias("up"), F.least(part, o).alias("low"), F.greatest(part, o).alias("high")))
    up = with_others("above", lambda o: F.struct(step.alias("step"), F.lit(1).alias("up"), part.alias("low"), o.alias("high")))
    down = with_others("below", lambda o: F.struct((step - 1).alias("step"), F.lit(1).alias("up"), o.alias("low"), part.alias("high")))
    dealt = dealt.select("key", "rep", "n", "comp", F.explode(F.concat(own, up, down)).alias("block")).select("key", "block.*", "rep", "n", "comp")
    several = dealt.groupBy(*GROUP).agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first != last").select(*GROUP)
    return dealt.join(several, GROUP, "left_semi")


def across(group: pd.DataFrame) -> pd.DataFrame:
    """Links between different components of a group, one for each two."""
    rep, comp, n = (group[c].to_numpy() for c in ("rep", "comp", "n"))
    row = np.repeat(np.arange(len(rep)), [len(x) for x in group["shingles"]])
    _, column, times = np.unique(np.concatenate(group["shingles"].to_list()), return_inverse=True, return_counts=True)
    several = times > 1
    row, column = row[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(rep), len(rep)), np.float32)
    for first in range(0, int(several.sum()), COLUMNS):
        low, high = np.searchsorted(column, [first, first + COLUMNS])
        has = np.zeros((len(rep), COLUMNS), np.float32)
        has[row[low:high], column[low:high] - first] = 1
        shared += has @ has.T
    shared = shared.astype(np.int64)
    a, b = np.nonzero((comp[:, None] < comp[None, :]) & (100 * shared >= PERCENT * (n[:, None] + n[None, :] - shared)))
    links = pd.DataFrame({"a": rep[a], "b": rep[b], "x": comp[a], "y": comp[b]})
    return links.drop_duplicates(["x", "y"])[["a", "b"]]


def still_open(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Members of those buckets that hold more than one component, with their component."""
    now = buckets.join(found, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).select(*buckets.columns, "comp")
    spread = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    return now.join(spread, "key", "left_semi")


def stars(members: DataFrame, leads: DataFrame) -> DataFrame:
    """Pairs of each bucket's lead with the other members that are in another component and of like size."""
    fits = 100 * F.least("n", "lead_n") >= PERCENT * F.greatest("n", "lead_n")
    met = members.join(leads, "key").where((F.col("comp") != F.col("lead_comp")) & fits)
    return met.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()


def drawn_leads(members: DataFrame, salt: int) -> DataFrame:
    """One member of each bucket, drawn by a hash."""
    drawn = members.groupBy("key").agg(F.min(F.xxhash64(F.lit(salt), "rep")).alias("draw"))
    told = [F.col(c).alias(f"lead_{c}") for c in members.columns if c not in ("key", "rep")]
    return members.join(drawn, "key").where(F.xxhash64(F.lit(salt), "rep") == F.col("draw")).select("key", F.col("rep").alias("lead"), *told)


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    drawn = written(sketches(docs), "sketches")
    some = drawn.where(F.col("same").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(some.groupBy("same").agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(classes, "same").where("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), "bands")

    dealt = written(reps.select("rep", F.col("n").cast("int").alias("n"), F.explode("bands").alias("key")), "dealt")
    shared = dealt.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low != high")
    buckets = written(dealt.join(shared.select("key"), "key", "left_semi"), "buckets")

    ids = buckets.select(F.col("rep").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    sets = written(shingle_sets(docs.join(ids, "doc_id", "left_semi")), "sets")

    alone = buckets.withColumn("comp", F.col("rep"))
    first = buckets.groupBy("key").agg(F.min("rep").alias("rep")).join(buckets, ["key", "rep"]).select("key", F.col("rep").alias("lead"), F.col("n").alias("lead_n"), F.col("rep").alias("lead_comp")).distinct()
    found = components(confirmed(stars(alone, first), sets))
    members, salt = written(still_open(buckets, found), "open"), 1
    while True:
        large = members.groupBy("key").agg(_parts().alias("parts")).where("parts > 1").select("key")
        large = written(members.join(large, "key", "left_semi"), "large")
        if large.isEmpty():
            break
        links = written(confirmed(stars(large, drawn_leads(large, salt)), sets), "links")
        if links.isEmpty():
            break
        found = joined(found, links)
        members, salt = written(still_open(buckets, found), "open"), salt + 1

    full = blocks(members).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    more = written(full.groupBy(*GROUP).applyInPandas(across, "a long, b long").distinct(), "links")
    if not more.isEmpty():
        found = joined(found, more)

    rep = classes.join(found, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    out = drawn.select("doc_id", "n_shingles", "same").join(rep, "same", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def reference(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    """Brute force over a small list, for tests: the component of each doc_id."""
    sets = {}
    for d, text in docs:
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + WIDTH]) for i in range(max(0, len(w) - WIDTH) + 1)} if w else set()
    comp = {d: d for d in sets}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= PERCENT * (len(sets[a]) + len(sets[b]) - n) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {d: low if c == high else c for d, c in comp.items()}
    return comp
