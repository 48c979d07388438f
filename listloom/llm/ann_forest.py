"""Approximate nearest neighbours by inner product with a forest of hash-prefix trees.

A tree gives each vector a string of `BITS` bits, the sides of orthogonal random hyperplanes on which it lies, so that
vectors in like directions share long prefixes. Vectors are stored once, in blocks dealt by a hash; a task makes the sorted
arrays of all trees for one block from its vectors, so neither strings nor lists of candidates are written or shuffled. A
query descends all trees to its longest matching prefixes, then all trees ascend together, one bit at a time, until the
subtrees at that depth hold `candidates` entries in all trees together or the root is reached: blocks count for each depth,
the counts are summed over the blocks. In a second pass each block compares exactly what its part of the subtrees holds:
inner products in double precision on the original vectors.

Only directions are hashed. Vectors are parted into bands of norms, in each of which the largest norm is at most `BAND`
times the smallest, so that inner products there are nearly in the order of cosines; every band has trees of its own and
every query searches all bands. Of vectors that are equal, the k + 1 with the smallest ids enter the index: none of the
others can be among the k nearest of any query (equal: by a 128-bit digest).

The same parameters hold at every size. In a band of up to `FULL` vectors a query gets `candidates` entries; beyond that the
number grows as the vectors to the power `GROWTH`: of evenly spread directions the nearest come closer as a table grows,
but so slowly that a hundredfold table allows one more bit of prefix, which halves the share of the table that is compared.

Every task holds one block and one part of the queries, both of bounded size, whatever the subtrees. Each pass shuffles the
blocks once for each part of the queries, and the queries once for each block.

Defined cases: vectors that are null, zero, hold null or non-finite components, have a null id, or haven't the most
common length take no part; ties go to the smaller vec_id; a band that holds fewer than candidates / trees vectors is
compared whole, so fewer than k candidates are all returned; rows with one vec_id are that many candidates; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TREES, BITS, CANDIDATES = 64, 32, 24_000
FULL, GROWTH = 60_000, 0.85
BAND = 1.25
BLOCK = 1 << 15  # vectors of one block, at most (places are 16-bit numbers)
ARRAY = 8192  # queries that one task compares with a block


def hyperplanes(dim: int, trees: int, bits: int, seed: int) -> np.ndarray:
    """trees x dim x bits: normals that are orthogonal within each run of `dim`."""
    rng = np.random.default_rng(seed)
    runs = [np.linalg.qr(rng.standard_normal((trees, dim, dim)))[0] for _ in range(-(-bits // dim))]
    return np.concatenate(runs, 2)[:, :, :bits].astype(np.float32)


def strings(x: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """The bits of each row, first bit highest."""
    sides = x @ normals > 0
    out = np.zeros(len(x), np.int64)
    for side in sides.T:
        out = 2 * out + side
    return out


def directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>), dim, norm (its logarithm) and a digest of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b["embedding"].value_lengths().fill_null(0).to_numpy()
            end = np.cumsum(n)
            values = b["embedding"].flatten()
            x = values.to_numpy(zero_copy_only=False).astype(float)  # a null component is read as NaN

            def count(flags: np.ndarray, start: np.ndarray = end - n, end: np.ndarray = end) -> np.ndarray:
                total = np.r_[0, np.cumsum(flags)]
                return total[end] - total[start]

            fine = (count(~np.isfinite(x)) == 0) & (count(x != 0) > 0) & b["vec_id"].is_valid().to_numpy(zero_copy_only=False)
            rows = b.filter(pa.array(fine))
            if not rows.num_rows:
                continue
            n = n[fine]
            first = np.cumsum(n) - n
            x = rows["embedding"].flatten().to_numpy().astype(float)
            most = np.maximum.reduceat(np.abs(x), first)
            norm = np.log(most) + np.log(np.add.reduceat((x / np.repeat(most, n)) ** 2, first)) / 2
            digests = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in np.split(x + 0.0, first[1:])]
            yield pa.record_batch({"vec_id": rows["vec_id"], "embedding": rows["embedding"], "dim": pa.array(n.astype(np.int32)), "norm": pa.array(norm), "digest": pa.array(digests, pa.binary())})

    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return typed.mapInArrow(run, f"vec_id long, embedding {kind}, dim int, norm double, digest binary")


def stored(rows: DataFrame, n: int) -> DataFrame:
    """The n vectors with the block and the place in it that they are written to. Vectors are dealt by a hash, so blocks are
    nearly full whatever the partitioning; one that runs over has a second part."""

    def run(dealt: pa.Table) -> pa.Table:
        nth = np.arange(len(dealt))
        block = (np.int64(dealt["dealt"][0].as_py()) << 20) + nth // BLOCK
        return pa.table({**{c: dealt[c] for c in ("vec_id", "embedding", "band")}, "block": pa.array(block), "place": pa.array((nth % BLOCK).astype(np.int32))})

    many = 1 + n * 5 // (4 * BLOCK)
    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(many)))
    return written(dealt.groupBy("dealt").applyInArrow(run, f"vec_id long, embedding {dict(rows.dtypes)['embedding']}, band int, block long, place int"), "vectors")


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of the ranges, and which range it is of."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n), of


def budget(n: int, candidates: int) -> int:
    """Entries of all trees together that a query gets at least in a band of n vectors."""
    return math.ceil(candidates * max(1.0, n / FULL) ** GROWTH)


class Trees:
    """The forest of a block: for each tree the sorted strings of its vectors, under their bands."""

    def __init__(self, x: np.ndarray, band: np.ndarray, normals: np.ndarray, bits: int) -> None:
        self.normals, self.bits = normals, bits
        x = directions(x)
        keys = (band.astype(np.int64) << bits | strings(x, own) for own in normals)
        self.trees = [(k[order], order) for k in keys for order in (np.argsort(k, kind="stable"),)]

    def under(self, sorted_keys: np.ndarray, keys: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The range of entries that share the band and the first `depth` bits with each key."""
        cut = self.bits - depth
        first = keys >> cut << cut
        return np.searchsorted(sorted_keys, first), np.searchsorted(sorted_keys, first + (np.int64(1) << cut))

    def counted(self, asked: list[np.ndarray], bands: np.ndarray) -> np.ndarray:
        """query x band x depth: entries of all trees that share at least so many bits; `asked`: the strings of each tree."""
        out = np.zeros((len(asked[0]) * len(bands), self.bits + 1), np.int32)
        for (known, _), own in zip(self.trees, asked, strict=True):
            keys = (bands.astype(np.int64) << self.bits | own[:, None]).ravel()
            order = np.argsort(keys)  # neighbours are looked up one after the other
            keys = keys[order]
            for depth in range(self.bits + 1):
                low, high = self.under(known, keys, depth)
                out[order, depth] += (high - low).astype(np.int32)
        return out.reshape(len(asked[0]), len(bands), -1)

    def marked(self, asked: list[np.ndarray], of: np.ndarray, band: np.ndarray, depth: np.ndarray, n: int) -> np.ndarray:
        """query x place among the block's n vectors: whether it is in a subtree of the query (of), band and depth. At the
        root one tree has them all."""
        wanted = np.zeros((len(asked[0]), n), bool)
        for t, ((known, order), own) in enumerate(zip(self.trees, asked, strict=True)):
            some = np.flatnonzero((depth > 0) | (t == 0))
            low, high = self.under(known, band[some].astype(np.int64) << self.bits | own[of[some]], depth[some])
            at, which = expanded(low, high)
            wanted[of[some][which], order[at]] = True
        return wanted


def asked_strings(x: np.ndarray, normals: np.ndarray) -> list[np.ndarray]:
    x = directions(x)
    return [strings(x, own) for own in normals]


def meeting(index: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every block, and every query, once for each of the other's parts: a part has about ARRAY queries."""
    parts = max(1, -(-given.count() // ARRAY))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    blocks = F.broadcast(index.select(F.col("block").alias("_block")).distinct())  # a row for each 2^15 vectors
    rows = given.withColumnRenamed("vec_id", "query_id").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).crossJoin(blocks)
    return copies, rows


def depths(index: DataFrame, given: DataFrame, normals: np.ndarray, bits: int, budgets: dict[int, int]) -> DataFrame:
    """query_id, depths (band, depth): the longest prefix at which all trees of all blocks together have the band's budget of
    entries, or 0. Blocks count on their own; only the counts are shuffled."""
    shared, bands = index.sparkSession.sparkContext.broadcast(normals), np.array(sorted(budgets), np.int64)

    def counted(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(vectors) and len(queries):
            trees = Trees(matrix(vectors["embedding"]), vectors["band"].to_numpy(), shared.value, bits)
            step = max(1, (1 << 14) // len(bands))
            for i in range(0, len(queries), step):
                part = queries.slice(i, step)
                n = trees.counted(asked_strings(matrix(part["embedding"]), shared.value), bands)
                ids = np.repeat(part["query_id"].to_numpy(), len(bands))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n.size + 1, bits + 1, dtype=np.int32)), pa.array(n.ravel()))
                out.append(pa.table({"query_id": pa.array(ids), "band": pa.array(np.tile(bands, len(part)).astype(np.int32)), "n": lists}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.nulls(0, pa.int64()), "band": pa.nulls(0, pa.int32()), "n": pa.nulls(0, pa.list_(pa.int32()))})

    copies, rows = meeting(index, given)
    found = copies.groupBy("block", "part").cogroup(rows.groupBy("_block", "_part")).applyInArrow(counted, "query_id long, band int, n array<int>")
    total = found.groupBy("query_id", "band").agg(*(F.sum(F.get("n", F.lit(d))).alias(f"n{d}") for d in range(bits + 1)))
    wanted = F.create_map([F.lit(x) for pair in budgets.items() for x in pair])[F.col("band")]
    depth = F.greatest(F.lit(0), *(F.when(F.col(f"n{d}") >= wanted, F.lit(d)) for d in range(bits + 1)))
    return written(total.select("query_id", F.struct("band", depth.alias("depth")).alias("x")).groupBy("query_id").agg(F.collect_list("x").alias("depths")), "depths")


def wanted_of(queries: pa.Table, trees: Trees, n: int) -> np.ndarray:
    """query x place: the candidates that the forest of a block has for queries with their depths."""
    lists = queries["depths"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    of = np.repeat(np.arange(len(queries)), lists.value_lengths().to_numpy())
    pairs = lists.flatten()
    return trees.marked(asked_strings(matrix(queries["embedding"]), trees.normals), of, pairs.field("band").to_numpy(), pairs.field("depth").to_numpy().astype(np.int64), n)


def asked(index: DataFrame, given: DataFrame, dim: int, trees: int, bits: int, candidates: int, seed: int) -> tuple[np.ndarray, DataFrame]:
    """The hyperplanes, and the queries with their depths in each band."""
    bands = {r.band: r["count"] for r in index.groupBy("band").count().collect()}  # a few thousand at most: doubles end
    normals = hyperplanes(dim, trees, bits, seed)
    found = depths(index, given, normals, bits, {b: budget(n, candidates) for b, n in bands.items()})
    return normals, given.join(found.withColumnRenamed("query_id", "vec_id"), "vec_id")


def candidate_lists(index: DataFrame, given: DataFrame, dim: int, trees: int, bits: int, candidates: int, seed: int) -> DataFrame:
    """block, query_id, places (int16, packed): what the forest of the stored vectors finds for the given ones, before any
    comparison. `search` compares where they are found and writes no lists."""
    normals, queries = asked(index, given, dim, trees, bits, candidates, seed)
    shared = index.sparkSession.sparkContext.broadcast(normals)

    def listed(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, places = [], []
        if len(vectors) and len(queries):
            known, place = Trees(matrix(vectors["embedding"]), vectors["band"].to_numpy(), shared.value, bits), vectors["place"].to_numpy().astype(np.int16)
            for i in range(0, len(queries), 64):
                part = queries.slice(i, 64)
                for query, row in zip(part["query_id"].to_pylist(), wanted_of(part, known, len(place)), strict=True):
                    if row.any():
                        ids.append(query), places.append([place[row].tobytes()])
        return pa.table({"block": pa.array([vectors["block"][0].as_py()] * len(ids), pa.int64()), "query_id": pa.array(ids, pa.int64()), "places": pa.array(places, pa.list_(pa.binary()))})

    copies, rows = meeting(index, queries)
    return copies.groupBy("block", "part").cogroup(rows.groupBy("_block", "_part")).applyInArrow(listed, "block long, query_id long, places array<binary>")


def best_of_block(vectors: pa.Table, queries: pa.Table, k: int, normals: np.ndarray, bits: int) -> pa.Table:
    """Each query's best k of its candidates in a block: query_id, best (far: the negative score, vec_id)."""
    asked, sizes, scores, names = [], [], [np.empty(0)], [np.empty(0, np.int64)]
    if len(vectors) and len(queries):
        x, ids, query = matrix(vectors["embedding"]), vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        trees = Trees(x, vectors["band"].to_numpy(), normals, bits)
        for i in range(0, len(query), 64):
            part = queries.slice(i, 64)
            v, wanted = matrix(part["embedding"]), wanted_of(part, trees, len(ids))
            wanted &= ids[None, :] != query[i : i + 64, None]
            with np.errstate(over="ignore", invalid="ignore"):
                near = np.where(wanted, v @ x.T, -np.inf)
            if near.shape[1] > k:
                least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                wanted &= near >= (least - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0)) - 1e-300)[:, None]
            for j in range(len(part)):
                at = np.flatnonzero(wanted[j])
                score = (x[at] * v[j]).sum(1)
                best = np.lexsort((ids[at], -score))[:k]
                asked.append(query[i + j])
                sizes.append(len(best))
                names.append(ids[at[best]])
                scores.append(score[best])
    best = pa.StructArray.from_arrays([pa.array(0.0 - np.concatenate(scores)), pa.array(np.concatenate(names))], ["far", "vec_id"])
    return pa.table({"query_id": pa.array(asked, pa.int64()), "best": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), best)})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, bits: int = BITS, candidates: int = CANDIDATES, seed: int = 3) -> DataFrame:
    """vectors and queries: vec_id, embedding. Gives query_id, rank (from 1), vec_id, score; a query's own id is no
    candidate."""
    rows = valid(vectors)
    known = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).orderBy(F.desc("n"), "dim").first()
    if known is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same = Window.partitionBy("digest").orderBy("vec_id")
    rows = rows.where(F.col("dim") == known.dim).withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    band = F.floor((F.lit(known.top) - F.col("norm")) / math.log(BAND)).cast("int")
    index = stored(rows.select("vec_id", "embedding", band.alias("band")), known.n)
    given = written(valid(queries).where(F.col("dim") == known.dim).select("vec_id", "embedding"), "queries")
    normals, queries = asked(index, given, known.dim, trees, bits, candidates, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(normals)
    copies, wanted = meeting(index, queries)
    near = copies.groupBy("block", "part").cogroup(wanted.groupBy("_block", "_part")).applyInArrow(lambda v, q: best_of_block(v, q, k, shared.value, bits), "query_id long, best array<struct<far: double, vec_id: long>>")
    best = near.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
