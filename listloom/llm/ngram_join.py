"""Similarity join of documents on sets of word shingles, by grouped prefixes.

Two sets with 100 |A and B| >= PERCENT |A or B| share an element among their first n - ceil(PERCENT n / 100) + 1 ones, in any
order of elements that is the same for all. The order here puts rare shingles first: document frequencies of all shingles
are counted in 2^SKETCH_BITS cells of their hashes, and shingles are sorted by the cell's level (eighths of powers of two), then
by hash. So shingles that very many documents have stand in few prefixes, and the table of cells has one size whatever the
corpus; a coarse count can only make more candidates.

Documents with equal sets are one class. Classes with the same prefix and size are one group; only groups are dealt to the
prefixes' shingles. The first shingle that two linked sets share is among the first n - ceil(2 PERCENT n / (100 + PERCENT)) + 1
ones of the smaller set (its short prefix): they share that many at least, and none stands before. So the groups are dealt
by shingle once, in order of size, and a group leaves a shingle where no smaller one of like size has it in its short
prefix, and no larger one of like size follows its own; the rest are expanded to the groups' classes. Pairs are filtered by
that place and by size, then by XOR bitmaps of the sets (each differing bit is an element that only one of
them has, so a pair over the limit can't link), and what is left is verified on the full sets:

1. each class with the smallest class of its shingle;
2. while that finds links: in shingles of more than `SMALL` classes, each class with a further one, drawn by a hash;
3. in shingles that still hold several components, all pairs of different components: by a join where a shingle has at most
   `SMALL` classes, in blocks of bounded size (see minhash_dedup.blocks) where it has more. Of blocks only the members with
   a partner left after the filters are shuffled on with their sets, and one link is kept for each two components.

Pairs that earlier links have already connected are not verified again: they can't change a component. No other pair is
left out.

Defined cases: null text and text without words have no shingles and link with nothing; with fewer than five words the whole
sequence is one shingle; equal rows share a class (rows with one doc_id are one document); rows with a null doc_id link with
nothing and have a null component; texts of any length are used whole; there are no ties, as components are named by their
smallest doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pieces, written
from .components import components
from .minhash_dedup import FEW_IDS, GROUP, PIECE_BYTES, blocks, drawn_leads, joined, shingle_sets, shingles, still_open

PERCENT = 80
SKETCH_BITS, CELLS = 20, 1024  # cells of one row of the sketch, when it is summed
SMALL = 32
LEAST_BITS, MOST_BITS = 512, 1 << 16
CLASS = "doc_id long, n_shingles long, same binary, alike binary, prefix array<long>, bitmap array<long>"


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def short_size(n: Column) -> Column:
    return (n - F.ceil(2 * PERCENT * n / (100 + PERCENT)) + 1).cast("int")


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def levels(docs: DataFrame) -> np.ndarray:
    """For each cell of hashes, the level of how many documents hold its shingles: 2^SKETCH_BITS bytes."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in pieces(batches, "text", PIECE_BYTES):
            for s in shingles(as_bytes(b, "text")):
                np.add.at(counts, cell(s), 1)
        rows = counts.reshape(-1, CELLS)
        some = np.flatnonzero(rows.any(1))
        yield pa.record_batch({"part": pa.array(some.astype(np.int32)), "counts": pa.array([rows[i].astype(np.uint32).tobytes() for i in some], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b["part"].to_pylist(), b["counts"].to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        found = [np.minimum(8 * np.log2(1 + c), 255).astype(np.uint8).tobytes() for c in total.values()]
        yield pa.record_batch({"part": pa.array(list(total), pa.int32()), "levels": pa.array(found, pa.binary())})

    parts = docs.select("text").mapInArrow(counted, "part int, counts binary").repartition("part").mapInArrow(summed, "part int, levels binary")
    out = np.zeros((1 << SKETCH_BITS) // CELLS * CELLS, np.uint8).reshape(-1, CELLS)
    for r in parts.collect():  # of one size, whatever the corpus
        out[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def bitmap(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements fall on each bit; two bits an element, if that isn't too few or too many."""
    bits = min(max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, and for sets that aren't empty: same (a digest of the set), alike (of size and prefix), the
    prefix and the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def digest(n: int, s: np.ndarray) -> bytes:
        return hashlib.blake2b(s.tobytes(), digest_size=16, salt=n.to_bytes(8, "little")).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for b in pieces(batches, "text", PIECE_BYTES):
            sets = shingles(as_bytes(b, "text"))
            rows: list[tuple] = []
            for s in sets:
                if len(s):
                    prefix = s[np.argsort(level[cell(s)], kind="stable")[: prefix_size(len(s))]]
                    rows.append((digest(len(s), s), digest(len(s), prefix), prefix.view(np.int64), bitmap(s)))
                else:
                    rows.append((None,) * 4)
            same, alike, prefix, bits = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.record_batch({
                "doc_id": b["doc_id"], "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "same": pa.array(same, pa.binary()), "alike": pa.array(alike, pa.binary()),
                "prefix": pa.array(prefix, pa.list_(pa.int64())), "bitmap": pa.array(bits, pa.list_(pa.int64())),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CLASS)


def like_sized(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def placed(n: Column, short: Column, m: Column, other: Column) -> Column:
    """True unless the shingle stands too late in the smaller set to be the first that linked sets share."""
    return F.when(n <= m, short).otherwise(other)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, lead, sized: twice n, and one if the key is in the short prefix), sorted by key and sized, those with a
    partner. Only a short row is a partner of larger ones; the nearest in size decides. Two rows at most are held back."""
    held, done = None, np.empty(0, bool)
    for b in batches:
        if not b.num_rows:
            continue
        now = np.stack([b[c].to_numpy() for c in ("key", "lead", "sized")])
        now, done = now if held is None else np.concatenate([held, now], 1), np.r_[done, np.zeros(b.num_rows, bool)]
        key, n, short = now[0], now[2] >> 1, (now[2] & 1).astype(bool)
        last = np.maximum.accumulate(np.where(short, np.arange(len(key)), -1))
        before = np.r_[-1, last[:-1]]
        fits = (before >= 0) & (key[before] == key) & (100 * n[before] >= PERCENT * n)
        fits[:-1] |= short[:-1] & (key[1:] == key[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])
        out = now[:, fits & ~done]
        yield pa.record_batch({"key": out[0], "lead": out[1], "short": pa.array((out[2] & 1).astype(bool))})
        keep = np.unique([i for i in (last[-1], len(key) - 1) if i >= 0 and key[i] == key[-1]])
        held, done = now[:, keep], (keep < len(key) - 1) | fits[keep]


def within_bits(x: str, y: str, n: Column) -> Column:
    """True unless the bitmaps show that sets of n elements together differ in too many. The longer bitmap is folded."""
    least = f"least(size({x}), size({y}))"
    fold = "IF(size({0}) > {1}, zip_with(slice({0}, 1, {1}), slice({0}, {1} + 1, {1}), (p, q) -> p ^ q), {0})"
    apart = F.expr(f"aggregate(zip_with({fold.format(x, least)}, {fold.format(y, least)}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")
    return (100 + PERCENT) * apart <= (100 - PERCENT) * n


def near_in_block(n: np.ndarray, bitmaps: list[np.ndarray], comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places) of different components that pass both filters."""
    words = min(map(len, bitmaps))
    folded = np.array([b if len(b) == words else np.bitwise_xor.reduce(b.reshape(-1, words)) for b in bitmaps]).view(np.uint64)  # bits of a negative number are counted differently
    first, second = [], []
    for i in range(len(n) - 1):
        m = n[i + 1 :]
        fits = np.flatnonzero((comp[i + 1 :] != comp[i]) & (100 * np.minimum(m, n[i]) >= PERCENT * np.maximum(m, n[i]))) + i + 1
        if len(fits):
            apart = np.bitwise_count(folded[fits] ^ folded[i]).sum(1, dtype=np.int64)
            fits = fits[(100 + PERCENT) * apart <= (100 - PERCENT) * (n[fits] + n[i])]
            first.append(np.full(len(fits), i)), second.append(fits)
    return (np.concatenate(first), np.concatenate(second)) if first else (np.empty(0, np.int64),) * 2


def left_in_block(group: pd.DataFrame) -> pd.DataFrame:
    """The members of a block that have a partner left."""
    a, b = near_in_block(group["n"].to_numpy(np.int64), group["bitmap"].to_list(), group["comp"].to_numpy())
    return group.iloc[np.union1d(a, b)]


def links_in_block(group: pd.DataFrame) -> pd.DataFrame:
    """Verified links, until every two components that have one are connected."""
    rep, sets = group["rep"].to_numpy(), group["shingles"].to_list()
    top = {c: c for c in group["comp"]}

    def root(c: int) -> int:
        while top[c] != c:
            c = top[c]
        return c

    out = []
    a, b = near_in_block(group["n"].to_numpy(np.int64), group["bitmap"].to_list(), group["comp"].to_numpy())
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(group["comp"].iat[i]), root(group["comp"].iat[j])
        if x != y:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= PERCENT * (len(sets[i]) + len(sets[j]) - both):
                out.append((rep[i], rep[j]))
                top[max(x, y)] = min(x, y)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


class Join:
    """One join: its documents, and the classes with their bitmaps."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs
        self.all = written(sketches(docs, levels(docs)), "sketches")
        some = self.all.where("same IS NOT NULL AND doc_id IS NOT NULL")
        self.classes = written(some.groupBy("same").agg(F.min("doc_id").alias("rep")), "classes")
        reps = some.join(self.classes, "same").where("doc_id = rep")
        self.reps = written(reps.select("rep", F.col("n_shingles").cast("int").alias("n"), "alike", "bitmap"), "reps")

    def buckets(self) -> DataFrame:
        """key (a prefix's shingle), rep, n, short: the classes of each key that have a partner there."""
        groups = self.reps.groupBy("alike").agg(F.min("rep").alias("lead"), F.count("*").alias("classes"))
        groups = written(groups, "groups")
        leads = groups.select(F.col("lead").alias("doc_id"), "alike")
        leads = self.all.join(F.broadcast(leads) if groups.count() <= FEW_IDS else leads, ["doc_id", "alike"])
        dealt = leads.select(F.col("doc_id").alias("lead"), "n_shingles", F.posexplode("prefix").alias("pos", "key"))
        dealt = dealt.select("key", "lead", (2 * F.col("n_shingles") + (F.col("pos") < short_size(F.col("n_shingles"))).cast("int")).alias("sized"))
        pairs = dealt.repartition("key").sortWithinPartitions("key", "sized").mapInArrow(met, "key long, lead long, short boolean").distinct()
        within = groups.where("classes > 1").select(F.xxhash64("alike").alias("key"), "lead", F.lit(True).alias("short"))
        members = self.reps.join(groups, "alike").select("lead", "rep", "n")
        return written(pairs.unionByName(within).join(members, "lead").select("key", "rep", "n", "short"), "buckets")

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sizes and bitmaps let them link."""
        one = self.reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("x"))
        two = self.reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("y"))
        both = pairs.join(one, "a").join(two, "b").where(like_sized(F.col("na"), F.col("nb")))
        return both.where(within_bits("x", "y", F.col("na") + F.col("nb"))).select("a", "b")

    def sets(self, ids: DataFrame) -> DataFrame:
        """Full shingle sets of the documents named in `rep`."""
        ids = written(ids.select(F.col("rep").alias("doc_id")).distinct(), "ids")
        ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
        return written(shingle_sets(self.docs.join(ids, "doc_id", "left_semi")), "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs, by their full sets."""
        pairs = written(pairs, "pairs")
        sets = self.sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")))
        one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
        two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        sized = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("n"), (F.size("x") + F.size("y")).alias("of"))
        return written(sized.where(100 * F.col("n") >= PERCENT * (F.col("of") - F.col("n"))).select("a", "b").distinct(), "links")

    def with_leads(self, members: DataFrame, leads: DataFrame) -> DataFrame:
        n, lead_n = F.col("n"), F.col("lead_n")
        pairs = members.join(leads, "key").where((F.col("comp") != F.col("lead_comp")) & like_sized(n, lead_n) & placed(n, F.col("short"), lead_n, F.col("lead_short")))
        return self.verified(self.filtered(pairs.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()))

    def within_small(self, members: DataFrame) -> DataFrame:
        """Links between components in keys of few classes."""
        one = members.select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("short").alias("sa"), F.col("comp").alias("ca"))
        two = members.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("short").alias("sb"), F.col("comp").alias("cb"))
        pairs = one.join(two, (one["key"] == two["key"]) & (F.col("ca") < F.col("cb")) & like_sized(F.col("na"), F.col("nb")))
        pairs = pairs.where(placed(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return self.verified(self.filtered(pairs.distinct()))

    def within_large(self, members: DataFrame) -> DataFrame:
        """Links between components in keys of many classes, block by block."""
        dealt = blocks(members).join(self.reps.select("rep", "bitmap"), "rep")
        kind = ", ".join(f"{k} {t}" for k, t in dealt.dtypes)
        left = written(dealt.groupBy(*GROUP).applyInPandas(left_in_block, kind), "left")
        if left.isEmpty():
            return left.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        full = left.join(self.sets(left).withColumnRenamed("doc_id", "rep"), "rep")
        return written(full.groupBy(*GROUP).applyInPandas(links_in_block, "a long, b long").distinct(), "links")


def different(members: DataFrame) -> DataFrame:
    """Of keys with the same members, short in the same sets, one is enough."""
    ids = F.xxhash64("rep", "short")
    kinds = members.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(ids).alias("x"), F.sum(ids.cast("decimal(38,0)")).alias("y"))
    one = kinds.groupBy("size", "x", "y").agg(F.min("key").alias("key")).where("size > 2")  # pairs are compared by then
    return members.join(one.select("key", "size"), "key")


def similar(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id."""
    join = Join(docs)
    buckets = join.buckets()
    alone = buckets.withColumn("comp", F.col("rep"))
    first = alone.groupBy("key").agg(F.min_by(F.struct("rep", "n", "short"), "rep").alias("x"))
    first = first.select("key", F.col("x.rep").alias("lead"), F.col("x.n").alias("lead_n"), F.col("x.short").alias("lead_short"), F.col("x.rep").alias("lead_comp"))
    found = components(join.with_leads(alone, first))

    members, salt = written(different(still_open(buckets, found)), "open"), 1
    while True:
        large = members.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        links = join.with_leads(large, drawn_leads(large, salt))
        if links.isEmpty():
            break
        found, salt = joined(found, links), salt + 1
        members = written(different(still_open(members.select("key", "rep", "n", "short"), found)), "open")

    links = join.within_small(members.where(F.col("size") <= SMALL)).unionByName(join.within_large(members.where(F.col("size") > SMALL).drop("size")))
    if not links.isEmpty():
        found = joined(found, links)
    rep = join.classes.join(found, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    out = join.all.select("doc_id", "n_shingles", "same").join(rep, "same", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
