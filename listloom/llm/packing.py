"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

Documents (pieces of at most `capacity` tokens, where one is longer) go, longest first, to the open bin that they leave
fullest. A bin carries two bitmaps: of the duplicate clusters in it (a cluster at most once) and of source slots (a
source at most `per_source` times). Bins are kept in the order of their residual capacity; the search begins at the
tightest bin with room and moves to the next larger residual until a bin is compatible; if none is, a new one opens.

Packing runs within groups of about `group_size` pieces, dealt by a hash of the piece, so that no group holds more than
its share of a hot source or cluster; only lengths and keys are shuffled. Nothing is left out: when bitmaps are full, a
new bin opens.

Defined cases: null text and text without words have no tokens and no bin (bin_id null); null sources count as one
source; rows with one doc_id and text are copies of each other and never share a bin; a text of any length is packed whole,
in pieces of the capacity; ties go by doc_id and piece; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY, PER_SOURCE, GROUP_SIZE = 2048, 2, 4096
KIND = "doc_id long, piece int, first_token long, n_tokens long, bin_id long, offset long"


def place(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bins and offsets of pieces that come longest first. sources: small numbers; clusters: small numbers, -1 for a
    piece that is alone in its cluster."""
    order: list[tuple[int, int]] = []  # (residual, bin)
    source_bits, cluster_bits, bins, offsets = [], [], [], []
    for n, source, cluster in zip(sizes, sources, clusters, strict=True):
        slots = ((1 << per_source) - 1) << (source * per_source)
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (n, -1))
        while at < len(order) and (cluster_bits[order[at][1]] & cluster_bit or source_bits[order[at][1]] & slots == slots):
            at += 1
        if at < len(order):
            residual, name = order.pop(at)
        else:
            residual, name = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        taken = source_bits[name] & slots
        source_bits[name] |= ((taken << 1) | (1 << (source * per_source))) & slots
        cluster_bits[name] |= cluster_bit
        bins.append(name)
        offsets.append(capacity - residual)
        if residual > n:
            insort(order, (residual - n, name))
    return bins, offsets


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_size: int = GROUP_SIZE, clusters: DataFrame | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, first_token, n_tokens, bin_id, offset in the bin. Tokens are words. clusters
    (doc_id, cluster: one row for an id) says which documents are duplicates of each other, as near-duplicate detection
    does; documents without one, and all if it isn't given, are duplicates if their texts are equal but for case."""
    lengths = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("source").alias("source"),  # all nulls have one hash
        F.xxhash64(F.lower("text")).alias("cluster"),
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("n"),
    )
    lengths = written(lengths, "lengths")  # text is read once
    if clusters is not None:
        named = clusters.select("doc_id", F.xxhash64(F.col("cluster").cast("string"), F.lit("cluster")).alias("_cluster"))
        lengths = lengths.join(named, "doc_id", "left").withColumn("cluster", F.coalesce("_cluster", "cluster")).drop("_cluster")
    cut = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0)))
    parts = lengths.select("*", F.explode(cut).alias("piece")).withColumn("first_token", F.col("piece") * F.lit(capacity).cast("long"))
    parts = parts.withColumn("n_tokens", F.least(F.col("n") - F.col("first_token"), F.lit(capacity))).drop("n")
    groups = 1 + parts.where("n_tokens > 0").count() // group_size
    dealt = parts.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        empty = int((rows["n_tokens"] == 0).sum())
        full = rows.iloc[: len(rows) - empty]
        several = full["cluster"].duplicated(keep=False)
        clusters = pd.Series(-1, full.index)
        clusters[several] = pd.factorize(full["cluster"][several])[0]
        bins, offsets = place(full["n_tokens"].tolist(), pd.factorize(full["source"])[0].tolist(), clusters.tolist(), capacity, per_source)
        base = int(rows["group"].iloc[0]) << 20
        nothing = [None] * empty
        return pd.DataFrame({
            **{c: rows[c] for c in ("doc_id", "piece", "first_token", "n_tokens")},
            "bin_id": pd.array([*(base + b for b in bins), *nothing], "Int64"),
            "offset": pd.array([*offsets, *nothing], "Int64"),
        })

    return dealt.groupBy("group").applyInPandas(run, KIND)
