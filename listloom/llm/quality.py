"""Quality by nearest-neighbour voting in a latent-semantic space.

Features: hashed counts of byte n-grams (n in `ORDERS`) of the whole text, log-scaled, and terms for how much it repeats
itself (word pairs, words in a row, lines: the decile of each share), weighted by inverse document frequency and of unit
length. How much the terms for repetition weigh is learned: of `WEIGHTS` the one with which the sample's rows, each left
out in turn, are voted on best. A truncated SVD of a bounded labelled sample gives the latent space. The sample's latent
vectors are broadcast (their number is a parameter, so is the size); exact cosines of a block of documents with all of
them are one matrix product, and the labels of the nearest `k` vote with their similarity (to the fourth power) as the
weight.

Defined cases: null and empty texts have no features and get the sample's share of label 1; a document with no
neighbour of positive similarity gets the same; without labelled rows the share is 0.5; texts of any length are used whole;
repeated rows are scored one by one (of those with one id and label one is learned from); ties between neighbours go to
the one earlier in the sample (by id); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pieces

ORDERS = {1: 256, 2: 1024, 3: 1024}  # n: slots
DECILES = 30  # three shares in ten terms each
WEIGHTS = (0.0, 2.0, 5.0, 10.0, 15.0, 20.0)  # of these terms: fitting takes the one that votes best on the sample itself
SLOTS = sum(ORDERS.values()) + DECILES
PIECE_BYTES, PIECE_ROWS = 4 << 20, 256


@dataclass
class Model:
    idf: np.ndarray  # SLOTS
    basis: np.ndarray  # SLOTS x rank
    vectors: np.ndarray  # rank x labelled
    labels: np.ndarray  # labelled
    share: float
    k: int


def repetition(text: bytes) -> list[int]:
    """The terms for distinct word pairs, words like the one before, and distinct lines."""
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words) - 1)
    shares = (len(set(zip(words, words[1:], strict=False))) / n, sum(map(bytes.__eq__, words, words[1:])) / n, len(set(lines)) / len(lines))
    return [10 * k + min(9, int(10 * s)) for k, s in enumerate(shares)]


def counts(texts: list[bytes]) -> np.ndarray:
    """For each text, how many of its n-grams fall in each slot; an n-gram that leaves its text isn't counted."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    found, start = np.zeros((len(texts), SLOTS), np.float32), 0
    code = joined.astype(np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            code = code[:-1] * np.uint32(0x01000193) + joined[n - 1 :]
        if n in ORDERS and len(code):
            slots = ORDERS[n]
            slot = code if n == 1 else (code * np.uint32(0x9E3779B1)) >> np.uint32(33 - slots.bit_length())
            inside = row[: len(code)] == row[n - 1 : n - 1 + len(code)]
            flat = np.bincount((row[: len(code)] * slots + slot)[inside], minlength=len(texts) * slots)
            found[:, start : start + slots] = flat.reshape(len(texts), slots)
            start += slots
    for i, t in enumerate(texts):
        if t:
            found[i, [start + k for k in repetition(t)]] = np.expm1(1.0)
    return found


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(found) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, n_labelled: int = 3000, rank: int = 48, k: int = 15, seed: int = 7) -> Model:
    """`docs` (doc_id, text) joined with `labels` (doc_id, quality): at most `n_labelled` rows, chosen by a hash of the
    id, are learned from. The driver gets their slot counts only (4.6 kB a row)."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE_BYTES, PIECE_ROWS):
            x = np.log1p(counts(as_bytes(b, "text"))).astype(np.float16)
            yield pa.record_batch({"doc_id": b["doc_id"], "quality": b["quality"], "x": pa.array([r.tobytes() for r in x], pa.binary())})

    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    ids = docs.where(F.length("text") > 0).select("doc_id")
    sample = known.join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_labelled)
    # a limit bounds what is broadcast here
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.distinct()), "doc_id").where(F.length("text") > 0).mapInArrow(shrink, "doc_id long, quality int, x binary")
    rows = sorted(rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect(), key=lambda r: (r.doc_id, r.quality))
    if not rows:
        return Model(np.ones(SLOTS, np.float32), np.zeros((SLOTS, 1), np.float32), np.zeros((1, 0), np.float32), np.zeros(0, np.float32), 0.5, k)
    found = np.expm1(np.frombuffer(b"".join(r.x for r in rows), np.float16).reshape(len(rows), SLOTS).astype(np.float32))
    y = np.array([r.quality for r in rows], np.float32)
    models = [latent(found, y, w, rank, k, seed) for w in WEIGHTS]
    return min(models, key=lambda m: left_out_loss(found, m))  # the first of equals


def latent(found: np.ndarray, y: np.ndarray, weight: float, rank: int, k: int, seed: int) -> Model:
    """The model of a sample with the terms for repetition at one weight."""
    idf = (np.log((1 + len(y)) / (1 + (found > 0).sum(0))) + 1).astype(np.float32)
    idf[-DECILES:] *= weight
    x = weighted(found, idf)
    # randomized SVD: two passes of subspace iteration
    q = np.linalg.qr(x.T @ (x @ np.random.default_rng(seed).standard_normal((SLOTS, min(2 * rank, SLOTS))).astype(np.float32)))[0]
    q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ v[:rank].T).astype(np.float32)
    z = unit(x @ basis)
    return Model(idf, basis, np.ascontiguousarray(z.T), y, float(y.mean()), min(k, len(y)))


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def voted(near: np.ndarray, m: Model) -> np.ndarray:
    """The vote of the k nearest for each row of similarities; of equally near ones, the first."""
    least = np.partition(near, near.shape[1] - m.k, axis=1)[:, near.shape[1] - m.k][:, None]
    above, level = near > least, near == least
    chosen = above | (level & (np.cumsum(level, 1) <= m.k - above.sum(1, keepdims=True)))
    weight = np.where(chosen, np.maximum(near, 0), 0).astype(np.float64) ** 4
    total = weight.sum(1)
    return np.where(total > 1e-12, (weight @ m.labels) / np.maximum(total, 1e-12), m.share).clip(0, 1)


def left_out_loss(found: np.ndarray, m: Model) -> float:
    """Log loss of the sample's rows, each voted on by the others; both labels weigh the same."""
    loss, z = np.empty(len(m.labels)), m.vectors.T
    for i in range(0, len(z), PIECE_ROWS):
        near = z[i : i + PIECE_ROWS] @ m.vectors
        near[np.arange(len(near)), i + np.arange(len(near))] = -1
        p = voted(near, m).clip(0.01, 0.99)
        y = m.labels[i : i + PIECE_ROWS]
        loss[i : i + PIECE_ROWS] = -np.log(np.where(y == 1, p, 1 - p))
    return float(sum(loss[m.labels == c].mean() for c in (0, 1) if (m.labels == c).any()))


def votes(texts: list[bytes], m: Model) -> np.ndarray:
    out = np.full(len(texts), m.share)
    if m.vectors.shape[1]:
        some = np.array([bool(t) for t in texts])
        out[some] = voted(unit(weighted(counts([t for t in texts if t]), m.idf) @ m.basis) @ m.vectors, m)
    return out


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of docs, with score (0 to 1) and predicted (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE_BYTES, PIECE_ROWS):
            s = votes(as_bytes(b, "text"), shared.value)
            yield pa.record_batch({**{k: b[k] for k in keep}, "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    fields = ", ".join(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}, score double, predicted int")
