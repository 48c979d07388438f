"""Language identification with a string kernel.

Kernel: a text is the set of its byte n-grams for n in `ORDERS` (the blended spectrum), hashed into one block of
slots for each n; two texts are compared by the number of slots that both have, divided by the geometric mean of
their own numbers. A bounded number of training texts are the Nystrom landmarks; one-versus-rest kernel ridge
regression on the landmark features gives a weight for each landmark and language, and texts are scored by two matrix
products a batch.

Defined cases: null text or text without a letter gives `und` and score 0; without any training row every text is
`und`; texts of any length are used whole; rows with one id are scored one by one (in training, one of those with one label
counts); other columns are ignored; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, pieces

ORDERS = {2: 2048, 3: 4096, 4: 4096}  # n: slots
SLOTS = sum(ORDERS.values())
PIECE_BYTES, PIECE_ROWS = 4 << 20, 256
PARTS = 64  # of a label, that are ranked on their own


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # SLOTS x landmarks, 0 or 1
    sizes: np.ndarray  # slots of each landmark
    weights: np.ndarray  # landmarks x languages


def presence(texts: list[bytes]) -> np.ndarray:
    """For each text, which slots its n-grams fall in. n-grams run on into the zero bytes put after each text."""
    gap = max(ORDERS)
    joined = np.frombuffer(b"".join(t.lower() + bytes(gap) for t in texts), np.uint8)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * SLOTS, [len(t) + gap for t in texts])
    found, start = np.zeros(len(texts) * SLOTS, np.uint8), 0
    code = joined.astype(np.uint32)
    for n in range(2, gap + 1):
        code = code[:-1] * np.uint32(0x01000193) + joined[n - 1 :]  # wraps: a polynomial hash of n bytes
        if n in ORDERS:
            slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - ORDERS[n].bit_length() + 1)
            found[row[: len(slot)] + slot + start] = 1
            start += ORDERS[n]
    return found.reshape(len(texts), SLOTS)


def kernel(found: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    shared = found.astype(np.float32) @ landmarks
    return shared / np.sqrt(np.maximum(found.sum(1, dtype=np.float32), 1)[:, None] * sizes[None, :])


def training_sample(train: DataFrame, label: str, n_sample: int) -> DataFrame:
    """doc_id and label of a sample that all labels share evenly, at least one row each, chosen by a hash of the id. Rows are
    ranked in parts first, so that no task ranks all rows of a frequent label."""
    known = train.where(F.col(label).isNotNull()).select("doc_id", F.col(label).alias("label")).distinct()
    labels = known.agg(F.count_distinct("label")).first()[0]
    each, draw = max(1, n_sample // max(1, labels)), F.xxhash64("doc_id")
    for part in (F.pmod(draw, F.lit(PARTS)), F.lit(0)):
        first = Window.partitionBy("label", part).orderBy(draw, "doc_id")
        known = known.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= each).drop("nth")
    return known


def fit(train: DataFrame, label: str = "lang", n_sample: int = 1200, n_landmarks: int = 128, ridge: float = 1e-2) -> Model:
    """Fit on a bounded sample of labelled rows: `n_sample` texts (one for each label, if there are more labels), of which
    the driver gets only the packed slot bits (1.3 kB each). Landmarks are shared evenly too, at least two a label."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE_BYTES, PIECE_ROWS):
            packed = np.packbits(presence(as_bytes(b, "text")), axis=1)
            yield pa.record_batch({"doc_id": b["doc_id"], "label": b["label"], "bits": pa.array([x.tobytes() for x in packed], pa.binary())})

    train = train.where(F.col("text").rlike(r"\p{L}"))
    sample = training_sample(train, label, n_sample)
    texts = train.select("doc_id", F.col(label).alias("label"), "text").join(F.broadcast(sample), ["doc_id", "label"])  # as large as the sample
    found = texts.mapInArrow(bits, "doc_id long, label string, bits binary").groupBy("doc_id", "label").agg(F.min("bits").alias("bits"))
    rows = sorted(found.collect(), key=lambda r: (r.doc_id, r.label))
    languages = sorted({r.label for r in rows})
    if not rows:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros(0, np.float32), np.zeros((0, 0), np.float32))
    found = np.unpackbits(np.frombuffer(b"".join(r.bits for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    of = np.array([languages.index(r.label) for r in rows])
    share = max(2, n_landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(of == k)[:share] for k in range(len(languages))])
    landmarks = found[chosen].T.astype(np.float32)
    sizes = np.maximum(landmarks.sum(0), 1)
    near = kernel(found, landmarks, sizes).astype(np.float64)
    value, vector = np.linalg.eigh(near[chosen])
    value, vector = value[value > 1e-6], vector[:, value > 1e-6]
    root = vector / np.sqrt(value)  # Nystrom: features = kernel to landmarks x root
    z = near @ root
    balance = 1.0 / np.bincount(of)[of]
    y = np.eye(len(languages))[of]
    a = (z * balance[:, None]).T @ z + ridge * np.eye(z.shape[1])
    w = np.linalg.solve(a, (z * balance[:, None]).T @ y)
    return Model(languages, landmarks, sizes.astype(np.float32), (root @ w).astype(np.float32))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of docs, with lang_pred and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.languages, "und"])
        for b in pieces(batches, "text", PIECE_BYTES, PIECE_ROWS):
            known = b["has_letter"].to_numpy(zero_copy_only=False) & bool(m.languages)
            best, value = np.full(b.num_rows, len(m.languages)), np.zeros(b.num_rows)
            if known.any():
                some = b.filter(pa.array(known))
                by = kernel(presence(as_bytes(some, "text")), m.landmarks, m.sizes) @ m.weights
                best[known], value[known] = by.argmax(1), np.clip(by.max(1), 0.0, 1.0)
            yield pa.record_batch({**{k: b[k] for k in keep}, "lang_pred": names.take(pa.array(best)), "score": pa.array(value)})

    fields = ", ".join(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep)
    ready = docs.select(*keep, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return ready.mapInArrow(score, f"{fields}, lang_pred string, score double")
