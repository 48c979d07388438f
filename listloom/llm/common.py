"""What the operators share: reading, the shared scratch folder, folds, batches of bounded size."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir, written

__all__ = ["ALPHANUMERIC", "DOCUMENT_COLUMNS", "SPACED", "as_bytes", "fold", "held_out", "matching", "mixed", "pieces", "rolled", "shared_dir", "table", "word_hashes", "written"]

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")  # setting, Spark's default, ours


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts: where the session has Spark's default, batches for Python get fewer rows, so that they and
    their copies stay small."""
    setting, default, ours = ARROW_ROWS
    if spark.conf.get(setting) == default:
        spark.conf.set(setting, ours)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of documents that is never learned from; a null id is held out too."""
    return F.coalesce(fold(doc_id) == 1, F.lit(True))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of `column` (one longer value stands alone) and `rows` rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + limit, side="right"))
            stop = min(max(stop, start + 1), start + rows)
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Values of a string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers with their bits spread."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


CHUNK = 1 << 17  # bytes of text that are hashed at once
MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def _byte_values(separators: bytes) -> np.ndarray:
    """A number for each byte, the same for A-Z and a-z; zero for a separator."""
    values = np.random.default_rng(20240611).integers(1 << 62, 1 << 63, 256, np.uint64) | np.uint64(1)
    values[65:91] = values[97:123]
    values[np.frombuffer(separators, np.uint8)] = 0
    return values


SPACED = _byte_values(b" \t\n\x0b\x0c\r")  # words are what stands between ASCII white space
ALPHANUMERIC = _byte_values(bytes(c for c in range(128) if not chr(c).isalnum()))  # runs of letters, digits, non-ASCII


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])  # wraps


def word_hashes(texts: list[bytes], values: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and how many words each text has. A word's hash is a polynomial
    in its bytes' numbers, taken from sums over the joined texts, so that no word is handled on its own."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)  # both kinds of word end at a new line
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        n = CHUNK
        while True:  # a chunk ends after a separator; one word of more bytes than a chunk makes it longer
            v = values[data[at : at + n]]
            if at + n >= len(data):
                break
            tail = np.flatnonzero(v[-CHUNK:] == 0)
            if len(tail):
                v = v[: len(v) - min(CHUNK, len(v)) + int(tail[-1]) + 1]
                break
            n *= 2
        word = v != 0
        start = np.flatnonzero(word & ~np.r_[False, word[:-1]])
        if len(start):
            size = 1 << max(len(v) - 1, CHUNK - 1).bit_length()
            hashes.append(np.add.reduceat(v * _powers(MULTIPLIER, size)[: len(v)], start) * _powers(pow(MULTIPLIER, -1, 1 << 64), size)[start])
            starts.append(start + at)
        at += len(v)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    n_words = np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)
    return mixed(np.concatenate(hashes)), n_words


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words."""
    h = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for i in range(width):
        h = h * np.uint64(MULTIPLIER) + hashes[i : i + len(h)]
    return mixed(h)


def matching(df: DataFrame, ids: DataFrame, how: str = "left_semi", few: int = 1 << 20) -> DataFrame:
    """Rows of df whose doc_id is (left_semi) or isn't (left_anti) in ids, null taken as a value. ids are broadcast
    only if they are counted to be few (8 MB); else both sides are shuffled."""
    ids = written(ids.select(F.col("doc_id").alias("_id")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= few else ids
    return df.join(ids, df["doc_id"].eqNullSafe(ids["_id"]), how)
