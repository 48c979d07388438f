"""Exact repeated passages, found with a stored logarithmic family of suffix arrays.

A byte is removed if a string of `LENGTH` bytes that covers it also starts in a document with a smaller doc_id, or, with
documents of earlier arrivals, in any of those.

1. Sampling. Every window of LENGTH bytes picks its smallest `GRAM`-byte string by hash (a minimizer), so equal windows
   pick the same one at the same offset. Only suffixes that start at a pick are indexed.
2. Levels. `SuffixIndex` keeps levels: tables of sampled suffixes (the text's hash, the pick's number in it), in order of
   the hash of their first GRAM bytes, one range of hashes a bucket. An arrival's suffixes are sorted in each bucket and
   merge-scanned against the levels; both sides of what meets are reported. Levels of about the arrival's size are merged
   with it in the same pass, so n arrivals leave about log n levels and each suffix is rewritten log n times. A manifest
   that is created exclusively commits the levels. The oldest level, which is the largest, isn't shuffled: it is read by
   the parts it was written in, until there are more buckets. The texts stay where they are.
3. Matches. Reported suffixes come back with the text around them (only the windows that chose the pick), dealt by hash, so
   that all copies of a window meet in one bucket. There whole windows are sorted and merged as bytes, in batches of
   bounded size and the order of documents (`IndexFamily`).
4. Windows with a match in a smaller document become byte spans, which are joined to their documents. Documents equal as a
   whole are one before that.

A bucket holds the suffixes of about `BUCKET_BYTES` of text: their number follows from the counted bytes of all arrivals,
and levels written with fewer are cut when they are read. Nothing but counts reaches the driver. Texts of equal 64-bit
hash count as one when suffixes meet.

Defined cases: null text is empty; texts under LENGTH bytes keep all; rows with a null doc_id keep all and match
nothing; equal rows with one id don't remove each other; an empty table gives an empty result; other columns are dropped,
`keep` names that the result has itself are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder
from .common import as_bytes, pieces

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1  # grams in a window
PART = 1 << 22  # longer texts are sampled in overlapping parts
PIECE_BYTES, BATCH_WINDOWS = 8 << 20, 1 << 18
BUCKET_BYTES = 4 << 20  # of text whose suffixes share a bucket
ARRIVALS = 3  # into which a whole table is cut
KEY_BITS, BLOCK = 48, 1 << 16  # of a suffix's hash; suffixes in a row of a level
PLAIN_BYTES = 256  # shorter arrays of integers aren't compressed
NOTHING = np.empty(0, np.int64)


def _hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM-byte string, by doubling: a string of 2n bytes from two of n."""
    power, n, whole, have = np.full(1, 0x9E3779B97F4A7C15, np.uint64), 1, None, 0
    part, left = text.astype(np.uint64) + np.uint64(1), GRAM
    while left:
        if left & 1:
            whole = part if whole is None else whole[: len(part) - have] * power + part[have:]
            have += n
        left >>= 1
        if left:
            part, power, n = part[:-n] * power + part[n:], power * power, 2 * n  # wraps
    whole = whole[: len(text) - GRAM + 1]
    whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ (whole >> np.uint64(29))


def minimizers(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The picks: their positions, hashes, and the first and the last window (by start) that chose each."""
    found = []
    for start in range(0, max(1, len(text) - LENGTH + 1), PART):
        part = np.frombuffer(text, np.uint8)[start : start + PART + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        h = _hashes(part)
        least = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= SPAN:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        if n < SPAN:
            least = np.minimum(least[: len(least) - (SPAN - n)], least[SPAN - n :])
        pick = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1]])
        last = np.r_[first[1:], len(pick)] - 1
        found.append((pick[first] + start, h[pick[first]], first + start, last + start))
    if not found:
        return NOTHING, NOTHING.view(np.uint64), NOTHING, NOTHING
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class IndexFamily:
    """Levels of sorted distinct windows, each with the smallest document that has it. Documents are added in order."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, windows: np.ndarray) -> np.ndarray:
        """For sorted windows, the smallest document of any level that has each; else the largest integer."""
        best = np.full(len(windows), np.iinfo(np.int64).max)
        for keys, docs in self.levels:
            at = np.searchsorted(keys, windows)
            at[at == len(keys)] = 0
            best = np.where(keys[at] == windows, np.minimum(best, docs[at]), best)
        return best

    def add(self, windows: np.ndarray, docs: np.ndarray) -> None:
        """A new level of sorted windows that no level has; then levels merge while the last is at least half as large
        as the one before it."""
        if len(windows):
            self.levels.append((windows, docs))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            keys, owners = np.concatenate([b, a]), np.concatenate([y, x])
            order = np.argsort(keys, kind="stable")
            self.levels.append((keys[order], owners[order]))


def repeats(ids: np.ndarray, contexts: list[bytes], family: IndexFamily) -> tuple[np.ndarray, np.ndarray]:
    """One batch, ids ascending. For each context the flags of its windows, joined: whether a smaller id has the window.
    Also where each context's flags begin."""
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(c, len(number)) for c in contexts), np.int64, len(contexts))
    smallest = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(smallest, of, ids)
    text = np.frombuffer(b"".join(number), np.uint8)
    lengths = np.fromiter(map(len, number), np.int64, len(number))
    windows = lengths - LENGTH + 1
    begins = np.cumsum(windows) - windows
    starts = np.arange(windows.sum()) + np.repeat(np.cumsum(lengths) - lengths - begins, windows)
    suffixes = np.ascontiguousarray(sliding_window_view(text, LENGTH)[starts]).view(f"S{LENGTH}").ravel()
    order = np.argsort(suffixes, kind="stable")
    ordered = suffixes[order]
    run = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    own = np.minimum.reduceat(np.repeat(smallest, windows)[order], run)
    before = family.scan(ordered[run])
    new = before == np.iinfo(np.int64).max
    family.add(ordered[run][new], own[new])
    first = np.empty(len(suffixes), np.int64)
    first[order] = np.repeat(np.minimum(own, before), np.diff(np.r_[run, len(order)]))
    n = windows[of]
    at = np.cumsum(n) - n
    flags = first[np.arange(n.sum()) + np.repeat(begins[of] - at, n)] < np.repeat(ids, n)
    return flags, at


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket numbers with the places of their items, in order."""
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    yield from zip(names.tolist(), np.split(order, first[1:]), strict=True)


def planes(x: np.ndarray) -> bytes:
    """An integer array as planes, all low bytes, then all second bytes and so on. A first byte tells whether they are
    compressed, each on its own, so that the random low bytes don't spoil the high ones: then the number of integers and,
    before each plane, its size."""
    by_byte = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T)
    if by_byte.size < PLAIN_BYTES:
        return b"\0" + by_byte.tobytes()
    packed = [pa.compress(plane.tobytes(), codec="zstd", asbytes=True) for plane in by_byte]
    return b"".join([b"\1", len(x).to_bytes(4, "little"), *(part for p in packed for part in (len(p).to_bytes(4, "little"), p))])


def _flat(x: bytes) -> bytes:
    """The planes, joined."""
    if not x[0]:
        return x[1:]
    n, at, out = int.from_bytes(x[1:5], "little"), 5, []
    while at < len(x):
        size = int.from_bytes(x[at : at + 4], "little")
        out.append(pa.decompress(x[at + 4 : at + 4 + size], n, codec="zstd", asbytes=True))
        at += 4 + size
    return b"".join(out)


def unplaned(column: pd.Series, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    parts = [np.frombuffer(_flat(x), np.uint8).reshape(width, -1).T for x in column]
    return np.ascontiguousarray(np.concatenate(parts)).view(kind).ravel()


def gaps(x: np.ndarray) -> bytes:
    """Ascending 64-bit integers, as differences."""
    return planes(np.diff(x.view(np.uint64), prepend=np.uint64(0)))


def ungapped(value: bytes) -> np.ndarray:
    return np.cumsum(unplaned([value], "u8"), dtype=np.uint64)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].to_numpy(zero_copy_only=False)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*rows, strict=True))], names)


PICKS = "bucket int, texts binary, n binary, hashes binary, numbers binary"


def _picks(units: DataFrame, bits: int) -> DataFrame:
    """For each bucket and piece: hashes of texts, how many picks each has there, and of each pick KEY_BITS of its hash and
    its number in the text. Equal texts of a piece are one."""
    names = ["bucket", "texts", "n", "hashes", "numbers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE_BYTES):
            h, once = np.unique(_column(b, "h"), return_index=True)
            texts = as_bytes(b, "text")
            found = [minimizers(texts[i])[1] for i in once.tolist()]
            hashes = np.concatenate(found) >> np.uint64(64 - KEY_BITS)
            if not len(hashes):
                continue
            sizes = [len(f) for f in found]
            of = np.repeat(np.arange(len(found)), sizes)
            number = (np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            rows = []
            for name, at in _dealt((hashes >> np.uint64(KEY_BITS - bits)).astype(np.int64)):
                unit, n = np.unique(of[at], return_counts=True)
                rows.append((name, gaps(h[unit]), planes(n.astype(np.int32)), planes(hashes[at]), planes(number[at])))
            yield _rows(rows, names)

    return units.mapInArrow(run, PICKS)


def _joined(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


class Suffixes:
    """Sampled suffixes in order of their hash: hashes, hashes of the texts, numbers in them."""

    def __init__(self, hashes: np.ndarray, texts: np.ndarray, numbers: np.ndarray) -> None:
        self.hashes, self.texts, self.numbers = hashes, texts, numbers

    def __getitem__(self, at: np.ndarray) -> Suffixes:
        return Suffixes(self.hashes[at], self.texts[at], self.numbers[at])

    @classmethod
    def sorted(cls, rows: pd.DataFrame) -> Suffixes:
        """Of rows of PICKS; what is repeated as a whole is one."""
        texts = np.repeat(np.concatenate([ungapped(x) for x in rows["texts"]]).view(np.int64), unplaned(rows["n"], "i4"))
        all_ = cls(unplaned(rows["hashes"], "u8"), texts, unplaned(rows["numbers"], "i4"))
        all_ = all_[np.lexsort((all_.numbers, all_.texts, all_.hashes))]
        same = (all_.hashes[1:] == all_.hashes[:-1]) & (all_.texts[1:] == all_.texts[:-1]) & (all_.numbers[1:] == all_.numbers[:-1])
        return all_[np.flatnonzero(np.r_[True, ~same])]

    @classmethod
    def stored(cls, rows: pd.DataFrame) -> Suffixes:
        """Of a level's rows of one bucket, in any order."""
        rows = rows.sort_values("block")
        hashes = [ungapped(x) for x in rows["hashes"]]
        texts = [ungapped(known).view(np.int64)[unplaned([of], "i4")] for known, of in zip(rows["texts"], rows["n"], strict=True)]
        return cls(np.concatenate(hashes), np.concatenate(texts), unplaned(rows["numbers"], "i4"))

    def blocks(self) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
        """Rows of a level: distinct texts, the text of each suffix among them, gaps between hashes, numbers."""
        for x in range(0, len(self.hashes), BLOCK):
            part = slice(x, x + BLOCK)
            known, of = np.unique(self.texts[part], return_inverse=True)
            yield gaps(known), planes(of.astype(np.int32)), gaps(self.hashes[part]), planes(self.numbers[part])

    def merged(self, other: Suffixes) -> tuple[Suffixes, np.ndarray]:
        """Both in order, and where each came from (places in self, then in other). The sort merges two sorted runs."""
        both = Suffixes(*(np.concatenate(x) for x in ((self.hashes, other.hashes), (self.texts, other.texts), (self.numbers, other.numbers))))
        order = np.argsort(both.hashes, kind="stable")
        return both[order], order

    def runs(self) -> np.ndarray:
        """Where runs of equal hashes begin."""
        return np.flatnonzero(np.r_[True, self.hashes[1:] != self.hashes[:-1]])


def _spread(per_run: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(per_run, np.diff(np.r_[first, n]))


def met(arrival: Suffixes, level: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Merge scan: which suffixes of the arrival the level has in other texts, and which of the level the arrival has."""
    both, order = arrival.merged(level)
    new, first = order < len(arrival.hashes), both.runs()
    some = np.logical_and(np.logical_or.reduceat(new, first), np.logical_or.reduceat(~new, first))
    some &= np.minimum.reduceat(both.texts, first) != np.maximum.reduceat(both.texts, first)
    hit = np.empty(len(order), bool)
    hit[order] = _spread(some, first, len(order))
    return hit[: len(arrival.hashes)], hit[len(arrival.hashes) :]


def _scanned(merging: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A bucket of an arrival (place -1) and of the levels, the levels from place `merging` on being merged with it: rows of
    the new level, and the suffixes that two texts have, one of them new."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        of = {int(place): rows for place, rows in bucket.groupby("place")}
        levels = {p: Suffixes.stored(rows) for p, rows in sorted(of.items()) if p >= 0}
        found, arrival = [], None
        if -1 in of:
            arrival = Suffixes.sorted(of[-1])
            first = arrival.runs()
            hit = _spread(np.minimum.reduceat(arrival.texts, first) != np.maximum.reduceat(arrival.texts, first), first, len(arrival.hashes))
            for level in levels.values():
                own, others = met(arrival, level)
                hit = hit | own
                found.append((level[others], True))
            found.append((arrival[hit], False))
        parts = [x for p, x in levels.items() if p >= merging] + ([arrival] if arrival else [])
        level = [reduce(lambda x, y: x.merged(y)[0], parts)] if parts else []
        rows = [(kind, old, bucket["bucket"].iloc[0], i, *x) for kind, old, part in [*(("level", False, x) for x in level), *(("shared", old, x) for x, old in found)] for i, x in enumerate(part.blocks())]
        return pd.DataFrame(rows, columns=["kind", "old", "bucket", "block", "texts", "n", "hashes", "numbers"])

    return run


def _beside(merging: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The same where the oldest level's rows (place 0) come from its own files."""
    run = _scanned(merging)

    def both(others: pd.DataFrame, oldest: pd.DataFrame) -> pd.DataFrame:
        parts = [x for x in (others, oldest.assign(place=0)) if len(x)]
        return run(pd.concat(parts, ignore_index=True))

    return both


LEVEL = "bucket int, block int, texts binary, n binary, hashes binary, numbers binary"
SCANNED = f"kind string, old boolean, {LEVEL}"


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct suffixes of shared rows, without their hashes."""
    for rows in batches:
        for old, known, of, numbers in rows.itertuples(index=False):
            yield pd.DataFrame({"text": ungapped(known).view(np.int64)[unplaned([of], "i4")], "old": old, "number": unplaned([numbers], "i4")})


def _cut(level: DataFrame, bits: int) -> DataFrame:
    """A level's rows for more buckets than it was written with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(len(rows)):
                x = Suffixes.stored(rows.iloc[i : i + 1])
                bucket = (x.hashes >> np.uint64(KEY_BITS - bits)).astype(np.int64)
                for name, at in _dealt(bucket):
                    yield pd.DataFrame([(name, int(rows["block"].iloc[i]), *y) for y in x[at].blocks()], columns=list(rows.columns))

    return level.mapInPandas(run, level.schema)


class SuffixIndex:
    """The stored family. `add` is one arrival; each version's manifest lists levels, oldest first, with the bytes of text
    behind each, the bits that number their buckets and the parts that these were dealt to."""

    def __init__(self, spark: SparkSession, path: str, bucket_bytes: int = BUCKET_BYTES) -> None:
        self.spark, self.path, self.bucket_bytes = spark, path.rstrip("/"), bucket_bytes
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _name(self, version: int):
        return self._hadoop.Path(f"{self.path}/manifests/v{version:08d}.json")

    def manifest(self) -> tuple[int, list[dict]]:
        """The newest version and its levels (path, bytes, bits)."""
        folder = self._hadoop.Path(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        version = max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)
        return version, json.loads(self.spark.read.text(self._name(version).toString(), wholetext=True).first()[0]) if version else []

    def _commit(self, version: int, levels: list[dict]) -> None:
        """The file appears whole under its version's name, or another writer has it: written aside, then renamed."""
        aside = self._hadoop.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(levels).encode()))
        out.close()
        if self._fs.exists(self._name(version)) or not self._fs.rename(aside, self._name(version)):
            raise RuntimeError(f"version {version} was committed by another writer")

    def scanned(self, units: DataFrame, levels: list[dict], bits: int, tasks: int, merging: int, oldest: str | None) -> DataFrame:
        """All buckets of an arrival and the levels. Levels and arrival are dealt by bucket, but for the oldest level, the
        largest one: where it was written in as many parts, they are read in place (as the table `oldest`)."""
        rows = _picks(units, bits).select(F.lit(-1).alias("place"), "bucket", F.lit(0).alias("block"), "texts", "n", "hashes", "numbers")
        for place, level in enumerate(levels):
            if place or not oldest:
                rows = rows.union(self.level(level, bits).select(F.lit(place), "*"))
        # packed rows compress well, so partitions joined by their shuffled size would be large in memory: the number is fixed
        groups = rows.repartition(tasks, "bucket").groupBy("bucket")
        if not oldest:
            return groups.applyInPandas(_scanned(merging), SCANNED)
        return groups.cogroup(self.spark.table(oldest).groupBy("bucket")).applyInPandas(_beside(merging), SCANNED)

    def _in_place(self, level: dict, tasks: int) -> str | None:
        """A level's files as a table clustered by bucket; null if they were written otherwise."""
        if level["tasks"] != tasks:
            return None
        name = f"suffixes_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({LEVEL}) USING parquet CLUSTERED BY (bucket) INTO {tasks} BUCKETS LOCATION '{level['path']}/kind=level'")
        return name

    def level(self, level: dict, bits: int) -> DataFrame:
        rows = self.spark.read.schema(SCANNED).parquet(level["path"]).where("kind = 'level'").select("bucket", "block", "texts", "n", "hashes", "numbers")
        return rows if level["bits"] == bits else _cut(rows, bits)

    def add(self, units: DataFrame, n_bytes: int | None = None, floor_bits: int = 0) -> DataFrame:
        """Units (h: the text's hash, text) of an arrival, of n_bytes (else counted). Gives the suffixes that two texts have,
        one of which arrived now: text (its hash), old (it is in a level), number."""
        version, levels = self.manifest()
        if n_bytes is None:
            n_bytes = units.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        every = n_bytes + sum(x["bytes"] for x in levels)
        least = max(2 * self.spark.sparkContext.defaultParallelism, every // self.bucket_bytes + 1)
        bits = max([floor_bits, (least - 1).bit_length(), *(x["bits"] for x in levels)])
        merging, size = len(levels), n_bytes
        while merging and size >= 0.75 * levels[merging - 1]["bytes"]:
            merging -= 1
            size += levels[merging]["bytes"]
        path = f"{self.path}/arrival-{uuid.uuid4().hex}"
        tasks = min(1 << bits, max(4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 16), int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        oldest = self._in_place(levels[0], tasks) if levels and levels[0]["bits"] == bits else None
        name = f"suffixes_{uuid.uuid4().hex}"
        try:
            rows = self.scanned(units, levels, bits, tasks, merging, oldest)
            rows.write.partitionBy("kind").bucketBy(tasks, "bucket").option("path", path).saveAsTable(name, format="parquet")
        finally:
            for known in filter(None, (name, oldest)):
                self.spark.sql(f"DROP TABLE IF EXISTS {known}")  # the files stay
        shared = self.spark.read.schema(SCANNED).parquet(path).where("kind = 'shared'").select("old", "texts", "n", "numbers")
        shared = shared.mapInPandas(_unpacked, "text long, old boolean, number int")
        if n_bytes >= LENGTH:
            self._commit(version + 1, [*levels[:merging], {"path": path, "bytes": size, "bits": bits, "tasks": tasks}])
        return shared


def _contexts(texts: DataFrame, buckets: int) -> DataFrame:
    """For each bucket and piece: documents, their text hashes, whether they came earlier, how many contexts each has there,
    where each begins, its size and its bytes (compressed)."""
    names = ["bucket", "ids", "h", "old", "n", "begin", "sizes", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE_BYTES):
            ids, h, old = _column(b, "doc_id"), _column(b, "h"), _column(b, "old").astype(np.uint8)
            of, hashes, begin, around = [], [], [], []
            for i, (text, kept) in enumerate(zip(as_bytes(b, "text"), b["numbers"].to_pylist(), strict=True)):
                _, hs, first, last = minimizers(text)
                some = np.unique(kept)
                some = some[some < len(hs)]
                of += [i] * len(some)
                hashes.append(hs[some])
                begin += first[some].tolist()
                around += [text[x : y + LENGTH] for x, y in zip(first[some].tolist(), last[some].tolist(), strict=True)]
            if not of:
                continue
            of, begin, sizes = np.array(of), np.array(begin, np.int32), np.array([len(x) for x in around], np.int32)
            rows = []
            for name, at in _dealt((np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64)):
                unit, n = np.unique(of[at], return_counts=True)
                text = pa.compress(b"".join([around[i] for i in at.tolist()]), codec="zstd", asbytes=True)
                rows.append((name, planes(ids[unit]), h[unit].tobytes(), old[unit].tobytes(), planes(n.astype(np.int32)), planes(begin[at]), planes(sizes[at]), text))
            yield _rows(rows, names)

    return texts.mapInArrow(run, "bucket int, ids binary, h binary, old binary, n binary, begin binary, sizes binary, bytes binary")


def _matched(bucket: pd.DataFrame) -> pd.DataFrame:
    """Byte spans of a bucket's windows that a smaller document, or an earlier one, has."""
    n = unplaned(bucket["n"], "i4")
    ids, h = np.repeat(unplaned(bucket["ids"], "i8"), n), np.repeat(_joined(bucket["h"], "i8"), n)
    begin, each = unplaned(bucket["begin"], "i4").astype(np.int64), [unplaned([s], "i4") for s in bucket["sizes"]]
    data = b"".join(pa.decompress(x, int(s.sum()), codec="zstd", asbytes=True) for x, s in zip(bucket["bytes"], each, strict=True))
    sizes = np.concatenate(each).astype(np.int64)
    ends = np.cumsum(sizes)
    old = np.repeat(_joined(bucket["old"], "u1"), n) > 0
    place = np.where(old, 0, 1 + np.unique(ids, return_inverse=True)[1])
    order = np.argsort(place, kind="stable")
    batch = np.cumsum((sizes - LENGTH + 1)[order]) // BATCH_WINDOWS
    family, out = IndexFamily(), []
    for at in np.split(order, np.flatnonzero(np.diff(batch)) + 1):
        flags, starts = repeats(place[at], [data[ends[i] - sizes[i] : ends[i]] for i in at.tolist()], family)
        context = np.repeat(at, sizes[at] - LENGTH + 1)
        window = np.arange(len(flags)) - np.repeat(starts, sizes[at] - LENGTH + 1) + begin[context]
        edge = np.r_[True, context[1:] != context[:-1]]
        opens = np.flatnonzero(flags & (edge | ~np.r_[False, flags[:-1]]))
        closes = np.flatnonzero(flags & np.r_[edge[1:] | ~flags[1:], True])
        out.append(pd.DataFrame({"doc_id": ids[context[opens]], "h": h[context[opens]], "first": window[opens], "after": window[closes] + LENGTH}))
    return pd.concat(out).astype({"first": np.int32, "after": np.int32})


def _units(docs: DataFrame, keep: tuple[str, ...], old: bool) -> DataFrame:
    # a cast that does nothing would make equal exchanges below look different
    docs = docs if dict(docs.dtypes)["doc_id"] == "bigint" else docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    units = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep).where(F.col("doc_id").isNotNull())
    return units.select("doc_id", F.xxhash64("text").alias("h"), F.lit(old).alias("old"), "text", *keep)


def _indexed(index: SuffixIndex, units: DataFrame, arrivals: int) -> tuple[DataFrame, int]:
    """Suffixes that two texts have, of units added in so many arrivals (by text), and the bytes of the units."""
    arrival = F.pmod("h", F.lit(arrivals))
    sizes = dict(units.groupBy(arrival.alias("of")).agg(F.sum(F.octet_length("text").cast("long"))).collect())
    every = sum(sizes.values())
    bits = (every // index.bucket_bytes).bit_length()
    shared = [index.add(units.where(arrival == i).select("h", "text"), sizes.get(i, 0), bits) for i in range(arrivals)]
    return reduce(DataFrame.union, shared), every


def repeated_spans(docs: DataFrame, keep: tuple[str, ...] = (), index: SuffixIndex | None = None, earlier: DataFrame | None = None, arrivals: int = ARRIVALS) -> tuple[DataFrame, DataFrame]:
    """Two tables: units (doc_id, a hash h of the text, text, `keep` columns), the rows of docs with an id; and spans
    (doc_id, h, first, after): byte spans to remove, which may overlap. See `removed` for the other arguments."""
    spark = docs.sparkSession
    if (index is None) != (earlier is None):
        raise ValueError("an index goes with the documents that it has, earlier")
    units = new = _units(docs, keep, False)
    if index is None:
        shared, n_bytes = _indexed(SuffixIndex(spark, new_folder(spark, "suffixes")), units, arrivals)
    else:
        shared, n_bytes = _indexed(index, units, 1)
        units = units.union(_units(earlier, (), True).select("doc_id", "h", "old", "text", *(F.lit(None).cast(dict(docs.dtypes)[k]).alias(k) for k in keep)))
    buckets = 2 << (max(2 * spark.sparkContext.defaultParallelism, n_bytes // BUCKET_BYTES + 1) - 1).bit_length()
    rows = units.select("doc_id", "h", "old", F.octet_length("text").alias("n"), F.unhex(F.md5("text")).alias("same")).where(F.col("n") >= LENGTH)
    place = F.struct((~F.col("old")).alias("new"), F.col("doc_id"))
    owners = rows.groupBy("same").agg(F.min(place).alias("owner"), F.min("h").alias("h"))  # one text, one h
    copies = rows.join(owners.select("same", "owner"), "same").where(~F.col("old") & (place > F.col("owner")))
    copies = copies.select("doc_id", "h", F.lit(0).alias("first"), F.col("n").alias("after"))
    numbers = shared.groupBy("text").agg(F.collect_set("number").alias("numbers"))
    wanted = numbers.join(owners, numbers["text"] == owners["h"]).select("owner.doc_id", F.struct((~F.col("owner.new")).alias("old"), "h", "numbers").alias("of"))
    wanted = wanted.groupBy("doc_id").agg(F.collect_list("of").alias("wanted"))
    # this join and that of `removed` have one key and one left side, so the texts are shuffled once
    around = units.join(wanted.hint("shuffle_hash"), "doc_id")
    own = F.filter("wanted", lambda w: (w["h"] == F.col("h")) & (w["old"] == F.col("old")))
    around = around.withColumn("numbers", F.get(own, F.lit(0))["numbers"]).where(F.col("numbers").isNotNull())
    spans = _contexts(around.select("doc_id", "h", "old", "text", "numbers"), buckets).groupBy("bucket").applyInPandas(_matched, "doc_id long, h long, first int, after int")
    return new, spans.union(copies)


def removed(docs: DataFrame, keep: tuple[str, ...] = (), whole_characters: bool = False, index: SuffixIndex | None = None, earlier: DataFrame | None = None, arrivals: int = ARRIVALS) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, spans (maximal removed byte runs: first, after), kept (the bytes
    that are left) and the `keep` columns. With whole_characters, spans shrink so that no character is cut.

    Without an index, docs are added to a new one in so many arrivals. With an index, docs are its next arrival, judged
    among themselves and against `earlier`, the documents that it has: of those only the ones with suffixes that docs have
    too are looked at again."""
    clash = set(keep) & {"doc_id", "h", "old", "text", "spans", "n_bytes", "kept", "wanted", "numbers"}
    if clash:
        raise ValueError(f"columns can't be kept under names of the result: {sorted(clash)}")
    units, spans = repeated_spans(docs, keep, index, earlier, arrivals)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE_BYTES):
            runs, kept, sizes = [], [], []
            for text, h, found in zip(as_bytes(b, "text"), b["h"].to_pylist(), b["spans"].to_pylist(), strict=True):
                whole, at, left = [], 0, []
                for s in sorted((x["first"], x["after"]) for x in found or [] if x["h"] == h):
                    if whole and s[0] <= whole[-1][1]:
                        whole[-1][1] = max(whole[-1][1], s[1])
                    else:
                        whole.append(list(s))
                if whole_characters:
                    whole = [[_forward(text, x), _back(text, y)] for x, y in whole]
                for x, y in whole:
                    left.append(text[at:x])
                    at = y
                runs.append([{"first": x, "after": y} for x, y in whole])
                kept.append(b"".join([*left, text[at:]]))
                sizes.append(len(text))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
            yield pa.record_batch({"doc_id": b["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(runs, kind), "kept": pa.array(kept, pa.binary()), **{k: b[k] for k in keep}})

    by_unit = spans.groupBy("doc_id").agg(F.collect_list(F.struct("h", "first", "after")).alias("spans"))
    ready = units.join(by_unit.hint("shuffle_hash"), "doc_id", "left")
    nameless = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h"), F.lit(False).alias("old"), "text", *keep, F.lit(None).cast("array<struct<h:long,first:int,after:int>>").alias("spans"))
    fields = "".join(f", `{k}` {dict(docs.dtypes)[k]}" for k in keep)
    return ready.union(nameless).mapInArrow(cut, f"doc_id long, n_bytes long, spans array<struct<first:int,after:int>>, kept binary{fields}")


def _forward(text: bytes, at: int) -> int:
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def _back(text: bytes, at: int) -> int:
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def reference(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, bytes]]:
    """Brute force over a small list with distinct ids, for tests: n_bytes, n_removed, n_spans, kept."""
    seen: dict[bytes, int] = {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        t = (text or "").encode()
        for i in range(len(t) - LENGTH + 1):
            seen.setdefault(t[i : i + LENGTH], d)
    out = {}
    for d, text in docs:
        t = (text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - LENGTH + 1):
            if seen[t[i : i + LENGTH]] < d:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        flags = [0, *gone]
        out[d] = (len(t), sum(gone), sum(b > a for a, b in zip(flags, flags[1:], strict=False)), bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out
