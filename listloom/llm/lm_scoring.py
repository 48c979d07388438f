"""Masked pseudo-likelihood scores from a bidirectional window network.

Tokens are words (A-Z lowered, split at ASCII white space) under 64-bit hashes. A word is predicted in two factors: its
class, by a network with one hidden layer that reads the classes of the `REACH` words on either side, and the word within
its class, by its share of the corpus count of that class. A document's score is the sum over all its words of the
conditional log-probability.

Classes come from the corpus. The `OWN` most frequent words have one each. The `ANCHORS` most frequent words are clustered
by whom they stand beside (positive pointwise mutual information, truncated SVD, k-means); every other word of the
vocabulary joins the cluster that most anchors around it, over all its occurrences, belong to.

Texts are cut once into blocks of bounded size, each with its own dictionary. The vocabulary (every distinct word, its
count over all documents and its class) is a table that is shuffled by word and grows with the corpus; each block gets the
counts and classes of its own words back. Training is data-parallel and every word is the target of one round: in
each round every partition takes gradient steps in numpy from the same parameters, and the results are averaged in a
distributed sum, weighted by targets. The driver gets the anchors, their co-occurrences and the parameters (sizes are
constants), never words by the vocabulary.

Defined cases: null text and text without words score 0 with no mean; a word that the corpus doesn't have counts as one
that it has once; words that tie in count are ordered by hash, a word whose classes tie joins the first; with no words at all
the network stays untrained; equal rows are scored one by one; a text is never cut, one longer than a block is a block;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, pieces, word_hashes, written

OWN, CLUSTERS, ANCHORS = 48, 16, 512
CLASSES = OWN + CLUSTERS
RARE = 20_000  # a word is counted as a possible anchor in blocks where it is at least one word in so many
REACH, HIDDEN, RANK = 3, 16, 16
OFFSETS = [o for o in range(-REACH, REACH + 1) if o]
PAD = CLASSES  # the class before the first and after the last word
SHAPES = {"table": (len(OFFSETS), CLASSES + 1, HIDDEN), "bias": (HIDDEN,), "out": (HIDDEN, CLASSES), "prior": (CLASSES,)}
BLOCK_BYTES, ROWS, BATCH = 4 << 20, 1 << 10, 512
PARTS = ("doc_ids", "n", "codes", "words", "counts", "classes", "logs")
BLOCKS = "block long, doc_ids array<long>, n binary, codes binary, words array<long>, counts array<int>"
READY = "doc_ids array<long>, n binary, classes binary, logs binary, mass array<long>"


@dataclass
class Anchors:
    words: np.ndarray  # hashes, most frequent first
    clusters: np.ndarray  # of each

    def classes(self) -> np.ndarray:
        return np.where(np.arange(len(self.words)) < OWN, np.arange(len(self.words)), OWN + self.clusters)


@dataclass
class Model:
    anchors: Anchors
    vocabulary: DataFrame  # word, n, name
    mass: np.ndarray  # words of each class
    weights: dict[str, np.ndarray]


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block: doc_ids, how many words each has (int32), all words as places in the block's dictionary
    (int32, compressed), the dictionary (hashes) and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in gathered(pieces(batches, "text", block_bytes), block_bytes):
            hashes, n = word_hashes(as_bytes(b, "text"))
            words, codes, counts = np.unique(hashes.view(np.int64), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # frequent words get small places, which compress well
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            words, codes, counts = words[order], place[codes], counts[order]
            yield pa.record_batch({
                "block": pa.array([block], pa.int64()),
                "doc_ids": pa.array([b["doc_id"].to_pylist()], pa.list_(pa.int64())),
                "n": pa.array([n.astype(np.int32).tobytes()], pa.binary()),
                "codes": pa.array([packed(codes)], pa.binary()),
                "words": pa.array([words], pa.list_(pa.int64())),
                "counts": pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
            })
            block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about `limit` bytes each."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def packed(codes: np.ndarray) -> bytes:
    """Compressed, all low bytes first, then all second bytes and so on."""
    return pa.compress(codes.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Dictionary places of all words, and how many words each document has."""
    n = np.frombuffer(row["n"], np.int32).astype(np.int64)
    if not n.sum():
        return np.empty(0, np.int32), n
    bytes_ = np.frombuffer(pa.decompress(row["codes"], 4 * int(n.sum()), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(bytes_.reshape(4, -1).T).view(np.int32).ravel(), n


def classes_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words, and how many words each document has."""
    n = np.frombuffer(row["n"], np.int32).astype(np.int64)
    return np.frombuffer(pa.decompress(row["classes"], int(n.sum()), codec="zstd", asbytes=True) if n.sum() else b"", np.uint8), n


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One block at a time; words and counts as numpy arrays, doc_ids (of which some may be null) as they are."""
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b[name][i].as_py() if pa.types.is_binary(b[name].type) else b[name][i].values if name == "doc_ids" else b[name][i].values.to_numpy() for name in b.schema.names if name in PARTS}
        pa.default_memory_pool().release_unused()


def padded(classes: np.ndarray, n: np.ndarray, pad: int = PAD) -> tuple[np.ndarray, np.ndarray]:
    """Classes with REACH pads after each text (and before the first), and the places of the words there."""
    at = np.arange(len(classes)) + REACH * (1 + np.repeat(np.arange(len(n)), n))
    out = np.full(len(classes) + REACH * (len(n) + 1), pad, classes.dtype)
    out[at] = classes
    return out, at


def places(words: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """The place of each word among the anchors, or -1."""
    if not len(anchors):
        return np.full(len(words), -1)
    order = np.argsort(anchors)
    at = np.searchsorted(anchors[order], words)
    at[at == len(order)] = 0
    return np.where(anchors[order][at] == words, order[at], -1)


def frequent(rows: DataFrame) -> np.ndarray:
    """The ANCHORS most frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            some = row["counts"] * RARE >= row["counts"].sum()
            yield pa.record_batch({"word": pa.array(row["words"][some], pa.int64()), "n": pa.array(row["counts"][some].astype(np.int64))})

    counted = rows.select("words", "counts").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return np.array([r.word for r in counted.orderBy(F.desc("n"), "word").limit(ANCHORS).collect()], np.int64)


def cooccurrence(rows: DataFrame, anchors: np.ndarray) -> np.ndarray:
    """How often each two anchors stand within REACH words, over all documents."""
    shared, size = rows.sparkSession.sparkContext.broadcast(anchors), len(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for row in rows_of(batches):
            codes, n = unpacked(row)
            around, _ = padded(places(row["words"], shared.value)[codes], n, -1)
            for o in range(1, REACH + 1):
                left, right = around[:-o], around[o:]
                both = (left >= 0) & (right >= 0)
                total += np.bincount(left[both] * size + right[both], minlength=size * size)
        some = np.flatnonzero(total)
        yield pa.record_batch({"cell": pa.array(some, pa.int64()), "n": pa.array(total[some])})

    sums = rows.select("n", "codes", "words").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(size * size)
    matrix[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    matrix = matrix.reshape(size, size)
    return matrix + matrix.T


def clustered(together: np.ndarray, seed: int = 11) -> np.ndarray:
    """A cluster for each anchor."""
    total = max(together.sum(), 1)
    share = np.maximum(together.sum(0), 1) / total
    likeness = np.log(np.maximum(together / total / (share[:, None] * share[None, :]), 1))
    u, s, _ = np.linalg.svd(likeness)
    x = (u * np.sqrt(s))[:, :RANK]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = x[:1]
    while len(centres) < min(CLUSTERS, len(x)):  # each centre begins at the anchor that is least like those before
        centres = np.concatenate([centres, x[[int((x @ centres.T).max(1).argmin())]]])
    for _ in range(20):
        of = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9), centres)
    return (x @ centres.T).argmax(1)


def anchored(rows: DataFrame) -> Anchors:
    words = frequent(rows)
    return Anchors(words, clustered(cooccurrence(rows, words)) if len(words) else np.zeros(0, np.int64))


def voted(codes: np.ndarray, n: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a block's dictionary the cluster that most anchors around it belong to, and how many do. clusters:
    of each word of the dictionary, -1 where it is no anchor."""
    around, at = padded(clusters[codes], n, -1)
    votes = np.zeros(len(clusters) * CLUSTERS, np.int64)
    for o in OFFSETS:
        beside = around[at + o]
        some = beside >= 0
        votes += np.bincount(codes[some] * np.int64(CLUSTERS) + beside[some], minlength=len(votes))
    votes = votes.reshape(-1, CLUSTERS)
    best = votes.argmax(1)
    return best, votes[np.arange(len(best)), best]


def block_words(rows: DataFrame, anchors: Anchors) -> DataFrame:
    """A row for each word of each block: block, place, word, n, name (CLASSES + its number for an anchor, else the class
    that this block votes for) and votes."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, row in zip(b["block"].to_pylist(), rows_of([b]), strict=True):
                codes, n = unpacked(row)
                place = places(row["words"], shared.value.words)
                best, votes = voted(codes, n, np.append(shared.value.clusters, -1)[place])
                name = np.where(place >= 0, CLASSES + place, OWN + best)
                yield pa.record_batch({"block": pa.array(np.full(len(best), block)), "place": pa.array(np.arange(len(best), dtype=np.int32)), "word": pa.array(row["words"], pa.int64()), "n": pa.array(row["counts"], pa.int32()), "name": pa.array(name.astype(np.int32)), "votes": pa.array(votes.astype(np.int32))})

    return rows.select("block", "n", "codes", "words", "counts").mapInArrow(run, "block long, place int, word long, n int, name int, votes int")


NAMES = CLASSES + ANCHORS
RANKED = f"votes * {NAMES} + ({NAMES - 1} - name)"  # most votes, then the first name


def vocabulary(each: DataFrame) -> DataFrame:
    """word, n, name: every word with its count over all documents; its name as in `block_words`, by all its votes."""
    by_name = each.groupBy("word", "name").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes"))
    return by_name.groupBy("word").agg(F.sum("n").alias("n"), (NAMES - 1 - F.max(F.expr(RANKED)) % NAMES).cast("int").alias("name"))


def named(each: DataFrame) -> DataFrame:
    """block, place, n, name: what the vocabulary says, for each word of each block, without a shuffle more than by word. Only
    words that the corpus has more than once, and anchors, are sent back: of the others the count is one and the class is
    what their only block says."""
    word, name = Window.partitionBy("word"), Window.partitionBy("word", "name")
    rows = each.repartition("word").withColumn("votes", F.sum("votes").over(name))
    rows = rows.select("block", "place", F.sum("n").over(word).alias("n"), (NAMES - 1 - F.max(F.expr(RANKED)).over(word) % NAMES).cast("int").alias("name"))
    return rows.where((F.col("n") > 1) | (F.col("name") >= CLASSES))


def attached(rows: DataFrame, anchors: Anchors, known: DataFrame) -> DataFrame:
    """Blocks with the classes of all words (bytes, compressed), the sum of the logarithms of the words' corpus counts for
    each document, and how many words of each class there are. known: block, place, n, name of words; the others count
    once."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for row in rows_of(block.to_batches()):
            codes, n = unpacked(row)
            own = np.bincount(codes, minlength=int(codes.max(initial=-1)) + 1)
            at, name = known["place"].to_numpy(), known["name"].to_numpy()
            anchor = np.full(len(own), -1)
            anchor[at[name >= CLASSES]] = name[name >= CLASSES] - CLASSES
            classes, counts = OWN + voted(codes, n, np.append(shared.value.clusters, -1)[anchor])[0], np.ones(len(own), np.int64)
            classes[at], counts[at] = name, known["n"].to_numpy()
            classes = np.where(anchor >= 0, np.append(shared.value.classes(), 0)[anchor], classes).astype(np.uint8)
            mass = np.bincount(classes, weights=own, minlength=CLASSES).astype(np.int64)
            logs = np.bincount(np.repeat(np.arange(len(n)), n), weights=np.log(counts)[codes], minlength=len(n)).astype(np.float64)
            ids = pa.ListArray.from_arrays(pa.array([0, len(row["doc_ids"])], pa.int32()), row["doc_ids"])
            zipped = pa.compress(classes[codes].tobytes(), codec="zstd", asbytes=True)
            out.append(pa.table({"doc_ids": ids, "n": pa.array([row["n"]]), "classes": pa.array([zipped]), "logs": pa.array([logs.tobytes()]), "mass": pa.array([mass], pa.list_(pa.int64()))}))
        return pa.concat_tables(out)

    known = known.select(F.col("block").alias("of"), "place", "n", "name")
    return rows.select("block", "doc_ids", "n", "codes").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, READY)


def hidden(context: list[np.ndarray] | np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """context: a row of classes for each offset."""
    h = w["table"][0][context[0]]
    for i in range(1, len(OFFSETS)):
        h += w["table"][i][context[i]]
    h += w["bias"]
    return np.tanh(h, out=h)


def windows(classes: np.ndarray, n: np.ndarray, nth: int, of: int) -> np.ndarray:
    """The class of each word that is dealt to round `nth` of `of`, and the classes around it, in mixed order."""
    around, at = padded(classes, n)
    rng = np.random.default_rng(len(at))
    at = rng.permutation(at[rng.integers(0, of, len(at), np.uint8) == nth])
    return np.stack([around[at], *(around[at + o] for o in OFFSETS)]).astype(np.int64)


def steps(windows: np.ndarray, w: dict[str, np.ndarray], rate: float) -> None:
    """One pass of gradient steps over the windows, in place."""
    for i in range(0, windows.shape[1], BATCH):
        target, context = windows[0, i : i + BATCH], windows[1:, i : i + BATCH]
        row = np.arange(len(target))
        h = hidden(context, w)
        p = h @ w["out"]
        p += w["prior"]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        p[row, target] -= 1
        p *= np.float32(rate / len(row))
        back = (p @ w["out"].T) * (1 - h * h)
        w["out"] -= h.T @ p
        w["prior"] -= p.sum(0)
        w["bias"] -= back.sum(0)
        for k, classes in enumerate(context):
            one = np.zeros((len(row), CLASSES + 1), np.float32)
            one[row, classes] = 1
            w["table"][k] -= one.T @ back


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def shaped(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k], at = x[at : at + n].reshape(shape).astype(np.float32), at + n
    return out


def averaged_round(ready: DataFrame, now: np.ndarray, rate: float, nth: int, of: int) -> np.ndarray:
    shared = ready.sparkSession.sparkContext.broadcast(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = shaped(shared.value), 0
        for row in rows_of(batches):
            part = windows(*classes_of(row), nth, of)
            steps(part, w, rate)
            total += part.shape[1]
        if total:
            x = flat(w).astype(np.float64)
            yield pa.record_batch({"i": pa.array(np.arange(len(x))), "x": pa.array(x * total), "n": pa.array(np.full(len(x), total, np.int64))})

    sums = ready.select("n", "classes").mapInArrow(run, "i long, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
    out = now.copy()
    out[sums["i"].to_numpy()] = sums["x"].to_numpy()
    shared.unpersist()
    return out


def fit(docs: DataFrame, rounds: int = 4, rate: float = 1.0, seed: int = 5) -> Model:
    model, _ = fitted(written(blocks(docs), "blocks"), rounds, rate, seed)
    model.vocabulary = written(model.vocabulary, "vocabulary")
    return model


def fitted(rows: DataFrame, rounds: int = 4, rate: float = 1.0, seed: int = 5) -> tuple[Model, DataFrame]:
    """The model (its vocabulary as a table still to be computed), and the blocks with what it says of their words."""
    anchors = anchored(rows)
    each = block_words(rows, anchors)
    ready = written(attached(rows, anchors, named(each)), "ready")
    mass = np.zeros(CLASSES)
    for r in ready.select(F.posexplode("mass").alias("class", "n")).groupBy("class").agg(F.sum("n").alias("n")).collect():
        mass[r["class"]] = r.n
    rng = np.random.default_rng(seed)
    start = {k: rng.standard_normal(shape) * 0.1 for k, shape in SHAPES.items()}
    start["prior"] = np.log(np.maximum(mass, 0.5) / max(mass.sum(), 1))
    now = flat(start)
    for k in range(rounds):
        now = averaged_round(ready, now, rate / (1 + k), k, rounds)
    return Model(anchors, vocabulary(each), np.maximum(mass, 1), shaped(now)), ready


def log_probabilities(classes: np.ndarray, n: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Of each word's class, given the words around it."""
    around, at = padded(classes, n)
    out = np.empty(len(classes))
    for i in range(0, len(classes), ROWS):
        place = at[i : i + ROWS]
        z = hidden([around[place + o] for o in OFFSETS], w) @ w["out"]
        z += w["prior"]
        z -= z.max(1, keepdims=True)
        own = z[np.arange(len(place)), classes[i : i + ROWS]].astype(np.float64)
        out[i : i + ROWS] = own - np.log(np.exp(z, out=z).sum(1))
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, pll (sum of log-probabilities), pll_per_token."""
    rows = written(blocks(docs), "blocks")
    known = rows.select("block", F.posexplode("words").alias("place", "word")).join(model.vocabulary, "word")
    return scored(attached(rows, model.anchors, known.select("block", "place", "n", "name")), model)


def scored(ready: DataFrame, model: Model) -> DataFrame:
    shared = ready.sparkSession.sparkContext.broadcast((np.log(model.mass), model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, weights = shared.value
        for row in rows_of(batches):
            classes, n = classes_of(row)
            each = log_probabilities(classes, n, weights) - mass[classes]
            total = np.frombuffer(row["logs"], np.float64) + np.bincount(np.repeat(np.arange(len(n)), n), weights=each, minlength=len(n))
            yield pa.record_batch({"doc_id": row["doc_ids"], "n_tokens": pa.array(n), "pll": pa.array(total), "pll_per_token": pa.array(total / np.maximum(n, 1), mask=n == 0)})

    return ready.mapInArrow(run, "doc_id long, n_tokens long, pll double, pll_per_token double")
