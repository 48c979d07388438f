"""License statements found with MinHash bands over overlapping text windows, then exact shingle containment.

A text is a run of words (as in `decontaminate`); shingles are five words. Windows of `WINDOW` words begin every
`STRIDE` words; templates are cut into overlapping segments of `SEGMENT` = WINDOW - STRIDE + 1 words, so a segment that
occurs lies whole in some window. A window and a segment that share a shingle have similarity 1/16 at least, for a
window has sixteen shingles at most; bands of one row and `BANDS` bands then collide with probability
1 - (15/16)^192 > 0.99999 each. Coordinates are circulant, as in near-duplicate detection.

Each template that is retrieved is compared exactly: the share of the template's shingles that the words around the
window have. From `THRESHOLD` on it is a match; a document reports each template once, with its best containment and
the word at which that region begins.

Defined cases: null text and text under five words match only templates of as many words or fewer, compared whole;
templates under five words are one shingle; a document without matches has an empty list; equal rows are scanned one by
one; ties go to the first region; other columns are ignored; without templates nothing matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALPHANUMERIC, as_bytes, pieces, rolled, word_hashes
from .decontaminate import words
from .license_texts import STATEMENTS, TEXTS

WIDTH, WINDOW, STRIDE = 5, 20, 8  # a window has two blocks of STRIDE shingles
SEGMENT = WINDOW - STRIDE + 1
BANDS, UNIVERSE, THRESHOLD = 192, 1 << 19, 0.75
PIECE_BYTES, CHUNK = 1 << 20, 1 << 12

TEMPLATES = STATEMENTS | TEXTS
TEMPLATE_BYTES = 4 << 20  # of all templates together, at most: they are broadcast


def shingles(tokens: list[bytes]) -> set[tuple[bytes, ...]]:
    width = min(WIDTH, len(tokens))
    return {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)} if tokens else set()


def slots(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the slots of its shingles (none for fewer words than a shingle has), and how many words it has."""
    words, n = word_hashes(texts, ALPHANUMERIC)
    found, ends = (rolled(words, WIDTH) >> np.uint64(64 - UNIVERSE.bit_length() + 1)).astype(np.int64), np.cumsum(n)
    return [found[e - k : max(e - k, e - WIDTH + 1)] for e, k in zip(ends.tolist(), n.tolist(), strict=True)], n


class Templates:
    """Templates with their minima: coordinate and value to the templates that have a segment with that minimum."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.tokens = {k: words(t.encode()) for k, t in texts.items()}
        self.shingles = {k: shingles(t) for k, t in self.tokens.items() if t}
        second = np.random.default_rng(77).permutation(UNIVERSE).astype(np.int32)
        self.second = np.concatenate([second, second[: BANDS - 1]])
        self.minima, self.known = defaultdict(set), np.zeros(UNIVERSE, bool)
        for k, t in self.tokens.items():
            for i in range(0, max(1, len(t) - WIDTH + 1), SEGMENT - WIDTH + 1):
                (s,), _ = slots([b" ".join(t[i : i + SEGMENT])])
                if len(s):
                    self.known[s] = True
                    for band, value in enumerate(self.table()[s].min(0).tolist()):
                        self.minima[band * UNIVERSE + value].add(k)
        self.keys = np.array(sorted(self.minima), np.int64)

    def table(self) -> np.ndarray:
        return sliding_window_view(self.second, BANDS)


def candidates(docs: list[bytes], t: Templates, table: np.ndarray) -> tuple[set[tuple[int, int, str]], np.ndarray]:
    """(document, first word of the window, template) that collide in a band; and how many words each document has. A minimum
    names the slot that it comes from, so a window without any slot of a template collides with none: minima are drawn for
    the other windows only."""
    each, n_words = slots(docs)
    n = np.array([len(s) for s in each])
    blocks = -(-n // STRIDE) + 1  # one that stays empty ends each document
    start = np.cumsum(blocks) - blocks
    s = np.concatenate([np.empty(0, np.int64), *each])
    of = np.repeat(start, n) + (np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)) // STRIDE
    has = np.zeros(int(blocks.sum()) + 1, bool)
    has[of[t.known[s]]] = True
    near = has.copy()
    near[1:] |= has[:-1]
    near[:-1] |= has[1:]
    of, s = of[near[of]], s[near[of]]
    name = np.unique(of)
    least = np.full((len(name) + 1, BANDS), UNIVERSE, np.int32)  # of each block that is left
    place = np.searchsorted(name, of)
    for i in range(0, len(s), CHUNK):
        part = place[i : i + CHUNK]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        least[part[first]] = np.minimum(least[part[first]], np.minimum.reduceat(table[s[i : i + CHUNK]], first, axis=0))
    # a window is a block of shingles and the next
    after = np.searchsorted(name, name + 1)
    after = np.where(np.append(name, -1)[after] == name + 1, after, len(name))
    out = set()
    for i in range(0, len(name), CHUNK):
        window = np.minimum(least[i : i + CHUNK][: len(name) - i], least[after[i : i + CHUNK]])
        key = window + np.arange(BANDS, dtype=np.int64) * UNIVERSE
        at = np.minimum(np.searchsorted(t.keys, key), max(0, len(t.keys) - 1))
        w, band = np.nonzero((t.keys[at] == key) & (window < UNIVERSE)) if len(t.keys) else (of[:0], of[:0])
        block = name[i + w]
        doc = np.searchsorted(start, block, "right") - 1
        word = (block - start[doc]) * STRIDE
        out |= {(d, x, k) for d, x, v in set(zip(doc.tolist(), word.tolist(), key[w, band].tolist(), strict=True)) for k in t.minima[v]}
    return out, n_words


def contained(doc: list[bytes], word: int, name: str, t: Templates) -> float:
    """Share of the template's shingles within its own length around the window."""
    n = len(t.tokens[name])
    have = shingles(doc[max(0, word - n) : word + 2 * STRIDE + WINDOW + n])
    return len(have & t.shingles[name]) / len(t.shingles[name])


def named_texts(table: DataFrame) -> dict[str, str]:
    """A table of templates (template, text), measured before it is read. Nulls are left out; of several texts with one
    name the least counts."""
    rows = table.where(F.col("template").isNotNull() & F.col("text").isNotNull()).groupBy("template").agg(F.min("text").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates have {size} bytes, more than the {TEMPLATE_BYTES} that are broadcast; scan them in parts")
    return {r.template: r.text for r in rows.collect()}


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, licenses (array of template, containment, word), by template.
    templates: texts by name, or a table of them (template, text)."""
    texts = templates if isinstance(templates, dict) else named_texts(templates)
    shared = docs.sparkSession.sparkContext.broadcast(Templates(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        table = t.table()
        short = {k: s for k, s in t.shingles.items() if len(t.tokens[k]) < WIDTH}
        for b in pieces(batches, "text", PIECE_BYTES):
            texts = as_bytes(b, "text")
            found, n_words = candidates(texts, t, table)
            several = {d: words(texts[d]) for d in {d for d, *_ in found}}
            best: list[dict[str, tuple[float, int]]] = [{} for _ in texts]
            for d, word, name in sorted(found):
                c = contained(several[d], word, name, t)
                if c >= threshold and c > best[d].get(name, (0.0, 0))[0]:
                    best[d][name] = (c, word)
            for name, shingle in short.items():  # under five words: an exact run of words
                (run_,) = shingle
                for d, w in enumerate(map(words, texts)):
                    at = next((i for i, x in enumerate(w) if x == run_[0] and tuple(w[i : i + len(run_)]) == run_), None)
                    if at is not None:
                        best[d][name] = (1.0, at)
            kind = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("word", pa.int64())]))
            matched = [[{"template": k, "containment": c, "word": x} for k, (c, x) in sorted(m.items())] for m in best]
            yield pa.record_batch({"doc_id": b["doc_id"], "n_words": pa.array(n_words, pa.int64()), "licenses": pa.array(matched, kind)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, licenses array<struct<template:string,containment:double,word:long>>")


def reference(docs: list[tuple[int, str | None]], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> dict[int, set[str]]:
    """Brute force over a small list, for tests: templates contained in some run of words of four template lengths."""
    out = {}
    for d, text in docs:
        w, names = words((text or "").encode()), set()
        whole = shingles(w)
        for k, x in templates.items():
            t = words(x.encode())
            have, span = shingles(t), 2 * len(t) + 2 * STRIDE + WINDOW
            if len(t) >= WIDTH and len(whole & have) < threshold * len(have):
                continue  # then no run of the text has enough of them
            if any(len(shingles(w[i : i + span]) & have) >= threshold * len(have) for i in range(max(1, len(w) - WIDTH + 1))):
                names.add(k)
        out[d] = names
    return out
