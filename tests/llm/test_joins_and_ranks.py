"""The prefix join, whitening and ranked search against brute force and on odd tables."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from listloom.llm import ann_forest, minhash_dedup, ngram_join, ranked_search, registry, whitening
from listloom.llm.common import table

from ..conftest import TEST
from .test_operators import _corpus, _empty, _table, _words


@pytest.mark.parametrize("name", ["op11_ngram_join", "op13_ranked_search"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{TEST}/{t}.parquet'")
    got = registry.QUERIES[name](spark, TEST)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(registry.ORACLES[name]).fetchall())


# the prefix join


def _at_80(docs):
    old = minhash_dedup.PERCENT
    minhash_dedup.PERCENT = 80
    try:
        return minhash_dedup.reference(docs)
    finally:
        minhash_dedup.PERCENT = old


def _joined(df):
    return {r.doc_id: r.component_id for r in ngram_join.similar(df).collect()}


def test_join_equals_brute_force(spark):
    docs = _corpus(2)
    assert _joined(_table(spark, docs).repartition(5)) == _at_80(docs)


@pytest.mark.parametrize("small", [0, 3])
def test_join_of_chains_and_large_keys(spark, monkeypatch, small):
    """Copies that drift word by word: neighbours link, ends don't; with a common passage in all others."""
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rng = random.Random(5)
    words, docs = _words(rng, 150, 10_000).split(), []
    for i in range(60):
        words[rng.randrange(150)] = f"changed{i}"
        docs.append((i, " ".join(words)))
    passage = _words(rng, 12, 10_000)
    docs += [(100 + i, f"{_words(rng, rng.randrange(1, 9), 10_000)} {passage}") for i in range(60)]
    rng.shuffle(docs)
    assert _joined(_table(spark, docs).repartition(3)) == _at_80(docs)


def test_join_at_the_very_threshold(spark):
    """4 of 5 shingles in common link; 7 of 9 don't."""
    base = [f"a{i}" for i in range(9)]
    docs = [(1, " ".join(base[:8])), (2, " ".join(base)), (3, " ".join([f"b{i}" for i in range(12)])), (4, " ".join([f"b{i}" for i in range(11)] + ["c", "d"]))]
    got = _joined(_table(spark, docs))
    assert got == _at_80(docs) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_groups_of_equal_prefixes_are_expanded(spark):
    """Sets of one size that share their prefix are one group; its members are still told apart."""
    docs = _table(spark, [(i, t) for i, t in enumerate(["x y", "x y", "X  Y", "z", None, "", "a b c d e f"])])
    join = ngram_join.Join(docs)
    assert join.buckets().count() == 0  # equal sets are one class
    assert {r.doc_id: r.n_shingles for r in join.all.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 2}
    assert _joined(docs) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}


def test_shingles_without_a_partner_of_like_size_are_dropped(spark):
    """Sets whose sizes are too far apart share a rare shingle: it is dealt, but no class is kept for it."""
    words = [f"w{i}" for i in range(120)]
    docs = _table(spark, [(1, " ".join(words[:5])), (2, " ".join(words)), (3, " ".join(words[60:]))])
    assert ngram_join.Join(docs).buckets().count() == 0
    assert _joined(docs) == {1: 1, 2: 2, 3: 3}


@pytest.mark.parametrize("rows", [1, 2, 7, 5000])
def test_partners_are_found_across_batches(rows):
    """Whatever the batches, a row stays if and only if it and another one of its shingle fit by size, the smaller one short."""
    rng = np.random.default_rng(7)
    key, n, short = np.sort(rng.integers(0, 300, 2000)), rng.integers(5, 60, 2000), rng.random(2000) < 0.5
    sized = 2 * n + short
    order = np.lexsort((sized, key))
    key, sized, lead = key[order], sized[order], np.arange(2000)
    n, short = sized >> 1, (sized & 1).astype(bool)
    partner = (key[:, None] == key) & (lead[:, None] < lead) & short[:, None] & (100 * n[:, None] >= ngram_join.PERCENT * n)
    want = np.flatnonzero(partner.any(0) | partner.any(1))
    table = pa.table({"key": key, "lead": lead, "sized": sized})
    got = [i for b in ngram_join.met(iter(table.to_batches(rows))) for i in b["lead"].to_pylist()]
    assert sorted(got) == want.tolist() and 0 < len(want) < 2000


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for n in (3, 40, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.r_[a[n // 9 :], rng.integers(0, 1 << 63, n // 9, np.uint64)])
        sizes, comp = np.array([len(a), len(b)]), np.array([1, 2])
        both = len(np.intersect1d(a, b))
        if 100 * both >= ngram_join.PERCENT * (len(a) + len(b) - both):
            assert len(ngram_join.near_in_block(sizes, [ngram_join.bitmap(a), ngram_join.bitmap(b)], comp)[0]) == 1
        other = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        assert n < 10 or not len(ngram_join.near_in_block(np.array([len(a), len(other)]), [ngram_join.bitmap(a), ngram_join.bitmap(other)], comp)[0])


def test_join_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    df = _table(spark, [(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f"), (6, ""), (7, None), (8, long), (9, long)])
    assert sorted(map(tuple, ngram_join.similar(df).collect()), key=str) == sorted([(None, 2, None), (None, 0, None), (5, 2, 5), (5, 2, 5), (6, 0, 6), (7, 0, 7), (8, 299_996, 8), (9, 299_996, 8)], key=str)
    assert ngram_join.similar(_empty(spark)).collect() == []


# whitening


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, n string")


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(500, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    df = _vectors(spark, [(i, x.tolist(), 1, "x") for i, x in enumerate(v)]).repartition(4)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    x = np.floor(v.astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, w = e[::-1][:8], c @ (u[:, ::-1][:, :8] / np.sqrt(e[::-1][:8]))
    assert len(got) == 8 * n and {r.n for r in got.values()} == {n}
    for k in range(8):
        mine = np.array([got[i, k + 1].whitened for i in range(n)])
        assert np.abs(mine * np.sign(mine @ w[:, k]) - w[:, k]).max() < 1e-8
        assert abs(got[0, k + 1].explained - e[k] / np.trace(cov)) < 1e-10
    assert all(got[i, 1].deviation == int(((n * x[i] - s) ** 2).sum()) for i in range(n))
    assert {r.identity_error for r in got.values()} == {got[0, 1].identity_error} and got[0, 1].identity_error < 1e-8


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.5, 0.25]), (3, None), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [1.0]), (8, [])]
    got = whitening.whiten(_vectors(spark, [(i, v, 1, "x") for i, v in rows])).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == [(i, k) for i in ("1", "2", "2", "None") for k in (1, 2) for i in (i,)] or len(got) == 8
    assert {r.n for r in got} == {4} and len({(r.component, r.whitened) for r in got if r.vec_id == 2}) == 2
    assert whitening.whiten(_vectors(spark, [])).collect() == []
    assert whitening.whiten(_vectors(spark, [(1, None, 1, "x")])).collect() == []
    alone = whitening.whiten(_vectors(spark, [(1, [1.0, 2.0], 1, "x")])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    flat = whitening.whiten(_vectors(spark, [(i, [float(i), 0.0], 1, "x") for i in range(4)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and {r.explained for r in flat} == {1.0, 0.0}
    with pytest.raises(ArithmeticError):
        whitening.whiten(_vectors(spark, [(1, [3e38], 1, "x"), (2, [0.0], 1, "x")]))


def test_whitening_fails_only_where_a_row_deviates_too_far(spark):
    """Each dimension has another row with its greatest entry: together they would pass 64 bits, no row does."""
    rows = [(i, [30_000.0 if i == j else 0.0 for j in range(16)], 1, "x") for i in range(64)]
    n, got = 64, {r.vec_id: r.deviation for r in whitening.whiten(_vectors(spark, rows)).collect()}
    x = [[math.floor(c * 1024) + 100_000 for c in v] for _, v, _, _ in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    with pytest.raises(ArithmeticError, match="64 bits"):
        whitening.whiten(_vectors(spark, [(i, [30_000.0 * (i == 0)] * 16, 1, "x") for i in range(64)]))



# ranked search


def _ranked(docs, items):
    return sorted(map(tuple, ranked_search.search(ranked_search.index(docs), items).collect()), key=str)


def _items(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1.0) for i, t in rows], "item_id string, text string, rank int, score double")


def test_ranks_equal_brute_force_in_many_shards_and_blocks(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, _words(rng, rng.randrange(1, 120), 300)) for i in range(400)] + [(i, "w1 w2 w3") for i in range(400, 440)]
    items = [(f"i{k}", _words(rng, rng.randrange(1, 40), 300)) for k in range(30)] + [("ties", "w1 w2"), ("none", "zzz"), ("blank", " ,")]
    rng.shuffle(docs)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 100)
    want = sorted(ranked_search.reference(docs, items), key=str)
    assert _ranked(_table(spark, docs).repartition(6), _items(spark, items)) == want
    assert [r[2] for r in want if r[0] == "ties"] and not [r for r in want if r[0] in ("none", "blank")]


def test_wand_skips_documents(monkeypatch):
    """A rare term's document beats all that hold only the frequent term; they aren't scored once ten such are found."""
    n = 1000
    docs = np.r_[np.arange(n), np.arange(0, 20)]
    scores = np.r_[np.full(n, 5), np.full(20, 100)]
    scored = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, int):
                scored.append(key)
            return super().__getitem__(key)

    zeros = np.zeros
    monkeypatch.setattr(ranked_search.np, "zeros", lambda shape, kind: zeros(shape, kind).view(Counted))
    found = ranked_search.wand([0, 1], docs, scores, np.array([0, n, n + 20]), np.array([5, 100]), n, 10)
    assert sorted(found, reverse=True) == [(105, -d) for d in range(10)] and len(scored) == 10


def test_ranks_of_odd_rows(spark):
    docs = [(None, "cat dog"), (3, "cat dog"), (3, "cat dog"), (2, None), (1, ""), (9, "..."), (7, "CAT é " + "dog " * 50_000), (8, "bird")]
    items = [("a", "Cat!"), ("a", "dog"), (None, "cat"), ("b", None), ("c", ""), ("d", "é")]
    want = sorted(ranked_search.reference(docs, items), key=str)
    assert _ranked(_table(spark, docs), _items(spark, items)) == want
    assert {r[0] for r in want} == {"a", "d"} and [r[2] for r in sorted(want[:4], key=lambda r: r[1])] == [3, 3, None, 7]
    assert _ranked(_empty(spark), _items(spark, items)) == [] and _ranked(_table(spark, docs), _items(spark, [])) == []
    assert _ranked(_table(spark, [(1, None)]), _items(spark, items)) == []


def test_one_index_serves_several_searches(spark):
    docs = table(spark, TEST, "documents")
    shards, items = ranked_search.index(docs), table(spark, TEST, "benchmark")
    whole = {tuple(r) for r in ranked_search.search(shards, items).collect()}
    half = {tuple(r) for r in ranked_search.search(shards, items.where("item_id % 2 = 0")).collect()}
    assert half == {r for r in whole if r[0] % 2 == 0}


# nearest neighbours


def test_recall_holds_as_the_table_grows():
    """The forest's rule in numpy, with its production parameters, on evenly spread directions far beyond the size at which
    it compares everything: recall stays above 0.9, and the budget's share of the table falls."""
    rng, shares = np.random.default_rng(5), []
    normals = ann_forest.hyperplanes(64, ann_forest.TREES, ann_forest.BITS, 3)
    for n in (60_000, 180_000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        queries, found = x[:16], np.zeros((16, ann_forest.BITS + 1), np.int64)
        lengths = np.zeros((ann_forest.TREES, 16, n), np.int8)
        for t, own in enumerate(normals):
            s = np.asarray(ann_forest.strings(x, own)).astype(np.int64)
            for q in range(16):
                lengths[t, q] = ann_forest.BITS - np.frexp((s ^ s[q]).astype(float))[1]
                found[q] += np.bincount(lengths[t, q], minlength=ann_forest.BITS + 1)
        enough, recall = ann_forest.budget(n, ann_forest.CANDIDATES), []
        for q in range(16):
            depth = np.flatnonzero(found[q][::-1].cumsum()[::-1] >= enough).max()
            met = (lengths[:, q] >= depth).any(0)
            score = x @ queries[q]
            score[q] = -2
            recall.append(met[np.argpartition(-score, 20)[:20]].mean())
        assert np.mean(recall) >= 0.9
        shares.append(enough / n)
    assert shares[1] < shares[0] and ann_forest.budget(50_000, 24_000) == 24_000 and ann_forest.budget(6_000_000, 24_000) / 6_000_000 < shares[0] / 1.9
