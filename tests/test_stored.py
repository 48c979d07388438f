"""What is kept between runs: the search index, threads by batch, sessions with state, pages read once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from listloom.operators import search, threads
from listloom.operators.search_index import SearchIndex, left_out, variants
from listloom.streaming import incremental, sessions
from listloom.streaming.thread_store import ThreadStore, page_stream, thread_stream

# search


def _docs(spark, n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 14))) for _ in range(200)] + ["workshop", "parallel", "Δοκιμή", "ab"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 8))) or None, rng.choice(vocabulary), rng.choice(["event", "technical", None])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, subject string, from_name string, category string"), vocabulary


def _scores(df, key):
    return sorted((r[key], r.score) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs, vocabulary = _docs(spark)
    index = SearchIndex(spark, str(tmp_path_factory.mktemp("index")))
    index.append(docs.where("id % 3 = 0"), "id").append(docs.where("id % 3 > 0"), "id")
    return docs, vocabulary, index


def test_stored_search_equals_search(stored):
    docs, vocabulary, index = stored
    rng = random.Random(2)
    asked = ["workshp", "paralel workshop", "δοκιμη", "a", "  ", "zzzzzzzz"]
    for _ in range(4):  # words with up to two mistakes, near their beginnings too
        w = list(rng.choice([v for v in vocabulary if len(v) > 7]))
        del w[rng.randrange(len(w))]
        w.insert(rng.randrange(len(w)), "b")
        asked.append("".join(w))
    for query in asked:
        category = "event" if query == "a" else None
        assert _scores(index.hits(query, category=category), "key") == _scores(search.hits(docs, query, "id", category=category), "id"), query


def test_many_matching_terms_are_joined(stored, monkeypatch):
    docs, _, index = stored
    monkeypatch.setattr("listloom.operators.search_index.LISTED", 2)
    assert _scores(index.hits("a"), "key") == _scores(search.hits(docs, "a", "id"), "id")


def test_a_query_reads_the_folders_of_its_terms(stored):
    _, _, index = stored
    df = index.postings("workshop")
    terms = {r.term for r in df.collect()}
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert terms == {"workshop"} and "PartitionFilters: [" in scan.toString() and "bucket" in scan.toString().split("PartitionFilters: ")[1].split("]")[0]
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,workshop)]" in scan.toString() or "In(term" in scan.toString()
    read = scan.metrics().apply("numFiles").value()
    assert 0 < read <= 2 < len(df.inputFiles())  # one folder of each arrival


def test_an_arrival_that_broke_off_counts_nowhere(spark, stored, tmp_path):
    docs, _, _ = stored
    index = SearchIndex(spark, f"{tmp_path}/i").append(docs.where("id < 100"), "id")
    before = _scores(index.hits("workshop"), "key")
    index.append(docs.where("id >= 100"), "id")
    os.remove(f"{tmp_path}/i/sizes/arrival=1/_SUCCESS")
    assert _scores(index.hits("workshop"), "key") == before
    index.append(docs.where("id >= 100"), "id")
    assert _scores(index.hits("workshop"), "key") == _scores(search.hits(docs, "workshop", "id"), "id")
    with pytest.raises(FileNotFoundError):
        SearchIndex(spark, f"{tmp_path}/none").hits("x")


def test_variants_of_both_sides(spark):
    words = ["", "a", "ab", "abcdefghijklmno", "éé😀x"]
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", variants(F.col("w")).alias("v")).collect():
        assert sorted(r.v) == left_out(r.w, 2)


# threads


MESSAGES = "message_number long, in_reply_to_number long, subject string"


def _messages(spark, rows):
    return spark.createDataFrame([(n, p, f"s{n}") for n, p in rows], MESSAGES)


def _threads(df):
    return sorted((r.message_number is None, r.message_number, r.thread_id) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_a_rebuild(spark, tmp_path, seed):
    """Random parents: missing ones, chains, cycles and ways into them, in random order."""
    rng = random.Random(seed)
    rows = [(n, rng.choice([None, rng.randrange(60), rng.randrange(60), n - 1])) for n in range(50)]
    rows += [(100, 102), (101, 100), (102, 101), (103, 101), (104, 103), (105, 105)]
    rng.shuffle(rows)
    store = ThreadStore(spark, f"{tmp_path}/t")
    for i in range(0, len(rows), 14):
        store.add(_messages(spark, rows[i : i + 14]))
        if i == 14:
            assert store.compact(least=1) and not store.compact(least=1)
    store.add(_messages(spark, [(None, 3), (None, None), *rows[:5]]))
    want = _threads(threads.thread_roots(_messages(spark, [*rows, (None, 3), (None, None)])))
    assert _threads(store.messages()) == want


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    store = ThreadStore(spark, f"{tmp_path}/t")
    store.add(_messages(spark, [(n, n - 1 if n % 10 else None) for n in range(1000)]).union(_messages(spark, [(2001, 2000), (2002, 2001)])))
    store.add(_messages(spark, [(2000, 5), (3000, 17)]))
    log = spark.read.parquet(f"{tmp_path}/t/roots/batch=1")
    assert sorted((r.message_number, r.thread_id) for r in log.collect()) == [(2000, 0), (2001, 0), (2002, 0), (3000, 10)]
    assert spark.read.parquet(f"{tmp_path}/t/messages/batch=1").count() == 2
    store.add(_messages(spark, [(2000, 5), (3000, 27)]), number=1)  # once more, as after a failure
    assert {r.message_number: r.thread_id for r in store.roots().collect()}[3000] == 20 and store.messages().count() == 1004


def test_a_batch_links_only_what_is_new(spark, tmp_path, monkeypatch):
    """A late top moves a long chain, whose own links aren't followed again."""
    linked, own = [], threads.climbed
    monkeypatch.setattr("listloom.streaming.thread_store.climbed", lambda edges: linked.append(edges.count()) or own(edges))
    store = ThreadStore(spark, str(tmp_path / "store"))
    for rows in ([(n, n - 1) for n in range(2, 30)], [(1, 0)]):
        store.add(spark.createDataFrame(rows, "message_number long, in_reply_to_number long"))
    assert linked == [28, 1] and {r.thread_id for r in store.roots().collect()} == {0}


def test_the_stream_adds_new_messages_only(spark, tmp_path):
    for rows in ([(2, 1), (3, 2)], [(1, 9), (4, 3), (2, 7)]):
        _messages(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        thread_stream(spark.readStream.schema(MESSAGES).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    assert _threads(ThreadStore(spark, f"{tmp_path}/t").messages()) == [(False, n, 9) for n in (1, 2, 3, 4)]


def test_pages_are_read_once_and_an_empty_parse_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []

    def parse(batch):
        rows = batch.select(F.regexp_extract("path", r"msg(\d+)", 1).cast("long").alias("message_number"), F.decode("content", "UTF-8").try_cast("long").alias("in_reply_to_number"))
        seen.append(sorted(r[0] for r in rows.collect()))
        return rows.where("message_number < 100")

    def run():
        thread_stream(page_stream(spark, f"{tmp_path}/in", "*.html"), f"{tmp_path}/t", f"{tmp_path}/c", parse).awaitTermination()

    for pages in ({"msg1.html": "first", "msg2.html": "1", "note.txt": "9"}, {"msg3.html": "2"}):
        for name, text in pages.items():
            (tmp_path / "in" / name).write_text(text)
        run()
    assert seen == [[1, 2], [3]]
    run()
    assert seen == [[1, 2], [3]] and _threads(ThreadStore(spark, f"{tmp_path}/t").messages()) == [(False, n, 1) for n in (1, 2, 3)]
    (tmp_path / "in" / "msg100.html").write_text("x")
    with pytest.raises(Exception, match="no page gave a message"):
        run()


# sessions


def _told(spark, rows, folder, files, **options):
    df = spark.createDataFrame(rows, "key string, id long, t string").select("key", "id", F.to_timestamp("t").alias("at"))
    for part in files:
        df.where(F.col("id").isin(*part)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")
    return incremental.run_to_table(sessions.gap_sessions(stream, "key", "at", "id", **options), "told", "update", sessions.ROCKS)


ROWS = [
    ("k", 1, "2020-01-01 00:00:00"), ("k", 2, "2020-03-01 23:59:59"), ("k", 3, "2020-05-01 23:59:59"), ("k", 4, "2020-05-01 23:59:59"), ("j", 5, "2020-01-01 00:00:00"),
    ("k", 6, "2019-06-01 00:00:00"), ("k", 7, "2020-04-01 00:00:00"), ("k", 8, None), (None, 9, "2020-01-01 00:00:00"), ("j", 10, "2021-01-01 00:00:00"),
]


def test_late_events_renumber_sessions(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    told = _told(spark, ROWS, tmp_path, [(3, 5, 9), (1, 2, 8), (4, 10), (6,), (7,)])
    batch = threads.split_at_gaps(spark.createDataFrame(ROWS, "key string, id long, t string").withColumn("date", F.to_timestamp("t")), "key", [F.col("date"), F.col("id")])
    want = {r.id: None if r.key is None or r.date is None else int((r.key.split("#") + ["0"])[1]) for r in batch.collect()}
    assert {r.id: r.session for r in sessions.latest(told, "key", "id").collect()} == want
    assert told.where("id = 3").count() > 1  # it was told anew
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_final_events_leave_the_state(spark, tmp_path):
    rows = [("k", i, f"2020-{m:02d}-01 00:00:00") for i, m in enumerate((1, 2, 6, 7, 12))] + [("k", 9, "2020-01-15 00:00:00")]
    told = _told(spark, rows, tmp_path, [(0,), (1,), (2,), (3,), (4,), (9,)], late="1 day")
    got = {r.id: r.session for r in sessions.latest(told, "key", "id").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}  # the last one comes behind the watermark
    assert sessions.numbered([(5 * sessions.DAY, 1)], (0, 7), 3) == [8] and sessions.numbered([], None, 3) == []


def test_keys_of_one_bucket_are_numbered_apart(spark, tmp_path):
    """All keys in one bucket, over several batches; an event without an id doesn't round the others' ids."""
    big, start = (1 << 53) + 1, 1_577_836_800
    rows = [(f"k{i % 7}", None if i == 40 else big + i, start + (i * 37 % 400) * 86_400) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, id long, s long").select("key", "id", F.timestamp_seconds("s").alias("at"))
    for part in range(3):
        df.where(F.coalesce(F.col("id"), F.lit(0)) % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    told = incremental.run_to_table(sessions.gap_sessions(stream, "key", "at", "id", days=20, buckets=1), "told", "update", sessions.ROCKS)
    want = {}
    for k in range(7):
        events = sorted((s * 1_000_000, i or 0) for key, i, s in rows if key == f"k{k}")
        want |= {(f"k{k}", i or None): n for (_, i), n in zip(events, sessions.numbered(events, None, 20), strict=True)}
    assert {(r.key, r.id): r.session for r in sessions.latest(told, "key", "id").collect()} == want
