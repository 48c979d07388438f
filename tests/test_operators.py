"""Threads, duplicates, views, search, sources and incremental runs on small tables."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from listloom.operators import dedup, search, threads, views
from listloom.session import configured
from listloom.sources import archive, html
from listloom.streaming import incremental


def _messages(spark, rows):
    return spark.createDataFrame(rows, "message_number long, in_reply_to_number long")


def _walk(parents):
    """The rule in words: follow parents until there is none, or until a number comes twice."""
    out = {}
    for n in parents:
        seen, at = set(), n
        while at not in seen and parents.get(at) is not None:
            seen.add(at)
            at = parents[at]
        out[n] = at
    return out


def _depth(parents):
    out = {}
    for n in parents:
        seen, at, d = set(), parents[n], 0
        while at is not None and at in parents and at not in seen:
            seen.add(at)
            d, at = d + 1, parents[at]
        out[n] = d
    return out


def test_roots_of_traced_cases(spark):
    rows = [(1, None), (2, 1), (3, 2), (5, 6), (6, 5), (7, 5), (8, 99), (9, 9)]
    got = {r.message_number: r.thread_id for r in threads.thread_roots(_messages(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 6, 7: 5, 8: 99, 9: 9}


@pytest.mark.parametrize("seed", range(3))
def test_roots_and_depths_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    parents = {n: rng.choice([None, *range(60), 999]) if rng.random() < 0.8 else n - 1 for n in range(1, 60)}
    m = _messages(spark, list(parents.items())).withColumn("thread_key", F.lit("t"))
    assert {r.message_number: r.thread_id for r in threads.thread_roots(m).collect()} == _walk(parents)
    assert {r.message_number: r.depth for r in threads.reply_depths(m).collect()} == _depth(parents)


def test_gaps(spark):
    rows = [("k", "2020-01-01 00:00:00", 1), ("k", "2020-03-01 23:59:59", 2), ("k", "2020-05-01 23:59:59", 3), ("k", None, 4), ("j", "2020-01-01 00:00:00", 5)]
    df = spark.createDataFrame(rows, "key string, d string, n long").withColumn("date", F.to_timestamp("d"))
    got = {r.n: r.key for r in threads.split_at_gaps(df, "key", [F.col("date"), F.col("n")]).collect()}
    assert got == {1: "k", 2: "k", 3: "k#1", 4: "k", 5: "j"}


FULL = "message_number long, date timestamp, from_name string, subject string, body_clean string, source string, source_url string"


def _full(spark, rows):
    return spark.createDataFrame(rows, "message_number long, d string, from_name string, subject string, body_clean string, source string, source_url string").withColumn("date", F.to_timestamp("d")).drop("d")


def test_dedup_rules_and_idempotence(spark):
    day = "2020-01-01 10:00:00"
    m = _full(spark, [
        (1, day, "a", "Re: x", "b1", "live", "u1"), (2, day, "a", "x", "b2", "topic", "u2"),  # two sources: priority wins
        (3, day, "a", "y", "b1", "legacy", "p"), (4, day, "a", "y", "b2", "legacy", "p"),  # one page: both stay
        (5, day, None, "z", "b1", "legacy", "p"), (6, day, None, "z", "b2", "legacy", "p"),  # no author: one stays
        (7, day, "a", "", "b1", "live", "u7"), (8, day, "a", "", "b2", "live", "u8"),  # blank subjects differ by body
    ])
    once = dedup.resolved(m)
    assert sorted(r.message_number for r in once.collect()) == [1, 3, 4, 5, 7, 8]
    assert sorted(r.message_number for r in dedup.resolved(once).collect()) == [1, 3, 4, 5, 7, 8]


def test_newest_and_upsert(spark):
    e = spark.createDataFrame([("u", "2", "b"), ("u", "10", "a"), ("v", "1", "z"), ("v", "1", "y")], "key string, timestamp string, url string")
    assert {(r.key, r.url) for r in dedup.newest(e, "key").collect()} == {("u", "b"), ("v", "y")}
    rows = [(n, n // 2 or None) for n in range(1, 20)]
    whole = threads.thread_roots(_messages(spark, rows))
    parts = incremental.upserted(threads.thread_roots(_messages(spark, rows[5:])), _messages(spark, rows[:8]))
    assert sorted(map(tuple, parts.select("message_number", "thread_id").collect())) == sorted(map(tuple, whole.select("message_number", "thread_id").collect()))


def test_neighbours_equal_one_global_window(spark):
    rows = [(n, None if n % 7 == 0 else f"2020-01-{1 + n % 3:02d} 00:00:00", "a", "s", "b", "live", f"u{n}") for n in range(1, 40)]
    df = views.with_neighbours(_full(spark, rows), column="source_url")
    order = [r.source_url for r in _full(spark, rows).orderBy(F.col("date").asc_nulls_first(), "message_number").collect()]
    got = {r.source_url: (r.previous_source_url, r.next_source_url) for r in df.collect()}
    assert got == {u: (order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, u in enumerate(order)}


def test_urls(spark):
    df = spark.createDataFrame([(42, "2006-May_1_a.html"), (123456, "topic001.html")], "message_number long, source_file string")
    assert [r[0] for r in df.select(archive.page_url("live", "x/")).collect()] == ["x/msg00042.html", "x/msg123456.html"]
    assert df.select(archive.page_url("pipermail", "x/")).first()[0] == "x/2006-May/1_a.html"
    assert [r[0] for r in df.select(archive.page_url("topic", "x/", "t/")).collect()] == ["x/2006-May_1_a.html", "t/topic001.html"]


def test_search(spark):
    d = spark.createDataFrame([(1, "parallel runs", "Ann"), (2, "paralel", "Ben"), (3, "other", "Parallel")], "id long, subject string, from_name string")
    found = {r.id: r.score for r in search.hits(d, "parallel", "id").collect()}
    assert set(found) == {1, 2, 3} and found[2] > 0
    assert search.hits(d, "  ", "id").count() == 0
    assert search.tolerance("abc") == 0 and search.tolerance("x" * 20) == 2


def test_sources(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a": "A", "b": "B", "a": "C"}')
    assert {tuple(r) for r in archive.overrides(spark, f"{tmp_path}/o.json").collect()} == {("a", "C"), ("b", "B")}
    assert archive.overrides(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "cdx.txt").write_text("20200101000000 http://x/1.html\nbroken\n2 http://y/2\n")
    assert archive.index_listing(spark, f"{tmp_path}/cdx.txt", "x/").count() == 1
    with pytest.raises(FileNotFoundError):
        archive.first_existing(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    with pytest.raises(ValueError):
        archive.load_sources(spark, {"live": f"{tmp_path}/none"})


LIVE = """<html><body><h1><span class="subject"><a><span itemprop="name">Re: A &amp; B</span></a></span></h1>
<div class="msgHead"><span class="sender"><a><span itemprop="name">Ann</span></a></span> <span class="date"><a href="#">Thu, 19 Mar 2026 10:20:38 -0700</a></span></div>
<div class="msgBody"><pre>Hello<br>you</pre>X-Body-of-Message</div><form><input name="msgid" value="m@x"></form>
<ul class="icons"><li><span class="subject"><a href="msg00007.html">A</a></span></li><li><ul><li class="tSliceCur"><span class="subject">B</span></li></ul></li></ul></body></html>"""
NESTED = LIVE.replace("<pre>Hello<br>you</pre>", "<div>one<div>two</div><div>three</div></div><blockquote>four<br>five</blockquote>")
LEGACY = """<html><head><title>Topic</title></head><body>From: Ann Example &lt;a@x.example&gt;<br>Subject: First<br>Date: 16 Oct 1995<br><br>Some words that make the block long enough to count.<br>
********<br>From: Ben<br>Date: 17 Oct 1995<br>Subject: Re: First<br>More words that make this block long enough, too.<br>-------------<br>x = 1</body></html>"""
PIPER = """<html><head><title>Hi</title><meta name="author" content=""></head><!-- name="Ann Example" --><!-- sent="Fri, 01 Dec 2006 22:59:17 +1300" -->
<body><div class="mail"><address>x</address>caf=C3=A9 =3D tea =C3=A9</div></body></html>"""
TOPIC = """<html><body><h1>A topic</h1><p>Question started by: Ann Example - 21 Nov 1993</p><p>Why?</p><p>Reply by Ben (b@x.example)</p><p>So.</p><p>End of topic</p><p>Reply by nobody</p></body></html>"""


def test_pages(spark):
    def page(text, name="p.html"):
        return spark.createDataFrame([(8, name, bytearray(text.encode()))], "message_number long, name string, content binary")

    live = html.live_messages(page(LIVE)).first()
    assert (live.subject, live.from_name, live.message_id, live.in_reply_to_number, live.body_raw) == ("Re: A & B", "Ann", "m@x", 7, "Helloyou")
    legacy = html.legacy_messages(page(LEGACY)).orderBy("place").collect()
    assert [(r.from_name, r.subject, str(r.date)[:10]) for r in legacy] == [("Ann Example", "First", "1995-10-16"), ("Ben", "Re: First", "1995-10-17")]
    piper = html.pipermail_messages(page(PIPER, "2006-December_0015.html")).first()
    assert (piper.from_name, piper.archive_id, piper.body_clean, str(piper.date)) == ("Ann Example", 15, "café = tea é", "2006-12-01 09:59:17")
    imputed = spark.createDataFrame([("p.html", None, "6 Apr 1994")], "name string, place int, date_raw string")
    topic = html.topic_messages(page(TOPIC), imputed).orderBy("place").collect()
    assert [(r.from_name, r.body_raw, str(r.date)[:10]) for r in topic] == [("Ann Example", "Why?", "1993-11-21"), ("Ben", "So.", "1994-04-06")]
    latin = spark.createDataFrame([(bytearray("é".encode("latin-1")),)], "c binary")
    assert latin.select(html.decoded(F.col("c"))).first()[0] == "é"


def test_whole_bodies_of_nested_pages(spark):
    def page(text, charset="utf-8"):
        return spark.createDataFrame([(8, "2006-May_1.html", bytearray(text.encode(charset)))], "message_number long, name string, content binary")

    assert html.live_messages(page(NESTED)).first().body_raw == "one\n\ntwo\n\nthree\n\n> four five"
    deep = LIVE.replace("<pre>Hello<br>you</pre>", "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>end</p>")
    assert html.live_messages(page(deep)).first().body_raw == "deep\n\nend"
    mail = '<title>T</title><div class="mail"><div>one</div><p>two</p> <p>three</p><div>four <dfn>x</dfn></div><span id="received">r</span></div>'
    assert html.pipermail_messages(page(mail)).first().body_raw == "onetwo\n\nthreefour"
    assert html.pipermail_messages(page("<title>T</title><pre>a</pre><pre>b</pre>")).first().body_raw == "a\nb"
    soft = '<div class="mail">a long line=\n<br>goes on</div>'
    assert html.pipermail_messages(page(soft)).first().body_raw == "a long linegoes on"
    for charset, said in (("windows-1252", "windows-1252"), ("koi8-r", "koi8-r"), ("utf-8", "no-such"), ("utf-8", "us-ascii"), ("latin-1", "")):
        text = f'<meta charset="{said}"><title>{"тест" if charset == "koi8-r" else "“é”" if charset != "latin-1" else "é"}</title>'
        assert page(text, charset).select(html.decoded(F.col("content"))).first()[0] == text


@pytest.mark.parametrize(
    ("block", "want"),
    [
        ("\nPage\n\nFrom: a\n\n  Subject: b\n\nbody  \n\n\n\nend", "From: a\nSubject: b\nbody\n\nend"),
        ("Page\nbody", "Page\nbody"),
        ("noise\nmore\nFrom a@x.example Mon\nDate: x\nbody", "From a@x.example Mon\nDate: x\nbody"),
        ("1\n2\n3\n4\n5\n6\n7\n8\nFrom: late", "1\n2\n3\n4\n5\n6\n7\n8\nFrom: late"),
        ("From: a\nDate: b", "From: a\nDate: b"),
        ("", ""),
    ],
)
def test_header_first(one, block, want):
    assert one(lambda b, t: html.header_first(b, t), block, "Page") == want


def test_latest_version_is_the_same_in_every_run_and_keeps_rows_without_key(spark):
    known = spark.createDataFrame([(1, "old"), (None, "x"), (2, "old")], "message_number long, subject string")
    new = spark.createDataFrame([(1, "b"), (1, "a"), (None, "y")], "message_number long, subject string")
    found = {tuple(sorted((r.message_number or 0, r.subject) for r in dedup.latest_version(known, new.repartition(n)).collect())) for n in (1, 2, 3)}
    assert len(found) == 1 and {(0, "x"), (0, "y"), (2, "old")} < set(found.pop())


def test_numbers_of_undated_messages_in_several_runs(spark, monkeypatch):
    from listloom.operators import views
    from listloom.plans.enrich import by_date

    rows = [(n if n % 9 else None, None if n % 4 else "2020-01-%02d" % (n % 28 + 1), None if n % 7 == 0 else "s", f"u{n:03}") for n in range(200)]
    df = spark.createDataFrame(rows, "message_number long, d string, subject string, source_url string").withColumn("date", F.to_timestamp("d"))
    want = sorted((r.source_url, r.msg_seq) for r in views.numbered(df, by_date()).collect())
    near = {r.message_number: r.next_source_url for r in views.with_neighbours(df.where("message_number IS NOT NULL"), column="source_url").collect()}
    monkeypatch.setattr(views, "RUN", 16)
    assert sorted((r.source_url, r.msg_seq) for r in views.numbered(df, by_date()).collect()) == want
    assert {r.message_number: r.next_source_url for r in views.with_neighbours(df.where("message_number IS NOT NULL"), column="source_url").collect()} == near


def test_upsert_stream(spark, tmp_path):
    rows = [(n, n // 2 or None) for n in range(1, 10)]
    _messages(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("message_number long, in_reply_to_number long").parquet(f"{tmp_path}/in")
    incremental.upsert_stream(stream, f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()
    assert {r.thread_id for r in incremental.newest_version(spark, f"{tmp_path}/store").collect()} == {1}
    _messages(spark, [(10, 9)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    incremental.upsert_stream(stream, f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()
    assert incremental.newest_version(spark, f"{tmp_path}/store").count() == 10
    shutil.rmtree(f"{tmp_path}/store/v1")
    _messages(spark, [(11, 9)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="would become the store"):
        incremental.upsert_stream(stream, f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()


def test_enriched_messages(spark):
    from listloom.plans.catalogue import messages
    from listloom.plans.enrich import enriched

    from .conftest import SMALL

    m = messages(spark, SMALL)
    out = enriched(m, decode=False).cache()
    assert out.count() == m.count()
    assert {"author_slug", "thread_key", "msg_seq", "url", "display_thread_key", "year", "month"} <= set(out.columns)
    assert out.where("from_name = '' OR subject = ''").count() == 0
    assert out.where("date IS NOT NULL").select("url").distinct().count() == out.where("date IS NOT NULL").count()
    shuffled = enriched(m.repartition(7), decode=False)
    assert shuffled.exceptAll(out).count() == 0


def test_sources_to_messages(spark, tmp_path):
    live = spark.createDataFrame([(1, "Ann", "Re: x", "2020-01-01 00:00:00")], "message_number long, from_name string, subject string, d string")
    live = live.withColumn("date", F.to_timestamp("d"))
    old = live.withColumn("source_file", F.lit("2006-May_1.html")).drop("message_number")
    live.write.parquet(f"{tmp_path}/live")
    old.write.parquet(f"{tmp_path}/pipermail")
    files = {k: f"{tmp_path}/{k}" for k in ("live", "pipermail", "legacy")}
    both = archive.load_sources(spark, files, {k: archive.page_url(k, "http://a/") for k in files})
    assert both.columns[:5] == ["date", "from_name", "subject", "category", "body_clean"] and both.count() == 2
    kept = dedup.resolved(both).collect()
    assert [(r.source, r.source_url) for r in kept] == [("live", "http://a/msg00001.html")]


# messages are shuffled no more often than needed


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbering_shuffles_messages_once(spark):
    with configured(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        m = spark.range(9).selectExpr("id AS message_number", "timestamp_seconds(id * 90000) AS date", "string(id) AS subject")
        assert _plan(views.numbered(m, [F.col("date"), F.col("message_number")])).count("Exchange hashpartitioning") == 4  # three of them of days


def test_few_gaps_are_broadcast(spark):
    m = spark.range(2_000_000).selectExpr("id", "string(id % 50) AS key", "timestamp_seconds(id % 100 * 8640000) AS date")
    found = threads.split_at_gaps(m, "key")
    assert "BroadcastHashJoin" in _plan(found) and found.where("key LIKE '7#%'").count() == 20_000
