"""Scans by days, clustered tables, footers, collation, spelling, shapes of dates, page folders."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from listloom.functions import dates, text
from listloom.functions.text import is_reply
from listloom.operators import dedup, threads, views
from listloom.plans.enrich import by_date
from listloom.sources import archive, html


def _thread_rows(seed, n=400):
    rng = random.Random(seed)
    days = [f"20{rng.randrange(10, 14)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d} {h:02d}:00:00" for h in (3, 3, 23) for _ in range(30)]
    return [(i, rng.choice([None, "hot", "hot", "hot", f"k{rng.randrange(9)}"]), rng.choice([None, *days]), rng.choice(["Re: a", "a", "RE: b"]), rng.randrange(1, 300)) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "message_number long, k string, d string, subject string, msg_seq long").withColumn("date", F.to_timestamp("d")).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_scans_by_days_equal_windows_over_threads(spark, monkeypatch, seed):
    monkeypatch.setattr(threads, "RUN", 16)
    df = _frame(spark, _thread_rows(seed))
    order = Window.partitionBy("k").orderBy(F.col("date").isNull(), "date", "msg_seq", "message_number")
    plain = df.withColumn("place", F.row_number().over(order))
    start = F.min(F.when(~is_reply(F.col("subject")), F.col("place"))).over(Window.partitionBy("k"))
    plain = plain.withColumn("first", F.coalesce(F.col("place") == start, F.lit(False)))
    plain = plain.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("first"), "place")))
    assert {r.message_number: r.position for r in threads.thread_order(df, "k").collect()} == {r.message_number: r.position for r in plain.collect()}

    run = Window.partitionBy("k").orderBy("date", "message_number")
    gap = F.coalesce(F.floor((F.unix_micros("date") - F.unix_micros(F.lag("date").over(run))) / 86_400_000_000) > 20, F.lit(False)).cast("int")
    dated = df.where("date IS NOT NULL AND k IS NOT NULL").withColumn("gap", gap).withColumn("n", F.sum("gap").over(run))
    want = {r.message_number: f"{r.k}#{r.n}" if r.n else r.k for r in dated.collect()}
    got = {r.message_number: (r.date, r.k0, r.k) for r in threads.split_at_gaps(df.withColumn("k0", F.col("k")), "k", by_date(), days=20).collect()}
    assert len(got) == df.count() and all(k == want.get(n, k0) for n, (_, k0, k) in got.items())


def test_no_window_reads_messages_of_a_whole_thread(spark):
    """Windows over threads stand above an aggregate by thread and day."""
    plan = threads.split_at_gaps(_frame(spark, _thread_rows(3)), "k")._jdf.queryExecution().sparkPlan().toString().splitlines()
    windows = [i for i, line in enumerate(plan) if "Window [" in line]
    assert windows and all("HashAggregate(keys=[k" in "".join(plan[i : i + 5]) for i in windows)
    assert threads.thread_order(_frame(spark, []), "k").count() == 0


def test_pages_mixed_by_any_source(spark):
    rows = [(1, "legacy", "p", "a"), (2, "legacy", "p", "b"), (3, "live", "p", "a"), (4, "legacy", "q", "a"), (5, "legacy", None, "a"), (6, "topic", "t", "z"), (7, "legacy", "r", "")]
    df = spark.createDataFrame(rows, "message_number long, source string, source_url string, subject string").withColumns({"date": F.lit(None).cast("timestamp"), "thread_key": F.lit(None).cast("string")})
    got = {r.message_number: r.display_thread_key for r in threads.display_threads(df, by_date()).collect()}
    assert got == {1: "page:p", 2: "page:p", 3: "a", 4: "a", 5: "a", 6: "page:t", 7: "page:r"}


def test_followups_of_a_page_in_one_shuffle(spark):
    kind = "message_number long, date timestamp, from_name string, subject string, body_clean string, source string, source_url string, in_reply_to_number long"
    rows = [(None, "N", "x", "one", "legacy", "p"), (None, "N", "x", "two", "legacy", "p"), (None, "N", "x", "two", "legacy", "p"), (None, "M", "x", "b", "live", "u"), (None, "M", "x", "c", "topic", "v")]
    df = spark.createDataFrame([(n, None, f, s, b, k, u, None) for n, f, s, b, k, u in rows], kind).withColumn("date", F.to_timestamp(F.lit("2020-01-01 00:00:00")))
    found = dedup.resolved(df)
    assert sorted((r.from_name, r.body_clean) for r in found.collect()) == [("M", "b"), ("N", "one"), ("N", "two")]
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial")[0].count("Exchange hashpartitioning") == 1


def test_clustered_tables_join_without_an_exchange(spark, tmp_path):
    a = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    b = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for name, df in (("clustered_a", a), ("clustered_b", b)):
        archive.write_clustered(df, name, "k", 4, f"{tmp_path}/{name}")
    try:
        joined = spark.table("clustered_a").join(spark.table("clustered_b").hint("merge"), "k").groupBy("k").agg(F.sum("v").alias("v"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert {r.k: r.v for r in joined.collect()} == {k: 40 * k for k in range(50)}
        assert spark.table("clustered_a").where("k = 7").count() == 20
    finally:
        for name in ("clustered_a", "clustered_b"):
            spark.sql(f"DROP TABLE {name}")


def test_maxima_come_from_footers(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("message_number"), F.lit("x").alias("body")).write.parquet(f"{tmp_path}/m")
    spark.range(0).select(F.col("id").alias("message_number")).write.parquet(f"{tmp_path}/none")
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert archive.greatest(spark, f"{tmp_path}/m") == 4999 and archive.greatest(spark, f"{tmp_path}/none") is None
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    with archive.configured(spark, archive.FOOTERS):
        plan = spark.read.parquet(f"{tmp_path}/m").agg(F.max("message_number"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MAX(message_number)]" in plan


def test_lists_are_collated(spark):
    names = ["Zoë", "Émile", "emil", "Emil", "zoe", "Ødegaard", "Olsen"]
    index = spark.createDataFrame([(n, n, 1, 2000) for n in names], "author_slug string, name string, n long, last_year int")
    assert [r.name for r in views.sorted_authors(index).collect()] == ["emil", "Emil", "Émile", "Ødegaard", "Olsen", "zoe", "Zoë"]
    assert [r.name for r in views.sorted_authors(index, "name_desc").collect()][:2] == ["Zoë", "zoe"]


@pytest.mark.parametrize(("name", "want"), [
    ("Жанна Щукина", "zhanna-shchukina"), ("Ельцын, Борис", "eltsyn-boris"), ("Γιώργος Χατζής", "giorgos-khatzes"), ("Ærø Straße", "aero-strasse"), ("Nguyễn Văn", "nguyen-van"), ("İpek Çağ", "ipek-cag"), ("1,000 µ", "1000"), ("東京 x", "x"),
])
def test_slugs_are_spelled_in_ascii(one, name, want):
    assert one(text.slug, name) == want


def test_every_format_has_the_shape_of_its_strings(spark):
    row = spark.range(1).select(*(dates._shape(F.date_format(F.lit("2003-11-25 04:05:06").cast("timestamp"), p)).alias(f"c{i}") for i, (p, _) in enumerate(dates.FORMATS))).first()
    assert list(row) == [dates._shape_of(p) for p, _ in dates.FORMATS]


def test_page_folders(spark, tmp_path):
    for name in ("msg2.html", "msg10.html", "index.html", "msgx.html", "note.txt"):
        (tmp_path / name).write_text("<html><body>x</body></html>")
    assert sorted(r.name for r in archive.pages(spark, str(tmp_path)).collect()) == ["index.html", "msg10.html", "msg2.html", "msgx.html"]
    numbers = [r.message_number for r in archive.numbered_pages(spark, str(tmp_path)).orderBy("message_number").collect()]
    assert numbers == [None, 2, 10]
    pages = archive.numbered_pages(spark, str(tmp_path)).where("message_number > 0")
    with pytest.raises(RuntimeError, match="no page gave a message"):
        html.require_rows(html.live_messages(pages), pages)
    assert html.require_rows(html.live_messages(pages.limit(0)), pages.limit(0)).count() == 0


def test_json_maps_keep_one_of_equal_keys(spark, tmp_path):
    df = spark.createDataFrame([("a", "2"), ("a", "1"), ('q"', "x\\y"), (None, "z")], "k string, v string")
    archive.json_map(df, "k", "v").write.text(f"{tmp_path}/m")
    assert {tuple(r) for r in archive.overrides(spark, f"{tmp_path}/m").collect()} == {("a", "1"), ('q"', "x\\y")}
