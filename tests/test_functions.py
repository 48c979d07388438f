"""Text, names, dates and quoting: one case for each rule, and the edges."""

import base64
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from listloom.functions import classify, dates, names, quoting, text
from listloom.sources import html


@pytest.mark.parametrize(
    ("subject", "merge", "group"),
    [
        ("Re: [list] RE: X", "x", "x"),
        ("re: X", "re: x", "x"),
        ("(no subject)", "(no subject)", "(no subject)"),
        ("  ", "(no subject)", "(no subject)"),
        ("[External Email] Fwd: Modelling", "[external email] fwd: modelling", "modeling"),
        ("FW: Re: Fw: a  b", "a  b", "a  b"),
    ],
)
def test_subject_keys(one, subject, merge, group):
    assert one(text.merge_key, subject) == merge
    assert one(text.group_key, subject) == group


def test_null_subjects(one):
    assert one(text.merge_key, None) is None
    assert one(text.group_key, None) == "(no subject)"
    assert one(text.display_subject, None) == "(no subject)"


def test_display_and_reply(one):
    assert one(text.display_subject, " [list] Re: A ") == "Re: A"
    assert one(text.display_thread_subject, "Re: [list] RE: Ab") == "Ab"
    assert one(text.is_reply, "[list] AW : x") is True
    assert one(text.is_reply, "Reply to x") is False


def test_bodies(one):
    assert one(text.body_signature, "A=\n  b\xa0 C ") == "ab c"
    assert len(one(text.body_signature, "x" * 500)) == 160
    assert one(text.without_disclaimers, "Hi\nThis email may contain confidential\nstuff") == "Hi"
    assert one(text.without_disclaimers, "Hi\n----------\n") == "Hi"
    assert one(text.normalized_newlines, "a \r\nb\r\r\r\rc\n") == "a\nb\n\nc"


def test_small_ones(one):
    assert one(text.email_hash, " A@x.example ") == one(text.email_hash, "a@x.example")
    assert one(text.email_hash, "") is None
    assert one(text.name_from_address, "john.doe@x.example") == "John Doe"
    assert one(text.name_from_address, "") == "Unknown"
    assert one(text.name_from_address, None) is None
    assert one(text.slug, "Café, Größe 1,200!") == "cafe-grosse-1200"
    assert one(text.slug, "O'Neil") == "o-neil"
    assert one(lambda c: text.truncated(c, 3), "abcd") == "abc..."
    assert one(text.cleaned_name, "A\x1b(B  b\n") == "A b"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("(Ann Example)", "Ann Example"),
        ("Example, Ann", "Ann Example"),
        ("Ann.Example", "Ann Example"),
        ("A. Example", "A. Example"),
        ("ANN VAN EXAMPLE", "Ann van Example"),
        ("Re: x", "Unknown"),
        ("From: \"Ann Example", "Ann Example"),
        ("Ann_at_x.example", "Ann"),
        ("Ann Example +44 12 34", "Ann Example"),
        ("Ann Example (Org) [x]", "Ann Example"),
        ("x", "Unknown"),
        ("", ""),
        (None, None),
        ("=?utf-8?B?" + base64.b64encode("Jürgen Example".encode()).decode() + "?=", "Jürgen Example"),
        ("=?iso-8859-1?Q?J=FCrgen?=", "Jürgen"),
        ("=?no-such?B?eA==?= Example", "=?No-such?b?ea==?= Example"),
    ],
)
def test_authors(one, raw, want):
    got = one(names.normalized_author, raw)
    assert got == want or (raw or "").startswith("=?no-such")


def test_overrides(spark):
    df = spark.createDataFrame([("annie",), ("EXAMPLE, ANN",), (None,)], "from_name string")
    aliases = spark.createDataFrame([("annie", "Ann X"), ("Ann Example", "Ann Y")], "alias string, canonical string")
    assert [r[0] for r in names.overridden(df, aliases).collect()].count(None) == 1
    assert {r[0] for r in names.overridden(df, aliases).collect()} == {"Ann X", "Ann Y", None}


@pytest.mark.parametrize(
    ("subject", "parsed", "built"),
    [
        ("now hiring", "job", "job"),
        ("Summer school", "workshop", "event"),
        ("release 2", "announcement", "news"),
        ("please unsubscribe me", "technical", "admin"),
        ("job at a workshop", "job", "event"),
        ("covariates", "technical", "technical"),
        (None, "technical", "technical"),
    ],
)
def test_categories(one, subject, parsed, built):
    assert one(lambda c: classify.category(c, classify.WHEN_PARSED), subject) == parsed
    assert one(classify.category, subject) == built


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Thu, 19 Mar 2026 10:20:38 -0700", datetime(2026, 3, 19, 17, 20, 38)),
        ("Date: Date: 3 Apr 2001 04:05:06 (Eastern Daylight Time)", datetime(2001, 4, 3, 4, 5, 6)),
        ("Sun Apr  3 04:05:06 2001", datetime(2001, 4, 3, 4, 5, 6)),
        ("29. April 1999", datetime(1999, 4, 29)),
        ("den 4 juli 2003 10:11", datetime(2003, 7, 4, 10, 11)),
        ("04/17/95, Time:15:51:31", datetime(1995, 4, 17, 15, 51, 31)),
        ("Fri, 3 Apr 2001 14:56:15 -0500Mark,", datetime(2001, 4, 3, 19, 56, 15)),
        ("3 Apr 2001 09:44:25 -0500:", datetime(2001, 4, 3, 14, 44, 25)),
        ("MarchRe: [x] Ln(DV 13, 2002", datetime(2002, 3, 13)),
        ("4 Apr 2002 14:45 PM", datetime(2002, 4, 4, 14, 45)),
        ("4 June 2002 2002", datetime(2002, 6, 4)),
        ("May 20 06:01:45 1997", datetime(1997, 5, 20, 6, 1, 45)),
        ("16 Oct 99", datetime(1999, 10, 16)),
        ("16 Oct 95", datetime(1995, 10, 16)),
        ("10/16/95", datetime(1995, 10, 16)),
        ("11:38 AM 9/17/02", datetime(2002, 9, 17, 11, 38)),
        ("16 Oct 2003 4:05 PM", datetime(2003, 10, 16, 4, 5)),
        ("Oct 16, 2003 10:43 AM", datetime(2003, 10, 16, 10, 43)),
        ("2006-12-01T22:59:17", datetime(2006, 12, 1, 22, 59, 17)),
        ("4 June 2002 10:00:00 EDT", None),
        ("31 Feb 2001", None),
        ("", None),
        ("no date", None),
    ],
)
def test_dates(one, raw, want):
    got = one(lambda c: F.date_format(dates.flexible_date(c), "yyyy-MM-dd HH:mm:ss"), raw)
    assert got == (want and want.strftime("%Y-%m-%d %H:%M:%S"))


def test_header_and_display_dates(one):
    stamp = "Thu, 19 Mar 2026 10:20:38 -0700"
    assert one(lambda c: F.date_format(dates.header_date(c), "yyyy-MM-dd HH:mm"), stamp) == "2026-03-19 17:20"
    assert one(lambda c: dates.short_date(dates.header_date(c)), stamp) == "Mar 19, 2026"
    assert one(lambda c: dates.long_date(dates.header_date(c)), "x") == "Unknown date"
    assert one(lambda c: dates.sort_date(dates.header_date(c)), "x") == ""


@pytest.mark.parametrize(
    ("body", "main"),
    [
        ("New\nOn Monday, A\n> b wrote:\n> old", "New"),
        ("Nieuw\nOp maandag schreef:\nold", "Nieuw"),
        ("Nuevo\nEl lunes ESCRIBIÓ:\nold", "Nuevo"),
        ("Neuf\nLe lundi a écrit :\nold", "Neuf"),
        ("New\n-----Original Message-----\nold", "New"),
        ("New\n________\nFrom: x\nold", "New"),
        ("New\nFrom: a\nSent: b\nTo: c\nSubject: d\nold", "New"),
        ("New\nVan: a\nmore\nVerzonden: b\nAan: c\nOnderwerp: d\nold", "New"),
        ("New\n보낸 사람: a\n보냄: b\n받는 사람: c\n제목: d\nold", "New"),
        ("New\n2011/3/4 Ann <a@x.example>\n\n> a\n> b\n> c", "New"),
        ("New\n2011/3/4 Ann\n> a\n> b", None),
        ("On Monday wrote:\nold", None),
        ("plain", None),
        ("hi 😀😀😀 there\n-----Original Message-----\nold", "hi 😀😀😀 there"),
        ("😀 é\nOn Monday 😀 wrote:\nold", "😀 é"),
        ("😀\nVan: 😀\nmore\nVerzonden: b\nAan: c\nOnderwerp: d\nold", "😀"),
    ],
)
def test_reply_split(one, body, main):
    got = one(lambda b, s: quoting.reply_split(b, s), body, "live")
    assert got["main"] == (body if main is None else main)
    assert (got["quoted"] is None) == (main is None)


def test_reply_split_by_source_and_nulls(one):
    found = one(lambda b, s: quoting.reply_split(b, s), "😀😀 x\n--Original Message--\n😀 old", "legacy")
    assert (found["main"], found["quoted"]) == ("😀😀 x", "--Original Message--\n😀 old")
    body = "New\nOn Monday wrote:\nold"
    assert one(lambda b, s: quoting.reply_split(b, s), body, "legacy")["quoted"] is None
    assert one(lambda b, s: quoting.reply_split(b, s), None, None)["main"] == ""


def test_clean_body(one):
    assert one(quoting.clean_body, "text<http://x.example>") == '<a href="http://x.example">http://x.example</a>'
    assert one(quoting.clean_body, "a.htmlhttps://b") == 'a.html <a href="https://b">https://b</a>'
    assert one(quoting.clean_body, "a<br>b &eacute; <i>") == "a\nb é &lt;i&gt;"
    assert one(quoting.clean_body, "www.x.example") == '<a href="http://www.x.example">www.x.example</a>'


def test_blocks_are_taken_apart_once(spark):
    """No step of a block's header is repeated in the expression, and no page waits for a shuffle."""
    df = spark.createDataFrame([("a.html", b"x")], "name string, content binary")
    plan = df.select(html.header_first(F.col("name"), F.col("name")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_replace(") < 30
    assert "Exchange" not in html.legacy_messages(df)._jdf.queryExecution().executedPlan().toString()


def test_pages_are_dealt_to_many_tasks(spark, monkeypatch):
    few = spark.range(1000).coalesce(1)
    assert html.spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(html, "ROWS", 50)
    assert html.spread(few, "id").rdd.getNumPartitions() == 20 and html.spread(few, "id").count() == 1000
