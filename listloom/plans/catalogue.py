"""Named queries over the driver's tables. `messages` makes a message table of orders; its SQL is the oracles' too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, dates, names, quoting, text
from ..operators import dedup, search, threads, views
from ..operators.search_index import SearchIndex
from ..scratch import new_folder
from ..sources import archive, html
from ..streaming import incremental, sessions
from ..streaming.thread_store import ThreadStore, thread_stream
from ..streaming.thread_store import page_stream as stream_of_pages
from .enrich import by_date, enriched, unswapped

PAGE = """case when o.o_orderkey % 4 in (2, 3) then concat('http://x.example/p', cast(o.o_orderkey % 4 as varchar(5)), '/', cast(o.o_custkey % 400 as varchar(20)), '-', cast(cast(o.o_orderdate as date) as varchar(20)))
  else concat('http://x.example/m', cast(o.o_orderkey as varchar(20))) end"""
MESSAGES_SQL = f"""select o.o_orderkey as message_number,
  case when o.o_orderkey % 97 = 0 then cast(null as timestamp) else cast(o.o_orderdate as timestamp) end as date,
  case when o.o_orderkey % 101 = 0 then cast(null as varchar(40)) else concat('User ', cast(o.o_custkey % 40 as varchar(20))) end as from_name,
  concat(case o.o_orderkey % 7 when 0 then 'Re: ' when 1 then 'RE: Fwd: ' when 2 then '[list] ' when 3 then 'Re: [list] ' else '' end,
    case when o.o_orderkey % 53 = 0 then '' else concat('Topic ', cast(o.o_custkey % 400 as varchar(20)),
      case o.o_custkey % 9 when 0 then ' workshop' when 1 then ' postdoc position' when 2 then ' released' when 3 then ' unsubscribe' else '' end) end) as subject,
  case when o.o_orderkey % 103 = 0 then cast(null as varchar(200)) else concat('Order note ', o.o_orderpriority, ' ', cast(o.o_custkey % 400 as varchar(20))) end as body_clean,
  case o.o_orderkey % 4 when 0 then 'live' when 1 then 'pipermail' when 2 then 'legacy' else 'topic' end as source,
  {PAGE} as source_url,
  case when o.o_orderkey % 11 <> 0 then cast(floor(o.o_orderkey / 3.0) as bigint) else cast(null as bigint) end as in_reply_to_number
from {{orders}} o"""
DATE_STRINGS_SQL = """select o_orderkey as id, case o_orderkey % 8
  when 0 then concat('Thu, ', {d}) when 1 then concat('Date: ', {d}, ' (PST)') when 2 then concat({d}, ' EST') when 3 then {us}
  when 4 then concat({us}, ' 14:45 PM') when 5 then {iso} when 6 then 'no date' else concat({us2}, ', Time:15:51:31') end as raw from {orders}"""

BY_TASKS = ("mapreduce.fileoutputcommitter.algorithm.version", "2")  # tasks put their files in place, not the driver one by one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.sql(MESSAGES_SQL, orders=table(spark, sf_dir, "orders"))
    return m.withColumns({"category": classify.category(F.col("subject")), "thread_id": F.lit(None).cast("long")})


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _day(*columns: str) -> dict:
    return {c: F.date_format(c, "yyyy-MM-dd") for c in columns}


def monthly_volume(spark, sf_dir):
    return views.monthly_volume(messages(spark, sf_dir))


def event_volume(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("date"), F.col("event_type").alias("category"))
    return views.monthly_volume(e)


def thread_summary(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("thread_key", text.group_key(F.col("subject")))
    return views.thread_summary(m, "thread_key").withColumns(_day("first_date", "last_date"))


def top_contributors(spark, sf_dir):
    return views.top_contributors(messages(spark, sf_dir))


def technical_only(spark, sf_dir):
    return views.only(messages(spark, sf_dir)).select("message_number", "subject")


def year_category_pivot(spark, sf_dir):
    return _long(views.year_by_category(messages(spark, sf_dir)), "year", *classify.CATEGORIES)


def source_totals(spark, sf_dir):
    return views.source_totals(messages(spark, sf_dir))


def totals(spark, sf_dir):
    return _long(views.totals(messages(spark, sf_dir)), "first_year", "last_year")


def month_counts(spark, sf_dir):
    return _long(views.months(messages(spark, sf_dir)), "year", "month")


def category_counts(spark, sf_dir):
    return views.counts(messages(spark, sf_dir), "source", "category")


def author_index(spark, sf_dir):
    return _long(views.author_index(messages(spark, sf_dir)), "first_year", "last_year")


def author_timeline(spark, sf_dir):
    return views.author_timeline(messages(spark, sf_dir))


def subject_keys(spark, sf_dir):
    s = F.col("subject")
    return messages(spark, sf_dir).select(
        "message_number", text.merge_key(s).alias("merge_key"), text.group_key(s).alias("group_key"), text.display_subject(s).alias("display_subject"),
        text.display_thread_subject(s).alias("thread_subject"), text.is_reply(s).alias("is_reply"),
    )


def message_classes(spark, sf_dir):
    s = F.col("p_name")
    some = table(spark, sf_dir, "part").select("p_partkey", F.concat(s, F.element_at(F.array(*map(F.lit, TRIGGERS)), (F.col("p_partkey") % len(TRIGGERS) + 1).cast("int"))).alias("p_name"))
    return some.select("p_partkey", classify.category(s, classify.WHEN_PARSED).alias("parsed"), classify.category(s).alias("built"))


# One subject ending for each rule of both tables, and some for none.
TRIGGERS = ("", " hiring", " course", " version 3", " unsubscribe", " PAGE 2019", " meeting in 2004", " postdoc", " R package", " job", " looking for a scientist", " passed away", " virus", " release", " fellowship at")


def body_signatures(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.body_signature(F.col("text")).alias("signature"))


def stripped_disclaimers(spark, sf_dir):
    ending = F.when(F.col("doc_id") % 3 == 0, F.lit("\nThis e-mail may contain confidential matter.\nBye")).when(F.col("doc_id") % 3 == 1, F.lit("\n------------  ")).otherwise("")
    d = table(spark, sf_dir, "documents").select("doc_id", text.without_disclaimers(F.concat("text", ending)).alias("body"))
    return d.select("doc_id", F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("n"))


def email_hashes(spark, sf_dir):
    address = F.when(F.col("c_custkey") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), "c_name", F.lit("@X.example ")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.email_hash(address).alias("hash"))


def swapped_fields(spark, sf_dir):
    m = messages(spark, sf_dir)
    odd = F.col("message_number") % 5 == 0
    m = m.withColumns({"from_name": F.when(odd, F.concat(F.lit("Re: "), F.col("source"))).otherwise(F.col("from_name"))})
    return unswapped(m).select("message_number", "from_name", "subject")


def source_urls(spark, sf_dir):
    m = messages(spark, sf_dir)
    files = m.withColumns({"source_file": F.concat_ws("_", F.lit("2006-May"), F.col("message_number").cast("string"), F.lit("a.html")), "source_url": F.when(F.col("message_number") % 2 == 0, F.col("source_url"))})
    parts = [archive.shaped(files.where(F.col("source") == k), k, archive.page_url(k, "http://a.example/")) for k in ("live", "pipermail", "legacy", "topic")]
    return archive.merged(parts).select("message_number", "source", "source_url")


def union_sources(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    live = archive.shaped(c.where("turn = 0").select(F.col("conv_id").alias("thread_id"), F.col("role").alias("from_name"), F.col("text").alias("body_clean")), "live")
    legacy = archive.shaped(c.where("turn > 0").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("message_number"), F.col("role").alias("from_name")), "legacy")
    return archive.merged([live, legacy]).select("thread_id", "message_number", "from_name", "source", F.md5("body_clean").alias("body_md5"))


def dedup_priority(spark, sf_dir):
    return dedup.resolved(messages(spark, sf_dir)).select("message_number", "source", "source_url", "subject", "from_name")


def newest_snapshot(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"), "event_id")
    return dedup.newest(e, "url", tie="event_id")


def message_sequence(spark, sf_dir):
    m = views.numbered(messages(spark, sf_dir), by_date())
    return _long(m.withColumn("url", views.message_url()), "year", "month").select("message_number", "year", "month", "msg_seq", "url")


def gap_threads(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("thread_key", text.group_key(F.col("subject")))
    return threads.split_at_gaps(m, "thread_key", by_date()).select("message_number", "thread_key")


def keyed_threads(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("thread_key", threads.thread_key()).select("message_number", "thread_key")


def _displayed(spark, sf_dir):
    m = views.numbered(messages(spark, sf_dir).drop("category", "body_clean", "in_reply_to_number"), by_date()).withColumn("thread_key", threads.thread_key())
    shown = threads.display_threads(m.drop("thread_id", "year", "month"), by_date())
    return threads.thread_order(shown.drop("source", "source_url", "thread_key"))


def display_threads(spark, sf_dir):
    return _displayed(spark, sf_dir).select("message_number", "display_thread_key", F.col("position").cast("long").alias("position"))


def thread_meta(spark, sf_dir):
    meta = views.thread_meta(_displayed(spark, sf_dir))
    return meta.select("display_thread_key", "subject", "n_messages", "n_participants", F.date_format("last_date", "yyyy-MM-dd").alias("last_date"))


def thread_members(spark, sf_dir):
    return _long(views.thread_members(_displayed(spark, sf_dir)), "position")


def messages_with_thread(spark, sf_dir):
    found = views.with_thread(_displayed(spark, sf_dir))
    return found.select("message_number", "thread_subject", "thread_n_messages", "thread_n_participants", F.date_format("thread_last_date", "yyyy-MM-dd").alias("thread_last_date"), "has_context")


def thread_list_tops(spark, sf_dir):
    """The first page of the thread list in each of its orders."""
    meta = views.thread_meta(_displayed(spark, sf_dir))
    tops = [views.sorted_threads(meta, by).limit(20).select(F.lit(by).alias("by"), "display_thread_key", "n_messages") for by in ("recent", "count", "subject")]
    return tops[0].union(tops[1]).union(tops[2])


def author_list_tops(spark, sf_dir):
    """The first page of the author list in each of its orders."""
    index = views.author_index(messages(spark, sf_dir))
    tops = [views.sorted_authors(index, by).limit(5).select(F.lit(by).alias("by"), "author_slug", "n") for by in ("name", "name_desc", "count", "recent")]
    return tops[0].union(tops[1]).union(tops[2]).union(tops[3])


def one_thread(spark, sf_dir):
    """The messages of one reply chain."""
    return views.thread(threads.thread_roots(messages(spark, sf_dir)), 7).select("message_number", F.date_format("date", "yyyy-MM-dd").alias("date"))


def archive_span(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("thread_key", text.group_key(F.col("subject")))
    return views.span(m).withColumns(_day("first_date", "last_date"))


def enriched_messages(spark, sf_dir):
    found = enriched(messages(spark, sf_dir), decode=False)
    return found.select("message_number", "from_name", "author_slug", "subject", "category", "thread_key", "msg_seq", "url", "display_thread_key")


def thread_root(spark, sf_dir):
    return threads.thread_roots(messages(spark, sf_dir)).select("message_number", "thread_id")


def reply_depth(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("thread_key", (F.col("message_number") % 2).cast("string"))
    return threads.reply_depths(m).select("message_number", "depth")


def month_threads(spark, sf_dir):
    m = views.numbered(messages(spark, sf_dir), by_date()).withColumn("thread_key", text.group_key(F.col("subject")))
    return _long(views.month_threads(m), "position", "thread_place").select("message_number", "position", "is_reply", "thread_place")


def previous_next(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("url", F.concat(F.lit("/m/"), F.col("message_number").cast("string")))
    return views.with_neighbours(m).select("message_number", "previous_url", "next_url")


def recent_30(spark, sf_dir):
    return views.recent(messages(spark, sf_dir)).select("message_number", F.date_format("date", "yyyy-MM-dd").alias("date"))


def date_formats(spark, sf_dir):
    forms = {"d": "date_format(o_orderdate, 'd MMM yyyy HH:mm:ss')", "us": "date_format(o_orderdate, 'MM/dd/yyyy')", "us2": "date_format(o_orderdate, 'MM/dd/yy')", "iso": "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")"}
    raw = spark.sql(DATE_STRINGS_SQL.format(orders="{orders}", **forms), orders=table(spark, sf_dir, "orders"))
    return raw.select("id", F.date_format(dates.flexible_date(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("date"))


NAMES = ("(Ann Example)", "Example, Ann", "Ann.Example", "A. Example", "Dr. ANN EXAMPLE", "ann van example [org]", "Re: topic", "Ann Example /ORG", "Ann Example 555-123-4567", "a", "Ann {X~Y} Example", "Unknown")
NORMAL = ("Ann Example", "Ann Example", "Ann Example", "A. Example", "Ann Example", "Ann van Example", "Unknown", "Ann Example", "Ann Example", "Unknown", "Ann Example", "Unknown")


def author_normalize(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("c_custkey") % len(NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", names.normalized_author(raw, decode=False).alias("author"))


def author_override(spark, sf_dir):
    aliases = spark.createDataFrame([("User 1", "Ann Example"), ("User 2", "Ben Example")], "alias string, canonical string")
    return names.overridden(messages(spark, sf_dir), aliases, decode=False).select("message_number", "from_name")


def names_from_addresses(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("john.DOE_"), F.col("c_custkey").cast("string"), F.lit("@x.example"))).when(F.col("c_custkey") % 3 == 1, F.lit("[email protected]")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.name_from_address(raw).alias("name"))


def reply_split(spark, sf_dir):
    mark = F.when(F.col("turn") % 2 == 0, F.lit("\n-----Original Message-----\n")).otherwise(F.lit("\nOn Monday A wrote:\n"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("x😀é😀 "), F.regexp_replace("text", r"\s+", " "), mark, F.lit("> 😀 old")).alias("body"))
    split = quoting.reply_split(F.col("body"), F.when(F.col("turn") % 3 == 0, F.lit("legacy")).otherwise(F.lit("live")))
    return c.select("conv_id", "turn", split.alias("s")).select("conv_id", "turn", F.md5("s.main").alias("main_md5"), "s.quoted")


def clean_bodies(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", quoting.clean_body(F.col("html")).alias("body"))


def page_extract(spark, sf_dir):
    p = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", html.title(p).alias("title"), html.heading(p).alias("heading"), html.plain_text(p).alias("text"), html.decoded(F.encode(p, "UTF-8")).alias("decoded"))


def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("link"))


def _page(*parts: str) -> F.Column:
    """Page bytes of literal text and columns (names in braces)."""
    return F.encode(F.concat(*(F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in parts)), "UTF-8")


def _customers(spark, sf_dir):
    """Customers with a day of a month in text, dealt to many tasks."""
    return html.spread(table(spark, sf_dir, "customer"), "c_custkey").withColumn("day", (F.col("c_custkey") % 28 + 1).cast("string"))


def live_pages(spark, sf_dir):
    page = _page(
        '<html><body><h1><span class="subject"><span itemprop="name">Re: ', "{c_mktsegment}", '</span></span></h1><div class="msgHead"><span class="sender"><span itemprop="name">', "{c_name}",
        '</span></span><span class="date"><a href="x">Thu, ', "{day}", ' Mar 2026 10:20:38 -0700</a></span></div><div class="msgBody"><div>one <div>two</div> <tt>a\n b</tt><br><tt>', "{c_nationkey}",
        "</tt></div><p>é 😀 &amp; more</p><blockquote><div>quoted</div><blockquote>deeper<pre>as  it\n  is</pre></blockquote></blockquote><pre> x  y\n  z</pre><table><tr><td>cell</td></tr></table>X-Body-of-Message</div>",
        '<form><input name="msgid" value="m', "{c_custkey}", '"></form></body></html>',
    )
    found = html.live_messages(_customers(spark, sf_dir).select(F.col("c_custkey").alias("message_number"), page.alias("content")))
    return found.select("message_number", "message_id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "from_name", "subject", "category", "body_raw")


def legacy_pages(spark, sf_dir):
    page = _page(
        "<html><head><title>Page</title></head><body>Page<br><br>From: ", "{c_name}", " &lt;a@x.example&gt;<br>  Subject: dosing of ", "{c_mktsegment}", "<br>Date: Fri, ", "{day}",
        " Jan 1999 10:20:38 -0500<br><br><br>The first body has 50 characters and more, for shorter ones are no messages.<br>  indented<br>___________<br>Subject: Re: dosing<br>From: Ben Example<br>Date: ", "{day}",
        " Feb 1999<br><br>A second body, of ", "{c_nationkey}", " and a number of other words, long enough.</body></html>",
    )
    found = html.legacy_messages(_customers(spark, sf_dir).select(F.concat("c_custkey", F.lit(".html")).alias("name"), page.alias("content")))
    return found.select("source_file", F.col("place").cast("long").alias("place"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "from_name", "subject", "category", "body_raw")


def monthly_pages(spark, sf_dir):
    page = _page(
        '<html><head><title>Re: ', "{c_mktsegment}", '</title><meta name="Created" content="2006-05-', "{two}", 'T10:20:38"><meta name="Author" content="', "{c_name}",
        '"></head><body><div class="mail"><address>gone</address><map><a>gone</a></map><div>one<br>\ntwo ', "{c_nationkey}", '</div><p>three</p><p>four</p><div>five <dfn>gone</dfn></div>\n\n\n\n<span id="received">gone</span>six</div>after</body></html>',
    )
    c = _customers(spark, sf_dir).withColumn("two", F.lpad("day", 2, "0"))
    found = html.pipermail_messages(c.select(F.concat(F.lit("2006-May_"), "c_custkey", F.lit(".html")).alias("name"), page.alias("content")))
    return found.select("source_file", "archive_month", "archive_id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "from_name", "subject", "category", "body_raw")


def topic_pages(spark, sf_dir):
    page = _page(
        "<html><body><h1>On ", "{c_mktsegment}", "</h1><pre>\nQuestion started by ", "{c_name}", " - ", "{day}", " Nov 1993\n\nThe question.\n\nReply by: Ben Example (b@x.example)\n\nAn answer of ", "{c_nationkey}",
        ".\n\nMemo from Cleo Example\n\nA memo.\n\nResponse by D Example\n\nOne more.\n\nEnd of topic\nReply by Nobody\n\nnothing</pre></body></html>",
    )
    imputed = spark.createDataFrame([("7.html", 1, None, "16 Feb 1994"), ("8.html", None, None, "6 Apr 1994"), ("9.html", None, "memo from", "15 Mar 1994")], "name string, place int, prefix string, date_raw string")
    found = html.topic_messages(_customers(spark, sf_dir).select(F.concat("c_custkey", F.lit(".html")).alias("name"), page.alias("content")), imputed)
    return found.select("source_file", F.col("place").cast("long").alias("place"), F.date_format("date", "yyyy-MM-dd").alias("date"), "from_name", "subject", "body_raw")


def index_pages(spark, sf_dir):
    """The newest number that an index page links to, and local names of snapshots."""
    c = _customers(spark, sf_dir)
    page = F.concat(F.lit('<a href="msg00012.html">x</a> <a href="msg'), "c_custkey", F.lit('.html">y</a> <a href="other99999.html">z</a><a href="msgx.html">w</a>'))
    url = F.concat(F.lit("http://a.example/list/"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("2006-May/"), F.col("c_custkey"))).otherwise(F.concat(F.lit("99apr"), "c_custkey")), F.lit(".html"))
    named = {f"{k}_name": archive.local_name(url, k) for k in ("pipermail", "legacy", "topic")}
    return c.select("c_custkey", html.newest_listed(page).alias("newest"), *(x.alias(k) for k, x in named.items()))


def mime_names(spark, sf_dir):
    raw = F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(F.concat(F.lit("Jürgen "), "c_name"), "UTF-8")), F.lit("?="))
    return table(spark, sf_dir, "customer").select("c_custkey", names.decoded_word(raw).alias("name"))


def quoted_printable_bodies(spark, sf_dir):
    raw = F.concat(F.lit("caf=C3=A9 =3D "), "c_name", F.lit("=\n and=\n more"))
    return table(spark, sf_dir, "customer").select("c_custkey", html.mail_body(raw).alias("body"))


def _searched(spark, sf_dir):
    return messages(spark, sf_dir).select("message_number", "subject", "from_name", "category")


def search_terms(spark, sf_dir):
    return search.inverted_index(_searched(spark, sf_dir), "message_number")


def search_top50(spark, sf_dir):
    return search.top(search.hits(_searched(spark, sf_dir), "topic 17 wokshop", "message_number", category="event"), "message_number")


def search_results(spark, sf_dir):
    """The 50 best documents as they are listed."""
    docs = _documents(spark, sf_dir)
    found = search.top(search.hits(docs, "topic 17 wokshop", "url", category="event"), "url")
    return search.shown(found, docs, search.snippets(docs))


def search_hit_count(spark, sf_dir):
    return search.hits(_searched(spark, sf_dir), "postdok", "message_number").agg(F.count("*").alias("n_hits"))


def _stored_index(spark, sf_dir):
    """An index written in two arrivals."""
    docs, index = _searched(spark, sf_dir), SearchIndex(spark, new_folder(spark, "search"))
    return index.append(docs.where("message_number % 4 <> 0"), "message_number").append(docs.where("message_number % 4 = 0"), "message_number")


def stored_search(spark, sf_dir):
    """The 50 best of several queries to one written index."""
    index, asked = _stored_index(spark, sf_dir), (("topic 17 wokshop", "event"), ("postdok", None), ("user 7", None))
    found = [search.top(index.hits(q, category=c), "key").select(F.lit(q).alias("query"), F.col("key").alias("message_number"), "score") for q, c in asked]
    return reduce(DataFrame.union, found)


def stored_search_counts(spark, sf_dir):
    index = _stored_index(spark, sf_dir)
    return reduce(DataFrame.union, [index.hits(q).agg(F.lit(q).alias("query"), F.count("*").alias("n_hits")) for q in ("postdok", "realeased", "zzzzzz", "to")])


def incremental_upsert(spark, sf_dir):
    m = messages(spark, sf_dir)
    return incremental.upserted(threads.thread_roots(m.where("message_number % 3 <> 0")), m.where("message_number % 5 <> 1 OR message_number % 3 = 0")).select("message_number", "thread_id", "subject")


def incremental_threads(spark, sf_dir):
    """Threads after four batches, in which parents often come after their replies."""
    m, store = messages(spark, sf_dir).drop("category"), ThreadStore(spark, new_folder(spark, "threads"))
    for part in (3, 0, 2, 1):
        store.add(m.where(F.col("message_number") % 4 == part))
    return store.messages().select("message_number", "thread_id")


def page_stream(spark, sf_dir):
    """Page files read by two runs of one stream: what each message is, its thread, and which run read it."""
    s, folder = html.spread(table(spark, sf_dir, "supplier"), "s_suppkey"), new_folder(spark, "pages")
    page = F.concat(
        F.lit('<html><body><h1><span class="subject"><span itemprop="name">Re: '), "s_nationkey", F.lit('</span></span></h1><div class="msgHead"><span class="sender"><span itemprop="name">'), "s_name",
        F.lit('</span></span></div><div class="msgBody">text</div><ul><li><span class="subject"><a href="msg'), F.floor(F.col("s_suppkey") / 3), F.lit('.html">x</a></span><ul><li class="tSliceCur">this</li></ul></li></ul></body></html>'),
    )
    files = s.select("s_suppkey", F.concat(F.lit("msg"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit(".html")).alias("page"), page.alias("html"))

    def parse(batch):
        number = F.regexp_extract("path", r"msg(\d+)\.html", 1).cast("long")
        return html.live_messages(batch.select(number.alias("message_number"), "content"))

    for part in (1, 0):  # later pages are parents of earlier ones
        files.where(F.col("s_suppkey") % 2 == part).drop("s_suppkey").write.mode("append").partitionBy("page").option(*BY_TASKS).text(f"{folder}/in")
        thread_stream(stream_of_pages(spark, f"{folder}/in"), f"{folder}/store", f"{folder}/checkpoint", parse).awaitTermination()
    return ThreadStore(spark, f"{folder}/store").messages().select("message_number", "from_name", "subject", "in_reply_to_number", "thread_id", F.col("batch").cast("long").alias("batch"))


def gap_sessions_stream(spark, sf_dir):
    """Sessions of events that arrive file by file in no order, some without a time."""
    e, folder = table(spark, sf_dir, "events"), new_folder(spark, "events")
    e = e.select("event_id", "user_id", F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp")).alias("ts"))
    e.repartition(6, F.xxhash64("event_id")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", "2").parquet(f"{folder}/in")
    told = incremental.run_to_table(sessions.gap_sessions(stream, "user_id", "ts", "event_id", days=1), "sessions", "update", sessions.ROCKS)
    return sessions.latest(told, "user_id", "event_id")


def yearly_files(spark, sf_dir):
    """Messages written by year, read from the first path that exists, together with those sources that are there."""
    m, folder = messages(spark, sf_dir), new_folder(spark, "archive")
    for source in ("live", "topic"):
        archive.write_by_year(m.where(F.col("source") == source), f"{folder}/{source}")
    years = archive.first_existing(spark, f"{folder}/none", f"{folder}/live").groupBy("year").agg(F.count("*").alias("n")).select(F.lit("live by year").alias("source"), F.col("year").cast("long").alias("year"), "n")
    both = archive.load_sources(spark, {k: f"{folder}/{k}" for k in ("live", "legacy", "topic")})
    return years.union(both.groupBy("source", F.year("date").cast("long").alias("year")).agg(F.count("*").alias("n")))


def alias_file(spark, sf_dir):
    """Names replaced by a JSON object of aliases that is written and read."""
    s, folder = table(spark, sf_dir, "supplier"), new_folder(spark, "aliases")
    some = s.select("s_name", F.concat(F.lit('Firm "'), F.col("s_nationkey").cast("string"), F.lit('"')).alias("name"))
    archive.json_map(some, "s_name", "name").write.text(folder)
    found = archive.overrides(spark, folder)
    none = archive.overrides(spark, f"{folder}/none")
    return s.join(found.union(none), F.col("s_name") == F.col("alias"), "left").select("s_suppkey", "canonical")


def snapshot_manifest(spark, sf_dir):
    """Lines of an index listing and links of its pages, the newest of each URL, as a manifest that is written and read."""
    c, folder = table(spark, sf_dir, "customer"), new_folder(spark, "listing")
    stamp = F.concat(F.lit("2006"), F.lpad((F.col("c_custkey") % 12 + 1).cast("string"), 2, "0"), F.lit("01000000"))
    line = F.when(F.col("c_custkey") % 10 == 0, F.lit("malformed")).otherwise(F.concat(stamp, F.lit(" http://a.example/list/"), F.col("c_custkey") % 500, F.when(F.col("c_custkey") % 7 == 0, F.lit(".txt")).otherwise(".html")))
    c.select(line).write.text(f"{folder}/lines")
    listed = archive.index_listing(spark, f"{folder}/lines", r"\.html$")
    pages = c.select(F.concat(F.lit("https://archive.example/web/"), stamp, F.lit("/http://a.example/")).alias("url"), F.concat(F.lit('<a HREF="/new/'), F.col("c_custkey") % 300, F.lit('.html">x</a> <a href="http://a.example/list/'), F.col("c_custkey") % 500, F.lit('.html">y</a><a href="z.gif">z</a>')).alias("html"))
    links = archive.harvested_links(pages, "html", "http://a.example/", r"\.html$")
    archive.write_manifest(dedup.newest(listed.union(links), "url", tie=""), f"{folder}/manifest")
    return archive.read_manifest(spark, f"{folder}/manifest")


def feed_files(spark, sf_dir):
    """The home feed and the search documents as JSON lines, read again."""
    folder, feed, docs = new_folder(spark, "feeds"), views.home_feed(messages(spark, sf_dir)), _documents(spark, sf_dir)
    archive.write_json(feed, f"{folder}/feed")
    archive.write_json(docs, f"{folder}/docs")
    feed, docs = (spark.read.schema(x.schema).json(f"{folder}/{k}") for k, x in (("feed", feed), ("docs", docs)))
    return feed.groupBy(F.lit("feed").alias("file"), F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n")).union(docs.groupBy(F.lit("docs"), F.col("year").cast("long")).agg(F.count("*")))


def clustered_threads(spark, sf_dir):
    """Messages and their threads from two tables in buckets of the thread, joined and counted without an exchange."""
    m, folder = messages(spark, sf_dir).select("message_number", "date", text.group_key(F.col("subject")).alias("thread")), new_folder(spark, "clustered")
    names = [f"listloom_{x}_{folder.rsplit('-', 1)[1]}" for x in ("messages", "threads")]
    archive.write_clustered(m, names[0], "thread", 8, f"{folder}/messages")
    archive.write_clustered(m.groupBy("thread").agg(F.min("date").alias("first")), names[1], "thread", 8, f"{folder}/threads")
    late = F.count_if(F.col("date") > F.date_add("first", 365))
    return spark.table(names[0]).join(spark.table(names[1]).hint("merge"), "thread").groupBy("thread").agg(F.count("*").alias("n"), late.alias("n_late"))


def number_from_footers(spark, sf_dir):
    """The next number after those of a written archive, from its footers."""
    folder = new_folder(spark, "numbers")
    messages(spark, sf_dir).select("message_number").write.parquet(folder)
    return spark.range(1).select(F.lit((archive.greatest(spark, folder) or 0) + 1).cast("long").alias("next_number"))


FOREIGN = ("Жанна Щукина", "Ελένη Ψαρρού", "Łukasz Żółć", "Đặng Thùy", "Юлія Їжак", "plain")


def transliterated_slugs(spark, sf_dir):
    name = F.concat(F.element_at(F.array(*map(F.lit, FOREIGN)), (F.col("c_custkey") % len(FOREIGN) + 1).cast("int")), F.lit(" "), F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.slug(name).alias("slug"))


def quoted_blocks(spark, sf_dir):
    """Replies over wrapped header blocks in several languages, and over dated quotes; near misses stay whole."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[\s>@<:]+", " ").alias("text"))
    blocks = (
        "From: Ann\nExample <a@x.example>\nSent: Monday\nTo: B\nSubject: x\n\nold", "Van: Ann\nVerzonden: maandag\nAan: B\nOnderwerp: x\n\nold", "De : Ann\nEnvoyé : lundi\nÀ : B\nObjet : x\n\nold",
        "2020-01-02 10:00 GMT Ann\n<a@x.example>\n> one\n> two\n> three", "From: Ann\nTo: B\n\nno block", "12 May 2020\n> one\n> two",
    )
    block = F.element_at(F.array(*map(F.lit, blocks)), (F.col("conv_id") % len(blocks) + 1).cast("int"))
    split = quoting.reply_split(F.concat(F.lit("new "), "text", F.lit(" end\n\n"), block), F.lit("live"))
    return c.select("conv_id", "turn", split.alias("s")).select("conv_id", "turn", F.md5("s.main").alias("main_md5"), "s.quoted")


def daily_volume_stream(spark, sf_dir):
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table may be one file
    out = incremental.run_to_table(incremental.volume(stream.withColumn("ts", F.col("ts").cast("timestamp"))), "listloom_daily_volume")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def subjects_containing(spark, sf_dir):
    return views.containing(messages(spark, sf_dir), "subject", "WORKSHOP").select("message_number")


def fetch_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select((F.col("event_id") % 10).alias("batch"), F.element_at(F.array(*map(F.lit, ("downloaded", "cached", "not_found", "error"))), (F.col("user_id") % 4 + 1).cast("int")).alias("status"))
    return views.running_status(log)


def page_subjects(spark, sf_dir):
    return views.page_subjects(messages(spark, sf_dir))


def years(spark, sf_dir):
    return _long(views.years(messages(spark, sf_dir)), "year")


def home_feed(spark, sf_dir):
    return _long(views.home_feed(messages(spark, sf_dir)), "year")


def _documents(spark, sf_dir):
    m = views.numbered(messages(spark, sf_dir), by_date()).withColumn("url", views.message_url())
    return search.search_documents(m)


def search_documents(spark, sf_dir):
    return _long(_documents(spark, sf_dir), "year")


def search_snippets(spark, sf_dir):
    return search.snippets(_documents(spark, sf_dir))


def thread_urls(spark, sf_dir):
    m = views.numbered(messages(spark, sf_dir), by_date())
    return m.select("message_number", views.thread_url().alias("url"), F.when(views.is_current(1995, 1, 3), F.lit("current")).alias("marker"), views.thousands(F.col("message_number")).alias("shown"), views.source_label({"live": "Mail archive", "topic": "Topics"}).alias("label"))


def event_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("date"), F.col("user_id").cast("string").alias("key"))
    return threads.split_at_gaps(e, "key", [F.col("date"), F.col("event_id")], days=1).select("event_id", "key")


def next_number(spark, sf_dir):
    return views.next_number(messages(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        monthly_volume, event_volume, thread_summary, top_contributors, technical_only, year_category_pivot, source_totals, totals,
        month_counts, category_counts, author_index, author_timeline, subject_keys, message_classes, body_signatures,
        stripped_disclaimers, email_hashes, swapped_fields, source_urls, union_sources, dedup_priority, newest_snapshot,
        message_sequence, gap_threads, keyed_threads, display_threads, thread_meta, thread_root, reply_depth, month_threads,
        previous_next, recent_30, date_formats, author_normalize, author_override, names_from_addresses, reply_split,
        clean_bodies, page_extract, page_links, mime_names, quoted_printable_bodies, search_terms, search_top50,
        search_hit_count, incremental_upsert, daily_volume_stream, subjects_containing, fetch_status, page_subjects,
        years, home_feed, search_documents, search_snippets, thread_urls, event_gaps, next_number, thread_members,
        messages_with_thread, thread_list_tops, author_list_tops, one_thread, archive_span, enriched_messages,
        stored_search, stored_search_counts, incremental_threads, page_stream, gap_sessions_stream,
        yearly_files, alias_file, snapshot_manifest, feed_files, clustered_threads, number_from_footers, transliterated_slugs, quoted_blocks, search_results, live_pages, legacy_pages, monthly_pages, topic_pages, index_pages,
    )
}
