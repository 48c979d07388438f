"""Messages from HTML pages, mostly by built-in expressions. The tree walks (reply parent here, bodies in `markup`) are
Arrow-batched functions over one page's markup."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import WHEN_PARSED, category
from ..functions.dates import flexible_date, header_date
from ..functions.quoting import unescaped
from ..functions.text import in_charset, normalized_newlines, once, trimmed, without_disclaimers
from .markup import live_body, mail_text

# How a topic page's messages begin.
TOPIC_STARTS = (
    "Question started by",
    "Topic started by",
    "Topic originated by",
    "Reply by",
    "Response from",
    "Response by",
    "Memo from",
    "Provided by",
)
_LABEL = r"(?:From:|From\s+\S|Subject:|Date:|Sent:)"
_LINE = r"(?:[^\n]*\S[^\n]*\n\s*)"
BOUNDARY = (
    r"(?i)(?:^|\n)[ \t]*(?:_{7,}|={7,}|\*{4,}|-{7,})[ \t]*"
    rf"(?=\n\s*{_LINE}{{0,5}}?(?:From:|From\s+\S|Subject:))"
    rf"(?=\n\s*{_LINE}{{0,4}}?({_LABEL})[^\n]*\n\s*{_LINE}{{0,4}}?(?!\1){_LABEL})"
)


ROWS = 4096  # pages of a task


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that become pages, dealt by their keys to tasks of about ROWS rows, at least one for each core: a file of short rows
    is few tasks, while reading a page takes about a millisecond."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    return rows.repartition(parts, *keys)


def decoded(content: Column) -> Column:
    """Page bytes as text: in the charset that the first 2048 bytes declare, if it is known and fits; else UTF-8 if that is
    valid; else Latin-1. Only pages in other charsets than these two leave the JVM."""
    head = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    charset = F.coalesce(*(_or_null(F.regexp_extract(head, rf"""{word}=["']?([a-z0-9_-]+)""", 1)) for word in ("charset", "encoding")), F.lit(""))
    latin, text = F.decode(content, "ISO-8859-1"), content.cast("string")
    usual = F.when(F.is_valid_utf8(text), text).otherwise(latin)
    rare = ~charset.isin("", "utf-8", "utf8", "iso-8859-1", "latin-1", "latin1")
    found = in_charset(F.when(rare, content), F.when(rare, charset), F.lit("strict"))
    return F.when(charset.isin("iso-8859-1", "latin-1", "latin1"), latin).otherwise(F.coalesce(found, usual))


def plain_text(html: Column) -> Column:
    """Text of a page: <br> and paragraph ends are line ends, comments, scripts and other tags go, references are decoded."""
    x = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", "")
    x = F.regexp_replace(x, r"(?is)[ \t\r\n]*<br\s*/?>[ \t\r\n]*", "\n")
    x = F.regexp_replace(x, r"(?is)</p>\s*<p[^>]*>|</(?:p|div|h\d|li|tr|table|ul|ol|pre|blockquote)>", "\n\n")
    return normalized_newlines(unescaped(F.regexp_replace(x, "(?s)<[^>]+>", "")))


def element(html: Column, start: str, end: str) -> Column:
    """Text of the first element between two patterns; empty for none."""
    return trimmed(unescaped(F.regexp_replace(F.regexp_extract(html, rf"(?is){start}(.*?){end}", 1), "(?s)<[^>]+>", "")))


def title(html: Column) -> Column:
    return element(html, r"<title\b[^>]*>", "</title>")


def heading(html: Column) -> Column:
    return element(html, r"<h1\b[^>]*>", "</h1>")


def links(html: Column) -> Column:
    """Targets of all anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def newest_listed(html: Column) -> Column:
    """The greatest number of an index page's msgN.html links; null for none."""
    numbers = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']msg(\d+)\.html["']"""), F.lit(1))
    return F.array_max(F.transform(numbers, lambda n: n.cast("long")))


class _Tree(HTMLParser):
    """Events of list items: for the current item, the nearest item above (or beside one above) that has a subject link."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[dict] = []
        self.parent, self.in_subject = None, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        known = dict(attrs)
        classes = (known.get("class") or "").split()
        if tag == "ul":
            self.open.append({"tag": "ul", "last": None})
        elif tag == "li":
            if "tSliceCur" in classes:
                self.found()
            self.open.append({"tag": "li", "link": None})
        elif tag == "span":
            self.in_subject = "subject" in classes
        elif tag == "a" and self.in_subject and self.open and self.open[-1]["tag"] == "li" and self.open[-1]["link"] is None:
            n = re.search(r"msg(\d+)", known.get("href") or "")
            self.open[-1]["link"] = int(n[1]) if n else None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("ul", "li") and any(x["tag"] == tag for x in self.open):
            while True:
                x = self.open.pop()
                if x["tag"] == "li" and self.open and self.open[-1]["tag"] == "ul":
                    self.open[-1]["last"] = x["link"]
                if x["tag"] == tag:
                    break
        elif tag == "span":
            self.in_subject = False

    def found(self) -> None:
        lists = [i for i, x in enumerate(self.open) if x["tag"] == "ul"]
        for i in reversed(lists[1:]):  # the item that holds the list, then the item before that one
            above = self.open[i - 1]
            if above["tag"] == "li" and above["link"] is not None:
                self.parent = self.parent or above["link"]
            beside = [x for x in self.open[:i] if x["tag"] == "ul"][-1]["last"]
            self.parent = self.parent or beside


@F.pandas_udf(T.LongType())
def reply_parent(html: pd.Series) -> pd.Series:
    """The number of the message that a page's thread tree puts above its own; null for none."""

    def one(page: str | None) -> int | None:
        tree = _Tree()
        tree.feed(page or "")
        return tree.parent

    return html.map(one).astype("Int64")


def live_messages(found: DataFrame) -> DataFrame:
    """Pages (message_number, content) with one message each; a page with neither subject nor author is dropped."""
    p = found.withColumn("html", decoded(F.col("content")))
    p = p.select(
        "message_number",
        F.nullif(F.regexp_extract("html", r"""(?is)<input[^>]*name=["']msgid["'][^>]*value=["']([^"']*)["']""", 1), F.lit("")).alias("message_id"),
        element(F.col("html"), r"""<span[^>]*class="date"[^>]*>\s*<a\b[^>]*>""", "</a>").alias("date_raw"),
        element(F.col("html"), r"""<span[^>]*class="sender[^"]*"[^>]*>.*?<span[^>]*itemprop="name"[^>]*>""", "</span>").alias("from_name"),
        element(F.col("html"), r"""<h1\b[^>]*>.*?<span[^>]*itemprop="name"[^>]*>""", "</span>").alias("subject"),
        trimmed(F.replace(live_body("html"), F.lit("X-Body-of-Message"), F.lit(""))).alias("body_raw"),
        reply_parent("html").alias("in_reply_to_number"),
    )
    p = p.where((F.col("subject") != "") | (F.col("from_name") != ""))
    return p.withColumns({"date": header_date(F.col("date_raw")), "category": category(F.col("subject"), WHEN_PARSED), "body_clean": without_disclaimers(F.col("body_raw"))})


def _after(label: str, block: str = "block") -> Column:
    return trimmed(F.regexp_extract(block, rf"(?m)(?:^|\s){label}:[ \t]*(\S[^\n]*)", 1))


def _or_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def sender_name(raw: Column) -> Column:
    """Display name of a From: field: bracketed and bare addresses, leaked labels and mailbox timestamps go; with nothing
    left, the address."""
    x = raw
    for pattern in (r"\s*\[mailto:[^\]]+\]", r"\s*<[^>]+>", r"\s*\S+@\S+", r"^Subject:\s*", r"\s+\w{3}\s+\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}\s*$"):
        x = trimmed(F.regexp_replace(x, pattern, ""))
    x = trimmed(F.regexp_replace(x, '^"+|"+$', ""))
    return F.coalesce(_or_null(x), _or_null(F.regexp_extract(raw, r"[\w.\-+]+@[\w.\-]+", 0)), raw)


HEADERS = r"(?:From|Subject|Date|Sent):"  # of a block


def header_first(block: Column, page_title: Column) -> Column:
    """A block that begins with its header: the page's title before a From: or Date: line goes, and so does what stands
    before a header in the first eight lines; the header's lines follow each other without blanks or indentation."""

    def rest(x: Column, first: Column) -> Column:
        """From the line at `first` (from 0) on; all for null."""
        return F.slice(x, F.coalesce(first, F.lit(0)) + 1, F.greatest(F.size(x), F.lit(1)))

    def place(x: Column, fits: Callable[[Column], Column]) -> Column:
        return F.array_min(F.filter(F.transform(x, lambda line, i: F.when(fits(line), i)), lambda i: i.isNotNull()))

    def told(line: Column) -> Column:
        return trimmed(line) != ""

    def untitled(x: Column) -> Column:
        titled = (page_title != "") & (trimmed(F.get(x, F.lit(0))) == trimmed(page_title))
        named = once(rest(x, F.lit(1)), lambda y: rest(y, place(y, told)))
        return F.when(titled, once(named, lambda y: F.when(trimmed(F.get(y, F.lit(0))).rlike("^(?:From|Date):"), y).otherwise(x))).otherwise(x)

    def from_header(x: Column) -> Column:
        return rest(x, place(F.slice(x, 1, 8), lambda line: line.rlike(rf"^\s*(?:{HEADERS}|From\s+\S)")))

    def closed_up(x: Column, body: Column) -> Column:
        head = F.filter(F.transform(F.slice(x, 1, body), trimmed), lambda line: line != "")
        after = F.transform(F.when(body < F.size(x), rest(x, body)).otherwise(F.array().cast("array<string>")), lambda line: F.regexp_replace(line, r"\s+$", ""))
        return trimmed(F.regexp_replace(F.array_join(F.concat(head, after), "\n"), "\n{3,}", "\n\n"))

    def joined(x: Column) -> Column:
        body = F.coalesce(place(x, lambda line: told(line) & ~trimmed(line).rlike(f"^{HEADERS}")), F.size(x))
        return once(body, lambda at: closed_up(x, at))

    lines = F.split(normalized_newlines(block), "\n")
    return once(lines, lambda x: once(untitled(x), lambda y: once(from_header(y), joined)))


def legacy_messages(found: DataFrame) -> DataFrame:
    """Pages (name, content) that hold several messages: blocks between separator lines that a header follows. Blocks under
    50 characters, and blocks without a sender, are no messages; a date may stand at the end of the block before."""
    p = found.withColumn("html", decoded(F.col("content")))
    p = p.select("name", title(F.col("html")).alias("title"), plain_text(F.col("html")).alias("text"))
    blocks = F.transform(F.split("text", BOUNDARY), lambda block: header_first(trimmed(block), F.col("title")))
    blocks = once(blocks, lambda x: F.transform(x, lambda block, i: F.struct(block.alias("block"), F.get(x, i - 1).alias("before"), F.size(x).alias("n"))))
    blocks = p.select("name", "title", F.posexplode(blocks).alias("place", "x")).select("name", "title", "place", "x.*")
    blocks = blocks.where((F.col("n") == 1) | (F.length("block") >= 50))
    mbox = r"(?m)^From\s+(\S+@\S+)\s+\w{3}\s+(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4})"
    sender = F.coalesce(_or_null(_after("From")), _or_null(F.regexp_extract("block", mbox, 1)), _or_null(F.regexp_extract("block", r"(?m)^From\s+([A-Z][a-z]+ [A-Z][a-z]+.*)$", 1)))
    inside = F.regexp_extract(_after("From"), r"\w{3}\s+(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4})", 1)
    earlier = F.element_at(F.regexp_extract_all("before", F.lit(r"Date:\s*([^\n]+)"), F.lit(1)), -1)
    earlier = F.when(F.col("before").contains("Date:"), earlier)
    raw = F.coalesce(_or_null(_after("Date")), _or_null(_after("Sent")), _or_null(trimmed(earlier)), _or_null(F.regexp_extract("block", mbox, 2)), _or_null(inside), F.lit(""))
    got = blocks.select("name", "place", "block", sender.alias("sender"), raw.alias("raw"), F.coalesce(_or_null(_after("Subject")), F.col("title")).alias("topic")).where(F.col("sender").isNotNull())
    swapped = F.col("raw").rlike(r"(?i)^(?:Re|FW|Fwd):") & F.col("topic").rlike(r"^\w{3},?\s+\d")
    got = got.select("name", "place", "block", "sender", F.when(swapped, F.col("topic")).otherwise(F.col("raw")).alias("date_raw"), F.when(swapped, F.col("raw")).otherwise(F.col("topic")).alias("subject"))
    second = F.get(F.regexp_extract_all("block", F.lit(r"Subject:\s*([^\n]+)"), F.lit(1)), 1)
    return got.select(
        F.col("name").alias("source_file"), "place", F.coalesce(flexible_date(F.col("date_raw")), flexible_date(F.col("subject")), flexible_date(second)).alias("date"), "date_raw",
        sender_name(F.col("sender")).alias("from_name"), "subject", category(F.col("subject"), WHEN_PARSED).alias("category"),
        F.col("block").alias("body_raw"), without_disclaimers(F.col("block")).alias("body_clean"),
    )


@F.pandas_udf(T.StringType())
def quoted_printable(texts: pd.Series) -> pd.Series:
    import quopri

    return texts.map(lambda t: quopri.decodestring(t.encode()).decode("utf-8", "replace"), na_action="ignore")


def mail_body(text: Column, markup: Column | None = None) -> Column:
    """A plain body; decoded if soft line ends and escapes, or a soft end before a <br> of its markup, show that it is
    quoted-printable."""
    x = F.replace(F.regexp_replace(text, "\r\n?", "\n"), F.lit("\xa0"), F.lit(" "))
    soft, hexes = F.regexp_count(x, F.lit("=\n")), F.regexp_count(x, F.lit("=[0-9A-F]{2}"))
    coded = (soft >= 2) | ((soft >= 1) & (hexes >= 1)) | (hexes >= 3)
    if markup is not None:
        coded = coded | markup.rlike(r"(?i)=\s*\n\s*<br\s*/?>")
    return normalized_newlines(F.when(coded, quoted_printable(x)).otherwise(x))


def _meta(name: str) -> Column:
    return trimmed(unescaped(F.regexp_extract("html", rf"""(?is)<meta[^>]*name=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)))


def _comment(name: str) -> Column:
    return trimmed(F.regexp_extract("html", rf'<!--\s*{name}="([^"]+)"', 1))


def _span(name: str, label: str) -> Column:
    return trimmed(F.regexp_replace(element(F.col("html"), rf"""<span[^>]*id=["']{name}["'][^>]*>""", "</span>"), rf"^{label}:\s*", ""))


def pipermail_messages(found: DataFrame) -> DataFrame:
    """Pages (name, content) with one message each and metadata in tags, comments or spans, whichever comes first."""
    p = found.withColumn("html", decoded(F.col("content")))
    raw = [_or_null(x) for x in (_meta("created"), _comment("sent"), _span("date", "Date"))]
    p = p.select(
        F.col("name").alias("source_file"),
        F.regexp_extract("name", r"^(\d{4}-\w+)_(\d+)\.html$", 1).alias("archive_month"),
        F.regexp_extract("name", r"^(\d{4}-\w+)_(\d+)\.html$", 2).try_cast("long").alias("archive_id"),
        F.coalesce(*(flexible_date(r) for r in raw)).alias("date"),
        F.coalesce(*(F.when(flexible_date(r).isNotNull(), r) for r in raw), *raw[::-1], F.lit("")).alias("date_raw"),
        F.coalesce(_or_null(_meta("author")), _or_null(_comment("name")), _or_null(sender_name(_span("from", "From"))), F.lit("")).alias("from_name"),
        title(F.col("html")).alias("subject"),
        mail_body(mail_text("html"), F.col("html")).alias("body_raw"),
    )
    return p.withColumns({"category": category(F.col("subject"), WHEN_PARSED), "body_clean": without_disclaimers(F.col("body_raw"))})


def heading_parts(rest: Column) -> Column:
    """struct(author, date_raw): a date after the last dash, or in the last five, four or three words."""
    parts = F.split(rest, " ")
    dash = F.regexp_extract(rest, r"^(.*) - (.*)$", 2)
    out = F.when(flexible_date(dash).isNotNull(), F.struct(trimmed(F.regexp_extract(rest, r"^(.*) - (.*)$", 1)).alias("author"), dash.alias("date_raw")))
    for n in (5, 4, 3):
        tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), " ")
        author = F.regexp_replace(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - n, F.lit(0))), " "), "^[ -]+|[ -]+$", "")
        out = out.when((F.size(parts) >= n) & flexible_date(tail).isNotNull(), F.struct(author.alias("author"), tail.alias("date_raw")))
    return out.otherwise(F.struct(rest.alias("author"), F.lit("").alias("date_raw")))


def topic_author(raw: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(raw, r"\S+@\S+", ""), r"\(\s*\)", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^[ :-]+|[ :-]+$", "")
    x = F.regexp_replace(x, r"^\((.*)\)$", "$1")
    return F.coalesce(_or_null(x), _or_null(F.regexp_extract(raw, r"\S+@\S+", 0)), F.lit("Unknown"))


def topic_messages(found: DataFrame, imputed: DataFrame | None = None) -> DataFrame:
    """Pages (name, content) of one topic each: sections under headings as in TOPIC_STARTS, up to "end of topic". `imputed`
    (name, place from 0 or null, prefix or null; date_raw) gives dates to sections that have none: by place, else by page
    (both null), else by page and how the heading begins (in lower case)."""
    start = "|".join(TOPIC_STARTS)
    p = found.withColumn("html", decoded(F.col("content")))
    text = F.regexp_replace(plain_text(F.col("html")), r"(?is)\n[ \t]*end of topic.*$", "")
    p = p.select("name", F.coalesce(_or_null(heading(F.col("html"))), F.regexp_replace("name", r"\.html$", "")).alias("subject"), F.split(F.concat(F.lit("\n"), text), rf"(?i)\n[ \t]*(?={start})").alias("parts"))
    s = p.select("name", "subject", F.posexplode(F.slice("parts", 2, F.size("parts"))).alias("place", "section"))
    head = rf"(?i)^(?:{start})\s*:?\s*([^\n]+(?:\n\s*- [^\n]*)?)"
    s = s.select("name", "subject", "place", F.lower(F.regexp_extract("section", f"(?i)^({start})", 1)).alias("prefix"), heading_parts(F.regexp_replace(F.regexp_extract("section", head, 1), r"\s+", " ")).alias("h"), trimmed(F.regexp_replace("section", head, "")).alias("body_raw"))
    s = s.where(F.col("body_raw") != "").select("name", "place", "prefix", "subject", "body_raw", topic_author(F.col("h.author")).alias("from_name"), _or_null(F.col("h.date_raw")).alias("date_raw"))
    if imputed is not None:
        known = imputed if "prefix" in imputed.columns else imputed.withColumn("prefix", F.lit(None).cast("string"))
        for i, (where, keys) in enumerate((("place IS NOT NULL", ["name", "place"]), ("place IS NULL AND prefix IS NULL", ["name"]), ("prefix IS NOT NULL", ["name", "prefix"]))):
            s = s.join(known.where(where).select(*keys, F.col("date_raw").alias(f"_raw{i}")), keys, "left")
        s = s.withColumn("date_raw", F.coalesce("date_raw", "_raw0", "_raw1", "_raw2"))
    return s.select(F.col("name").alias("source_file"), "place", flexible_date(F.col("date_raw")).alias("date"), F.coalesce("date_raw", F.lit("")).alias("date_raw"), "from_name", "subject", category(F.col("subject"), WHEN_PARSED).alias("category"), "body_raw", without_disclaimers(F.col("body_raw")).alias("body_clean"))


def require_rows(messages: DataFrame, pages_: DataFrame) -> DataFrame:
    """The messages; an error if there were pages and not one gave a message."""
    if messages.isEmpty() and not pages_.isEmpty():
        raise RuntimeError("no page gave a message; has the layout changed?")
    return messages
