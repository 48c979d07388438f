"""Rollups, lists and links over messages. Each function is a DataFrame transformation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import CATEGORIES
from ..functions.dates import short_date
from ..functions.text import NO_SUBJECT, display_thread_subject, group_key, slug


def distinct_with_null(column: str) -> Column:
    """Distinct values, null counted as one."""
    return F.count_distinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def only(df: DataFrame, category: str = "technical") -> DataFrame:
    return df.where(F.col("category") == category)


def thread(df: DataFrame, root: int) -> DataFrame:
    """One thread's messages, undated last."""
    return df.where(F.col("thread_id") == root).orderBy(F.col("date").asc_nulls_last(), "message_number")


def thread_summary(df: DataFrame, thread: str = "thread_id", first: str = "message_number") -> DataFrame:
    """Subject and category of the first message, messages, first and last date, participants (null is one)."""
    return df.groupBy(thread).agg(
        F.min_by("subject", first).alias("subject"),
        F.min_by("category", first).alias("category"),
        F.count("*").alias("n_messages"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        distinct_with_null("from_name").alias("n_participants"),
    )


def top_contributors(df: DataFrame, n: int = 20) -> DataFrame:
    return counts(df, "from_name").orderBy(F.desc("n"), F.col("from_name").asc_nulls_last()).limit(n)


def monthly_volume(df: DataFrame) -> DataFrame:
    return counts(df.where(F.col("date").isNotNull()).withColumn("month", F.date_format("date", "yyyy-MM")), "month", "category")


def year_by_category(df: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """A row for each year, a column for each category, zero where there is none."""
    dated = df.where(F.col("date").isNotNull()).withColumn("year", F.year("date"))
    return dated.groupBy("year").pivot("category", list(categories)).agg(F.count(F.lit(1))).na.fill(0)


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_messages"), distinct_with_null("from_name").alias("n_authors"), F.count_if(F.col("category") == "technical").alias("n_technical"), F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year"))


def source_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n_messages"), distinct_with_null("from_name").alias("n_authors"), F.count_if(F.col("category") == "technical").alias("n_technical"))


def months(df: DataFrame) -> DataFrame:
    return counts(df.where(F.col("date").isNotNull()).select(F.year("date").alias("year"), F.month("date").alias("month")), "year", "month")


def author_slug(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("unknown")).otherwise(slug(name))


def author_index(df: DataFrame, first: str = "message_number") -> DataFrame:
    """A row for each author: the name first seen, messages, first and last year, share of the busiest author's messages."""
    found = df.withColumn("author_slug", author_slug(F.col("from_name"))).groupBy("author_slug").agg(
        F.min_by("from_name", first).alias("name"), F.count("*").alias("n"), F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year")
    )
    top = found.agg(F.max("n").alias("_top"))  # one row
    return found.join(F.broadcast(top)).withColumn("percent", F.round(100.0 * F.col("n") / F.col("_top"), 1)).drop("_top")


def author_timeline(df: DataFrame) -> DataFrame:
    """First and last year as text, ? for authors without dates."""
    years = df.withColumn("author_slug", author_slug(F.col("from_name"))).groupBy("author_slug").agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b"), F.count("*").alias("n"))
    return years.select("author_slug", "n", *(F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(name) for c, name in (("a", "first_year"), ("b", "last_year"))))


RUN = 1 << 16  # numbers of undated messages that are ordered at once


def _parts(df: DataFrame, number: str, date: str = "date") -> DataFrame:
    """Adds _day and _run: messages that are ordered together. Undated ones are parted by their numbers, in order."""
    run = F.coalesce(F.floor(F.col(number) / RUN), F.lit((1 << 63) - 1))
    return df.withColumns({"_day": F.to_date(date), "_run": F.when(F.col(date).isNull(), run).otherwise(F.lit(0).cast("long"))})


def numbered(df: DataFrame, order: list[Column], number: str = "message_number") -> DataFrame:
    """Adds year, month and msg_seq: the running count of subjects in the month, by date, number and the rest of `order`.
    Undated messages are one month. Messages are counted within days (undated ones within runs of numbers); only the days'
    totals are summed up over a month."""
    found = _parts(df.withColumns({"year": F.year("date"), "month": F.month("date")}), number)
    # never null, so that the join below is by the same columns as the window and needs no shuffle of its own
    found = found.withColumn("_day", F.coalesce(F.unix_date("_day"), F.lit(-(1 << 31))))
    own = Window.partitionBy("_day", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("year", "month").orderBy("_day", "_run").rowsBetween(Window.unboundedPreceding, -1)
    days = found.groupBy("year", "month", "_day", "_run").agg(F.count("subject").alias("_n"))
    days = days.select("_day", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = found.withColumn("_own", F.count("subject").over(own)).join(days, ["_day", "_run"])
    return found.withColumn("msg_seq", F.col("_own") + F.col("_before")).drop("_day", "_run", "_own", "_before")


def message_url() -> Column:
    dated = F.format_string("/%d/%02d/%d.html", "year", "month", "msg_seq")
    return F.when(F.col("year").isNull() | F.col("month").isNull(), F.format_string("/undated/%d.html", "msg_seq")).otherwise(dated)


def thread_url() -> Column:
    """Of a thread's first message; zero is no identifier."""
    month = F.when(F.col("year").isNotNull() & F.col("month").isNotNull(), F.format_string("%d-%02d-%d", "year", "month", "msg_seq"))
    name = F.coalesce(F.nullif("thread_id", F.lit(0)).cast("string"), F.nullif("message_number", F.lit(0)).cast("string"), month, F.format_string("undated-%d", "msg_seq"))
    words = F.coalesce(F.nullif(slug(display_thread_subject(F.col("subject")), 80), F.lit("")), F.lit("thread"))
    return F.concat(F.lit("/threads/"), words, F.lit("-"), name, F.lit("/"))


def thread_meta(ordered: DataFrame, thread: str = "display_thread_key") -> DataFrame:
    """From messages with a position: the starter's subject, messages, participants, and the date of the last dated message
    in thread order. Members are rows of their own (`thread_members`)."""
    dated = F.when(F.col("date").isNotNull(), F.struct("position", "date"))
    return ordered.groupBy(thread).agg(
        F.min_by("subject", "position").alias("subject"),
        F.count("*").alias("n_messages"),
        distinct_with_null("from_name").alias("n_participants"),
        F.max(dated)["date"].alias("last_date"),
    )


def thread_members(ordered: DataFrame, thread: str = "display_thread_key") -> DataFrame:
    """A row for each message of a thread, in order by position."""
    return ordered.select(thread, "position", "message_number")


def with_thread(ordered: DataFrame, thread: str = "display_thread_key") -> DataFrame:
    """Messages with what is known of their thread: its subject, messages, participants and last date; has_context says
    whether there are others."""
    meta = thread_meta(ordered, thread)
    meta = meta.select(F.col(thread).alias("_thread"), *(F.col(c).alias(f"thread_{c}") for c in meta.columns if c != thread))
    found = ordered.join(meta, F.col(thread).eqNullSafe(F.col("_thread")), "left").drop("_thread")
    return found.withColumn("has_context", F.coalesce(F.col("thread_n_messages") > 1, F.lit(False)))


def recent(df: DataFrame, n: int = 30) -> DataFrame:
    return df.where(F.col("date").isNotNull()).orderBy(F.desc("date"), F.desc("message_number")).limit(n)


def with_neighbours(df: DataFrame, date: str = "date", number: str = "message_number", column: str = "url") -> DataFrame:
    """Adds previous and next `column` over the whole order (date, nulls first; number), without one task for all rows:
    windows run within days (undated messages: within runs of numbers), and the ends of days are stitched by a window over
    one row a day (their number is that of the calendar, not of the messages)."""
    found = _parts(df, number, date).withColumn("_day", F.coalesce("_day", F.lit("0001-01-01").cast("date")))
    day = Window.partitionBy("_day", "_run").orderBy(F.col(date).asc_nulls_first(), F.col(number).asc_nulls_last())
    place = F.struct(F.col(date), F.col(number).isNull(), F.col(number))
    ends = found.groupBy("_day", "_run").agg(F.min_by(column, place).alias("_first"), F.max_by(column, place).alias("_last"))
    days = Window.orderBy("_day", "_run")
    ends = ends.select("_day", "_run", F.lag("_last").over(days).alias("_before"), F.lead("_first").over(days).alias("_after"))
    found = found.join(ends, ["_day", "_run"])
    return found.withColumns({
        f"previous_{column}": F.coalesce(F.lag(column).over(day), "_before"),
        f"next_{column}": F.coalesce(F.lead(column).over(day), "_after"),
    }).drop("_day", "_run", "_before", "_after")


def month_threads(df: DataFrame, thread: str = "thread_key") -> DataFrame:
    """Messages of each month by thread: position in the thread's part of the month, whether it is a reply there, and the
    place of the thread (latest last message first)."""
    bucket = Window.partitionBy("year", "month", thread)
    order = [F.col("date").asc_nulls_first(), F.col("message_number")]
    found = df.withColumn("position", F.row_number().over(bucket.orderBy(*order))).withColumn("is_reply", F.col("position") > 1)
    last = F.max(F.struct(F.col("position"), F.col("date"))).over(bucket)["date"]
    first = F.min(F.struct(F.col("position"), F.col("date"))).over(bucket)["date"]
    found = found.withColumn("_last", F.coalesce(last, first))
    return found.withColumn("thread_place", F.dense_rank().over(Window.partitionBy("year", "month").orderBy(F.desc("_last"), thread))).drop("_last")


def sorted_threads(meta: DataFrame, by: str = "recent") -> DataFrame:
    """Thread lists: recent, count or subject (in the order of Unicode's collation, which puts case and accents last)."""
    key = F.collate(F.col("subject"), "UNICODE")
    orders = {"recent": [F.desc("last_date")], "count": [F.desc("n_messages"), F.desc("last_date")], "subject": [key]}
    return meta.orderBy(*orders[by], "display_thread_key")


def sorted_authors(index: DataFrame, by: str = "name") -> DataFrame:
    """Author lists: name, name_desc (in the order of Unicode's collation), count or recent."""
    key = F.collate(F.col("name"), "UNICODE")
    orders = {"name": [key], "name_desc": [key.desc()], "count": [F.desc("n")], "recent": [F.desc("last_year"), F.desc("n")]}
    return index.orderBy(*orders[by], "author_slug")


def containing(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column contains the text in any case."""
    return df.where(F.contains(F.lower(column), F.lower(F.lit(text))))


def running_status(log: DataFrame) -> DataFrame:
    """Fetch results (batch, status) as counts of each batch and running totals."""
    found = log.groupBy("batch").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("downloaded", "cached")), F.count_if(F.col("status").isin("not_found", "error")).alias("failed"))
    run = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a batch
    return found.withColumns({f"total_{c}": F.sum(c).over(run) for c in ("downloaded", "cached", "failed")})


def next_number(df: DataFrame, column: str = "message_number") -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_number"))


def years(df: DataFrame) -> DataFrame:
    """Years with messages, latest first."""
    return df.where(F.col("date").isNotNull()).select(F.year("date").alias("year")).distinct().orderBy(F.desc("year"))


def page_subjects(df: DataFrame) -> DataFrame:
    """Different subjects of each page, and whether one is blank: such pages are threads of their own."""
    key = group_key(F.col("subject"))
    found = df.where(F.col("source_url").isNotNull()).groupBy("source_url")
    return found.agg(F.count_distinct(key).alias("n_subjects"), F.max(key == NO_SUBJECT).alias("has_blank"))


def source_label(labels: dict[str, str], source: str = "source") -> Column:
    """Display names of sources; others as they are."""
    out = F
    for name, label in labels.items():
        out = out.when(F.col(source) == name, F.lit(label))
    return out.otherwise(F.col(source))


def thousands(n: Column) -> Column:
    """A whole number with separators."""
    return F.format_number(n, 0)


def is_current(year: int | None, month: int | None, number: int) -> Column:
    """Whether a row is the message of that month and number; undated months are equal to each other."""
    return F.col("year").eqNullSafe(F.lit(year)) & F.col("month").eqNullSafe(F.lit(month)) & (F.col("msg_seq") == number)


def span(df: DataFrame, thread: str = "thread_key") -> DataFrame:
    """Distinct threads (null is one), first and last date."""
    return df.agg(distinct_with_null(thread).alias("n_threads"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def home_feed(df: DataFrame, n: int = 30, year: int | None = None, category: str | None = None) -> DataFrame:
    """The latest messages as they are listed: number, subject, author, category, year and short date; of them those of one
    year or category, if given."""
    feed = recent(df, n)
    for column, wanted in ((F.year("date"), year), (F.col("category"), category)):
        feed = feed if wanted is None else feed.where(column == wanted)
    return feed.select("message_number", "subject", "from_name", "category", F.year("date").alias("year"), short_date(F.col("date")).alias("date"))
