"""From merged messages to the table that views are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import category
from ..functions.names import normalized_author, overridden
from ..functions.text import display_subject, name_from_address
from ..operators.threads import display_threads, split_at_gaps, thread_key
from ..operators.views import author_slug, message_url, numbered
from ..scratch import written


def by_date() -> list[Column]:
    """Date (undated first), then number: the order in which messages are counted."""
    return [F.col("date").asc_nulls_first(), F.col("message_number").asc_nulls_last(), F.col("source_url").asc_nulls_last()]


def unswapped(messages: DataFrame, list_name: str = "list") -> DataFrame:
    """Author and subject change places where only the author looks like a subject. Both are read before either is set."""
    looks = rf"^(?:Re:|RE:|Fwd?:|FW:|\[{list_name}\])"
    swap = F.col("from_name").rlike(looks) & ~F.col("subject").rlike(looks)
    return messages.withColumns({"from_name": F.when(swap, F.col("subject")).otherwise(F.col("from_name")), "subject": F.when(swap, F.col("from_name")).otherwise(F.col("subject"))})


def enriched(messages: DataFrame, overrides: DataFrame | None = None, decode: bool = True) -> DataFrame:
    """Readable authors and subjects, categories, author slugs, thread keys (split at gaps), numbers in the month, URLs."""
    m = unswapped(messages)
    m = m.withColumns({"category": category(F.col("subject")), "from_name": name_from_address(F.col("from_name"))})
    m = m.withColumn("subject", F.when(F.col("subject").isNotNull(), display_subject(F.col("subject"))))
    m = m.withColumn("from_name", normalized_author(F.col("from_name"), decode=decode)) if overrides is None else overridden(m, overrides, decode=decode)
    m = m.withColumns({"author_slug": author_slug(F.col("from_name")), "thread_key": thread_key()})
    m = written(m, "messages")  # the steps below read it several times
    native = F.col("thread_id").isNotNull() | (F.col("source").isin("legacy", "topic") & F.col("source_url").isNotNull())
    m = split_at_gaps(m, "thread_key", by_date(), eligible=~native)
    m = numbered(m, by_date())
    return display_threads(m.withColumn("url", message_url()), by_date())
