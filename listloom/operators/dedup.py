"""Duplicate resolution by source priority, and newest snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_subject_signature, merge_key
from ..schemas import SOURCES

EXACT = ("source", "source_url", "subject", "date", "body_clean", "from_name")


def priority(source: Column, order: tuple[str, ...] = SOURCES) -> Column:
    """The place of a source in the order; others come last, together with the last named one."""
    out = F
    for i, name in enumerate(order[:-1]):
        out = out.when(source == name, F.lit(i))
    return out.otherwise(F.lit(len(order) - 1))


def ordinal(sort_by_priority: bool = True) -> list[Column]:
    """A total order, so that keep-first doesn't depend on partitioning."""
    first = [priority(F.col("source"))] if sort_by_priority else []
    return [*first, F.col("date").asc_nulls_first(), F.col("message_number").asc_nulls_last(), F.col("source_url").asc_nulls_last(), F.col("subject"), F.col("from_name"), F.col("body_clean")]


def resolved(messages: DataFrame, tag: str = "[list]") -> DataFrame:
    """One message of each group with equal subject key, body signature (blank subjects only), day and author: that of
    the source with the best priority. Groups within one page keep all their different messages, unless a key is null.

    One shuffle by the coarse key serves the group's statistics, the choice and the follow-ups: messages that are equal in all
    of EXACT are in one group. Null is equal to nothing there, so of a page's group the chosen message with a null among
    them stands beside itself as a follow-up."""
    keyed = messages.withColumn("_subject", merge_key(F.col("subject"), tag)).withColumn("_day", F.to_date("date"))
    keyed = keyed.withColumn("_body", blank_subject_signature(F.coalesce("_subject", F.lit("")), F.col("body_clean")))
    keys = ("_subject", "_body", "_day", "from_name")
    group = Window.partitionBy(*keys)
    n, urls = F.count("*").over(group), F.count("source_url").over(group)
    one_page = (urls == 0) | ((urls == n) & (F.min("source_url").over(group) == F.max("source_url").over(group)))
    known = F.col("_subject").isNotNull() & F.col("_day").isNotNull() & F.col("from_name").isNotNull()
    ranked = keyed.withColumns({
        "_nth": F.row_number().over(group.orderBy(*ordinal())),
        "_page": known & (n > 1) & one_page,
        "_copy": F.row_number().over(Window.partitionBy(*keys, *(c for c in EXACT if c not in keys)).orderBy(*ordinal())),
    })
    kept = F.col("_nth") == 1
    incomplete = reduce(Column.__or__, [F.col(c).isNull() for c in EXACT])
    followup = F.col("_page") & (F.col("_copy") == 1) & (~kept | incomplete)
    times = kept.cast("int") + F.coalesce(followup, F.lit(False)).cast("int")
    return ranked.withColumn("_times", times).where("_times > 0").withColumn("_each", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select(*messages.columns)


def newest(entries: DataFrame, key: str, at: str = "timestamp", tie: str = "url") -> DataFrame:
    """The row of each key with the greatest `at` (text order); the first of ties by `tie`. Partial aggregates go first."""
    columns = [c for c in entries.columns if c != key]
    best = F.max_by(F.struct(*columns), F.col(at))
    if tie and tie != key:
        top = entries.groupBy(key).agg(F.max(at).alias("_at"))
        tied = entries.join(top, key).where(F.col(at) == F.col("_at")).drop("_at")
        best, entries = F.min_by(F.struct(*columns), F.col(tie)), tied
    return entries.groupBy(key).agg(best.alias("_best")).select(key, *(F.col(f"_best.{c}").alias(c) for c in columns)).select(*entries.columns)


def latest_version(known: DataFrame, new: DataFrame, key: str = "message_number") -> DataFrame:
    """Known rows and new rows; of equal keys the new one, of several new ones the same in every run. Rows without a key are
    no versions of each other and stay."""
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    keyed, columns = both.where(F.col(key).isNotNull()), sorted(c for c in both.columns if c != "_new")
    last = Window.partitionBy(key).orderBy(F.desc("_new"), F.xxhash64(*columns), F.to_json(F.struct(*columns)))
    return keyed.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth").unionByName(both.where(F.col(key).isNull())).drop("_new")


def unseen(new: DataFrame, known: DataFrame, key: str = "message_number") -> DataFrame:
    return new.join(known.select(key), key, "left_anti")
