"""Threads: reply chains, thread keys, gaps in time, order within a thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import whole_days
from ..functions.text import NO_SUBJECT, group_key, is_reply
from ..scratch import written

GAP_DAYS = 60


def climbed(edges: DataFrame) -> DataFrame:
    """Follows node -> parent (distinct nodes, parents not null) to the top by pointer doubling: rounds grow with the
    logarithm of the longest chain, and a round joins only the nodes that aren't at a top yet. Gives node, top, hops, loop:
    the length of the cycle that the node is in or leads to (null without one). In a cycle, top is the node itself; for a
    node that leads to one, top is where it enters and hops count up to there. A parent that is no node is a top."""
    first = written(edges.select("node", F.col("parent").alias("at"), F.lit(1).cast("long").alias("hops"), F.least("node", "parent").alias("low")), "climb")
    heads = first.select(F.col("node").alias("at"), F.lit(True).alias("_more"))
    now = written(first.join(heads, "at", "left").select("node", "at", "hops", "low", F.coalesce("_more", F.lit(False)).alias("moving")), "climb")
    at_top, before, reach = now.where("NOT moving"), None, 1  # rows that are at a top stay where they were written
    while True:
        rising = now.where("moving")
        moving = rising.count()
        if not moving or (moving == before and reach >= moving):
            break
        before, reach = moving, 2 * reach
        ahead = at_top.unionByName(rising).select(F.col("node").alias("at"), *(F.col(c).alias(f"_{c}") for c in ("at", "hops", "low", "moving")))
        step = rising.drop("moving").join(ahead, "at")
        now = written(step.select("node", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.least("low", "_low").alias("low"), F.col("_moving").alias("moving")), "climb")
        at_top = at_top.unionByName(now.where("NOT moving"))
    done = at_top.select("node", F.col("at").alias("top"), "hops", F.lit(None).cast("long").alias("loop"))
    if not moving:
        return done
    endless = rising.drop("moving")
    cycle = endless.select(F.col("at").alias("node")).distinct()
    members = endless.join(cycle, "node", "left_semi").select("node", "low")
    sizes = members.join(members.groupBy("low").agg(F.count("*").alias("loop")), "low").select("node", "loop")
    inside = sizes.select("node", F.col("node").alias("top"), F.lit(0).cast("long").alias("hops"), "loop")
    tails = edges.join(endless.select("node"), "node", "left_semi").join(cycle, "node", "left_anti")
    entered = climbed(tails) if not tails.isEmpty() else done.limit(0)
    entered = entered.drop("loop").join(sizes.select(F.col("node").alias("top"), "loop"), "top").select("node", "top", "hops", "loop")
    return done.unionByName(inside).unionByName(entered)


def thread_roots(messages: DataFrame) -> DataFrame:
    """Adds thread_id: the number at the end of the reply chain. A parent that isn't there is the root; on a cycle, the
    first number that comes twice."""
    known = messages.where(F.col("message_number").isNotNull())
    edges = known.where(F.col("in_reply_to_number").isNotNull()).select(F.col("message_number").alias("node"), F.col("in_reply_to_number").alias("parent")).dropDuplicates(["node"])
    roots = climbed(edges).select(F.col("node").alias("message_number"), F.col("top").alias("_root"))
    found = messages.drop("thread_id").join(roots, "message_number", "left")
    return found.withColumn("thread_id", F.coalesce("_root", "message_number")).drop("_root")


def reply_depths(messages: DataFrame, thread: str = "thread_key") -> DataFrame:
    """Adds depth: replies between a message and the start of its chain, counted within its thread. Each member of a cycle
    of n counts n."""
    child = messages.select(F.col("message_number").alias("node"), F.col("in_reply_to_number").alias("parent"), F.col(thread).alias("_t"))
    parent = messages.select(F.col("message_number").alias("parent"), F.col(thread).alias("_u"))
    edges = child.join(parent, "parent").where(F.col("_t") == F.col("_u")).select("node", "parent").dropDuplicates(["node"])
    found = climbed(edges)
    depth = F.when(F.col("loop").isNull(), F.col("hops")).when(F.col("hops") == 0, F.col("loop")).otherwise(F.col("hops") + F.col("loop") - 1)
    depths = found.select(F.col("node").alias("message_number"), depth.alias("depth"))
    return messages.join(depths, "message_number", "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))


def thread_key(page_sources: tuple[str, ...] = ("legacy", "topic")) -> Column:
    """Native thread, else page (for sources of thread pages), else subject."""
    page = F.concat_ws(":", "source", "source_url")
    return (
        F.when(F.col("thread_id").isNotNull(), F.concat(F.lit("thread:"), F.col("thread_id").cast("string")))
        .when(F.col("source").isin(*page_sources) & F.col("source_url").isNotNull(), page)
        .otherwise(group_key(F.col("subject")))
    )


def split_at_gaps(messages: DataFrame, key: str, order: list[Column] | None = None, date: str = "date", days: int = GAP_DAYS, eligible: Column | None = None, out: str | None = None) -> DataFrame:
    """Appends #1, #2 … to the key after each gap of more than `days` whole days to the message before. Messages without a
    date, and those not eligible, keep their key and don't count as the message before.

    There is no such gap within a day, so only the first and last time of each key's days are scanned, and a key with very
    many messages is as many rows there as it has days. `order` doesn't matter for the result."""
    fits = F.col(date).isNotNull() & F.col(key).isNotNull() & (F.lit(True) if eligible is None else eligible)
    found = messages.withColumn("_day", F.when(fits, F.to_date(date)))
    times = found.where(F.col("_day").isNotNull()).groupBy(F.col(key).alias("_k"), F.col("_day").alias("_d")).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    run = Window.partitionBy("_k").orderBy("_d")
    gap = F.coalesce(whole_days(F.col("_first"), F.lag("_last").over(run)) > days, F.lit(False)).cast("int")
    later = times.withColumn("_gap", gap).withColumn("_number", F.sum("_gap").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_number > 0")
    later = written(later.select("_k", "_d", "_number"), "later")  # where few days come after a gap, Spark knows and broadcasts them
    found = found.join(later, (F.col(key) == F.col("_k")) & (F.col("_day") == F.col("_d")), "left")
    named = F.when(F.col("_number") > 0, F.concat(F.col(key), F.lit("#"), F.col("_number").cast("string"))).otherwise(F.col(key))
    return found.withColumn(out or key, named).drop("_day", "_k", "_d", "_number")


def display_threads(messages: DataFrame, order: list[Column], days: int = GAP_DAYS, page_source: str = "topic", mixed_source: str = "legacy") -> DataFrame:
    """Adds display_thread_key. One source goes by page; another by page only where the page mixes subjects or has a blank
    one; blank subjects go by their thread key, or stand alone; all others by subject. Then gaps split.

    The messages are written once: pages, gaps and the result read from there what they need."""
    messages = written(messages.withColumn("_key", group_key(F.col("subject"))), "messages")
    key = F.col("_key")
    here = F.max((F.col("source") == mixed_source).cast("int"))
    keys = messages.where(F.col("source_url").isNotNull()).groupBy("source_url", "_key").agg(here.alias("_here"))
    pages = keys.groupBy(F.col("source_url").alias("_url")).agg(F.count("*").alias("_n"), F.max((key == NO_SUBJECT).cast("int")).alias("_blank"), F.max("_here").alias("_here"))
    mixed = written(pages.where("_here = 1 AND (_n > 1 OR _blank = 1)").select("_url", F.lit(True).alias("_mixed")), "mixed")
    found = messages.join(mixed, F.when(F.col("source") == mixed_source, F.col("source_url")) == F.col("_url"), "left").drop("_url")
    found = found.withColumn("_mixed", F.coalesce("_mixed", F.lit(False)))
    by_page = ((F.col("source") == page_source) & F.col("source_url").isNotNull()) | F.col("_mixed")
    base = (
        F.when(by_page, F.concat(F.lit("page:"), F.col("source_url")))
        .when((key == NO_SUBJECT) & (F.coalesce("thread_key", F.lit(NO_SUBJECT)) != NO_SUBJECT), F.col("thread_key"))
        .when(key == NO_SUBJECT, F.concat(F.lit("msg-"), F.col("message_number").cast("string")))
        .otherwise(key)
    )
    found = found.withColumn("display_thread_key", base).drop("_mixed", "_key")
    return split_at_gaps(found, "display_thread_key", order, days=days)


RUN = 1 << 16  # undated messages that are ordered at once


def thread_order(messages: DataFrame, thread: str = "display_thread_key") -> DataFrame:
    """Adds position (from 1) in the thread: the earliest message that is no reply, then the others by date (undated last)
    and number in the month. Messages are ordered within a thread's days (undated ones in runs of their numbers in the
    month); over a whole thread only the days' counts are summed up. The messages are written once, in between."""
    run = F.when(F.col("date").isNull(), F.coalesce(F.floor(F.col("msg_seq") / RUN), F.lit(-1))).otherwise(F.lit(0)).cast("long")
    found = messages.withColumns({"_day": F.to_date("date"), "_run": run})
    found = written(found.withColumn("_own", F.row_number().over(Window.partitionBy(thread, "_day", "_run").orderBy("date", "msg_seq", "message_number"))), "ordered")
    days = found.groupBy(F.col(thread).alias("_t"), F.col("_day").alias("_d"), F.col("_run").alias("_r")).agg(F.count("*").alias("_n"), F.min(F.when(~is_reply(F.col("subject")), F.col("_own"))).alias("_open"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_t").orderBy(F.col("_d").asc_nulls_last(), "_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("_before", before).withColumn("_start", F.min(F.col("_before") + F.col("_open")).over(Window.partitionBy("_t")))
    same = F.col(thread).eqNullSafe(F.col("_t")) & F.col("_day").eqNullSafe(F.col("_d")) & (F.col("_run") == F.col("_r"))
    found = found.join(days.select("_t", "_d", "_r", "_before", "_start"), same)
    place, start = F.col("_own") + F.col("_before"), F.col("_start")
    position = F.when(place == start, F.lit(1)).when(place < start, place + 1).otherwise(place).cast("int")
    return found.withColumn("position", position).drop("_day", "_run", "_own", "_t", "_d", "_r", "_before", "_start")
