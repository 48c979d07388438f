"""Messages and the tops of their reply chains, kept up to date batch by batch.

A folder holds logs, each batch in a folder of its own: `messages` as they arrived, and `roots` (message_number, parent,
thread_id) of the messages that are new or whose thread a batch has changed; a message's last row counts. So what a batch
writes follows the batch and the chains it touches, not the store. `bases` hold the last rows of all messages up to a batch,
written when the log has grown to the size of the base.

A known message's thread changes only if the top of its chain, missing so far, has come and has a parent. Only new messages
are linked: a parent that is known stands for its whole chain, by the top it had. A known message whose top has come gets
that message's top. What then leads to a cycle, old and new, is linked again along its own edges, so that cycles come out
as in a rebuild."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import latest_version
from ..operators.threads import climbed
from ..scratch import written
from ..sources.archive import folders
from ..sources.html import require_rows

LOG = "message_number long, parent long, thread_id long"


class ThreadStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def batches(self, log: str = "roots") -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in folders(self.spark, f"{self.folder}/{log}") if n.startswith("batch="))

    def _read(self, log: str, batches: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{log}").parquet(*[f"{self.folder}/{log}/batch={n}" for n in batches])

    def _log(self, before: int | None = None) -> DataFrame:
        """All rows of the log and the base under it: message_number, parent, thread_id, batch."""
        bases = [n for n in self.batches("bases") if before is None or n < before]
        logged = [n for n in self.batches() if (before is None or n < before) and n > max(bases, default=-1)]
        parts = [self._read(log, some) for log, some in (("bases", bases[-1:]), ("roots", logged)) if some]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{LOG}, batch int")

    @staticmethod
    def _last(log: DataFrame) -> DataFrame:
        found = log.groupBy("message_number").agg(F.max_by(F.struct("parent", "thread_id"), "batch").alias("x"))
        return found.select("message_number", "x.parent", "x.thread_id")

    def roots(self) -> DataFrame:
        """message_number, parent, thread_id of all numbered messages."""
        return self._last(self._log())

    def messages(self) -> DataFrame:
        """All messages with their thread_id and the batch they came in; those without a number have no thread."""
        found = self._read("messages", self.batches())
        return found.join(self.roots().select("message_number", "thread_id"), "message_number", "left")

    def add(self, messages: DataFrame, number: int | None = None) -> int:
        """Appends a batch: messages whose number is known are skipped, of several with one number one is kept. The same
        batch number again replaces what that batch wrote, so a batch may be repeated after a failure.

        The log is only joined with written tables of the batch's numbers, whose sizes Spark knows: small ones are broadcast,
        so that the log isn't shuffled."""
        number = max(self.batches(), default=-1) + 1 if number is None else number
        log = self._log(number)
        incoming = written(messages.drop("thread_id"), "incoming")
        known = log.join(incoming.select("message_number"), "message_number", "left_semi").select("message_number").distinct()
        place, fresh = f"{self.folder}/messages/batch={number}", latest_version(incoming.limit(0), incoming.join(known, "message_number", "left_anti"))
        fresh.write.mode("overwrite").parquet(place)  # in place, and counts once the batch's roots are there
        fresh = self.spark.read.schema(fresh.schema).parquet(place)

        nodes = fresh.where("message_number IS NOT NULL").select("message_number", F.col("in_reply_to_number").alias("parent"))
        come = nodes.where("parent IS NOT NULL").select(F.col("message_number").alias("thread_id"))
        suspects = written(log.join(come, "thread_id", "left_semi").select("message_number").distinct(), "suspects")
        touched = written(self._last(log.join(suspects, "message_number", "left_semi")).join(come, "thread_id", "left_semi"), "touched")
        edges = nodes.where("parent IS NOT NULL")
        outer = written(edges.select(F.col("parent").alias("message_number")).distinct().join(nodes.select("message_number"), "message_number", "left_anti"), "outer")
        above = self._last(log.join(outer, "message_number", "left_semi")).select(F.col("message_number").alias("parent"), F.col("thread_id").alias("above"))
        tops = written(climbed(edges.join(above, "parent", "left").select(F.col("message_number").alias("node"), F.coalesce("above", "parent").alias("parent"))), "tops")
        rows = nodes.withColumn("thread_id", F.col("message_number")).unionByName(touched)
        rows = rows.join(tops.select(F.col("node").alias("thread_id"), "top", "loop"), "thread_id", "left")
        rows = rows.select("message_number", "parent", F.coalesce("top", "thread_id").alias("thread_id"), "loop")
        if not tops.where("loop IS NOT NULL").isEmpty():
            rows = written(rows, "rows")
            around = climbed(rows.where("loop IS NOT NULL").select(F.col("message_number").alias("node"), "parent"))
            rows = rows.join(around.select(F.col("node").alias("message_number"), "top"), "message_number", "left").withColumn("thread_id", F.coalesce("top", "thread_id"))
        rows.select("message_number", "parent", "thread_id").write.mode("overwrite").parquet(f"{self.folder}/roots/batch={number}")
        return number

    def compact(self, least: int = 1 << 20) -> bool:
        """Writes a new base once the log has as many rows as the base, and `least` rows."""
        last, bases = max(self.batches(), default=-1), self.batches("bases")
        logged = [n for n in self.batches() if n > max(bases, default=-1)]
        grown = self._read("roots", logged).count() if logged else 0
        if grown < max(least, self._read("bases", bases[-1:]).count() if bases else 0):
            return False
        self.roots().write.mode("overwrite").parquet(f"{self.folder}/bases/batch={last}")
        return True


def thread_stream(stream: DataFrame, folder: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Adds what the stream has now to the store. `parse` makes messages of a batch (of pages, say); a batch of which it
    makes none is an error."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        store = ThreadStore(batch.sparkSession, folder)
        store.add(batch if parse is None else require_rows(written(parse(batch), "parsed"), batch), number)
        store.compact()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_stream(spark: SparkSession, folder: str, pattern: str = "*", at_once: int = 100_000) -> DataFrame:
    """path and content of the page files of a folder and the folders in it, as a stream: a file is read once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(at_once)).load(folder).select("path", "content")
