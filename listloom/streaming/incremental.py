"""Incremental runs: append new messages so that the result equals a rebuild, and windowed volume with late data."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import latest_version, unseen
from ..operators.threads import thread_roots
from ..scratch import shared_dir
from ..session import configured
from ..sources.archive import exists


def upserted(known: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """Known messages and new ones (those already known are skipped, or with `replace` take their place); reply chains are
    rebuilt over the union, as a late message may join others."""
    fresh = new if replace else unseen(new, known)
    return thread_roots(latest_version(known, fresh))


def upsert_stream(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Each batch of new messages gives the next version of the store, a folder; a version is never overwritten while it is
    read. A batch that is repeated after a failure writes its own version again."""

    def step(batch: DataFrame, number: int) -> None:
        spark, last = batch.sparkSession, f"{store}/v{number - 1}"
        if number and not exists(spark, f"{last}/_SUCCESS"):
            raise FileNotFoundError(f"{last} is gone: the batch alone would become the store")
        out = upserted(spark.read.parquet(last), batch) if number else thread_roots(batch)
        out.write.mode("overwrite").parquet(f"{store}/v{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_version(spark: SparkSession, store: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    names = (f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))
    numbers = sorted((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), reverse=True)
    return spark.read.parquet(next(f"{store}/v{n}" for n in numbers if exists(spark, f"{store}/v{n}/_SUCCESS")))


def volume(events: DataFrame, at: str = "ts", kind: str = "event_type", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows in each window by kind; rows later than the watermark are dropped from a stream. A batch counts all."""
    by = events.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count("*").alias("n"))
    return by.select(F.col("window.start").alias("start"), kind, "n")


def run_to_table(df: DataFrame, name: str, mode: str = "complete", settings: dict[str, str] | None = None) -> DataFrame:
    """All that a stream has now: each batch is written to the shared folder; of complete results the last one is read, of
    appended or updated rows all. `settings` hold for this query only."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v{number}")

    with configured(spark, settings or {}):
        query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return newest_version(spark, folder) if mode == "complete" else spark.read.schema(df.schema).parquet(f"{folder}/v*")
