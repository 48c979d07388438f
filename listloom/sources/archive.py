"""Reading and writing archives: message tables of several sources, page folders, index listings, manifests, sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cleaned_name
from ..schemas import MANIFEST, MESSAGES
from ..session import configured


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete folders (with Spark's mark of success) in a folder; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()] if fs.exists(at) else []
    return [n for n in names if exists(spark, f"{path}/{n}/_SUCCESS")]


def first_existing(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of the Parquet paths that is there; an error if none is."""
    for p in paths:
        if exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError(f"none of {', '.join(paths)} exists")


def pages(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """path, name and content of the files of a folder that match."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def numbered_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages msgN.html with their number."""
    found = pages(spark, folder, "msg*.html")
    return found.withColumn("message_number", F.regexp_extract("name", r"^msg(\d+)\.html$", 1).try_cast("long"))


def page_url(kind: str, base: str, topic_base: str | None = None) -> Column:
    """URLs by source. live: number padded to five digits (not cut if longer); pipermail: the first underscore of the file
    is a slash; legacy: the file; topic: numbered topic files have a folder of their own."""
    if kind == "live":
        return F.concat(F.lit(f"{base}msg"), F.format_string("%05d", "message_number"), F.lit(".html"))
    if kind == "pipermail":
        return F.concat(F.lit(base), F.regexp_replace("source_file", "^([^_]*)_", "$1/"))
    if kind == "topic":
        return F.concat(F.when(F.col("source_file").rlike(r"^topic\d{3}\.html$"), F.lit(topic_base or base)).otherwise(F.lit(base)), F.col("source_file"))
    return F.concat(F.lit(base), F.col("source_file"))


def shaped(df: DataFrame, source: str, url: Column | None = None) -> DataFrame:
    """The shared columns, typed nulls where a source has none; a URL that a parser found is kept."""
    df = df.withColumn("source", F.lit(source))
    if url is not None:
        df = df.withColumn("source_url", F.coalesce("source_url", url) if "source_url" in df.columns else url)
    typed = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MESSAGES.fields]
    return df.select(*typed).withColumn("from_name", cleaned_name(F.col("from_name"))).select(*MESSAGES.names)


def merged(sources: list[DataFrame]) -> DataFrame:
    if not sources:
        raise ValueError("no source is there")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def load_sources(spark: SparkSession, files: dict[str, str], urls: dict[str, Column] | None = None) -> DataFrame:
    """The union of those source tables that exist; an error if none does."""
    there = {k: p for k, p in files.items() if exists(spark, p)}
    return merged([shaped(spark.read.parquet(p), k, (urls or {}).get(k)) for k, p in there.items()])


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """alias, canonical from a JSON object; of a repeated alias the last counts; nothing if the file isn't there."""
    empty = spark.createDataFrame([], "alias string, canonical string")
    if not exists(spark, path):
        return empty
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r'("(?:[^"\\]|\\.)*")\s*:\s*"(?:[^"\\]|\\.)*"'), F.lit(0))).alias("place", "pair"))
    parsed = pairs.select("place", F.explode(F.from_json(F.concat(F.lit("{"), F.col("pair"), F.lit("}")), "map<string,string>")).alias("alias", "canonical"))
    return parsed.groupBy("alias").agg(F.max_by("canonical", "place").alias("canonical"))


def index_listing(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """timestamp and url from lines `timestamp url`; other lines, and URLs that don't match, go."""
    parts = spark.read.text(path).select(F.split("value", " ", 2).alias("p")).where(F.size("p") == 2)
    return parts.select(F.trim(F.col("p")[0]).alias("timestamp"), F.trim(F.col("p")[1]).alias("url")).where(F.col("url").rlike(pattern))


def harvested_links(listing: DataFrame, html: str, base: str, pattern: str) -> DataFrame:
    """Links of index pages, resolved against the base, each once, with the page's replay timestamp."""
    hrefs = listing.select(F.regexp_extract("url", r"/web/(\d{14})", 1).alias("timestamp"), F.explode(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]+)"'), F.lit(1))).alias("href"))
    hrefs = hrefs.where(F.col("href").rlike(pattern))
    url = F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(F.lit(base), F.regexp_replace("href", "^/+", "")))
    return hrefs.select("timestamp", url.alias("url")).groupBy("url").agg(F.min("timestamp").alias("timestamp")).select("timestamp", "url")


# How the files of the sources are named.
DATED, NUMBERED, MONTHLY = r"(\d{2}\w{3}\d+\.html)$", r"(?i)(topic\d{3}\.html)$", r"(\d{4}-\w+)/(\d+\.html)$"


def local_name(url: Column, source: str = "pipermail") -> Column:
    """File name of a snapshot: the dated file of a legacy page, the numbered file of a topic page, month_number of a monthly
    page; else the last part of the path, as it stands."""
    found = {"legacy": F.regexp_extract(url, DATED, 1), "topic": F.regexp_extract(url, NUMBERED, 1)}
    monthly = F.when(url.rlike(MONTHLY), F.concat_ws("_", F.regexp_extract(url, MONTHLY, 1), F.regexp_extract(url, MONTHLY, 2)))
    return F.coalesce(F.nullif(found[source], F.lit("")) if source in found else monthly, F.element_at(F.split(url, "/"), -1))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def write_manifest(entries: DataFrame, path: str) -> None:
    entries.select(*MANIFEST.names).orderBy("url").write.json(path)


def write_by_year(messages: DataFrame, path: str) -> None:
    """Parquet in a folder for each year."""
    messages.withColumn("year", F.year("date")).write.partitionBy("year").parquet(path)


def json_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row `value`: a JSON object of a small table's keys and values, as `overrides` reads it. Of equal keys one stays."""
    pairs = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.min(F.col(value).cast("string")).alias("v"))
    return pairs.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v"))))).alias("value"))


def write_clustered(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """A table in buckets of `key`, sorted by it: joins and groups on the key of tables with as many buckets need no
    exchange. A bucket is written as one sorted file."""
    write = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    (write if path is None else write.option("path", path)).saveAsTable(table)


def greatest(spark: SparkSession, path: str, column: str = "message_number") -> int | None:
    """The greatest value of a Parquet column, from the files' footers: the rows aren't read."""
    with configured(spark, FOOTERS):
        return spark.read.parquet(path).agg(F.max(column)).first()[0]


FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def declared(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns cast to a declared schema."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines: a feed, search documents, snippets."""
    df.write.json(path)
