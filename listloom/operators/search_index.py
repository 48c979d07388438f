"""A search index that is written once and answers many queries.

A folder holds, for each arrival of documents,

* postings (field, term, key, tf, length, category), in folders by a hash of the term and sorted by term within them;
* terms, sorted, so that words are found by their beginning from a file's statistics;
* variants: what is left of the first `PREFIX` characters of a term without up to `EDITS` of them, in folders by a hash of
  the variant. Two strings at most k edits apart share a variant with k characters left out (of their beginnings too), so a
  mistyped word is looked up by its own variants, and only what is found is measured;
* field sizes by category.

A query reads the term and variant folders of its words, then the posting folders of the terms that match. An arrival counts
once its field sizes, written last, are there; one that broke off is passed over and replaced by the next. Documents of an
arrival must not be in the index yet."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from ..sources.archive import folders
from .search import FIELDS, field_sizes, inverted_index, matches, scored, tolerance, words

PREFIX, EDITS = 10, 2
BUCKET_ROWS = 1 << 21  # postings that a folder is meant to hold
LISTED = 1 << 10  # so many matching terms are named in the filter; more are joined


def bucket(text: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int")


def variants(text: Column, times: int = EDITS) -> Column:
    """The text's beginning, and what is left of it without 1 to `times` characters."""

    def shorter(x: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        return F.when(F.length(x) > 0, each).otherwise(F.array().cast("array<string>"))

    levels = [F.array(F.substring(text, 1, PREFIX))]
    for _ in range(times):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], shorter))))
    return F.array_distinct(F.concat(*levels))


def left_out(word: str, times: int) -> list[str]:
    """The same for one word of a query."""
    found = level = {word[:PREFIX]}
    for _ in range(times):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        found = found | level
    return sorted(found)


class SearchIndex:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def arrivals(self) -> list[int]:
        return sorted(int(x.partition("=")[2]) for x in folders(self.spark, f"{self.folder}/sizes") if x.startswith("arrival="))

    def part(self, name: str) -> DataFrame:
        """A table of the index, of all complete arrivals."""
        paths = [f"{self.folder}/{name}/arrival={n}" for n in self.arrivals()]
        if not paths:
            raise FileNotFoundError(f"{self.folder} is no search index")
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def append(self, docs: DataFrame, key: str, fields: tuple[str, ...] = tuple(FIELDS), category: str = "category") -> SearchIndex:
        """Adds documents. The number of folders follows from the first arrival's terms and stays."""
        done = self.arrivals()
        number = max(done, default=-1) + 1
        shown = docs.select(F.col(key).alias("key"), *fields, F.col(category).alias("category"))
        sizes = written(field_sizes(shown, fields, "category"), "sizes")
        if done:
            buckets = self.part("sizes").agg(F.max("buckets")).first()[0]
        else:
            total = sizes.agg(F.sum("total")).first()[0] or 0
            buckets = 8 << max(0, math.ceil(math.log2(max(1, total / BUCKET_ROWS / 8))))

        def put(df: DataFrame, name: str, by: str | None = None) -> None:
            write = df.write.mode("overwrite")
            (write.partitionBy(by) if by else write).parquet(f"{self.folder}/{name}/arrival={number}")

        postings = inverted_index(shown, "key", fields, ("category",)).withColumn("bucket", bucket(F.col("term"), buckets))
        put(postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "key"), "postings", "bucket")
        now = self.spark.read.parquet(f"{self.folder}/postings/arrival={number}").select("term").distinct()
        known = self.part("terms").select("term") if done else now.limit(0)
        fresh = written(now.join(known, "term", "left_anti"), "terms")
        put(fresh.repartitionByRange("term").sortWithinPartitions("term"), "terms")
        left = fresh.select(F.explode(variants(F.col("term"))).alias("variant"), "term").withColumn("bucket", bucket(F.col("variant"), buckets))
        put(left.hint("rebalance", "bucket").sortWithinPartitions("bucket", "variant"), "variants", "bucket")
        put(sizes.withColumn("buckets", F.lit(buckets)).coalesce(1), "sizes")
        return self

    def matching(self, query: str) -> DataFrame:
        """The terms that match a word of the query: by their beginning, or within the query's tolerance."""
        asked, k = words(query), tolerance(query)
        found = self.part("terms").where(reduce(Column.__or__, [F.col("term").startswith(w) for w in asked])).select("term")
        if k:
            near = self._in_folders("variants", "variant", sorted({v for w in asked for v in left_out(w, k)}))
            found = found.union(near.where(matches(asked, k)).select("term"))
        return found.distinct()

    def _in_folders(self, name: str, column: str, values: list[str]) -> DataFrame:
        buckets = self.part("sizes").agg(F.max("buckets")).first()[0]
        there = F.col("bucket").isin(*sorted({r[0] for r in self.spark.createDataFrame([(v,) for v in values], "v string").select(bucket(F.col("v"), buckets)).collect()}))
        return self.part(name).where(there & F.col(column).isin(*values))

    def postings(self, query: str) -> DataFrame:
        """Postings of the terms that match. Few terms are named in the filter, so only their folders are read; many are
        joined by folder and term."""
        found = written(self.matching(query), "matching")
        listed = [r[0] for r in found.limit(LISTED + 1).collect()]
        if not listed:
            return self.part("postings").limit(0)
        if len(listed) <= LISTED:
            return self._in_folders("postings", "term", listed)
        buckets = self.part("sizes").agg(F.max("buckets")).first()[0]
        return self.part("postings").join(found.withColumn("bucket", bucket(F.col("term"), buckets)), ["bucket", "term"], "left_semi")

    def hits(self, query: str, weights: dict[str, float] = FIELDS, category: str | None = None) -> DataFrame:
        """key and score of all matching documents, as search.hits gives them for the documents themselves."""
        sizes, one = self.part("sizes"), F.lit(True) if category is None else F.col("category") == category
        if not words(query):
            return self.part("postings").select("key", F.lit(0.0).alias("score")).limit(0)
        found = self.postings(query).where(one & F.col("field").isin(*weights))
        return scored(found, sizes.where(one), "key", weights)
