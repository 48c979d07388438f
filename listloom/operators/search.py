"""Typo-tolerant search over an inverted index, ranked by BM25 with field weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncated

FIELDS = {"subject": 5.0, "from_name": 3.0}
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search_documents(messages: DataFrame) -> DataFrame:
    """What is searched: subject, from_name, body, category, year (0 for none), date and url."""
    return messages.select("subject", "from_name", F.col("body_clean").alias("body"), "category", F.coalesce(F.year("date"), F.lit(0)).alias("year"), F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")).alias("date"), "url")


def snippets(docs: DataFrame, size: int = 500, order: tuple[str, ...] = ("date", "body")) -> DataFrame:
    """The beginning of each URL's body (null is empty); of documents with one URL, the last one's in `order`."""
    last = F.max_by(F.coalesce("body", F.lit("")), F.struct(*order))
    return docs.groupBy("url").agg(F.substring(last, 1, size).alias("snippet"))


def shown(found: DataFrame, docs: DataFrame, snippets: DataFrame, key: str = "url", size: int = 200) -> DataFrame:
    """Hits (key, score) as they are listed: title, author and date of the document, and the beginning of its snippet."""
    rows = found.join(docs.select(key, "subject", "from_name", "category", "date"), key)
    rows = rows.join(snippets.withColumnRenamed("url", "_url"), F.col(key) == F.col("_url"), "left").drop("_url")
    return rows.withColumn("snippet", truncated(F.coalesce("snippet", F.lit("")), size))


def inverted_index(docs: DataFrame, key: str, fields: tuple[str, ...] = tuple(FIELDS), beside: tuple[str, ...] = ()) -> DataFrame:
    """field, term, key, tf, length (terms of the field), and columns that stand beside them."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("terms")) for f in fields))
    flat = docs.select(key, *beside, F.explode(parts).alias("p")).select(key, *beside, "p.field", F.size("p.terms").cast("long").alias("length"), F.explode("p.terms").alias("term"))
    return flat.groupBy("field", "term", key, "length", *beside).agg(F.count("*").alias("tf"))


def tolerance(query: str) -> int:
    return min(len(query.strip()) // 4, 2)


def words(query: str) -> list[str]:
    return sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})


def matches(asked: list[str], k: int) -> Column:
    """Whether a term begins with one of the words or is at most k edits away from one."""
    return reduce(Column.__or__, [F.col("term").startswith(w) | (F.levenshtein("term", F.lit(w), k).between(0, k) if k else F.lit(False)) for w in asked])


def field_sizes(docs: DataFrame, fields: tuple[str, ...], *by: str) -> DataFrame:
    """Documents and terms of each field."""
    sizes = docs.select(*by, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.size(terms(F.col(f))).alias("n")) for f in fields))).alias("p"))
    return sizes.groupBy("p.field", *by).agg(F.count("*").alias("docs"), F.sum("p.n").alias("total"))


def scored(found: DataFrame, sizes: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """key and score from postings of matching terms, and field sizes."""
    sizes = sizes.groupBy("field").agg(F.sum("docs").alias("docs"), (F.sum("total") / F.sum("docs")).alias("mean"))  # one row a field
    frequent = found.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("field")]
    joined = found.join(frequent, ["field", "term"]).join(F.broadcast(sizes), "field")
    return joined.groupBy(key).agg(F.round(F.sum(weight * idf * tf), 6).alias("score"))


def hits(docs: DataFrame, query: str, key: str, weights: dict[str, float] = FIELDS, category: str | None = None) -> DataFrame:
    """key and score of all matching documents. A term of the index matches a word of the query if it begins with it or is
    at most `tolerance` edits away (counted for the whole query). Nothing matches an empty query.

    Statistics cover all documents: terms are matched first, so what is shuffled are postings of matching terms. For many
    queries over the same documents see search_index."""
    asked = words(query)
    pool = docs if category is None else docs.where(F.col("category") == category)
    index = inverted_index(pool, key, tuple(weights))
    if not asked:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    return scored(index.where(matches(asked, tolerance(query))), field_sizes(pool, tuple(weights)), key, weights)


def top(found: DataFrame, key: str, n: int = 50) -> DataFrame:
    return found.orderBy(F.desc("score"), key).limit(n)
