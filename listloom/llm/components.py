"""Connected components of an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _minimum(pairs: DataFrame) -> DataFrame:
    """u, v, m: m is the smallest of u and all its v. Minima are combined before the shuffle; the join lets AQE split a hot u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _each(rows: DataFrame, *pairs: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """Each of the pairs of columns of each row. Not a union, which would plan and run what `rows` comes from once for each."""
    made = F.array(*(F.struct(F.col(x).alias(names[0]), F.col(y).alias(names[1])) for x, y in pairs))
    return rows.select(F.inline(made))


def _round(edges: DataFrame) -> DataFrame:
    both = _each(edges, ("a", "b"), ("b", "a"), names=("u", "v"))
    large = _minimum(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = _minimum(down)
    return _each(small, ("v", "m"), ("u", "m"), names=("a", "b")).where("a != b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Gives node, component (the smallest node it is connected with) for every node that isn't
    itself the smallest of its component. Each round is written to the shared folder; only a count and a checksum reach
    the driver. Null ends and loops are dropped."""
    now = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = written(_round(now), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
