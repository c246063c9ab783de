"""Evaluation of retrieval and comparison of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(ranked: DataFrame, good: Column, *, query: str = "query", place: str = "place") -> DataFrame:
    """Of each query the place of its first good result, and whether it is the first or among five."""
    first = ranked.groupBy(query).agg(F.min(F.when(good, F.col(place))).alias("first"))
    return first.select(query, "first", F.coalesce((F.col("first") == 1), F.lit(False)).alias("hit1"), F.coalesce(F.col("first") <= 5, F.lit(False)).alias("hit5"))


def bucket(importance: Column) -> Column:
    """Six fixed buckets of importance, and one for none."""
    edges = [(0.2, "<=0.2"), (0.35, "<=0.35"), (0.5, "<=0.5"), (0.7, "<=0.7"), (0.85, "<=0.85")]
    out = F.when(importance.isNull(), "none")
    for most, name in edges:
        out = out.when(importance <= most, name)
    return out.otherwise(">0.85")


def histogram(rows: DataFrame, importance: Column) -> DataFrame:
    return rows.groupBy(bucket(importance).alias("bucket")).agg(F.count("*").alias("n"))


def movers(compared: DataFrame, most: int = 20) -> DataFrame:
    """Of the rows of compare() in both snapshots the `most` that rose and that fell most: direction, place, id, delta."""
    both = compared.where("found = 'both'").select("id", "delta")
    up = both.orderBy(F.desc("delta"), "id").limit(most).select(F.lit("up").alias("direction"), F.row_number().over(Window.orderBy(F.desc("delta"), "id")).alias("place"), "id", "delta")
    down = both.orderBy("delta", F.desc("id")).limit(most).select(F.lit("down").alias("direction"), F.row_number().over(Window.orderBy("delta", F.desc("id"))).alias("place"), "id", "delta")
    return up.union(down)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, where it is (both, before, after), the change of importance (none counts as 0.5), and of kind."""
    b = before.select(F.col("id"), F.col("importance").alias("ib"), F.col("kind").alias("kb"), F.lit(True).alias("inb"))
    a = after.select(F.col("id"), F.col("importance").alias("ia"), F.col("kind").alias("ka"), F.lit(True).alias("ina"))
    j = b.join(a, "id", "full_outer")
    where = F.when(F.col("inb") & F.col("ina"), "both").when(F.col("inb"), "before").otherwise("after")
    delta = F.when(F.col("inb") & F.col("ina"), F.coalesce("ia", F.lit(0.5)) - F.coalesce("ib", F.lit(0.5)))
    moved = F.when(F.col("inb") & F.col("ina") & ~F.col("kb").eqNullSafe(F.col("ka")), F.concat_ws(">", F.coalesce("kb", F.lit("none")), F.coalesce("ka", F.lit("none"))))
    return j.select("id", where.alias("found"), delta.alias("delta"), moved.alias("kind_change"))
