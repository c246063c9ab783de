"""Similar pairs by an inverted index, and greedy passes over them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..sources.tables import shared_folder
from . import blocks


def set_pairs(rows: DataFrame, key: str, items: str, least: float, measure: str = "jaccard") -> DataFrame:
    """i < j and their similarity (jaccard or dice of two sets), where it is at least `least` > 0.

    A pair shares an item among the first n - ceil(share * n) + 1 of each side in the order of rarity, so
    only those items are joined. What comes after a pair's last shared one bounds its overlap; for pairs that can
    still reach it the overlap is counted on whole sets. Pairs of empty sets are left out.
    """
    if not least > 0:
        raise ValueError("the least similarity must be positive")
    # For Jaccard t, an overlap of at least t * n; for Dice t, of t * n / (2 - t).
    share = least if measure == "jaccard" else least / (2 - least)
    sets = rows.select(F.col(key).alias("i"), F.array_distinct(items).alias("s")).where(F.size("s") > 0)
    each = sets.select("i", F.explode("s").alias("x"))
    rarity = each.groupBy("x").agg(F.count("*").alias("df"))
    ranked = each.join(rarity, "x").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o"))
    prefix = ranked.select("i", F.size("o").alias("n"), F.posexplode(F.slice("o", F.lit(1), F.size("o") - F.ceil(F.size("o") * F.lit(share) - 1e-9).cast("int") + 1)).alias("p", "o")).select("i", F.col("o.x").alias("x"), "n", (F.col("p") + 1).alias("p"))
    other = prefix.select(F.col("i").alias("j"), "x", F.col("n").alias("m"), F.col("p").alias("q"))
    met = prefix.join(other, "x").where(F.col("i") < F.col("j")).where((F.col("n") >= F.lit(share) * F.col("m") - 1e-9) & (F.col("m") >= F.lit(share) * F.col("n") - 1e-9))
    met = met.groupBy("i", "j").agg(F.count("*").alias("c"), F.max("p").alias("p"), F.max("q").alias("q"), F.first("n").alias("n"), F.first("m").alias("m"))
    wanted = (F.col("n") + F.col("m")) * F.lit(least / (1 + least) if measure == "jaccard" else least / 2)
    near = met.where(F.col("c") + F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= wanted - 1e-9).select("i", "j")
    both = near.join(sets, "i").join(sets.select(F.col("i").alias("j"), F.col("s").alias("t")), "j")
    overlap = F.size(F.array_intersect("s", "t"))
    total = F.size("s") + F.size("t")
    similarity = overlap / (total - overlap) if measure == "jaccard" else 2.0 * overlap / total
    return both.select("i", "j", similarity.alias("similarity")).where(F.col("similarity") >= least)


def tf_cosine_pairs(rows: DataFrame, key: str, terms: str, least: float) -> DataFrame:
    """i < j and the cosine of their term counts, where it is at least `least` > 0.

    Common words make so many rows alike at low thresholds that the pairs grow with the square of the rows. So nothing but
    the rows is stored, in blocks; each two blocks meet in one task, which gives their pairs out as it finds them.
    """
    if not least > 0:
        raise ValueError("the least similarity must be positive")
    return blocks.similar(_stored(blocks.pack(rows, key, terms)), "cosine", least)


def _stored(df: DataFrame) -> DataFrame:
    """The rows from the folder that driver and executors share, which cuts lineage."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.stored_at = path
    return out


def _drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(pairs: DataFrame) -> DataFrame:
    """id and component (its smallest id) of all ends of pairs (i, j): the least of the neighbours' again and again, by doubling."""
    both = _stored(pairs.select(F.col("i").alias("a"), F.col("j").alias("b")).union(pairs.select("j", "i")).distinct())
    of = _stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(of.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        lower = of.join(near, "id").select("id", F.least("component", "least").alias("to"), F.col("component").alias("was"))
        up = of.select(F.col("id").alias("to"), F.col("component").alias("next"))
        after = _stored(lower.join(up, "to").select("id", F.least("to", "next").alias("component"), "was"))
        _drop(of)
        of = after
        if of.where("component <> was").isEmpty():
            _drop(both)
            return of.select("id", "component")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a whole number n in the order of their distinct keys: the key itself where it is one."""
    if isinstance(rows.schema[key].dataType, IntegralType):
        return rows.withColumn("n", F.col(key).cast("bigint"))
    from .hygiene import with_numbers

    return rows.join(with_numbers(rows.select(key), [F.col(key)]), key)


def sweep(stored: DataFrame, measure: str, least: float) -> DataFrame:
    """n and the first turn b that removes it, for all rows of blocks (keys n, longs z) that a pass in the order of n removes.

    A turn removes later rows alike whose z is not greater; a row that is gone has no turn. Who has an earlier turn
    undecided waits; each round decides the others, removes what they do, and goes on with the rest. Pairs are looked
    at where two blocks meet and are never stored, so that a round leaves a few bytes for each row.
    """
    every = _stored(stored.select(F.explode("keys").alias("n")))
    first = lambda asks, found: blocks.first_found(stored, _roles(every, asks, found), measure, least)
    turns, open_, mine = [], every, []
    while True:
        waits = _stored(first(open_, open_))
        turns.append(_stored(open_.join(waits, "n", "left_anti")))
        mine.append(waits)
        if waits.isEmpty():
            break
        open_ = _stored(waits.select("n").join(first(waits, turns[-1]), "n", "left_anti"))
        mine.append(open_)
        if open_.isEmpty():
            break
    all_turns = reduce(DataFrame.union, turns)
    out = _stored(first(every.join(all_turns, "n", "left_anti"), all_turns))
    _drop(every, *turns, *mine)
    return out


def _roles(every: DataFrame, asks: DataFrame, found: DataFrame) -> DataFrame:
    one = lambda df, role: df.select("n", F.lit(role).alias("role"))
    all_ = one(every, 0).union(one(asks, blocks.ASK)).union(one(found, blocks.FOUND))
    return all_.groupBy("n").agg(F.bit_or("role").cast("tinyint").alias("role"), F.lit(None).cast("bigint").alias("until"))


def greedy_removals(pairs: DataFrame, loser: Column) -> DataFrame:
    """What a pass over i, and for each i over j > i, removes: node and the turn `by` that removed it first.

    A turn is skipped if its i was removed in an earlier one; a j that is gone is passed over; an i that
    loses its own turn goes on with it. loser names the column ("i" or "j") that a similar pair
    loses. Found by repetition from "nothing was removed before" until no turn changes, which takes
    as many rounds as removals depend on each other, not as many as there are rows.
    """
    p = _stored(pairs.select("i", "j", loser.alias("lost")).distinct())
    removed = _stored(p.where("false").select(F.col("i").alias("node"), F.col("i").alias("by")))
    while True:
        a = removed.select(F.col("node").alias("ni"), F.col("by").alias("bi"))
        b = removed.select(F.col("node").alias("nj"), F.col("by").alias("bj"))
        open_ = p.join(a, p.i == F.col("ni"), "left").join(b, p.j == F.col("nj"), "left")
        # Who was removed in a turn before i's: i by another's turn, j by an earlier one.
        valid = open_.where((F.col("bi").isNull() | (F.col("bi") >= F.col("i"))) & (F.col("bj").isNull() | (F.col("bj") >= F.col("i"))))
        now = _stored(valid.groupBy(F.col("lost").alias("node")).agg(F.min("i").alias("by")))
        same = now.join(removed, ["node", "by"], "left_anti").limit(1).count() + removed.join(now, ["node", "by"], "left_anti").limit(1).count()
        _drop(removed)
        removed = now
        if not same:
            _drop(p)
            return removed
