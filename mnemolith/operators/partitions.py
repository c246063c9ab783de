"""Communities of a graph, what they are about, and which of them a query should visit.

Communities come from local moves that raise modularity, made as joins over the whole graph: in each
round every node looks up the weight of its edges into each neighbouring community, and those move whose
gains can't get in each other's way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text
from ..functions.rules import Has, any_of
from .pairs import _drop, _stored
from .recall import top_k

ROUNDS, SMALLEST = 20, 3
BROAD = any_of([Has(p, True) for p in P.BROAD_QUERIES])


def _undirected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, w in both directions: no loops, known ends, parallel edges summed, 0.5 where there is no weight."""
    e = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.coalesce("weight", F.lit(0.5)).alias("w"))
    ids = nodes.select("id").distinct()
    for end in ("a", "b"):
        e = e.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    e = e.groupBy("a", "b").agg(F.sum("w").alias("w"))
    return e.select("a", "b", "w").union(e.select(F.col("b"), F.col("a"), "w"))


def modularity(place: DataFrame, both: DataFrame) -> float:
    """Modularity of communities (id, c) over edges in both directions (a, b, w); 0 without edges."""
    at = both.join(place.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(place.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    of = at.groupBy("ca").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    r = of.agg(F.sum("tot").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("tot") * F.col("tot")).alias("q")).first()
    return r.i / r.m - r.q / (r.m * r.m) if r.m else 0.0


def move_once(place: DataFrame, both: DataFrame, strength: DataFrame, total: float) -> DataFrame:
    """One round of moves that can't lower modularity: id, c and moved of every node.

    Every node finds the neighbouring community with the greatest gain over its own. Of neighbours that both would move
    only the one with the greater gain may, so that no two that share an edge move at once. Others meet only where they
    join one community: there they are ordered by gain, and one moves if its gain exceeds what all before it could cost
    (its strength times the sum of theirs, over all weight). Each move then adds to modularity whatever the others do.
    """
    inside = place.join(strength, "id", "left").groupBy("c").agg(F.sum(F.coalesce("k", F.lit(0.0))).alias("tot"))
    at = place.select(F.col("id").alias("b"), F.col("c").alias("to"))
    links = both.join(at, "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("w").alias("into"))
    mine = place.join(strength, "id")
    # The own community too, with no links where there are none.
    options = links.join(mine, "id").unionByName(mine.select("id", F.col("c").alias("to"), F.lit(0.0).alias("into"), "c", "k")).groupBy("id", "to", "c", "k").agg(F.sum("into").alias("into"))
    options = options.join(inside.select(F.col("c").alias("to"), "tot"), "to")
    gain = F.col("into") - F.col("k") * (F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / F.lit(float(total))
    best = options.withColumn("gain", gain).groupBy("id", "k").agg(F.max(F.struct("gain", F.col("c") == F.col("to"), "to")).alias("o"), F.max(F.when(F.col("c") == F.col("to"), F.col("gain"))).alias("own"))
    wish = _stored(best.select("id", "k", (F.col("o.gain") - F.col("own")).alias("gain"), F.col("o.to").alias("to")).where(F.col("gain") > 1e-10))
    rank = lambda p: F.struct(F.col(f"{p}gain"), F.xxhash64(f"{p}id"), F.col(f"{p}id"))
    other = wish.select(F.col("id").alias("n_id"), F.col("gain").alias("n_gain"))
    beaten = both.join(wish.select(F.col("id").alias("a"), "id", "gain"), "a").join(other.withColumn("b", F.col("n_id")), "b").where(rank("n_") > rank("")).select("id").distinct()
    into = Window.partitionBy("to").orderBy(F.desc("gain"), "id").rowsBetween(Window.unboundedPreceding, -1)
    free = wish.join(beaten, "id", "left_anti").withColumn("cost", F.col("k") * F.coalesce(F.sum("k").over(into), F.lit(0.0)) / F.lit(float(total)))
    moves = free.where(F.col("gain") > F.col("cost") + 1e-10).select("id", F.col("to").alias("new"))
    after = _stored(place.join(moves, "id", "left").select("id", F.coalesce("new", "c").alias("c"), F.col("new").isNotNull().alias("moved")))
    _drop(wish)
    return after


def communities(nodes: DataFrame, edges: DataFrame, *, rounds: int = ROUNDS, smallest: int = SMALLEST, seen: list[float] | None = None) -> DataFrame:
    """id and community (from 0, the larger ones first), every node once; one community if no edge has weight.

    Moves end when no node gains, or after `rounds`. A list given as seen gets the modularity before the first round and
    after each.
    """
    both = _stored(_undirected(nodes, edges))
    total = both.agg(F.sum("w").alias("m")).first().m
    if not total:
        return nodes.select("id").distinct().withColumn("community", F.lit(0).cast("bigint"))
    strength = _stored(both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
    place = _stored(nodes.select("id").distinct().select("id", F.col("id").alias("c")))
    if seen is not None:
        seen.append(modularity(place, both))
    for _ in range(rounds):
        after = move_once(place.select("id", "c"), both, strength, total)
        _drop(place)
        place = after
        if place.where("moved").isEmpty():
            break
        if seen is not None:
            seen.append(modularity(place.select("id", "c"), both))
    place = place.select("id", "c")
    while True:
        size = place.groupBy("c").agg(F.count("*").alias("n"))
        small = size.where(F.col("n") < smallest).select("c")
        at = place.select(F.col("id").alias("b"), F.col("c").alias("to"))
        out = both.join(place.select(F.col("id").alias("a"), "c"), "a").join(at, "b").where("c <> to").join(small, "c", "left_semi").groupBy("c", "to").agg(F.sum("w").alias("w"))
        into = out.groupBy("c").agg(F.max(F.struct("w", "to")).alias("m")).select("c", F.col("m.to").alias("to"))
        # Of two small ones that choose each other, the one with the larger name moves.
        back = into.select(F.col("c").alias("to"), F.col("to").alias("c"))
        into = into.join(back.withColumn("mutual", F.lit(True)), ["c", "to"], "left").where("mutual is null or c > to").select("c", F.col("to").alias("new"))
        into = _stored(into)
        if not into.limit(1).count():
            break
        place = _stored(place.join(into, "c", "left").select("id", F.coalesce("new", "c").alias("c")))
    names = place.groupBy("c").agg(F.count("*").alias("n"))
    from .hygiene import with_numbers

    numbered = with_numbers(names, [F.desc("n"), F.col("c")]).select("c", F.col("n").alias("community"))
    return place.join(numbered, "c").select("id", F.col("community").cast("bigint").alias("community"))


def centroids(members: DataFrame, *, vector_col: str = "embedding", by: str = "community") -> DataFrame:
    """The mean vector of each community's vectors; communities without any have no row."""
    each = members.where(F.col(vector_col).isNotNull()).select(by, F.posexplode(vector_col).alias("p", "x"))
    mean = each.groupBy(by, "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda e: e["x"]).alias("centroid"))


def keywords(members: DataFrame, *, text_col: str = "concept", by: str = "community", most: int = 20) -> DataFrame:
    """The words that most members of a community have, each counted once a member: word, n, place from 1."""
    clean = F.regexp_replace(F.lower(text_col), r"[^a-z0-9à-ÿ\s-]", " ")
    words = F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(P.KEYWORD_STOPWORDS)))
    n = members.select(by, F.explode(words).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word"))).where(F.col("place") <= most)


def adjacent(place: DataFrame, edges: DataFrame, *, most: int = 5) -> DataFrame:
    """For each community those with most edges across: community, other, shared, place from 1."""
    a = place.select(F.col("id").alias("source"), F.col("community").alias("ca"))
    b = place.select(F.col("id").alias("target"), F.col("community").alias("cb"))
    cross = edges.join(a, "source").join(b, "target").where("ca <> cb")
    n = cross.select(F.col("ca").alias("community"), F.col("cb").alias("other")).union(cross.select("cb", "ca")).groupBy("community", "other").agg(F.count("*").alias("shared"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("shared"), "other"))).where(F.col("place") <= most)


def summary(words: DataFrame, members: DataFrame, *, text_col: str = "concept") -> DataFrame:
    """Eight keywords and the beginning of the heaviest member, for each community."""
    top = members.where(F.col(text_col).isNotNull()).groupBy("community").agg(F.max_by(text_col, F.struct(F.coalesce("weight", F.lit(0.0)), "id")).alias("t"))
    listed = words.where("place <= 8").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), ", ").alias("w"))
    snippet = F.regexp_replace(F.substring("t", 1, 120), "\n", " ")
    return top.join(listed, "community", "left").select("community", F.concat(F.coalesce("w", F.lit("")), F.lit(". Top: "), snippet, F.lit("...")).alias("summary"))


def route(partitions: DataFrame, queries: DataFrame, *, least: float = 0.25, at_least: int = 0, at_most: int = 5, searched: DataFrame | None = None) -> DataFrame:
    """Which communities (community, centroid) each query (query, text, vector) visits: query, community, similarity, place.

    A query without vector or with a broad wording visits the first ones; others the most similar at or above `least`,
    `at_least` of them in any case. Both ids are whole numbers. With searched (query, community) those are left out, and
    the next ones take their places.
    """
    broad = F.col("vector").isNull() | F.coalesce(BROAD.column(F.col("text")), F.lit(False))
    more = 0 if searched is None else searched.groupBy("query").agg(F.countDistinct("community").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    k = max(at_most, at_least) + more
    # The vectors' queries look for the nearest centroids, the others take the first k.
    near = top_k(partitions.select(F.col("community").alias("id"), F.col("centroid").alias("embedding")), queries.where(~broad).select(F.col("query").alias("id"), F.col("vector").alias("embedding")), k)
    near = near.select("query", F.col("id").alias("community"), F.col("score").alias("similarity"))
    first = F.broadcast(partitions.select("community").distinct().orderBy("community").limit(k))  # k rows
    wide = queries.where(broad).select(F.col("query").cast("bigint").alias("query")).join(first, F.lit(True)).select("query", F.col("community").cast("bigint").alias("community"), F.lit(None).cast("double").alias("similarity"))
    both = near.union(wide)
    if searched is not None:
        both = both.join(searched.select("query", "community").distinct(), ["query", "community"], "left_anti")
    order = Window.partitionBy("query").orderBy(F.coalesce(-F.col("similarity"), F.lit(0.0)), "community")
    chosen = F.col("similarity").isNull() | (F.col("similarity") >= least) | (F.col("place") <= at_least)
    return both.withColumn("place", F.row_number().over(order)).where(chosen & (F.col("place") <= at_most)).select("query", "community", "similarity", "place")


def execute(partitions: DataFrame, queries: DataFrame, searched: DataFrame, mode: str = "full", *, full_sweep: bool = False, fraction: float | None = None, at_most: int = 5, least: float = 0.25, at_least: int = 0) -> DataFrame:
    """query and community to sweep, for queries with a session whose searched communities (session, community) are known.

    full: the routed ones, that share of them (one at least) if a fraction is given, or all if full_sweep; continue: all
    not searched yet, or all if none is left; targeted: those routed among what is not searched, or all of that if none
    is routed, or all if none is left.
    """
    every = queries.select("query").join(F.broadcast(partitions.select("community").distinct()), F.lit(True))  # what full sweeps return
    options = {"least": least, "at_least": at_least, "at_most": at_most}
    if mode == "full":
        if full_sweep:
            return every
        routed = route(partitions, queries, **options)
        if fraction is not None and 0 < fraction <= 1:
            n = routed.groupBy("query").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(fraction))).alias("_n"))
            routed = routed.join(n, "query").where(F.col("place") <= F.col("_n"))
        return routed.select("query", "community")
    known = queries.select("query", "session").join(searched, "session").select("query", "community").distinct()
    left = every.join(known, ["query", "community"], "left_anti")
    done = queries.select("query").join(left.select("query").distinct(), "query", "left_anti")
    again = every.join(done, "query", "left_semi")
    if mode == "continue":
        return left.union(again)
    if mode != "targeted":
        raise ValueError(f"unknown mode {mode}")
    routed = route(partitions, queries.join(done, "query", "left_anti"), searched=known, **options).select("query", "community")
    unrouted = left.join(routed.select("query").distinct(), "query", "left_anti")
    return routed.union(unrouted).union(again)


def covered(searched: DataFrame, swept: DataFrame) -> DataFrame:
    """The table of searched communities (session, community) with those swept now, also where a sweep failed."""
    return searched.union(swept.select("session", "community")).distinct()


def without_sessions(searched: DataFrame, tenant: str) -> DataFrame:
    """The table without a tenant's sessions, which are named by it alone or begin with it and _, - or :."""
    if tenant in ("", "master"):
        return searched
    own = (F.col("session") == tenant) | F.substring("session", 1, len(tenant) + 1).isin(*(tenant + c for c in "_-:"))
    return searched.where(~own)


def still_to_search(partitions: DataFrame, searched: DataFrame, mode: str = "continue") -> DataFrame:
    """continue: those not searched yet, all if none is left; full: all."""
    if mode == "full":
        return partitions
    left = partitions.join(searched.select("community").distinct(), "community", "left_anti")
    return left if left.limit(1).count() else partitions


def _halves(balance: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a community after each other, by member and earlier neighbour; a row for each member when its last row was read."""
        community, side, size, member, weight = None, bytearray(), [0, 0], None, [0.0, 0.0]

        def decide():
            c, nth, n, id_ = member
            if nth == 0 or nth == n // 2:
                second = int(nth > 0)
            else:
                second = int(weight[0] - balance * size[0] < weight[1] - balance * size[1])
                size[second] += 1
            side[nth] = second + 1
            return id_, c, bool(second)

        for df in batches:
            out = []
            for c, nth, n, id_, other, w in df[["community", "nth", "n", "id", "other", "w"]].itertuples(index=False):
                if member is None or (c, nth) != member[:2]:
                    if member is not None:
                        out.append(decide())
                    if c != community:
                        # One byte for each member: 1 for the first half, 2 for the second. Both leaders stand from the start.
                        community, side, size = c, bytearray(n), [1, 1]
                        side[0], side[n // 2] = 1, 2
                    member, weight = (c, nth, n, id_), [0.0, 0.0]
                if other >= 0 and side[other]:
                    weight[side[other] - 1] += w
            yield pd.DataFrame(out, columns=["id", "community", "second"])
        if member is not None:
            yield pd.DataFrame([decide()], columns=["id", "community", "second"])

    return run


def split_large(members: DataFrame, nodes: DataFrame, edges: DataFrame, *, largest: int = 500, balance: float = 0.1) -> DataFrame:
    """id and community, after each community of more than `largest` members was split once in two.

    Members come in the order of their ids. The first and the middle one lead the halves; every other joins the half to
    whose members so far it has more weight, less `balance` for each member of that half; the first on a tie. Halves may
    still be large. New communities are numbered after the last one, in the order of those they came from.

    Each decision depends on all before it, so that a community's edges pass through one task, sorted by member: what
    the task keeps is a byte for each member. Communities are dealt over tasks.
    """
    from .hygiene import with_numbers

    place = members.select("id", "community")
    big = _stored(place.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") > largest))
    numbered = with_numbers(place.join(big.select("community"), "community", "left_semi"), [F.col("community"), F.col("id")])
    numbered = _stored(numbered.join(numbered.groupBy("community").agg(F.min("n").alias("base")), "community").select("id", "community", (F.col("n") - F.col("base")).alias("nth")).join(big, "community"))
    both = _undirected(nodes, edges)
    at = numbered.select(F.col("id").alias("b"), F.col("community").alias("cb"), F.col("nth").alias("other"))
    links = both.join(numbered.select(F.col("id").alias("a"), "community", "nth", "n"), "a").join(at, "b").where("community = cb and (other < nth or 2 * other in (n, n - 1))")
    rows = numbered.select("community", "nth", "n", "id", F.lit(-1).cast("bigint").alias("other"), F.lit(0.0).alias("w"))
    rows = rows.unionByName(links.select("community", "nth", "n", F.col("a").alias("id"), F.col("other").cast("bigint").alias("other"), F.col("w").cast("double").alias("w")))
    kinds = {c: numbered.schema[c].dataType.simpleString() for c in ("id", "community")}
    ordered = rows.repartition("community").sortWithinPartitions("community", "nth", "other")
    halves = ordered.mapInPandas(_halves(balance), f"id {kinds['id']}, community {kinds['community']}, second boolean")
    last = place.agg(F.max("community").alias("m")).first().m
    names = with_numbers(big.select("community"), [F.col("community")]).select("community", F.col("n").alias("k"))
    fresh = _stored(halves.where("second").join(names, "community").select("id", (F.lit(last or 0) + 1 + F.col("k")).cast(kinds["community"]).alias("community")))
    return place.join(fresh.select("id"), "id", "left_anti").union(fresh)


def synthesis_context(sweeps: DataFrame, totals: DataFrame) -> DataFrame:
    """What a provider reads to answer each query, out of all sweeps of it: query, context.

    sweeps: query, community, summary, nodes, keywords (array), output (null: failed); totals: query, nodes, edges,
    partitions, selected.
    """
    ok = sweeps.where("output is not null")
    part = F.concat(F.lit("---\n\n## Partition P-"), F.col("community").cast("string"), F.lit(": "), F.coalesce("summary", F.lit("Unknown domain")), F.lit("\n("), F.col("nodes").cast("string"), F.lit(" nodes analyzed, keywords: "), F.array_join("keywords", ", "), F.lit(")\n\n"), F.col("output"), F.lit("\n\n"))
    said = ok.select("query", "community", part.alias("part")).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("community", "part"))), lambda x: x["part"]), "").alias("parts"), F.count("*").alias("good"))
    j = totals.join(said, "query", "left")
    head = F.concat(F.lit("# Partitioned Graph Synthesis\nFull graph: "), F.col("nodes").cast("string"), F.lit(" nodes, "), F.col("edges").cast("string"), F.lit(" edges across "), F.col("partitions").cast("string"), F.lit(" partitions.\nSwept "), F.col("selected").cast("string"), F.lit(" partitions ("), F.coalesce("good", F.lit(0)).cast("string"), F.lit(" successful).\n\n"))
    return j.select("query", F.concat(head, F.coalesce("parts", F.lit(""))).alias("context"))


def sweep_context(members: DataFrame, *, text_col: str = "concept", budget: int = 500_000) -> DataFrame:
    """What a provider reads of each community: members by weight, up to the first beyond the budget, as one text."""
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.coalesce(text_col, F.lit("")))
    order = [F.desc_nulls_last("weight"), F.col("id")]
    rows = members.withColumn("line", line)
    rows = rows.withColumn("used", F.sum(F.length("line") + 1).over(Window.partitionBy("community").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)
    return rows.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("used", "line"))), lambda x: x["line"]), "\n").alias("context"))
