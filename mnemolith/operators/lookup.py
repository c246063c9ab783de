"""Subgraphs around what many queries name, at once.

Words of all queries look up nodes in an inverted index of the ids' runs of four characters: a word
probes the run of its own that fewest ids have, and what it meets is verified. Queries of one word that
nothing has find near spellings by an index of bigrams. Around its matches each query walks breadth
first until it has seen `max_nodes` nodes, in the order that a walk of one after the other has: matches
in node order, of each its own queue, neighbours in edge order; nodes that an earlier match has reached
are walked again but count once.

That order decides what a full query leaves out, yet no more of it is needed than its beginning: at most
`max_nodes` matches count, of a match's queue the first 2 x max_nodes (fewer than max_nodes can have
been seen before), and so of a node's edges the first 2 x max_nodes to other nodes. What is beyond can't
be reached before the query is full; everything is cut there, exactly, before it is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text
from .pairs import _stored

RUN, LEAST, NEAR = 4, 4, 0.65


def query_words(queries: DataFrame) -> DataFrame:
    """query, words (how many it has, repeated ones too), word and times, of words of four characters or more that are no stopwords."""
    kept = F.filter(F.split(text.normalize_name(F.col("text")), r"\s+"), lambda w: (F.length(w) >= LEAST) & ~w.isin(*P.GRAPH_STOPWORDS))
    each = queries.select("query", kept.alias("w")).where(F.size("w") > 0).select("query", F.size("w").alias("words"), F.explode("w").alias("word"))
    return each.groupBy("query", "words", "word").agg(F.count("*").alias("times"))


def _runs(s, n: int):
    """The runs of n characters, each once; none of a shorter string."""
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(words: DataFrame, ids: DataFrame, *, run: int = RUN, said: str = "id") -> DataFrame:
    """word and id, of words (word: `run` characters or more) that ids, or another text of theirs, contain."""
    w = words.select("word").distinct()
    has = ids.select("id", F.col(said).alias("_said"), F.explode(_runs(F.col(said), run)).alias("run"))
    own = w.select("word", F.explode(_runs(F.col("word"), run)).alias("run"))
    spread = has.join(own.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))
    # A run that no id has has no row: then the word has no match either.
    probe = own.join(spread, "run", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("m")).where("m.n > 0").select("word", F.col("m.run").alias("run"))
    return probe.join(has, "run").where(F.contains("_said", "word")).select("word", "id")


def near_spellings(words: DataFrame, ids: DataFrame, least: float = NEAR) -> DataFrame:
    """word and id, of words that an id, or one of its parts between spaces, is like (entity similarity of at least `least`).

    Dice: of a word's n bigrams, like names have n * least / (2 - least) at least, so that one of its rarest is shared.
    Names inside a word are found by their own rarest bigram, or by their only character.
    """
    w = words.select("word").distinct()
    names = ids.select("id", F.explode(F.array_distinct(F.array_union(F.array("id"), F.split("id", " ")))).alias("name")).where("name <> ''")
    each = _stored(names.select("name").distinct())
    of_name = each.select("name", F.explode(_runs(F.col("name"), 2)).alias("b"))
    of_word = w.select("word", F.size(_runs(F.col("word"), 2)).alias("n"), F.explode(_runs(F.col("word"), 2)).alias("b"))
    spread = of_name.join(of_word.select("b").distinct(), "b", "left_semi").groupBy("b").agg(F.count("*").alias("df"))
    rare = F.row_number().over(Window.partitionBy("word").orderBy(F.coalesce("df", F.lit(0)), "b"))
    prefix = of_word.join(spread, "b", "left").withColumn("nth", rare).where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * least / (2 - least) - 1e-9) + 1)
    dice = prefix.select("word", "b").join(of_name, "b").select("word", "name")
    common = of_word.groupBy("b").agg(F.count("*").alias("df"))
    probe = of_name.join(common, "b", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "b")).alias("m")).where("m.df > 0").select("name", F.col("m.b").alias("b"))
    inside = probe.join(of_word.select("word", "b"), "b").select("word", "name")
    letters = w.select("word", F.explode(F.array_distinct(F.split("word", ""))).alias("name")).where("name <> ''")
    single = letters.join(each.where(F.length("name") == 1), "name").select("word", "name")
    like = dice.union(inside).union(single).distinct().where(text.entity_similarity(F.col("word"), F.col("name")) >= least)
    return like.join(names, "name").select("word", "id").distinct()


def matches(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """query and id, of nodes (id) that contain two of the query's words (one, if it has one); else near spellings of its only word.

    queries: query, text. Words that stand twice count twice. Queries without words have no rows.
    """
    words = _stored(query_words(queries))
    ids = nodes.select("id").distinct()
    hits = _stored(containing(words, ids))
    direct = words.join(hits, "word").groupBy("query", "words", "id").agg(F.sum("times").alias("n")).where(F.col("n") >= F.when(F.col("words") > 1, 2).otherwise(1)).select("query", "id")
    single = words.where("words = 1").join(hits.select("word").distinct(), "word", "left_anti")
    return direct.union(single.join(near_spellings(single, ids), "word").select("query", "id"))


def subgraphs(
    nodes: DataFrame, edges: DataFrame, queries: DataFrame, *, max_depth: int = 3, max_nodes: int = 10, node_order: str = "id", edge_order: str = "target",
) -> tuple[DataFrame, DataFrame]:
    """Of each query (query, text): entities (query, id, place, match, depth), and the edges out of them with all their columns.

    nodes: id and node_order, each id once, only those that may be seen; edges: source, predicate, target and edge_order, of
    which those between nodes count. An edge has a row for each match (numbered from 1) whose walk came by its source.
    """
    seen_by = nodes.select("id", F.col(node_order).alias("o"))
    found = matches(nodes, queries).join(seen_by, "id")
    nth = F.row_number().over(Window.partitionBy("query").orderBy("o", "id"))
    starts = found.withColumn("match", nth).where(F.col("match") <= max_nodes)
    known = nodes.select("id")
    between = edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    steps = between.where("source <> target").groupBy("source", "target").agg(F.min(edge_order).alias("o"))
    far = 2 * max_nodes
    steps = _stored(steps.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("o", "target"))).where(F.col("nth") <= far).select(F.col("source").alias("id"), F.col("target").alias("next"), "nth"))
    front = _stored(starts.select("query", "match", "id", F.lit(1).alias("pos"), F.lit(0).alias("depth")))
    walked = front
    for depth in range(1, max_depth + 1):
        reached = front.join(steps, "id").groupBy("query", "match", F.col("next").alias("id")).agg(F.min(F.struct("pos", "nth")).alias("by"))
        reached = reached.join(walked.select("query", "match", "id"), ["query", "match", "id"], "left_anti")
        base = walked.groupBy("query", "match").agg(F.max("pos").alias("base"))
        place = F.row_number().over(Window.partitionBy("query", "match").orderBy("by"))
        new = reached.join(base, ["query", "match"]).withColumn("pos", F.col("base") + place).where(F.col("pos") <= far)
        front = _stored(new.select("query", "match", "id", "pos", F.lit(depth).alias("depth")))
        if front.isEmpty():
            break
        walked = walked.union(front)
    in_turn = Window.partitionBy("query").orderBy("match", "pos")
    first = (F.row_number().over(Window.partitionBy("query", "id").orderBy("match", "pos")) == 1).cast("int")
    before = F.coalesce(F.sum("first").over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    visited = _stored(walked.withColumn("first", first).withColumn("before", before).where(F.col("before") < max_nodes))
    entities = visited.where("first = 1").select("query", "id", (F.col("before") + 1).cast("int").alias("place"), "match", "depth")
    return entities, visited.select("query", "match", F.col("id").alias("source")).join(between, "source")
