"""Knowledge graph in two tables: build, look up, traverse, resolve, clean.

nodes: id, scope, name, type, description, first_seen, last_seen, mentions, sources (null: unknown)
edges: source, predicate, target, weight, first_seen, last_seen, sources
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text
from ..functions.rules import Has, any_of
from . import pairs

REJECTED = any_of([Has(p, f) for p, f in P.REJECTED_ENTITIES])


def is_rejected(name: Column) -> Column:
    """Names that are no entities: three characters or fewer, hashes, addresses, numbers, files, dates and the like."""
    n = F.lower(F.trim(name))
    return (F.length(n) <= 3) | REJECTED.column(n)


def entities(mentions: DataFrame) -> DataFrame:
    """Nodes of mentions (id, type, description, seen, source, ord): counted, first and last seen, the longest description (the first of equals)."""
    longest = F.max_by("description", F.when(F.col("description").isNotNull(), F.struct(F.length("description"), -F.col("ord"))))
    return mentions.groupBy("id").agg(F.min_by("type", "ord").alias("type"), F.count("*").alias("mentions"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), longest.alias("description"), F.array_sort(F.collect_set("source")).alias("sources"))


def relationships(mentions: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges of mentions (source, predicate, target, seen, doc), counted; of nodes only, where given."""
    if nodes is not None:
        for end in ("source", "target"):
            mentions = mentions.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return mentions.groupBy("source", "predicate", "target").agg(F.count("*").alias("weight"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.array_sort(F.collect_set("doc")).alias("sources"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and degree, in and out; an edge to itself counts twice."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of each type, and the number of edges under "edges"."""
    return nodes.groupBy(F.coalesce("type", F.lit("Other")).alias("type")).agg(F.count("*").alias("n")).union(edges.agg(F.count("*").alias("n")).select(F.lit("edges"), "n"))


def visible(node: Column, tenant: str, project: str | None) -> Column:
    """Whose nodes a reader sees: the master all, or with a project the global and its own; a tenant its own only."""
    scope = text.graph_scope(node)
    if tenant == "master":
        return F.lit(True) if project is None else scope.isNull() | (scope == project)
    own = f"tn-{tenant}"
    if project is None:
        return F.coalesce((scope == own) | scope.startswith(own + "--"), F.lit(False))
    return F.coalesce(scope.isin(own, f"{own}--{project}"), F.lit(False))


def matches(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose ids contain two of the query's words (one, if it has one); else near spellings of a single word."""
    spark = nodes.sparkSession
    norm = spark.range(1).select(text.normalize_name(F.lit(query)).alias("q")).first().q
    words = [w for w in norm.split() if len(w) >= 4 and w not in P.GRAPH_STOPWORDS]
    if not words:
        return nodes.where("false")
    found = sum((F.contains(F.col("id"), F.lit(w)).cast("int") for w in words[1:]), F.contains(F.col("id"), F.lit(words[0])).cast("int"))
    direct = nodes.where(found >= (2 if len(words) > 1 else 1))
    if len(words) > 1 or direct.limit(1).count():
        return direct
    w = F.lit(words[0])
    return nodes.where((text.entity_similarity(w, F.col("id")) >= 0.65) | F.exists(F.split("id", " "), lambda t: text.entity_similarity(w, t) >= 0.65))


def reach(starts: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """start, id and depth (the least) of what is reached along edges from each start; one join for each step."""
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct()
    front = seen
    step = edges.select(F.col("source").alias("s"), F.col("target").alias("t")).distinct()
    for d in range(1, max_depth + 1):
        front = front.join(step, front.id == step.s).select("start", F.col("t").alias("id"), F.lit(d).alias("depth")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        front = pairs._stored(front)
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen


def subgraph(nodes: DataFrame, edges: DataFrame, query: str, *, max_depth: int = 3, max_nodes: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes around the query's matches, the nearest to the first matches first, and all their edges out."""
    found = reach(matches(nodes, query), edges, max_depth)
    first = found.groupBy("id").agg(F.min(F.struct("start", "depth")).alias("m")).orderBy("m.start", "m.depth", "id").limit(max_nodes).select("id")
    return nodes.join(first, "id", "left_semi"), edges.join(first.select(F.col("id").alias("source")), "source", "left_semi")


def similar_entities(nodes: DataFrame, least: float = P.ENTITY_SIMILARITY, *, on: str = "id") -> DataFrame:
    """i < j and similarity of nodes of one scope and type, on their ids or bare names.

    Pairs meet by a shared bigram of a rare prefix (Dice), or as one name inside the other: the longer has the
    shorter's rarest bigram too.
    """
    rows = nodes.select(F.col("id").alias("key"), F.col(on).alias("n"), F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce("type", F.lit("Other")).alias("type")).where("n <> ''")
    rows = rows.withColumn("g", F.concat_ws("\u0000", "scope", "type"))
    tagged = rows.select("key", F.transform(text.bigrams(F.col("n")), lambda b: F.concat(F.col("g"), F.lit("\u0000"), b)).alias("b"))
    dice = pairs.set_pairs(tagged, "key", "b", least, "dice").select("i", "j")
    near = dice
    if least <= P.CONTAINED_SIMILARITY:
        # Bigrams and characters; a name of one character has nothing else to be found by.
        has = rows.select("key", "g", "n", F.explode(F.array_union(text.bigrams(F.col("n")), F.split("n", ""))).alias("x")).distinct()
        rarity = has.groupBy("g", "x").agg(F.count("*").alias("df"))
        probe = has.where(F.length("x") == F.least(F.length("n"), F.lit(2))).join(rarity, ["g", "x"]).groupBy("key", "g", "n").agg(F.min(F.struct("df", "x")).alias("m")).select("key", "g", "n", "m.x")
        inside = probe.join(has.select(F.col("key").alias("k2"), "g", F.col("n").alias("n2"), "x"), ["g", "x"]).where((F.col("key") != F.col("k2")) & F.contains("n2", "n"))
        near = near.union(inside.select(F.least("key", "k2").alias("i"), F.greatest("key", "k2").alias("j"))).distinct()
    both = near.join(rows.select(F.col("key").alias("i"), F.col("n").alias("a")), "i").join(rows.select(F.col("key").alias("j"), F.col("n").alias("b")), "j")
    return both.select("i", "j", text.entity_similarity(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= least)


def _merges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Similar pairs of a component after each other, in the order of the pass: what is merged, and at its end what became of the nodes."""
    part, turn, skipped, step = None, None, False, 0
    mentions: dict = {}
    has: dict = {}
    gone: set = set()

    def fates():
        # Who is left has what was merged into it; who is gone without one that is left is lost.
        out = [(n, s, mentions[s], None, None) for s in mentions if s not in gone for n in has.get(s, ())]
        kept = {n for n, *_ in out}
        out += [(s, s, mentions[s], None, None) for s in mentions if s not in gone]
        return out + [(n, None, None, None, None) for n in gone if n not in kept]

    for df in batches:
        out: list[tuple] = []
        for c, i, j, mi, mj in df[["component", "i", "j", "mi", "mj"]].itertuples(index=False):
            if c != part:
                out += fates()
                part, turn, step, mentions, has, gone = c, None, 0, {}, {}, set()
            mentions.setdefault(i, mi)
            mentions.setdefault(j, mj)
            if i != turn:
                turn, skipped = i, i in gone
            if skipped or j in gone:
                continue
            stays, goes = (i, j) if mentions[i] >= mentions[j] else (j, i)
            mentions[stays] += mentions[goes]
            has.setdefault(stays, set()).update({goes}, has.get(goes, ()))
            gone.add(goes)
            out.append((goes, None, mentions[stays], stays, step))
            step += 1
        yield pd.DataFrame(out, columns=["node", "into", "mentions", "stays", "step"])
    yield pd.DataFrame(fates(), columns=["node", "into", "mentions", "stays", "step"])


def resolve(nodes: DataFrame, edges: DataFrame, least: float = P.ENTITY_SIMILARITY, *, on: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges after similar entities were merged, and the merges: duplicate, canonical, mentions (of that one then).

    A pass over ids in order, and for each over the later ones that are similar: the one with more mentions stays, the
    first on a tie, and has the other's from then on. A node that lost its own turn goes on with it, so that it may be
    merged into several, and what is merged into it after it was itself is lost with it. Turns of one component of
    similar pairs depend on each other; its pairs pass through one task in order, which keeps a number for each node and
    whom it has taken in. Components are found by joins and dealt over tasks.
    """
    size = nodes.select("id", "mentions")
    found = similar_entities(nodes, least, on=on).join(size.select(F.col("id").alias("i"), F.col("mentions").alias("mi")), "i").join(size.select(F.col("id").alias("j"), F.col("mentions").alias("mj")), "j")
    found = pairs._stored(found.select("i", "j", "mi", "mj"))
    of = pairs.components(found).select(F.col("id").alias("i"), "component")
    ordered = found.join(of, "i").repartition("component").sortWithinPartitions("component", "i", "j")
    done = pairs._stored(ordered.mapInPandas(_merges, "node string, into string, mentions bigint, stays string, step bigint"))
    merges = done.where("stays is not null").select(F.col("node").alias("duplicate"), F.col("stays").alias("canonical"), "mentions")
    fate = done.where("stays is null")
    rename = fate.select(F.col("node").alias("n2"), "into", F.col("mentions").alias("sum"))
    named = nodes.join(rename, nodes.id == F.col("n2"), "left").where("n2 is null or into is not null").withColumn("new", F.coalesce("into", "id"))
    longest = F.max_by("description", F.when(F.col("description").isNotNull(), F.struct(F.length("description"), (F.col("id") == F.col("new")).cast("int"))))
    own = lambda c: F.max(F.when(F.col("id") == F.col("new"), F.col(c))).alias(c)
    sources = F.when(F.max(F.col("sources").isNotNull()), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources"))))).alias("sources")
    merged = named.groupBy(F.col("new").alias("id")).agg(own("scope"), own("name"), own("type"), longest.alias("description"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max(F.when(F.col("id") == F.col("new"), F.coalesce("sum", "mentions"))).alias("mentions"), sources)
    moved = edges
    for end in ("source", "target"):
        moved = moved.join(rename.select(F.col("n2").alias("k"), F.col("into").alias("v")), moved[end] == F.col("k"), "left").where("k is null or v is not null").withColumn("_" + end, F.coalesce("v", end)).drop("k", "v")
    moved = moved.where("_source <> _target").withColumn("kept", (F.col("source") == F.col("_source")) & (F.col("target") == F.col("_target")))
    # Where edges fall together the first one's weight stays: weights aren't summed.
    first = F.struct(~F.col("kept"), "source", "target")
    moved = moved.groupBy(F.col("_source").alias("source"), "predicate", F.col("_target").alias("target")).agg(F.min_by("weight", first).alias("weight"), F.min_by("first_seen", first).alias("first_seen"), F.min_by("last_seen", first).alias("last_seen"), sources)
    return merged, moved, merges


def sweep(nodes: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """id and why it goes: pattern, orphan or stale (null: it stays). Degrees are those before the sweep."""
    health = F.coalesce(F.col("type").isin(P.HEALTH_TYPES), F.lit(False))
    days = (F.unix_micros(as_of) - F.coalesce(F.unix_micros("last_seen"), F.lit(0))) / F.lit(86_400_000_000.0)
    why = F.when(is_rejected(F.col("id")), "pattern").when((F.col("degree") == 0) & ~health, "orphan").when((days > F.when(health, 90).otherwise(14)) & (F.coalesce("mentions", F.lit(0)) <= 2), "stale")
    return nodes.join(degrees(nodes, edges), "id").select("id", why.alias("reason"))


def without_source(nodes: DataFrame, edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """The graph without what only this source said: edges first, then nodes that are left without source and edge."""
    strip = F.when(F.col("sources").isNotNull(), F.array_remove("sources", source))
    had = F.array_contains("sources", source)
    e = edges.withColumn("_had", F.coalesce(had, F.lit(False))).withColumn("sources", strip).where(~F.col("_had") | (F.size("sources") > 0)).drop("_had")
    n = nodes.withColumn("_had", F.coalesce(had, F.lit(False))).withColumn("sources", strip).join(degrees(nodes, e), "id")
    return n.where(~F.col("_had") | (F.size("sources") > 0) | (F.col("degree") > 0)).drop("_had", "degree"), e


def without_sources(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without what only these sources (column source) said, as without_source one by one.

    Nodes and edges that know no sources stay. Only what one of the sources said is regrouped; whether a node that is
    left without source still has an edge is asked for those nodes alone. A source named often, or that nothing knows,
    changes nothing more.
    """
    ids = gone.select(F.col("source").alias("_s")).distinct()

    def stripped(table: DataFrame, key: list[str]) -> DataFrame:
        hit = table.select(*key, F.explode("sources").alias("_s")).join(ids, "_s", "left_semi").groupBy(*key).agg(F.collect_set("_s").alias("_gone"))
        j = table.join(hit, key, "left")
        return j.withColumn("sources", F.when(F.col("_gone").isNotNull(), F.array_except("sources", "_gone")).otherwise(F.col("sources")))

    e = stripped(edges, ["source", "predicate", "target"]).where("_gone is null or size(sources) > 0").drop("_gone").select(*edges.columns)
    n = stripped(nodes, ["id"])
    ends = e.select(F.col("source").alias("id")).union(e.select("target"))
    dead = n.where("_gone is not null and size(sources) = 0").select("id").join(ends, "id", "left_anti")
    return n.join(dead, "id", "left_anti").drop("_gone").select(*nodes.columns), e


def without_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without these nodes and their edges."""
    gone = ids.select("id").distinct()
    for end in ("source", "target"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(gone, "id", "left_anti"), edges


def decision_edges(decisions: DataFrame) -> DataFrame:
    """Edges of decisions (id, options, chosen, related): for the chosen option, against the others, to what is related."""
    against = decisions.select("id", F.explode("options").alias("o"), "chosen").where("o <> chosen").select(F.col("id").alias("source"), F.lit("DECIDED_AGAINST").alias("predicate"), F.col("o").alias("target"))
    chosen = decisions.where("chosen is not null").select(F.col("id").alias("source"), F.lit("DECIDED_FOR").alias("predicate"), F.col("chosen").alias("target"))
    related = decisions.select(F.col("id").alias("source"), F.lit("RELATED_TO").alias("predicate"), F.explode("related").alias("target"))
    return against.union(chosen).union(related).distinct()


def prune(nodes: DataFrame, edges: DataFrame, as_of: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """The `most` nodes with the best mentions per day since seen, those of tenants leaving first."""
    days = (F.unix_micros(as_of) - F.unix_micros("last_seen")) / F.lit(86_400_000_000.0)
    score = F.col("mentions") / (1 + days)
    tenant = F.coalesce(text.graph_scope(F.col("id")).startswith("tn-"), F.lit(False))
    kept = nodes.orderBy(tenant, score.desc(), "id").limit(most).select("id")
    return without_nodes(nodes, edges, nodes.select("id").join(kept, "id", "left_anti"))


def to_markdown(nodes: DataFrame, edges: DataFrame, *, predicates: int = 5, targets: int = 3) -> DataFrame:
    """One line for each node: its type and its first predicates with their first targets, and how many more there are."""
    per = edges.groupBy("source", "predicate").agg(F.array_sort(F.collect_set("target")).alias("t"), F.sum("weight").alias("w"))
    more = F.when(F.size("t") > targets, F.concat(F.lit(" +"), (F.size("t") - targets).cast("string"))).otherwise("")
    shown = per.withColumn("line", F.concat("predicate", F.lit(": "), F.array_join(F.slice("t", 1, targets), ", "), more))
    shown = shown.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("w"), "predicate"))).where(F.col("r") <= predicates)
    lines = shown.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "; ").alias("said"))
    return nodes.join(lines, nodes.id == lines.source, "left").select("id", F.concat(F.lit("- **"), "id", F.lit("** ("), F.coalesce("type", F.lit("Other")), F.lit(")"), F.coalesce(F.concat(F.lit(" "), "said"), F.lit(""))).alias("markdown"))

