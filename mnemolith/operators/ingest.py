"""Extracted entities and relations into the graph: rejection, a tenant's node budget, endpoints created on the way, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import graph, pairs

#: Fixed value: how many nodes a tenant may own.
NODE_CAP = 500


def rejects(name: Column, patterns: Sequence[str] = ()) -> Column:
    """By its form, or by one of a user's own patterns (Java regular expressions, any case); a null name is rejected."""
    n = F.lower(F.trim(name))
    own = F.lit(False)
    for p in patterns:
        own = own | n.rlike(f"(?iu){p}")
    return F.coalesce(graph.is_rejected(name) | own, F.lit(True))


def accepted(rows: DataFrame, names: Sequence[str], *, blocked: DataFrame | None = None, patterns: Sequence[str] = ()) -> DataFrame:
    """Rows none of whose names is rejected or on the list of blocked ids (id); for relations give both ends."""
    for c in names:
        rows = rows.where(~rejects(text.normalize_name(F.col(c)), patterns))
        if blocked is not None:
            key = F.lower(F.trim(text.normalize_name(F.col(c))))
            rows = rows.join(blocked.select(F.lower(F.trim("id")).alias("_blocked")).distinct(), key == F.col("_blocked"), "left_anti")
    return rows


def tenant_of(scope: Column) -> Column:
    """tn-x of a scope tn-x or tn-x--project; null for the master's scopes."""
    return F.when(scope.startswith("tn-"), F.split_part(scope, F.lit("--"), F.lit(1)))


def extracted(events: DataFrame, *, blocked: DataFrame | None = None, patterns: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Accepted entities and relations of events (ord, scope, seen, entities, relationships, sources), in their order `at`."""
    e = events.select("ord", "scope", "seen", "sources", F.posexplode("entities").alias("p", "e")).select("scope", "seen", "sources", "e.*", F.struct("ord", F.lit(0).alias("kind"), "p", F.lit(0).alias("end")).alias("at"))
    e = accepted(e, ["name"], blocked=blocked, patterns=patterns).withColumn("id", text.graph_id(F.col("scope"), F.col("name")))
    r = events.select("ord", "scope", "seen", "sources", F.posexplode("relationships").alias("p", "r")).select("ord", "p", "scope", "seen", "sources", "r.*")
    r = accepted(r, ["subject", "object"], blocked=blocked, patterns=patterns)
    ids = {c: text.graph_id(F.col("scope"), F.col(n)) for c, n in (("source", "subject"), ("target", "object"))}
    return e, r.withColumns(ids)


def _ends(r: DataFrame) -> DataFrame:
    one = lambda c, n, k: r.select("scope", "seen", "sources", F.col(n).alias("name"), F.col(c).alias("id"), F.struct("ord", F.lit(1).alias("kind"), "p", F.lit(k).alias("end")).alias("at"))
    return one("source", "subject", 0).union(one("target", "object", 1))


def within_budget(nodes: DataFrame, e: DataFrame, r: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Entities and relations that keep every tenant within `cap` nodes.

    New ids are claimed in order of appearance, each once; what needs an id beyond the budget is dropped. A
    tenant that has reached the cap gets nothing. The master has no cap.
    """
    owned = nodes.select(tenant_of(text.graph_scope(F.col("id"))).alias("tenant")).where("tenant is not null").groupBy("tenant").agg(F.count("*").alias("owned"))
    said = e.select("id", "scope", "at").union(_ends(r).select("id", "scope", "at")).withColumn("tenant", tenant_of(F.col("scope"))).where("tenant is not null")
    new = said.groupBy("tenant", "id").agg(F.min("at").alias("at")).join(nodes.select("id"), "id", "left_anti")
    place = F.row_number().over(Window.partitionBy("tenant").orderBy("at", "id"))
    over = new.withColumn("place", place).join(owned, "tenant", "left").where(F.col("place") > cap - F.coalesce("owned", F.lit(0))).select("id")
    full = owned.where(F.col("owned") >= cap).select("tenant")

    def fits(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        for c in columns:
            rows = rows.join(over.select(F.col("id").alias(c)), c, "left_anti")
        return rows.join(full.select(F.col("tenant").alias("_full")), tenant_of(F.col("scope")) == F.col("_full"), "left_anti")

    return fits(e, ["id"]), fits(r, ["source", "target"])


def ingest(nodes: DataFrame, edges: DataFrame, events: DataFrame, *, blocked: DataFrame | None = None, patterns: Sequence[str] = (), cap: int | None = NODE_CAP) -> tuple[DataFrame, DataFrame]:
    """nodes and edges (graph.py's columns) after the events.

    A known entity counts one mention more; the longest description stays, the first of equals. An end of a relation
    that no node has by then becomes one of type Other. A node's type is that of its first appearance.
    """
    said, r = _told(nodes, events, blocked, patterns, cap)
    sources = F.when(F.max(F.col("sources").isNotNull()), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources"))))).alias("sources_n")
    both = F.when(F.col("sources").isNull(), F.col("sources_n")).when(F.col("sources_n").isNull(), F.col("sources")).otherwise(F.array_sort(F.array_union("sources", "sources_n"))).alias("sources")
    return _upserted(nodes, edges, said, r, sources, both)


def _told(nodes: DataFrame, events: DataFrame, blocked: DataFrame | None, patterns: Sequence[str], cap: int | None) -> tuple[DataFrame, DataFrame]:
    """What is said of nodes, ends created on the way too, and of edges."""
    e, r = extracted(events, blocked=blocked, patterns=patterns)
    if cap is not None:
        e, r = within_budget(nodes, pairs._stored(e), pairs._stored(r), cap)
    # Ends that are not nodes and that no entity names before: only the first of them makes the node.
    first_entity = e.groupBy("id").agg(F.min("at").alias("named"))
    ends = _ends(r).join(nodes.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("at", "seen", "sources", "scope", "name")).alias("m"))
    made = ends.join(first_entity, "id", "left").where("named is null or m.at < named").select("id", "m.*", F.lit("Other").alias("type"), F.lit(None).cast("string").alias("description"))
    columns = ["id", "scope", "name", "type", "description", "seen", "sources", "at"]
    return e.select(*columns).unionByName(made.select(*columns)), r


_EDGE = ["source", "predicate", "target"]


def _upserted(nodes: DataFrame, edges: DataFrame, said: DataFrame, r: DataFrame, sources: Column, both: Column) -> tuple[DataFrame, DataFrame]:
    """nodes and edges with what is said of them; sources is made of a group's rows, both of that and what was there."""
    longest = F.min_by("description", F.when(F.col("description") != "", F.struct(-F.length("description"), "at")))
    new = said.groupBy("id").agg(
        F.min_by("scope", "at").alias("scope_n"), F.min_by(text.normalize_name(F.col("name")), "at").alias("name_n"), F.min_by("type", "at").alias("type_n"),
        longest.alias("description_n"), F.min("seen").alias("first_n"), F.max("seen").alias("last_n"), F.count("*").alias("mentions_n"), sources,
    )
    j = nodes.join(new, "id", "full_outer")
    longer = F.coalesce(F.length("description_n"), F.lit(0)) > F.coalesce(F.length("description"), F.lit(0))
    after = j.select(
        "id", F.coalesce("scope", "scope_n").alias("scope"), F.coalesce("name", "name_n").alias("name"), F.coalesce("type", "type_n").alias("type"),
        F.when(longer, F.col("description_n")).otherwise(F.col("description")).alias("description"), F.coalesce("first_seen", "first_n").alias("first_seen"),
        F.greatest("last_seen", "last_n").alias("last_seen"), (F.coalesce("mentions", F.lit(0)) + F.coalesce("mentions_n", F.lit(0))).alias("mentions"), both,
    )
    told = r.groupBy(*_EDGE).agg(F.count("*").alias("weight_n"), F.min("seen").alias("first_n"), F.max("seen").alias("last_n"), sources)
    k = edges.join(told, _EDGE, "full_outer")
    moved = k.select(*_EDGE, (F.coalesce("weight", F.lit(0)) + F.coalesce("weight_n", F.lit(0))).alias("weight"), F.coalesce("first_seen", "first_n").alias("first_seen"), F.greatest("last_seen", "last_n").alias("last_seen"), both)
    return after, moved


def apart(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A graph with its sources as tables of their own: nodes and edges with `known` (they have sources, or had), who said a node (id, by), who said an edge (source, predicate, target, by)."""
    bare = lambda t: t.withColumn("known", F.col("sources").isNotNull()).drop("sources")
    return bare(nodes), bare(edges), nodes.select("id", F.explode("sources").alias("by")), edges.select(*_EDGE, F.explode("sources").alias("by"))


def ingest_apart(nodes: DataFrame, edges: DataFrame, of_nodes: DataFrame, of_edges: DataFrame, events: DataFrame, *, blocked: DataFrame | None = None, patterns: Sequence[str] = (), cap: int | None = NODE_CAP) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """As ingest, for a graph whose sources are tables of their own: what millions name is a row, its sources are rows too."""
    said, r = _told(nodes, events, blocked, patterns, cap)
    known = F.max(F.col("sources").isNotNull()).alias("known_n")
    both = (F.coalesce("known", F.lit(False)) | F.coalesce("known_n", F.lit(False))).alias("known")
    after, moved = _upserted(nodes, edges, said, r, known, both)
    more = lambda old, new, key: old.select(*key, "by").union(new.select(*key, F.explode("sources").alias("by"))).distinct()
    return after, moved, more(of_nodes, said, ["id"]), more(of_edges, r, _EDGE)


def with_counts(rows: DataFrame, said: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of a graph whose sources are apart with their number, null where none were ever known."""
    n = said.groupBy(*key).agg(F.count("*").alias("_n"))
    return rows.join(n, list(key), "left").withColumn("n_sources", F.when(F.col("known"), F.coalesce("_n", F.lit(0)))).drop("_n")


def reingest_apart(nodes: DataFrame, edges: DataFrame, of_nodes: DataFrame, of_edges: DataFrame, events: DataFrame, **rules) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """As reingest, for a graph whose sources are tables of their own."""
    told, of_nodes, of_edges = pairs._stored(events), pairs._stored(of_nodes), pairs._stored(of_edges)
    ids = told.select(F.explode("sources").alias("by")).distinct()
    left = lambda said: pairs._stored(said.join(ids, "by", "left_anti"))
    ns, es = left(of_nodes), left(of_edges)
    bare = lambda before, after, key: before.join(ids, "by", "left_semi").select(*key).distinct().join(after, list(key), "left_anti")
    e = pairs._stored(edges.join(bare(of_edges, es, _EDGE), _EDGE, "left_anti"))
    ends = e.select(F.col("source").alias("id")).union(e.select("target"))
    n = pairs._stored(nodes.join(bare(of_nodes, ns, ["id"]).join(ends, "id", "left_anti"), "id", "left_anti"))
    return ingest_apart(n, e, ns, es, told, **rules)


def reingest(nodes: DataFrame, edges: DataFrame, events: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """nodes and edges after memories were given new texts: what only their old ones said goes, then the events are ingested.

    events are what the new texts say, with the memories' ids as sources; one without entities and relations takes the old
    ones back. All are one batch: what two memories said goes if both are among them. Mentions and weights count what was
    ever said and don't fall. What no event touches is not derived again; ids of edges and their sources are those of a
    graph built from the new texts. rules are those of ingest.
    """
    told = pairs._stored(events)
    n, e = graph.without_sources(nodes, edges, told.select(F.explode("sources").alias("source")))
    return ingest(pairs._stored(n), pairs._stored(e), told, **rules)


def decide(nodes: DataFrame, edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges after decisions (ord, scope, name, description, options, chosen, related: array of name and type, seen, sources).

    A decision's node replaces one of the same id, with one mention and the sources of both; options and related
    entities are upserted, and lead to it by DECIDED_FOR, DECIDED_AGAINST and RELATED_TO.
    """
    concept = lambda x: F.struct(x.alias("name"), F.lit("Concept").alias("type"), F.lit(None).cast("string").alias("description"))
    relation = lambda p, x: F.struct(F.col("name").alias("subject"), F.lit(p).alias("predicate"), x.alias("object"))
    others = F.filter("options", lambda o: o != F.col("chosen"))
    related = F.coalesce("related", F.array().cast("array<struct<name:string,type:string>>"))
    entities = F.concat(F.array(concept(F.col("chosen"))), F.transform(others, concept), F.transform(related, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), F.lit(None).cast("string").alias("description"))))
    relations = F.concat(F.array(relation("DECIDED_FOR", F.col("chosen"))), F.transform(others, lambda o: relation("DECIDED_AGAINST", o)), F.transform(related, lambda x: relation("RELATED_TO", x["name"])))
    last = decisions.withColumn("id", text.graph_id(F.col("scope"), F.col("name"))).groupBy("id").agg(F.max_by(F.struct("scope", text.normalize_name(F.col("name")).alias("name"), "description", "seen"), "ord").alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("own"))
    before = nodes.select("id", F.col("sources").alias("had"))
    made = last.join(before, "id", "left").select("id", "m.scope", "m.name", F.lit("Decision").alias("type"), "m.description", F.col("m.seen").alias("first_seen"), F.col("m.seen").alias("last_seen"), F.lit(1).cast("bigint").alias("mentions"), F.array_sort(F.array_union(F.coalesce("had", F.array().cast("array<string>")), "own")).alias("sources"))
    with_decisions = nodes.join(made.select("id"), "id", "left_anti").select(*made.columns).union(made)
    # Names of decisions are not judged by the rejection rules, so their relations are upserted as they are.
    events = decisions.select("ord", "scope", "seen", "sources", entities.alias("entities"), relations.alias("relationships"))
    e = events.select("ord", "scope", "seen", "sources", F.posexplode("entities").alias("p", "e")).select("ord", "p", "scope", "seen", "sources", "e.*").withColumn("id", text.graph_id(F.col("scope"), F.col("name")))
    new = e.groupBy("id").agg(F.min_by("scope", F.struct("ord", "p")).alias("scope_n"), F.min_by(text.normalize_name(F.col("name")), F.struct("ord", "p")).alias("name_n"), F.min_by("type", F.struct("ord", "p")).alias("type_n"), F.min("seen").alias("f"), F.max("seen").alias("l"), F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("s"))
    j = with_decisions.join(new, "id", "full_outer")
    out = j.select("id", F.coalesce("scope", "scope_n").alias("scope"), F.coalesce("name", "name_n").alias("name"), F.coalesce("type", "type_n").alias("type"), "description", F.coalesce("first_seen", "f").alias("first_seen"), F.greatest("last_seen", "l").alias("last_seen"), (F.coalesce("mentions", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("mentions"), F.when(F.col("s").isNull(), F.col("sources")).otherwise(F.array_sort(F.array_union(F.coalesce("sources", F.array().cast("array<string>")), "s"))).alias("sources"))
    r = events.select("scope", "seen", "sources", F.explode("relationships").alias("r")).select("scope", "seen", "sources", "r.*")
    r = r.select(text.graph_id(F.col("scope"), F.col("subject")).alias("source"), "predicate", text.graph_id(F.col("scope"), F.col("object")).alias("target"), "seen", "sources")
    known = r.groupBy("source", "predicate", "target").agg(F.count("*").alias("wn"), F.min("seen").alias("fn"), F.max("seen").alias("ln"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sn"))
    k = edges.join(known, ["source", "predicate", "target"], "full_outer")
    return out, k.select("source", "predicate", "target", (F.coalesce("weight", F.lit(0)) + F.coalesce("wn", F.lit(0))).alias("weight"), F.coalesce("first_seen", "fn").alias("first_seen"), F.greatest("last_seen", "ln").alias("last_seen"), F.when(F.col("sn").isNull(), F.col("sources")).otherwise(F.array_sort(F.array_union(F.coalesce("sources", F.array().cast("array<string>")), "sn"))).alias("sources"))


def owned(node: Column, tenant: str) -> Column:
    """Whose nodes may be removed: the master all, a tenant those of its own scopes."""
    if tenant == "master":
        return F.lit(True)
    scope = text.graph_scope(node)
    return F.coalesce((scope == f"tn-{tenant}") | scope.startswith(f"tn-{tenant}--"), F.lit(False))


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, tenant: str = "master") -> tuple[DataFrame, DataFrame]:
    """The graph without those of the nodes that the tenant owns, and their edges; others are skipped."""
    return graph.without_nodes(nodes, edges, ids.where(owned(F.col("id"), tenant)))


def remove_relationships(edges: DataFrame, asked: DataFrame, tenant: str = "master") -> DataFrame:
    """Edges without those asked for (source, predicates, targets; a null list means any).

    A request whose source or any of whose targets the tenant does not own removes nothing, and no edge into a node that
    it does not own goes.
    """
    fair = asked.where(owned(F.col("source"), tenant) & F.coalesce(F.forall("targets", lambda t: owned(t, tenant)), F.lit(True)))
    hit = edges.join(fair.select(F.col("source").alias("_s"), "predicates", "targets"), F.col("source") == F.col("_s"))
    hit = hit.where((F.col("predicates").isNull() | F.array_contains("predicates", F.col("predicate"))) & (F.col("targets").isNull() | F.array_contains("targets", F.col("target"))) & owned(F.col("target"), tenant))
    return edges.join(hit.select("source", "predicate", "target").distinct(), ["source", "predicate", "target"], "left_anti")


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges and id_sum of a graph: the sum of |hash| over the ids, in 32 bits, to know a graph by.

    hash starts from 5381 and takes 33 * hash + the next character, in 32 bits; characters are code points, which for
    those up to U+FFFF are UTF-16's units.
    """
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    codes = F.transform(F.split("id", ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(F.when(F.col("id") == "", F.array().cast("array<bigint>")).otherwise(codes), F.lit(5381).cast("bigint"), lambda a, c: wrap(a * 33 + c))
    n = nodes.agg(F.count("*").alias("nodes"), F.coalesce(wrap(F.sum(F.abs(h))), F.lit(0)).cast("bigint").alias("id_sum"))
    return n.join(F.broadcast(edges.agg(F.count("*").alias("edges"))), how="cross").select("nodes", "edges", "id_sum")
