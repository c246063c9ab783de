"""More queries over the given tables: what is written, merged, moved, paged, swept and put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scoring
from ..operators import consolidation, evaluate, hygiene, ingest, lifecycle, pairs, partitions
from ..sources import tables
from .queries import CENTROID_SQL, GRAPH_SQL, SEEDED_SQL, SQL, STATE_SQL, TEXTS_SQL, _members, memory_state, now, place_edges, place_nodes, query, read, seeded, texts

# The graph.

#: How many nodes a tenant may own here; names of one priority are blocked by a pattern, of another by the list.
_CAP, _PATTERN, _BLOCKED = 20, "^4-", "5-low"


def _graph_before(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    name = F.concat(F.lit("customer "), F.col("c_custkey").cast("string"))
    scope = F.when(F.col("c_custkey") % 10 == 0, "tn-a")
    then = F.lit("1990-01-01").cast("timestamp")
    known = c.where("c_custkey % 3 = 0").where("c_custkey % 10 <> 1")
    return known.select(F.concat(F.when(scope.isNotNull(), F.concat(scope, F.lit("::"))).otherwise(""), name).alias("id"), scope.alias("scope"), name.alias("name"), F.lit("Person").alias("type"), F.lit(None).cast("string").alias("description"), then.alias("first_seen"), then.alias("last_seen"), F.lit(5).cast("bigint").alias("mentions"), F.lit(None).cast("array<string>").alias("sources"))


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    """An order says that its customer ordered at a priority; its status is a name too short to keep."""
    key = F.col("o_custkey")
    entity = lambda n, t, e: F.struct(n.alias("name"), F.lit(t).alias("type"), e.cast("string").alias("description"))
    relation = lambda p, o: F.struct(F.concat(F.lit("Customer  "), key.cast("string")).alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    long = F.concat(F.expr("repeat('x', int(o_orderkey % 23))"), "o_orderstatus")
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("ord"), F.when(key % 10 == 0, "tn-a").when(key % 10 == 1, "tn-b--shop").alias("scope"), F.col("o_orderdate").cast("timestamp").alias("seen"), F.array(F.col("o_orderkey").cast("string")).alias("sources"),
        F.array(entity(F.col("o_orderpriority"), "Concept", long), entity(F.col("o_orderstatus"), "Other", F.lit(None))).alias("entities"),
        F.array(relation("ORDERED", F.col("o_orderpriority")), relation("HAS", F.col("o_orderstatus"))).alias("relationships"),
    )


_INGEST_SQL = f"""old AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'tn-a::' ELSE '' END || 'customer ' || c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'tn-a' END AS tenant FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 10 <> 1),
x AS (SELECT o_orderkey AS ord, o_orderdate::TIMESTAMP AS seen, repeat('x', (o_orderkey % 23)::INT) || o_orderstatus AS said, CASE WHEN o_custkey % 10 = 0 THEN 'tn-a' WHEN o_custkey % 10 = 1 THEN 'tn-b' END AS tenant,
  CASE WHEN o_custkey % 10 = 0 THEN 'tn-a::' WHEN o_custkey % 10 = 1 THEN 'tn-b--shop::' ELSE '' END AS pre, lower(o_orderpriority) AS p, 'customer ' || o_custkey AS c FROM orders WHERE NOT starts_with(o_orderpriority, '4-') AND lower(o_orderpriority) <> '{_BLOCKED}'),
owned AS (SELECT tenant, count(*) AS owned FROM old WHERE tenant IS NOT NULL GROUP BY 1),
y AS (SELECT x.*, pre || p AS pid, pre || c AS cid FROM x WHERE tenant IS NULL OR tenant NOT IN (SELECT tenant FROM owned WHERE owned >= {_CAP})),
new AS (SELECT id, tenant, min(pos) AS pos FROM (SELECT pid AS id, tenant, 2 * ord AS pos FROM y UNION ALL SELECT cid, tenant, 2 * ord + 1 FROM y) WHERE tenant IS NOT NULL AND id NOT IN (SELECT id FROM old) GROUP BY 1, 2),
beyond AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY pos, id) AS place FROM new) LEFT JOIN owned USING (tenant) WHERE place > {_CAP} - coalesce(owned, 0)),
e AS (SELECT * FROM y WHERE pid NOT IN (SELECT id FROM beyond)), r AS (SELECT * FROM e WHERE cid NOT IN (SELECT id FROM beyond))"""


@query(f"""WITH {_INGEST_SQL}, made AS (SELECT pid AS id, 'Concept' AS type, count(*) AS n, arg_max(said, (length(said), -ord)) AS description, min(seen) AS f, max(seen) AS l, count(DISTINCT ord) AS s FROM e GROUP BY 1
  UNION ALL SELECT cid, 'Other', 1, NULL, arg_min(seen, ord), arg_min(seen, ord), 1 FROM r WHERE cid NOT IN (SELECT id FROM old) GROUP BY 1)
SELECT id, type, description, n::BIGINT AS mentions, f AS first_seen, l AS last_seen, s::BIGINT AS n_sources FROM made UNION ALL SELECT id, 'Person', NULL, 5, TIMESTAMP '1990-01-01', TIMESTAMP '1990-01-01', NULL FROM old""")
def graph_ingest(spark: SparkSession, d: str) -> DataFrame:
    blocked = spark.range(1).select(F.lit(_BLOCKED.upper()).alias("id"))
    graph = ingest.apart(_graph_before(spark, d), spark.createDataFrame([], tables.EDGES))
    nodes, _, said, _ = ingest.ingest_apart(*graph, _extractions(spark, d), blocked=blocked, patterns=[_PATTERN], cap=_CAP)
    return ingest.with_counts(nodes, said, ["id"]).select("id", "type", "description", "mentions", "first_seen", "last_seen", "n_sources")


@query(f"WITH {_INGEST_SQL} SELECT cid AS source, 'ORDERED' AS predicate, pid AS target, count(*)::BIGINT AS weight, min(seen) AS first_seen, max(seen) AS last_seen FROM r GROUP BY 1, 3")
def graph_ingest_edges(spark: SparkSession, d: str) -> DataFrame:
    blocked = spark.range(1).select(F.lit(_BLOCKED.upper()).alias("id"))
    empty = spark.createDataFrame([], tables.EDGES)
    _, edges = ingest.ingest(_graph_before(spark, d), empty, _extractions(spark, d), blocked=blocked, patterns=[_PATTERN], cap=_CAP)
    return edges.select("source", "predicate", "target", "weight", "first_seen", "last_seen")


@query("""WITH c AS (SELECT c_custkey, lower(c_mktsegment) AS s, lower(n_name) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT 'plan ' || c_custkey AS id, 'Decision' AS type, 1::BIGINT AS mentions, NULL AS n_in FROM c UNION ALL SELECT s, 'Concept', count(*)::BIGINT, 'DECIDED_FOR ' || count(*) FROM c GROUP BY s
UNION ALL SELECT 'none of them', 'Concept', count(*)::BIGINT, 'DECIDED_AGAINST ' || count(*) FROM c UNION ALL SELECT n, 'Location', count(*)::BIGINT, 'RELATED_TO ' || count(*) FROM c GROUP BY n""")
def decided_graph(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's choice of a segment as a decision: the nodes, and what leads into them."""
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    decisions = c.select(
        F.col("c_custkey").alias("ord"), F.lit(None).cast("string").alias("scope"), F.concat(F.lit("Plan "), F.col("c_custkey").cast("string")).alias("name"), F.lit("of a segment").alias("description"), F.array(F.col("c_mktsegment"), F.lit("None of them")).alias("options"),
        F.col("c_mktsegment").alias("chosen"), F.array(F.struct(F.col("n_name").alias("name"), F.lit("Location").alias("type"))).alias("related"), now().alias("seen"), F.array(F.col("c_custkey").cast("string")).alias("sources"),
    )
    nodes, edges = ingest.decide(spark.createDataFrame([], tables.NODES), spark.createDataFrame([], tables.EDGES), decisions)
    into = edges.groupBy(F.col("target").alias("id")).agg(F.concat_ws(" ", F.min("predicate"), F.sum("weight").cast("string")).alias("n_in"))
    return nodes.join(into, "id", "left").select("id", "type", "mentions", "n_in")


def _revised(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The graph of all orders and who said it, after each seventh was written anew with another priority."""
    none = F.lit(None).cast("string")
    said = lambda name: read(spark, d, "orders").select(
        F.col("o_orderkey").alias("ord"), none.alias("scope"), F.col("o_orderdate").cast("timestamp").alias("seen"), F.array(F.col("o_orderkey").cast("string")).alias("sources"),
        F.array(F.struct(name.alias("name"), F.lit("Concept").alias("type"), none.alias("description"))).alias("entities"),
        F.array(F.struct(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("subject"), F.lit("ORDERED").alias("predicate"), name.alias("object"))).alias("relationships"),
    )
    empty = ingest.apart(spark.createDataFrame([], tables.NODES), spark.createDataFrame([], tables.EDGES))
    graph = ingest.ingest_apart(*empty, said(F.col("o_orderpriority")))
    again = said(F.concat(F.lit("revised "), F.col("o_orderpriority"))).where("ord % 7 = 0")
    return ingest.reingest_apart(*graph, again)


_REVISED_SQL = "o AS (SELECT o_orderkey AS k, 'customer ' || o_custkey AS c, lower(o_orderpriority) AS p, o_orderdate::TIMESTAMP AS t, o_orderkey % 7 = 0 AS u FROM orders)"


@query(f"""WITH {_REVISED_SQL} SELECT p AS id, 'Concept' AS type, count(*)::BIGINT AS mentions, min(t) AS first_seen, max(t) AS last_seen, (count(*) FILTER (NOT u))::BIGINT AS n_sources FROM o GROUP BY p HAVING bool_or(NOT u)
UNION ALL SELECT 'revised ' || p, 'Concept', count(*), min(t), max(t), count(*) FROM o WHERE u GROUP BY p
UNION ALL SELECT c, 'Other', 1, arg_min(t, k), arg_min(t, k), CASE WHEN arg_min(u, k) AND bool_or(NOT u) THEN 0 ELSE 1 END FROM o GROUP BY c""")
def graph_update(spark: SparkSession, d: str) -> DataFrame:
    nodes, _, said, _ = _revised(spark, d)
    return ingest.with_counts(nodes, said, ["id"]).select("id", "type", "mentions", "first_seen", "last_seen", "n_sources")


@query(f"""WITH {_REVISED_SQL} SELECT c AS source, p AS target, count(*)::BIGINT AS weight, (count(*) FILTER (NOT u))::BIGINT AS n_sources, max(t) AS last_seen FROM o GROUP BY 1, 2 HAVING bool_or(NOT u)
UNION ALL SELECT c, 'revised ' || p, count(*), count(*), max(t) FROM o WHERE u GROUP BY 1, 2""")
def graph_update_edges(spark: SparkSession, d: str) -> DataFrame:
    _, edges, _, said = _revised(spark, d)
    return ingest.with_counts(edges, said, ["source", "predicate", "target"]).select("source", "target", "weight", "n_sources", "last_seen")


@query("""WITH n AS (SELECT n_nationkey, lower(n_name) AS n, lower(r_name) AS r FROM nation JOIN region ON r_regionkey = n_regionkey),
d AS (SELECT 'plan ' || c_custkey AS id, 'plan ' || c_custkey || ' for ' || n || ' ' || lower(c_mktsegment) || ' ' || lower(c_mktsegment) || ' none of them' AS said, c_custkey % 7 AS seen, [lower(c_mktsegment), 'region ' || r] AS leads FROM customer JOIN n ON n_nationkey = c_nationkey),
w AS (SELECT n_nationkey::BIGINT AS query, unnest(list_filter(string_split_regex('building plan for ' || n || ' in ' || r || ' with this plan', ' +'), lambda x: length(x) > 2)) AS word FROM n),
own AS (SELECT query, id, count(*)::DOUBLE AS r FROM d JOIN w ON contains(said, word) GROUP BY 1, 2), near AS (SELECT query, id, 0.5 * count(DISTINCT t) AS r FROM (SELECT id, unnest(leads) AS t FROM d) JOIN w ON contains(t, word) GROUP BY 1, 2),
both_ AS (SELECT query, id, sum(r) AS relevance FROM (SELECT * FROM own UNION ALL SELECT * FROM near) GROUP BY 1, 2)
SELECT query, id, relevance::DOUBLE AS relevance, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, seen DESC, id) AS place FROM both_ JOIN d USING (id)) WHERE place <= 10""")
def decisions_asked(spark: SparkSession, d: str) -> DataFrame:
    """The customers' decisions that each nation's context is about."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.lower("n_name").alias("n"), F.lower("r_name").alias("r"))
    c = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("id", F.concat(F.lit("plan "), F.col("c_custkey").cast("string")))
    none = F.lit(None).cast("string")
    made = c.select("id", F.lit("Decision").alias("type"), F.concat(F.lit("for "), "n").alias("description"), F.col("c_mktsegment").alias("chosen"), none.alias("reasoning"), F.array(F.col("c_mktsegment"), F.lit("None of them")).alias("options"), F.lit(None).cast("array<string>").alias("criteria"), F.timestamp_seconds(F.col("c_custkey") % 7).alias("last_seen"))
    edges = c.select(F.col("id").alias("source"), F.explode(F.array(F.lower("c_mktsegment"), F.concat(F.lit("region "), "r"))).alias("target"))
    others = edges.select(F.col("target").alias("id")).distinct().select("id", F.lit("Concept").alias("type"), *[F.lit(None).cast(made.schema[x].dataType).alias(x) for x in made.columns[2:]])
    asked = n.select(F.col("n_nationkey").cast("bigint").alias("query"), F.concat(F.lit("Building plan for "), "n", F.lit(" in "), "r", F.lit(" with this plan")).alias("text"))
    return lifecycle.decisions_for(made.unionByName(others), edges, asked)


_WRAP = "((({0}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"


@query(f"""WITH {GRAPH_SQL}, h AS (SELECT abs(list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(id, ''), lambda c: unicode(c)::HUGEINT)), lambda a, c: {_WRAP.format('a * 33 + c')})) AS h FROM nodes)
SELECT count(*)::BIGINT AS nodes, (SELECT count(*) FROM edges)::BIGINT AS edges, ({_WRAP.format('sum(h)')})::BIGINT AS id_sum FROM h""")
def graph_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return ingest.fingerprint(place_nodes(spark, d), place_edges(spark, d))


# Memories.


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", F.col("t").alias("memory"), F.when(F.col("id") % 7 != 0, now() - F.make_dt_interval((F.col("id") % 200).cast("int"))).alias("created_at"))


@query(f"WITH {TEXTS_SQL}, d AS (SELECT id, t, (id % 200)::BIGINT AS days FROM texts WHERE id % 7 <> 0) SELECT id, days AS days_old, ({scoring.memory_quality_sql('t')})::INT AS quality FROM d WHERE days >= 90 AND ({scoring.memory_quality_sql('t')}) < 3")
def clean_candidates(spark: SparkSession, d: str) -> DataFrame:
    return consolidation.clean_candidates(_dated(spark, d), now()).select("id", "days_old", F.col("quality").cast("int").alias("quality"))


@query(f"""WITH g AS ({SQL["topic_groups"]}), m AS ({SEEDED_SQL}), busy AS (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 4),
f AS (SELECT grp, source, count(*) AS n, 'Decided: ' || string_agg(memory, chr(10) || '- ' ORDER BY id) AS merged FROM g JOIN m USING (id) WHERE source IN (SELECT source FROM busy) GROUP BY 1, 2)
SELECT source AS scope, n::INT AS fragments, CASE WHEN n % 3 = 0 THEN 'no answer' WHEN length(merged) > 20 AND ({scoring.memory_quality_sql('merged')}) >= {P.MIN_MEMORY_QUALITY} THEN 'merged' ELSE 'rejected' END AS outcome FROM f""")
def consolidated(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each source's topics when a provider joins their texts; it gives no answer for every third size."""
    m = seeded(spark, d).select(F.lpad(F.col("id").cast("string"), 18, "0").alias("id"), F.col("source").alias("scope"), "memory")
    groups = pairs._stored(consolidation.fragments(m))
    answers = groups.select("grp", F.when(F.size("ids") % 3 != 0, F.concat(F.lit("Decided: "), "fragments")).alias("merged"))
    _, _, audit = consolidation.consolidate(m, groups, answers, now())
    return audit.select("scope", F.col("fragments").cast("int").alias("fragments"), "outcome")


@query(f"""WITH {STATE_SQL}, p AS (SELECT user_id AS id, max(value) / 50.0 - 0.5 AS confidence, count(*) / 10.0::DOUBLE AS importance FROM events GROUP BY 1)
SELECT coalesce(s.id, p.id) AS id, round(CASE WHEN p.confidence IS NULL THEN s.confidence ELSE greatest(0.0, least(1.0, p.confidence)) END, 6) AS confidence, round(coalesce(p.importance, s.importance), 6) AS importance, s.kind FROM state s FULL JOIN p ON p.id = s.id""")
def payload_set(spark: SparkSession, d: str) -> DataFrame:
    patches = read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg((F.max("value") / 50.0 - 0.5).alias("confidence"), (F.count("*") / 10.0).alias("importance"))
    out = tables.set_payload(memory_state(spark, d), patches, ["confidence", "importance"])
    return out.select("id", F.round("confidence", 6).alias("confidence"), F.round("importance", 6).alias("importance"), "kind")


@query(f"WITH {STATE_SQL}, gone AS (SELECT DISTINCT user_id AS id FROM events) SELECT id, CASE WHEN id IN (SELECT id FROM gone) THEN NULL ELSE importance END AS importance, confidence FROM state")
def payload_cleared(spark: SparkSession, d: str) -> DataFrame:
    return tables.clear_payload(memory_state(spark, d), read(spark, d, "events").select(F.col("user_id").alias("id")), ["importance"]).select("id", "importance", "confidence")


@query(f"WITH {STATE_SQL} SELECT doc_id AS id, CASE WHEN confidence IS NULL THEN 0.5 ELSE confidence END AS confidence, coalesce(s.status, 'active') AS status, coalesce(s.kind, 'fact') AS kind FROM (SELECT doc_id FROM documents) LEFT JOIN state s ON s.id = doc_id AND s.id % 2 = 0")
def listed_feedback(spark: SparkSession, d: str) -> DataFrame:
    """All documents with the feedback on them; half have none."""
    f = memory_state(spark, d).where("id % 2 = 0").select("id", "confidence", F.lit(0).cast("bigint").alias("correct_count"), F.lit(None).cast("timestamp").alias("last_confirmed_at"), "status", "kind", F.lit(None).cast("string").alias("title"))
    return tables.with_defaults(read(spark, d, "documents").select(F.col("doc_id").alias("id")), f).select("id", "confidence", "status", "kind")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 30 OFFSET 60")
def memory_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of thirty, newest first."""
    return tables.page(read(spark, d, "events").select("event_id", "ts"), [F.desc("ts"), F.col("event_id")], limit=30, offset=60)


@query(f"""WITH c AS ({SQL["snapshot_compare"]}), b AS (SELECT id, delta FROM c WHERE found = 'both')
SELECT * FROM (SELECT 'up' AS direction, row_number() OVER (ORDER BY delta DESC, id)::INT AS place, id, delta FROM b) WHERE place <= 20
UNION ALL SELECT * FROM (SELECT 'down', row_number() OVER (ORDER BY delta, id DESC)::INT AS place, id, delta FROM b) WHERE place <= 20""")
def top_movers(spark: SparkSession, d: str) -> DataFrame:
    from .queries import snapshot_compare

    return evaluate.movers(snapshot_compare(spark, d))


@query("""WITH s AS (SELECT 'documents' AS store, CASE WHEN source = 'src1' THEN 'tn-ana' WHEN source = 'src2' THEN 'tn-ana--work' WHEN source = 'src3' THEN 'tn-anabel' END AS scope FROM documents
UNION ALL SELECT 'events', CASE WHEN user_id % 5 = 0 THEN 'tn-ana--x' WHEN user_id % 5 = 1 THEN 'tn-other' END FROM events)
SELECT store, count(*) FILTER (scope = 'tn-ana' OR starts_with(scope, 'tn-ana--'))::BIGINT AS removed, count(*) FILTER (scope IS NULL OR NOT (scope = 'tn-ana' OR starts_with(scope, 'tn-ana--')))::BIGINT AS stays FROM s GROUP BY 1""")
def account_wipe(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(lifecycle.graph_style(F.when(F.col("source") == "src1", "ana").when(F.col("source") == "src2", "ana:work").when(F.col("source") == "src3", "anabel").otherwise("master")).alias("scope"))
    events = read(spark, d, "events").select(F.when(F.col("user_id") % 5 == 0, "tn-ana--x").when(F.col("user_id") % 5 == 1, "tn-other").alias("scope"))
    left, gone = lifecycle.wiped({"documents": docs, "events": events}, "ana", {"documents": F.col("scope"), "events": F.col("scope")})
    stays = None
    for name, t in left.items():
        n = t.agg(F.count("*").alias("stays")).select(F.lit(name).alias("store"), "stays")
        stays = n if stays is None else stays.union(n)
    return gone.join(stays, "store")


# Communities and what queries do with them.


_SEARCH_SQL = f"""WITH {CENTROID_SQL}, q AS (SELECT vec_id AS query, vec_id % 5 AS session, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
done AS (SELECT DISTINCT session, community FROM q, c WHERE community % 3 = session % 3 OR session = 4), s AS (SELECT query, session, community, list_cosine_similarity(v, centroid) AS similarity FROM q, c),
open AS (SELECT s.* FROM s ANTI JOIN done ON done.session = s.session AND done.community = s.community), again AS (SELECT query, community FROM s WHERE query NOT IN (SELECT query FROM open))"""


def _searching(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = _members(spark, d)
    c = partitions.centroids(m)
    q = m.where("id % 20 = 0").select(F.col("id").alias("query"), (F.col("id") % 5).alias("session"), F.lit("some words").alias("text"), F.col("embedding").cast("array<double>").alias("vector"))
    searched = q.select("session").distinct().join(c.select("community"), F.lit(True)).where("community % 3 = session % 3 or session = 4")
    return c, q, searched


@query(f"""{_SEARCH_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, community) AS place FROM open), hit AS (SELECT query, community FROM k WHERE place <= 5 AND similarity >= 0.2)
SELECT query, community FROM hit UNION ALL SELECT query, community FROM open WHERE query NOT IN (SELECT query FROM hit) UNION ALL SELECT query, community FROM again""")
def targeted_search(spark: SparkSession, d: str) -> DataFrame:
    """Communities near each query that its session has not searched; one session has searched all."""
    c, q, searched = _searching(spark, d)
    return partitions.execute(c, q, searched, "targeted", least=0.2).select("query", "community")


@query(f"{_SEARCH_SQL} SELECT query, community FROM open UNION ALL SELECT query, community FROM again")
def continued_search(spark: SparkSession, d: str) -> DataFrame:
    c, q, searched = _searching(spark, d)
    return partitions.execute(c, q, searched, "continue").select("query", "community")


@query("""WITH s AS (SELECT vec_id % 10 AS query, label AS community, count(*) AS nodes, CASE WHEN label % 4 = 0 THEN NULL ELSE 'seen ' || sum(vec_id) END AS output FROM embeddings GROUP BY 1, 2),
p AS (SELECT query, count(*) AS selected, sum(nodes) AS nodes, count(output) AS good, string_agg('---' || chr(10) || chr(10) || '## Partition P-' || community || ': ' || CASE WHEN community % 2 = 0 THEN 'Unknown domain' ELSE 'label ' || community END || chr(10) || '(' || nodes || ' nodes analyzed, keywords: a, l' || community || ')' || chr(10) || chr(10) || output || chr(10) || chr(10), '' ORDER BY community) AS parts FROM s GROUP BY 1)
SELECT query, md5('# Partitioned Graph Synthesis' || chr(10) || 'Full graph: ' || nodes || ' nodes, 7 edges across ' || (selected + 1) || ' partitions.' || chr(10) || 'Swept ' || selected || ' partitions (' || good || ' successful).' || chr(10) || chr(10) || coalesce(parts, '')) AS digest FROM p""")
def synthesis_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What is read to answer each query, out of what sweeps of communities said; some failed."""
    e = read(spark, d, "embeddings").groupBy((F.col("vec_id") % 10).alias("query"), F.col("label").alias("community")).agg(F.count("*").alias("nodes"), F.sum("vec_id").alias("sum"))
    name = F.col("community").cast("string")
    sweeps = e.select("query", "community", F.when(F.col("community") % 2 != 0, F.concat(F.lit("label "), name)).alias("summary"), "nodes", F.array(F.lit("a"), F.concat(F.lit("l"), name)).alias("keywords"), F.when(F.col("community") % 4 != 0, F.concat(F.lit("seen "), F.col("sum").cast("string"))).alias("output"))
    totals = e.groupBy("query").agg(F.sum("nodes").alias("nodes"), F.lit(7).alias("edges"), (F.count("*") + 1).alias("partitions"), F.count("*").alias("selected"))
    return partitions.synthesis_context(sweeps, totals).select("query", F.md5("context").alias("digest"))


# The sweep of duplicates, whose SQL walks through its turns, copies and all.


@query("""WITH RECURSIVE r AS (SELECT conv_id * 1000 + turn AS id, turn::VARCHAR AS s, list_sort(list_filter(string_split_regex(lower(text), '[^a-z0-9_A-Z]+'), lambda w: length(w) > 2)) AS bag FROM conversations),
b AS (SELECT bag, row_number() OVER () AS c FROM (SELECT DISTINCT bag FROM r WHERE len(bag) > 0)), m AS (SELECT id, s, c FROM r JOIN b USING (bag)), t AS (SELECT c, x, count(*) AS f FROM (SELECT c, unnest(bag) AS x FROM b) GROUP BY 1, 2),
n AS (SELECT c, sqrt(sum(f * f)::DOUBLE) AS norm FROM t GROUP BY c), p AS (SELECT a.c, e.c AS d, sum(a.f * e.f)::DOUBLE AS dot FROM t a JOIN t e ON a.x = e.x AND a.c < e.c GROUP BY 1, 2),
k AS (SELECT p.c, d FROM p JOIN n nc ON nc.c = p.c JOIN n nd ON nd.c = d WHERE dot / (nc.norm * nd.norm) >= 0.6), alike AS (SELECT c, d FROM k UNION ALL SELECT d, c FROM k UNION ALL SELECT c, c FROM b),
near AS (SELECT a.id AS i, e.id AS j, a.s >= e.s AS j_goes FROM m a JOIN alike ON alike.c = a.c JOIN m e ON e.c = alike.d AND e.id > a.id),
turns AS (SELECT i, coalesce(list(j) FILTER (j_goes), []) AS lose, coalesce(list(j) FILTER (NOT j_goes), []) AS win, row_number() OVER (ORDER BY i) AS k FROM near GROUP BY i),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone, 0::BIGINT AS turn_of, []::BIGINT[] AS got
  UNION ALL SELECT k, list_concat(gone, got), i, got FROM (SELECT t.k, walk.gone, t.i, CASE WHEN list_contains(walk.gone, t.i) THEN [] ELSE list_concat(list_filter(t.lose, lambda j: NOT list_contains(walk.gone, j)), CASE WHEN len(list_filter(t.win, lambda j: NOT list_contains(walk.gone, j))) > 0 THEN [t.i] ELSE [] END) END AS got FROM walk JOIN turns t ON t.k = walk.k + 1))
SELECT unnest(got) AS id, turn_of AS "by" FROM walk""")
def dedup_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Turns that a sweep at 0.6 archives, and by which, in the order of their ids."""
    rows = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("memory"), F.col("turn").alias("seen"))
    return hygiene.dedup_sweep(rows, least=0.6)
