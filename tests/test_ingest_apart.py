from pyspark.sql import functions as F

from mnemolith.operators import ingest
from mnemolith.sources import tables


def test_sources_apart_equal_sources_in_arrays(spark):
    kind = "ord bigint, scope string, seen timestamp, sources array<string>, entities array<struct<name:string,type:string,description:string>>, relationships array<struct<subject:string,predicate:string,object:string>>"
    event = lambda k, name: (k, None, None, [f"m{k % 4}"], [(name, "Concept", f"said {k}")], [(f"Person {k % 3}", "LIKES", name)])
    before = spark.createDataFrame([event(k, f"Subject {k % 2}") for k in range(12)], kind)
    after = spark.createDataFrame([event(k, "Subject new") for k in (1, 3, 5)], kind)
    nodes, edges = spark.createDataFrame([], tables.NODES), spark.createDataFrame([], tables.EDGES)
    n, e = ingest.reingest(*ingest.ingest(nodes, edges, before), after)
    bare_n, bare_e, of_n, of_e = ingest.reingest_apart(*ingest.ingest_apart(*ingest.apart(nodes, edges), before), after)
    key = ["source", "predicate", "target"]
    plain = lambda t: sorted(map(tuple, t.collect()), key=repr)
    assert plain(n.select("id", F.explode("sources"))) == plain(of_n.select("id", "by")) and plain(e.select(*key, F.explode("sources"))) == plain(of_e.select(*key, "by"))
    assert plain(n.drop("sources")) == plain(bare_n.drop("known")) and plain(e.drop("sources")) == plain(bare_e.drop("known"))
    counted = ingest.with_counts(bare_n, of_n, ["id"])
    assert plain(counted.select("id", "n_sources")) == plain(n.select("id", F.size("sources").cast("bigint")))
    # No group gathers its sources.
    assert not any("collect_" in t._jdf.queryExecution().optimizedPlan().toString() for t in (counted, bare_e, of_n, of_e))
