import datetime as dt

from pyspark.sql import functions as F

from mnemolith.operators import lifecycle

T = dt.datetime(2024, 2, 1)
QUEUE = "id string, kind string, status string, scope string, memory_id string, memory string, reason string, verdict string, attempts int, detected_at timestamp, updated_at timestamp"


def test_queue(spark):
    q = spark.createDataFrame([], QUEUE)
    v = spark.createDataFrame([("merge", None, "m1", "x" * 3000, "r", "UPDATE")] * 2 + [("merge", None, "m2", "t", "r", "DELETE")], "kind string, scope string, memory_id string, memory string, reason string, verdict string")
    stored = lambda df: spark.createDataFrame(df.collect(), QUEUE)  # noqa: E731  a table is written after each step
    q = stored(lifecycle.enqueue(q, v, F.lit(T)))
    again = lifecycle.enqueue(q, v, F.lit(T + dt.timedelta(days=1)))
    assert q.count() == 2 == again.count() and q.where("memory_id = 'm1'").first().memory == "x" * lifecycle.MAX_TEXT
    for n in (1, 2, 3):
        claimed, q = lifecycle.claim(q, None, F.lit(T))
        assert {r.attempts for r in claimed.collect()} == {n}
        q = stored(q)
    assert lifecycle.claim(q, None, F.lit(T))[0].count() == 0
    q = stored(lifecycle.set_status(q, q.where("memory_id = 'm1'"), "dismissed", F.lit(T)))
    assert {r.memory_id: r.status for r in q.collect()} == {"m1": "dismissed", "m2": "pending"}
    assert lifecycle.pruned(q, 0).count() == 1


def test_saving(spark):
    long = "Acme Corp decided on 2024-05-03 to pay $ 1,200 for the yearly plan"
    new = spark.createDataFrame([("1", long), ("2", long + " again"), ("3", "ok"), ("4", long)], "id string, memory string")
    candidates = spark.createDataFrame([("2", "9", "something else"), ("4", "8", long)], "id string, candidate string, other string")
    said = spark.createDataFrame([("2", "UPDATE", ["9"])], "id string, action string, supersedes array<string>")
    got = {r.id: (r.verdict, r.action, r.supersedes) for r in lifecycle.save_with_conflicts(new, candidates, said).collect()}
    assert got == {"1": ("saved", "ADD", []), "2": ("saved", "UPDATE", ["9"]), "3": ("low_quality", "ADD", []), "4": ("duplicate", "NOOP", [])}


def test_enriched(spark):
    rows = [("The API endpoint", "The API  endpoint is GET /v1 with token: abc", True), ("The API endpoint", "The API endpoint at https://new.com/x", False), ("The API endpoint", "Another API endpoint", False), ("The API endpoint", "", False), ("x", None, False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.select("want", lifecycle.accepts_enriched(F.col("a"), F.col("b")).alias("got")).collect())


def test_merged_results(spark):
    schema = "doc_id int, chunk int, title string, summary string, facts array<string>, entities array<struct<name: string, type: string, description: string>>, relationships array<struct<subject: string, predicate: string, object: string>>"
    rows = [(1, 0, "T", "one", ["f1", "f2"], [("Ana", "Person", "short")], [("a", "b", "c")]), (1, 1, "U", "two", ["f2", "f3"], [("ana ", "Person", "longer text"), ("Bob", "Person", "")], [("a", "b", "c"), ("a", "b", "d")])]
    r = lifecycle.merged_results(spark.createDataFrame(rows, schema)).first()
    assert (r.title, r.summary, r.facts) == ("T", "one two", ["f1", "f2", "f3"])
    assert [(e.name, e.description) for e in r.entities] == [("ana ", "longer text"), ("Bob", "")] and len(r.relationships) == 2


def test_decisions(spark):
    n = spark.createDataFrame([("use postgres", "Decision", "database choice", ["postgres", "mysql"], ["cost"], "postgres", "json", T), ("other", "Decision", None, None, None, None, None, T), ("postgres", "Technology", None, None, None, None, None, T)], "id string, type string, description string, options array<string>, criteria array<string>, chosen string, reasoning string, last_seen timestamp")
    e = spark.createDataFrame([("use postgres", "postgres"), ("other", "mysql")], "source string, target string")
    got = {r.id: r.relevance for r in lifecycle.query_decisions(n, e, "postgres or mysql").collect()}
    assert got == {"use postgres": 2.5, "other": 0.5}
    assert lifecycle.query_decisions(n, e, "a").count() == 0


def test_tenants_and_small_ones(spark):
    df = spark.createDataFrame([("  José da_Silva!! ",), ("a",), ("Admin",), ("x" * 31 + " y",)], "n string").select(lifecycle.tenant_slug(F.col("n")).alias("s"))
    assert [(r.s, r.p) for r in df.select("s", lifecycle.slug_problem(F.col("s")).alias("p")).collect()] == [("jose-da-silva", None), ("a", "too short"), ("admin", "reserved"), ("x" * 31, None)]
    t = spark.createDataFrame([("tn-a",), ("tn-a--p",), ("tn-ab",), (None,)], "scope string")
    assert lifecycle.without_tenant(t, "a", F.col("scope")).count() == 2
    m = spark.createDataFrame([("1", "t", "a", None), ("2", "u", "a", "9"), ("3", "t", "b", None)], "id string, memory string, scope string, original_id string").withColumn("created_at", F.lit(T))
    assert [r.id for r in lifecycle.moved_scope(m, F.lit(True), "b").collect()] == ["2"]
    dump = spark.createDataFrame([("9", T - dt.timedelta(days=5))], "id string, created_at timestamp")
    assert {r.id: r.created_at for r in lifecycle.repaired_dates(m, dump).collect()}["2"] == T - dt.timedelta(days=5)
    b = spark.createDataFrame([("one two three four five six seven",)], "memory string")
    x = spark.createDataFrame([(1, "one two three four five six seven"), (2, "another text")], "id int, memory string")
    assert [r.id for r in lifecycle.bundle_exists(b, x).collect()] == [1]
    f = spark.createDataFrame([(1, 1, "ok"), (1, 2, "Acme Corp has 3 offices")], "doc_id int, ord int, fact string")
    assert [r.ord for r in lifecycle.good_facts(f).collect()] == [2]
    s = spark.createDataFrame([("1", None), ("2", 0.4)], "id string, importance double")
    assert [tuple(r) for r in lifecycle.backfill_importance(s, m).collect()] == [("1", 0.2)]
    log = spark.createDataFrame([(1, "a", "{}", 1), (2, "b", "{}", 1), (3, "a", "{}", 1)], "timestamp bigint, action string, details string, duration_ms bigint")
    assert [r.timestamp for r in lifecycle.log_entries(log, "a", 1).collect()] == [3] and lifecycle.log_kept(log, 2).count() == 2
    assert {r.action: r.runs for r in lifecycle.log_actions(log).collect()} == {"a": 2, "b": 1}


def test_decisions_for_many_contexts_equal_a_plain_scan(spark):
    import random

    rnd = random.Random(7)
    syllables = ["red", "blue", "is", "post", "gres", "my", "sql", "cache"]
    name = lambda: "".join(rnd.choices(syllables, k=2))
    decisions = [(f"pick {name()} {i}", "Decision", rnd.choice([None, name()]), name(), None, rnd.choice([None, [name(), name()]]), None, rnd.randint(0, 3)) for i in range(25)]
    others = [(x, "Concept", None, None, None, None, None, 0) for x in sorted({name() for _ in range(20)})]
    edges = sorted({(rnd.choice(decisions)[0], rnd.choice(others)[0], p) for p in ("FOR", "AGAINST") for _ in range(40)})
    texts = [" ".join(rnd.choice(syllables + ["of"]) for _ in range(rnd.randint(0, 5))) for _ in range(12)] + ["RED  Red", None, "a b"]
    nodes = spark.createDataFrame(decisions + others, "id string, type string, description string, chosen string, reasoning string, options array<string>, criteria array<string>, last_seen int")
    got = {}
    for r in lifecycle.decisions_for(nodes, spark.createDataFrame(edges, "source string, target string, predicate string"), spark.createDataFrame(list(enumerate(texts)), "query int, text string"), most=4).collect():
        got.setdefault(r["query"], {})[r.place] = (r.id, r.relevance)
    want = {}
    for q, t in enumerate(texts):
        words = [w for w in (t or "").lower().split() if len(w) > 2]
        scored = []
        for i, _, d, c, _, o, _, seen in decisions:
            said = " ".join(x for x in [i, d, c, *(o or [])] if x)
            r = sum(w in said for w in words) + 0.5 * len({b for a, b, _ in edges if a == i and any(w in b for w in words)})
            if r:
                scored.append((-r, -seen, i))
        if scored:
            want[q] = {k + 1: (i, -r) for k, (r, _, i) in enumerate(sorted(scored)[:4])}
    assert got == want


def test_a_context_has_heads(spark):
    from mnemolith.operators import recall

    rows = [(1, 1, "g", "one"), (1, 2, "p", "two"), (1, 3, "p", "three is far too long"), (2, 1, "p", "only"), (3, 1, "g", "x" * 40), (4, 1, "g", None)]
    df = spark.createDataFrame(rows, "conv int, turn int, role string, memory string")
    got = {r.conv: r.context for r in recall.spawn_context(df, 12, key="conv", is_global="role = 'g'", order=[F.col("turn")]).collect()}
    assert got == {1: "## Global (preferences & facts)\n- one\n\n## Project: 1\n- two", 2: "## Project: 2\n- only"}
