import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolith.functions import text
from mnemolith.operators import documents, evaluate, graph, hygiene, pairs, partitions, recall
from mnemolith.sources import tables

NOW = dt.datetime(2024, 2, 1)


def words(n, seed):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega".split()) for _ in range(rnd.randint(1, 9))) for _ in range(n)]


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    v[5] = v[6]
    v[7] = 0
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(300, None), (301, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    got = recall.top_k(df, df.where("id % 50 = 5"), 7).orderBy("query", "rank").collect()
    # Many blocks of either side find the same, and the same whether vectors are of floats or of doubles.
    assert recall.top_k(df, df.where("id % 50 = 5"), 7, query_bytes=100, memory_bytes=1000).orderBy("query", "rank").collect() == got
    wide = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert recall.top_k(wide, wide.where("id % 50 = 5").union(wide.where("id = 5")), 7, memory_bytes=3000).orderBy("query", "rank").collect() == got
    unit = np.nan_to_num(v.astype(np.float32).astype(float) / np.linalg.norm(v.astype(np.float32).astype(float), axis=1, keepdims=True))
    for q in range(5, 300, 50):
        s = [(-float(unit[q] @ unit[i]), i) for i in range(300)] + [(-0.0, 300), (-0.0, 301)]
        mine = [r for r in got if r.query == q]
        assert [round(r.score, 9) for r in mine] == [round(-x[0], 9) + 0.0 for x in sorted(s)[:7]]
    assert recall.top_k(df.limit(0), df.limit(0), 3).count() == 0


def test_score_threshold(spark):
    df = spark.createDataFrame([(1, 0.3), (2, 0.45), (3, 0.55), (4, None)], "id int, score double")
    assert [r.id for r in recall.min_score(df, 0.45).collect()] == [2, 3]
    assert recall.min_score(df, 0).count() == 4 == recall.min_score(df, None).count()


def test_rank(spark):
    t = lambda d: dt.datetime(2024, 2, 1) - dt.timedelta(days=d)
    rows = [(1, 1, "mora perto do bar do cioran", 0.6, t(20), None, 1.0, "fact", "active"), (1, 2, "estava no bar", 0.9, t(20), None, None, "state", "active"), (1, 3, "x", 0.99, t(1), None, None, "fact", "archived")]
    df = spark.createDataFrame(rows, "query int, id int, memory string, score double, created_at timestamp, updated_at timestamp, confidence double, kind string, status string").withColumn("importance", F.lit(None).cast("double"))
    kept = df.where("status <> 'archived'")
    got = recall.rank(kept, F.lit(NOW), F.array(F.lit("bar"), F.lit("cioran"))).orderBy("place").collect()
    assert [r.id for r in got] == [1, 2]


def test_context_stops_at_the_first_line_too_long(spark):
    rows = [(1, "g", 1, "x" * 10), (1, "g", 2, "x" * 100), (1, "g", 3, "x"), (1, "p", 4, "y" * 5), (1, "p", 5, "y" * 40), (1, "p", 6, "y")]
    df = spark.createDataFrame(rows, "k int, scope string, ord int, memory string")
    got = recall.context(df, 50, key="k", is_global="scope = 'g'", order=[F.col("ord")])
    assert sorted(r.ord for r in got.collect()) == [1, 4]


@pytest.mark.parametrize("measure,least", [("jaccard", 0.5), ("jaccard", 0.85), ("dice", 0.3)])
def test_set_pairs_lose_nothing(spark, measure, least):
    rows = list(enumerate(words(120, 3)))
    df = spark.createDataFrame([*rows, (900, ""), (901, None)], "id int, t string")
    got = {(r.i, r.j): r.similarity for r in pairs.set_pairs(df.select("id", F.split("t", " ").alias("w")).where("t <> ''"), "id", "w", least, measure).collect()}
    sets = [set(t.split()) for _, t in rows]
    want = {}
    for j in range(120):
        for i in range(j):
            both = len(sets[i] & sets[j])
            s = both / len(sets[i] | sets[j]) if measure == "jaccard" else 2 * both / (len(sets[i]) + len(sets[j]))
            if s >= least:
                want[i, j] = s
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
    return sum(x * b[t] for t, x in a.items()) / n if n else 0.0


def test_cosine_pairs_lose_nothing(spark):
    rows = list(enumerate(words(80, 5)))
    df = spark.createDataFrame(rows, "id int, t string").select("id", text.terms(F.col("t")).alias("w"))
    got = {(r.i, r.j) for r in pairs.tf_cosine_pairs(df, "id", "w", 0.76).collect()}
    bags = [Counter(t.split()) for _, t in rows]
    assert got == {(i, j) for j in range(80) for i in range(j) if cosine(bags[i], bags[j]) >= 0.76}


def sweep(rows, alike, loser):
    gone, by = set(), {}
    for i in range(len(rows)):
        if i in gone:
            continue
        for j in range(i + 1, len(rows)):
            if j not in gone and alike(i, j):
                lost = loser(i, j)
                gone.add(lost)
                by.setdefault(lost, i)
    return by


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_removals_equal_the_loop(spark, seed):
    rnd = random.Random(seed)
    n = 40
    edge = {(i, j): rnd.choice("ij") for j in range(n) for i in range(j) if rnd.random() < 0.12}
    df = spark.createDataFrame([(i, j, x) for (i, j), x in edge.items()], "i int, j int, lost string")
    got = {r.node: r.by for r in pairs.greedy_removals(df, F.when(F.col("lost") == "i", F.col("i")).otherwise(F.col("j"))).collect()}
    assert got == sweep(range(n), lambda i, j: (i, j) in edge, lambda i, j: i if edge[i, j] == "i" else j)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_dedup_sweep_equals_the_loop(spark, seed):
    """Copies, the same words in another order, texts without terms, nulls and ties, all in the order of ids."""
    rnd = random.Random(seed)
    base = words(14, 5) + ["", "a b", None]
    texts = [rnd.choice(base) for _ in range(60)]
    texts = [" ".join(rnd.sample(t.split(), len(t.split()))) if t and rnd.random() < 0.3 else t for t in texts]
    seen = [rnd.choice([None, *range(6)]) for _ in texts]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, seen))], "id int, memory string, seen int").repartition(5)
    got = {r.id: r.by for r in hygiene.dedup_sweep(df, least=0.6).collect()}
    bags = [Counter(w for w in (t or "").split() if len(w) > 2) for t in texts]
    at = ["" if s is None else str(s) for s in seen]
    assert got == sweep(texts, lambda i, j: bool(bags[i] and bags[j]) and cosine(bags[i], bags[j]) >= 0.6, lambda i, j: j if at[i] >= at[j] else i)
    assert len(got) > 20 and any(i == by for i, by in got.items())


def test_dedup_sweep_of_nothing(spark):
    assert hygiene.dedup_sweep(spark.createDataFrame([], "id int, memory string, seen int")).count() == 0
    alone = spark.createDataFrame([(1, "one thing here", 3), (2, "quite another matter", 1), (3, None, 2)], "id int, memory string, seen int")
    assert hygiene.dedup_sweep(alone).count() == 0


def test_topic_groups(spark):
    rows = [(0, "[Seed: Plan] a"), (1, "[Seed: plan ] b"), (2, "[Seed: Other] c"), (3, "garden flowers summer"), (4, "garden flowers winter"), (5, "completely different subject"), (6, "summer winter autumn")]
    df = spark.createDataFrame(rows, "id int, memory string")
    got = sorted((r.grp, r.id) for r in hygiene.topic_groups(df).collect())
    assert got == [("seed:plan", 0), ("seed:plan", 1), ("topic:3", 3), ("topic:3", 4), ("topic:3", 6)]


def test_conflicts_and_reaper(spark):
    same = "dark mode is used in the editor"
    df = spark.createDataFrame([(1, same, None, None), (2, same, 7, same), (3, same, 8, "other words entirely")], "id int, memory string, candidate int, other string")
    assert {r.id: r.action for r in hygiene.conflict_action(df).collect()} == {1: "ADD", 2: "NOOP", 3: "REVIEW"}
    t = dt.datetime(2024, 2, 1)
    rows = [(1, None, 0.1), (2, t - dt.timedelta(days=89), 0.1), (3, t - dt.timedelta(days=90), 0.1), (4, t - dt.timedelta(days=91), None), (5, t - dt.timedelta(days=91), 0.3)]
    ev = spark.createDataFrame(rows, "id int, t timestamp, i double").select("id", hygiene.reaper_event(F.col("t"), F.col("i"), F.lit(NOW)).alias("e"))
    assert [r.e for r in ev.orderBy("id").collect()] == ["skip_age", "skip_age", "dry_purge", "skip_no_importance", "skip_importance"]


def test_slices_go_round(spark):
    for total, cursor, size, want in [(100, 90, 20, {*range(90, 100), *range(10)}), (5, 3, 20, set(range(5))), (0, 0, 5, set())]:
        df = spark.range(total)
        assert {r.id for r in hygiene.slice_of(df, cursor, size, [F.col("id")]).collect()} == want


def test_archive_and_restore(spark):
    m = spark.createDataFrame([(1, "a"), (2, "trash"), (3, "b")], "id int, scope string")
    doomed = spark.createDataFrame([(1, "old"), (1, "old"), (2, "x"), (9, "y")], "id int, reason string")
    stay, trash, audit = hygiene.archive(m, doomed, F.lit(NOW))
    assert sorted(r.id for r in stay.collect()) == [2, 3]
    assert {r.id: r.outcome for r in audit.collect()} == {1: "archived", 2: "refused", 9: "missing"}
    assert [tuple(r) for r in hygiene.restore(trash, doomed, F.lit(NOW)).collect()] == [(1, "a")]
    assert hygiene.restore(trash, doomed, F.lit(dt.datetime(2024, 2, 9))).count() == 0


def test_rejected_entities(spark):
    bad = ["fed76be", "192.168.0.177", "get /api/vault/audit", "xp", "713", "december 2025", "speaker 4", "558132640725"]
    good = ["marta", "acme corp", "typescript", "recife"]
    got = {r.n: r.x for r in spark.createDataFrame([(x,) for x in bad + good], "n string").select("n", graph.is_rejected(F.col("n")).alias("x")).collect()}
    assert all(got[x] for x in bad) and not any(got[x] for x in good)


NODE = "id string, scope string, name string, type string, description string, first_seen timestamp, last_seen timestamp, mentions bigint, sources array<string>"
EDGE = "source string, predicate string, target string, weight bigint, first_seen timestamp, last_seen timestamp, sources array<string>"


def node(i, mentions=1, sources=None, kind="Other", last=None, description=None):
    return (i, "", i, kind, description, None, last, mentions, sources)


def test_entity_pairs_equal_all_pairs(spark):
    rnd = random.Random(4)
    names = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7))) for _ in range(60)})
    nodes = spark.createDataFrame([node(n) for n in names], NODE)

    def sim(a, b):
        x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
        return 0.8 if a in b or b in a else 2 * len(x & y) / max(1, len(x) + len(y))

    got = {(r.i, r.j) for r in graph.similar_entities(nodes, 0.75).collect()}
    assert got == {(a, b) for a in names for b in names if a < b and sim(a, b) >= 0.75}


def test_resolution(spark):
    nodes = spark.createDataFrame([node("javascript", 5, ["a"]), node("java", 2, ["b"], description="long text"), node("redis", 1), node("java script", 9)], NODE)
    edges = spark.createDataFrame([("java", "P", "redis", 3, None, None, ["x"]), ("javascript", "P", "redis", 1, None, None, ["y"]), ("java", "P", "javascript", 1, None, None, None)], EDGE)
    n, e, mapping = graph.resolve(nodes, edges)
    assert {tuple(r) for r in mapping.collect()} == {("java", "java script", 11), ("java", "javascript", 7), ("javascript", "java script", 18)}
    merged = {r.id: r for r in n.collect()}
    assert merged["java script"].mentions == 18 and set(merged) == {"java script", "redis"} and merged["java script"].sources == ["a", "b"] and merged["java script"].description == "long text"
    assert [(r.source, r.target, r.weight, r.sources) for r in e.collect()] == [("java script", "redis", 3, ["x", "y"])]


@pytest.mark.parametrize("seed", range(3))
def test_resolution_with_running_sums_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 6))) for _ in range(50)})
    have = {n: {"mentions": rnd.randint(1, 4), "sources": {f"s{rnd.randint(0, 9)}"}, "description": rnd.choice(["", "x", "longer"]) + n} for n in names}
    edges = {(a, b): rnd.randint(1, 9) for a, b in ((rnd.choice(names), rnd.choice(names)) for _ in range(80)) if a != b}
    nodes = spark.createDataFrame([node(n, v["mentions"], sorted(v["sources"]), description=v["description"]) for n, v in have.items()], NODE)
    e = spark.createDataFrame([(a, "P", b, w, None, None, None) for (a, b), w in edges.items()], EDGE)
    got_n, got_e, merges = graph.resolve(nodes, e, 0.6)

    def sim(a, b):
        x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
        return 0.8 if a in b or b in a else 2 * len(x & y) / max(1, len(x) + len(y))

    gone, log, ends = set(), [], set(edges)
    for k, i in enumerate(names):
        if i in gone:
            continue
        for j in names[k + 1 :]:
            if j in gone or sim(i, j) < 0.6:
                continue
            stays, goes = (i, j) if have[i]["mentions"] >= have[j]["mentions"] else (j, i)
            c, d = have[stays], have[goes]
            c["mentions"] += d["mentions"]
            c["sources"] |= d["sources"]
            c["description"] = d["description"] if len(d["description"]) > len(c["description"]) else c["description"]
            for a, b in [x for x in ends if goes in x]:
                moved = (stays if a == goes else a, stays if b == goes else b)
                if moved[0] != moved[1]:
                    ends.add(moved)
            gone.add(goes)
            log.append((goes, stays, c["mentions"]))
    assert sorted(map(tuple, merges.collect())) == sorted(log) and len(log) > 10
    left = {r.id: r for r in got_n.collect()}
    assert set(left) == set(names) - gone
    assert {n: (r.mentions, set(r.sources), len(r.description)) for n, r in left.items()} == {n: (have[n]["mentions"], have[n]["sources"], len(have[n]["description"])) for n in left}
    assert {(r.source, r.target) for r in got_e.collect()} == {x for x in ends if not gone & set(x)}


def test_reach_sweep_and_provenance(spark):
    t = dt.datetime(2024, 1, 31)
    nodes = spark.createDataFrame([node("alpha", 9, ["d"], last=t), node("beta", 1, ["d", "e"], last=t), node("gamma", 1, ["d"], last=dt.datetime(2023, 1, 1)), node("delta", 1, None, last=t), node("fed76be", 9, last=t), node("aspirin", 1, ["d"], "Medication", t)], NODE)
    edges = spark.createDataFrame([("alpha", "P", "beta", 1, None, None, ["d", "e"]), ("beta", "P", "gamma", 1, None, None, ["d"])], EDGE)
    got = {(r.id, r.depth) for r in graph.reach(nodes.where("id = 'alpha'"), edges, 3).collect()}
    assert got == {("alpha", 0), ("beta", 1), ("gamma", 2)}
    assert {r.id: r.reason for r in graph.sweep(nodes, edges, F.lit(NOW)).collect()} == {"alpha": None, "beta": None, "gamma": "stale", "delta": "orphan", "fed76be": "pattern", "aspirin": None}
    n, e = graph.without_source(nodes, edges, "d")
    assert sorted(r.id for r in n.collect()) == ["alpha", "beta", "delta", "fed76be"] and e.count() == 1
    assert graph.to_markdown(nodes, edges).where("id = 'alpha'").first().markdown == "- **alpha** (Other) P: beta"
    n2, e2 = graph.subgraph(nodes, edges, "alpha")
    assert {r.id for r in n2.collect()} == {"alpha", "beta", "gamma"} and e2.count() == 2
    assert {r.id for r in graph.matches(nodes, "alfa alpah").collect()} == set() and {r.id for r in graph.matches(nodes, "alphaa").collect()} == {"alpha"}


def communities_of(spark, ids, edges):
    n = spark.createDataFrame([(i,) for i in ids], "id string")
    e = spark.createDataFrame(edges, "source string, target string, weight double")
    return {r.id: r.community for r in partitions.communities(n, e).collect()}


def test_communities(spark):
    triangles = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("f", "d", 1.0), ("c", "d", 0.1)]
    got = communities_of(spark, "abcdef", triangles)
    assert sorted(Counter(got.values()).values()) == [3, 3] and set(got.values()) == {0, 1} and len({got[x] for x in "abc"}) == 1
    with_tail = communities_of(spark, "abcdefg", [*triangles, ("g", "a", 0.2), ("g", "g", 5.0), ("g", "unknown", 5.0)])
    assert with_tail["g"] == with_tail["a"] and len(with_tail) == 7
    assert set(communities_of(spark, "abc", [("a", "a", 1.0)]).values()) == {0}


def test_centroids_keywords_and_routes(spark):
    m = spark.createDataFrame([(1, [1.0, 0.0, 0.0], "Machine learning is fun", 1.0), (1, [0.0, 1.0, 0.0], "learning machine", 2.0), (1, [0.0, 0.0, 1.0], "deep learning", 0.5), (2, None, "x", 0.1)], "community int, embedding array<float>, concept string, weight double").withColumn("id", F.monotonically_increasing_id())
    assert [r.centroid for r in partitions.centroids(m).collect()] == [pytest.approx([1 / 3] * 3)]
    words_ = partitions.keywords(m)
    assert [(r.word, r.n) for r in words_.where("community = 1").orderBy("place").limit(2).collect()] == [("learning", 3), ("machine", 2)]
    assert partitions.summary(words_, m).where("community = 1").first().summary.endswith("Top: learning machine...")
    p = spark.createDataFrame([(i, [1.0, 0.0] if i == 2 else [0.0, 1.0]) for i in range(7)], "community int, centroid array<double>")
    q = spark.createDataFrame([(1, "about x", [1.0, 0.0]), (2, "about x", None), (3, "tell me everything", [1.0, 0.0])], "query int, text string, vector array<double>")
    got = {k: [r.community for r in partitions.route(p, q).where(f"query = {k}").orderBy("place").collect()] for k in (1, 2, 3)}
    assert got == {1: [2], 2: [0, 1, 2, 3, 4], 3: [0, 1, 2, 3, 4]}
    assert partitions.still_to_search(p, p.where("community < 6")).count() == 1 and partitions.still_to_search(p, p).count() == 7


def test_chunks(spark):
    assert documents.chunks("a\n\nb") == ["a\n\nb"] and documents.chunks("") == documents.chunks(None) == []
    assert documents.chunks("aaaa\n\nbbbb", 5) == ["aaaa", "bbbb"]
    assert documents.chunks("One. Two! rest without end", 10) == ["One.  Two!"]
    assert documents.chunks("x" * 20, 10) == ["x" * 20]
    df = spark.createDataFrame([(1, "a b. " * 30), (2, None)], "doc_id int, text string")
    assert [(r.doc_id, r.chunk) for r in documents.chunk_text(df, most=100).collect()][0] == (1, 0)


def test_pages_and_titles(spark):
    html = "<html><title>T</title><style>p{}</style><script>x='</p>'</script><p>a &amp; b</p><!-- c --><li>d</li></html>"
    assert spark.createDataFrame([(html,)], "h string").select(documents.page_text(F.col("h"))).first()[0] == "T\na & b\nd"
    facts = ["O usuário toma sertralina.", "Na época do curso, o usuário está com dor forte na cabeça toda", "x"]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in facts], "f string").select(documents.fallback_title(F.col("f"))).collect()]
    assert got == ["Toma sertralina", "Dor forte na cabeça toda", "X"]


def test_chat_facts(spark):
    said = ["O usuário mora em Recife", "o usuário MORA em recife", "Bom dia, o usuário chegou", "sem a âncora de sempre aqui", "o usuário toma sertralina", "The user lives in Recife now", "Segundo o assistente, o usuário saiu", "sim!!", "According to the assistant all is fine, user"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(said)], "c int, t int, text string")
    got = documents.chat_facts(df, key="c", order="t").orderBy("place").collect()
    assert [(r.place, r.fact) for r in got] == [(1, "O usuário mora em Recife"), (2, "Bom dia, o usuário chegou"), (3, "o usuário toma sertralina"), (4, "The user lives in Recife now")]
    raw = spark.createDataFrame([((9.0, "x", None),), ((4.0, "state", True),)], "r struct<relevance: double, kind: string, sensitive: boolean>")
    assert [tuple(r[0]) for r in raw.select(documents.rating(F.col("r"))).collect()] == [(3, "fact", False), (4, "state", True)]


@pytest.mark.parametrize(
    ("text_", "tenant", "want"),
    [
        ("Na conversa de hoje, o assistente comentou que o episódio é bom.", None, False),
        ("Segundo o assistente, os dois episódios citados pelo usuário ficam na emenda.", None, False),
        ("The Parking Space acaba sem revelar quem venceu a luta.", None, False),
        ("sim", None, False),
        ("O usuário tem a série como conforto: já assistiu todos os episódios.", None, True),
        ("O usuario mora em Recife hoje", None, True),
        ("Obrigado..........", None, False),
        ("Ana prefere chá à noite.", "Ana Lima", True),
        ("Anabel prefere chá à noite.", "Ana Lima", False),
        ("Mora com ANA LIMA em Recife", "Ana Lima", True),
        ("Mora com ana-lima em Recife", "Ana Lima", True),
        ("Gosta de chá (C++) à noite", "C++", True),
        ("Gosta de chá à noite, sempre", "A", False),
        (None, "Ana", False),
    ],
)
def test_accepted_facts(spark, text_, tenant, want):
    row = spark.createDataFrame([(text_, tenant)], "t string, n string").select(documents.accepts_fact(F.col("t"), tenant_name=F.col("n")).alias("ok")).first()
    assert row.ok is want


def test_chat_titles(spark):
    fact = "O usuário, reassistindo a série em ordem, disse que gostou."
    rows = [("O usuário curtiu a vaga do amigo.", "Curtiu a vaga do amigo"), ("", "Reassistindo a série em ordem"), (None, "Reassistindo a série em ordem"), ("«Um título: de, mais; de seis palavras ao todo»", "Um título de mais de seis"), ("série conforto", "Série conforto")]
    got = spark.createDataFrame([(r, fact) for r, _ in rows], "r string, f string").select(documents.chat_title(F.col("r"), F.col("f")).alias("t")).collect()
    assert [r.t for r in got] == [w for _, w in rows]


def test_block_list_words_and_files(spark, tmp_path):
    rows = ["  O usuário TOMOU Bupropiona, né?  ", "日本語", "ﬁ e\u0301 Ấ straße", "a_b\u00a0c"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(text.normalize_for_blocklist(F.col("t"))).collect()]
    assert got == ["o usuario tomou bupropiona ne", "", "e a stra e", "a b c"]
    where = str(tmp_path / "list")
    none, ok = tables.saved_block_list(spark, where)
    assert ok and none.count() == 0
    hashes = spark.createDataFrame([("Esquecer isto",), ("e isto",)], "t string").select(text.blocklist_hash(F.col("t")).alias("hash"))
    tables.save_block_list(hashes, where)
    tables.save_block_list(hashes, where)
    known, ok = tables.saved_block_list(spark, where)
    memories = spark.createDataFrame([(1, "esquecer, ISTO!"), (2, "We decided to use PostgreSQL on 3 May 2023 because of JSON"), (3, None), (4, " ")], "id int, memory string")
    verdicts = lambda **k: {r.id: r.verdict for r in hygiene.gate(memories, **k).collect()}
    assert ok and known.count() == 2 and verdicts(blocked=known)[1] == "blocked" and verdicts(blocked=known)[2] == "saved"
    for broken in ("[1, 2]", "{", '{"a": 1}', '["x", null]'):
        (tmp_path / "list" / "bad.txt").write_text(broken)
        _, ok = tables.saved_block_list(spark, where)
        assert not ok
    assert verdicts(block_all=True) == {1: "blocked", 2: "blocked", 3: "rejected", 4: "low_quality"}


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 3, True), (2, 1, True), (3, 9, True), (4, 1, False)], "query int, place int, good boolean")
    assert {r.query: (r.first, r.hit1, r.hit5) for r in evaluate.hits(df, F.col("good")).collect()} == {1: (3, False, True), 2: (1, True, True), 3: (9, False, False), 4: (None, False, False)}


def test_chunk_sentences_are_the_pattern():
    assert re.findall(r"[^.!?]+[.!?]+", "a. b?! c") == documents._SENTENCE.findall("a. b?! c")
