"""Subgraphs of many queries against a walk of one after the other."""

import random

import pytest

from mnemolith.functions import patterns as P
from mnemolith.operators import lookup


def bigrams(s):
    return {s[i : i + 2] for i in range(len(s) - 1)}


def similar(a, b):
    if not a or not b:
        return 0
    if a == b:
        return 1
    if a in b or b in a:
        return 0.8
    x, y = bigrams(a), bigrams(b)
    return 2 * len(x & y) / max(len(x) + len(y), 1)


def plain(nodes, edges, text, max_depth, max_nodes):
    words = [w for w in text.lower().split() if len(w) >= 4 and w not in P.GRAPH_STOPWORDS]
    if not words:
        return [], []
    need = 2 if len(words) > 1 else 1
    hits = [n for n in nodes if sum(w in n for w in words) >= need]
    if not hits and len(words) == 1:
        hits = [n for n in nodes if similar(words[0], n) >= 0.65 or any(similar(words[0], t) >= 0.65 for t in n.split(" "))]
    out = {n: [e for e in edges if e[0] == n and e[2] in nodes] for n in nodes}
    visited, context = [], []
    for start in hits:
        if len(visited) >= max_nodes:
            break
        queue, known = [(start, 0)], {start}
        while queue:
            n, depth = queue.pop(0)
            if depth > max_depth or len(visited) >= max_nodes:
                continue
            if n not in visited:
                visited.append(n)
            context += out[n]
            for e in out[n]:
                if e[2] not in known:
                    known.add(e[2])
                    queue.append((e[2], depth + 1))
    return visited, context


@pytest.fixture(scope="module")
def graph():
    rnd = random.Random(6)
    parts = ["garden", "gardens", "letter", "window", "zebra", "riverside", "a", "ob", "stone wall", "moon"]
    nodes = sorted({f"{rnd.choice(parts)} {rnd.choice(parts)} {i % 40}" for i in range(120)} | {"garden", "x", "respiridona tablets"})
    edges = [(rnd.choice(nodes), rnd.choice("pqr"), rnd.choice([*nodes, "nowhere"])) for _ in range(420)] + [(nodes[0], "p", n) for n in nodes[::2]]
    return nodes, sorted(set(edges), key=lambda e: (e[2], e[1], e[0]))


@pytest.mark.parametrize(("depth", "most"), [(3, 10), (1, 4), (2, 1), (0, 7), (3, 1000)])
def test_many_subgraphs_equal_walks_one_by_one(spark, graph, depth, most):
    nodes, edges = graph
    texts = ["garden letter", "garden", "risperidone", "gardenn", "what about windows", "zebra zebra", "the", "", None, "qqqqq", "stone wall moon riverside", "letters", "RIVERSIDE", "moooon", "zzzza"]
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    e = spark.createDataFrame([(*x, i) for i, x in enumerate(edges)], "source string, predicate string, target string, weight int")
    q = spark.createDataFrame(list(enumerate(texts)), "query int, text string")
    found, context = lookup.subgraphs(n, e, q, max_depth=depth, max_nodes=most)
    got, had = {}, {}
    for r in sorted(found.collect(), key=lambda r: (r.query, r.place)):
        got.setdefault(r.query, []).append(r.id)
    for r in context.collect():
        had.setdefault(r.query, []).append((r.source, r.predicate, r.target))
    want = {i: plain(nodes, edges, t or "", depth, most) for i, t in enumerate(texts)}
    assert got == {i: v for i, (v, _) in want.items() if v}
    assert {i: sorted(x) for i, x in had.items()} == {i: sorted(x) for i, (_, x) in want.items() if x}
    assert sum(bool(v) for v, _ in want.values()) >= 9


def test_lookup_without_rows(spark, graph):
    n, e, q = (spark.createDataFrame([], s) for s in ("id string", "source string, predicate string, target string", "query int, text string"))
    found, context = lookup.subgraphs(n, e, q)
    assert found.count() == 0 == context.count()
    some = spark.createDataFrame([(1, "garden")], "query int, text string")
    assert lookup.matches(n, some).count() == 0
