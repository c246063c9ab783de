"""Exact recall over any ids, and the index of vectors against it."""

import uuid

import numpy as np
import pytest

from mnemolith.operators import index, recall


def vectors(n, width=24, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, width)) * 3
    return (centers[rng.integers(0, groups, n)] + rng.normal(size=(n, width))).astype(np.float32)


def frame(spark, v, ids, kind="string"):
    return spark.createDataFrame([(i, x.tolist() if hasattr(x, "tolist") else x) for i, x in zip(ids, v)], f"id {kind}, embedding array<float>")


def exact(v, ids, k):
    u = np.asarray(v, float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    return {ids[q]: [ids[i] for i in sorted(range(len(ids)), key=lambda i: (-round(s[q, i], 12), ids[i]))[:k]] for q in range(0, len(ids), 20)}


def uuids(n):
    return [str(uuid.UUID(int=(i * 0x9E3779B97F4A7C15F39CC0605CEDC835) % (1 << 128))) for i in range(n)]


@pytest.mark.parametrize("blocks", [{}, {"query_bytes": 2000, "memory_bytes": 5000}])
def test_top_k_with_uuids_and_ties(spark, blocks):
    v = vectors(300)
    v[100:140] = v[7]  # ties
    ids = uuids(300)
    m = frame(spark, v, ids)
    asked = m.where(m.id.isin(ids[::20]))
    got = recall.top_k(m, asked, 9, **blocks)
    assert dict(got.dtypes)["query"] == dict(got.dtypes)["id"] == "string"
    by = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        by.setdefault(r.query, []).append(r.id)
    assert by == exact(v, ids, 9)
    mixed = recall.top_k(m, frame(spark, v[:2], [5, 9], "int"), 3)
    assert dict(mixed.dtypes) == {"query": "int", "id": "string", "score": "double", "rank": "int"} and mixed.count() == 6


def test_index_finds_nearly_all_and_scores_exactly(spark, tmp_path):
    v, ids = vectors(3000), uuids(3000)
    v[500:900] = v[3]  # a vector that stands very often
    m = frame(spark, v, ids).repartition(5)
    odd = frame(spark, [None, [], [0.0] * 24, [1.0] * 7], ["null", "empty", "zero", "short"])
    path = f"file://{tmp_path}/index"
    index.build(m.union(odd), path)
    rows = spark.read.parquet(f"{path}/rows")
    assert rows.count() == 3004 and {r.id for r in rows.where("cell = -1").collect()} == {"null", "empty", "zero", "short"}
    fitted, width = index.load(spark, path)
    assert width == 24 and fitted.probes < len(fitted.centers) / 2
    asked = m.where(m.id.isin(ids[::20])).union(odd)
    found = index.search(spark, path, asked, 10)
    assert {r.query for r in found.select("query").collect()} == set(ids[::20])
    want = recall.top_k(m, asked, 10)
    # Of equal vectors any will do: scores decide.
    lowest = {r.query: r.low for r in want.groupBy("query").agg({"score": "min"}).toDF("query", "low").collect()}
    got = found.collect()
    assert sum(r.score >= lowest[r.query] - 1e-9 for r in got) >= 0.95 * 10 * 150 and len(got) == 1500
    unit = {i: x / np.linalg.norm(x) for i, x in zip(ids, v.astype(float))}
    assert all(abs(r.score - unit[r.query] @ unit[r.id]) < 1e-9 for r in got)
    everything = index.search(spark, path, asked, 10, probes=10**6, rerank=50).collect()
    assert sum(r.score >= lowest[r.query] - 1e-9 for r in everything) == 1500


def test_index_on_vectors_without_clusters_probes_more(spark, tmp_path):
    rng = np.random.default_rng(2)
    v, ids = rng.normal(size=(1500, 24)), list(range(1500))
    m = frame(spark, v, ids, "bigint")
    path = f"file://{tmp_path}/index"
    index.build(m, path)
    asked = m.where("id % 20 = 0")
    hits = index.found_of(recall.top_k(m, asked, 10), index.search(spark, path, asked, 10)).collect()
    assert sum(r.found for r in hits) >= 0.95 * sum(r.wanted for r in hits) and len(hits) == 75


def test_a_search_reads_probed_cells_only(spark, tmp_path):
    v, ids = vectors(800), list(range(800))
    m = frame(spark, v, ids, "bigint")
    path = f"file://{tmp_path}/index"
    index.build(m, path, cells=16)
    plan = index.search(spark, path, m.where("id = 3"), 5, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    cells = {r.cell for r in spark.read.parquet(f"{path}/rows").select("cell").distinct().collect()}
    assert len(cells) > 8


def test_index_of_nothing(spark, tmp_path):
    m = frame(spark, [], [])
    path = f"file://{tmp_path}/index"
    index.build(m, path)
    assert index.search(spark, path, frame(spark, vectors(3), ["a", "b", "c"]), 5).count() == 0
