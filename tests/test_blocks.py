import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemolith.operators import blocks, consolidation, hygiene, pairs
from mnemolith.plans import QUERIES


def bags(n, seed, vocabulary=30):
    rnd = random.Random(seed)
    out = [[f"w{int(rnd.paretovariate(0.7)) % vocabulary}" for _ in range(rnd.randint(0, 12))] for _ in range(n)]
    out[3] = ["w1"] * 5000 + ["w2"] * 4999  # beyond what 32-bit floats count
    out[4] = ["w1"] * 5000 + ["w2"] * 5001 + ["w3"]
    return out


def similarity(a, b, measure):
    x, y = Counter(a), Counter(b)
    if measure == "cosine":
        dot = sum(x[t] * y[t] for t in x)
        return dot / (math.sqrt(sum(c * c for c in x.values())) * math.sqrt(sum(c * c for c in y.values()))) if dot else 0.0
    both = len(x.keys() & y.keys())
    return 2 * both / (len(x) + len(y)) if measure == "dice" else both / len(x.keys() | y.keys())


@pytest.mark.parametrize("measure,least", [("cosine", 0.6), ("dice", 0.3), ("jaccard", 0.5)])
def test_pairs_of_many_small_blocks_equal_brute_force(spark, monkeypatch, measure, least):
    monkeypatch.setattr(blocks, "ROWS", 7)
    monkeypatch.setattr(blocks, "SHARE", 0.3)
    rows = bags(90, 4)
    df = spark.createDataFrame([(f"k{i:03d}", t) for i, t in enumerate(rows)], "id string, t array<string>").repartition(3)
    if measure != "cosine":
        df = df.withColumn("t", F.array_distinct("t"))
    got = {(r.i, r.j): r.similarity for r in blocks.similar(pairs._stored(blocks.pack(df, "id", "t")), measure, least).collect()}
    want = {(f"k{i:03d}", f"k{j:03d}"): s for j in range(90) for i in range(j) if rows[i] and rows[j] and (s := similarity(rows[i], rows[j], measure)) >= least}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_pairs_that_share_a_common_word_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, ["the", f"w{i % 5}"]) for i in range(40)], "id int, t array<string>")
    found = pairs.tf_cosine_pairs(df, "id", "t", 0.6)
    assert found.where("similarity < 0.999").isEmpty() and found.count() == 5 * 28
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def stored_rows(monkeypatch):
    """What is stored from now on: rows of each table."""
    rows, plain = [], pairs._stored

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(pairs, "_stored", counted)
    return rows


def test_a_sweep_stores_no_pairs(spark, monkeypatch):
    rows = stored_rows(monkeypatch)
    df = spark.createDataFrame([(f"m{i:02d}", f"the the the word{i}", i % 4) for i in range(60)], "id string, memory string, seen int")
    got = {r.id: r.by for r in hygiene.dedup_sweep(df, least=0.6).collect()}
    # The first turn of each seen that is later than all before it removes what was seen by then, and loses to the next.
    assert got == {"m00": "m00", "m01": "m01", "m02": "m02", **{f"m{i:02d}": f"m{i % 4:02d}" for i in range(4, 60)}}
    assert max(rows) <= 60


def test_topics_store_no_pairs_and_keep_to_scopes(spark, monkeypatch):
    rows = stored_rows(monkeypatch)
    df = spark.createDataFrame([(f"m{i:02d}", f"s{i % 2}", f"garden flowers summer other{i:02d}") for i in range(60)], "id string, scope string, memory string")
    got = sorted((r.grp, r.id) for r in hygiene.topic_groups(df, scope_col="scope").collect())
    assert got == sorted((f"topic:m{i % 2:02d}", f"m{i:02d}") for i in range(60))
    assert max(rows) <= 60


def test_merging_does_not_store_the_fragments_texts_again(spark, monkeypatch):
    kept, plain = [], pairs._stored
    monkeypatch.setattr(pairs, "_stored", lambda df: kept.append(df.columns) or plain(df))
    m = spark.createDataFrame([(f"m{i}", "s", f"garden flowers summer other{i}") for i in range(5)], "id string, scope string, memory string")
    groups = consolidation.fragments(m)
    answers = groups.select("grp", F.concat(F.lit("Decided: "), "fragments").alias("merged"))
    _, _, audit = consolidation.consolidate(m, groups, answers, F.lit("2024-02-01").cast("timestamp"))
    assert [r.fragments for r in audit.collect()] == [5]
    assert kept and not any("fragments" in c for c in kept)


def test_jaccard_pairs_read_the_texts_once(spark, tmp_path):
    docs = [(i, f"alpha beta gamma delta epsilon zeta theta word{i // 2}") for i in range(6)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["jaccard_pairs"](spark, str(tmp_path))
    assert "documents.parquet" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0
