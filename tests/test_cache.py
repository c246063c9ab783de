"""The cache over a table and over a stream against a replay one request after the other."""

import datetime as dt
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from mnemolith.streaming import cache

T0 = dt.datetime(2024, 1, 1)


def replay(rows, ttl, most):
    caches, out = {}, {}
    for i, c, key, t in sorted(rows, key=lambda r: (r[3], r[0])):
        have = caches.setdefault(c, OrderedDict())
        if key in have and t < have[key]:
            out[i] = (True, None)
            continue
        have.pop(key, None)
        if len(have) >= most:
            for k in list(have):
                if t >= have[k]:
                    del have[k]
                if len(have) < most:
                    break
        gone = have.popitem(last=False)[0] if len(have) >= most else None
        have[key] = t + dt.timedelta(seconds=ttl)
        out[i] = (False, gone)
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    # Times meet the ends of entries exactly, and each other.
    return [(i, rnd.choice(["a", "b", "b", "b", "c"]), f"k{rnd.randint(0, 7)}", T0 + dt.timedelta(minutes=rnd.randint(0, 300))) for i in range(600)]


SCHEMA = "i int, who string, key string, ts timestamp"


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_batch(spark, rows, most):
    df = spark.createDataFrame([*rows, (1000, "a", "k1", None)], SCHEMA)
    got = {r.i: (r.hit, r.gone) for r in cache.cached(df, cache="who", key="key", time="ts", order="i", ttl=1200, most=most).collect()}
    want = replay(rows, 1200, most)
    assert got == want and any(h for h, _ in want.values())
    assert any(g for _, g in want.values()) == (most < 1000)


def test_stream_keeps_entries_between_batches(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    folder, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for hours in ((0, 2), (2, 4), (4, 6)):
        part = df.where((F.col("ts") >= F.lit(T0 + dt.timedelta(hours=hours[0]))) & (F.col("ts") < F.lit(T0 + dt.timedelta(hours=hours[1]))))
        part.coalesce(1).write.mode("append").parquet(folder)
        asked = cache.cached_stream(spark.readStream.schema(df.schema).parquet(folder), cache="who", key="key", time="ts", order="i", ttl=1200, most=3)
        asked.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {r.i: (r.hit, r.gone) for r in spark.read.parquet(out).collect()} == replay(rows, 1200, 3)


def test_misses_touch_their_first_results(spark):
    ranked = spark.createDataFrame([(1, f"m{p}", p, 0.98 if p == 1 else None) for p in range(1, 6)] + [(2, "m9", 1, 0.5)], "query int, id string, place int, importance double")
    asked = spark.createDataFrame([(1, T0, False), (1, T0 + dt.timedelta(hours=1), True), (2, T0, True)], "query int, ts timestamp, hit boolean")
    assert sorted(tuple(r) for r in cache.touches(ranked, asked).collect()) == [("m1", T0, 1.0), ("m2", T0, None), ("m3", T0, None)]


def test_no_requests(spark):
    assert cache.cached(spark.createDataFrame([], SCHEMA), cache="who", key="key", time="ts", order="i").count() == 0
