import datetime as dt
import json
import random

from pyspark.sql import functions as F

from mnemolith.sources import providers, tables
from mnemolith.streaming import limits, queue


def test_json_lines_and_quarantine(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(json.dumps({"timestamp": 1, "action": "a", "details": "{}", "duration_ms": 5}) + "\n{broken\n\n")
    good, bad = tables.json_lines(spark, str(tmp_path / "log.jsonl"), tables.LOG)
    assert [r.action for r in good.collect()] == ["a"] and [r.value for r in bad.collect()] == ["{broken"]
    tables.append_json(good, str(tmp_path / "out"))
    tables.append_json(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_seeds_upsert_and_lookup(spark, tmp_path):
    for i, p in enumerate(["x", "y"]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": str(i), "title": "t", "facts": ["f"], "project": p, "createdAt": f"2024-0{i + 1}-01"}))
    (tmp_path / "bad.json").write_text("{")
    assert [r.id for r in tables.seeds(spark, str(tmp_path)).collect()] == ["1", "0"]
    assert tables.seeds(spark, str(tmp_path), project="x").count() == 1
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(tuple(r) for r in tables.upsert(t, new).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.id for r in tables.delete(t, new).collect()] == [1]
    asked = spark.createDataFrame([("1",), ("7",), ("not an id",), ("123e4567-e89b-12d3-a456-426614174000",)], "id string")
    got = {r.id: r.missing for r in tables.lookup(t.withColumn("id", F.col("id").cast("string")), asked).collect()}
    assert got == {"1": False, "7": True, "123e4567-e89b-12d3-a456-426614174000": True}


def test_state_of_payloads(spark):
    rows = ['{"importance": 0.7, "relevance": 4, "feedback": {"confidence": 3, "status": "archived", "kind": "state"}}', '{"state": {"importance": 0.2, "feedback": {"confidence": 0.9}}, "relevance": 9}', "{}", None]
    got = [tuple(r.s) for r in spark.createDataFrame([(r,) for r in rows], "m string").select(tables.state_of(F.col("m")).alias("s")).collect()]
    assert got == [(0.7, 4, 1.0, "archived", "state"), (0.2, None, 0.9, "active", "fact"), (None, None, 0.5, "active", "fact"), (None, None, 0.5, "active", "fact")]


def test_providers(spark):
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, None)], "id int, prompt string")
    got = {r.id: r.answer for r in providers.ask(df, "prompt", providers.Offline()).collect()}
    assert got[1] == got[2] != got[3]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("status 503")
        return ["ok"]

    assert providers.retried(flaky, sleep=lambda s: None) == ["ok"]
    answers = spark.createDataFrame([('```json\n{"a": 1,}\n```',), ('text {"a": 2} more',), ("none",)], "x string")
    assert [r.a for r in answers.select(providers.answer_json(F.col("x"), "a int").alias("j")).select("j.a").collect()] == [1, 2, None]


def test_outbox_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps({"id": "1", "ts": 1, "attempts": 0}), json.dumps({"id": "1", "ts": 1, "attempts": 2}), json.dumps({"id": "2", "ts": 2, "attempts": 5}), "broken {"]
    (folder / "a.jsonl").write_text("\n".join(lines))
    queue.drain(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    (folder / "b.jsonl").write_text(json.dumps({"id": "3", "ts": 3, "attempts": 0}))
    queue.drain(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    read = lambda n: spark.read.parquet(str(tmp_path / "out" / n))
    assert sorted((r.id, r.attempts) for r in read("events").collect()) == [("1", 2), ("3", 0)]
    assert [r.id for r in read("dead").collect()] == ["2"] and read("quarantine").count() == 1


def test_outbox_applies_each_event_once(spark, tmp_path):
    """An id that comes again in a later file; a batch that runs twice; events that fail, up to the last attempt."""
    out = str(tmp_path / "out")
    line = lambda i, attempts=0: (json.dumps({"id": i, "ts": 1, "attempts": attempts}),)
    lines = lambda *rows: spark.createDataFrame(list(rows), "value string")
    read = lambda n: spark.read.parquet(f"{out}/{n}")
    applied = []

    def apply(events):
        ids = [r.id for r in events.collect()]
        applied.extend(i for i in ids if not i.startswith("bad"))
        return events.where("id like 'bad%'").select("id", F.lit("no answer").alias("error"))

    queue.apply_batch(lines(line("1"), line("bad1"), line("bad2", 4)), 0, out, apply)
    queue.apply_batch(lines(line("1"), line("2"), ("broken {",)), 1, out, apply)
    queue.apply_batch(lines(line("1"), line("2"), ("broken {",)), 1, out, apply)  # failed half-way before, say
    assert sorted((r.id, r.batch) for r in read("events").collect()) == [("1", 0), ("2", 1)] and applied == ["1", "2"]
    assert [(r.id, r.attempts) for r in read("retry").collect()] == [("bad1", 1)] and [(r.id, r.attempts) for r in read("dead").collect()] == [("bad2", 5)]
    assert sorted((r.batch, r.applied, r.retry, r.dead, r.quarantine) for r in queue.sync_status(spark, out).collect()) == [(0, 1, 1, 1, 0), (1, 1, 0, 0, 1)]
    queue.requeue(spark, out, 0, str(tmp_path / "again"))
    queue.apply_batch(spark.read.text(str(tmp_path / "again")), 2, out)
    assert [(r.id, r.attempts) for r in read("events").where("batch = 2").collect()] == [("bad1", 1)]


def test_outbox_is_drained_with_retries_and_applies_once_a_batch(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    line = lambda i, attempts=0: json.dumps({"id": i, "ts": 1, "attempts": attempts, "tenant": i[:1]})
    (folder / "a.jsonl").write_text("\n".join([line("a1"), line("a1"), line("b2"), line("b5"), line("dead", 5), "broken {", "broken {"]))
    (folder / "b.jsonl").write_text("\n".join([line("a1"), line("b2")]))
    asked = tmp_path / "asked"
    asked.mkdir()

    def apply(events):
        """Counts applications by files, as lazy plans may run anywhere; an event named b<k> fails k times."""

        def run(batches):
            for b in batches:
                for i, n in zip(b["id"], b["attempts"]):
                    with open(asked / f"{i}", "a") as f:
                        f.write(".")
                yield b.assign(error="no answer")[["id", "attempts", "error"]]

        return events.select("id", "attempts").mapInPandas(run, "id string, attempts int, error string").where("id like 'b%' and attempts < int(substr(id, 2))").select("id", "error")

    queue.drain_all(spark, str(folder), out, str(tmp_path / "check"), apply)
    read = lambda n: spark.read.parquet(f"{out}/{n}")
    assert sorted((r.id, r.attempts) for r in read("events").collect()) == [("a1", 0), ("b2", 2)]
    assert sorted((r.id, r.attempts) for r in read("dead").collect()) == [("b5", 5), ("dead", 5)] and read("quarantine").count() == 1
    assert {p.name: len(p.read_text()) for p in asked.iterdir()} == {"a1": 1, "b2": 3, "b5": 5}
    (folder / "c.jsonl").write_text(line("a1"))
    queue.drain_all(spark, str(folder), out, str(tmp_path / "check"), apply)
    assert len((asked / "a1").read_text()) == 1
    lines = spark.createDataFrame([(line("a1"),), (line("b2"),), ("broken {",)], "value string")
    assert sorted(r.value for r in queue.without_tenant(lines, "a").collect()) == sorted([line("b2"), "broken {"])


def test_seeds_and_payloads_go(spark):
    seeds = spark.createDataFrame([("s1", "ana", ["1", "2"]), ("s2", None, ["3"]), ("s3", "bia", None)], "id string, tenant string, memory_ids array<string>")
    memories = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string")
    left, kept = tables.without_seeds(seeds, memories, spark.createDataFrame([("s1",), ("s9",)], "id string"))
    assert sorted(r.id for r in left.collect()) == ["s2", "s3"] and sorted(r.id for r in kept.collect()) == ["3", "4"]
    assert sorted(r.id for r in tables.without_tenant_seeds(seeds, "ana").collect()) == ["s2", "s3"] and tables.without_tenant_seeds(seeds, "master").count() == 3
    state = spark.createDataFrame([("1", 0.5, 3, "fact")], "id string, confidence double, relevance int, kind string")
    new = spark.createDataFrame([("1", 7.0, 9.0), ("2", -1.0, 4.0)], "id string, confidence double, relevance double")
    assert sorted(tuple(r) for r in tables.set_payload(state, new, ["confidence", "relevance"]).collect()) == [("1", 1.0, 3, "fact"), ("2", 0.0, 4, None)]
    assert [tuple(r) for r in tables.clear_payload(state, spark.createDataFrame([("1",), ("no id",)], "id string"), ["relevance"]).collect()] == [("1", 0.5, None, "fact")]


def test_limiter(spark):
    rnd = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.randint(1, 4), t0 + dt.timedelta(minutes=rnd.randint(0, 600))) for i in range(300)]
    got = {r.event: r.allowed for r in limits.limited(spark.createDataFrame(rows, "event int, user int, ts timestamp"), key="user", time="ts", order="event", window=3600, most=3).collect()}
    want, state = {}, {}
    for i, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if u not in state or t >= state[u][0] + dt.timedelta(hours=1):
            state[u] = [t, 0]
        want[i] = state[u][1] < 3
        state[u][1] += want[i]
    assert got == want


def test_limiter_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0 + dt.timedelta(minutes=m)) for m in (0, 1, 2, 61)], "user int, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    out = limits.limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), key="user", time="ts", window=3600, most=2)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("limited").collect()] == [(1, 3, 1)]


def test_windows_batch(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (1, 2, 59)] + [(dt.datetime(2024, 1, 1, 1, 0), "a", 5.0)], "ts timestamp, k string, v double")
    assert sorted((r.n, r.total) for r in limits.windowed(df, time="ts", kind="k", value="v").collect()) == [(1, 5.0), (3, 3.0)]
