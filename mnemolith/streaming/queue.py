"""The graph's outbox as a stream: each event applied once, failures tried again, hopeless ones and bad lines set aside.

Which ids were let through is the stream's keyed state, not a table that every batch reads again: an
event passes if it is new, or comes with more attempts than the one before, which is how a failed one
comes back. `apply` is asked once a batch; its answer is written before anything else and used again
if the batch is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import OUTBOX

MAX_ATTEMPTS = 5
Apply = Callable[[DataFrame], DataFrame]


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.from_json("value", f"{OUTBOX}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))


#: SQL: the line can't be read.
_BAD = "(r._corrupt IS NOT NULL OR r.id IS NULL)"


def split_events(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of JSON lines (value): events to apply (each id once, the last attempt), those tried too often, unreadable lines."""
    parsed = _parsed(lines)
    events = parsed.where(f"NOT {_BAD}").select("r.*").drop("_corrupt")
    latest = events.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("attempts"), "ts"))).where("_n = 1").drop("_n")
    tried = F.coalesce("attempts", F.lit(0)) >= MAX_ATTEMPTS
    return latest.where(~tried), latest.where(tried), parsed.where(_BAD).select("value")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _written_once(spark: SparkSession, path: str, rows: Callable[[], DataFrame], schema: str) -> DataFrame:
    """The rows as a table, made only if an earlier try has not finished writing them."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        rows().write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def apply_batch(lines: DataFrame, number: int, out: str, apply: Apply | None = None, *, history: bool = True) -> None:
    """Applies a batch of JSON lines and writes batch=number of four tables under out: events (applied), dead, retry,
    quarantine.

    apply gets the events and returns `id` and `error` of those it could not apply (by default all are applied); they go
    to retry with one attempt more, or to dead at the last. It runs once: its answer is a table of its own, and a batch
    that failed after it was written uses it again. Every other write replaces the batch's own part. With history, events
    whose id an earlier batch has applied are dropped by reading those batches' ids; `drain` has them as state instead.
    """
    spark = lines.sparkSession
    good, dead, bad = split_events(lines)
    if history and _exists(spark, f"{out}/events"):
        before = spark.read.schema(f"{OUTBOX}, batch int").parquet(f"{out}/events").where(F.col("batch") < number)
        good = good.join(before.select("id"), "id", "left_anti")
    new = _written_once(spark, f"{out}/claimed/batch={number}", lambda: good.select(*_FIELDS), OUTBOX)
    answer = "id string, error string"
    failed = _written_once(spark, f"{out}/answers/batch={number}", lambda: (apply(new) if apply else spark.createDataFrame([], answer)).select("id", "error").dropDuplicates(["id"]), answer)
    tried = new.join(failed, "id").withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1)
    again = tried.where(F.col("attempts") < MAX_ATTEMPTS)
    lost = tried.where(F.col("attempts") >= MAX_ATTEMPTS).unionByName(dead.withColumn("error", F.lit("tried too often")))
    for name, rows in (("retry", again), ("dead", lost), ("quarantine", bad), ("events", new.join(failed, "id", "left_anti"))):
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")


#: Names of the events' columns.
_FIELDS = ["id", "ts", "attempts", "project", "tenant", "sourceIds", "text", "entities", "relationships"]


def let_through(lines: DataFrame) -> DataFrame:
    """Of a stream of JSON lines (value) those to apply: each id first, and again with more attempts than before.

    Unreadable lines pass once each. State is an id and a number; on a cluster it belongs into the RocksDB store.
    """

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else -1
        rows = pd.concat(list(parts)).sort_values("attempts", kind="stable").drop_duplicates("attempts")
        rows = rows[rows["attempts"] > best]
        if len(rows):
            state.update((int(rows["attempts"].iloc[-1]),))
        yield rows.tail(1)[["value"]]

    keyed = _parsed(lines).select("value", F.when(F.expr(_BAD), F.sha2("value", 256)).otherwise(F.concat(F.lit("id:"), "r.id")).alias("k"), F.when(F.expr(_BAD), F.lit(0)).otherwise(F.coalesce("r.attempts", F.lit(0))).alias("attempts"))
    return keyed.groupBy("k").applyInPandasWithState(run, "value string", "attempts bigint", "append", "NoTimeout")


def drain(spark: SparkSession, folder: str, out: str, checkpoint: str, apply: Apply | None = None):
    """Starts a query that reads JSON lines as they come and applies them; the checkpoint stands for the claim of a file.

    A batch that fails before apply's answer is written asks again with the same rows, which apply must bear: upserts by
    event id do.
    """
    lines = spark.readStream.format("text").load(folder)
    return let_through(lines).writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, out, apply, history=False)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def requeue(spark: SparkSession, out: str, number: int, folder: str) -> None:
    """Puts the events of a batch that are to be tried again back into the folder, as JSON lines."""
    rows = spark.read.parquet(f"{out}/retry/batch={number}").drop("error")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)


def drain_all(spark: SparkSession, folder: str, out: str, checkpoint: str, apply: Apply | None = None) -> None:
    """Drains the folder until nothing is left to be tried again: as many runs as the most attempts of an event, at most."""
    for _ in range(MAX_ATTEMPTS + 1):
        drain(spark, folder, out, checkpoint, apply).awaitTermination()
        if not _exists(spark, f"{out}/retry"):
            return
        tried = {r.batch for r in spark.read.schema(f"{OUTBOX}, error string, batch int").parquet(f"{out}/retry").select("batch").distinct().collect()}
        waiting = [b for b in sorted(tried) if not _exists(spark, f"{out}/requeued/batch={b}/_SUCCESS")]
        if not waiting:
            return
        for b in waiting:
            requeue(spark, out, b, folder)
            spark.range(0).write.mode("overwrite").parquet(f"{out}/requeued/batch={b}")


def sync_status(spark: SparkSession, out: str) -> DataFrame:
    """How many events each batch applied, will try again, gave up and could not read: batch, applied, retry, dead, quarantine."""
    counts = None
    for name in ("events", "retry", "dead", "quarantine"):
        rows = spark.read.parquet(f"{out}/{name}").groupBy("batch").agg(F.count("*").alias("n")).select("batch", F.lit({"events": "applied"}.get(name, name)).alias("what"), "n")
        counts = rows if counts is None else counts.union(rows)
    sums = [F.sum(F.when(F.col("what") == w, F.col("n")).otherwise(0)).alias(w) for w in ("applied", "retry", "dead", "quarantine")]
    return counts.groupBy("batch").agg(*sums)


def without_tenant(lines: DataFrame, tenant: str) -> DataFrame:
    """Lines that wait, without a tenant's; unreadable ones stay."""
    return _parsed(lines).where(F.expr(_BAD) | (F.coalesce("r.tenant", F.lit("")) != tenant)).select("value")
