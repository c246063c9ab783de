"""Schemas, readers and writers: memories, graph, append-only logs, block lists, seed files, documents."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

MEMORIES = "id string, memory string, scope string, embedding array<float>, created_at timestamp, updated_at timestamp, kind string, importance double, confidence double, status string, relevance int, sensitive boolean, title string"
NODES = "id string, scope string, name string, type string, description string, first_seen timestamp, last_seen timestamp, mentions bigint, sources array<string>"
EDGES = "source string, predicate string, target string, weight bigint, first_seen timestamp, last_seen timestamp, sources array<string>"
OUTBOX = "id string, ts bigint, attempts int, project string, tenant string, sourceIds array<string>, text string, entities array<struct<name: string, type: string, description: string>>, relationships array<struct<subject: string, predicate: string, object: string>>"
SEED = "id string, title string, summary string, facts array<string>, entities array<struct<name: string, type: string, description: string>>, relationships array<struct<subject: string, predicate: string, object: string>>, project string, tenant string, createdAt string"
LOG = "timestamp bigint, action string, details string, duration_ms bigint"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. In one process, where the session names none, a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines table, and the lines that can't be read, for quarantine."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull() | F.col("r").isNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select("value")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def seeds(spark: SparkSession, path: str, *, project: str | None = None, tenant: str | None = None) -> DataFrame:
    """Seed files of a folder, one document each, newest first; unreadable ones are left out."""
    df = spark.read.schema(SEED).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where("id is not null")
    if project is not None:
        df = df.where(F.col("project") == project)
    if tenant is not None:
        df = df.where(F.col("tenant") == tenant)
    return df.orderBy(F.desc("createdAt"), "id")


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length and content of files, for readers of other formats."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def block_list(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """hash of each text that must not be kept again."""
    t = F.col(text_col)
    return texts.where(F.trim(t) != "").select(text.blocklist_hash(t).alias("hash")).distinct()


def saved_block_list(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """hash of each entry of block-list files (each a JSON array of strings), and whether they could be read.

    A file that isn't there is an empty list. If any is broken nothing can be told apart, and whoever asks must block
    everything (`hygiene.gate(..., block_all=True)`): what was forgotten must not come back by a fault of reading.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    none = spark.createDataFrame([], "hash string")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return none, True
    files = spark.read.option("wholetext", True).text(path).where(F.trim("value") != "")
    # As variants, so that an element that is no string is seen.
    entries = files.select(F.try_parse_json("value").alias("v"))
    parts = entries.select(F.expr("try_variant_get(v, '$', 'array<variant>')").alias("a"))
    bad = F.col("a").isNull() | F.exists("a", lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) != "STRING")
    if parts.where(bad).limit(1).count():
        return none, False
    return parts.select(F.explode("a").alias("x")).select(F.expr("variant_get(x, '$', 'string')").alias("hash")).distinct(), True


def save_block_list(hashes: DataFrame, path: str) -> None:
    """Adds to the block list what it has not: one more file, an array in order. One list is small beside its memories."""
    spark = hashes.sparkSession
    known, readable = saved_block_list(spark, path)
    if not readable:
        raise ValueError(f"the block list at {path} cannot be read")
    new = hashes.where(F.trim("hash") != "").select("hash").distinct().join(known, "hash", "left_anti")
    new.agg(F.to_json(F.array_sort(F.collect_list("hash"))).alias("value")).where("value <> '[]'").write.mode("append").text(path)


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The table with rows of the same key replaced and new ones added."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def page(table: DataFrame, order: list[Column], *, limit: int = 20, offset: int = 0, fetched: int = 500) -> DataFrame:
    """Rows offset to offset + limit in the order; the limit is 1 to 100, and rows beyond `fetched` are on no page."""
    limit, offset = min(max(limit, 1), 100), max(offset, 0)
    return table.orderBy(*order).limit(min(offset + limit, fetched)).offset(offset)


def with_defaults(table: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every row with its feedback (id, confidence, correct_count, last_confirmed_at, status, kind, title), or the defaults."""
    f = feedback.select("id", "confidence", "correct_count", "last_confirmed_at", "status", "kind", "title")
    defaults = {"confidence": F.lit(0.5), "correct_count": F.lit(0).cast("bigint"), "status": F.lit("active"), "kind": F.lit("fact")}
    return table.join(f, "id", "left").withColumns({c: F.coalesce(c, v) for c, v in defaults.items()})


def set_payload(state: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """state with the given fields of patched rows (id and fields, null: left as it is) replaced, and rows for new ids.

    A confidence is brought into 0 to 1, a relevance must be a whole number from 1 to 5 and is left as it was otherwise.
    """
    clean = {"confidence": lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), "relevance": lambda c: F.when(c.between(1, 5) & (c == F.floor(c)), c)}
    p = patches.select("id", *[clean.get(c, lambda x: x)(F.col(c)).cast(state.schema[c].dataType).alias(f"_{c}") for c in fields]).dropDuplicates(["id"])
    j = state.join(p, "id", "full_outer")
    return j.select(*[(F.coalesce(f"_{c}", c) if c in fields else F.col(c)).alias(c) for c in state.columns])


def clear_payload(state: DataFrame, ids: DataFrame, fields: list[str]) -> DataFrame:
    """state with the given fields of these ids emptied; ids that aren't there, or can't be, are passed over."""
    gone = ids.where(valid_id(F.col("id"))).select(F.col("id").alias("_id"), F.lit(True).alias("_gone")).distinct()
    j = state.join(gone, F.col("id") == F.col("_id"), "left")
    return j.select(*[(F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)) if c in fields else F.col(c)).alias(c) for c in state.columns])


def without_seeds(seeds: DataFrame, memories: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds without these ids, and memories without those that came from them (seeds' memory_ids)."""
    gone = seeds.join(ids.select("id").distinct(), "id", "left_semi")
    doomed = gone.select(F.explode("memory_ids").alias("id")).distinct()
    return seeds.join(ids.select("id").distinct(), "id", "left_anti"), memories.join(doomed, "id", "left_anti")


def without_tenant_seeds(seeds: DataFrame, tenant: str) -> DataFrame:
    """Seeds without a tenant's own; the master's and those of no tenant stay in any case."""
    return seeds if tenant in ("", "master") else seeds.where(~F.coalesce(F.col("tenant") == tenant, F.lit(False)))


def lookup(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the ids asked for, those that aren't there with missing = true; ids that can't be keys are left out."""
    asked = ids.select(key).distinct().where(valid_id(F.col(key)))
    there = table.withColumn("missing", F.lit(False))
    return asked.join(there, key, "left").withColumn("missing", F.coalesce("missing", F.lit(True)))


def valid_id(key: Column) -> Column:
    """A UUID or digits."""
    k = key.cast("string")
    return k.rlike(r"^\d+\z") | k.rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")


def public_metadata(metadata: Column, reserved: list[str]) -> Column:
    """A map without reserved keys."""
    return F.map_filter(metadata, lambda k, v: ~k.isin(reserved))


def state_of(metadata: Column) -> Column:
    """Importance, relevance and feedback out of a JSON payload: flat keys before the nested legacy ones; out of range means default."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(metadata, p) for p in paths])
    confidence = get("$.feedback.confidence", "$.state.feedback.confidence").cast("double")
    relevance = get("$.relevance", "$.state.relevance").cast("double")
    return F.struct(
        get("$.importance", "$.state.importance").cast("double").alias("importance"),
        F.when(relevance.between(1, 5) & (relevance == F.floor(relevance)), relevance.cast("int")).alias("relevance"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.5)))).alias("confidence"),
        F.when(get("$.feedback.status", "$.state.feedback.status") == "archived", "archived").otherwise("active").alias("status"),
        F.when(get("$.feedback.kind", "$.state.feedback.kind") == "state", "state").otherwise("fact").alias("kind"),
    )
