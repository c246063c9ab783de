"""Fragments of memories put together: groups of a scope and queued merges, a provider's text, gates, trash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scoring
from . import hygiene, lifecycle, pairs

#: Memories that a scope must have, characters that a merged text must exceed.
LEAST_MEMORIES, LEAST_CHARS = 4, 20


def fragments(memories: DataFrame, *, least: float = P.TOPIC_DICE) -> DataFrame:
    """grp, scope, ids and prompt text of each group of a scope's memories (id, scope, memory) that are about one topic."""
    busy = memories.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_MEMORIES).select("scope")
    rows = memories.join(busy, "scope", "left_semi")
    groups = pairs._stored(hygiene.topic_groups(rows, least=least, scope_col="scope"))
    each = groups.join(rows.select("id", "scope", "memory"), "id").groupBy("grp", "scope").agg(F.array_sort(F.collect_list(F.struct("id", "memory"))).alias("m"))
    return each.select("grp", "scope", F.transform("m", lambda x: x["id"]).alias("ids"), F.array_join(F.transform("m", lambda x: x["memory"]), "\n- ").alias("fragments"))


def accepts_merged(merged: Column, *, least_chars: int = LEAST_CHARS) -> Column:
    return F.coalesce((F.length(merged) > least_chars) & (scoring.memory_quality(merged) >= P.MIN_MEMORY_QUALITY), F.lit(False))


def consolidate(memories: DataFrame, groups: DataFrame, answers: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories with accepted merged texts in place of their fragments, the trash, and one audit row for each group.

    groups as from fragments(); answers: grp, merged (a provider's text, null if it failed). A group whose text does not
    pass the gates keeps its fragments. Fragments go to the trash with replaced_by, the new memory's id.
    """
    judged = pairs._stored(groups.drop("fragments").join(answers.select("grp", "merged"), "grp", "left").withColumn("ok", accepts_merged(F.col("merged"))))
    new_id = F.concat(F.lit("merged-"), F.substring(F.sha2(F.concat_ws("|", "scope", "grp", "merged"), 256), 1, 16))
    done = judged.where("ok").withColumn("new_id", new_id)
    gone = done.select(F.explode("ids").alias("id"), F.lit("merged into consolidated memory").alias("reason"), F.col("new_id").alias("replaced_by"))
    stay, trash, _ = hygiene.archive(memories, gone, as_of)
    trash = trash.join(gone.select("id", "replaced_by").dropDuplicates(["id"]), "id", "left")
    fresh = done.select(F.col("new_id").alias("id"), "scope", F.col("merged").alias("memory"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in stay.schema.fields if f.name not in fresh.columns]
    fresh = fresh.select(*[F.col(c) if c in ("scope", "memory") else F.col(c).cast(stay.schema[c].dataType) for c in fresh.columns], *missing).select(*stay.columns)
    audit = judged.select("grp", "scope", F.size("ids").alias("fragments"), F.when(F.col("ok"), "merged").when(F.col("merged").isNull(), "no answer").otherwise("rejected").alias("outcome"))
    return stay.unionByName(fresh), trash, audit


def merge_claimed(memories: DataFrame, queue: DataFrame, claimed: DataFrame, answers: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories, trash and queue after claimed merges (id, scope, memory_id, memory, related: array of id and memory, attempts).

    answers: id, merged. Done if the text passes and two fragments at least are still there; failed if fewer are; else
    pending again, or failed once its attempts are used up. The queue comes from lifecycle.claim, which counts attempts.
    """
    all_ids = F.array_distinct(F.filter(F.concat(F.array("memory_id"), F.transform("related", lambda r: r["id"])), lambda x: x.isNotNull() & (x != "pending")))
    there = claimed.select("id", F.explode(all_ids).alias("m")).join(memories.where("memory is not null").select(F.col("id").alias("m")), "m", "left_semi")
    left = there.groupBy("id").agg(F.array_sort(F.collect_set("m")).alias("ids"))
    j = claimed.join(left, "id", "left").join(answers.select("id", "merged"), "id", "left")
    ok = accepts_merged(F.col("merged"), least_chars=0)
    status = F.when(F.coalesce(F.size("ids"), F.lit(0)) < 2, "failed").when(ok, "done").when(F.col("attempts") >= lifecycle.MAX_ATTEMPTS, "failed").otherwise("pending")
    judged = j.withColumn("new_status", status)
    done = judged.where("new_status = 'done'").select(F.col("id").alias("grp"), "scope", "ids", F.lit("").alias("fragments"), "merged")
    after, trash, _ = consolidate(memories, done.drop("merged"), done.select("grp", "merged"), as_of)
    new = judged.select(F.col("id").alias("_id"), "new_status")
    moved = queue.join(new, F.col("id") == F.col("_id"), "left").withColumn("status", F.coalesce("new_status", "status")).withColumn("updated_at", F.when(F.col("_id").isNotNull(), as_of).otherwise(F.col("updated_at")))
    return after, trash, moved.drop("_id", "new_status")


def clean_candidates(memories: DataFrame, as_of: Column, *, days: int = 90, quality: int = 3) -> DataFrame:
    """Memories (id, memory, created_at) at least so many days old, undated ones never, that score less: id, days_old, quality."""
    age = (F.unix_micros(as_of) - F.unix_micros("created_at")) / F.lit(86_400_000_000.0)
    rows = memories.where(age >= days).select("id", F.floor(age + 0.5).cast("bigint").alias("days_old"), scoring.memory_quality(F.col("memory")).alias("quality"))
    return rows.where(F.col("quality") < quality)
