"""Tables around memories: review queue, maintenance log, sessions, tenants; saving with conflicts; provider answers put together.

Steps on a table read it more than once: write the table before the next step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scoring, text
from . import hygiene, pairs

#: Bounds of the review queue and the log, and names that no tenant may have.
MAX_DONE_KEPT, MAX_ATTEMPTS, MAX_CLAIMED, MAX_TEXT, MAX_REASON, MAX_LOG = 200, 3, 5, 2000, 500, 500
RESERVED_TENANTS = ["master", "admin", "trash", "global", "api", "root", "system"]


# Review queue: id, kind, status, scope, memory_id, memory, reason, verdict, attempts, detected_at, updated_at


def enqueue(queue: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """The queue with new verdicts (kind, scope, memory_id, memory, reason, verdict), each pending one of a memory once."""
    pending = queue.where("status = 'pending'").select("memory_id", "verdict")
    new = verdicts.dropDuplicates(["memory_id", "verdict"]).join(pending, ["memory_id", "verdict"], "left_anti")
    rows = new.select(
        F.sha2(F.concat_ws("|", "memory_id", "verdict", as_of.cast("string")), 256).alias("id"), "kind", F.lit("pending").alias("status"), "scope", "memory_id",
        F.substring("memory", 1, MAX_TEXT).alias("memory"), F.substring("reason", 1, MAX_REASON).alias("reason"), "verdict", F.lit(0).alias("attempts"), as_of.alias("detected_at"), as_of.alias("updated_at"),
    )
    return pruned(queue.unionByName(rows))


def pruned(queue: DataFrame, kept: int = MAX_DONE_KEPT) -> DataFrame:
    """All pending entries, and the newest of the others; how many of them is fixed, so they are found by a top-k."""
    done = queue.where("status <> 'pending'").orderBy(F.desc("updated_at"), "id").limit(kept)
    return queue.where("status = 'pending'").unionByName(done)


def claim(queue: DataFrame, scope: str | None, as_of: Column, most: int = MAX_CLAIMED) -> tuple[DataFrame, DataFrame]:
    """The first pending merges of a scope with attempts left, counted once more, and the queue with them."""
    mine = queue.where((F.col("status") == "pending") & (F.col("kind") == "merge") & (F.coalesce("scope", F.lit("global")) == (scope or "global")) & (F.coalesce("attempts", F.lit(0)) < MAX_ATTEMPTS))
    ids = mine.orderBy("detected_at", "id").limit(most).select("id")
    bumped = queue.join(ids, "id", "left_semi").withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1).withColumn("updated_at", as_of)
    return bumped, queue.join(ids, "id", "left_anti").unionByName(bumped)


def set_status(queue: DataFrame, ids: DataFrame, status: str, as_of: Column) -> DataFrame:
    chosen = ids.select(F.col("id").alias("_i"), F.lit(True).alias("_c")).distinct()
    j = queue.join(chosen, F.col("id") == F.col("_i"), "left")
    hit = F.coalesce("_c", F.lit(False))
    return pruned(j.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at"))).drop("_i", "_c"))


# Maintenance log: timestamp, action, details, duration_ms


def log_entries(log: DataFrame, action: str | None = None, most: int = 50) -> DataFrame:
    """The newest entries, of one action or all."""
    rows = log if action is None else log.where(F.col("action") == action)
    return rows.orderBy(F.desc("timestamp"), "action", *[c for c in ("id",) if c in log.columns]).limit(most)


def log_actions(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count("*").alias("runs"), F.max("timestamp").alias("last_run"))


def log_kept(log: DataFrame, most: int = MAX_LOG) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), "action").limit(most)


# Saving


def save_with_conflicts(new: DataFrame, candidates: DataFrame, verdicts: DataFrame, *, blocked: DataFrame | None = None, strict_blocked: bool = False) -> DataFrame:
    """What becomes of new memories (id, memory): verdict of the gate, action, and the ids they supersede.

    candidates: id, candidate, other (texts alike in vectors); verdicts: a provider's answers (id, action, supersedes) for
    those left to review; without an answer a memory is added. What a blocked memory would supersede goes all the same
    unless strict_blocked.
    """
    alike = new.select("id", "memory").join(candidates, "id", "left")
    action = hygiene.conflict_action(alike).select("id", "action")
    gated = hygiene.gate(new, blocked=blocked).select("id", "memory", "verdict").join(action, "id").join(verdicts.select("id", F.col("action").alias("said"), "supersedes"), "id", "left")
    final = F.when(F.col("action") == "REVIEW", F.coalesce("said", F.lit("ADD"))).otherwise(F.col("action"))
    saved = (F.col("verdict") == "saved") & (final != "NOOP")
    goes = saved if strict_blocked else saved | ((F.col("verdict") == "blocked") & (final != "NOOP"))
    supersede = F.when(goes & final.isin("UPDATE", "DELETE"), F.coalesce("supersedes", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return gated.select("id", "memory", F.when(final == "NOOP", "duplicate").otherwise(F.col("verdict")).alias("verdict"), final.alias("action"), hygiene.domain_operation(final).alias("operation"), supersede.alias("supersedes"))


def absolute_urls(t: Column) -> Column:
    """Distinct absolute URLs, without closing punctuation, in lower case."""
    found = F.regexp_extract_all(t, F.lit(r"((?i:https?)://[^\s'\"`)\]}>]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.lower(F.regexp_replace(u, r"[.,;:]+$", ""))))


def accepts_enriched(original: Column, enriched: Column) -> Column:
    """The rewriting contains the original, brings no new URL, and is more actionable."""
    norm = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    same = F.contains(norm(enriched), norm(original))
    known = F.size(F.array_except(absolute_urls(enriched), absolute_urls(original))) == 0
    return F.coalesce((enriched != "") & same & known & (scoring.actionability(enriched) > scoring.actionability(original)), F.lit(False))


def backfill_importance(state: DataFrame, memories: DataFrame, most: int = 50) -> DataFrame:
    """Scores for the first memories of a run that have none: id, importance."""
    return state.where("importance is null").join(memories.select("id", "memory"), "id").orderBy("id").limit(most).select("id", scoring.importance(F.col("memory")).alias("importance"))


def backfill_relevance(memories: DataFrame, rated: DataFrame, answers: DataFrame) -> DataFrame:
    """New state of chat memories without rating: a provider's relevance as importance, 0.85 at least where confirmed; kind is kept if set."""
    open_ = memories.where(~F.coalesce(F.col("memory").startswith("[Bundle:"), F.lit(False))).join(rated.select("id"), "id", "left_anti").join(answers, "id")
    value = scoring.relevance_importance(F.col("relevance"))
    return open_.select("id", "relevance", F.when(F.col("confidence") >= 1.0, F.greatest(value, F.lit(0.85))).otherwise(value).alias("importance"), F.coalesce("kind", "said_kind").alias("kind"))


def moved_scope(memories: DataFrame, matches: Column, target: str) -> DataFrame:
    """Copies of the matching memories in another scope, without texts that it has already."""
    there = memories.where(F.col("scope") == target).select(F.col("memory").alias("_m")).distinct()
    return memories.where(matches & (F.col("scope") != target)).join(there, F.col("memory") == F.col("_m"), "left_anti").withColumn("scope", F.lit(target))


def repaired_dates(memories: DataFrame, dump: DataFrame) -> DataFrame:
    """created_at of the memory that each was copied from (original_id), where the dump has it."""
    d = dump.select(F.col("id").alias("original_id"), F.col("created_at").alias("_c")).dropDuplicates(["original_id"])
    return memories.join(d, "original_id", "left").withColumn("created_at", F.coalesce("_c", "created_at")).drop("_c")


# Decisions


def query_decisions(nodes: DataFrame, edges: DataFrame, context: str, most: int = 10) -> DataFrame:
    """Decisions (options, criteria, chosen, reasoning beside a node's columns) that say words of the context, or lead to nodes that do."""
    spark = nodes.sparkSession
    norm = spark.range(1).select(text.normalize_name(F.lit(context)).alias("q")).first().q
    words = sorted({w for w in norm.split() if len(w) > 2})
    if not words:
        return nodes.where("type = 'Decision'").withColumn("relevance", F.lit(0.0)).where("false")
    empty = F.array().cast("array<string>")
    said = F.lower(F.concat_ws(" ", "id", "description", "chosen", "reasoning", F.coalesce("options", empty), F.coalesce("criteria", empty)))
    own = sum((F.contains(said, F.lit(w)).cast("double") for w in words), F.lit(0.0))
    near = edges.select("source", "target").distinct().where(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains("target", w))).groupBy("source").agg((F.count("*") * 0.5).alias("near"))
    out = nodes.where("type = 'Decision'").join(near, nodes.id == near.source, "left").drop("source")
    return out.withColumn("relevance", own + F.coalesce("near", F.lit(0.0))).drop("near").where("relevance > 0").orderBy(F.desc("relevance"), F.desc("last_seen"), "id").limit(most)


def decisions_for(nodes: DataFrame, edges: DataFrame, contexts: DataFrame, most: int = 10) -> DataFrame:
    """query, id, relevance and place (up to `most`) of the decisions that each of many contexts (query, text) is about.

    Each word of a context, of three characters or more and as often as it stands there, counts one where a decision says
    it, inside of words too; each node that a decision leads to counts a half if its id has any of them. The later
    seen one of equals is first, then the smaller id. Words find texts by an index of runs of three characters. nodes are
    those that the asker may see. A context that is null or has no such word has no rows.
    """
    from . import lookup

    kept = F.filter(F.split(text.normalize_name(F.col("text")), r"\s+"), lambda w: F.length(w) > 2)
    words = contexts.select("query", F.explode(kept).alias("word")).groupBy("query", "word").agg(F.count("*").alias("times"))
    empty = F.array().cast("array<string>")
    said = F.lower(F.concat_ws(" ", "id", "description", "chosen", "reasoning", F.coalesce("options", empty), F.coalesce("criteria", empty)))
    decisions = nodes.where("type = 'Decision'").select("id", "last_seen", said.alias("said"))
    own = lookup.containing(words, decisions, run=3, said="said").join(words, "word").groupBy("query", "id").agg(F.sum("times").cast("double").alias("r"))
    out = edges.select("source", "target").distinct().join(decisions.select(F.col("id").alias("source")), "source", "left_semi")
    named = lookup.containing(words, out.select(F.col("target").alias("id")).distinct(), run=3).join(words, "word").select("query", F.col("id").alias("target")).distinct()
    near = out.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").join(named, "target").groupBy("query", F.col("source").alias("id")).agg((F.count("*") * 0.5).alias("r"))
    relevant = own.union(near).groupBy("query", "id").agg(F.sum("r").alias("relevance")).join(decisions.select("id", "last_seen"), "id")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("relevance"), F.desc("last_seen"), "id"))
    return relevant.withColumn("place", place).where(F.col("place") <= most).select("query", "id", "relevance", "place")


# Seeds and bundles


def merged_results(results: DataFrame, *, key: str = "doc_id", order: str = "chunk") -> DataFrame:
    """Answers for a document's chunks put together: the first title, all summaries, each fact, entity and relation once.

    Of an entity named alike (but for case) the longest description stays, the first of equals.
    """
    base = results.groupBy(key).agg(F.coalesce(F.min_by("title", order), F.lit("Untitled")).alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "summary"))), lambda x: x["summary"]), " ").alias("summary"))
    e = results.select(key, F.col(order).alias("o"), F.posexplode("entities").alias("p", "e")).withColumn("k", F.lower(F.trim("e.name")))
    e = e.groupBy(key, "k").agg(F.max_by("e", F.struct(F.length("e.description"), -F.col("o"), -F.col("p"))).alias("e"), F.min(F.struct("o", "p")).alias("at"))
    e = e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]).alias("entities"))
    r = results.select(key, F.col(order).alias("o"), F.posexplode("relationships").alias("p", "r")).groupBy(key, "r").agg(F.min(F.struct("o", "p")).alias("at"))
    r = r.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]).alias("relationships"))
    from .documents import merged_facts

    return base.join(merged_facts(results, key=key, order=order), key, "left").join(e, key, "left").join(r, key, "left")


def good_facts(facts: DataFrame, *, text_col: str = "fact", most: int = 10, key: str = "doc_id", order: str = "ord", least: int = P.MIN_FACT_QUALITY) -> DataFrame:
    """The first facts of each document that score well enough to be saved, with their place."""
    kept = facts.where(scoring.fact_quality(F.col(text_col)) >= least)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("place") <= most)


def is_title_candidate(memory: Column, title: Column) -> Column:
    return F.coalesce((F.trim(memory) != "") & ~memory.startswith("[Bundle:") & title.isNull(), F.lit(False))


def bundle_exists(bundles: DataFrame, merged: DataFrame) -> DataFrame:
    """Merged texts (id, memory) that a bundle says already in nearly the same words."""
    rows = bundles.select(F.struct(F.lit(0).alias("new"), F.sha2("memory", 256).alias("key")).alias("k"), text.words(F.col("memory"), 2).alias("w"))
    rows = rows.union(merged.select(F.struct(F.lit(1), F.col("id").cast("string")), text.words(F.col("memory"), 2))).dropDuplicates(["k"])
    near = pairs.set_pairs(rows, "k", "w", P.NOOP_JACCARD).where((F.col("i.new") == 0) & (F.col("j.new") == 1) & (F.col("similarity") > P.NOOP_JACCARD))
    return merged.join(near.select(F.col("j.key").alias("_k")).distinct(), F.col("id").cast("string") == F.col("_k"), "left_semi").select("id").distinct()


# Tenants


def tenant_name(name: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9-]", ""), F.lit(""))


def tenant_slug(name: Column) -> Column:
    """Without marks, spaces as -, 32 characters at most."""
    s = F.regexp_replace(text.strip_marks(F.lower(name)), r"[\s_]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9-]", ""), r"-+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, 32), r"-+$", "")


def slug_problem(slug: Column) -> Column:
    return F.when(F.length(slug) < 2, "too short").when(slug.isin(RESERVED_TENANTS), "reserved")


def wiped(tables: dict[str, DataFrame], tenant: str, scopes: dict[str, Column]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All of an account's stores without the tenant's rows, and how many rows each loses: store, removed.

    scopes names for each table the column that holds a scope, tn-x or tn-x--project (for nodes and edges the scope of
    an id). A column of memories' scopes (tenant or tenant:project) is rendered so first by graph_style().
    """
    left = {name: without_tenant(t, tenant, scopes[name]) for name, t in tables.items()}
    own = f"tn-{tenant}"
    gone = None
    for name, t in tables.items():
        mine = F.coalesce((scopes[name] == own) | scopes[name].startswith(own + "--"), F.lit(False))
        n = t.agg(F.coalesce(F.sum(mine.cast("bigint")), F.lit(0)).alias("removed")).select(F.lit(name).alias("store"), "removed")
        gone = n if gone is None else gone.union(n)
    return left, gone


def graph_style(scope: Column) -> Column:
    """tenant or tenant:project of a memory as tn-tenant or tn-tenant--project; null for the master's."""
    tenant = F.split_part(scope, F.lit(":"), F.lit(1))
    return F.when(tenant != "master", F.concat(F.lit("tn-"), F.regexp_replace(scope, ":", "--")))


def next_cursor(cursors: DataFrame, scope: str, taken: int, total: int) -> DataFrame:
    """The table of rotating cursors (scope, cursor) after `taken` rows of `total` were looked at in a scope."""
    before = cursors.where(F.col("scope") == scope).select("cursor")
    start = F.coalesce(F.max("cursor"), F.lit(0))
    after = before.agg(F.pmod(start + taken, F.lit(max(total, 1))).cast("bigint").alias("cursor")).select(F.lit(scope).alias("scope"), "cursor")
    return cursors.where(F.col("scope") != scope).select("scope", "cursor").union(after)


def doctor(events: DataFrame, settings: dict[str, object], as_of: Column, *, every_days: int = 7, most_bytes: int = 10_000_000) -> DataFrame:
    """Health of the reaper, from its audit rows (event, ts, run_id, size): name, status (ok, warn, fail), detail."""
    said = events.agg(F.max("ts").alias("last"), F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    days = (F.unix_micros(as_of) - F.unix_micros("last")) / F.lit(86_400_000_000.0)
    limit = int(settings.get("fetch_limit", 0) or 0)
    check = lambda name, status, detail: F.struct(F.lit(name).alias("name"), status.alias("status"), detail.cast("string").alias("detail"))
    lit = F.lit
    checks = F.array(
        check("enabled", lit("ok" if settings.get("enabled") else "warn"), lit(str(bool(settings.get("enabled"))))),
        check("mode", lit("ok" if settings.get("mode") in ("dry", "purge") else "fail"), lit(str(settings.get("mode")))),
        check("fetch-limit", lit("ok" if limit > 0 else "fail"), lit(str(limit))),
        check("scopes-found", lit("ok" if settings.get("scopes") else "warn"), lit(str(len(settings.get("scopes") or [])))),
        check("audit-log", F.when(F.col("rows") > 0, "ok").otherwise("warn"), F.col("rows")),
        check("audit-log-size", F.when(F.col("bytes") <= most_bytes, "ok").otherwise("warn"), F.col("bytes")),
        check("last-sweep", F.when(F.col("last").isNull(), "warn").when(days <= 2 * every_days, "ok").otherwise("fail"), F.col("last")),
    )
    return said.select(F.explode(checks).alias("c")).select("c.*")


def without_tenant(table: DataFrame, tenant: str, scope: Column) -> DataFrame:
    """The table without a tenant's rows, in all its scopes; the master's cannot be removed."""
    if tenant == "master":
        raise ValueError("the master's data cannot be removed")
    own = f"tn-{tenant}"
    return table.where(~F.coalesce((scope == own) | scope.startswith(own + "--"), F.lit(False)))
