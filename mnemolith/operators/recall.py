"""Recall: exact top-k by cosine, score threshold, state signals, rank; context within a budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scoring

#: Bytes of queries and of memories (eight for each element) that meet in one task; how many of them are multiplied at once.
QUERY_BYTES, MEMORY_BYTES, TOGETHER, ROWS = 1 << 26, 1 << 27, 512, 4096


def _by_size(vectors: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors the rows that have it, and their unit vectors; null elements are 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(pc.cast(pc.list_flatten(vectors), pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    out = {}
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        out[n] = rows, _unit(flat[((ends - size)[rows][:, None] + np.arange(n)[None]).reshape(-1)].reshape(len(rows), n))
    return out


def _best(query: np.ndarray, score: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, ties by id."""
    order = np.lexsort((who, -score, query))
    query, score, who = query[order], score[order], who[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    nth = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate((first, [len(query)]))))
    return query[nth < k], score[nth < k], who[nth < k]


def _extent(df: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their vectors v; a vector without elements counts as one with one."""
    r = df.agg(F.count("*").alias("n"), (8 * F.sum(F.greatest(F.coalesce(F.size("v"), F.lit(0)), F.lit(1)))).alias("b")).first()
    return r.n, r.b or 0


def top_k(memories: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "embedding", query_bytes: int = QUERY_BYTES, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """For each query the k memories with the greatest cosine: query, id, score, rank from 1.

    queries has the same columns as memories. Both are dealt into blocks of about query_bytes and memory_bytes; each block
    of queries meets each block of memories in one task, which multiplies them and sends its best k of each query, and a
    window over the query merges those. Nothing but sizes reaches the driver. A memory's block depends on its id and its
    partition, so that an id that stands very often is dealt over many. Vectors that are null, empty, zero or of another
    length score 0; so do null elements. Ids are of any type that orders (numbers, UUIDs and other strings) and keep it;
    rows without id are left out, and a query's id that stands twice is asked once.
    """
    kind = {f.name: f.dataType.simpleString() for f in memories.schema.fields}[vector_col]
    kind = kind if kind == "array<float>" else "array<double>"
    asked = queries.select(F.col(id_col).alias("q"), F.col(vector_col).cast(kind).alias("v")).where("q is not null")
    rows = memories.select(F.col(id_col).alias("i"), F.col(vector_col).cast(kind).alias("v")).where("i is not null")
    n_rows, size = _extent(rows)
    across = 1 + _extent(asked)[1] // query_bytes
    cores = memories.sparkSession.sparkContext.defaultParallelism
    down = max(1 + size // memory_bytes, min(-(-n_rows // ROWS), -(-cores // across)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.dropDuplicates(["q"]).select("q", "v", F.pmod(F.xxhash64("q"), F.lit(across)).cast("int").alias("a"), every(down).alias("d"))
    rows = rows.withColumn("d", F.pmod(F.xxhash64("i", F.spark_partition_id()), F.lit(down)).cast("int")).select("i", "v", every(across).alias("a"), "d")

    def best_of(asked: pa.Table, rows: pa.Table) -> pa.Table:
        groups = _by_size(asked["v"])
        # Places of ids in their order stand for them: strings by their bytes, as Spark orders them.
        order = pc.rank(rows["i"].combine_chunks(), sort_keys="ascending", tiebreaker="first").to_numpy().astype(np.int64)
        best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for at in range(0, rows.num_rows, ROWS):
            own, vectors = order[at : at + ROWS], _by_size(rows["v"].slice(at, ROWS))
            for width, (which, unit) in groups.items():
                for first in range(0, len(which), TOGETHER):
                    some = which[first : first + TOGETHER]
                    scores = np.zeros((len(some), len(own)))
                    if width and width in vectors:
                        mine, v = vectors[width]
                        scores[:, mine] = unit[first : first + TOGETHER] @ v.T
                    cut = np.partition(scores, len(own) - k, axis=1)[:, len(own) - k, None] if len(own) > k else -np.inf
                    q, m = np.nonzero(scores >= cut)
                    best = tuple(np.concatenate(x) for x in zip(best, _best(some[q], scores[q, m], own[m], k), strict=True))
            best = _best(*best, k)
        row = np.empty(len(order), np.int64)
        row[order - 1] = np.arange(len(order))
        return pa.table({"query": asked["q"].take(pa.array(best[0])), "id": rows["i"].take(pa.array(row[best[2] - 1])), "score": pa.array(best[1], pa.float64())})

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "q"), (rows, "i"))]
    found = asked.groupBy("a", "d").cogroup(rows.groupBy("a", "d")).applyInArrow(best_of, f"query {kinds[0]}, id {kinds[1]}, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def min_score(results: DataFrame, least: float | None = P.MIN_RECALL_SCORE) -> DataFrame:
    """Results of at least this raw score, a missing one counting as 0; all of them for 0 or less or no number."""
    if least is None or not least > 0:
        return results
    return results.where(F.coalesce("score", F.lit(0.0)) >= least)


def with_state(results: DataFrame, state: DataFrame) -> DataFrame:
    """Results with their state (id, importance, confidence, kind, status, updated_at and others), archived ones dropped."""
    return results.join(state, "id", "left").where(F.coalesce("status", F.lit("active")) != "archived")


def rank(results: DataFrame, as_of: Column, terms: Column | None = None, *, text_col: str = "memory") -> DataFrame:
    """Adjusted score and place of each result of a query, best first, ties by id."""
    boost = scoring.term_boost(F.col(text_col), terms) if terms is not None else F.lit(0.0)
    decay = scoring.age_decay(F.coalesce("updated_at", "created_at"), as_of, F.col("importance"), F.col("kind"))
    scored = results.withColumn("adjusted", scoring.adjusted_score(F.col("score"), decay, F.col("importance"), F.col("confidence"), boost))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("adjusted"), "id")))


def with_touches(results: DataFrame, touches: DataFrame) -> DataFrame:
    """Results with updated_at no earlier than when they were last looked at (id, touched_at)."""
    last = touches.groupBy("id").agg(F.max("touched_at").alias("_touched"))
    return results.join(last, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_touched")).drop("_touched")


def query_terms(text: Column) -> Column:
    """Words of a query with three characters or more, in the order they stand, repeated ones too."""
    return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) >= 3)


def recall(
    memories: DataFrame, queries: DataFrame, state: DataFrame, as_of: Column, *, k: int = 20, least: float | None = P.MIN_RECALL_SCORE, id_col: str = "id", vector_col: str = "embedding",
    touches: DataFrame | None = None, texts: DataFrame | None = None, asked: DataFrame | None = None,
) -> DataFrame:
    """Top-k, threshold on the raw cosine, touches and state, rank - in this order, so that archived rows use up places.

    touches: id, touched_at. texts (id, memory) and asked (query, text) give the boost by the query's terms.
    """
    found = with_state(min_score(top_k(memories, queries, k, id_col=id_col, vector_col=vector_col), least), state)
    if touches is not None:
        found = with_touches(found, touches)
    if texts is None or asked is None:
        return rank(found, as_of)
    found = found.join(texts.select("id", "memory"), "id", "left").join(asked.select("query", F.coalesce(query_terms(F.col("text")), F.array().cast("array<string>")).alias("terms")), "query", "left")
    return rank(found.withColumn("memory", F.coalesce("memory", F.lit(""))), as_of, F.coalesce("terms", F.array().cast("array<string>"))).drop("terms")


def touched(importance: Column) -> Column:
    """Importance after a memory was recalled among the first three: 0.05 more, 1 at most, if it has any."""
    return F.when(importance.isNotNull(), F.least(F.lit(1.0), importance + 0.05))


def within_budget(lines: DataFrame, budget: int, *, key: str, order: list[Column], text_col: str = "memory") -> DataFrame:
    """The first lines of each key whose characters, "- " before each, together stay within the budget."""
    used = F.sum(F.length(text_col) + 2).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used).where(F.col("used") <= budget)


def context(lines: DataFrame, budget: int, *, key: str, is_global: str, order: list[Column], text_col: str = "memory") -> DataFrame:
    """Global lines first, then a project's own by rank, each list up to the first line beyond what is left."""
    first = within_budget(lines.where(is_global), budget, key=key, order=order, text_col=text_col)
    spent = first.groupBy(F.col(key).alias("_k")).agg(F.max("used").alias("spent"))
    rest = lines.where(f"not ({is_global})").join(spent, F.col(key) == F.col("_k"), "left")
    used = F.sum(F.length(text_col) + 2).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rest = rest.withColumn("used", used + F.coalesce("spent", F.lit(0))).where(F.col("used") <= budget).drop("_k", "spent")
    return first.unionByName(rest)


def spawn_context(lines: DataFrame, budget: int, *, key: str, is_global: str, order: list[Column], project: str | None = None, text_col: str = "memory") -> DataFrame:
    """key and the context to begin with: the lines of context() under a head for global ones and one for the project's.

    project is the column with its name (the key's where not given). Heads don't count to the budget, which bounds what is
    put together for a key; keys without a line have no row.
    """
    kept = context(lines.withColumn("_project", F.col(project or key).cast("string")), budget, key=key, is_global=is_global, order=order, text_col=text_col)
    line = F.struct("used", F.concat(F.lit("- "), text_col).alias("line"))
    both = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.expr(is_global), line))).alias("g"), F.array_sort(F.collect_list(F.when(~F.expr(is_global), line))).alias("p"), F.max("_project").alias("_project"))
    block = lambda c, head: F.when(F.size(c) > 0, F.concat(head, F.lit("\n"), F.array_join(F.transform(c, lambda x: x["line"]), "\n")))
    return both.select(key, F.concat_ws("\n\n", block("g", F.lit("## Global (preferences & facts)")), block("p", F.concat(F.lit("## Project: "), "_project"))).alias("context"))
