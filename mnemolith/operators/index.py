"""An index over vectors for recall: an inverted file of k-means cells with coded residuals.

Vectors are scaled to length 1. Cells are fitted by spherical k-means on a sample of at most SAMPLE rows
(those whose ids hash lowest); everything else covers all rows: each is assigned to its cell, and what
it differs from the cell's center is coded with eight bits an element. The index is a Parquet table
partitioned by cell, so that a search reads only the cells it probes, and of these the codes first. A
cell with many rows (a vector that stands very often) is dealt into parts of about PART_ROWS.

How many cells to probe is measured while fitting: sampled vectors look up their neighbours within
the sample, and `probes` is the least number of cells that holds a share of `target` of them. The best
candidates by code, RERANK times as many as asked for, are scored again with their own vectors. On
vectors without clusters that means probing most cells; ``recall.top_k`` is the exact way and no worse there.

Rows with a null, empty or zero vector, or one of another length than most, are kept in cell -1, which
is not probed: their cosine is 0 with everything. Null elements count as 0. Ids may be of any type that
orders; rows with the same id are rows of their own. An index of nothing finds nothing.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from .recall import TOGETHER, _best, _by_size

SAMPLE, TARGET, MOST_CELLS, PART_ROWS, RERANK, ROUNDS = 20_000, 0.97, 4096, 65_536, 4, 12


class Fitted:
    """Centers, the step of each element's code, parts of each cell and the number of cells to probe."""

    def __init__(self, centers: np.ndarray, step: np.ndarray, parts: np.ndarray, probes: int):
        self.centers, self.step, self.parts, self.probes = centers, step, parts, probes

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return np.argmax(unit @ self.centers.T, axis=1) if len(unit) else np.zeros(0, np.int64)

    def codes(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((unit - self.centers[cell]) / self.step), -127, 127).astype(np.int8)


def fit(unit: np.ndarray, rows: int, *, k: int, target: float, cells: int | None, seed: int) -> Fitted:
    """Spherical k-means on the sample; `rows` is how many rows the index will have."""
    rng = np.random.default_rng(seed)
    n, width = unit.shape
    if not n:
        return Fitted(np.zeros((0, width)), np.ones(width), np.ones(0, np.int64), 0)
    count = max(1, min(cells or round(rows**0.5), MOST_CELLS, -(-n // 8)))
    centers = unit[rng.choice(n, count, replace=False)]
    for _ in range(ROUNDS):
        cell = np.argmax(unit @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, unit)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        # A cell that is empty, or whose vectors cancel out, starts anew at some vector.
        centers = np.where(norm > 1e-12, np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 1e-12), unit[rng.choice(n, count)])
    cell = np.argmax(unit @ centers.T, axis=1)
    step = np.maximum(np.abs(unit - centers[cell]).max(0), 1e-9) / 127
    parts = np.maximum(1, -(-np.bincount(cell, minlength=count) * max(rows, n) // (n * PART_ROWS)))
    # Where the neighbours of some sampled vectors lie, in the order in which those would probe the cells.
    asked = unit[rng.choice(n, min(n, 256), replace=False)]
    score = asked @ unit.T
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, n)]
    place = np.argsort(np.argsort(-(asked @ centers.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).reshape(-1))
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1
    return Fitted(centers, step, parts, probes)


def build(
    memories: DataFrame, path: str, *, id_col: str = "id", vector_col: str = "embedding", k: int = 20, target: float = TARGET, cells: int | None = None, sample: int = SAMPLE, seed: int = 0,
) -> None:
    """Writes the index of all rows under path. Only the sample and sizes reach the driver."""
    spark = memories.sparkSession
    rows = memories.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    usable = rows.where(F.size("v") > 0)
    lengths = usable.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    common = lengths.orderBy(F.desc("rows"), "n").first()
    width, n = (common.n, common.rows) if common else (0, 0)
    picked = usable.where(F.size("v") == width).orderBy(F.xxhash64("id"), F.xxhash64("v")).limit(sample).select("v").toArrow()
    unit = _by_size(picked["v"]).get(width, (None, np.zeros((0, width))))[1] if width else np.zeros((0, 0))
    fitted = fit(unit[(unit != 0).any(1)], n, k=k, target=target, cells=cells, seed=seed)

    def assign(batches):
        row = 0
        for b in batches:
            cell = np.full(b.num_rows, -1, np.int64)
            codes: list[bytes | None] = [None] * b.num_rows
            which, own = _by_size(b.column(1)).get(width, (np.zeros(0, np.int64), np.zeros((0, width))))
            real = (own != 0).any(1)
            which, own = which[real], own[real]
            if len(which) and len(fitted.centers):
                cell[which] = fitted.cells(own)
                for i, c in zip(which.tolist(), fitted.codes(own, cell[which]), strict=True):
                    codes[i] = c.tobytes()
            parts = np.where(cell >= 0, fitted.parts[cell], 1) if len(fitted.parts) else 1
            part = (row + np.arange(b.num_rows)) % parts
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary()), pa.array(part, pa.int32()), pa.array(cell, pa.int32())], names=["id", "v", "code", "part", "cell"])

    vector = rows.schema["v"].dataType.simpleString()
    made = rows.mapInArrow(assign, f"id {kind}, v {vector}, code binary, part int, cell int").withColumn("row", F.monotonically_increasing_id())
    made.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/rows")
    fields = [fitted.centers.astype("<f8").tobytes(), fitted.step.astype("<f8").tobytes(), fitted.parts.astype("<i8").tobytes(), fitted.probes, width, made.schema.json()]
    spark.createDataFrame([fields], "centers binary, step binary, parts binary, probes int, width int, rows string").coalesce(1).write.parquet(f"{path}/fitted")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index's rows: id, v, code, part, row, cell."""
    schema = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/fitted").first().rows))
    return spark.read.schema(schema).parquet(f"{path}/rows")


def load(spark: SparkSession, path: str) -> tuple[Fitted, int]:
    r = spark.read.parquet(f"{path}/fitted").first()
    step = np.frombuffer(r.step, "<f8")
    return Fitted(np.frombuffer(r.centers, "<f8").reshape(-1, max(r.width, 1))[:, : r.width], step, np.frombuffer(r.parts, "<i8"), r.probes), r.width


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "embedding", probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """For each query (each id once) k near rows: query, id, score (the cosine itself), rank from 1."""
    fitted, width = load(spark, path)
    many = min(len(fitted.centers), probes or fitted.probes)
    asked = queries.select(F.col(id_col).alias("query"), F.col(vector_col).alias("v")).where("query is not null").dropDuplicates(["query"])
    kind, vector = (asked.schema[c].dataType.simpleString() for c in ("query", "v"))

    def probe(batches):
        for b in batches:
            which, own = _by_size(b.column(1)).get(width, (np.zeros(0, np.int64), np.zeros((0, width))))
            real = (own != 0).any(1)
            which, own = which[real], own[real]
            cells = np.argsort(-(own @ fitted.centers.T), axis=1, kind="stable")[:, :many] if many and len(own) else np.zeros((0, 0), np.int64)
            at = pa.array(np.repeat(which[: len(cells)], cells.shape[1]))
            cell = cells.reshape(-1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell, pa.int32()), pa.array(fitted.parts[cell] if len(cell) else cell, pa.int32())], names=["query", "v", "cell", "parts"])

    probed = asked.mapInArrow(probe, f"query {kind}, v {vector}, cell int, parts int")
    wanted = [r.cell for r in probed.select("cell").distinct().collect()]  # at most MOST_CELLS
    rows = read(spark, path).where(F.col("cell").isin(wanted))
    codes = rows.select("cell", "part", "row", "code")
    probed = probed.select("query", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    keep = k * rerank

    def near(asked: pa.Table, rows: pa.Table) -> pa.Table:
        best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if asked.num_rows and rows.num_rows:
            cell = asked["cell"][0].as_py()
            unit = _by_size(asked["v"])[width][1]
            row = rows["row"].to_numpy()
            for at in range(0, len(row), TOGETHER * 8):
                own = row[at : at + TOGETHER * 8]
                code = np.frombuffer(b"".join(rows["code"].slice(at, len(own)).to_pylist()), np.int8).reshape(len(own), width)
                about = code * fitted.step + fitted.centers[cell]
                for first in range(0, len(unit), TOGETHER):
                    score = unit[first : first + TOGETHER] @ about.T
                    cut = np.partition(score, len(own) - keep, axis=1)[:, len(own) - keep, None] if len(own) > keep else -np.inf
                    q, m = np.nonzero(score >= cut)
                    best = tuple(np.concatenate(x) for x in zip(best, _best(q + first, score[q, m], own[m], keep), strict=True))
            best = _best(*best, keep)
        return pa.table({"query": asked["query"].take(pa.array(best[0])), "cell": asked["cell"].take(pa.array(best[0])), "row": pa.array(best[2], pa.int64()), "about": pa.array(best[1], pa.float64())})

    found = probed.groupBy("cell", "part").cogroup(codes.groupBy("cell", "part")).applyInArrow(near, f"query {kind}, cell int, row bigint, about double")
    first = Window.partitionBy("query").orderBy(F.desc("about"), "row")
    found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep).select("query", "cell", "row")
    exact = rows.select("cell", "row", "id", F.col("v").alias("m")).join(found, ["cell", "row"]).join(asked, "query")
    scored = exact.select("query", "id", text.dense_cosine(_whole(F.col("v")), _whole(F.col("m"))).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _whole(v: Column) -> Column:
    return F.transform(v, lambda x: F.coalesce(x, F.lit(0)))


def found_of(exact: DataFrame, found: DataFrame) -> DataFrame:
    """query, wanted and found: how many of the exact results (query, id) a search has as well."""
    got = found.select("query", "id", F.lit(1).alias("got")).distinct()
    return exact.select("query", "id").distinct().join(got, ["query", "id"], "left").groupBy("query").agg(F.count("*").alias("wanted"), F.count("got").alias("found"))
