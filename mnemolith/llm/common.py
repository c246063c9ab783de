"""What several operators share: tables of a folder, free column names, stored tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def output_schema(df: DataFrame, added: str) -> str:
    """DDL of df's columns and some more."""
    own = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{own}, {added}"


def free_name(taken: Sequence[str], name: str) -> str:
    """name, or name with underscores before it, so that no column has it (names are case-insensitive)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. In one process, where the session names none, a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Stored:
    """Tables written to the shared folder, which cuts lineage; they can be dropped when no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        out.stored_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
