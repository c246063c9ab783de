"""A cache of results with a time to live and a size, over a table of requests or a stream of them.

A request hits if its key was put into its cache less than `ttl` seconds before; else it misses and puts
the key in, at the end. Where the cache is full, entries that are past their time go first, from the
oldest on and only until there is room; else the oldest goes, however often it was asked for. A cache's
requests depend on each other and come one after the other; what is kept of a cache is its entries,
`most` at most. Caches are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.recall import touched

MOST, TTL = 1000, 300.0


def ask(entries: dict[str, float], key: str, now: float, ttl: float, most: int) -> tuple[bool, str | None]:
    """Whether the key is there, and which key had to go for it. entries: when each ends, in the order they were put in."""
    ends = entries.get(key)
    if ends is not None and now < ends:
        return True, None
    entries.pop(key, None)
    if len(entries) >= most:
        for k in [k for k, e in entries.items() if now >= e][: len(entries) - most + 1]:
            del entries[k]
    gone = None
    if entries and len(entries) >= most:
        gone = next(iter(entries))
        del entries[gone]
    entries[key] = now + ttl
    return False, gone


def _rows(requests: DataFrame, cache: str, key: str, time: str, order: str) -> DataFrame:
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    return requests.select(F.col(cache).alias("cache"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), micros.alias("t"), F.col(order).alias("o"))


def _schema(rows: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return f"cache {kinds['cache']}, key string, t bigint, o {kinds['o']}, hit boolean, gone string"


def _asked(rows: pd.DataFrame, entries: dict[str, float], ttl: float, most: int) -> pd.DataFrame:
    got = [ask(entries, k, t, ttl * 1e6, most) for k, t in zip(rows["key"].tolist(), rows["t"].tolist(), strict=True)]
    return rows.assign(hit=[h for h, _ in got], gone=pd.Series([g for _, g in got], index=rows.index, dtype=object))


def _named(df: DataFrame, cache: str, key: str, time: str, order: str) -> DataFrame:
    return df.select(F.col("cache").alias(cache), F.col("key").alias(key), F.timestamp_micros("t").alias(time), F.col("o").alias(order), "hit", "gone")


def cached(requests: DataFrame, *, cache: str, key: str, time: str, order: str, ttl: float = TTL, most: int = MOST) -> DataFrame:
    """Requests (a batch) in the order of time, with hit and gone, the key that had to go. Requests without a time are left out."""
    rows = _rows(requests, cache, key, time, order).where("t is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, entries = object(), {}
        for df in batches:
            parts = []
            for _, part in df.groupby((df["cache"].fillna(-1) != df["cache"].fillna(-1).shift()).cumsum(), sort=False):
                name = part["cache"].iloc[0]
                if name != last:
                    last, entries = name, {}
                parts.append(_asked(part, entries, ttl, most))
            if parts:
                yield pd.concat(parts)

    ordered = rows.repartition("cache").sortWithinPartitions("cache", "t", "o")
    return _named(ordered.mapInPandas(run, _schema(rows)), cache, key, time, order)


def cached_stream(requests: DataFrame, *, cache: str, key: str, time: str, order: str, ttl: float = TTL, most: int = MOST) -> DataFrame:
    """The same over a stream, a cache's entries being its state; requests of a batch come in the order of time."""
    rows = _rows(requests, cache, key, time, order)

    def run(name, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        entries = dict(zip(*state.get, strict=True)) if state.exists else {}
        got = _asked(pd.concat(list(parts)).sort_values(["t", "o"], kind="stable"), entries, ttl, most)
        state.update(([*entries], [*entries.values()]))
        yield got[["cache", "key", "t", "o", "hit", "gone"]]

    found = rows.where("t is not null").groupBy("cache").applyInPandasWithState(run, _schema(rows), "keys array<string>, ends array<double>", "append", "NoTimeout")
    return _named(found, cache, key, time, order)


def touches(ranked: DataFrame, asked: DataFrame, *, first: int = 3) -> DataFrame:
    """What a recall through the cache leaves behind: id, touched_at and importance of the first results of requests that missed.

    ranked: query, id, place and importance of every query; asked: query, ts and hit. A hit gives the results of the miss
    before it and touches nothing.
    """
    missed = asked.where("not hit").select("query", "ts")
    return ranked.where(F.col("place") <= first).join(missed, "query").groupBy("id").agg(F.max("ts").alias("touched_at"), touched(F.max("importance")).alias("importance"))
