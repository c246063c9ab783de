"""Windows over time: a rate limiter whose windows start with the first event, and windows of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(times: list[float], state: tuple[float, int] | None, window: float, most: int) -> tuple[list[bool], tuple[float, int] | None]:
    """Whether each event is allowed, and the window's start and count afterwards. Denied events don't count."""
    out = []
    for t in times:
        if state is None or t >= state[0] + window:
            state = (t, 0)
        allowed = state[1] < most
        state = (state[0], state[1] + allowed)
        out.append(allowed)
    return out, state


def limited(events: DataFrame, *, key: str, time: str, order: str, window: float, most: int) -> DataFrame:
    """Events (a batch) with `allowed`: at most so many in each window of a key, a window starting with the first event after the last.

    The events of a key come one after the other to a task, which keeps start and count only.
    """
    rows = events.select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(order).alias("o"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for df in batches:
            allowed: list[bool] = []
            for k, part in df.groupby((df["k"] != df["k"].shift()).cumsum(), sort=False):
                name = part["k"].iloc[0]
                got, state = decide(part["t"].tolist(), state if name == last else None, window * 1e6, most)
                last = name
                allowed += got
            yield df.assign(allowed=allowed)

    ordered = rows.repartition("k").sortWithinPartitions("k", "t", "o")
    return ordered.mapInPandas(run, f"k {kinds['k']}, t bigint, o {kinds['o']}, allowed boolean").select(F.col("k").alias(key), F.timestamp_micros("t").alias(time), F.col("o").alias(order), "allowed")


def limited_stream(events: DataFrame, *, key: str, time: str, window: float, most: int) -> DataFrame:
    """The same over a stream: allowed and denied events of each key and batch, with the window kept as state."""
    kind = events.schema[key].dataType.simpleString()

    def run(name, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        have = state.get if state.exists else None
        times = sorted(t for p in parts for t in p["t"].tolist())
        got, have = decide(times, tuple(have) if have else None, window * 1e6, most)
        if have is not None:
            state.update(have)
        yield pd.DataFrame({"k": [name[0]], "allowed": [sum(got)], "denied": [len(got) - sum(got)]})

    rows = events.select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).cast("double").alias("t"))
    return rows.groupBy("k").applyInPandasWithState(run, f"k {kind}, allowed bigint, denied bigint", "start double, n bigint", "append", "NoTimeout")


def windowed(events: DataFrame, *, time: str, kind: str, value: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by window of event time and kind: n and sum; for a stream, later ones than the watermark are dropped."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    g = df.groupBy(F.window(time, size).alias("w"), F.col(kind)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), kind, "n", "total")
