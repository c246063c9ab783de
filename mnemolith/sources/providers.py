"""Language models behind one seam: a provider answers prompts; a deterministic one serves tests."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Offline:
    """The same answer to the same prompt: its digest, as JSON."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [f'{{"answer": "{hashlib.sha256(p.encode()).hexdigest()[:16]}"}}' for p in prompts]


def retried(call: Callable[[], list[str]], attempts: int = 3, wait: float = 1.0, sleep=time.sleep) -> list[str]:
    """Tries again, after 1, 2, 4 .. seconds, what failed for load or inside the service."""
    import re

    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts or not re.search(r"\b429\b|5\d\d", str(e)):
                raise
            sleep(wait * 2**k)
    raise ValueError("no attempt was allowed")


def ask(rows: DataFrame, prompt_col: str, provider: Provider, *, batch: int = 16) -> DataFrame:
    """rows with `answer`; a batch that fails for good has null answers. Split off what needs no answer first."""

    @F.pandas_udf("string")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in prompts:
            out: list[str | None] = []
            for a in range(0, len(p), batch):
                some = p.iloc[a : a + batch].fillna("").tolist()
                try:
                    out += retried(lambda some=some: provider.complete(some))
                except Exception:
                    out += [None] * len(some)
            yield pd.Series(out, dtype="object")

    return rows.withColumn("answer", run(F.col(prompt_col)))


def answer_json(answer, schema: str):
    """The object in an answer: out of a fenced block, else between the outermost braces, without commas before closing brackets."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    raw = F.when(fenced != "", fenced).otherwise(F.regexp_extract(answer, r"(?s)(\{.*\})", 1))
    return F.from_json(F.regexp_replace(raw, r",\s*([}\]])", "$1"), schema)
