"""Token counts of byte-level BPE by rank-synchronous array merging.

Distinct new pre-tokens of a batch lie in one ragged array of symbols. In each round every
pre-token finds the lowest rank among its pairs and merges that pair wherever it stands (left to
right where places overlap); finished pre-tokens leave the array. The symbols that survive are the
tokens. Merges come from the vocabulary file, in which a pair's rank exceeds those that made its
parts, so that merging all its places at once gives what merging them one by one gives.

The added tokens of the file (such as an end-of-text mark) are cut out of the text first and count
as one token each, as the tokenizers library does by default. Null texts count as empty. Texts and
pre-tokens of any length are counted whole. Nothing is shuffled.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretoken import Known

NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.base = max(ids.values()) + 1
        self.of_byte = np.array([ids[c] for c in byte_letters()], np.int32)
        key = np.array([ids[a] * self.base + ids[b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.key, self.rank_ = key[order], order.astype(np.int32)
        self.result = np.array([ids[a + b] for a, b in merges], np.int32)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.of_bytes = self.rank(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank_[at], NONE)


def count(words: list[bytes], v: Vocabulary, limit: int = 1 << 22) -> np.ndarray:
    """Number of tokens of each word; the words go into the array `limit` bytes at a time."""
    out = np.zeros(len(words), np.int64)
    at = 0
    while at < len(words):
        end, size = at, 0
        while end < len(words) and (end == at or size + len(words[end]) <= limit):
            size += len(words[end])
            end += 1
        out[at:end] = _count(words[at:end], v)
        at = end
    return out


def _count(words: list[bytes], v: Vocabulary) -> np.ndarray:
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = size.copy()
    buf = np.frombuffer(b"".join(words), np.uint8)
    if len(buf) < 2:
        return out
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    sym = v.of_byte[buf]
    rank = np.full(len(buf), NONE)
    rank[:-1] = v.of_bytes[buf[:-1].astype(np.int64) * 256 + buf[1:]]
    rank[:-1][word[1:] != word[:-1]] = NONE
    while len(sym):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        length = np.diff(np.concatenate((first, [len(sym)])))
        lowest = np.minimum.reduceat(rank, first)
        out[word[first]] = length
        going = np.repeat(lowest != NONE, length)
        if not going.all():
            sym, rank, word = sym[going], rank[going], word[going]
            length = length[lowest != NONE]
            lowest = lowest[lowest != NONE]
            if not len(sym):
                break
        chosen = rank == np.repeat(lowest, length)
        at = np.flatnonzero(chosen)
        chained = np.concatenate(([False], at[1:] == at[:-1] + 1)) & np.concatenate(([False], word[at[1:]] == word[at[:-1]]))
        if chained.any():
            k = np.arange(len(at))
            head = np.maximum.accumulate(np.where(chained, 0, k))
            at = at[(k - head) % 2 == 0]
        sym[at] = v.result[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = (np.cumsum(keep) - 1)[at]
        sym, rank, word = sym[keep], rank[keep], word[keep]
        # Only the pairs on either side of a merge have changed.
        touched = np.unique(np.concatenate((place, place - 1)))
        touched = touched[touched >= 0]
        rank[touched] = NONE
        touched = touched[touched + 1 < len(sym)]
        touched = touched[word[touched] == word[touched + 1]]
        rank[touched] = v.rank(sym[touched], sym[touched + 1])
    return out


class Counter:
    def __init__(self, path: str):
        v = Vocabulary(path)
        self.cut = v.cut
        self.known = Known(lambda words: (np.ones(len(words), np.int64), count(words, v)))

    def counts(self, docs: list[str]) -> list[int]:
        k = self.known
        k.tidy()
        numbers, extra = [], []
        for d in docs:
            parts = self.cut.split(d) if self.cut else [d]
            extra.append(len(parts) - 1)
            numbers.append(k.numbered(d) if len(parts) == 1 else np.concatenate([k.numbered(p) for p in parts]))
        k.catch_up()
        return [int(k.flat[x].sum()) + e for x, e in zip(numbers, extra, strict=True)]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The process's counter for a vocabulary file, read once. The file must be at this path on every executor."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """The id with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}[id_col]

    def run(batches):
        c = counter(path)
        for b in batches:
            docs_ = [x or "" for x in b.column(1).to_pylist()]
            size = pa.array([len(x.encode()) for x in docs_], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(c.counts(docs_), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text_of_the_row"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
