"""Byte-level BPE encoding and decoding by merge replay.

Pre-tokens are numbered, and the merges are replayed over all distinct new pre-tokens of a share of
the corpus together: an inverted index leads from a merge's rank to the places where its pair
stands; a heap gives the ranks in order; applying a merge touches its places and their neighbours
only, whose new pairs go into the index. A text's ids are then the ids of its pre-tokens in a row.

A pair merges if its bytes together are in the vocabulary, lowest rank first, leftmost first. In
some vocabularies a merge can make a pair of lower rank than its own; then only the leftmost place
of each pre-token is taken at a time.

Special tokens do not exist here: their strings are ordinary text. Null texts count as empty and
give no ids. Very long texts and pre-tokens are encoded whole. Nothing is shuffled; a process
forgets its pre-tokens when they are too many, which changes no result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .pretoken import Known

NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """Which two ids merge, and into what; the id of the result is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, result = np.array(pairs or np.zeros((0, 3)), np.int64).reshape(-1, 3).T
        self.base = int(max(ranks.values())) + 1
        key = left * self.base + right
        order = np.argsort(key)
        self.key, self.result = key[order], result[order].astype(np.int32)
        lower = result[(result < left) | (result < right)]
        parts = np.concatenate((left[(result < left)], right[(result < right)]))
        #: Ids whose making can give a pair of lower rank.
        self.unruly = frozenset(parts.tolist()) if len(lower) else frozenset()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it doesn't merge."""
        if not len(self.key):
            return np.full(len(left), NONE)
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.result[at], NONE)


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Applies every merge in rank order to all words; the number of ids of each word, and all ids in a row."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    buf = np.frombuffer(b"".join(words), np.uint8)
    n = len(buf)
    if not n:
        return np.zeros(len(words), np.int64), np.zeros(0, np.int32)
    start = np.cumsum(size) - size
    sym = merges.of_byte[buf]
    # Links to the neighbours within the word; -1 where there is none.
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    full = size > 0
    after[(start + size - 1)[full]] = -1
    before[start[full]] = -1
    alive = np.ones(n, bool)
    # The rank of the pair that starts at each place. Of pairs of single bytes there are few.
    of_bytes = merges.rank(np.repeat(merges.of_byte, 256), np.tile(merges.of_byte, 256))
    rank = np.full(n, NONE)
    rank[:-1] = of_bytes[buf[:-1].astype(np.int64) * 256 + buf[1:]]
    rank[after < 0] = NONE

    index: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []

    def enter(places: np.ndarray) -> None:
        r = rank[places]
        there = r != NONE
        places, r = places[there], r[there]
        if not len(r):
            return
        order = np.argsort(r, kind="stable")
        places, r = places[order], r[order]
        cuts = np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)])).tolist()
        names = r[cuts[:-1]].tolist()
        for k, name in enumerate(names):
            if name not in index:
                heapq.heappush(heap, name)
            index[name].append(places[cuts[k] : cuts[k + 1]])

    enter(np.arange(n, dtype=np.int32))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
        at = at[rank[at] == r]
        if not len(at):
            continue
        if r in merges.unruly:
            word = np.searchsorted(start, at, "right") - 1
            first = np.concatenate(([True], word[1:] != word[:-1]))
            if not first.all():
                heapq.heappush(heap, r)
                index[r].append(at[~first])
            at = at[first]
        elif len(at) > 1:
            # In a row of overlapping places, every other one from the left.
            chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
            if chained.any():
                k = np.arange(len(at))
                head = np.maximum.accumulate(np.where(chained, 0, k))
                at = at[(k - head) % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        sym[at] = r
        alive[gone] = False
        rank[gone] = NONE
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        rank[at] = NONE
        rank[at[inner]] = merges.rank(sym[at[inner]], sym[beyond[inner]])
        left = before[at]
        outer = left >= 0
        rank[left[outer]] = merges.rank(sym[left[outer]], sym[at[outer]])
        enter(np.unique(np.concatenate((at, left[outer]))))
    count = np.zeros(len(words), np.int64)
    count[full] = np.add.reduceat(alive.astype(np.int64), start[full])
    return count, sym[alive]


class Codec:
    def __init__(self, path: str):
        ranks = read_ranks(path)
        merges = Merges(ranks)
        self.token = {r: t for t, r in ranks.items()}
        self.known = Known(lambda words: replay(words, merges))

    def encode(self, docs: list[str]) -> list[np.ndarray]:
        self.known.tidy()
        k = self.known
        numbers = [k.numbered(d) for d in docs]
        k.catch_up()
        return [k.flat[tb.ranges(k.start[x], k.length[x])] for x in numbers]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The process's codec for a rank file, read once. The file must be at this path on every executor."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", as_digest: bool = False, step: int = 1 << 24) -> DataFrame:
    """The id with `ids` (array<int>) and `decoded` (their bytes put together again), or the digests of both:
    n_tokens, ids_sha256 (little-endian unsigned 32-bit), decoded_sha256.
    """
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}[id_col]

    def run(batches):
        c = codec(path)
        for b in batches:
            all_docs = [x or "" for x in b.column(1).to_pylist()]
            at = 0
            while at < len(all_docs):
                end, size = at, 0
                while end < len(all_docs) and (end == at or size + len(all_docs[end]) <= step):
                    size += len(all_docs[end])
                    end += 1
                ids = c.encode(all_docs[at:end])
                own = b.column(0).slice(at, end - at)
                if as_digest:
                    rows = [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(x)).hexdigest()) for x in ids]
                    n, a, d = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([own, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([own, lists, pa.array([c.decode(x) for x in ids], pa.binary())], names=[id_col, "ids", "decoded"])
                at = end

    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if as_digest else "ids array<int>, decoded binary"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text_of_the_row")).mapInArrow(run, f"`{id_col}` {kind}, {added}")
