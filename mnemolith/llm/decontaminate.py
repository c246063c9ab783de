"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. The
automaton's symbols are word numbers, its patterns all windows of `window` consecutive words of an
item (an item of fewer words, but not none, is one window). Every text is scanned once; each match
is a range of words, and the ranges are mapped back to characters of the text as it was.

The automaton reaches the executors by broadcast, so its size is checked: items whose windows have
more than `max_symbols` words together are dealt over several automata, and the texts pass through
one after the other. Nothing is shuffled.

Null and empty texts have no words and no matches. Items without words match nothing. Items that
share an id count as one; a null item id counts as the string "null". Rows with equal ids are
judged each for itself. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb

WINDOW = 13
MAX_SYMBOLS = 4_000_000

_automata: dict[object, tuple] = {}


def windows_of(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    words = (text or "").encode().translate(tb.LOWER_WORDS).split()
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def build(patterns: dict[tuple[bytes, ...], list[str]]) -> tuple[dict[bytes, int], ahocorasick.Automaton | None]:
    """Numbers of the words, from 1, and the automaton over them; its values are (words, item ids)."""
    number: dict[bytes, int] = {}
    a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, items in patterns.items():
        a.add_word(tuple(number.setdefault(w, len(number) + 1) for w in words), (len(words), items))
    if not patterns:
        return number, None
    a.make_automaton()
    return number, a


def _scan(docs: list[bytes], number: dict, automaton) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """Of each text: number of words, whether each is hit (empty if none is), items found."""
    none = np.zeros(0, bool)
    get = number.get
    for d in docs:
        words = d.translate(tb.LOWER_WORDS).split()
        found: set[str] = set()
        hit = none
        if automaton is not None and words:
            for end, (n, items) in automaton.iter(tuple([get(w, 0) for w in words])):
                if not found:
                    hit = np.zeros(len(words), bool)
                hit[end - n + 1 : end + 1] = True
                found.update(items)
        yield len(words), hit, found


def _spans(doc: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of hit words, as characters of the text: start, end."""
    block = tb.Block([doc])
    start, end = block.runs(tb.ALNUM)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    chars = block.code_points()
    return [{"start": int(chars[start[a]]), "end": int(chars[end[b - 1]])} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_symbols: int = MAX_SYMBOLS) -> DataFrame:
    """The documents with n_words, n_hit (words inside any window), items (ids found, sorted as strings)
    and spans (of hit words, in characters of the original). The id may be a struct of whole rows.
    """
    spark = docs.sparkSession
    patterns: dict[tuple[bytes, ...], list[str]] = {}
    shards: list = []
    symbols = 0
    # The items come in one at a time; a shard is sent as soon as it is full, and forgotten here.
    rows = items.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t")).toLocalIterator()
    for r in rows:
        for w in windows_of(r.t, window):
            ids = patterns.setdefault(w, [])
            if r.i not in ids:
                symbols += len(w) if not ids else 0
                ids.append(r.i)
        if symbols > max_symbols:
            shards.append(spark.sparkContext.broadcast(list(patterns.items())))
            patterns, symbols = {}, 0
    if patterns or not shards:
        shards.append(spark.sparkContext.broadcast(list(patterns.items())))

    added = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, `end`: bigint>>"
    text = "_text_of_the_row"
    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text))
    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}"
    hits_type = pa.list_(pa.int64())
    for k, sent in enumerate(shards):
        last = k == len(shards) - 1

        def scan(batches, sent=sent, first=k == 0, last=last, key=uuid.uuid4().hex):
            if key not in _automata:
                _automata.clear()
                _automata[key] = build(dict(sent.value))
            number, automaton = _automata[key]
            for b in batches:
                docs_ = tb.texts(b.column(text))
                size, hits, found = [], [], []
                for n, hit, items_ in _scan(docs_, number, automaton):
                    size.append(n)
                    hits.append(np.flatnonzero(hit))
                    found.append(sorted(items_))
                if not first:
                    hits = [np.union1d(x, y).astype(np.int64) if len(y) else x for x, y in zip(hits, (np.asarray(v) for v in b.column("_hits").to_pylist()), strict=True)]
                    found = [sorted({*x, *y}) for x, y in zip(found, b.column("_found").to_pylist(), strict=True)]
                own = b.column(0)
                if not last:
                    yield pa.RecordBatch.from_arrays([own, b.column(text), pa.array([h.tolist() for h in hits], hits_type), pa.array(found, pa.list_(pa.string()))], names=[id_col, text, "_hits", "_found"])
                    continue
                spans = []
                for d, n, h in zip(docs_, size, hits, strict=True):
                    mask = np.zeros(n, bool)
                    mask[h] = True
                    spans.append(_spans(d, mask) if len(h) else [])
                yield pa.RecordBatch.from_arrays([own, pa.array(size, pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=[id_col, "n_words", "n_hit", "items", "spans"])

        df = df.mapInArrow(scan, f"{ddl}, {added}" if last else f"{ddl}, `{text}` string, _hits array<bigint>, _found array<string>")
    return df


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A twentieth of the words, and one at least, stand in windows of the benchmark."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.select(
        id_col, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def sql(window: int = WINDOW) -> str:
    """The same digest in DuckDB's SQL: windows of all lengths that items have are joined as strings."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} FROM documents), b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {words} FROM benchmark),
i AS (SELECT item, w, least({window}, len(w)) AS k FROM b WHERE len(w) > 0), win AS (SELECT DISTINCT item, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
dw AS (SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT r, p, k, item FROM dw JOIN win USING (k, s)), cover AS (SELECT r, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r),
said AS (SELECT r, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN said USING (r)
"""


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract's rows by comparing every window with every place; for tests."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: word.findall((t or "").translate(lower))
    out = []
    for doc_id, text in docs:
        words, hit, found = cut(text), set(), set()
        for item_id, item in items:
            w = cut(item)
            k = min(window, len(w))
            for i in range(len(w) - k + 1) if w else ():
                for j in range(len(words) - k + 1):
                    if words[j : j + k] == w[i : i + k]:
                        hit.update(range(j, j + k))
                        found.add("null" if item_id is None else str(item_id))
        names = ",".join(sorted(found))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out
