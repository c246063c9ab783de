"""Grouping of spelling variants by reduced alphabets.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z as a-z. A run loses one letter
where the crc32 of its row's id and itself says so (1 of every TYPO); the words kept are of LEAST
letters or more and stand OFTEN times or more in all rows.

1. Every letter of a word is hashed to one of SYMBOLS symbols. Equal reduced words are one shape.
2. Each shape generates its full neighbourhood of one edit over the few symbols: itself, all
   deletions, replacements and insertions, each as a 64-bit rolling hash made from prefix sums, so
   that a word of n letters costs n x SYMBOLS numbers, however long it is.
3. The neighbours are joined to the shapes that exist. Words one edit apart have shapes at most one
   edit apart, so no pair is lost.
4. The words of joined shapes are verified on their own letters (Levenshtein distance 1).

A pair of shapes is found from both sides and used once. Words are counted in each task before they
are shuffled; all joins are of shuffled tables, on shapes' hashes, so that no group is gathered
anywhere. What is near is summed up for each word: how many, and the largest (the smallest in code
point order of equals), which is its form if it stands FACTOR times as often or more. Following
forms multiplies the count by FACTOR each time, so that chains are short; they are followed by
doubling, on the words that have a form only.

Null texts have no words; a null id counts as ''. Rows with the same id are runs of that id each for
itself. Words of any length take part. An empty table gives no words. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .common import Stored

LEAST, OFTEN, FACTOR, TYPO = 6, 5, 5, 199
SYMBOLS = 8
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def _counted(least: int, typo: int, limit: int = 300_000):
    # A greedy run of `least` or more letters is a maximal one: a shorter run has no such part.
    pattern = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # bytes.lower() changes A-Z only.
                here = Counter(pattern.findall(text.encode().lower().decode()))
                seed = zlib.crc32(f"{id_}:".encode())
                for w, n in here.items():
                    h = zlib.crc32(w.encode(), seed)
                    if h % typo == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least:
                            continue
                    counts[w] += n
            if len(counts) > limit:
                yield of(counts)
                counts = Counter()
        yield of(counts)

    return run


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, often: int = OFTEN, typo: int = TYPO) -> DataFrame:
    """word and n of all words that stand often enough."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = docs.select(text(id_col).alias("id"), text(text_col).alias("text")).mapInArrow(_counted(least, typo), "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def symbol_of(symbols: int) -> dict[str, str]:
    """The symbol of each letter, by a hash of its code point; a-z and the others are dealt evenly, each for themselves."""
    out = {}
    for letters in (LETTERS[:26], LETTERS[26:]):
        order = np.argsort(tb.mix(np.array([ord(c) for c in letters], np.uint64)))
        out |= {letters[i]: chr(97 + k % symbols) for k, i in enumerate(order)}
    return out


def _shape_hashes(shapes: list[bytes]) -> np.ndarray:
    """The hash of each shape."""
    block = tb.Block(shapes)
    return tb.Block.hashes(block.prefix(), block.start, block.end)


def _neighbours(shape: bytes, symbols: int) -> np.ndarray:
    """Hashes of the shape and of all that is one edit away, each once."""
    x = np.frombuffer(shape, np.uint8)
    n = len(x)
    values = tb.BYTE_CASED
    each = values[97 + np.arange(symbols)]
    base = tb.powers(tb._P_INV, n + 2)
    terms = values[x] * base[:n]
    pre = np.concatenate(([np.uint64(0)], np.cumsum(terms, dtype=np.uint64)))
    left, right = pre[:-1], pre[-1] - pre[1:]  # before and after each letter
    ahead, back = np.uint64(tb._P), np.uint64(tb._P_INV)
    finish = lambda total, length: tb.mix(total + np.uint64(length) * np.uint64(0xD6E8FEB86659FD93))
    deleted = left + right * ahead
    replaced = (pre[-1] - terms)[:, None] + each[None, :] * base[:n, None]
    inserted = (pre + (pre[-1] - pre) * back)[:, None] + each[None, :] * base[: n + 1, None]
    with np.errstate(over="ignore"):
        return np.unique(np.concatenate((finish(deleted, n - 1), finish(replaced.ravel(), n), finish(inserted.ravel(), n + 1))))


def _hashed(batches):
    for b in batches:
        h = _shape_hashes(tb.texts(b.column(0)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64))], names=["shape", "key"])


def _generated(symbols: int, limit: int = 1 << 20):
    def run(batches):
        def out():
            size = [len(f) for f in found]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, np.int64), size)), pa.array(np.concatenate(found).view(np.int64))], names=["key", "to"])

        keys, found, size = [], [], 0
        for b in batches:
            for key, shape in zip(b.column(1).to_pylist(), tb.texts(b.column(0)), strict=True):
                near = _neighbours(shape, symbols)
                keys.append(key)
                found.append(near)
                size += len(near)
                if size > limit:
                    yield out()
                    keys, found, size = [], [], 0
        if size:
            yield out()

    return run


def near_words(words: DataFrame, *, symbols: int = SYMBOLS) -> DataFrame:
    """Pairs (a, b) of words one edit apart, each in both orders, with their numbers. `words` (word, n) must be stored."""
    spark = words.sparkSession
    store = Stored(spark)
    symbol = symbol_of(symbols)
    shaped = words.withColumn("shape", F.translate("word", "".join(symbol), "".join(symbol.values())))
    shapes = store.write(shaped.select("shape").distinct().mapInArrow(_hashed, "shape string, key bigint"))
    edges = shapes.mapInArrow(_generated(symbols), "key bigint, to bigint")
    # Found from both sides, used from one; keys that exist are unique up to chance.
    there = shapes.select(F.col("key").alias("to")).distinct()
    edges = store.write(edges.where("key <= to").join(there, "to", "left_semi").distinct())
    keyed = store.write(shaped.join(shapes, "shape").select("word", "n", "key"))
    a = keyed.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "key")
    b = keyed.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("key").alias("to"))
    differ = (F.abs(F.length("a") - F.length("b")) <= 1) & ((F.col("key") < F.col("to")) | (F.col("a") < F.col("b")))
    pairs = a.join(edges, "key").join(b, "to").where(differ & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")
    pairs = store.write(pairs)
    return pairs.unionAll(pairs.select(F.col("b"), F.col("b_n"), F.col("a"), F.col("a_n")))


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, often: int = OFTEN, typo: int = TYPO, factor: int = FACTOR, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    store = Stored(docs.sparkSession)
    words = store.write(vocabulary(docs, id_col=id_col, text_col=text_col, least=least, often=often, typo=typo))
    best = near_words(words, symbols=symbols).groupBy(F.col("a").alias("word")).agg(F.count("b").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("form"))).alias("best"))
    large = -F.col("best.n") >= factor * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.n")).alias("form_n"))
    out = store.write(out)
    links = store.write(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = store.write(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "root")
    out = out.join(links.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql() -> str:
    """The same rows in DuckDB's SQL; crc32 by its table, pairs by equal deletions."""
    return rf"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, coalesce(doc_id::VARCHAR, '') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+') AS w FROM documents),
e AS (SELECT id, run, count(*) AS n FROM (SELECT r, id, unnest(w) AS run FROM d) WHERE length(run) >= {LEAST} GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(id || ':' || run) + 1), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), 2 * i - 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM e, tab),
o AS (SELECT CASE WHEN h % {TYPO} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {OFTEN}),
x AS (SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE left(word, i - 1) || substr(word, i + 1) END AS k FROM v, LATERAL (SELECT unnest(range(0, length(word) + 1)) AS i)),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM x a JOIN x b USING (k) WHERE a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
f AS (SELECT word, count(*) AS n_near, max(n) AS form_n, arg_min(near, (-n, near)) AS form FROM p GROUP BY word),
g AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {FACTOR} * v.n THEN form END AS form, CASE WHEN form_n >= {FACTOR} * v.n THEN form_n END AS form_n FROM v LEFT JOIN f USING (word)),
s AS (SELECT word, form, 0 AS step, word AS root FROM g UNION ALL SELECT s.word, g.form, step + 1, g.word FROM s JOIN g ON g.word = s.form)
SELECT word, g.form, s.root, g.n, g.n_near::BIGINT AS n_near, g.form_n::BIGINT AS form_n FROM g JOIN (SELECT word, arg_max(root, step) AS root FROM s GROUP BY word) s USING (word)
"""
