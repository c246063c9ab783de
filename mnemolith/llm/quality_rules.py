"""Quality rules: a hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Every document passes plain rules (size, repeated windows of words), and then a ratio of two
multinomials over hashed words and word pairs: one counted over all trusted documents (labelled as
good; the labels' different ids are joined to the documents), one over all documents. In bucket b, with E the count that the trusted documents would have at the corpus's
rate, the ratio is (trusted count + PRIOR) / (E + PRIOR): where little is expected it stays near
one. A document's score is the mean log ratio of its n-grams; it is kept if the score is at least
`threshold`, each document by the same constant.

Counts are made in one pass over all documents, whose rows meet the trusted ids in a shuffle, summed in each task first; what reaches the driver
is one table of at most `2 ** BITS` buckets, whatever the corpus. A second pass scores.

Null, empty and word-less texts have no words, fail the base rules and have score 0. Rows with the
same id are judged each for itself, and count as trusted if the id is. Without trusted documents
all ratios are one, and the base rules alone decide. Other columns don't matter and aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb

BITS = 18
PRIOR = 20.0
THRESHOLD = -0.1
WINDOW = 8
MIN_WORDS = 20
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_symbol = np.isin(np.arange(256), list(SYMBOLS))


def word_hashes(block: tb.Block, pre: np.ndarray, word: np.ndarray = tb.SPACED):
    start, end = block.runs(word)
    lo, hi = block.of(start)
    return start, end, lo, hi, block.hashes(pre, start, end)


def ngram_buckets(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of word pairs, and which pairs lie within one text."""
    shift = np.uint64(64 - bits)
    one = (h >> shift).astype(np.int64)
    two = (tb.rolling(h, 2) >> shift).astype(np.int64)
    within = np.ones(len(two), bool)
    cut = hi[:-1] - 1
    within[cut[(cut >= 0) & (cut < len(two))]] = False
    return one, two, within


def repeated_windows(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Whether each word lies in a window of n words that the same text has twice or more."""
    w = tb.rolling(h, n)
    out = np.zeros(len(h), bool)
    if not len(w):
        return out
    doc = np.repeat(np.arange(len(lo)), hi - lo)
    inside = doc[: len(w)] == doc[n - 1 :]
    at = np.flatnonzero(inside)
    key = tb.mix(w[at] + doc[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    edge[at[twice]] += 1
    np.subtract.at(edge, at[twice] + n, 1)
    return np.cumsum(edge[:-1]) > 0


def duplicate_lines(block: tb.Block, pre: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text the number of lines with a word that equal an earlier one."""
    ends = np.flatnonzero(block.buf == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    filled = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    begins, ends = begins[filled], ends[filled]
    doc = np.searchsorted(block.start, begins, "right") - 1
    key = tb.mix(block.hashes(pre, begins, ends) + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key)
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    return np.bincount(doc[again], minlength=len(block.docs))


def base_rules(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    """Failed: fewer than 20 words, or over 30 of 100 words in repeated windows."""
    return (n_words < MIN_WORDS) | (100 * n_repeat > 30 * n_words)


def count_ngrams(docs: DataFrame, trusted: DataFrame, *, id_col: str, text_col: str, bits: int = BITS) -> DataFrame:
    """bucket, raw and target: how often each bucket's n-grams stand in all documents, and in those whose id `trusted` has."""

    def run(batches):
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for b in batches:
            good = np.array(b.column(0).to_pylist(), bool)
            for at, block in tb.blocks(tb.texts(b.column(1))):
                _, _, lo, hi, h = word_hashes(block, block.prefix())
                one, two, within = ngram_buckets(h, lo, hi, bits)
                raw += np.bincount(one, minlength=1 << bits)
                raw += np.bincount(two[within], minlength=1 << bits)
                of_good = np.repeat(good[at : at + len(lo)], hi - lo)
                if of_good.any():
                    target += np.bincount(one[of_good], minlength=1 << bits)
                    target += np.bincount(two[within & of_good[: len(two)]], minlength=1 << bits)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    ids = trusted.select(F.col(id_col).alias("_trusted_id")).where("_trusted_id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("_id_of_the_row"), F.col(text_col).cast("string").alias("_text_of_the_row"))
    # Both sides are dealt out at every size: ids grow with the input.
    rows = rows.join(ids.hint("merge"), F.col("_id_of_the_row") == F.col("_trusted_id"), "left")
    counts = rows.select(F.col("_trusted_id").isNotNull(), "_text_of_the_row").mapInArrow(run, "bucket int, raw bigint, target bigint")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, bits: int = BITS, prior: float = PRIOR) -> np.ndarray:
    """The log ratio of every bucket: one number for each of 2 ** bits."""
    got = counts.toPandas()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[got.bucket], target[got.bucket] = got.raw, got.target
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    return np.log((target + prior) / (expected + prior)).astype(np.float32)


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1", threshold: float = THRESHOLD, whole_rows: bool = False) -> DataFrame:
    """The id (or, with whole_rows, all columns as one struct, `row`) with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score and kept.
    """
    ratios = log_ratios(count_ngrams(docs, labels.where(good), id_col=id_col, text_col=text_col))
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    mine = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if whole_rows else F.col(id_col)
    rows = docs.select(own, F.col(text_col).cast("string").alias("_text_of_the_row"))
    name, kind = rows.columns[0], rows.schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols = [[] for _ in mine]
            for _, block in tb.blocks(tb.texts(b.column(1))):
                for c, x in zip(cols, measure(block, sent.value, threshold), strict=True):
                    c.append(x)
            made = [np.concatenate(c) if c else np.zeros(0) for c in cols]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(made, kinds, strict=True))], names=[name, *mine])

    return rows.mapInArrow(run, f"`{name}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean")


def measure(block: tb.Block, ratios: np.ndarray, threshold: float) -> list[np.ndarray]:
    pre = block.prefix()
    start, _, lo, hi, h = word_hashes(block, pre)
    n = hi - lo
    inside = tb.SPACED[block.buf] & ((block.buf & 0xC0) != 0x80)
    chars = per_byte(inside, block)
    symbols = per_byte(_symbol[block.buf], block)
    dup = duplicate_lines(block, pre, start)
    repeat = tb.per_text(repeated_windows(h, lo, hi), lo, hi)
    one, two, within = ngram_buckets(h, lo, hi)
    total = tb.per_text(ratios[one].astype(np.float64), lo, hi)
    pairs = np.zeros(len(h))
    pairs[: len(two)] = np.where(within, ratios[two], 0.0)
    total += tb.per_text(pairs, lo, hi)
    score = total / np.maximum(2 * n - 1, 1)
    failed = base_rules(n, repeat)
    return [n, chars, symbols, dup, repeat, failed, score, ~failed & (score >= threshold)]


def per_byte(flag: np.ndarray, block: tb.Block) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flag)))
    return c[block.end] - c[block.start]


def brute_force(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, the plain way; for tests."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    text = text or ""
    words = word.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if word.search(line):
            dup += line in seen
            seen.add(line)
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - WINDOW + 1):
        places.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + WINDOW)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n
