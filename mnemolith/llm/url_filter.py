"""URL filter: rules by host and path, and a ratio of two character language models for the rest.

URLs that a rule decides are the examples: two smoothed Markov models of variable order, one of
allowed and one of blocked URLs, over the characters (UTF-8 bytes) of host and path; all digits are
one character, as numbers of pages and dates would fill the tables without saying anything. The model of
order k mixes its own rate with that of order k - 1: p_k = (n(context, c) + SMOOTH * p_(k-1)) /
(n(context) + SMOOTH). A URL's score is the difference of the two log-likelihoods divided by its
length. The threshold is calibrated on all examples, each scored without its own count, as the
score that sets the two kinds apart best (greatest sum of both rates of right verdicts).

The examples are what the rules decide, so the models learn how such hosts and paths read, language
paths above all. Counts are hashed to 2 ** BITS buckets, summed in each task before they are shuffled; the summed
table, the only thing that reaches the driver, is bounded by the number of buckets, and so is its
broadcast. The calibration gathers counts of 2 * BINS score bins.

Null URLs and URLs without "://" have an empty host and path; without characters to judge they are
blocked. Without examples of both kinds all scores are zero and the threshold is zero, which
allows. Repeated rows are judged each for itself. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblock as tb

#: Fixed values of the contract: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

ORDER = 5
BITS = 20
SMOOTH = 4.0
BINS, WIDTH = 400, 0.05
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


#: Values of bytes by which 0 to 9 are the same.
_ONE_DIGIT = tb.BYTE_CASED.copy()
_ONE_DIGIT[48:58] = tb.BYTE_CASED[48]


def _grams(block: tb.Block):
    """For each order the places that have so much context, with the buckets of gram and context."""
    pre = block.prefix(_ONE_DIGIT)
    at = tb.ranges(block.start, block.end - block.start)
    doc = np.repeat(np.arange(len(block.start)), block.end - block.start)
    inner = at - block.start[doc]
    shift = np.uint64(64 - BITS)
    for k in range(ORDER + 1):
        has = np.flatnonzero(inner >= k)
        p = at[has]
        gram = tb.Block.hashes(pre, p - k, p + 1)
        context = tb.mix(tb.Block.hashes(pre, p - k, p) + np.uint64(0xC2B2AE3D27D4EB4F))
        yield has, doc, (gram >> shift).astype(np.int64), (context >> shift).astype(np.int64)


def _log_likelihood(block: tb.Block, table: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Mean log ratio (allowed over blocked) of each text; own: 0 or 1 where the text is an example, whose counts are left out."""
    size = block.end - block.start
    if not size.sum():
        return np.zeros(len(size))
    p = None
    for has, doc, gram, context in _grams(block):
        if p is None:
            p = np.full((2, len(doc)), 1.0 / 256)
        for kind in (0, 1):
            n, of = table[kind][gram].astype(np.float64), table[kind][context].astype(np.float64)
            if own is not None:
                mine = own[doc[has]] == kind
                n, of = n - mine, of - mine
            n, of = np.maximum(n, 0), np.maximum(of, 0)
            n = np.minimum(n, of)
            p[kind][has] = (n + SMOOTH * p[kind][has]) / (of + SMOOTH)
    each = np.log(p[0]) - np.log(p[1])
    total = np.bincount(doc, weights=each, minlength=len(size))
    return total / np.maximum(size, 1)


def _counts(rows: DataFrame) -> DataFrame:
    def run(batches):
        have = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            kind = b.column(1).to_numpy(zero_copy_only=False)
            for at, block in tb.blocks(tb.texts(b.column(0))):
                for has, doc, gram, context in _grams(block):
                    of = kind[at:][doc[has]]
                    for k in (0, 1):
                        have[k] += np.bincount(gram[of == k], minlength=1 << BITS)
                        have[k] += np.bincount(context[of == k], minlength=1 << BITS)
        seen = np.flatnonzero(have.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(have[0][seen]), pa.array(have[1][seen])], names=["bucket", "allowed", "blocked"])

    return rows.mapInArrow(run, "bucket int, allowed bigint, blocked bigint").groupBy("bucket").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))


def _threshold(rows: DataFrame, sent) -> float:
    def run(batches):
        bins = np.zeros((2, BINS), np.int64)
        for b in batches:
            kind = b.column(1).to_numpy(zero_copy_only=False)
            for at, block in tb.blocks(tb.texts(b.column(0))):
                own = kind[at : at + len(block.docs)]
                score = _log_likelihood(block, sent.value, own)
                where = np.clip(np.floor(score / WIDTH).astype(np.int64) + BINS // 2, 0, BINS - 1)
                for k in (0, 1):
                    bins[k] += np.bincount(where[own == k], minlength=BINS)
        k, at = np.nonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(bins[k, at])], names=["kind", "at", "n"])

    got = rows.mapInArrow(run, "kind int, at int, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
    bins = np.zeros((2, BINS))
    for r in got:
        bins[r.kind, r.at] = r.n
    if not bins.sum(axis=1).all():
        return 0.0
    rate = bins / bins.sum(axis=1, keepdims=True)
    # Allowed from the cut on, blocked below it; of equally good cuts the one nearest to zero.
    right = np.concatenate((np.cumsum(rate[0][::-1])[::-1], [0])) + np.concatenate(([0], np.cumsum(rate[1])))
    best = np.flatnonzero(right >= right.max() - 1e-12) - BINS // 2
    return float(best[np.argmin(np.abs(best))]) * WIDTH


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """The id with host, path, rule, score (of the models; null where a rule decides) and verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    name, said = longest_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).select(id_col, "host", "path", name.alias("rule"), said.alias("said"))
    examples = rows.where("said is not null").select(F.concat("host", "path").alias("t"), F.when(F.col("said") == "allow", 0).otherwise(1).alias("k"))
    got = _counts(examples).toArrow()
    table = np.zeros((2, 1 << BITS), np.int64)
    for k, c in enumerate(("allowed", "blocked")):
        table[k][got["bucket"].to_numpy()] = got[c].to_numpy()
    sent = spark.sparkContext.broadcast(table)
    threshold = _threshold(examples, sent)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            score = np.zeros(b.num_rows)
            docs = [h + p for h, p in zip(tb.texts(b.column(1)), tb.texts(b.column(2)), strict=True)]
            for at, block in tb.blocks(docs):
                score[at : at + len(block.docs)] = _log_likelihood(block, sent.value)
            size = np.fromiter(map(len, docs), np.int64, len(docs))
            verdict = np.where((score >= threshold) & (size > 0), "allow", "block")
            ruled = [x is not None for x in b.column(4).to_pylist()]
            said = [s if r else v for s, r, v in zip(b.column(4).to_pylist(), ruled, verdict.tolist(), strict=True)]
            shown = pa.array(score, pa.float64(), mask=np.array(ruled, bool))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), shown, pa.array(said, pa.string())], names=[id_col, "host", "path", "rule", "score", "verdict"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, score double, verdict string")
