"""Source divergence audit by hash-consed segment trees over term ids.

Terms are runs of letters and of characters beyond ASCII, A-Z as a-z. A language keeps the terms
that stand in at least MIN_DOCS of its rows. Each source of a language, and the language itself,
gives every kept term a share of PARTS, counts plus one, in whole numbers. What a share p costs
against q is floor((p - q)^2 / q); all arithmetic is exact.

Counts are added up in each task before one shuffle by language and term. Kept terms are dealt by
hash into blocks of about BLOCK terms, sources into tiles of TILE, and a task gets one block of two
tiles: a small matrix at any size of the input. There each source's counts become a segment tree
over the block's terms; equal subtrees are one node, whichever source they belong to (a run of terms
that a source lacks is one node a level). Two trees are walked at once from their roots: at each
level equal pairs of nodes are one entry with the number of places where it stands, so that each is
priced once. Sums over the blocks make a pair's value; the terms of the blocks that neither of the
two tiles has are added as so many pairs of zeros. Only ranks are found by a window for each source.

Null texts, languages and sources count as ''. Rows with the same id count each for itself, as no
id is read. A group without terms, or without kept ones, has all its pairs (of value 0 if the
language keeps none) and no term rows. Ties are broken by the item's UTF-8. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored
from .textblock import texts

PARTS, MIN_DOCS, TOP = 1_000_000_000, 3, 200
BLOCK, TILE = 2048, 128
#: bytes.translate table: A-Z to a-z, bytes of terms as they are, all others to a space.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _partial_counts(batches, limit: int = 400_000):
    """Rows (lang, source, term, n, d) of what a task has read; a null term for each group, so that none is lost."""

    def rows():
        for (lang, source), n in counts.items():
            terms, d = [*n], rows_with[lang, source]
            at = len(terms) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * at, pa.string()),
                    pa.array([source] * at, pa.string()),
                    pa.array([*terms, None], pa.binary()).cast(pa.string()),
                    pa.array([*n.values(), 0], pa.int64()),
                    pa.array([*(d[t] for t in terms), 0], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "d"],
            )

    counts: dict = defaultdict(Counter)
    rows_with: dict = defaultdict(Counter)
    size = 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
            n, d = counts[lang, source], rows_with[lang, source]
            before = len(n)
            words = text.translate(TERMS).split()
            n.update(words)
            d.update(set(words))
            size += len(n) - before
        if size + len(counts) > limit:
            yield from rows()
            counts.clear()
            rows_with.clear()
            size = 0
    yield from rows()


def term_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n) of kept terms, with the language's total and whether the row is the term's first; a null term for each group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    partial = read.mapInArrow(_partial_counts, "lang string, source string, term string, n bigint, d bigint")
    n = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_term = Window.partitionBy("lang", "term")
    n = n.withColumns({"total": F.sum("n").over(of_term), "docs": F.sum("d").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    return n.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).select("lang", "source", "term", "n", "total", (F.col("first") & F.col("term").isNotNull()).alias("first"))


def shares(count: np.ndarray, total, terms: int) -> np.ndarray:
    """p of each count, as 64-bit numbers; counts that would not fit go through Python's numbers."""
    if not len(count) or int(count.max()) < 9_000_000_000:
        return 1 + PARTS * (count + 1) // (np.asarray(total, np.int64) + terms)
    return (1 + PARTS * (count.astype(object) + 1) // (np.asarray(total, object) + terms)).astype(np.int64)


def cost(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Trees:
    """Segment trees over the columns of a matrix of counts, one for each row; equal subtrees are one node of their level."""

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        padded = np.full((len(counts), width), -1, np.int64)
        padded[:, : counts.shape[1]] = counts
        self.leaves, node = np.unique(padded, return_inverse=True)
        node = node.reshape(padded.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves up
        while node.shape[1] > 1:
            n = int(node.max()) + 1
            pair, up = np.unique(node[:, ::2] * n + node[:, 1::2], return_inverse=True)
            self.children.append((pair // n, pair % n))
            node = up.reshape(len(counts), -1)
        self.root = node[:, 0]

    def pairs_of_leaves(self, a: int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The walk of root a with each of the roots b: index into b, the two counts, and at how many places they meet; sorted by the index."""
        k, na, nb, places = np.arange(len(b)), np.full(len(b), a), b, np.ones(len(b), np.int64)
        for left, right in reversed(self.children):
            k, places = np.concatenate((k, k)), np.concatenate((places, places))
            na, nb = np.concatenate((left[na], right[na])), np.concatenate((left[nb], right[nb]))
            key = (k * (int(na.max()) + 1) + na) * (int(nb.max()) + 1) + nb
            order = np.argsort(key)
            key, places = key[order], places[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            k, na, nb, places = k[order[first]], na[order[first]], nb[order[first]], np.add.reduceat(places, first)
        return k, self.leaves[na], self.leaves[nb], places


def price_pairs(trees: Trees, total: np.ndarray, terms: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values of every row of left against every row of right (both ways); rows of equal root and total are priced once."""
    of = np.stack((trees.root, total), 1)
    profile, which = np.unique(of, axis=0, return_inverse=True)
    which = which.reshape(-1)
    a, b = np.unique(which[left]), np.unique(which[right])
    there, back = np.zeros((len(a), len(b)), np.int64), np.zeros((len(a), len(b)), np.int64)
    same = np.array_equal(a, b)
    for i, x in enumerate(a):
        # Within one tile a walk prices both ways, so that only later profiles are left.
        to = b[i:] if same else b
        k, ca, cb, places = trees.pairs_of_leaves(profile[x, 0], profile[to, 0])
        real = ca >= 0
        p, q = shares(np.where(real, ca, 0), profile[x, 1], terms), shares(np.where(real, cb, 0), profile[to, 1][k], terms)
        first = np.searchsorted(k, np.arange(len(to)))
        there[i, len(b) - len(to) :] = np.add.reduceat(np.where(real, cost(p, q), 0) * places, first)
        back[i, len(b) - len(to) :] = np.add.reduceat(np.where(real, cost(q, p), 0) * places, first)
    if same:
        there, back = np.triu(there) + np.triu(back, 1).T, np.triu(back) + np.triu(there, 1).T
    ia, ib = np.searchsorted(a, which[left]), np.searchsorted(b, which[right])
    return there[ia[:, None], ib[None, :]], back[ia[:, None], ib[None, :]]


_PRICED = "part string, lang string, source string, item string, value bigint, m bigint, zeros bigint, v bigint"


def _price(top: int):
    def run(t: pa.Table) -> pa.Table:
        """One block of two tiles: rows of groups (null term; n is the group's sum) and of counts."""
        kind = pc.is_null(t["term"])
        groups, rows = t.filter(kind), t.filter(pc.invert(kind))
        names, tile = groups["source"].to_pylist(), groups["tile"].to_numpy()
        lang, v, whole = groups["lang"][0].as_py(), groups["v"][0].as_py(), groups["total"][0].as_py()
        total = groups["n"].to_numpy().astype(np.int64)
        number = {s: i for i, s in enumerate(names)}
        who = np.array([number[s] for s in rows["source"].to_pylist()], np.int64)
        coded = rows["term"].combine_chunks().dictionary_encode()
        terms, of_term = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        in_lang = np.zeros(len(terms), np.int64)
        in_lang[of_term] = rows["total"].to_numpy()
        place = np.empty(len(terms), np.int64)
        order = np.argsort(-in_lang, kind="stable")
        place[order] = np.arange(len(terms))
        counts = np.zeros((len(names), len(terms)), np.int64)
        n = rows["n"].to_numpy()
        counts[who, place[of_term]] = n
        one = t["ti"][0].as_py() == t["tj"][0].as_py()
        left = np.flatnonzero(tile == t["ti"][0].as_py())
        right = np.flatnonzero(tile == t["tj"][0].as_py())
        out: list[list] = [[] for _ in range(8)]

        def add(part, source, item, value, zeros):
            for column, x in zip(out, ([part] * len(item), [lang] * len(item), source, item, value, [len(terms)] * len(item), zeros, [v] * len(item)), strict=True):
                column.extend(x)

        if v:
            there, back = price_pairs(Trees(counts), total, v, left, right)
            none = shares(np.zeros(len(names), np.int64), total, v)
        else:
            there = back = np.zeros((len(left), len(right)), np.int64)
            none = np.ones(len(names), np.int64)
        for i, x in enumerate(left):
            others = np.flatnonzero(right != x) if one else np.arange(len(right))
            y = right[others]
            add("pair", [names[x]] * len(y), [names[k] for k in y], there[i, others].tolist(), cost(none[x], none[y]).tolist())
            if not one:
                add("pair", [names[k] for k in y], [names[x]] * len(y), back[i, others].tolist(), cost(none[y], none[x]).tolist())
        if one and len(n):
            # The walk of a source's tree with the language's: distinct pairs of leaves are priced once, zeros of the source are left out.
            leaf, at = np.unique(np.stack((total[who], n, in_lang[of_term]), 1), axis=0, return_inverse=True)
            p, q = shares(leaf[:, 1], leaf[:, 0], v), shares(leaf[:, 2], whole, v)
            f = np.where(p > q, cost(p, q), -1)[at.reshape(-1)]
            above = np.flatnonzero(f >= 0)
            by_name = np.empty(len(terms), np.int64)
            by_name[sorted(range(len(terms)), key=lambda i: terms[i].encode())] = np.arange(len(terms))
            above = above[np.lexsort((by_name[of_term[above]], -f[above], who[above]))]
            start = np.searchsorted(who[above], who[above])
            above = above[np.arange(len(above)) - start < top]
            add("term", [names[k] for k in who[above]], [terms[k] for k in of_term[above]], f[above].tolist(), [0] * len(above))
        kinds = [pa.string()] * 4 + [pa.int64()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["part", "lang", "source", "item", "value", "m", "zeros", "v"])

    return run


def audit(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): each other source of the language, and the source's terms above the language's share up to rank top."""
    store = Stored(docs.sparkSession)
    counts = store.write(term_counts(docs, lang_col=lang_col, source_col=source_col, text_col=text_col, min_docs=min_docs))
    of_lang = Window.partitionBy("lang")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("bigint")).alias("v"))
    # Rows of null terms count nothing: their n is 0.
    groups = groups.withColumns({"total": F.sum("n").over(of_lang), "v": F.sum("v").over(of_lang), "sources": F.count("source").over(of_lang), "tile": F.floor((F.row_number().over(of_lang.orderBy("source")) - 1) / tile).cast("int")})
    groups = store.write(groups.withColumns({"tiles": F.ceil(F.col("sources") / tile).cast("int"), "blocks": F.greatest(F.ceil(F.col("v") / block), F.lit(1)).cast("int")}))
    every_tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    tiles = [F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj")]
    a = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("*", every_tile)
    a = a.select("lang", "block", *tiles, "tile", "source", F.lit(None).cast("string").alias("term"), "n", "total", "v")
    b = counts.where(F.col("term").isNotNull()).join(groups.select("lang", "source", "tile", "tiles", "blocks"), ["lang", "source"])
    b = b.select("*", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")).select("*", every_tile)
    b = b.select("lang", "block", *tiles, "tile", "source", "term", "n", "total", F.lit(0).cast("bigint").alias("v"))
    # By a number of parts: blocks are few bytes and much work, so that Spark must not put many into one task.
    tasks = groups.groupBy("lang").agg(F.max(F.col("blocks") * F.col("tiles") * (F.col("tiles") + 1) / 2).alias("n")).agg(F.sum("n")).first()[0] or 1
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(tasks / 16))
    priced = a.unionAll(b).repartition(parts, "lang", "block", "ti", "tj").groupBy("lang", "block", "ti", "tj").applyInArrow(_price(top), _PRICED)
    priced = store.write(priced)
    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg((F.sum("value") + (F.max("v") - F.sum("m")) * F.max("zeros")).alias("value"))
    terms = priced.where("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int")
    return pairs.withColumn("rank", rank).unionAll(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def sql() -> str:
    """The same rows in DuckDB's SQL."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(d) >= {MIN_DOCS}),
l AS (SELECT lang, count(term) AS v, coalesce(sum(k.n), 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
g AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) LEFT JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({PARTS}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v)::HUGEINT AS p, 1 + ({PARTS}::HUGEINT * (k.n + 1)) // (l.total + l.v)::HUGEINT AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM s WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= {TOP}
"""
