"""Near-duplicates by ProbMinHash, banding and verification.

A text's shingles are all runs of five words (lower-case letters and digits; a text of one to four
words is one shingle), each with weight 1 however often it stands in the text, so that candidates
come from the same similarity by which links are verified. ProbMinHash: every shingle
sends arrivals of a Poisson process whose rate is its weight, each to a register chosen by hash;
the earliest arrival's shingle is the register's value. Only arrivals before a bound are made, and
the bound is raised for texts that still have an empty register: that ends early, and changes no
register. Two texts agree in a register with their probability Jaccard similarity, which for equal
weights is the plain Jaccard similarity of the sets. BANDS bands of
ROWS registers make candidates: a pair at 0.8 is missed with probability 3e-6.

Links are pairs of different texts whose sets of shingles have a Jaccard similarity of 0.8 or more,
verified exactly. Not all pairs of a band are made, yet none is lost:
- equal texts are one node from the start, known by 128 bits of their SHA-256;
- with u of its n shingles in no other candidate text, a text has similarity at most (n - u) / n to
  any other, and a pair at most min(n - u, n' - u') / max(n + u', n' + u), so that texts and pairs
  under 0.8 drop out exactly;
- in each band all texts are compared with one center, the text whose bands have most members; then
  only pairs of the band that lie in different components so far and that can still be similar by
  what each has besides the center and lacks of it (kept as bitmaps, which bound both from the safe
  side);
- in a band with more than CROWDED such texts they are not paired with each other: a text of n
  shingles with more than n / 5 besides the center can only be similar to one that shares some of these,
  one of its first n / 5 + 1 by hash among them, so they meet by those, each text once for all bands of a
  center; texts that lie within the center but for so many are still paired among themselves, where one
  of the two at least is not similar to the center.

Classes are the connected components, found by repeated minimum and pointer jumping over tables
in the shared folder; nothing but counts reaches the driver. A group's members meet neither in one
task nor as pairs; joins with a hot key have unique keys on the other side, so that Spark can split
them. The class id is the smallest id of the class; the row with it stays.

Null and empty texts are in no class but their own, and stay. Texts without words are linked to
equal texts only. Rows with equal id and equal text are one document. Null ids come last; a class
without any other has a null class id. Other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .common import Stored, free_name

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Members of a band, unlike its center, above which they are not paired with each other.
CROWDED = 64


def shingles(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each different shingle of each text."""
    start, end = block.runs(tb.ALNUM)
    lo, hi = block.of(start)
    h = block.hashes(block.prefix(tb.BYTE_LOWER), start, end)
    size = hi - lo
    doc = np.repeat(np.arange(len(lo)), np.maximum(size - SHINGLE + 1, 0))
    at = tb.ranges(lo, np.maximum(size - SHINGLE + 1, 0))
    value = tb.rolling(h, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        doc = np.concatenate((doc, short))
        value = np.concatenate((value, [tb.rolling(h[lo[i] : hi[i]], int(size[i]))[0] for i in short]))
    key = tb.mix(value + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key)
    new = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]]))) if len(order) else order
    count = np.diff(np.concatenate((new, [len(order)])))
    return doc[order[new]], value[order[new]], count


def _uniform(x: np.ndarray, salt: int) -> np.ndarray:
    return ((tb.mix(x + np.uint64(salt * 0x9E3779B97F4A7C15 & tb.MASK)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(n_docs: int, doc: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The registers of each text: the values whose arrivals were first. Texts without values have zeros."""
    m = REGISTERS
    out = np.zeros((n_docs, m), np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    todo = total > 0
    reach = np.where(todo, m * (np.log(m) + 4) / np.maximum(total, 1e-300), 0.0)
    while todo.any():
        use = np.flatnonzero(todo[doc])
        # The first arrival comes in time if its uniform number is above this.
        x, w, d = value[use], weight[use], doc[use]
        u = _uniform(x, 1)
        soon = np.flatnonzero(u >= np.exp(-w * reach[d]))
        x, w, d, time = x[soon], w[soon], d[soon], -np.log(u[soon]) / w[soon]
        first = np.full(n_docs * m, np.inf)
        made = []
        k = 1
        while len(x):
            register = d * m + (tb.mix(x + np.uint64((2 * k + 1) * 0xD1342543DE82EF95 & tb.MASK)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(first, register, time)
            made.append((register, time, x))
            k += 1
            time = time - np.log(_uniform(x, k)) / w
            on = np.flatnonzero(time <= reach[d])
            x, w, d, time = x[on], w[on], d[on], time[on]
        flat = out.reshape(-1)
        for register, time, x in made:
            won = time == first[register]
            flat[register[won]] = x[won]
        empty = np.isinf(first).reshape(n_docs, m).any(axis=1)
        todo &= empty
        reach = reach * 2
    return out


def bands(registers: np.ndarray) -> np.ndarray:
    """A hash of each band of each text."""
    out = np.zeros((len(registers), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(registers), b + 1, np.uint64)
        for r in range(ROWS):
            x = tb.mix(x * np.uint64(0x9FB21C651E98DF25) + registers[:, b * ROWS + r])
        out[:, b] = x
    return out


def _band_rows(batches):
    """Every text of the task once: one row for each band."""
    seen: set[bytes] = set()
    for b in batches:
        docs, ids = [], []
        for d in tb.texts(b.column(0)):
            key = hashlib.sha256(d).digest()[:16]
            if d and key not in seen:
                seen.add(key)
                docs.append(d)
                ids.append(key)
        for at, block in tb.blocks(docs):
            n = len(block.docs)
            doc, value, _ = shingles(block)
            has = np.flatnonzero(np.bincount(doc, minlength=n))
            rows = bands(signatures(n, doc, value, np.ones(len(value))))[has].view(np.int64)
            names = pa.array([ids[at + i] for i in has], pa.binary())
            short = np.array([int.from_bytes(ids[at + i][:8], "big", signed=True) for i in has], np.int64)
            pick = np.repeat(np.arange(len(has)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(rows.reshape(-1)), pa.array(short[pick]), names.take(pa.array(pick))], names=["band", "short", "node"])


#: Bytes of text for each part that shingles are dealt into to find those of one text only.
PART_BYTES = 1 << 22


def _local_shingles(parts: int):
    def rows(batches):
        """Shingles of the batch by part: those of one text here with its place in `nodes`, others once, with -1."""
        for b in batches:
            nodes = b.column(0).to_pylist()
            for at, block in tb.blocks(tb.texts(b.column(1))):
                doc, value, _ = shingles(block)
                order = np.argsort(value)
                value, doc = value[order], doc[order]
                new = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else order
                count = np.diff(np.concatenate((new, [len(value)])))
                owner = np.where(count == 1, doc[new], -1).astype(np.int32)
                mixed = tb.mix(value[new] + np.uint64(7))
                part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                low = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                by = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[by], np.arange(parts + 1)) if parts < len(by) else np.concatenate((np.flatnonzero(np.concatenate(([True], np.diff(part[by]) > 0))) if len(by) else [], [len(by)])).astype(np.int64)
                out: list[tuple] = []
                for x, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if x < z:
                        mine = by[x:z]
                        own = owner[mine]
                        keep = np.unique(own)
                        keep = keep[keep >= 0]
                        out.append((int(part[mine[0]]), low[mine].tobytes(), np.searchsorted(keep, own).astype(np.int32).tobytes(), (own >= 0).tobytes(), [nodes[at + i] for i in keep.tolist()]))
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "low", "owner", "single", "nodes"])

    return rows


def _unique_of_part(batches):
    """Rows sorted by part, one part at a time: for each text the number of its shingles that no other row of the part has."""

    def flush(rows):
        low = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
        base, nodes = [], []
        for r in rows:
            base.append(np.frombuffer(r[2], np.int32).astype(np.int64) + len(nodes))
            nodes += r[4]
        owner = np.concatenate(base)
        single = np.concatenate([np.frombuffer(r[3], bool) for r in rows])
        order = np.argsort(low, kind="stable")
        same = low[order[1:]] == low[order[:-1]]
        alone = np.ones(len(low), bool)
        alone[order[1:][same]] = False
        alone[order[:-1][same]] = False
        n = np.bincount(owner[alone & single], minlength=len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(n, pa.int64())], names=["node", "u"])

    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("part", "low", "owner", "single", "nodes")), strict=True):
            if held and row[0] != held[0][0]:
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


def _sizes(batches):
    for b in batches:
        nodes = b.column(0)
        for at, block in tb.blocks(tb.texts(b.column(1))):
            doc, _, _ = shingles(block)
            yield pa.RecordBatch.from_arrays([nodes.slice(at, len(block.docs)), pa.array(np.bincount(doc, minlength=len(block.docs)), pa.int64())], names=["node", "n"])


#: How many texts are compared with another one in one share.
SHARE = 512


LONGS = 8


def _bitmap(values: np.ndarray) -> list[int]:
    """A set as 64 * LONGS bits."""
    bits = np.zeros(64 * LONGS, np.uint8)
    bits[(tb.mix(values + np.uint64(11)) % np.uint64(64 * LONGS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _compared(batches):
    """Of each pair the size of x, what both have, whether it holds, bitmaps of what y has besides x and lacks of it, and
    the first shingles that y has besides x, as many as a text like y must share one of.

    The rows of x come in a row, its own text first (y null), whose shingles are kept meanwhile.
    """
    have = np.zeros(0, np.uint64)
    longs = pa.list_(pa.int64())
    for b in batches:
        x, y, text = b.column("x"), b.column("y"), tb.texts(b.column("t"))
        own = y.is_null().to_numpy(zero_copy_only=False)
        rows = []
        for at, block in tb.blocks(text):
            doc, value, _ = shingles(block)
            order = np.lexsort((value, doc))
            value = value[order]
            cut = np.searchsorted(doc[order], np.arange(len(block.docs) + 1))
            for i in range(len(block.docs)):
                mine = value[cut[i] : cut[i + 1]]
                if own[at + i]:
                    have = mine
                    continue
                shared = np.isin(mine, have, assume_unique=True)
                both = int(shared.sum())
                besides = mine[~shared]
                first = besides[: int((1 - SIMILARITY) * len(mine) + 1e-9) + 1]
                rows.append((len(have), both, both >= SIMILARITY * (len(have) + len(mine) - both), _bitmap(besides), _bitmap(have[~np.isin(have, mine, assume_unique=True)]), first.view(np.int64).tolist()))
        nx, both, holds, more, less, first = zip(*rows, strict=True) if rows else ((), (), (), (), (), ())
        others = pa.array(~own)
        yield pa.RecordBatch.from_arrays([x.filter(others), y.filter(others), pa.array(nx, pa.int64()), pa.array(both, pa.int64()), pa.array(holds, pa.bool_()), pa.array(more, longs), pa.array(less, longs), pa.array(first, longs)], names=["x", "y", "nx", "both", "holds", "more", "less", "first"])


def _can_be_similar(n, u, m, v):
    """By their own shingles (u of n, v of m) a pair can have the similarity."""
    return F.least(n - u, m - v) >= SIMILARITY * F.greatest(n + v, m + u)


def _bound(a: str, b: str):
    return _can_be_similar(*(F.col(f"{x}.{c}") for x in (a, b) for c in "nu"))


def _bound_by_center():
    """So it can by what p and q have besides the center of their band and lack of it.

    Both lack at least as many of the center's shingles as bits are set in either bitmap; besides the
    center they share at most the bits set in both, and as many as share bits.
    """
    bits = lambda f: sum((F.bit_count(f(k)) for k in range(1, LONGS)), F.bit_count(f(0)))
    lack = bits(lambda k: F.col("p.less")[k].bitwiseOR(F.col("q.less")[k]))
    share = bits(lambda k: F.col("p.more")[k].bitwiseAND(F.col("q.more")[k])) + F.least(F.col("p.extra"), F.col("q.extra"))
    both = F.col("p.nx") - lack + share
    return (1 + SIMILARITY) * both >= SIMILARITY * (F.col("p.n") + F.col("q.n"))


def _holds_with_center(p: str):
    """Whether a member is similar to the center of its band."""
    bits = sum((F.bit_count(F.col(f"{p}.more")[k]) for k in range(1, LONGS)), F.bit_count(F.col(f"{p}.more")[0]))
    both = F.col(f"{p}.n") - bits - F.col(f"{p}.extra")
    return both >= SIMILARITY * (F.col(f"{p}.nx") + F.col(f"{p}.n") - both)


def by_shingle(members: DataFrame, center: str = "band") -> DataFrame:
    """Members by their first shingles besides the center, those of a text once for all bands of a center."""
    once = members.select(F.col(center).alias("c"), "label", "within", F.col("node").alias("x"), "n", "u", "first").dropDuplicates(["c", "x"])
    return once.select("c", "label", "within", "x", "n", "u", F.explode("first").alias("s"))


def open_pairs(members: DataFrame, crowded: int, center: str = "band") -> DataFrame:
    """x, y of a band (members: band, label, node, n, u, p, within, first) with different labels that can be similar; each once.

    center: the column with the center of the band. Two texts that are similar to it have one label.
    """
    big = members.groupBy("band").agg(F.count("*").alias("c")).where(F.col("c") > crowded).select("band")
    both = (F.col("p.node").alias("x"), F.col("q.node").alias("y"))

    def among(rows: DataFrame, unlike: DataFrame, once) -> DataFrame:
        pairs = unlike.select("band", "label", "p").join(rows.select("band", F.col("label").alias("label_q"), F.col("p").alias("q")), "band")
        return pairs.where("label <> label_q").where(once).where(_bound("p", "q")).where(_bound_by_center())

    few = members.join(big, "band", "left_anti")
    many = members.join(big, "band", "left_semi")
    inside = many.where("within")
    # Of two inside one at least is unlike the center: p; if both are, p is the first.
    unlike = among(inside, inside.where(~_holds_with_center("p")), F.expr("p.node < q.node") | _holds_with_center("q"))
    each = by_shingle(many, center)
    other = each.select("c", "s", F.col("label").alias("label_q"), F.col("within").alias("within_q"), F.col("x").alias("y"), F.col("n").alias("m"), F.col("u").alias("v"))
    met = each.join(other, ["c", "s"]).where("x < y and label <> label_q and not (within and within_q)").where(_can_be_similar(*map(F.col, "numv"))).select("x", "y")
    inner = unlike.select(F.least("p.node", "q.node").alias("x"), F.greatest("p.node", "q.node").alias("y"))
    return among(few, few, F.expr("p.node < q.node")).select(*both).union(inner).union(met).distinct()


def components(links: DataFrame, store: Stored) -> DataFrame:
    """node and label (the smallest node of its component) for every node of the links x, y."""
    both = store.write(links.select("x", "y").union(links.select(F.col("y"), F.col("x"))).distinct())
    labels = store.write(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.x).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("p"), F.col("label").alias("above"))
        after = store.write(lower.join(up, lower.label == up.p, "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"), "old"))
        moved = after.where("label <> old").limit(1).count()
        store.drop(labels)
        labels = after
        if not moved:
            store.drop(both)
            return labels.select("node", "label")


def with_nodes(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with the node of each row's text, null for null and empty texts."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.withColumn(name, F.when(F.length(text) > 0, F.unhex(F.substring(F.sha2(text, 256), 1, 32))))


def labels_of_texts(docs: DataFrame, text_col: str, store: Stored, crowded: int = CROWDED) -> DataFrame:
    """node and label for every text that is linked to a different one."""
    text = F.col(f"`{text_col}`").cast("string")
    made = store.write(docs.select(text.alias("t")).where("t <> ''").mapInArrow(_band_rows, "band bigint, short bigint, node binary"))
    shared = made.groupBy("band").agg(F.min("short").alias("a"), F.max("short").alias("b")).where("a < b").select("band")
    member = store.write(made.join(shared, "band", "left_semi").select("band", "node").distinct())
    store.drop(made)
    wanted = member.select("node").distinct()
    texts = with_nodes(docs.select(text.alias("t")), "t", "node").where("node is not null").dropDuplicates(["node"])
    texts = store.write(texts.join(wanted, "node", "left_semi").select("node", "t"))
    written: list[DataFrame] = []
    parts = 1 + (texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // PART_BYTES
    alone = texts.mapInArrow(_local_shingles(parts), "part int, low binary, owner binary, single binary, nodes array<binary>")
    alone = alone.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_unique_of_part, "node binary, u bigint").groupBy("node").agg(F.sum("u").alias("u"))
    sizes = texts.mapInArrow(_sizes, "node binary, n bigint")
    facts = sizes.join(alone, "node", "left").select("node", "n", F.coalesce("u", F.lit(0)).alias("u")).where(F.col("n") - F.col("u") >= SIMILARITY * F.col("n"))
    member2 = store.write(member.join(facts, "node").select("band", F.struct("node", "n", "u").alias("m")))
    store.drop(member)

    def compare(pairs: DataFrame) -> DataFrame:
        """Each x meets its ys in shares of about SHARE, to each of which its text is sent once."""
        pairs = store.write(pairs.select("x", "y"))
        written.append(pairs)
        shares = pairs.groupBy("x").agg(F.ceil(F.count("*") / SHARE).alias("n"))
        first = shares.join(texts, F.col("x") == F.col("node")).select("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("share"), F.lit(None).cast("binary").alias("y"), "t")
        rest = pairs.join(shares, "x").select("x", F.pmod(F.xxhash64("y"), "n").alias("share"), "y").join(texts, F.col("y") == F.col("node")).select("x", "share", "y", "t")
        rows = first.union(rest).repartition("x", "share").sortWithinPartitions("x", "share", F.asc_nulls_first("y")).select("x", "y", "t")
        return rows.mapInArrow(_compared, "x binary, y binary, nx bigint, both bigint, holds boolean, more array<bigint>, less array<bigint>, first array<bigint>")

    # The center of a band is the text whose bands have most members altogether.
    crowd = member2.groupBy("band").agg(F.count("*").alias("members"))
    weight = member2.join(crowd, "band").groupBy(F.col("m.node").alias("k")).agg(F.sum("members").alias("w"))
    weighed = member2.join(weight, F.col("m.node") == F.col("k"))
    center = weighed.groupBy("band").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("m.node").alias("node"))).alias("c")).select("band", F.col("c.node").alias("x"))
    spokes = store.write(member2.join(center, "band").select("band", "m", "x"))
    stars = store.write(compare(spokes.where("m.node <> x").select("x", F.col("m.node").alias("y")).distinct()))
    first = stars.where("holds").select("x", "y")
    label = components(first, store)
    # What is left: pairs of a band, both besides the center, in different components.
    placed = spokes.join(label.select(F.col("node").alias("k"), "label"), F.col("m.node") == F.col("k"), "left").select("band", "m", "x", F.coalesce("label", "m.node").alias("label"))
    placed = store.write(placed)
    split = placed.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("band")
    facts = stars.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "nx", "both", "more", "less", "first")
    open_ = placed.join(split, "band", "left_semi").join(facts, (F.col("x") == F.col("sx")) & (F.col("m.node") == F.col("sy")))
    besides = F.col("m.n") - F.col("both")
    set_bits = sum((F.bit_count(F.col("more")[k]) for k in range(1, LONGS)), F.bit_count(F.col("more")[0]))
    within = besides <= F.floor(F.col("m.n") * F.lit(1 - SIMILARITY) + 1e-9)
    member3 = store.write(open_.select("band", "x", "label", "m.node", "m.n", "m.u", F.struct("m.node", "m.n", "m.u", "nx", "more", "less", (besides - set_bits).alias("extra")).alias("p"), within.alias("within"), "first"))
    rest = open_pairs(member3, crowded, "x")
    tried = stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    second = store.write(compare(rest.join(tried, ["x", "y"], "left_anti")).where("holds").select("x", "y"))
    if second.limit(1).count():
        label = components(first.union(second), store)
    store.drop(texts, member2, spokes, placed, stars, second, member3, *written)
    return label


def labelled_rows(docs: DataFrame, id_col: str, text_col: str, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """id, node and label of each row (label null where there is no text), and of each label the id and node that stay."""
    label = labels_of_texts(docs, text_col, Stored(docs.sparkSession), crowded)
    rows = with_nodes(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")), "t", "node").drop("t")
    rows = rows.join(label.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").select("id", "node", F.coalesce("label", "node").alias("label"))
    winner = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "node")).alias("w"))
    return rows, winner.select(F.col("label").alias("l2"), "w")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One row a row of docs: the id, class_id and kept (the row with the class's smallest id)."""
    rows, winner = labelled_rows(docs, id_col, text_col, crowded)
    out = rows.join(winner, F.col("label") == F.col("l2"), "left")
    alone = F.col("label").isNull()
    return out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("w.id")).alias("class_id"), (alone | (F.col("id").eqNullSafe(F.col("w.id")) & (F.col("node") == F.col("w.node")))).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: all columns of one row of each class, and all null and empty texts."""
    _, winner = labelled_rows(docs, id_col, text_col)
    node, win_id, win_node = (free_name(docs.columns, c) for c in ("node", "win_id", "win_node"))
    full = with_nodes(docs, text_col, node)
    winner = winner.select(F.col("w.id").alias(win_id), F.col("w.node").alias(win_node))
    kept = full.where(F.col(node).isNotNull()).join(winner, (F.col(node) == F.col(win_node)) & F.col(f"`{id_col}`").eqNullSafe(F.col(win_id)), "left_semi").dropDuplicates([node])
    return kept.union(full.where(F.col(node).isNull())).drop(node)
