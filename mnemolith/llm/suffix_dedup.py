"""Removal of repeated strings by suffix sorting with a difference cover.

A string is a number of tokens in a row: bytes (BYTES, 400 of them), or words between white space
(WORDS, 50 of them, however many bytes that is). Every byte covered by a string that also starts
anywhere else, in another text or the same one, is removed; strings are judged on the input. The
suffixes that must be compared are dealt over the cluster by content, and sorted there by the
difference-cover algorithm:

1. In each window of `span` tokens the smallest hash of `gram` tokens elects a place, the leftmost of
   equals. Equal windows elect at the same place, so they meet in the bucket of that hash. A place
   owns a run of neighbouring windows, whose tokens together are its stretch.
2. A bucket with one stretch only is done: nothing repeats, or all of its windows do, if the same
   stretch stands more than once. Stretches are the same if their 128-bit BLAKE2 digests are. Of
   different stretches one each goes on, with its bytes.
3. Whole buckets lie in one task, some at a time in one array. Triples at two of three places are
   sorted and named; the names' suffixes are sorted the same way, recursively, until names differ;
   the rest is sorted by first token and the rank that follows, and merged. A window is repeated if
   its neighbour in the order has the same first `span` tokens; those are compared themselves (words
   by their bytes).
4. Buckets of more than `crowd` stretches would be too much for a task. Their windows are dealt by a
   fingerprint of all their tokens instead, into as many parts as their bytes ask for, repeated ones
   of a task first put together: the values of the tokens' polynomial at two points modulo 2^61 - 1,
   which are drawn anew for each run. Two different windows agree in both with a chance below 2^-104,
   whatever the text is (sums modulo 2^64 agree on some regular patterns, and only elect places here).

Only places (about one for 170 bytes or 22 words), the stretches of step 3 and, by their 128-bit
digest, one copy of each text are shuffled. Nothing but a sum reaches the driver. Equal texts are
looked at once: their number says that all of them repeat. A task remembers the digests of its own
input split's texts, 16 bytes each.

Null counts as empty. Texts under the shortest string lose nothing. Very long texts are cut in
overlapping pieces for step 1. Repeated rows are copies like any other. Other columns don't matter,
whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .common import Stored, free_name


@dataclass(frozen=True)
class Unit:
    """Strings of `span` tokens, bytes or words; `gram` tokens elect places."""

    span: int
    gram: int
    words: bool = False

    @property
    def least(self) -> int:
        """Bytes of the shortest string."""
        return 2 * self.span - 1 if self.words else self.span


BYTES = Unit(400, 64)
WORDS = Unit(50, 8, words=True)

PIECE = 1 << 20
CROWD = 1500
#: Bytes in one array: of stretches that are sorted, of texts in which places are elected (or one bucket, one piece).
STEP, BLOCK = 1 << 17, 1 << 18
_PLACE_BITS = 24


class Tokens:
    """The tokens of a block's texts: a hash, first and past-the-last byte of each; each text's first and past-the-last token."""

    def __init__(self, block: tb.Block, unit: Unit, pre: np.ndarray):
        if unit.words:
            self.at, self.till = block.runs(tb.SPACED)
            self.lo, self.hi = block.of(self.at)
            self.value = tb.Block.hashes(pre, self.at, self.till)
        else:
            self.at = np.arange(len(block.buf))
            self.till = self.at + 1
            self.lo, self.hi = block.start, block.end
            self.value = tb.BYTE_CASED[block.buf]

    def contents(self, block: tb.Block) -> np.ndarray:
        """A number for each token, the same for equal tokens only: bytes themselves, words by their order of appearance."""
        if len(self.at) == len(block.buf):
            return block.buf.astype(np.int64)
        numbers: dict[bytes, int] = {}
        buf = block.buf.tobytes()
        return np.fromiter((numbers.setdefault(buf[a:z], len(numbers)) for a, z in zip(self.at.tolist(), self.till.tolist(), strict=True)), np.int64, len(self.at))

    def windows(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens of all windows, and how many each text has."""
        n = np.maximum(self.hi - self.lo - span + 1, 0)
        return tb.ranges(self.lo, n), n


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes of s (positive numbers) in order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s.astype(np.int64), [0, 0, 0]))
    base = int(t.max()) + 1
    m1 = np.arange(1, n + (n % 3 == 1), 3)
    m2 = np.arange(2, n, 3)
    sample = np.concatenate((m1, m2))
    triple = np.concatenate([(t[a : a + 3 * k : 3] * base + t[a + 1 : a + 1 + 3 * k : 3]) * base + t[a + 2 : a + 2 + 3 * k : 3] for a, k in ((1, len(m1)), (2, len(m2)))])
    order = np.argsort(triple)  # equal triples get one name, so their order does not matter
    ranked = triple[order]
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])))
    if name[order[-1]] < len(sample):
        order = suffix_array(name)
    sorted12 = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sorted12] = np.arange(1, len(sample) + 1)
    sorted12 = sorted12[sorted12 < n]
    m0 = np.arange(0, n, 3)
    big = n + 3
    key0 = t[m0] * big + rank[m0 + 1]
    m0 = m0[np.argsort(key0)]
    # How many sampled suffixes come before each of the rest: against each kind by what both have.
    one, two = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    before = np.searchsorted(t[one] * big + rank[one + 1], t[m0] * big + rank[m0 + 1])
    before += np.searchsorted((t[two] * base + t[two + 1]) * big + rank[two + 2], (t[m0] * base + t[m0 + 1]) * big + rank[m0 + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(m0))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at] = m0
    out[rest] = sorted12
    return out


def really_equal(s: np.ndarray, i: np.ndarray, j: np.ndarray, span: int, at_once: int = 1 << 22) -> np.ndarray:
    """For pairs of places (i after j by any distance) whether their next `span` numbers are the same.

    Neighbouring pairs of one distance are compared as one stretch.
    """
    out = np.ones(len(i), bool)
    if not len(i):
        return out
    o = np.lexsort((i, i - j))
    a, gap = i[o], (i - j)[o]
    head = np.flatnonzero(np.concatenate(([True], (gap[1:] != gap[:-1]) | (a[1:] != a[:-1] + 1))))
    count = np.diff(np.concatenate((head, [len(o)])))
    size = count + span - 1
    group = np.cumsum(size) // at_once
    for g in np.split(np.arange(len(head)), np.flatnonzero(group[1:] != group[:-1]) + 1):
        x = tb.ranges(a[head[g]], size[g])
        differ = s[x] != s[x - np.repeat(gap[head[g]], size[g])]
        if differ.any():  # equal hashes of different windows
            bad = np.concatenate(([0], np.cumsum(differ)))
            begin = np.concatenate(([0], np.cumsum(size[g])))[:-1]
            first = tb.ranges(begin, count[g])
            out[o[tb.ranges(head[g], count[g])]] = bad[first + span] == bad[first]
    return out


def runs_of(flags: np.ndarray, at: np.ndarray, till: np.ndarray, span: int, first: int = 0) -> list[int]:
    """Bytes that the flagged windows of a text cover: starts and ends in turn. at, till: bytes of its tokens; first is added."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    out: list[int] = []
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out += [first + int(at[a]), first + int(till[z + span - 2])]
    return out


def _spans(block: tb.Block, tok: Tokens, flags: np.ndarray, n: np.ndarray, span: int, first: Sequence[int]) -> list[list[int]]:
    """runs_of for each text, from the flags of all windows in a row."""
    ends = np.cumsum(n)
    out: list[list[int]] = [[] for _ in n]
    some = np.flatnonzero(tb.per_text(flags, ends - n, ends))
    for i in some.tolist():
        own = slice(tok.lo[i], tok.hi[i])
        out[i] = runs_of(flags[ends[i] - n[i] : ends[i]], tok.at[own], tok.till[own], span, int(first[i]) - int(block.start[i]))
    return out


def repeated(strings: list[bytes], unit: Unit, first: Sequence[int] | None = None) -> list[list[int]]:
    """For each string the bytes covered by windows that stand anywhere else in the strings; first is added to each place."""
    block = tb.Block(strings)
    tok = Tokens(block, unit, block.prefix())
    n = tok.hi - tok.lo
    k = len(strings)
    text = np.repeat(np.arange(k), n)
    number = tok.contents(block)
    s = np.empty(len(text) + k, np.int64)
    s[np.arange(len(text)) + text] = number[tb.ranges(tok.lo, n)] + k + 1
    s[np.cumsum(n) + np.arange(k)] = np.arange(1, k + 1)  # each string ends by a mark of its own
    many = np.maximum(n - unit.span + 1, 0)
    places = tb.ranges(np.cumsum(n) - n + np.arange(k), many)
    window = np.zeros(len(s), bool)
    window[places] = True
    order = suffix_array(s)
    order = order[window[order]]
    content = tb.Block.hashes(tb.prefix(tb.mix(s)), order, order + unit.span)
    same = np.flatnonzero(content[1:] == content[:-1])
    same = same[really_equal(s, order[same + 1], order[same], unit.span)]
    hit = np.zeros(len(s), bool)
    hit[order[same + 1]] = True
    hit[order[same]] = True
    return _spans(block, tok, hit[places], many, unit.span, first if first is not None else [0] * k)


def elected(tok: Tokens, unit: Unit) -> tuple[np.ndarray, ...]:
    """The places that windows elect: text, first token of the first and of the last window, hash at the place."""
    n = len(tok.value)
    none = np.zeros(0, np.int64)
    width = unit.span - unit.gram + 1
    if n < unit.span:
        return none, none, none, none.astype(np.uint64)
    pre = tb.prefix(tok.value)
    at = np.arange(n - unit.gram + 1)
    gram = tb.Block.hashes(pre, at, at + unit.gram)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    key = (gram & ~low) | at.astype(np.uint64)
    rows = -(-len(key) // width)
    key = np.concatenate((key, np.full(rows * width - len(key), np.iinfo(np.uint64).max))).reshape(rows, width)
    head = np.minimum.accumulate(key, axis=1).reshape(-1)
    tail = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    s, _ = tok.windows(unit.span)
    place = (np.minimum(tail[s], head[s + width - 1]) & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(s) else none
    lo, hi = s[new], s[np.concatenate((new[1:], [len(s)])) - 1] if len(s) else none
    doc = np.searchsorted(tok.lo, lo, "right") - 1
    return doc, lo, hi, gram[place[new]]


def digests(buf: bytes, at: np.ndarray, till: np.ndarray, words: bool) -> np.ndarray:
    """Two 64-bit numbers for each piece of buf; of words, white space between them doesn't count."""
    pieces = (buf[a:z] for a, z in zip(at.tolist(), till.tolist(), strict=True))
    if words:
        pieces = (b" ".join(x.split()) for x in pieces)
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in pieces]), "<u8").reshape(-1, 2)


PRIME = (1 << 61) - 1
_P, _HALF, _LOWER = np.uint64(PRIME), np.uint64(31), np.uint64((1 << 31) - 1)
_SHIFT, _UNDER = np.uint64(30), np.uint64((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of numbers below PRIME, modulo PRIME: by halves of 31 bits, as 2^61 is 1."""
    ah, al, bh, bl = a >> _HALF, a & _LOWER, b >> _HALF, b & _LOWER
    middle = ah * bl + al * bh
    return _reduced(np.uint64(2) * ah * bh + (middle >> _SHIFT) + ((middle & _UNDER) << _HALF) + al * bl)


_powers_of: dict[int, np.ndarray] = {}


def powers_of(x: int, n: int) -> np.ndarray:
    """x ** 0 .. x ** (n - 1) modulo PRIME; a process keeps those of its last points."""
    have = _powers_of.get(x)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        done = 1
        while done < len(out):
            k = min(done, len(out) - done)
            out[done : done + k] = product(out[:k], np.uint64(pow(x, done, PRIME)))
            done += k
        if len(_powers_of) > 8:
            _powers_of.clear()
        _powers_of[x] = have = out
    return have[:n]


def fingerprints(values: np.ndarray, start: np.ndarray, span: int, point: int) -> np.ndarray:
    """The polynomial of `span` values (below PRIME) from each start, at the point."""
    terms = product(values, powers_of(point, len(values)))
    high, low = np.cumsum(terms >> _HALF, dtype=np.uint64), np.cumsum(terms & _LOWER, dtype=np.uint64)
    pre = np.concatenate(([np.uint64(0)], _reduced((high >> _SHIFT) + ((high & _UNDER) << _HALF) + _reduced(low))))
    return product(_reduced(pre[start + span] + (_P - pre[start])), powers_of(pow(point, -1, PRIME), len(values))[start])


def _pieces(d: bytes, units: Sequence[Unit]) -> Iterator[tuple[int, int, int]]:
    """Pieces of a text: for which units (bits), first and past-the-last byte. Each window is in one piece of its unit."""
    if len(d) <= PIECE:
        yield (1 << len(units)) - 1, 0, len(d)
        return
    for u, unit in enumerate(units):
        if unit.words:
            at, till = tb.Block([d]).runs(tb.SPACED)
            step = PIECE // 8
            for w in range(0, len(at) - unit.span + 1, step):
                yield 1 << u, int(at[w]), int(till[min(w + step + unit.span - 1, len(at)) - 1])
        else:
            for a in range(0, len(d) - unit.span + 1, PIECE):
                yield 1 << u, a, min(a + PIECE + unit.span - 1, len(d))


_PLACES = "unit int, bucket bigint, stretch binary, node binary, lo bigint, till bigint, n int"


def _places(units: Sequence[Unit]):
    def rows(batches):
        """Rows of places: of equal stretches in a piece of work one, with how many there are (2: more than one).

        What repeats there already is sent as bytes of the text to be removed (bucket null).
        """
        seen: set[bytes] = set()
        least = min(u.least for u in units)
        names = ["unit", "bucket", "stretch", "node", "lo", "till", "n"]
        for b in batches:
            pieces, kinds, nodes, offset = [], [], [], []
            for d in tb.texts(b.column(0)):
                if len(d) < least:
                    continue
                node = hashlib.sha256(d).digest()[:16]
                if node in seen:
                    continue
                seen.add(node)
                for kind, a, z in _pieces(d, units):
                    pieces.append(d[a:z])
                    kinds.append(kind)
                    nodes.append(node)
                    offset.append(a)
            for at, block in tb.blocks(pieces, BLOCK):
                m = len(block.docs)
                pre, buf = block.prefix(), block.buf.tobytes()
                node = pa.array(nodes[at : at + m], pa.binary())
                shift = np.array(offset[at : at + m], np.int64) - block.start
                kind = np.array(kinds[at : at + m])
                for u, unit in enumerate(units):
                    tok = Tokens(block, unit, pre)
                    tok.hi = np.where(kind >> u & 1, tok.hi, tok.lo)
                    doc, lo, hi, gram = elected(tok, unit)
                    if not len(doc):
                        continue
                    gram = tb.mix(gram + np.uint64(u))
                    lo, till = tok.at[lo], tok.till[hi + unit.span - 1]
                    stretch = digests(buf, lo, till, unit.words)
                    lo, till = lo + shift[doc], till + shift[doc]
                    order = np.lexsort((stretch[:, 1], stretch[:, 0]))
                    key = stretch[order]
                    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
                    count = np.diff(np.concatenate((first, [len(order)])))
                    one = order[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(one), u, np.int32)), pa.array(gram[one].view(np.int64)), pa.array(np.ascontiguousarray(stretch[one]).view("V16").reshape(-1).tolist(), pa.binary()), node.take(pa.array(doc[one])), pa.array(lo[one]), pa.array(till[one]), pa.array(np.minimum(count, 2).astype(np.int32))],
                        names=names,
                    )
                    again = np.sort(order[np.repeat(count > 1, count)])
                    if len(again):
                        # Stretches that touch are one piece of text.
                        d, a, z = doc[again], lo[again], till[again]
                        head = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (a[1:] > z[:-1]))))
                        k = len(head)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(k, u, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), node.take(pa.array(d[head])), pa.array(a[head]), pa.array(np.maximum.reduceat(z, head)), pa.array(np.full(k, 2, np.int32))],
                            names=names,
                        )

    return rows


def _cut_out(batches):
    """Bytes of the stretches that a text must send."""
    for b in batches:
        texts = tb.texts(b.column(0))
        for i, places in enumerate(b.column(2).to_pylist()):
            d = texts[i]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p["unit"] for p in places], pa.int32()),
                    pa.array([p["bucket"] for p in places], pa.int64()),
                    pa.array([p["crowded"] for p in places], pa.bool_()),
                    b.column(1)[i : i + 1].take(pa.array(np.zeros(len(places), np.int64))),
                    pa.array([p["lo"] for p in places], pa.int64()),
                    pa.array([d[p["lo"] : p["till"]] for p in places], pa.binary()),
                ],
                names=["unit", "bucket", "crowded", "node", "lo", "bytes"],
            )


_LIST = pa.list_(pa.int64())
_FOUND = "unit int, node binary, spans array<bigint>"


def _found(unit: list[int], node: list[bytes], spans: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(node, pa.binary()), pa.array(spans, _LIST)], names=["unit", "node", "spans"])


def _sorted_buckets(units: Sequence[Unit]):
    def rows(batches):
        """Whole buckets come one after the other; the windows of some at a time are compared."""

        def flush(held):
            for u, unit in enumerate(units):
                own = [r for r in held if r[0] == u]
                if len(own) > 1:
                    spans = repeated([r[4] for r in own], unit, [r[3] for r in own])
                    some = [i for i, x in enumerate(spans) if x]
                    yield _found([u] * len(some), [own[i][2] for i in some], [spans[i] for i in some])

        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("unit", "bucket", "node", "lo", "bytes")), strict=True):
                if row[1] != last and size > STEP:
                    yield from flush(held)
                    held, size = [], 0
                last = row[1]
                held.append(row)
                size += len(row[4])
        yield from flush(held)

    return rows


#: A window of a crowded bucket: its fingerprint, its place in the text, the number of its text in the row, its bytes.
_WINDOW = np.dtype([("h", "<u8"), ("h2", "<u8"), ("lo", "<i8"), ("owner", "<i4"), ("size", "<i4")])


def _values(tok: Tokens, block: tb.Block, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers below PRIME for each token: of bytes themselves, of words 122 bits of their digest."""
    if not unit.words:
        x = block.buf.astype(np.uint64) + np.uint64(1)
        return x, x
    number = tok.contents(block)
    _, first = np.unique(number, return_index=True)
    d = digests(block.buf.tobytes(), tok.at[first], tok.till[first], True) & _P
    return d[number, 0] % _P, d[number, 1] % _P


#: Bytes of text for each part that the windows of crowded buckets are dealt into.
PART_BYTES = 1 << 20


def _dealt_windows(units: Sequence[Unit], parts: int, points: tuple[int, int]):
    def rows(batches):
        """Windows of crowded buckets by the fingerprint of their tokens; those found twice here are sent as removed, and once on."""
        names = ["unit", "part", "windows", "nodes", "node", "spans"]
        for b in batches:
            kind = b.column("unit").to_numpy(zero_copy_only=False)
            for u, unit in enumerate(units):
                own = b.filter(pa.array(kind == u))
                docs, nodes, lows = tb.texts(own.column("bytes")), own.column("node").to_pylist(), own.column("lo").to_numpy(zero_copy_only=False)
                for at, block in tb.blocks(docs, BLOCK):
                    tok = Tokens(block, unit, block.prefix())
                    s, n = tok.windows(unit.span)
                    doc = np.repeat(np.arange(len(n)), n)
                    here = lows[at : at + len(n)]
                    w = np.empty(len(s), _WINDOW)
                    values = _values(tok, block, unit)
                    w["h"], w["h2"] = (fingerprints(v, s, unit.span, x) for v, x in zip(values, points, strict=True))
                    w["lo"] = tok.at[s] - block.start[doc] + here[doc]
                    w["size"] = tok.till[s + unit.span - 1] - tok.at[s]
                    order = np.lexsort((w["h2"], w["h"]))
                    k = w[order]
                    first = np.flatnonzero(np.concatenate(([True], (k["h"][1:] != k["h"][:-1]) | (k["h2"][1:] != k["h2"][:-1])))) if len(k) else order
                    count = np.diff(np.concatenate((first, [len(order)])))
                    flags = np.zeros(len(s), bool)
                    flags[order[np.repeat(count > 1, count)]] = True
                    spans = _spans(block, tok, flags, n, unit.span, here)
                    done = [i for i, x in enumerate(spans) if x]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([u] * len(done), pa.int32()), pa.nulls(len(done), pa.int32()), pa.nulls(len(done), pa.binary()), pa.nulls(len(done), pa.list_(pa.binary())), pa.array([nodes[at + i] for i in done], pa.binary()), pa.array([spans[i] for i in done], _LIST)],
                        names=names,
                    )
                    one = order[first]
                    part = (w["h"][one] % np.uint64(parts)).astype(np.int64)
                    by = np.argsort(part, kind="stable")
                    one, part = one[by], part[by]
                    cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(one) else [], [len(one)])).astype(np.int64)
                    out: list[tuple] = []
                    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        pick = w[one[a:z]]
                        keep, pick["owner"] = np.unique(doc[one[a:z]], return_inverse=True)
                        out.append((int(part[a]), pick.tobytes(), [nodes[at + i] for i in keep.tolist()]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([u] * len(out), pa.int32()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.list_(pa.binary())), pa.nulls(len(out), pa.binary()), pa.nulls(len(out), _LIST)],
                        names=names,
                    )

    return rows


def _met_windows(batches):
    """Rows sorted by unit and part, one part at a time: windows that more than one row has."""

    def flush(key, rows):
        w = np.concatenate([np.frombuffer(r[2], _WINDOW) for r in rows])
        nodes: list[bytes] = []
        owner = []
        for r in rows:
            owner.append(np.full(len(r[2]) // _WINDOW.itemsize, len(nodes), np.int64))
            nodes += r[3]
        owner = np.concatenate(owner) + w["owner"]
        order = np.lexsort((w["h2"], w["h"]))
        k = w[order]
        same = np.flatnonzero((k["h"][1:] == k["h"][:-1]) & (k["h2"][1:] == k["h2"][:-1]))
        hit = np.unique(order[np.concatenate((same, same + 1))])
        who, inverse = np.unique(owner[hit], return_inverse=True)
        spans: list[list[int]] = [[] for _ in who]
        for i, lo, size in zip(inverse.tolist(), w["lo"][hit].tolist(), w["size"][hit].tolist(), strict=True):
            spans[i] += [lo, lo + size]
        return _found([key[0]] * len(who), [nodes[i] for i in who.tolist()], spans)

    held, last = [], None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("unit", "part", "windows", "nodes")), strict=True):
            if last is not None and row[:2] != last:
                yield flush(last, held)
                held = []
            last = row[:2]
            held.append(row)
    if held:
        yield flush(last, held)


def _node(text) -> F.Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _text(text_col: str):
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def shared_places(places: DataFrame) -> DataFrame:
    """Places of buckets that have more than one. Most have one, where nothing can repeat; they are told apart by the bucket's number alone."""
    shared = places.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").select("bucket")
    return places.join(shared, "bucket", "left_semi").select(*places.columns)


def repeated_spans(docs: DataFrame, text_col: str = "text", *, units: Sequence[Unit] = (BYTES,), crowd: int = CROWD, store: Stored | None = None) -> tuple[DataFrame, DataFrame]:
    """One row for each different text that can hold a string: node, t, copies; and node with spans_0, spans_1 and so
    on for the units (starts and ends of repeated bytes in turn, unsorted, overlapping), without what copies repeat.

    The spans are a table in the shared folder; the others that the work needs are deleted before this returns.
    """
    store = store or Stored(docs.sparkSession)
    least = min(u.least for u in units)
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).where(F.octet_length("t") >= least)
    places = store.write(rows.mapInArrow(_places(units), _PLACES))
    met_places = store.write(shared_places(places))
    here_already = store.write(places.where("bucket is null").select("unit", "node", "lo", "till"))
    store.drop(places)
    kinds = store.write(met_places.groupBy("bucket", "stretch").agg(F.sum("n").alias("n")))
    variety = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"))
    # Of a stretch the repeated ones are settled; one of each goes on where a bucket has others.
    facts = kinds.join(variety, "bucket").select("bucket", "stretch", "kinds", (F.col("n") > 1).alias("repeated"))
    known = store.write(met_places.join(facts, ["bucket", "stretch"]).select("unit", "bucket", "stretch", "node", "lo", "till", "kinds", "repeated"))
    store.drop(met_places, kinds)
    covered = ("unit", "node", F.array("lo", "till").alias("spans"))
    settled = known.where("repeated").select(*covered).union(here_already.select(*covered))
    going = known.where("kinds > 1")
    asks = ("unit", "bucket", "lo", "till", "kinds")
    single = going.where("not repeated").select("node", *asks)
    other = going.where("repeated").groupBy("bucket", "stretch").agg(F.min(F.struct("node", *asks)).alias("m")).select("m.*")
    asked = single.union(other).groupBy("node").agg(F.collect_list(F.struct("unit", "bucket", "lo", "till", (F.col("kinds") > crowd).alias("crowded"))).alias("places"))

    text = _text(text_col)
    texts = docs.select(text.alias("t"), _node(text).alias("node")).where(F.octet_length("t") >= least).groupBy("node").agg(F.first("t").alias("t"), F.count("*").alias("copies"))
    cut = store.write(texts.join(asked, "node").select("t", "node", "places").mapInArrow(_cut_out, "unit int, bucket bigint, crowded boolean, node binary, lo bigint, bytes binary"))
    compared = cut.where("not crowded").select("unit", "bucket", "node", "lo", "bytes").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_buckets(units), _FOUND)
    size = cut.where("crowded").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    parts = 1 + size // PART_BYTES
    points = tuple(2 + secrets.randbelow(PRIME - 3) for _ in range(2))
    dealt = store.write(cut.where("crowded").select("unit", "node", "lo", "bytes").mapInArrow(_dealt_windows(units, parts, points), "unit int, part int, windows binary, nodes array<binary>, node binary, spans array<bigint>"))
    met = dealt.where("part is not null").select("unit", "part", "windows", "nodes").repartition(parts, "unit", "part").sortWithinPartitions("unit", "part").mapInArrow(_met_windows, _FOUND)
    here = dealt.where("part is null").select("unit", "node", "spans")
    found = store.write(settled.unionByName(compared).unionByName(met).unionByName(here))
    store.drop(here_already, known, cut, dealt)
    return texts, found.groupBy("node").agg(*[F.flatten(F.collect_list(F.when(F.col("unit") == u, F.col("spans")))).alias(f"spans_{u}") for u in range(len(units))])


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Runs of bytes, none of which overlap or touch."""
    out: list[tuple[int, int]] = []
    if spans:
        pairs = np.array(spans, np.int64).reshape(-1, 2)
        a, z = pairs[np.argsort(pairs[:, 0], kind="stable")].T
        far = np.maximum.accumulate(z)
        head = np.flatnonzero(np.concatenate(([True], a[1:] > far[:-1])))
        out = list(zip(a[head].tolist(), far[np.concatenate((head[1:] - 1, [len(a) - 1]))].tolist(), strict=True))
    return out


def runs_of_text(d: bytes, unit: Unit, copies: int, spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal repeated runs of a text; of one with copies all that its strings cover."""
    if copies > 1:
        block = tb.Block([d])
        tok = Tokens(block, unit, block.prefix())
        spans = [int(tok.at[0]), int(tok.till[tok.hi[0] - 1])] if tok.hi[0] - tok.lo[0] >= unit.span else []
    return merged(spans)


def without(d: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(d)]
    return b"".join(d[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))


def _digested(batches):
    """By BYTES what is removed, by WORDS the passages."""
    for b in batches:
        out = []
        for d, copies, spans, passages in zip(tb.texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            runs = runs_of_text(d, BYTES, copies, spans)
            found = runs_of_text(d, WORDS, copies, passages)
            out.append((sum(z - a for a, z in runs), len(runs), hashlib.sha256(without(d, runs)).hexdigest(), len(found), sum(len(d[a:z].split()) for a, z in found)))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=["node", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words"])


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """For each row the id; by BYTES n_bytes, n_removed, n_spans and kept_sha256; by WORDS n_passages, the maximal
    repeated runs of 50 words or more, and n_passage_words, the words in them. Null and short texts have none.
    """
    texts, spans = repeated_spans(docs, text_col, units=(BYTES, WORDS), crowd=crowd)
    cut = texts.join(spans, "node", "left").select("node", "t", "copies", "spans_0", "spans_1")
    cut = cut.mapInArrow(_digested, "node binary, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, n_passage_words bigint")
    text = _text(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    rows = rows.join(cut.withColumnRenamed("node", "n2"), F.unhex(F.substring("sha", 1, 32)) == F.col("n2"), "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(F.col("id").alias(id_col), "n_bytes", none("n_removed"), none("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), none("n_passages"), none("n_passage_words"))


def _rewritten(units: Sequence[Unit]):
    def rows(batches):
        for b in batches:
            text = []
            spans = [b.column(f"spans_{u}").to_pylist() for u in range(len(units))]
            for i, (d, copies) in enumerate(zip(tb.texts(b.column("t")), b.column("copies").to_pylist(), strict=True)):
                runs = [r for u, unit in enumerate(units) for r in runs_of_text(d, unit, copies, spans[u][i])]
                text.append(without(d, merged([x for r in runs for x in r])).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(text, pa.string())], names=["node", "kept"])

    return rows


def remove_repeats(docs: DataFrame, *, text_col: str = "text", size_col: str | None = None, units: Sequence[Unit] = (BYTES,)) -> DataFrame:
    """All rows and columns, the text without strings of any of the units that repeat. Bytes of characters cut in two
    go too. size_col, if given, gets the characters left of texts that lost any.
    """
    texts, spans = repeated_spans(docs, text_col, units=units)
    changed = texts.join(spans, "node", "left").where("copies > 1 or spans_0 is not null")
    changed = changed.select("node", "t", "copies", *[f"spans_{u}" for u in range(len(units))]).mapInArrow(_rewritten(units), "node binary, kept string")
    node, other, kept = (free_name(docs.columns, c) for c in ("node_of_row", "node_of_text", "kept_text"))
    rows = docs.withColumn(node, _node(_text(text_col)))
    rows = rows.join(changed.select(F.col("node").alias(other), F.col("kept").alias(kept)), F.col(node) == F.col(other), "left")
    out = {text_col: F.coalesce(kept, F.col(f"`{text_col}`"))}
    if size_col:
        out[size_col] = F.when(F.col(kept).isNotNull(), F.length(kept).cast(docs.schema[size_col].dataType)).otherwise(F.col(f"`{size_col}`"))
    return rows.select(*[(out[c] if c in out else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def brute_runs(texts: list[bytes], unit: Unit) -> list[list[tuple[int, int]]]:
    """Maximal repeated runs of each text, the plain way; for tests."""
    import re
    from collections import Counter

    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+" if unit.words else rb"(?s:.)", t)] for t in texts]
    key = lambda t, p, i: tuple(t[a:z] for a, z in p[i : i + unit.span])
    count = Counter(key(t, p, i) for t, p in zip(texts, at, strict=True) for i in range(len(p) - unit.span + 1))
    return [merged([x for i in range(len(p) - unit.span + 1) if count[key(t, p, i)] > 1 for x in (p[i][0], p[i + unit.span - 1][1])]) for t, p in zip(texts, at, strict=True)]


def brute_force(texts: list[bytes]) -> list[tuple[int, int, int, str, int, int]]:
    """What digest() gives each text, the plain way; for tests."""
    out = []
    for t, runs, found in zip(texts, brute_runs(texts, BYTES), brute_runs(texts, WORDS), strict=True):
        out.append((len(t), sum(z - a for a, z in runs), len(runs), hashlib.sha256(without(t, runs)).hexdigest(), len(found), sum(len(t[a:z].split()) for a, z in found)))
    return out
