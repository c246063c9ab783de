"""Token ids as files of range asymmetric numeral systems, with one table of frequencies for all.

The tokenizers library encodes whole texts; each text ends with `end` of its own. Texts are cut where
pre-tokens end whatever stands around (before most spaces, between letters, digits and signs); what
the library's model gives for such a stretch is kept by the process. New stretches go to the model
many at a time, with byte 0xFF between, which it merges with nothing; stretches with an added token
go through the library as they are. Ids are counted over all texts and scaled to a table of sum
2^PRECISION in which every id that occurs has at least one slot; its size is that of the vocabulary.
Rows are sorted by id over the cluster and cut into blocks of BLOCK ids, whatever texts these belong to.

A block is independent of all others. It is coded by LANES states that take turns (id i belongs to
lane i mod LANES), each of 64 bits, which share one stream of 32-bit words; `EVERY` ids apart the
states and the place in the stream are kept as a checkpoint, so that any stretch can be decoded by
itself, and all stretches of some blocks are decoded at the same time. Payloads are

    magic 'RNS1', ids, lanes, every, words, crc32 of the ids, crc32 of what follows (each of 32 bits, little-endian),
    checkpoints of (place: 32 bits; lanes x 64 bits), the stream.

Blocks are rows of Parquet files, so that a job commits whole files on any store that Spark writes:
part (a file of ascending ids), block, first (ids of the part before it), payload, and for the
texts in it (id, row number, ids of the part before the text, ids of the text in this block, piece).
The table of frequencies lies beside them. `read` checks both sums of each block.

Null texts count as empty and give `end` alone. Null ids come first; rows with the same id follow
each other, ordered by their ids' digest, and each has a place of its own. A very long text goes on
over several blocks, and its sum is combined from theirs. A text of more ids than a block costs no
more memory than its row. An empty table gives no blocks. Other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, free_name
from .pretoken import PATTERN
from .textblock import ranges, texts
from .token_counts import byte_letters

PRECISION, LANES, EVERY, BLOCK = 20, 32, 1 << 14, 1 << 16
MAGIC = int.from_bytes(b"RNS1", "little")
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)

# Ids of texts.


#: 1, 2, 3 for letters, digits and other signs of ASCII; 0 for the rest.
_KIND = np.array([0 if c < 33 or c > 126 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)


def cuts(buf: np.ndarray) -> np.ndarray:
    """Places, in order, before which texts may be cut: no pre-token reaches over one, and none depends on what stands beyond.

    They are spaces that something other than white space follows; changes between letters, digits
    and other signs (unless an apostrophe and a letter meet, as these may belong together); both
    sides of a line feed that stands alone. Some where rare characters stand are left out. 0xFF
    stands between texts.
    """
    padded = np.concatenate((np.zeros(2, np.uint8), buf, np.zeros(3, np.uint8)))
    at = np.flatnonzero(buf == 32)
    one, two, three = padded[at + 3], padded[at + 4], padded[at + 5]
    ascii_ = (one > 32) & (one < 127)
    latin = (one == 0xC2) & (two != 0x85) & (two != 0xA0)
    marks = (one == 0xE2) & (((two == 0x80) & (three >= 0x90) & (three <= 0xA7)) | (two >= 0x82))
    spaces = at[ascii_ | latin | marks | ((one == 0xE3) & (two > 0x80)) | ((one >= 0xC3) & (one < 0xF5) & (one != 0xE1) & (one != 0xE2) & (one != 0xE3))]
    here = np.zeros(len(buf) + 1, bool)
    here[spaces] = True
    kind = _KIND[buf]
    left, right = kind[:-1], kind[1:]
    here[1:-1] |= (left != right) & (left > 0) & (right > 0) & ((buf[:-1] != 39) | (right != 1))
    at = np.flatnonzero(kind == 3)  # after letters from U+00C0 to U+00FF
    one, two = padded[at + 1], padded[at]
    here[at] |= (two == 0xC3) & (one >= 0x80) & (one <= 0xBF) & (one != 0x97) & (one != 0xB7)
    at = np.flatnonzero(buf == 10)
    at = at[_KIND[padded[at + 1]] > 0]
    here[at] = True
    here[at + 1] |= _KIND[padded[at + 3]] > 0
    return np.flatnonzero(here[:-1])


class Stretches(dict):
    """Numbers for stretches, in order of appearance; those that came since they were last taken."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, stretch: bytes) -> int:
        self[stretch] = n = len(self)
        self.new.append(stretch)
        return n

    def taken(self) -> list[bytes]:
        new, self.new = self.new, []
        return new


class Rows:
    """Numbers of variable count for each row; more rows are put behind, the arrays grow by doubling."""

    def __init__(self, kind: np.dtype):
        self.n, self.edge, self.flat = 0, np.zeros(1 << 10, np.int64), np.zeros(1 << 10, kind)

    def put(self, length: np.ndarray, flat: np.ndarray) -> None:
        n, size = self.n + len(length), int(self.edge[self.n]) + len(flat)
        if n >= len(self.edge):
            self.edge = np.concatenate((self.edge, np.zeros(max(len(self.edge), n), np.int64)))
        if size > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), size), self.flat.dtype)))
        self.flat[size - len(flat) : size] = flat
        self.edge[self.n + 1 : n + 1] = self.edge[self.n] + np.cumsum(length)
        self.n = n

    def get(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many numbers some rows have, and all of them."""
        start = self.edge[row]
        length = self.edge[row + 1] - start
        return length, self.flat[ranges(start, length)]


class Encoder:
    """The library's ids of texts. Stretches are known by their bytes, a space before them included, until there are `limit` of them."""

    def __init__(self, path: str, limit: int = 400_000, end: int = 0):
        from tokenizers import Tokenizer

        self.library, self.limit = Tokenizer.from_file(path), limit
        letters = byte_letters()
        self.letters = np.array([ord(c) for c in letters], "<u4")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(re.escape(a.encode()) for a in sorted(self.added, key=len, reverse=True))) if self.added else None
        vocabulary, model = self.library.get_vocab(with_added_tokens=False), self.library.model
        #: The id of byte 0xFF, which stands in no text, if the model merges it with nothing: pre-tokens between such bytes are merged each for itself.
        self.between = vocabulary.get(letters[255])
        if any(letters[255] in t for t in vocabulary if t != letters[255]) or model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix:
            self.between = None
        #: Ids are kept in 16 bits where all fit, else in 32.
        self.kind = np.dtype("<u2" if max(self.library.get_vocab_size() - 1, end) < 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        self.known = Stretches()
        self.ids = Rows(self.kind)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids pre-tokens have, and all of them in a row, by the library's model."""
        length, flat = [np.zeros(0, np.int64)], [np.zeros(0, self.kind)]
        for some in itertools.batched(words, 1 if self.between is None else 512):
            found = self.library.model.tokenize(self.letters[np.frombuffer(b"\xff".join(some), np.uint8)].tobytes().decode("utf-32-le"))
            ids = np.fromiter(map(attrgetter("id"), found), self.kind, len(found))
            if len(some) > 1:
                between = ids == self.between
                length.append(np.diff(np.flatnonzero(between), prepend=-1, append=len(ids)) - 1)
                ids = ids[~between]
            else:
                length.append(np.array([len(ids)]))
            flat.append(ids)
        return np.concatenate(length), np.concatenate(flat)

    def learn(self, new: list[bytes]) -> None:
        """Ids of new stretches."""
        words: list[bytes] = []
        size = [1] * len(new)
        special = []
        for i, raw in enumerate(new):
            bare = raw[1:] if raw[:1] == b" " else raw
            if bare.isalpha() or (s := bare.decode()).isalpha():  # one pre-token, with its space
                words.append(raw)
            elif self.special and self.special.search(raw):
                special.append(i)
                size[i] = 0
            else:
                tokens = PATTERN.findall(raw.decode())
                words += [t.encode() for t in tokens]
                size[i] = len(tokens)
        length, flat = self.merged(words)
        length = np.bincount(np.repeat(np.arange(len(new)), size), length, len(new)).astype(np.int64)
        if special:
            rows = np.split(flat, np.cumsum(length)[:-1])
            for i in special:
                rows[i] = np.array(self.library.encode(new[i].decode(), add_special_tokens=False).ids, self.kind)
            length, flat = np.array([len(r) for r in rows]), np.concatenate(rows)
        self.ids.put(length, flat)

    def stretches(self, docs: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The texts' stretches, one text after the other, and how many each has (some may be empty)."""
        raw = b"\xff".join(docs)
        if raw.count(b"\xff") != len(docs) - 1:
            raise ValueError("a text is not UTF-8")
        buf = np.frombuffer(raw, np.uint8)
        at = cuts(buf)
        if self.special:  # what stands around such a token is cut off by the library
            found = [m.span() for m in self.special.finditer(raw)]
            if found:
                first, last = np.array(found).T
                at = at[np.searchsorted(first - 1, at, "right") == np.searchsorted(last, at, "right")]
        size = np.fromiter(map(len, docs), np.int64, len(docs))
        start = np.cumsum(size + 1) - size - 1
        n = 1 + np.searchsorted(at, start + size) - np.searchsorted(at, start)
        out = np.full(len(buf) + len(at), 0xFF, np.uint8)
        inside = np.ones(len(out), bool)
        inside[at + np.arange(len(at))] = False
        out[inside] = buf
        return out.tobytes().split(b"\xff"), n

    def encode(self, docs: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8)."""
        if not docs:
            return []
        if len(self.known) > self.limit:
            self.clear()
        parts, n = self.stretches(docs)
        row = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        del parts
        if self.known.new:
            self.learn(self.known.taken())
        length, flat = self.ids.get(row)
        before = np.concatenate(([0], np.cumsum(length)))
        edge = before[np.concatenate(([0], np.cumsum(n)))].tolist()
        return [flat[a:b] for a, b in itertools.pairwise(edge)]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """The process's encoder for a vocabulary file, read once. The file must be at this path on every executor."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end=end)
    return _encoders[path, end]


def _slices(batch: pa.RecordBatch, column: int, limit: int):
    """Rows of a batch, some at a time: at most `limit` bytes of text or ids, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, n = 0, 0
    for i, x in enumerate(size):
        if i > at and n + x > limit:
            yield batch.slice(at, i - at)
            at, n = i, 0
        n += x
    if at < len(size):
        yield batch.slice(at)


def encoded(docs: DataFrame, path: str, end: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, a digest of the ids, a row number and the ids (little-endian, of the encoder's width), with `end` behind."""
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}[id_col]

    def run(batches):
        e = encoder(path, end)
        last = end.to_bytes(e.kind.itemsize, "little")
        for whole in batches:
            for b in _slices(whole, 1, 1 << 21):
                found = [x.tobytes() + last for x in e.encode(texts(b.column(1)))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, ids binary")
    return rows.select("id", F.xxhash64("ids").alias("digest"), F.monotonically_increasing_id().alias("row"), "ids")


# Frequencies.


def frequencies(counts: dict[int, int], precision: int = PRECISION) -> np.ndarray:
    """Slots of each id: in proportion to its count, at least one if it occurs, 2^precision in all."""
    out = np.zeros(max(counts, default=0) + 1, np.int64)
    if not counts:
        return out
    if len(counts) > 1 << precision:
        raise ValueError(f"{len(counts)} different ids need more than 2^{precision} slots")
    ids = np.array(sorted(counts))
    n = np.array([counts[i] for i in ids], float)
    slots = np.maximum(1, np.floor(n / n.sum() * (1 << precision))).astype(np.int64)
    left = (1 << precision) - int(slots.sum())
    by = np.argsort(-n, kind="stable")
    if left >= 0:
        slots[by[0]] += left
    else:
        for i in by:  # the most frequent give what the rare ones took
            take = min(-left, int(slots[i]) - 1)
            slots[i] -= take
            left += take
            if not left:
                break
    out[ids] = slots
    return out


def count_ids(rows: DataFrame, width: int) -> dict[int, int]:
    """How often each id occurs: one row for each id of the vocabulary and task is shuffled, one for each id reaches the driver."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for whole in batches:
            for b in _slices(whole, 0, 1 << 22):
                n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), f"<u{width}"))
                if len(n) > len(total):
                    total = np.concatenate((total, np.zeros(len(n) - len(total), np.int64)))
                total[: len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["token", "n"])

    counted = rows.select("ids").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in counted.toLocalIterator()}


class Model:
    """Slots of the ids, where they begin, and the id of each slot."""

    def __init__(self, slots: np.ndarray, precision: int = PRECISION):
        self.precision = np.uint64(precision)
        self.slots = slots.astype(np.uint64)
        self.begin = (np.cumsum(slots) - slots).astype(np.uint64)
        self.id_of = np.repeat(np.arange(len(slots), dtype=np.uint32), slots)
        self.mask = np.uint64((1 << precision) - 1)


_models: dict[bytes, Model] = {}


def model(slots: bytes) -> Model:
    """The process's model for a table of 32-bit slots."""
    if slots not in _models:
        _models.clear()
        _models[slots] = Model(np.frombuffer(slots, np.uint32).astype(np.int64))
    return _models[slots]


# Blocks.


def pack(blocks: list[np.ndarray], m: Model, lanes: int = LANES, every: int = EVERY) -> list[bytes]:
    """Payloads of some blocks, coded side by side from their last ids to their first."""
    if not blocks:
        return []
    n = np.array([len(b) for b in blocks])
    steps = -(-int(n.max()) // lanes)
    ids = np.zeros((len(blocks), steps * lanes), np.uint32)
    for row, b in zip(ids, blocks, strict=True):
        row[: len(b)] = b
    ids = np.ascontiguousarray(ids.reshape(len(blocks), steps, lanes).transpose(1, 0, 2))
    x = np.full((len(blocks), lanes), _LOW)
    lane = np.arange(lanes)[None, :]
    owners, words, points = [], [], []
    written = np.zeros(len(blocks), np.int64)
    limit = np.uint64(63) - m.precision
    whole = int(n.min()) // lanes  # before this step no block ends
    for t in range(steps - 1, -1, -1):
        token = ids[t]
        f, begin = m.slots[token], m.begin[token]
        full = x >= (f << limit)
        if t >= whole:
            inside = t * lanes + lane < n[:, None]
            full &= inside
        count = full.sum(1)
        owners.append(np.repeat(np.arange(len(blocks)), count))
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        written += count
        y = np.where(full, x >> _WORD, x)
        q = y // np.maximum(f, np.uint64(1))
        y = (q << m.precision) + (y - q * f) + begin
        x = np.where(inside, y, x) if t >= whole else y
        if t * lanes % every == 0:
            points.append((written.copy(), x))
    owner, stream = np.concatenate(owners[::-1]), np.concatenate(words[::-1])
    stream = stream[np.argsort(owner, kind="stable")].astype("<u4")
    ends = np.cumsum(written)
    out = []
    for i, b in enumerate(blocks):
        own = stream[ends[i] - written[i] : ends[i]]
        table = b"".join(np.uint32(written[i] - place[i]).tobytes() + state[i].astype("<u8").tobytes() for place, state in points[::-1][: -(-len(b) // every)])
        body = table + own.tobytes()
        head = np.array([MAGIC, len(b), lanes, every, len(own), zlib.crc32(b.astype("<u4").tobytes()), zlib.crc32(body)], "<u4")
        out.append(head.tobytes() + body)
    return out


def unpack(payloads: list[bytes], m: Model) -> list[np.ndarray]:
    """The ids of some blocks; every stretch from a checkpoint to the next is decoded at the same time. ValueError if a sum is wrong."""
    heads = []
    for p in payloads:
        h = np.frombuffer(p[:28], "<u4").astype(np.int64)
        if len(h) < 7 or h[0] != MAGIC or zlib.crc32(memoryview(p)[28:]) != h[6]:
            raise ValueError("a block is damaged")
        heads.append(h)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(payloads)
    kinds = {(int(h[2]), int(h[3])) for h in heads}
    for lanes, every in kinds:
        which = [i for i, h in enumerate(heads) if (h[2], h[3]) == (lanes, every)]
        states, place, size, streams, base = [], [], [], [], 0
        for i in which:
            _, n, _, _, w, _, _ = heads[i]
            points = -(-int(n) // every)
            table = np.frombuffer(payloads[i], np.uint8, points * (4 + 8 * lanes), 28).reshape(points, -1)
            place.append(base + np.ascontiguousarray(table[:, :4]).view("<u4")[:, 0].astype(np.int64))
            states.append(np.ascontiguousarray(table[:, 4:]).view("<u8"))
            size.append(np.minimum(every, int(n) - every * np.arange(points)))
            streams.append(np.frombuffer(payloads[i], "<u4", int(w), 28 + table.size))
            base += int(w)
        x, at, n = np.concatenate(states).astype(np.uint64), np.concatenate(place), np.concatenate(size)
        stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
        ids = np.zeros((len(n), every), np.uint32)
        for t in range(every // lanes):
            inside = (t * lanes + np.arange(lanes))[None, :] < n[:, None]
            if not inside.any():
                break
            slot = x & m.mask
            token = m.id_of[slot]
            ids[:, t * lanes : (t + 1) * lanes] = token
            x = np.where(inside, m.slots[token] * (x >> m.precision) + slot - m.begin[token], x)
            low = inside & (x < _LOW)
            if low.any():
                order = np.cumsum(low, 1)
                from_ = np.where(low, at[:, None] + order - 1, 0)
                x = np.where(low, (x << _WORD) | stream[from_], x)
                at = at + order[:, -1]
        first = 0
        for i, s in zip(which, size, strict=True):
            got = ids[first : first + len(s)].reshape(-1)[: int(heads[i][1])]
            if zlib.crc32(got.astype("<u4").tobytes()) != heads[i][5]:
                raise ValueError("a block's ids are not those that were written")
            out[i] = got
            first += len(s)
    return out


# Files.

_TEXTS = "array<struct<id: {kind}, row: bigint, start: bigint, n: bigint, piece: int, pieces: int>>"


def write(spark: SparkSession, rows: DataFrame, path: str, width: int, block: int = BLOCK, together: int = 64) -> None:
    """Files of `rows` (of encoded(), stored) under path: blocks and frequencies."""
    kind = dict(rows.dtypes)["id"]
    slots = frequencies(count_ids(rows, width)).astype(np.uint32).tobytes()
    spark.createDataFrame([(PRECISION, slots)], "precision int, slots binary").coalesce(1).write.parquet(f"{path}/frequencies")

    def run(batches):
        m, part = model(slots), TaskContext.get().partitionId()
        waiting: list[tuple[np.ndarray, int, list]] = []
        number, first, start = 0, 0, 0
        ids, texts, size = [], [], 0

        def close():
            nonlocal ids, texts, size, first
            waiting.append((np.concatenate(ids), first, texts))
            first, ids, texts, size = first + size, [], [], 0

        def flush():
            nonlocal number
            made = pack([w[0] for w in waiting], m)
            columns = [[part] * len(made), list(range(number, number + len(made))), [w[1] for w in waiting], [len(w[0]) for w in waiting], made, [w[2] for w in waiting]]
            number += len(made)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "block", "first", "n_ids", "payload", "texts"])

        types = None
        for b in batches:
            if types is None:
                item = pa.struct([("id", b.schema.field(0).type), ("row", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32())])
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(item)]
            for id_, row, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = np.frombuffer(x.as_buffer(), f"<u{width}").astype(np.uint32)
                pieces = 1 + max(0, -(-(len(x) - (block - size)) // block))
                at = 0
                for piece in range(pieces):
                    part_ = x[at : at + block - size]
                    texts.append({"id": id_, "row": row, "start": start, "n": len(part_), "piece": piece, "pieces": pieces})
                    ids.append(part_)
                    size += len(part_)
                    at += len(part_)
                    if size == block:
                        close()
                        if len(waiting) == together:
                            yield flush()
                start += len(x)
        if size:
            close()
        if waiting:
            yield flush()

    ordered = rows.repartitionByRange("id", "digest", "row").sortWithinPartitions("id", "digest", "row").select("id", "row", "ids")
    ordered.mapInArrow(run, f"part int, block int, first bigint, n_ids bigint, payload binary, texts {_TEXTS.format(kind=kind)}").write.parquet(f"{path}/blocks")


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for i in range(32):
        if v >> i & 1:
            out ^= matrix[i]
    return out


@functools.cache
def _shifts() -> list[list[int]]:
    """Matrices over one bit that append 2^k zero bytes to a crc32 (each column as a 32-bit number)."""
    one = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    square = lambda m: [_times(m, c) for c in m]
    for _ in range(3):
        one = square(one)
    out = [one]
    for _ in range(40):
        out.append(square(out[-1]))
    return out


def combined(sums: list[tuple[int, int]]) -> int:
    """crc32 of parts put together, from (crc32, bytes) of each."""
    whole, matrices = 0, _shifts() if len(sums) > 1 else []
    for crc, n in sums:
        k = 0
        while whole and n >> k:
            if n >> k & 1:
                whole = _times(matrices[k], whole)
            k += 1
        whole ^= crc
    return whole


def read(spark: SparkSession, path: str, as_ids: bool = False, together: int = 64) -> DataFrame:
    """What the files hold, a row for each text: id, start (ids before it in all files), n_tokens, ids_crc32.

    as_ids: the pieces of texts instead (id, row, part, first, piece, ids as bytes), block by block.
    """
    slots = bytes(spark.read.parquet(f"{path}/frequencies").first().slots)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["texts"].dataType.elementType["id"].dataType.simpleString()

    def run(batches):
        m = model(slots)
        for whole in batches:
            for b in _slices(whole, 1, together << 17):
                decoded = unpack(b.column(1).to_pylist(), m)
                held = b.column(2)
                at = held.flatten()
                n, owner = at.field("n").to_pylist(), pc.list_parent_indices(held).to_pylist()
                values, place, last = [], 0, -1
                for length, k in zip(n, owner, strict=True):
                    if k != last:
                        place, last = 0, k
                    got = decoded[k][place : place + length].astype("<u4").tobytes()
                    values.append(got if as_ids else zlib.crc32(got))
                    place += length
                parts = b.column(0).take(pc.list_parent_indices(held))
                yield pa.RecordBatch.from_arrays([parts, *(at.field(c) for c in ("id", "row", "start", "n", "piece", "pieces")), pa.array(values, pa.binary() if as_ids else pa.int64())], names=["part", "id", "row", "start", "n", "piece", "pieces", "value"])

    pieces = blocks.select("part", "payload", "texts").mapInArrow(run, f"part int, id {kind}, row bigint, start bigint, n bigint, piece int, pieces int, value {'binary' if as_ids else 'bigint'}")
    if as_ids:
        return pieces
    pieces = Stored(spark).write(pieces)  # decoded once, read twice
    # One row for each file: how many ids the files before it have.
    sizes = blocks.groupBy("part").agg(F.max(F.col("first") + F.col("n_ids")).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    combine = F.udf(lambda parts: combined([(p.value, 4 * p.n) for p in parts]), "bigint")
    one = pieces.where("pieces = 1").select("id", "part", "start", "n", F.col("value").alias("crc"))
    # Pieces of a text are few: one for each block of ids. Only those of texts over a block's edge are shuffled.
    some = pieces.where("pieces > 1").groupBy("part", "row").agg(F.first("id").alias("id"), F.first("start").alias("start"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("piece", "n", "value"))).alias("parts"))
    some = some.select("id", "part", "start", "n", combine("parts").alias("crc"))
    all_ = one.unionByName(some).join(before, "part")
    return all_.select("id", (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def write_tokens(docs: DataFrame, vocabulary: str, path: str, *, end: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Encodes the texts and writes their files under path; read() gives them back."""
    store = Stored(docs.sparkSession)
    width = encoder(vocabulary, end).kind.itemsize
    rows = store.write(encoded(docs, vocabulary, end, id_col=id_col, text_col=text_col))
    write(docs.sparkSession, rows, path, width, block)
    store.drop(rows)


def digest(docs: DataFrame, vocabulary: str, *, end: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The files of the texts, written to the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{Stored(spark).folder}/ids"
    write_tokens(docs, vocabulary, path, end=end, id_col=id_col, text_col=text_col, block=block)
    out = read(spark, path)
    return out.withColumnRenamed("id", free_name(["start", "n_tokens", "ids_crc32"], id_col))
