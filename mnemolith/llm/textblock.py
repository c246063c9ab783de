"""Texts of an Arrow batch as one byte buffer: vectorised words, lines and substring hashes.

All word patterns used here are ASCII classes, so that splitting UTF-8 bytes splits code points
too: every byte of a non-ASCII character is 0x80 or more, and always inside a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_lower = np.arange(256)
_lower[65:91] += 32
#: A random number for each byte, and the same with A-Z as a-z.
BYTE_CASED, BYTE_LOWER = _BYTE, _BYTE[_lower]

_codes = np.arange(256)
#: Words of letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
#: Words between white space: [^\x20\x09-\x0D]+.
SPACED = (_codes != 32) & ((_codes < 9) | (_codes > 13))
#: bytes.translate table: A-Z to a-z, bytes of words as they are, all others to a space.
LOWER_WORDS = bytes(int(_lower[c]) if ALNUM[c] else 32 for c in range(256))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept by the process and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        done = 1
        while done < len(out):
            k = min(done, len(out) - done)
            out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
            done += k
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + length[0] - 1, start[1] .. and so on, in one array."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(total)


def prefix(values: np.ndarray) -> np.ndarray:
    """What Block.hashes() needs of a row of 64-bit numbers."""
    x = values.astype(np.uint64) * powers(_P_INV, len(values))
    pre = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=pre[1:])
    return pre


class Block:
    """Some texts, as bytes, in one buffer; a line feed follows each."""

    def __init__(self, docs: list[bytes]):
        self.docs = docs
        size = np.fromiter(map(len, docs), np.int64, len(docs))
        self.start = np.concatenate(([0], np.cumsum(size + 1)))[:-1] if len(docs) else np.zeros(0, np.int64)
        self.end = self.start + size
        self.buf = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes of a class; the closing line feed must be outside it."""
        m = inside[self.buf]
        flips = np.flatnonzero(m[1:] != m[:-1]) + 1
        if m[0]:
            flips = np.concatenate(([0], flips))
        return flips[::2], flips[1::2]

    def of(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the first and the past-the-last index into sorted places."""
        return np.searchsorted(starts, self.start), np.searchsorted(starts, self.end)

    def prefix(self, values: np.ndarray = BYTE_CASED) -> np.ndarray:
        """What hashes() needs of the buffer."""
        return prefix(values[self.buf])

    @staticmethod
    def hashes(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each substring, the same wherever it stands; its length counts too."""
        return mix((pre[end] - pre[start]) * powers(_P, len(pre))[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def code_points(self) -> np.ndarray:
        """Number of characters before each byte, and before the end."""
        return np.concatenate(([0], np.cumsum((self.buf & 0xC0) != 0x80)))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours; the result has n - 1 entries less."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[k : k + m]
    return mix(out)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; nothing for a null."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def blocks(docs: list[bytes], limit: int = 1 << 19) -> Iterator[tuple[int, Block]]:
    """The texts in their order, some at a time: at most `limit` bytes, or one text. With the first's index."""
    at, size = 0, 0
    for i, d in enumerate(docs):
        if i > at and size + len(d) > limit:
            yield at, Block(docs[at:i])
            at, size = i, 0
        size += len(d) + 1
    if at < len(docs):
        yield at, Block(docs[at:])


def per_text(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of values[lo:hi] for each text."""
    c = np.concatenate(([0], np.cumsum(values)))
    return c[hi] - c[lo]
