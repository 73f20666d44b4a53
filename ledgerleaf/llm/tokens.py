"""Word hashes of whole texts, vectorised over the buffers of Arrow batches.

Texts are taken in blocks of about ``BLOCK`` bytes (a longer text is a block of its own), so
memory follows the block and not the batch. A word's hash is made from its bytes, eight at a
time, each step a bijection that spreads every bit; words of up to eight bytes so have no
equal hash at all, and words beyond ``LONG`` bytes go through BLAKE2. Hashes of several
words are polynomials over these, read from prefix sums. Where equal hashes must mean equal
words, ``Block.digests`` reads the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
LONG = 64
_U = np.uint64
_BASES = {"words": 0xD6E8FEB86659FD93, "check": 0xA24BAED4963EE407}
_LANES = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and whatever lies beyond ASCII make words; all else separates.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
NOT_SPACE = ~SPACES


def powers(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of a base modulo 2**64, and of its inverse."""
    if name not in _powers or len(_powers[name][0]) < n:
        size, base = max(1 << 18, n), _BASES[name]
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            made.append(np.cumprod(p, dtype=_U))
        _powers[name] = (made[0], made[1])
    return _powers[name]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Sums:
    """Prefix sums that give the hash of any stretch of a sequence of hashes."""

    def __init__(self, values: np.ndarray, name: str):
        self.power, self.inverse = powers(name, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values.astype(_U) * self.power[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(_U))


class Stretches:
    """Hashes of stretches of bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        out = mix(mix(length.astype(_U)) ^ (self.lanes[start] & _LANES[np.minimum(length, 8)]))
        for at in range(8, LONG, 8):
            more = np.flatnonzero(length > at)
            if not len(more):
                return out
            out[more] = mix(out[more] ^ (self.lanes[start[more] + at] & _LANES[np.minimum(length[more] - at, 8)]))
        for i in np.flatnonzero(length > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]], digest_size=8).digest(), "little")
        return out


def hashes_of(words: list[bytes]) -> np.ndarray:
    """The hashes that blocks give these words."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends
    return Stretches(np.frombuffer(b"".join(words), np.uint8)).of(starts, ends)


class Block:
    """Consecutive texts: ``data`` their bytes, ``first`` their limits in it, ``rows`` their place in the batch."""

    def __init__(self, data: np.ndarray, first: np.ndarray, rows: range):
        self.data, self.first, self.rows = data, first, rows

    def words(self, inside: np.ndarray = NOT_SPACE) -> None:
        """Find the words: ``start``, ``end``, ``doc`` (the text each is in) and ``limit`` (the first word of each text)."""
        mask = inside[self.data]
        edge = np.empty(len(mask) + 1, bool)
        edge[1:-1] = mask[1:] != mask[:-1]
        edge[0], edge[-1] = (mask[0], mask[-1]) if len(mask) else (False, False)
        cut = self.first[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(mask))])
        joined = cut[mask[cut] & mask[cut - 1]]  # the last word of one text touches the first of the next
        at = np.flatnonzero(edge)
        if len(joined):
            at = np.sort(np.concatenate([at, joined, joined]))
        self.start, self.end = at[0::2], at[1::2]
        self.limit = np.searchsorted(self.start, self.first)
        self.doc = np.repeat(np.arange(len(self.rows)), np.diff(self.limit))

    def hashes(self) -> np.ndarray:
        self.bytes = Stretches(self.data)
        return self.bytes.of(self.start, self.end)

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """128 bits, as two columns, of the words from ``first`` up to ``last``, each with one space after it.

        BLAKE2 over the words' own bytes, so two stretches that agree read the same words.
        """
        length = self.end - self.start
        after = np.cumsum(length + 1)
        told = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
        shift = after - length - 1 - self.start
        source = np.arange(int(length.sum())) + np.repeat(self.start - np.cumsum(length) + length, length)
        told[source + np.repeat(shift, length)] = self.data[source]
        view, digest = memoryview(told), hashlib.blake2b
        a, z = (after - length - 1)[first].tolist(), after[last - 1].tolist()
        out = bytearray()
        for i, j in zip(a, z, strict=True):
            out += digest(view[i:j], digest_size=16).digest()
        return np.frombuffer(out, np.int64).reshape(-1, 2)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """The texts of an Arrow column in order; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    limits = np.frombuffer(offsets, np.int64, n + 1, 8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(limits, limits[at] + size, side="right")) - 1)
        yield Block(data[limits[at] : limits[to]], limits[at : to + 1] - limits[at], range(at, to))
        at = to


def segment_sum(values: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive limits, 0 for an empty stretch."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[limit[1:]] - sums[limit[:-1]]
