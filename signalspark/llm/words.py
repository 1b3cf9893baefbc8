"""Words and word shingles of whole Arrow batches as numpy arrays.

Texts of a batch lie one after the other in one buffer, so words, hashes and
shingles are array operations over pieces of about a megabyte of text (a longer
text is a piece of its own). Words are runs of bytes other than space and
``\\t``-``\\r``; they never cross texts. Hashes are 64 bits and the same everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
INVERSE = pow(ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit image of each number (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * PIECE_BYTES:
            _powers[base] = have
    return have


#: Primes below 2**31 and a base for each. A polynomial modulo 2**64 would give one hash to long
#: texts of two letters that follow certain patterns; modulo primes no short pattern does.
FIELDS = ((2147483647, 1299721033), (2147483629, 1687093547))
_prime_powers: dict[tuple[int, int], np.ndarray] = {}


def prime_powers(prime: int, base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo ``prime`` for i below n at least."""
    have = _prime_powers.get((prime, base))
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        have = np.ones(1, np.uint64)
        while len(have) < size:
            step = np.uint64(pow(base, len(have), prime))
            have = np.concatenate([have, have * step % np.uint64(prime)])
        if size <= 4 * PIECE_BYTES:
            _prime_powers[prime, base] = have
    return have


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range, of two polynomials modulo primes and the length."""
    n = len(data)
    out = (end - start).astype(np.uint64) * np.uint64(ODD)
    for shift, (prime, base) in zip((0, 31), FIELDS):
        p = np.uint64(prime)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((BYTE_CODES % p)[data] * prime_powers(prime, base, n)[:n] % p, out=sums[1:])
        back = prime_powers(prime, pow(base, -1, prime), n + 1)[start]
        out += ((sums[end] - sums[start]) % p * back % p) << np.uint64(shift)
    return mix(out)


@dataclass
class Piece:
    """Some texts of a batch: ``rows`` are their row numbers, text i is data[bounds[i]:bounds[i+1]]."""

    first_row: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Texts of an Arrow string or binary column in pieces; null is the empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield Piece(row, raw[bounds[row]:bounds[end]], bounds[row:end + 1] - bounds[row])
        row = end


@dataclass
class Words:
    """Words of a piece in order: start and end byte, text number, hash."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray


def words_of(piece: Piece) -> Words:
    data, bounds = piece.data, piece.bounds
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64))
    inside = ~SPACE[data]
    after_gap = np.empty(n, bool)
    after_gap[0] = True
    np.logical_not(inside[:-1], out=after_gap[1:])
    firsts = bounds[:-1]
    after_gap[firsts[firsts < n]] = True
    start = np.flatnonzero(inside & after_gap)
    before_gap = np.empty(n, bool)
    before_gap[-1] = True
    np.logical_not(inside[1:], out=before_gap[:-1])
    lasts = bounds[1:]
    before_gap[lasts[lasts > 0] - 1] = True
    end = np.flatnonzero(inside & before_gap) + 1
    return Words(start, end, np.searchsorted(bounds, start, "right") - 1, range_hashes(data, start, end))


@dataclass
class Shingles:
    """Shingles in order: the word that each begins with, its text, its hash."""

    word: np.ndarray
    text: np.ndarray
    hash: np.ndarray


def shingles_of(words: Words, k: int = 5, short: bool = True) -> Shingles:
    """Runs of ``k`` words. With ``short``, a text of 1 to k-1 words is one shingle."""
    n = len(words.hash)
    if n >= k:
        value = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            value = value * np.uint64(ODD) + words.hash[j:n - k + 1 + j]
        whole = np.flatnonzero(words.text[:n - k + 1] == words.text[k - 1:])
        word, hashes = whole, mix(value[whole])
    else:
        word, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if short and n:
        text, first, count = np.unique(words.text, return_index=True, return_counts=True)
        few = count < k
        if few.any():
            extra = []
            for f, c in zip(first[few], count[few], strict=True):
                v = np.uint64(c)
                for j in range(c):
                    v = np.uint64((int(v) * ODD + int(words.hash[f + j])) & MASK)
                extra.append(v)
            word = np.concatenate([word, first[few]])
            hashes = np.concatenate([hashes, mix(np.array(extra, np.uint64))])
            order = np.argsort(word, kind="stable")
            word, hashes = word[order], hashes[order]
    return Shingles(word, words.text[word], hashes)


def text_starts(text: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each text begin in a sorted array of text numbers; n+1 bounds."""
    return np.searchsorted(text, np.arange(n + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
