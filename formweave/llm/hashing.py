"""Vectorised hashing of words and word windows.

A batch of texts becomes one byte buffer.  Prefix sums of ``table[byte] * base**i``
modulo two primes give the hash of every word in O(1), and prefix sums over the word
hashes give the hash of every window of words, so the cost is a handful of numpy
passes and no Python loop over words.  The moduli of words are primes, since modulo a
power of two there are words (Thue-Morse sequences) that collide under any base; a window
is too short for them.

Words are ``[^\\x20\\x09-\\x0D]+`` throughout (the same set as ``bytes.split()``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_MASK = (1 << 64) - 1

#: Bytes of text hashed together; bounds the working memory of a batch.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    """``mix`` of one Python integer."""
    x &= _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 12)
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_WORD = _Powers(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def chunks(items: Iterable[tuple], limit: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Groups (key, bytes) pairs into lists of about ``limit`` bytes."""
    held, size = [], 0
    for item in items:
        held.append(item)
        size += len(item[1]) + 1
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Prime:
    """Values of bytes, and powers of a base and of its inverse modulo a prime below 2**31,
    grown on demand."""

    def __init__(self, prime: int, base: int, salt: int):
        self.prime, self.base, self.inverse = prime, base, pow(base, -1, prime)
        self.table = mix(np.arange(salt, salt + 256, dtype=U64)) % U64(prime - 1) + U64(1)
        self.lower = self.table.copy()
        self.lower[65:91] = self.table[97:123]
        self.up = self.down = np.empty(0, U64)

    def _grow(self, base: int, n: int) -> np.ndarray:
        out, step = np.ones(1, U64), base
        while len(out) < n:
            out, step = np.concatenate((out, out * U64(step) % U64(self.prime))), step * step % self.prime
        return out

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        n, prime = len(buf), U64(self.prime)
        if len(self.up) < n + 1:
            self.up, self.down = self._grow(self.base, n + 1), self._grow(self.inverse, n + 1)
        sums = np.zeros(n + 1, U64)
        # a sum of n values below 2**31 does not overflow
        np.cumsum((self.lower if lower else self.table)[buf] * self.up[:n] % prime, out=sums[1:])
        return (sums[ends] - sums[starts]) % prime * self.down[starts] % prime


# Two primes, bases and where the values of bytes come from.
_PRIMES = (_Prime((1 << 31) - 1, 1_263_482_647, 1), _Prime((1 << 31) - 19, 918_273_645, 1 << 20))
#: Bytes of text hashed at once; a longer text goes in stretches that end between words.
STRETCH = 1 << 20


def _hash_buffer(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer that ends with a space, and where they start."""
    space = _SPACE[buf]
    edge = np.diff(np.concatenate(([1], space.view(np.int8))))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    one, other = (p.words(buf, starts, ends, lower) for p in _PRIMES)
    return mix((one << U64(31)) + other + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D)), starts


def hash_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and offsets: the words of text i
    are ``hashes[offsets[i]:offsets[i + 1]]``.  ``lower`` folds A-Z.

    Besides its words' hashes a text needs the memory of a stretch, or of its longest word.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.empty(0, np.uint8)
    parts, at = [], 0
    while at < len(buf):
        end = min(at + STRETCH, len(buf))
        while not (gaps := np.flatnonzero(_SPACE[buf[max(at, end - (1 << 16)) : end]])).size:
            end = min(end + (1 << 16), len(buf))
        end = max(at, end - (1 << 16)) + int(gaps[-1]) + 1
        hashes, starts = _hash_buffer(buf[at:end], lower)
        parts.append((hashes, starts + at))
        at = end
    hashes, starts = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, U64), np.empty(0, np.int64))
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return hashes, offsets


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` consecutive words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    up, down = _WORD.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n] + U64(k))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; the whole sequence is the
    one shingle of a text with fewer words, and a text without words has none."""
    if not len(words):
        return np.empty(0, U64)
    return np.unique(window_hashes(words, min(k, len(words))))
