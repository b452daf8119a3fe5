"""Words and their hashes over many texts at once, as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; hashing folds A-Z to lower case.
Runs of any length are hashed by their 8-byte words (hash_runs()): each is mixed with a key of its
place, so runs of up to 8 bytes and one length never share a hash. Short windows that overlap, such as
grams and suffixes of at most some hundred bytes, are hashed from prefix sums (gram_hashes(),
run_hashes()), as polynomials modulo 2**64 over random byte values; such a polynomial is not fit for
long runs, for which equal hashes of unlike strings can be written down whatever the base.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(0x5EED)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
TAIL_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PLACE = (_rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)
STRETCH = 1 << 20
LENGTH_FACTOR = 0xD6E8FEB86659FD93
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, n + n // 8)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            np.multiply(out[:step], np.uint64(pow(base, done, 1 << 64)), out=out[done : done + step])
            done += step
        have = _powers[base] = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    return mix_own(x.copy())


def mix_own(x: np.ndarray) -> np.ndarray:
    """mix() of an array that nobody else needs: it is changed in place."""
    t = x >> np.uint64(33)
    x ^= t
    x *= np.uint64(0xFF51AFD7ED558CCD)
    np.right_shift(x, np.uint64(33), out=t)
    x ^= t
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    np.right_shift(x, np.uint64(33), out=t)
    x ^= t
    return x


def prefix_sums(data: np.ndarray, values: np.ndarray = FOLDED_VALUES) -> np.ndarray:
    """Prefix sums from which run_hashes() takes the hash of any byte run."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.take(values, data, out=sums[1:], mode="wrap")
    sums[1:] *= powers(BASE, len(data))
    np.cumsum(sums[1:], out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end), of a few hundred bytes at most."""
    h = sums[ends] - sums[starts]
    if len(starts):
        h *= powers(BASE_INVERSE, int(starts.max()) + 1)[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(LENGTH_FACTOR)
    return mix_own(h)


def gram_hashes(sums: np.ndarray, width: int, first: int, n: int) -> np.ndarray:
    """run_hashes() of the ``n`` runs of ``width`` bytes that start at ``first``, ``first`` + 1, ..."""
    h = sums[first + width : first + width + n] - sums[first : first + n]
    h *= powers(BASE_INVERSE, first + n)[first:]
    h += np.uint64(width * LENGTH_FACTOR & 0xFFFFFFFFFFFFFFFF)
    return mix_own(h)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (len+1 values)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs [start, end) (none empty) as little-endian 8-byte words, zeros after a run's end.

    Gives the words of all runs back to back, each word's place in its run and the index of each run's first word.
    """
    count = (ends - starts + 7) >> 3
    first = np.cumsum(count) - count
    place = ragged(np.zeros(len(count), np.int64), count)
    at = np.repeat(starts, count) + 8 * place
    padded = np.append(data, np.zeros(8, np.uint8))
    words = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))[at]
    words &= TAIL_MASKS[np.minimum(np.repeat(ends, count) - at, 8)]
    return words, place, first


def hash_words(words: np.ndarray, place: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs that run_words() gave, ``lengths`` bytes each."""
    if not len(first):
        return np.zeros(0, np.uint64)
    keyed = words ^ mix(place.astype(np.uint64) + np.uint64(BASE))
    h = np.add.reduceat(mix_own(keyed), first)
    h += lengths.astype(np.uint64) * np.uint64(LENGTH_FACTOR)
    return mix_own(h)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end), which may be long."""
    return hash_words(*run_words(data, starts, ends), ends - starts)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every case-folded word, and the index of each text's first word."""
    starts, ends, first = word_bounds(data, offsets)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # a stretch of bytes at a time, or one word
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + STRETCH, side="right")))
        out[at:to] = hash_runs(FOLD[data[low : int(ends[to - 1])]], starts[at:to] - low, ends[at:to] - low)
        at = to
    return out, first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For every text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    w, first = word_hashes(data, offsets)
    m = len(w) - width + 1
    if m > 0:
        s = w[:m] * PLACE[0]
        for i in range(1, width):
            s += w[i : i + m] * PLACE[i]
        s = mix_own(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(s[a : b - width + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            k = b - a
            one = (w[a:b] * PLACE[:k]).sum(keepdims=True, dtype=np.uint64)
            out.append(mix(one + np.uint64(k * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of all runs, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
