"""Vectorised hashes of words and byte strings for use inside tasks."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes that are hashed at once; longer runs are cut at white space.
BLOCK = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (constants of the public SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that seed fixes."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15)) | U64(1)


_BYTE = constants(256, 1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = int(constants(1, 2)[0])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    with np.errstate(over="ignore"):
        out[1:] = U64(base)
        return np.multiply.accumulate(out)


_UP = _powers(_BASE, BLOCK + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array: longest runs without space and the control characters 9 to 13."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of the byte ranges [starts, ends), which rise and do not overlap; fold: A-Z count as a-z.

    Prefix sums of a polynomial give the hash of any range in two look-ups. The sums run over blocks of BLOCK bytes, so
    memory does not follow the length of the data; a range longer than a block is hashed block by block.
    """
    table, out = _FOLDED if fold else _BYTE, np.zeros(len(starts), U64)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(starts):
            low = int(starts[done])
            n = int(np.searchsorted(ends, low + BLOCK, "right")) - done
            if n <= 0:
                h, at, end = U64(0), low, int(ends[done])
                while at < end:
                    part = table[data[at : min(end, at + BLOCK)]]
                    h = mix64((h ^ (part * _UP[: len(part)]).sum(dtype=U64)).reshape(1))[0]
                    at += BLOCK
                out[done] = h
                done += 1
                continue
            high = int(ends[done + n - 1])
            part = table[data[low:high]]
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(part * _UP[: len(part)], dtype=U64, out=sums[1:])
            a, b = starts[done : done + n] - low, ends[done : done + n] - low
            out[done : done + n] = (sums[b] - sums[a]) * _DOWN[a]
            done += n
        return mix64(out ^ ((ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)))


def word_hashes(data: bytes | np.ndarray, fold: bool) -> np.ndarray:
    array = data if isinstance(data, np.ndarray) else np.frombuffer(data, np.uint8)
    return range_hashes(array, *word_bounds(array), fold)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each width consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(constants(width, 3)):
            out += words[j : j + n] * c
        return mix64(out)


def shingles(text: str | np.ndarray | None, width: int = 5) -> np.ndarray:
    """The set of hashed shingles of a text, sorted: width words each, or one of all words if there are fewer."""
    words = word_hashes(text if isinstance(text, np.ndarray) else (text or "").encode(), fold=True)
    if not len(words):
        return words
    if len(words) < width:
        with np.errstate(over="ignore"):
            return mix64((words * constants(len(words), 4)).sum(dtype=U64).reshape(1) + U64(len(words)))
    return np.unique(window_hashes(words, width))
