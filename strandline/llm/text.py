"""Words, windows and fingerprints of whole Arrow text columns, as numpy arrays.

A word is a run of characters other than space and \\t \\n \\v \\f \\r.  Fingerprints are 64-bit
polynomial hashes read off prefix sums, so that every window of a text costs a few array operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Two independent sets of byte values and odd multipliers, for 64 or 128 bits.
_BYTES = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MASK = (1 << 64) - 1
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, inverse: bool = False, which: int = 0) -> np.ndarray:
    """The first n powers, mod 2**64, of a base or of its inverse."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, _U(base))
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[(which, inverse)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """values[k] * base**k summed up to each place, mod 2**64; one longer than values."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(len(values), which=which), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the spans [start, stop) of what prefix_sums() has summed."""
    if not len(start):
        return np.zeros(0, _U)
    return mix((sums[stop] - sums[start]) * powers(int(start.max()) + 1, True, which)[start] + (stop - start).astype(_U))


def byte_values(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _BYTES[which][data]


class Texts:
    """Some whole texts, one after another: data (bytes) and offsets (one more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def words(self, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words start and stop, and the first word of each text (one more than texts); between: which bytes part words."""
        inside = ~between[self.data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edge = self.offsets[:-1][self.offsets[:-1] < len(inside)]
            before[edge] = False
            after[edge[edge > 0] - 1] = False
        starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, stops, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, stops: np.ndarray, lower: bool = False, which: int = 0) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return spans(prefix_sums(byte_values(data, which), which), starts, stops, which)


def pieces(column: pa.Array | pa.ChunkedArray, most: int = 1 << 19) -> Iterator[tuple[int, Texts]]:
    """Runs of whole texts of about `most` bytes (a longer text stands alone), with the first row of each; null is empty."""
    row = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = pc.fill_null(part.cast(pa.large_string()), "")
        if not len(part):
            continue
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] else np.zeros(0, np.uint8)
        first = 0
        while first < len(part):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
            last = min(last, len(part))
            yield row + first, Texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last
        row += len(part)
    release()


#: Of glibc alone; elsewhere None.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give what Arrow and numpy have freed back to the system: workers live on between tasks, beside those at work."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def ngram_hashes(hashes: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside texts, and the word each starts at."""
    total = len(hashes)
    ok = np.zeros(total, bool)
    if total:
        room = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(total)
        ok = room >= n
    at = np.flatnonzero(ok)
    return spans(prefix_sums(hashes), at, at + n), at


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans [start, start + length)."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + length, n), minlength=n + 1)
    return np.cumsum(change[:n]) > 0
