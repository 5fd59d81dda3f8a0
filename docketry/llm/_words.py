"""Word and shingle hashes of whole texts, from the bytes of Arrow string columns.

Everything here runs inside tasks on one Arrow batch at a time. A batch is cut into slices of about
``SLICE`` bytes of text; one longer text is a slice of its own and is never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
MASK = (1 << 64) - 1


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


BYTE = _random(256, 7)
STEP = 0x9E3779B97F4A7C15 | 1
UNSTEP = pow(STEP, -1, 1 << 64)
PLACE = _random(16, 11)


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower()
#: Words are runs of 0-9, a-z and all non-ASCII characters.
ALNUM = np.array([b >= 128 or 48 <= b < 58 or 97 <= b < 123 for b in range(256)])
#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
SPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int, cache: dict) -> np.ndarray:
    have = cache.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        cache[base] = have = np.multiply.accumulate(out)
    return have[:n]


class Words:
    """Words of a slice of texts: ``hashes`` of all words, ``first[d] : first[d + 1]`` those of text d.

    ``starts`` and ``ends`` are byte positions within the slice, ``at[d]`` where text d begins.
    """

    def __init__(self, column: pa.Array, kind: np.ndarray, cache: dict, fold: bool = True):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.bytes = LOWER[raw[at[0] : at[-1]]] if fold else raw[at[0] : at[-1]]
        self.at = at = at - at[0]
        inside = kind[self.bytes]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edge = at[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            before[edge] = False
            after[edge - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, at)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[self.bytes] * powers(n, STEP, cache), out=total[1:])
        size = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mix((total[self.ends] - total[self.starts]) * powers(n + 1, UNSTEP, cache)[self.starts] + size)


def joined(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; of the whole sequence where it is shorter; of none, none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = words[: n - k + 1] * PLACE[0]
    for j in range(1, k):
        out = out + words[j : n - k + 1 + j] * PLACE[j]
    return mix(out + np.uint64(k))


def sliced(batches, column: str = "text", size: int = SLICE):
    """Slices of the batches with about ``size`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(own) - own) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
