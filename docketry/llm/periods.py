"""Periodic run detection: stretches of a text whose words repeat with a period at least three times.

A run is a stretch of consecutive words with smallest period q and a length of at least ``max(24, 3 * q)`` that no
neighbouring word extends. They are found by block convolution at dyadic scales:

1. A run of period q holds at least ``max(16, 2 * q)`` neighbouring words that come back q words later. So at the scale of
   blocks of B = 8, 16, 32 ... words, every run with a period of up to 16 (B = 8) or in ``(B, 2 * B]`` holds a whole
   block that occurs again q words later, and the words that follow within 2 B are a window that must show it.
2. Words get small codes, and the sum of squared differences of a block and each place of its window comes from an exact
   integer number-theoretic transform: it is zero where the codes agree, and only there, as no sum reaches the modulus.
   Blocks of a scale are transformed side by side. A block with a word that does not come back within the window
   has no occurrence there and is not transformed.
3. Each distance is a seed. Seeds of one distance in neighbouring blocks are one stretch; it is checked word by word and
   extended to both sides until the words differ. Seeds inside a run of a smaller period show multiples of it and are
   dropped, so a text of one repeated word costs no more than others.

Of runs on one stretch the smallest period counts. Everything is exact: words are compared by numbers given to them text by text.

The work on a text grows with its length times the logarithm of it, and its memory with its length. Nothing is shuffled: texts stay where they
lie, and equal texts or a hot source make no difference. Words are what stands between ASCII white space, as they are
written. Null, empty and white texts have no words and no runs; a row with a null ``doc_id`` is treated like any other, and keeps its text.
Rows that repeat an id keep a row each; other columns are left behind, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm._shared import texts
from docketry.llm._words import sliced

#: A run has at least so many words and so many periods.
LEAST, TIMES = 24, 3
#: Words of a block at the lowest scale.
BASE = 8
#: A prime with 2**23 as a factor of P - 1, and a generator.
P, GENERATOR = 998244353, 3
#: Words of a block that are transformed at most. Of longer blocks the first words stand for all, and their window is cut.
MOST = 1 << 20
#: Numbers that are transformed at once, and compared at once.
AT_ONCE = 1 << 18
#: Codes of words run from 1 (0 stands beyond the end of the text), so a sum is below MOST * CODES**2, and that below P.
CODES = 15


class Run(NamedTuple):
    start: int
    length: int
    period: int


def roots(n: int, inverse: bool) -> np.ndarray:
    """The powers of an n-th root of one, up to half of n."""
    w = pow(GENERATOR, (P - 1) // n, P)
    w = pow(w, P - 2, P) if inverse else w
    out = np.ones(max(1, n // 2), np.uint64)
    step = 1
    while step < len(out):
        out[step : 2 * step] = out[:step] * np.uint64(pow(w, step, P)) % np.uint64(P)
        step *= 2
    return out


def transformed(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (its length a power of two): self-sorting, one pass a level."""
    p = np.uint64(P)
    m, n = x.shape
    half, stride = n // 2, 1
    w = roots(n, inverse)
    x = x.reshape(m, n, 1)
    while half:
        a, b = x[:, :half, :], x[:, half:, :]
        y = np.empty((m, half, 2, stride), np.uint64)
        y[:, :, 0, :] = (a + b) % p
        y[:, :, 1, :] = (a + (p - b)) % p * w[:: stride][:half, None] % p
        x = y.reshape(m, half, 2 * stride)
        half, stride = half // 2, stride * 2
    x = x.reshape(m, n)
    return x * np.uint64(pow(n, P - 2, P)) % p if inverse else x


def zero_distances(codes: np.ndarray, at: np.ndarray, size: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """``(block start, distance)`` wherever the block of ``size`` codes at ``at`` occurs again ``ahead .. ahead + size`` further on.

    ``codes`` has room behind the text for every window.
    """
    p = np.uint64(P)
    width = 2 * size
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for first in range(0, len(at), max(1, AT_ONCE // width)):
        here = at[first : first + max(1, AT_ONCE // width)]
        block = codes[here[:, None] + np.arange(size)]
        window = codes[here[:, None] + ahead + np.arange(width)]
        # the block turned round: the convolution at size - 1 + t is the inner product at distance t
        turned = np.zeros((len(here), 2 * width), np.uint64)
        turned[:, :size] = block[:, ::-1]
        beside = np.zeros_like(turned)
        beside[:, :width] = window
        product = transformed(transformed(turned) * transformed(beside) % p, inverse=True)[:, size - 1 : width]
        squares = np.zeros((len(here), width + 1), np.uint64)
        np.cumsum(window * window, axis=1, out=squares[:, 1:])
        sums = (block * block).sum(axis=1)[:, None] + squares[:, size:] - squares[:, : size + 1]
        i, t = np.nonzero((sums + 2 * (p - product)) % p == 0)
        found.append((here[i], t + ahead))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def agreeing(ids: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from places ``a`` and ``b`` on (``step`` 1) or backwards (-1); both stop at the ends of the text."""
    n = len(ids)
    room = (n - np.maximum(a, b)) if step > 0 else np.minimum(a, b) + 1
    out = np.zeros(len(a), np.int64)
    live, width = np.flatnonzero(room > 0), 8
    while len(live):
        rest = []
        for first in range(0, len(live), max(1, AT_ONCE // width)):
            part = live[first : first + max(1, AT_ONCE // width)]
            k = out[part, None] + np.arange(width)
            inside = k < room[part, None]
            k = np.where(inside, k, 0)
            same = inside & (ids[a[part, None] + step * k] == ids[b[part, None] + step * k])
            run = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[part] += run
            rest.append(part[(run == width) & (out[part] < room[part])])
        live, width = np.concatenate(rest), min(2 * width, AT_ONCE)
    return out


def covered(at: np.ndarray, to: np.ndarray, runs: list[np.ndarray]) -> np.ndarray:
    """Which stretches ``at : to`` lie within one of the runs (rows ``start, end``)."""
    if not runs:
        return np.zeros(len(at), bool)
    known = np.concatenate(runs)
    known = known[np.argsort(known[:, 0], kind="stable")]
    furthest = np.maximum.accumulate(known[:, 1])
    i = np.searchsorted(known[:, 0], at, side="right") - 1
    return (i >= 0) & (furthest[i] >= to)


def runs_of(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    by = np.argsort(ids, kind="stable")
    again = np.full(n, n, np.int64)
    same = ids[by[1:]] == ids[by[:-1]]
    again[by[:-1][same]] = (by[1:] - by[:-1])[same]
    codes, known, out = None, [], {}
    size = BASE
    while size == BASE or TIMES * (size + 1) <= n:
        least, most = (1 if size == BASE else size + 1), 2 * size
        blocks = n // size
        # a block with a word that does not come back in time has no occurrence in its window
        late = again[: blocks * size].reshape(blocks, size).max(axis=1)
        at = np.flatnonzero(late <= most) * size
        at = at[~covered(at, np.minimum(at + most + size, n), known)]
        if len(at):
            if codes is None:
                mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                codes = np.concatenate([mixed % np.uint64(CODES) + np.uint64(1), np.zeros(2 * n + 4 * BASE, np.uint64)])
            unit = min(size, MOST)
            seeds = [zero_distances(codes, at, unit, ahead) for ahead in ((0, size) if size == BASE else range(size, 2 * size, unit))]
            start, distance = np.concatenate([s[0] for s in seeds]), np.concatenate([s[1] for s in seeds])
            keep = (distance >= least) & (distance <= most) & (start + distance + unit <= n)
            start, distance = start[keep], distance[keep]
            keep = ~covered(start, start + distance + size, known)
            start, distance = start[keep], distance[keep]
            # codes can agree where words do not
            keep = np.zeros(len(start), bool)
            for first in range(0, len(start), max(1, AT_ONCE // unit)):
                part = slice(first, first + max(1, AT_ONCE // unit))
                here = start[part, None] + np.arange(unit)
                keep[part] = (ids[here] == ids[here + distance[part, None]]).all(axis=1)
            start, distance = start[keep], distance[keep]
            if len(start):
                by = np.lexsort((start, distance))
                start, distance = start[by], distance[by]
                begins = np.append(True, (np.diff(distance) != 0) | (np.diff(start) > unit))
                ends = np.append(begins[1:], True)
                low, high, q = start[begins], start[ends] + unit, distance[begins]
                left = low - agreeing(ids, low - 1, low - 1 + q, -1)
                right = high + agreeing(ids, high, high + q, 1) + q
                long = right - left >= np.maximum(LEAST, TIMES * q)
                for a, b, period in zip(left[long].tolist(), right[long].tolist(), q[long].tolist()):
                    out[a, b] = min(period, out.get((a, b), period))
                known = [np.array(list(out), np.int64)] if out else []
        size *= 2
    return sorted((Run(a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r.start, r.period))


def greatest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; of equal ones that with the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def dropped(runs: list[Run], n: int) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        edge[r.start + r.period] += 1
        edge[r.start + r.length] -= 1
    return np.cumsum(edge[:n]) > 0


def repeated_tail(n: int, name: str) -> np.ndarray | None:
    """For one id in ten: which word stands at each place once the tail of the text is replaced by repeats of its first words."""
    h = zlib.crc32(name.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


COLUMNS = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
FOUND = COLUMNS + ", n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic(docs: DataFrame, tails: bool = False) -> DataFrame:
    """``doc_id``, what the contract asks for, ``n_words``, all ``runs`` and the ``collapsed`` text: the words that no run repeats.

    ``start, length, period, exponent_milli`` are those of the run with the most repeats. ``tails`` puts repeats into the text of one id in ten first.
    """

    def described(doc_id: int | None, text: str | None) -> tuple:
        words = (text or "").encode().split()
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        moved = repeated_tail(len(words), str(doc_id)) if tails and doc_id is not None else None
        if moved is not None:
            ids, words = ids[moved], [words[i] for i in moved.tolist()]
        runs = runs_of(ids)
        if runs:
            gone = dropped(runs, len(words))
            words = [w for w, d in zip(words, gone.tolist()) if not d]
        best = greatest(runs)
        listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
        collapsed = b" ".join(words)
        milli = 1000 * best.length // best.period if best else None
        hashes = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()
        return (len(runs), *(best or repeat(None, 3)), milli, *hashes, len(ids), [r._asdict() for r in runs], collapsed.decode())

    out = pa.schema([(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in Run._fields]))), ("collapsed", pa.string())])

    def run(batches):
        for part in sliced(batches):
            names, ids = part.column("doc_id"), part.column("doc_id").to_pylist()
            rows = [described(i, t.as_py()) for i, t in zip(ids, part.column("text"))]
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)]
            yield pa.RecordBatch.from_arrays([names, *columns], names=["doc_id", *out.names])

    return texts(docs).mapInArrow(run, FOUND)
