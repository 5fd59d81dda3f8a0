"""Which entries of a document hold a chunk's beginning, or lie within it: a block of rows at a time, exactly.

A block has rows of ``doc, probe`` (or entry) and text, the probes of a document before its entries and these by position. Texts that can
contain one another have a hash of fifteen bytes in common; hashes of all places of a block are met with those of the beginnings
in one pass over its bytes, and what meets is compared byte by byte. Entries of fewer bytes are met by their length.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a hashed beginning: no probe has fewer.
BEGINNING = 15
_A, _B, _C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
NONE = np.iinfo(np.int64).max


def _mixed(low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
    h = (low * _A) ^ ((high + doc * _C) * _B)
    h ^= h >> np.uint64(31)
    return h * _A


def _met(hashes: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places ``at`` with their hashes those whose hash is among the sorted ``keys``, and the first and last of these keys."""
    if not len(keys):
        return at[:0], at[:0], at[:0]
    some = np.zeros(1 << 20, bool)
    some[keys >> np.uint64(44)] = True
    few = some[hashes >> np.uint64(44)]
    hashes, at = hashes[few], at[few]
    first, last = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, "right")
    hit = first < last
    return at[hit], first[hit], last[hit]


def first_entries(doc: np.ndarray, is_probe: np.ndarray, half: np.ndarray, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row that is a probe the first entry row of its document that contains it or lies within it, and the first that contains its
    first ``half`` bytes; ``NONE`` where there is none. Row i is ``raw[ends[i]:ends[i + 1]]``."""
    n = len(doc)
    begins, ends = ends[:-1].astype(np.int64), ends[1:].astype(np.int64)
    lengths = ends - begins
    first, second = np.full(n, NONE), np.full(n, NONE)
    # equal probes of a document are looked up once, and of its equal entries the first stands for all
    of, seen = np.arange(n), {}
    for i, key in enumerate(zip(doc.tolist(), is_probe.tolist(), begins.tolist(), ends.tolist())):
        of[i] = seen.setdefault((*key[:2], raw[key[2] : key[3]]), i)
    own = of == np.arange(n)
    probes, entries = np.flatnonzero(own & is_probe), np.flatnonzero(own & ~is_probe)
    if not len(probes) or not len(entries):
        return first, second

    padded = np.frombuffer(raw + bytes(16), np.uint8)
    words = np.ndarray(len(raw) + 9, np.uint64, padded, strides=(1,))

    def places(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All places of rows at which ``width`` bytes begin, in order, and their rows."""
        some = np.maximum(lengths[rows] - width + 1, 0)
        row = np.repeat(rows, some)
        return np.arange(len(row)) + np.repeat(begins[rows] - np.cumsum(some) + some, some), row

    def hashed(at: np.ndarray, row: np.ndarray) -> np.ndarray:
        return _mixed(words[at], words[at + (BEGINNING - 8)], doc[row].astype(np.uint64))

    # probes in entries: the places come in the order of the entries, so the first that holds is the first of all
    keys = hashed(begins[probes], probes)
    by = np.argsort(keys, kind="stable")
    keys, rows = keys[by], probes[by].tolist()
    at, row = places(entries, BEGINNING)
    met, a, b = _met(hashed(at, row), at, keys)
    found = np.searchsorted(begins, met, "right") - 1
    for i, e, a, b in zip(met.tolist(), found.tolist(), a.tolist(), b.tolist()):
        for p in rows[a:b]:
            # where the whole is contained its half is
            if first[p] == NONE and doc[p] == doc[e]:
                begin, room = begins[p], ends[e] - i
                if second[p] == NONE and half[p] <= room and raw[i : i + half[p]] == raw[begin : begin + half[p]]:
                    second[p] = e
                if lengths[p] <= room and raw[i : i + lengths[p]] == raw[begin : ends[p]]:
                    first[p] = e

    # entries in probes
    longest = lengths[probes].max()
    inner = entries[(lengths[entries] >= BEGINNING) & (lengths[entries] <= longest)]
    keys = hashed(begins[inner], inner)
    by = np.argsort(keys, kind="stable")
    keys, rows = keys[by], inner[by].tolist()
    at, row = places(probes, BEGINNING)
    met, a, b = _met(hashed(at, row), at, keys)
    found = np.searchsorted(begins, met, "right") - 1
    for i, p, a, b in zip(met.tolist(), found.tolist(), a.tolist(), b.tolist()):
        for e in rows[a:b]:
            if e < first[p] and doc[p] == doc[e] and lengths[e] <= ends[p] - i and raw[i : i + lengths[e]] == raw[begins[e] : ends[e]]:
                first[p] = e
    for width in range(1, BEGINNING):
        inner = entries[lengths[entries] == width]
        if len(inner):
            mask = np.uint64((1 << 8 * min(width, 8)) - 1)
            low, high = lambda at: words[at] & mask, lambda at, back=max(0, width - 8): words[at + back] & mask
            keys = _mixed(low(begins[inner]), high(begins[inner]), doc[inner].astype(np.uint64))
            by = np.argsort(keys, kind="stable")
            keys, inner = keys[by], inner[by]
            at, row = places(probes, width)
            met, a, b = _met(_mixed(low(at), high(at), doc[row].astype(np.uint64)), at, keys)
            p = np.searchsorted(begins, met, "right") - 1
            while len(met):
                e = inner[a]
                same = (doc[p] == doc[e]) & (low(met) == low(begins[e])) & (high(met) == high(begins[e]))
                np.minimum.at(first, p[same], e[same])
                # equal hashes of different texts, if there ever are any
                a = a + 1
                more = a < b
                met, a, b, p = met[more], a[more], b[more], p[more]
    # an empty entry is in every probe
    for e in entries[lengths[entries] == 0].tolist():
        mine = probes[doc[probes] == doc[e]]
        first[mine] = np.minimum(first[mine], e)
    return first[of], second[of]
