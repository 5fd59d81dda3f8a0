"""Periodic runs, SimHash links and ranked search, against plain versions written from their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from docketry.llm import periods, ranked, simhash

ODD = "doc_id long, text string, source string, bits long, start long, score long, key long"


def odd(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 4) for i, t in rows], ODD)


# periodic runs


def plain_runs(words):
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        begin = None
        for i, s in enumerate(same):
            if s and begin is None:
                begin = i
            if not s and begin is not None:
                if i - begin + q >= max(24, 3 * q):
                    best[begin, i + q] = min(q, best.get((begin, i + q), q))
                begin = None
    return sorted((a, b - a, q) for (a, b), q in best.items())


def plain_periodic(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept))


def repeating(rng, n, vocabulary):
    words = [str(rng.randrange(vocabulary)) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // 3))
        for i in range(a, rng.randrange(a, n)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("most", [1 << 20, 16])
def test_runs_against_brute_force(most, monkeypatch):
    monkeypatch.setattr(periods, "MOST", most)
    rng = random.Random(3)
    for _ in range(300):
        words = repeating(rng, rng.choice([1, 23, 24, 30, 60, 100, 200, 400]), rng.choice([1, 2, 3, 20, 1000]))
        numbers = np.unique(words, return_inverse=True)[1]
        assert [tuple(r) for r in periods.runs_of(numbers)] == plain_runs(words)


def test_transform_multiplies_polynomials():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, periods.P, (2, 3, 16)).astype(np.uint64)
    a[:, 8:] = b[:, 8:] = 0
    got = periods.transformed(periods.transformed(a) * periods.transformed(b) % np.uint64(periods.P), inverse=True)
    want = [[sum(int(x[i]) * int(y[k - i]) for i in range(k + 1)) % periods.P for k in range(16)] for x, y in zip(a, b)]
    assert got.tolist() == want


def test_long_texts_of_few_words():
    one = periods.runs_of(np.zeros(300_000, np.int64))
    assert one == [periods.Run(0, 300_000, 1)]
    tower = periods.runs_of(np.tile(np.append(np.zeros(700, np.int64), 1), 100))
    assert periods.Run(0, 70_100, 701) in tower and sum(r.period == 1 for r in tower) == 100


def test_periodic_on_odd_rows(spark):
    rng = random.Random(5)
    line = "a b c d e f g h "
    rows = [(None, line * 5), (1, None), (2, ""), (3, " \t\n"), (4, line * 3), (4, line * 3), (4, line * 4), (5, "Wort wort " * 12), (6, "über alles " * 40)]
    rows += [(i, " ".join(repeating(rng, rng.choice([30, 90, 250]), 40))) for i in range(10, 70)]
    docs = odd(spark, rows)
    names = [c.split()[0] for c in periods.COLUMNS.split(", ")]
    got = sorted((tuple(r) for r in periods.periodic(docs, tails=True).select(*names).collect()), key=str)
    assert got == sorted((plain_periodic(i, t) if i is not None else (None, *plain_periodic(1, t)[1:]) for i, t in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    one = periods.periodic(docs.where("doc_id = 4")).orderBy("n_words").first()
    assert one.collapsed == line.strip() and [tuple(r) for r in one.runs] == [(0, 24, 8)]
    assert periods.periodic(docs.limit(0)).collect() == []


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, pairs):
    low = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                moved = True
    return low


def plain_simhash(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    named = [(i, f) for i, f in prints if i is not None]
    pairs = [(i, j) for i, f in named for j, g in named if (f ^ g).bit_count() <= 3]
    low = plain_components({i for i, _ in named}, pairs)
    return [(i, f"{f:016x}", low.get(i)) for i, f in prints]


def test_simhash_on_odd_rows(spark):
    rng = random.Random(11)
    rows = [(None, "A b c"), (None, None), (1, None), (2, ""), (3, "  "), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "ünï Ünï"), (8, "x " * 40_000), (9, "x " * 50_000)]
    for n in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 300, 900]))]
        for c in range(rng.choice([1, 2, 5])):
            other = list(words)
            for _ in range(c):
                other[rng.randrange(len(other))] = "changed"
            rows.append((100 + 10 * n + c, " ".join(other)))
    rows += [(100, rows[-1][1]), rows[15]]
    docs = odd(spark, rows)
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(plain_simhash(rows), key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_links_of_three_bits_are_all_found(spark, monkeypatch):
    """Fingerprints up to five bits from their neighbours, in keys that are cut into parts."""
    monkeypatch.setattr(simhash, "PART", 8)
    rng = random.Random(2)
    prints = set()
    for n in range(30):
        x = rng.getrandbits(64)
        for _ in range(60 if n < 2 else rng.randrange(6)):
            prints.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << b
    for b in range(40):
        prints.add(1 << b)
    ids = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in ids]
    classes = spark.createDataFrame([(x,) for x in signed], "bits long")
    keys = simhash.keyed(classes).cache()
    pairs = [((r.x + (1 << 64)) % (1 << 64), (r.y + (1 << 64)) % (1 << 64)) for r in simhash.links(simhash.in_units(keys, keys.count())).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    want = plain_components(ids, [(a, b) for a in ids for b in ids if a < b and (a ^ b).bit_count() <= 3])
    assert plain_components(ids, pairs) == want and len(set(want.values())) < len(ids)


# ranked search


def plain_ranks(docs, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(find(t))) for i, t in docs if i is not None]
    held = [(i, c) for i, c in held if c]
    n, words = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        if item is None:
            continue
        scores = []
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c in held) + 1))) for t in set(find(text))}
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // words
            s = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(1 << 22, 64), (3000, 4), (1, 2)])
def test_ranks_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ranked, "SHARD_BYTES", shard)
    monkeypatch.setattr(ranked, "BLOCK", block)
    rng = random.Random(shard)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 30, 200])))) for i in range(150)]
    docs += [(None, "w1 w2"), (200, None), (201, ""), (202, "., -"), (7, docs[7][1]), (8, docs[9][1]), (203, "W1 w2-w3_É é " * 3), (204, "w1 " * 20_000), (300, docs[9][1]), (301, docs[9][1])]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 40])))) for i in range(12)] + [(None, "w1"), (50, None), (51, ""), (52, "unheard"), (53, "É w3"), (54, docs[9][1])]
    index = ranked.indexed(odd(spark, docs).repartition(3))
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id long, row string")
    want = plain_ranks(docs, items)
    assert sorted(tuple(r) for r in ranked.search(index, asked).collect()) == want
    assert sorted(tuple(r) for r in ranked.search(index, asked, block_terms=20).collect()) == want


def test_blocks_are_skipped_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 8)
    rng = random.Random(9)
    # documents of twenty subjects; a query of one subject needs no block of another
    docs = [(i, " ".join(["common", *(f"s{i % 20}w{rng.randrange(12)}" for _ in range(30))])) for i in range(1000)]
    index = ranked.indexed(odd(spark, docs).coalesce(1))
    asked = spark.createDataFrame([(1, "common s3w1 s3w2 s3w3"), (2, "common s4w1 s4w5 s5w5")], "item_id long, text string")
    assert sorted(tuple(r) for r in ranked.search(index, asked).collect()) == plain_ranks(docs, [tuple(r) for r in asked.collect()])
    met = ranked.search(index, asked, pruning=True).first()
    assert 0 < met.skipped <= met.blocks
    assert ranked.search(index, asked.limit(0)).collect() == []
    assert ranked.search(ranked.indexed(odd(spark, docs).limit(0)), asked).collect() == []
