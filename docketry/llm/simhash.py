"""SimHash near-dedup with pivot distance tables: documents whose 64-bit fingerprints differ in three bits or fewer are linked.

A fingerprint's bit is 1 if more than half of the XXH64 hashes of the text's 3-word shingles (repeats included) have it.

1. Texts with the same fingerprint are one class, counted by an aggregation that is combined before the shuffle.
   Everything below runs over classes.
2. The pivot table of a class holds its Hamming distances to reference fingerprints. Two fingerprints that differ in d bits have
   distances to any reference that differ by d at most. There are two sorts of references:

   - *Groups.* The 64 bits fall into six groups; the references of a group differ from the reference of all zeros in one bit of that group,
     so what the table says of a group depends on that group's bits alone. Three bits touch three groups at most, so two linked
     classes have equal entries in at least three whole groups: each choice of three groups is a key, made from the entries, under
     which a link's two ends meet. No link is lost, and classes of unrelated texts share no key, as a key has about 32 bits.
   - *Spread* references (``SPREAD``), whose bits are random. Of the pairs under a key those whose entries differ by more than 3 for
     any of them are discarded: the maximum coordinate difference.
3. What is left is verified by the bits that differ, and only as many links as hold a part of the pairs together leave a task.
4. Links are turned into pairs of smallest ``doc_id`` and joined to components over all tasks.

A key with very many classes (a text and its many near copies) is cut into parts of ``PART`` classes, and each two parts are one unit of
work, so that no task gets a whole large key and no row is made for each pair. Keys with one class go before anything is sorted.

Words are runs of anything but ASCII white space, with A-Z in lower case; one or two words are one shingle; a text without
words, or null, has the fingerprint zero, and is linked like any other. A row with a null ``doc_id`` gets its fingerprint and a
null component and links nothing. Rows that repeat a ``doc_id`` keep a row each, and the id stands for all of them: the component of each
is that of its own fingerprint, and the texts of one id are linked through it. Texts of any length are read whole; an empty table gives
an empty result; other columns are left behind, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import components, discarded, stored, texts
from docketry.llm._words import LOWER, mix, sliced

SHINGLE, SEED = 3, 42
#: Bits in which linked fingerprints differ at most.
NEAR = 3
#: Groups of bits, of which linked fingerprints agree in all but ``NEAR``.
GROUPS = 6
#: Reference fingerprints with random bits.
SPREAD = np.random.default_rng(41).integers(0, 1 << 64, 32, dtype=np.uint64)
#: Classes of one part of a key; a unit of work holds two parts.
PART = 512
#: Keys that are handed to all tasks by name, as they are cut into parts: no more than this, whatever the table.
MOST_HOT = 10_000
LOWER_TABLE = LOWER.tobytes()


def grouped_references() -> list[np.ndarray]:
    """For each group of bits its references: one bit of the group each."""
    edge = [64 * g // GROUPS for g in range(GROUPS + 1)]
    return [np.uint64(1) << np.arange(a, b, dtype=np.uint64) for a, b in zip(edge, edge[1:])]


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot table: a row of Hamming distances for each fingerprint."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(LOWER_TABLE).split()
    if not words:
        return 0
    k = min(SHINGLE, len(words))
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    shingles = zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())
    h = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in shingles), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for first in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[first : first + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, bits`` (the fingerprint as a long) of every row."""

    def run(batches):
        for part in sliced(batches):
            bits = np.array([fingerprint(t.as_py()) for t in part.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return texts(docs).mapInArrow(run, "doc_id bigint, bits bigint")


def keyed(classes: DataFrame) -> DataFrame:
    """``key, bits``: a key for each choice of groups, made from the class's distances to the references of those groups."""
    groups = grouped_references()
    choices = list(combinations(range(GROUPS), GROUPS - NEAR))

    def run(batches):
        for batch in batches:
            prints = batch.column("bits").to_numpy().view(np.uint64)
            if not len(prints):
                continue
            whole = np.bitwise_count(prints).astype(np.int8)
            entries = []
            for references in groups:
                # one up or one down from the distance to zero: as many bits of a number as the group has references
                own = distances(prints, references) > whole[:, None]
                entries.append((own.astype(np.uint64) << np.arange(len(references), dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
            keys = []
            for n, choice in enumerate(choices):
                key = np.full(len(prints), n + 1, np.uint64)
                for g in choice:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + entries[g])
                keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(prints, len(choices)).view(np.int64))], names=["key", "bits"])

    return classes.select("bits").mapInArrow(run, "key bigint, bits bigint")


def in_units(rows: DataFrame, total: int) -> DataFrame:
    """``key, bits`` of the keys that two classes or more share, as ``unit, bits``: small keys are a unit each, large ones one for each two parts."""
    counts = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    large = max(2 * PART, total // MOST_HOT)
    hot, rest = F.broadcast(counts.where(F.col("n") > large)), counts.where(F.col("n") <= large)
    met = rows.join(hot, "key").unionByName(rows.join(F.broadcast(counts.where(F.col("n") > large).select("key")), "key", "left_anti").join(rest, "key"))
    parts = F.ceil(F.col("n") / PART)
    own = F.pmod(F.xxhash64("bits", F.lit(31)), parts)
    # a part meets every other one, and itself in each of these units
    others = F.when(F.col("n") <= 2 * PART, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
    whole = F.col("n") <= 2 * PART
    spread = met.withColumn("own", F.when(whole, 0).otherwise(own)).withColumn("other", F.explode(others)).where(whole | (F.col("own") != F.col("other")))
    return spread.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "bits")


def linked(prints: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of their units: enough links ``(a, b)`` to hold together what is linked within a unit."""
    table = distances(prints, SPREAD)
    place = np.arange(len(prints))
    end = np.searchsorted(unit, unit, side="right")
    root = place.copy()
    out: list[tuple[int, int]] = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step, live = 1, place[end - place > 1]
    while len(live):
        a, b = live, live + step
        # the entries that discard most come first, a few at a time
        for first in range(0, len(SPREAD), 8):
            near = np.abs(table[a, first : first + 8] - table[b, first : first + 8]).max(axis=1) <= NEAR
            a, b = a[near], b[near]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= NEAR
        a, b = a[near], b[near]
        if len(a):
            while (root[root] != root).any():
                root = root[root]
            apart = root[a] != root[b]
            for i, j in zip(a[apart].tolist(), b[apart].tolist()):
                x, y = top(i), top(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((i, j))
        step += 1
        live = live[end[live] - live > step]
    at = np.array(out, np.int64).reshape(-1, 2)
    return prints[at[:, 0]], prints[at[:, 1]]


def links(units: DataFrame) -> DataFrame:
    """``x, y``: linked classes."""

    def run(batches):
        unit, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            unit, prints = np.concatenate([unit, batch.column("unit").to_numpy()]), np.concatenate([prints, batch.column("bits").to_numpy()])
            # the last unit may go on in the next batch
            whole = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            if whole:
                yield found(unit[:whole], prints[:whole])
                unit, prints = unit[whole:], prints[whole:]
        if len(unit):
            yield found(unit, prints)

    def found(unit: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        x, y = linked(prints.view(np.uint64), unit)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["x", "y"])

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "x bigint, y bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    rows = stored(fingerprints(docs), "fingerprints")
    named = rows.where("doc_id IS NOT NULL")
    classes = stored(named.groupBy("bits").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "classes")
    keys = stored(keyed(classes), "keyed")
    found = stored(links(in_units(keys, keys.count())), "links")
    ids = classes.select("bits", "doc_id")
    pairs = found.join(ids.select(F.col("bits").alias("x"), F.col("doc_id").alias("a")), "x").join(ids.select(F.col("bits").alias("y"), F.col("doc_id").alias("b")), "y").select("a", "b")
    # an id with several texts holds their classes together
    several = stored(named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    texts_of = named.join(several, "doc_id", "left_semi").distinct().join(ids.withColumnRenamed("doc_id", "a"), "bits").select("a", F.col("doc_id").alias("b"))
    reached = components(pairs.unionByName(texts_of)).withColumnRenamed("node", "doc_id")
    final = classes.join(reached, "doc_id", "left").select("bits", "n", F.coalesce("component", "doc_id").alias("component_id"))
    discarded(keys, found)
    # classes of very many documents are few; theirs need no shuffle of the documents
    hot = max(PART, rows.count() // MOST_HOT)
    large = F.broadcast(final.where(F.col("n") > hot).select("bits", "component_id"))
    known = named.join(large, "bits", "left")
    small = known.where("component_id IS NULL").drop("component_id").join(final.where(F.col("n") <= hot).select("bits", "component_id"), "bits")
    every = [known.where("component_id IS NOT NULL"), small, rows.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long"))]
    every = reduce(DataFrame.unionByName, every)
    return every.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
