"""N-gram Jaccard join: every pair of texts whose sets of 5-word shingles have a Jaccard similarity of 0.75
or more is linked, and each document gets the smallest ``doc_id`` that it reaches over links.

1. Texts with the same set are one class, so exact copies meet in an aggregation that is combined before the
   shuffle. Classes, not documents, are joined.
2. A first round merges what is clearly alike: min-hash bands name groups of classes, each member is compared
   with the first member of its group and of the smaller groups that it shares two bands with, and links that hold form components.
3. A second round makes the join exact. Two sets of similarity 0.75 share an element among the rarest quarter
   of each (prefix filter), so classes are tiled by prefix element and size band. Elements that repeat most
   often come last in the order that picks the prefixes, which keeps the tiles small. Only pairs of
   classes that are in different components yet are compared: all of them that share an element which stands
   early enough in both for their two sizes.

A comparison first bounds the overlap from above by the bit counts of hashed bitmap signatures, and only pairs
that can still reach the threshold have their sorted hash arrays intersected. The arrays are written once for
each class that is compared, and texts are never joined. Sets hold 64-bit hashes of
shingles; that two different shingles or sets share a hash is left out of account (odds below 1e-8 at a
billion sets).

Words are runs of anything but ASCII white space; a text of one to four words is one shingle of its own length; a text without words, or
null, has an empty set and is linked with nothing. A row with a null ``doc_id`` gets its set size and a null
component, and links nothing. Rows that repeat a ``doc_id`` each keep their row. Texts of any length are read whole; an empty
table gives an empty result; of other columns only ``deduplicated`` hands any on, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm._shared import components, discarded, members, salted, stored, texts
from docketry.llm._words import SPACED, Words, joined, mix, sliced

SHINGLE = 5
#: Links need ``100 * overlap >= PERCENT * union``.
PERCENT = 75
BANDS, ROWS = 6, 3
#: So many shingles at most, those that repeat most often, go to the end of the prefix order (8 bytes each).
MOST_COMMON = 1 << 19
WINDOW_SIZE = 1 << 20
#: Sets that a task remembers to have sent on.
MOST_SEEN = 1 << 17
SEEDS = np.random.default_rng(23).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(part: pa.RecordBatch, cache: dict):
    """Sorted distinct shingle hashes of each text of a slice."""
    w = Words(part.column("text"), SPACED, cache)
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        yield np.unique(joined(w.hashes[a:b], SHINGLE))


def fingerprint(found: np.ndarray) -> int:
    """64 bits that tell sets apart."""
    if not len(found):
        return 0
    return int(mix(np.array([np.add.reduce(mix(found + np.uint64(len(found))))], np.uint64)).view(np.int64)[0])


def bands(found: np.ndarray) -> list:
    if not len(found):
        return []
    low = ((found[None, :] ^ SEEDS[:, None]) * np.uint64(0x9E3779B97F4A7C15)).min(axis=1).reshape(BANDS, ROWS)
    return mix(np.bitwise_xor.reduce(mix(low + np.arange(ROWS, dtype=np.uint64)), axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


def described(docs: DataFrame) -> DataFrame:
    """A row for each document (set size, fingerprint, bands) and rows ``(shingle, n)`` for shingles that neighbouring
    documents share (counts within about ``WINDOW_SIZE`` shingles, which only order the prefixes)."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("bands", pa.list_(pa.int64())), ("shingle", pa.int64())])
    def repeated(held: list) -> pa.RecordBatch:
        key = np.sort(np.concatenate(held))
        held.clear()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(first, len(key)))
        key, n = key[first[n > 1]].view(np.int64), n[n > 1]
        return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.array(n), pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.list_(pa.int64())), pa.array(key)], schema=out)

    def run(batches):
        cache: dict = {}
        held: list = []
        size = 0
        for part in sliced(batches):
            ids, sizes, prints, keys = part.column("doc_id").to_pylist(), [], [], []
            for found in shingle_sets(part, cache):
                sizes.append(len(found))
                prints.append(fingerprint(found))
                keys.append(bands(found))
                held.append(found)
                size += len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.nulls(len(ids), pa.int64())], schema=out)
            if size > WINDOW_SIZE:
                yield repeated(held)
                size = 0
        if held:
            yield repeated(held)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, set_id bigint, bands array<bigint>, shingle bigint")


def prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """``(key, set_id, size)``: the elements of each set of which a set of similarity 0.75 must hold one; ``size`` holds
    the set's size (upper 32 bits) and the element's rank in the prefix, from 0. Of equal sets each task sends one on
    (forgetting after ``MOST_SEEN`` sets), so a text with very many copies gives a key one row a task."""
    sent = docs.sparkSession.sparkContext.broadcast(common)
    out = pa.schema([("key", pa.int64()), ("set_id", pa.int64()), ("size", pa.int64())])

    def run(batches):
        last = sent.value
        cache: dict = {}
        seen: set = set()
        for part in sliced(batches):
            keys, prints, sizes = [], [], []
            for found in shingle_sets(part, cache):
                n = len(found)
                if not n or (name := fingerprint(found)) in seen:
                    continue
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add(name)
                take = n - -(-PERCENT * n // 100) + 1
                if len(last):
                    at = np.minimum(np.searchsorted(last, found), len(last) - 1)
                    late = last[at] == found
                    found_in_order = np.concatenate([found[~late], found[late]]) if late.any() else found
                else:
                    found_in_order = found
                keys.append(found_in_order[:take])
                prints.append(np.full(take, name, np.int64))
                sizes.append((n << 32) + np.arange(take, dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(prints)), pa.array(np.concatenate(sizes))], schema=out)

    return docs.mapInArrow(run, "key bigint, set_id bigint, size bigint")


def signature(found: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set, with at least four bits an element."""
    bits = max(64, 1 << int(4 * len(found) - 1).bit_length())
    map_ = np.zeros(bits, bool)
    map_[(found >> np.uint64(20)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(map_, bitorder="little")


def folded(map_: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(map_.reshape(-1, size), axis=0) if len(map_) > size else map_


def overlap_bound(n: int, a: np.ndarray, m: int, b: np.ndarray) -> int:
    """No more elements than this are in both sets: each bit that only one map has stands for an element of that set alone."""
    size = min(len(a), len(b))
    a, b = folded(a, size), folded(b, size)
    both = int(np.bitwise_count(a & b).sum())
    return min(n - int(np.bitwise_count(a).sum()) + both, m - int(np.bitwise_count(b).sum()) + both)


def sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, name: str, whole: bool) -> DataFrame:
    """``(set_id, doc_id, n, map, elements)`` of each class in ``(x, y)`` pairs, and of a few other documents: size, signature
    and, where ``whole``, sorted hashes of its smallest document."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("set_id")).distinct()
    may_be = members(classes.join(wanted, "set_id", "left_semi"), "doc_id")
    out = pa.schema([("set_id", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("map", pa.binary()), ("elements", pa.binary())])

    def run(batches):
        cache: dict = {}
        for batch in batches:
            for part in sliced([batch.filter(pa.array(may_be(batch.column("doc_id"))))]):
                ids = part.column("doc_id").to_pylist()
                rows = [(fingerprint(x), ids[i], len(x), signature(x).tobytes(), x.tobytes() if whole else None) for i, x in enumerate(shingle_sets(part, cache)) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], out.field(k).type) for k in range(5)], schema=out)

    return stored(docs.where("doc_id IS NOT NULL").mapInArrow(run, "set_id bigint, doc_id bigint, n int, map binary, elements binary"), name)


def met(pairs: DataFrame, classes: DataFrame, held: DataFrame, *columns: str) -> DataFrame:
    """Pairs ``(x, y)`` beside the columns of both. A class in very many pairs is split: its row is copied once for each
    ``HOT_ROWS`` pairs, and no task gets all of them."""
    total = pairs.count()
    for c, other in (("x", "y"), ("y", "x")):
        pairs = salted(pairs, c, other, total).withColumnRenamed("salt", f"{c}_salt")
    out = pairs
    for c in ("x", "y"):
        side = held.select(F.col("set_id").alias(c), "doc_id", *[F.col(k).alias(f"{c}_{k}") for k in columns])
        copies = pairs.select(c, f"{c}_salt").distinct().join(classes.select(F.col("set_id").alias(c), "doc_id"), c).join(side, [c, "doc_id"]).drop("doc_id")
        out = out.join(copies, [c, f"{c}_salt"])
    return out


def within_bound(pairs: DataFrame, classes: DataFrame, held: DataFrame) -> DataFrame:
    """Those pairs ``(x, y)`` whose signatures leave room for the threshold."""
    out = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches):
        for batch in batches:
            n, m, a, b = (batch.column(c).to_pylist() for c in ("x_n", "y_n", "x_map", "y_map"))
            keep = [i for i in range(batch.num_rows) if overlap_bound(n[i], np.frombuffer(a[i], np.uint8), m[i], np.frombuffer(b[i], np.uint8)) >= needed(n[i], m[i])]
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("x").take(keep), batch.column("y").take(keep)], schema=out)

    return met(pairs, classes, held, "n", "map").select("x", "y", "x_n", "y_n", "x_map", "y_map").mapInArrow(run, "x bigint, y bigint")


def needed(n: int, m: int) -> int:
    """Elements that two sets of these sizes must share."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def shared_elements(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted arrays share: each of the shorter one is looked up in the longer."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def links(pairs: DataFrame, classes: DataFrame, held: DataFrame, name: str) -> DataFrame:
    """Those pairs of classes ``(x, y)`` that reach the threshold; ``held`` has the classes' signatures and elements."""
    out = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            a, b, x_map, y_map = (batch.column(c) for c in ("x_elements", "y_elements", "x_map", "y_map"))
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                need = needed(len(x), len(y))
                bound = overlap_bound(len(x), np.frombuffer(x_map[i].as_buffer(), np.uint8), len(y), np.frombuffer(y_map[i].as_buffer(), np.uint8))
                if bound >= need and shared_elements(x, y) >= need:
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("x").take(keep), batch.column("y").take(keep)], schema=out)

    both = met(pairs, classes, held, "map", "elements")
    return stored(both.select("x", "y", "x_elements", "y_elements", "x_map", "y_map").mapInArrow(run, "x bigint, y bigint").distinct(), name)


def fits(a: str, b: str):
    """Sizes that a similarity of 0.75 allows."""
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def tile(n):
    """Size band: sets that can reach the threshold are in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / PERCENT) + 1e-9)).cast("int")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    docs = texts(docs)
    seen = stored(described(docs), "described")
    rows = seen.where("shingle IS NULL")
    classes = stored(rows.where("doc_id IS NOT NULL AND n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").cast("int").alias("n"), F.first("bands").alias("bands")), "classes")
    held = stored(seen.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n")), "repeated")
    # the lowest count for which the list stays within its bound
    most, least = 0, 1 << 62
    for row in held.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("shingles")).orderBy(F.desc("n")).collect():
        most += row.shingles
        if most > MOST_COMMON:
            break
        least = row.n
    common = np.sort(held.where(F.col("n") >= least).select("shingle").toArrow().column(0).to_numpy().view(np.uint64))

    by_key = Window.partitionBy("key")
    keys = prefixes(docs, common).withColumn("lo", F.min("set_id").over(by_key)).withColumn("hi", F.max("set_id").over(by_key))
    shared = stored(keys.where("lo <> hi").select("key", "set_id", "size").distinct(), "shared")
    # only classes that share a prefix element with another one can have a link
    able = stored(classes.join(shared.select("set_id").distinct(), "set_id", "left_semi"), "able")

    # each member of a band meets the band's first member, and the first of those that share another band with it too
    banded = able.select("set_id", "doc_id", "n", "bands", F.posexplode("bands").alias("i", "band"))
    other = lambda step: F.element_at("bands", ((F.col("i") + step) % BANDS + 1).cast("int"))
    groups = F.array(F.col("band"), F.xxhash64("band", other(1)), F.xxhash64("band", other(2)))
    banded = banded.select("set_id", "doc_id", "n", F.explode(groups).alias("band"))
    first = banded.groupBy("band").agg(F.min(F.struct("doc_id", "set_id", "n")).alias("r"), F.count("*").alias("members")).where("members > 1").drop("members")
    star = banded.join(first, "band").where("r.set_id <> set_id").where(fits(F.col("n"), F.col("r.n"))).select(F.greatest("set_id", "r.set_id").alias("x"), F.least("set_id", "r.set_id").alias("y")).distinct()
    star = stored(star, "star")
    sets = sets_of(docs, classes, star, "star-sets", True)
    near = links(star, classes, sets, "near")
    discarded(sets, star)
    merged = components(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "set_id")
    part_of = able.join(merged, "set_id", "left").select("set_id", F.coalesce("component", "set_id").alias("part"))

    tiles = shared.join(part_of, "set_id").withColumn("n", F.shiftright("size", 32).cast("int")).withColumn("r", F.col("size").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    tiles = stored(tiles.withColumn("lo", F.min("part").over(by_key)).withColumn("hi", F.max("part").over(by_key)).where("lo <> hi").select("key", "set_id", "n", "r", "part", tile(F.col("n")).alias("tile")), "tiles")
    left = tiles.select("key", F.col("set_id").alias("x"), F.col("n").alias("nx"), F.col("r").alias("rx"), F.col("part").alias("px"), F.explode(F.array("tile", F.col("tile") + 1)).alias("tile"))
    right = tiles.select("key", F.col("set_id").alias("y"), F.col("n").alias("ny"), F.col("r").alias("ry"), F.col("part").alias("py"), "tile")
    # for these two sizes, an element they share must stand among the first (size - overlap needed + 1) of both
    need = F.ceil((F.col("nx") + F.col("ny")) * PERCENT / (100 + PERCENT))
    early = (F.col("rx") <= F.col("nx") - need) & (F.col("ry") <= F.col("ny") - need)
    pairs = left.join(right, ["key", "tile"]).where("px <> py AND (nx < ny OR nx = ny AND x < y)").where(fits("nx", "ny") & early).select("x", "y").distinct()
    pairs = stored(pairs, "pairs")
    pairs = stored(within_bound(pairs, classes, sets_of(docs, classes, pairs, "maps", False)).distinct(), "bounded")
    sets = sets_of(docs, classes, pairs, "sets", True)
    every = near.unionByName(links(pairs, classes, sets, "rest"))
    discarded(sets, shared, tiles, held)
    ids = classes.select("set_id", "doc_id")
    named = every.join(ids.select(F.col("set_id").alias("x"), F.col("doc_id").alias("a")), "x").join(ids.select(F.col("set_id").alias("y"), F.col("doc_id").alias("b")), "y").select("a", "b")
    reached = components(named).withColumnRenamed("node", "doc_id")
    final = ids.join(reached, "doc_id", "left").select("set_id", F.coalesce("component", "doc_id").alias("component_id"))
    joined_rows = rows.select("doc_id", F.col("n").alias("n_shingles"), "set_id").join(final, "set_id", "left")
    return joined_rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group of linked documents the one with the smallest id stays.

    Of equal rows one stays; rows with a null ``doc_id`` all stay.
    """
    kept = stored(near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct(), "kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_hash"), F.struct(*columns).alias("row"))
    one = named.join(kept, F.col("row_id") == F.col("kept_id"), "left_semi").dropDuplicates(["row_id", "row_hash"]).select("row.*")
    return one.unionByName(docs.where("doc_id IS NULL"))
