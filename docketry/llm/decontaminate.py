"""Benchmark decontamination with a distributed positional inverted index.

The index is written once, in shards where the documents lie: a shard holds about half a MB of texts, its distinct terms
in order with their counts, and the positions of each (``indexed``). It serves any number of benchmarks without reading a
text again. For a benchmark, the corpus-wide counts of its terms are summed up over the shards. Then each of its windows
starts from the positions of its rarest term, shifts them by the term's offset, and intersects them with the shifted positions of
its next-rarest terms until nothing is left or the whole window stands. With a slop, each word may stand so many
positions off its place (proximity). No text and no posting is shuffled; what moves is the benchmark's windows, in blocks
of bounded size, and a row for each document and window found.

Null text has no words. A benchmark row without words, or with a null ``item_id``, takes no part; repeated items count
once. Documents with a null or repeated ``doc_id``, and repeated rows, each keep their own row. A text of any length is indexed
whole (a long one is a shard of its own). With an empty benchmark nothing is hit; an empty table gives an empty result. Other
columns of either table are not read, whatever their names; ``clean`` hands them on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import small_batches, stored, texts
from docketry.llm._words import ALNUM, Words, sliced

WINDOW, SLOP = 10, 2
#: Benchmark windows sent to the tasks at once; a larger benchmark goes in more blocks, each a pass over the index.
BLOCK_WINDOWS = 100_000
#: Positions left free between two texts of a shard, so that no window reaches from one into the next.
GAP = 64

#: Bytes of text in a shard, but for a text that is longer alone.
SHARD_BYTES = 1 << 19
SHARD = "doc_ids array<bigint>, n_words array<bigint>, terms binary, counts binary, positions binary"


def shards(batches, cache: dict):
    """Positional indexes of the slices of some batches: ``(slice, words of each text, terms, counts, positions)``."""
    for part in sliced(batches, size=SHARD_BYTES):
        w = Words(part.column("text"), ALNUM, cache)
        size = np.diff(w.first)
        position = np.arange(len(w.hashes)) + np.repeat(np.arange(part.num_rows), size) * GAP + GAP
        by = np.argsort(w.hashes, kind="stable")
        ordered = w.hashes[by]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        yield part, size, ordered[first], np.diff(np.append(first, len(ordered))).astype(np.uint32), position[by].astype(np.uint32)


def indexed(docs: DataFrame) -> DataFrame:
    """The index of a corpus, written once: a row for each shard (``SHARD``), numbered by ``shard``."""
    listed = pa.list_(pa.int64())

    def run(batches):
        cache: dict = {}
        for part, size, *arrays in shards(batches, cache):
            ids = pa.array([part.column("doc_id").to_pylist()], listed)
            yield pa.RecordBatch.from_arrays([ids, pa.array([size.tolist()], listed), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], names=["doc_ids", "n_words", "terms", "counts", "positions"])

    return stored(texts(docs).mapInArrow(run, SHARD).withColumn("shard", F.monotonically_increasing_id()), "index")


def dictionaries(docs: DataFrame) -> DataFrame:
    """The shards' terms and counts alone, not written."""

    def run(batches):
        cache: dict = {}
        for _, _, terms, counts, _ in shards(batches, cache):
            yield pa.RecordBatch.from_arrays([pa.array([terms.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["terms", "counts"])

    return docs.select("text").mapInArrow(run, "terms binary, counts binary")


def item_words(benchmark: DataFrame) -> DataFrame:
    """``item_id`` as string and the word hashes of each benchmark text."""
    out = pa.schema([("item_id", pa.string()), ("words", pa.list_(pa.int64()))])

    def run(batches):
        cache: dict = {}
        for part in sliced(batches):
            w = Words(part.column("text"), ALNUM, cache)
            words = [w.hashes[a:b].view(np.int64) for a, b in zip(w.first, w.first[1:])]
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(words, pa.list_(pa.int64()))], schema=out)

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.where("item_id IS NOT NULL").mapInArrow(run, "item_id string, words array<bigint>").where("size(words) > 0").distinct()


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``window, item_id, words``: runs of ``size`` words of an item, or all of a shorter item; ``window`` names equal runs."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    run = F.transform(starts, lambda i: F.slice("words", i, F.least(F.lit(size), F.size("words"))))
    return items.select("item_id", F.explode(run).alias("words")).distinct().select(F.xxhash64("words").alias("window"), "item_id", "words")


def within(terms: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(begin, end)`` of the postings of each wanted term in a shard; an empty range where it has none."""
    at = np.searchsorted(terms, wanted)
    at[at == len(terms)] = 0
    ends = np.append(0, np.cumsum(counts, dtype=np.int64))
    here = terms[at] == wanted if len(terms) else np.zeros(len(wanted), bool)
    return np.where(here, ends[at], 0), np.where(here, ends[np.minimum(at + 1, len(ends) - 1)], 0)


def term_counts(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Occurrences in the whole corpus of each of the (sorted) terms."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts")):
                begin, end = within(np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32), sent.value)
                total += end - begin
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "n"])

    with small_batches(index.sparkSession):
        found = index.select("terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(wanted), np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


class Block:
    """Windows of the benchmark as term numbers, each with the order from its rarest term to its commonest."""

    def __init__(self, names: np.ndarray, words: list[np.ndarray], count):
        self.terms = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        frequency = count(self.terms)
        self.plans = []
        size = np.array([len(w) for w in words])
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            ids = np.searchsorted(self.terms, np.stack([words[i] for i in which]))
            here = (frequency[ids] > 0).all(axis=1)
            if here.any():
                self.plans.append((names[which[here]], ids[here], np.argsort(frequency[ids[here]], axis=1, kind="stable")))

    def search(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, slop: int):
        """For each plan ``(names, words, window rows, starts)`` of what stands in a shard; starts count from the shard's first position."""
        begin, end = within(terms, counts, self.terms)
        # the postings of the benchmark's terms as one sorted list: term * stride + position
        many = end - begin
        stride = (int(positions.max()) if len(positions) else 0) + 4 * GAP
        of = np.repeat(np.arange(len(self.terms)), many)
        first = np.append(0, np.cumsum(many))
        inner = np.arange(len(of)) - first[of]
        postings = of * stride + positions[begin[of] + inner].astype(np.int64)
        for names, ids, order in self.plans:
            rows = np.arange(len(ids))
            live = rows[(many[ids] > 0).all(axis=1)]
            anchor = order[live, 0]
            term = ids[live, anchor]
            row, offset, term = (np.repeat(x, many[term]) for x in (live, anchor, term))
            nth = np.arange(len(row)) - np.repeat(np.cumsum(many[ids[live, anchor]]) - many[ids[live, anchor]], many[ids[live, anchor]])
            start = postings[first[term] + nth] - term * stride - offset
            if slop:
                row, start = np.repeat(row, 2 * slop + 1), (start[:, None] + np.arange(-slop, slop + 1)).ravel()
            for j in range(1, ids.shape[1]):
                if not len(row):
                    break
                offset = order[row, j]
                want = ids[row, offset] * stride + start + offset
                at = np.searchsorted(postings, want - slop)
                ok = at < len(postings)
                ok[ok] = postings[at[ok]] <= want[ok] + slop
                row, start = row[ok], start[ok]
            yield names, ids, row, start


def blocks_of(index: DataFrame, held: DataFrame, block_windows: int):
    """The benchmark's windows (``window, words``) in blocks of bounded size, ready to be sent."""
    n = max(1, -(-held.count() // block_windows))
    for b in range(n):
        got = held.where(F.pmod("window", F.lit(n)) == b).toArrow()
        words = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in got.column("words")]
        yield Block(got.column("window").to_numpy(), words, lambda terms: term_counts(index, terms) if len(terms) else np.zeros(0, np.int64))


def matches(index: DataFrame, held: DataFrame, slop: int = SLOP, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``shard, nth`` (document of the shard) ``, window, exact`` and ``starts`` (word numbers where it stands exactly) of each window
    that stands in a document exactly or within the slop."""
    out = pa.schema([("shard", pa.int64()), ("nth", pa.int32()), ("window", pa.int64()), ("n", pa.int32()), ("starts", pa.list_(pa.int64()))])
    every = []
    for block in blocks_of(index, held, block_windows):
        sent = index.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                for shard, sizes, *arrays in zip(*(batch.column(c) for c in ("shard", "n_words", "terms", "counts", "positions"))):
                    terms, counts, positions = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(arrays, (np.uint64, np.uint32, np.uint32)))
                    if not len(terms):
                        continue
                    sizes = sizes.values.to_numpy()
                    begins = np.cumsum(sizes) - sizes + (np.arange(len(sizes)) + 1) * GAP
                    # a place of the window lies in its document; with a slop, up to so many positions outside
                    owner = lambda at: np.searchsorted(begins, at, "right") - 1  # noqa: B023, E731
                    found: dict = {}
                    for off in (0, slop) if slop else (0,):
                        for names, ids, row, start in sent.value.search(terms, counts, positions, off):
                            # with a slop a place may lie before its text; words stand less than GAP / 2 from it
                            nth = owner(start + (GAP // 2 if off else 0))
                            for d, i, s in zip(nth.tolist(), row.tolist(), (start - begins[nth]).tolist()):
                                starts = found.setdefault((d, int(names[i])), (ids.shape[1], []))[1]
                                if not off:
                                    starts.append(s)
                    rows = [(shard.as_py(), d, w, n, sorted(set(starts))) for (d, w), (n, starts) in found.items()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], out.field(k).type) for k in range(5)], schema=out)

        every.append(index.mapInArrow(run, "shard bigint, nth int, window bigint, n int, starts array<bigint>"))
    got = every[0]
    for more in every[1:]:
        got = got.unionByName(more)
    return got


def found_in(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row a document of the index: ``doc_id, n_words, n_hit`` (words inside exact matches) ``, items`` (sorted; with a window
    whose words stand consecutively) ``, near_items`` (with one whose words all stand within ``slop`` positions of their
    places, those that stand exactly included) and ``spans`` (hit word ranges)."""
    if size + 2 * slop >= GAP // 2:
        raise ValueError(f"size + 2 * slop must be below {GAP // 2}")
    named = stored(windows(item_words(benchmark), size), "windows")
    held = stored(named.groupBy("window").agg(F.any_value("words").alias("words")), "distinct-windows")
    hits = stored(matches(index, held, slop, block_windows), "matches")
    span = F.transform("starts", lambda s: F.struct(s.alias("start"), (s + F.col("n")).alias("end")))
    spans = hits.where("size(starts) > 0").groupBy("shard", "nth").agg(F.sort_array(F.flatten(F.collect_list(span))).alias("spans"))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(x)))

    spans = spans.withColumn("spans", F.aggregate("spans", empty, add))
    items = hits.join(named.select("window", "item_id"), "window").groupBy("shard", "nth").agg(
        F.sort_array(F.collect_set(F.when(F.size("starts") > 0, F.col("item_id")))).alias("items"), F.sort_array(F.collect_set("item_id")).alias("near_items")
    )
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("nth", "d")).select("shard", "nth", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    rows = rows.join(spans, ["shard", "nth"], "left").join(items, ["shard", "nth"], "left")
    none = F.array().cast("array<string>")
    rows = rows.select("doc_id", "n_words", F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"), F.coalesce("spans", empty).alias("spans"))
    return rows.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"]))


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``found_in`` over an index of ``docs``."""
    return found_in(indexed(docs), benchmark, size, slop, block_windows)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, as they are (``text`` as string).

    A pass over the texts that keeps no index: each task drops its shards when it has searched them.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    held = stored(windows(item_words(benchmark), size).groupBy("window").agg(F.any_value("words").alias("words")), "distinct-windows")
    for block in blocks_of(dictionaries(docs), held, block_windows):
        docs = docs.where(~is_hit(docs.sparkSession.sparkContext.broadcast(block))(F.col("text")))
    return docs


def is_hit(sent):
    """A function of texts: whether a window of the block stands in one."""
    cache: dict = {}

    @F.arrow_udf("boolean")
    def run(texts_: pa.Array) -> pa.Array:
        out, done = np.zeros(len(texts_), bool), 0
        for part, size, terms, counts, positions in shards([pa.RecordBatch.from_arrays([texts_], names=["text"])], cache):
            begins = np.cumsum(size) - size + (np.arange(len(size)) + 1) * GAP
            for _, _, _, start in sent.value.search(terms, counts, positions, 0):
                out[done + np.searchsorted(begins, start, "right") - 1] = True
            done += part.num_rows
        return pa.array(out)

    return run


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, and ``n_near`` (items near or exact)."""
    return find(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near"),
    )
