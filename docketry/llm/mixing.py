"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are put in a random but fixed order and cut into blocks. Shares are exact at any size of the table: at a
virtual time v a source has been due ``weight * v`` blocks, or all it has; the slot in which v falls is the sum of that over all sources, so a source
that runs dry leaves its slots to the others by their weights. A source's block j (from 0) is released at the slot in which it begins to be due
(rounded down) and must be served before the slot in which it is due whole (rounded up), and each slot goes to the released
block with the earliest deadline (ties: the earlier release, then the source's name, then the block). What is due adds up to one block a slot, so all
deadlines are met: after any number of slots, a source is less than one block away from its exact share.

Periods of ``PERIOD`` slots are scheduled side by side. A period has to know which of the blocks whose windows reach into it were served
before. It first takes those with the earliest deadlines, as many as the exact shares say; where the period before ends otherwise, it is run
again, until each begins where the one before ends. That is the one schedule over all slots: each round settles one more period at least, and
as a period holds many windows of most sources, few rounds change anything. Every document is placed once, none is dropped or
repeated; nothing goes through the driver, and the number of sources has no bound.

The order within a source comes from hash buckets of id and text: their counts, summed up, give each bucket its first rank, and
only a bucket is ever sorted in one task. So a source with a third of all rows is dealt to many tasks. Whole rows are shuffled once.

A source without a weight gets ``default_weight``; a null source counts as a source of its own. Rows with null or repeated
ids keep a place each; rows that are alike in id and text are in one bucket, and which of them comes first is left
open. Texts of any length go along as they are. Weights must be positive. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm._shared import discarded, stored

BLOCK = 16
#: Slots of a period: what one task schedules at a time.
PERIOD = 1 << 17
#: Documents that one hash bucket of a source should hold, and rows of one range of the virtual time.
BUCKET_ROWS, RANGE_BLOCKS = 2000, 1 << 16
NO_SOURCE = "\u0000"


def source_of(docs: DataFrame):
    return F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))


def tempered(docs: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Target weights ``source, weight`` (``count ** alpha``) from the sizes of all sources."""
    return docs.groupBy(source_of(docs).alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(alpha)).alias("weight"))


def shares(blocks: DataFrame) -> DataFrame:
    """``source, block, size, release, due`` of every block (``source, block, size, weight, last``): the slots of its window.

    At a virtual time v that all sources share, a source has been due ``min(its blocks, weight * v)``; the sum over all sources is the slot in which v
    falls. It needs the sources that have run dry before v (their blocks) and those that have not (their weights): sums in the order of v, kept
    by ranges of v, so nothing of it depends on the number of sources.
    """
    ends = F.array(F.struct(F.col("block").alias("at"), F.lit(0).alias("end")), F.struct((F.col("block") + 1).alias("at"), F.lit(1).alias("end")))
    rows = blocks.select("*", F.explode(ends).alias("e")).select("source", "block", "size", "weight", "e.end", (F.col("e.at") / F.col("weight")).alias("v"), F.when(F.col("last") & (F.col("e.end") == 1), F.col("e.at")).alias("dry"))
    order = ["v", "source", "block", "end"]
    parts = max(1, -(-2 * blocks.count() // RANGE_BLOCKS))
    # written with their ranges, as the bounds of ranges are drawn anew each time they are asked for
    ranges = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("part").agg(F.coalesce(F.sum("dry"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("dry").isNotNull(), F.col("weight"))), F.lit(0.0)).alias("w"))
    # a row for each 65536 rows; weights are summed up from the end, so that what is left is never a small difference of large sums
    before, after = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("w").over(after), F.lit(0.0)).alias("w_after"))
    up, down = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("part").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = F.col("n_before") + F.coalesce(F.sum("dry").over(up), F.lit(0))
    left = F.col("w_after") + F.coalesce(F.sum(F.when(F.col("dry").isNotNull(), F.col("weight"))).over(down), F.lit(0.0))
    slot = done + F.col("v") * left
    slack = F.greatest(F.lit(1e-6), slot * 1e-13)
    edge = F.when(F.col("end") == 0, F.floor(slot + slack)).otherwise(F.ceil(slot - slack))
    edges = ranges.join(sums, "part").select("source", "block", "size", "end", edge.cast("long").alias("edge"))
    return edges.groupBy("source", "block").agg(F.max("size").alias("size"), F.min(F.when(F.col("end") == 0, F.col("edge"))).alias("release"), F.max(F.when(F.col("end") == 1, F.col("edge"))).alias("due"))


def earliest_first(jobs: list[tuple[int, int, str, int]], begin: int, end: int) -> list[int]:
    """For the slots ``begin .. end - 1``: which of the jobs ``(due, release, source, block)`` has it, the released one that is due first."""
    order = sorted(range(len(jobs)), key=lambda i: jobs[i][1])
    released: list = []
    out, at = [], 0
    for t in range(begin, end):
        while at < len(order) and jobs[order[at]][1] <= t:
            heapq.heappush(released, (jobs[order[at]], order[at]))
            at += 1
        if not released:
            break
        out.append(heapq.heappop(released)[1])
    return out


RAN = "period long, source string, block long, size long, release long, due long, done boolean, slot long"


def slots_of(blocks: DataFrame, period: int) -> DataFrame:
    """``source, block, slot, position`` of every block (``source, block, size, weight, last``)."""
    windows = stored(shares(blocks), "windows")
    turn = F.explode(F.sequence(F.floor(F.col("release") / period), F.floor((F.col("due") - 1) / period))).alias("period")
    jobs = windows.select(turn, "*").withColumn("came", F.col("release") < F.col("period") * period)
    # how many of the blocks that a period takes over have been served: the slots before it, less the blocks that were due by then
    due = windows.groupBy(F.ceil(F.col("due") / period).alias("period")).agg(F.count("*").alias("n"))
    due = due.select("period", F.sum("n").over(Window.orderBy("period")).alias("served"))  # a row for each period
    rank = F.row_number().over(Window.partitionBy("period", "came").orderBy("due", "release", "source", "block"))
    jobs = jobs.join(due, "period", "left").withColumn("done", F.col("came") & (rank <= F.col("period") * period - F.coalesce("served", F.lit(0))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        begin = int(rows["period"].iloc[0]) * period
        open_ = rows[~rows["done"]]
        served = earliest_first(list(zip(open_["due"].tolist(), open_["release"].tolist(), open_["source"].tolist(), open_["block"].tolist())), begin, begin + period)
        slot = pd.Series(pd.array([None] * len(rows), "Int64"), index=rows.index)
        slot.loc[open_.index[served]] = range(begin, begin + len(served))
        return rows.assign(slot=slot)[["period", "source", "block", "size", "release", "due", "done", "slot"]]

    kept = ["period", "source", "block", "size", "release", "due", "done"]
    ran = stored(jobs.select(*kept).groupBy("period").applyInPandas(run, RAN), "ran")
    while True:
        # a period begins where the one before it ends; those that began elsewhere are run again
        ends = ran.select((F.col("period") + 1).alias("period"), "source", "block", (F.col("done") | F.col("slot").isNotNull()).alias("ended"))
        began = ran.join(ends, ["period", "source", "block"], "left").withColumn("ended", F.coalesce("ended", F.lit(False)))
        wrong = stored(began.where("ended <> done").select("period").distinct(), "wrong")
        if wrong.isEmpty():
            break
        again = began.join(wrong, "period", "left_semi").withColumn("done", F.col("ended")).select(*kept)
        before, ran = ran, stored(ran.join(wrong, "period", "left_anti").unionByName(again.groupBy("period").applyInPandas(run, RAN)), "ran")
        discarded(before)
    late = F.when(F.col("slot") < F.col("due"), F.col("slot")).otherwise(F.raise_error(F.lit("a deadline was missed")).cast("long"))
    turns = ran.where("slot IS NOT NULL").select("source", "block", "size", "period", late.alias("slot"))
    sizes = turns.groupBy("period").agg(F.sum("size").alias("n"))
    begins = sizes.select("period", (F.sum("n").over(Window.orderBy("period")) - F.col("n")).alias("begin"))  # a row for each period
    ahead = F.sum("size").over(Window.partitionBy("period").orderBy("slot")) - F.col("size")
    return turns.withColumn("ahead", ahead).join(begins, "period").select("source", "block", "slot", (F.col("begin") + F.col("ahead")).alias("position"))


def mixed(docs: DataFrame, weights: DataFrame | Mapping[str, float], block: int = BLOCK, period: int = PERIOD, default_weight: float = 1.0) -> DataFrame:
    """All rows of ``docs`` (``doc_id, text, source`` and what else it has) with their place in the mix.

    ``weights`` is ``source, weight`` or a mapping; it may name the null source ``NO_SOURCE``. Adds ``mix_block`` (long: which
    block of its source), ``mix_slot`` (long: the block's slot) and ``mix_position`` (long: dense position of the row in
    the whole mix). Reading in order of ``mix_position`` gives the mix. Input columns of these names are replaced.
    """
    spark = docs.sparkSession
    if not isinstance(weights, DataFrame):
        weights = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double")
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    hashed = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(5))
    return placed(docs.select(F.struct(*kept).alias("row"), source_of(docs).alias("source"), hashed.alias("hash")), weights, block, period, default_weight).select("row.*", "mix_block", "mix_slot", "mix_position")


def placed(rows: DataFrame, weights: DataFrame, block: int = BLOCK, period: int = PERIOD, default_weight: float = 1.0) -> DataFrame:
    """``rows`` (``source`` not null, ``hash`` long, and what else it has) with ``mix_block, mix_slot, mix_position``."""
    keys = rows.select("source", "hash")
    buckets = max(64, -(-keys.count() // BUCKET_ROWS))
    bucket = F.pmod("hash", F.lit(buckets)).alias("bucket")
    counts = stored(keys.groupBy("source", bucket).agg(F.count("*").alias("n")), "counts")
    by_source = Window.partitionBy("source")
    begins = counts.select("source", "bucket", "n", F.sum("n").over(by_source.orderBy("bucket")).alias("end"), F.sum("n").over(by_source).alias("size"))
    begins = stored(begins.withColumn("before", F.col("end") - F.col("n")), "begins")

    # a block belongs to the bucket that holds its first document, and reaches into the following ones
    first, last = F.ceil(F.col("before") / block), F.ceil(F.col("end") / block) - 1
    weights = weights.groupBy("source").agg(F.max(F.col("weight").cast("double")).alias("weight"))
    blocks = begins.where(first <= last).select("source", "size", F.explode(F.sequence(first, last)).alias("block")).join(weights, "source", "left")
    weight = F.coalesce("weight", F.lit(float(default_weight)))
    weight = F.when(weight > 0, weight).otherwise(F.raise_error(F.lit("weights must be positive")).cast("double"))
    own = F.col("size") - F.col("block") * block
    slots = stored(slots_of(stored(blocks.select("source", "block", F.least(F.lit(block), own).alias("size"), weight.alias("weight"), (own <= block).alias("last")), "blocks"), period), "slots")

    # each bucket with the places of its blocks, in order
    held = begins.select("source", "bucket", "before", F.explode(F.sequence(F.floor(F.col("before") / block), last)).alias("block")).join(slots, ["source", "block"])
    held = held.groupBy("source", "bucket").agg(F.first("before").alias("before"), F.sort_array(F.collect_list(F.struct("block", "slot", "position"))).alias("blocks"))
    ranked = rows.withColumn("bucket", bucket).withColumn("nth", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("hash")) - 1)
    out = ranked.join(held, ["source", "bucket"]).withColumn("rank", F.col("before") + F.col("nth")).withColumn("mix_block", F.floor(F.col("rank") / block).cast("long"))
    place = F.element_at("blocks", (F.col("mix_block") - F.floor(F.col("before") / block) + 1).cast("int"))
    return out.withColumn("mix_slot", place["slot"]).withColumn("mix_position", place["position"] + F.col("rank") % block).drop("bucket", "nth", "before", "blocks", "rank")
