"""Quality scores by a sparse rule ensemble, compiled into Spark columns.

Statistics of every whole text are computed in the tasks (one row of doubles a document). Small trees, each
grown on a random part of the labelled rows and of the statistics, are taken apart into the conjunctions along
their paths; a logistic regression with an L1 penalty over these rules keeps the few that matter; and the kept
rules become one column expression, which scores all documents.

The classifier is fitted on about ``SAMPLE`` labelled rows, those with a low hash of the id (twice as many at most); rows
whose ``crc32(doc_id) mod 4`` is 2 are held out. Statistics and scores cover every document. Nothing but the
text makes up a score.

Null text counts as empty; texts of any length are read whole. Rows with null or repeated ids each keep their row (a null
id is not held out); equal texts have equal scores. An empty table gives an empty result. Other columns are not read, and
``accepted`` hands them on, whatever their names.
Labels of null quality are left out. Without labels of both kinds every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm._shared import sampled, stored, texts
from docketry.llm._words import SPACED, Words, joined, sliced

SAMPLE = 20_000
TREES, DEPTH, BINS = 60, 3, 24
PENALTY = 0.002
THRESHOLD = 0.7
STATS = (
    "chars", "words", "word_len", "word_len_sd", "distinct", "top_word", "top_3", "repeated", "lines", "line_len", "line_dup", "line_short",
    "punct", "symbol", "digit", "upper", "space", "other", "short_words", "long_words", "no_letter", "end_mark", "stop_len", "entropy",
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|<>{}[]=~^\\_@+/")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?'\"()-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def described(raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The statistics of one text, from its bytes, word hashes and word places in the bytes."""
    out = np.zeros(len(STATS))
    n = len(raw)
    if not n:
        return out
    count = np.bincount(raw, minlength=256)
    chars = n - int(count[128:192].sum())
    size = ends - starts
    m = len(size)
    out[0], out[1] = np.log1p(chars), np.log1p(m)
    p = count[count > 0] / n
    out[23] = -(p * np.log2(p)).sum()
    out[12], out[13], out[14], out[15] = count[_PUNCT].sum() / n, count[_SYMBOL].sum() / n, count[_DIGIT].sum() / n, count[_UPPER].sum() / n
    out[16], out[17] = (count[32] + count[9:14].sum()) / n, count[128:].sum() / n
    cut = np.flatnonzero(raw == 10)
    line = np.diff(np.concatenate([[-1], cut, [n]])) - 1
    out[8], out[9], out[11] = np.log1p(len(line)), np.log1p(line.mean()), (line < 20).mean()
    if m:
        _, times = np.unique(hashes, return_counts=True)
        times = np.sort(times)[::-1]
        out[2], out[3], out[4], out[5], out[6] = size.mean(), size.std(), len(times) / m, times[0] / m, times[:3].sum() / m
        grams = joined(hashes, 3)
        out[7] = 1 - len(np.unique(grams)) / len(grams)
        out[18], out[19] = (size <= 3).mean(), (size > 12).mean()
        letters = np.append(0, np.cumsum(_LETTER[raw]))
        out[20] = (letters[ends] == letters[starts]).mean()
        last = raw[ends - 1]
        out[21] = ((last == 46) | (last == 33) | (last == 63)).mean()
        out[22] = np.median(size)
        if len(line) > 1:
            at = np.searchsorted(starts, np.concatenate([[0], cut + 1, [n]]))
            sums = np.append(np.uint64(0), np.cumsum(hashes))
            keys = (sums[at[1:]] - sums[at[:-1]])[at[1:] > at[:-1]]
            out[10] = 1 - len(np.unique(keys)) / max(1, len(keys))
    return out


def measured(texts_: pa.Array, cache: dict) -> np.ndarray:
    """A row of statistics for each text."""
    out = []
    for part in sliced([pa.RecordBatch.from_arrays([texts_], names=["text"])]):
        w = Words(part.column("text"), SPACED, cache, fold=False)
        rows = np.zeros((part.num_rows, len(STATS)))
        for i in range(part.num_rows):
            a, b = w.first[i], w.first[i + 1]
            rows[i] = described(w.bytes[w.at[i] : w.at[i + 1]], w.hashes[a:b], w.starts[a:b] - w.at[i], w.ends[a:b] - w.at[i])
        out.append(rows)
    return np.round(np.concatenate(out), 9) if out else np.zeros((0, len(STATS)))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every text; of rows that hold both."""

    def run(batches):
        cache: dict = {}
        for batch in batches:
            rows = measured(batch.column("text"), cache)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(rows[:, j]) for j in range(len(STATS))]], names=["doc_id", *STATS])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(s, T.DoubleType()) for s in STATS]]))


def statistics_of(text: Column) -> Column:
    """The same as a struct beside the row: only the text goes to Python, and only numbers come back."""
    cache: dict = {}

    @F.arrow_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
    def run(texts_: pa.Array) -> pa.Array:
        rows = measured(texts_, cache)
        return pa.StructArray.from_arrays([pa.array(rows[:, j]) for j in range(len(STATS))], names=list(STATS))

    return run(text)


Rule = tuple[tuple[int, float, bool], ...]  # (statistic, threshold, whether above it)


def grown(binned: np.ndarray, cuts: list, y: np.ndarray, rows: np.ndarray, usable: np.ndarray, depth: int, path: Rule = ()) -> list[Rule]:
    """Paths to all nodes below the root of a tree that splits by the drop of the squared error."""
    if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
        return []
    best = (1e-9, -1, -1)
    total, n = y[rows].sum(), len(rows)
    for j in usable:
        sums = np.bincount(binned[rows, j], y[rows], len(cuts[j]) + 1).cumsum()[:-1]
        size = np.bincount(binned[rows, j], minlength=len(cuts[j]) + 1).cumsum()[:-1]
        ok = (size >= 5) & (n - size >= 5)
        if ok.any():
            gain = np.where(ok, sums**2 / np.maximum(size, 1) + (total - sums) ** 2 / np.maximum(n - size, 1) - total**2 / n, -1)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), int(j), k))
    _, j, k = best
    if j < 0:
        return []
    above = binned[rows, j] > k
    out = []
    for side in (False, True):
        here = (*path, (j, float(cuts[j][k]), side))
        out += [here, *grown(binned, cuts, y, rows[above == side], usable, depth - 1, here)]
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, t, above in rule:
        out &= (x[:, j] > t) == above
    return out


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, seed: int = 1) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules."""
    if not len(y):
        return 0.0, []
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return base, []
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        rows = rng.choice(len(y), max(20, len(y) // 2), replace=False) if len(y) > 40 else np.arange(len(y))
        usable = rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False)
        for r in grown(binned, cuts, y.astype(float), np.sort(rows), usable, DEPTH):
            rules[r] = None
    table = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
    keep = (table.mean(axis=0) > 0.002) & (table.mean(axis=0) < 0.998)
    table, names = table[:, keep], [r for r, k in zip(rules, keep) if k]
    if not names:
        return base, []
    # proximal gradient steps with momentum; the step is set by the largest curvature of the loss
    v = np.ones(table.shape[1])
    for _ in range(20):
        v = table.T @ (table @ v)
        v /= np.linalg.norm(v)
    step = 4 / max(1e-9, float(np.linalg.norm(table @ v) ** 2) / len(y) + 1)
    w, b, u, c, t = np.zeros(table.shape[1]), base, np.zeros(table.shape[1]), base, 1.0
    for _ in range(500):
        off = 1 / (1 + np.exp(-(table @ u + c))) - y
        new = u - step * (table.T @ off) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * off.mean()
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        u, c = new + (old - 1) / t * (new - w), new_b + (old - 1) / t * (new_b - b)
        w, b = new, new_b
    return float(b), [(r, float(k)) for r, k in zip(names, w) if abs(k) > 1e-4]


def compiled(intercept: float, rules: list[tuple[Rule, float]], prefix: str = "") -> Column:
    """The score as one Spark column over the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        test = F.lit(True)
        for j, t, above in rule:
            c = F.col(f"{prefix}{STATS[j]}")
            test &= (c > t) if above else (c <= t)
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(1 / (1 + F.exp(-total)), 9)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def known(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, quality`` of the labelled rows to learn from: at most twice ``sample`` rows, so they may be broadcast."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("quality IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows.where(~held_out(F.col("doc_id")))
    return sampled(rows, sample, rows.count(), "doc_id")


def learned(stats: DataFrame, labels: DataFrame, sample: int, prefix: str = "") -> Column:
    """The score, learned from ``stats`` (``doc_id`` and statistics) of the labelled rows."""
    rows = stats.join(F.broadcast(known(labels, sample)), "doc_id")
    rows = sampled(rows, 2 * sample, rows.count(), "doc_id", *STATS).toPandas().sort_values(["doc_id", "quality", *STATS])
    return compiled(*fitted(rows[list(STATS)].to_numpy(np.float64), (rows["quality"].to_numpy() > 0.5).astype(float)), prefix)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every text."""
    stats = stored(statistics(texts(docs)), "statistics")
    score = learned(stats, labels, sample)
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score ``THRESHOLD`` or more, as they are."""
    column = "_statistics"
    while column in docs.columns:
        column += "_"
    # the statistics of the rows to learn from alone
    own = stored(statistics(texts(docs).join(F.broadcast(known(labels, sample)).select("doc_id").distinct(), "doc_id", "left_semi")), "statistics")
    score = learned(own, labels, sample, f"{column}.")
    kept = docs.withColumn(column, statistics_of(F.col("text").cast("string"))).where(score >= THRESHOLD)
    return kept.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
