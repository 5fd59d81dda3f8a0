"""License detection by ordered signature rules, with DataFrame functions only.

Texts are lower-cased (A-Z) and turned into words. A prefilter (one alternation of the rules' keywords, each of
which begins a word of every match of its rules) lets few texts through; for these, the rules of the keywords
that occur are run. A rule is a regular expression over the words joined by single spaces, with a label and a
priority; its matches are leftmost and do not overlap each other. A match that lies within another one's interval
is suppressed if that one has the higher priority, or the same and is longer, or is the same interval under an earlier
rule. What is left gives the labels. Three base phrases are found in every text, whatever the rules do, and their
labels are never suppressed.

Matches are rows: their places are running sums over the pieces that a rule cuts a text into, and suppression compares each with
running maxima of what begins before it. So the work grows with the text (and a sort of its matches), however often it repeats itself.

Null text counts as empty: no words, no labels, score 0. Rows with null or repeated ids, and repeated rows, each keep their row;
no other column is read, whatever its name; texts of any length are scanned whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm._license_rules import rules
from docketry.llm._shared import texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Stands around matches while a text is cut; no word holds it.
MARK = "\u0001"


def gate(keywords: list[str]) -> str:
    """One expression for all keywords at the beginnings of words, as a tree of their letters."""
    tree: dict = {}
    for k in keywords:
        at = tree
        for c in k:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(at: dict) -> str:
        if "" in at:
            return ""
        ways = [c + written(below) for c, below in sorted(at.items())]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return " " + written(tree)


def phrase(words: str) -> str:
    return " " + "  ".join(words.split()) + " "


def words_in(spaced: Column) -> Column:
    """Words of a text in which each word has a space of its own on either side."""
    return ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def cut(words: Column, table: list) -> Column:
    """``array<struct<rule, priority, label, sizes>>`` of the rules that match: sizes of the pieces before, in and between its matches."""
    groups: dict = {}
    for i, (label, priority, keyword, pattern) in enumerate(table):
        rule = F.struct(F.lit(i).alias("rule"), F.lit(priority).alias("priority"), F.lit(label).alias("label"), F.lit(f"(?<= )({pattern})(?= )").alias("pattern"))
        groups.setdefault(keyword, []).append(rule)
    groups = F.array(*[F.struct(F.lit(f" {k}").alias("keyword"), F.array(*r).alias("rules")) for k, r in groups.items()])
    tried = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(words, g["keyword"])), lambda g: g["rules"]))
    pieces = lambda r: F.transform(F.split(F.regexp_replace(words, r["pattern"], F.lit(f"{MARK}$1{MARK}")), MARK, -1), F.length)
    found = F.transform(tried, lambda r: F.struct(r["rule"].alias("rule"), r["priority"].alias("priority"), r["label"].alias("label"), pieces(r).alias("sizes")))
    return F.filter(found, lambda r: F.size(r["sizes"]) > 1)


def placed(rows: DataFrame) -> DataFrame:
    """A row for each match, ``start`` and ``end`` (code points) beside ``rule, priority, label``; one without them for a text without any."""
    rows = rows.withColumn("found", F.explode_outer("found")).select("*", "found.*").drop("found")
    rows = rows.select("*", F.posexplode_outer("sizes").alias("piece", "size")).drop("sizes").repartition("at")
    before = Window.partitionBy("at", "rule").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.sum("size").over(before)).withColumn("end", F.col("start") + F.col("size"))
    # matches are the pieces at odd places; the first piece of each rule goes with the others, but one stays where a text has none
    return rows.where("piece IS NULL OR piece % 2 = 1").drop("piece", "size")


def kept(rows: DataFrame, levels: list[int]) -> DataFrame:
    """The matches that no stronger one contains."""
    through = Window.partitionBy("at").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    higher = [F.when(F.col("priority") == p, F.max(F.when(F.col("priority") > p, F.col("end"))).over(through)) for p in levels]
    own = Window.partitionBy("at", "priority")
    rows = rows.withColumns({
        "higher": F.coalesce(*higher),
        "earlier": F.max("end").over(own.orderBy("start").rangeBetween(Window.unboundedPreceding, -1)),
        "longest": F.max("end").over(Window.partitionBy("at", "priority", "start")),
        "same": F.min("rule").over(Window.partitionBy("at", "priority", "start", "end")),
    })
    weaker = (F.col("higher") >= F.col("end")) | (F.col("earlier") >= F.col("end")) | (F.col("longest") > F.col("end")) | (F.col("same") < F.col("rule"))
    return rows.where(F.col("rule").isNull() | ~F.coalesce(weaker, F.lit(False))).drop("higher", "earlier", "longest", "same")


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections`` of every text.

    ``detections`` (``array<struct<start, end, priority, rule, label>>``) are code points in the words joined by
    single spaces, with one space before and after.
    """
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = texts(docs).select("doc_id", F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")).alias("trimmed"))
    rows = rows.select("doc_id", F.when(F.col("trimmed") == "", F.lit("")).otherwise(F.concat(F.lit(" "), "trimmed", F.lit(" "))).alias("spaced"))
    rows = rows.withColumn("n_words", words_in(F.col("spaced")))
    spaced, n, counts, firsts, lasts = F.col("spaced"), {}, [], [], []
    for text, label in BASE.items():
        needle = F.lit(phrase(text))
        many = F.when(F.contains(spaced, needle), ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, needle, F.lit("")))) / F.octet_length(needle)).cast("long")).otherwise(F.lit(0).cast("long"))
        n[label] = F.contains(spaced, needle)
        counts.append(many)
        firsts.append(F.when(n[label], words_in(F.substring_index(spaced, phrase(text), 1))))
        lasts.append(F.when(n[label], F.col("n_words") - words_in(F.substring_index(spaced, phrase(text), -1)) - len(text.split())))
    base = F.array_compact(F.array(*[F.when(n[label], F.lit(label)) for label in BASE.values()]))
    table = rules()
    none = F.array().cast("array<struct<rule:int,priority:int,label:string,sizes:array<int>>>")
    own = F.struct("doc_id", "n_words", sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), base.alias("base"))
    rows = rows.select(own.alias("own"), F.replace(spaced, F.lit("  "), F.lit(" ")).alias("words"), F.monotonically_increasing_id().alias("at"))
    passed = F.col("words").rlike(gate(sorted({keyword for _, _, keyword, _ in table})))
    rows = rows.select("at", "own", F.when(passed, cut(F.col("words"), table)).otherwise(none).alias("found"))
    rows = kept(placed(rows), sorted({priority for _, priority, _, _ in table}))
    match = F.struct("start", "end", "priority", "rule", "label")
    rows = rows.groupBy("at").agg(F.any_value("own").alias("own"), F.sort_array(F.collect_list(F.when(F.col("rule").isNotNull(), match))).alias("detections")).select("own.*", "detections")
    top = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])) / 100.0, F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"])))), ",").alias("labels"),
        F.greatest(top, F.when(F.col("n_base") > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
        "detections",
    )
