"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions only.

Turns are ordered by ``turn`` (nulls first; ties by role, then text). A window holds turns of its own, the conversation's first system turn
where that came before, and history; all of it counts. The system turn, if it is no larger than half the budget, and the history are
charged first; half of what is left is a unit. Prefix sums of turn tokens choose the windows: a turn of more than a unit is a window of its
own, and the others are cut where their prefix sum passes a multiple of the unit. What is repeated has to fit: history is as many of the
preceding turns as the history budget and the rest of the window allow, and a system turn is left out where it does not fit beside a
single large turn, or is larger than half the budget. So no window passes the budget, but for a single turn that does so alone; it is kept
whole. Loss falls on the texts of a window's own assistant turns only: each assistant text is a target once in the whole output.

A turn is written ``<|im_start|>role LF text<|im_end|> LF``. Inside roles and texts a backslash is written
``\\b`` and ``<|`` is written ``<\\p`` (a line feed in a role: ``\\n``), which plain replacements undo, so no
text can forge a control string.

Null roles and texts count as empty; a null ``conv_id`` is a conversation of its own; repeated rows are turns
like others. An empty table gives an empty result. Columns beyond the four are not read. Nothing but the
digest of a conversation, which the query asks for, ever holds a whole conversation in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 256


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escaped_role(c: Column) -> Column:
    return F.replace(escaped(c), F.lit("\n"), F.lit("\\n"))


def unescaped_role(c: Column) -> Column:
    return unescaped(F.replace(c, F.lit("\\n"), F.lit("\n")))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the bytes, and four for the turn's marks."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), escaped_role(turn["role"]), F.lit("\n"), escaped(turn["text"]), F.lit(END + "\n"))


def formatted(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """One row a window: ``conv_id, window`` (from 0) ``, text, n_repeated`` (leading turns that are repeated)
    ``, loss`` (``array<struct<start, length>>``, code points from 0 into ``text``) ``, n_tokens``."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.withColumn("tokens", F.greatest(tokens(F.col("text")), F.lit(1)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("n", F.row_number().over(order)).withColumn("end", F.sum("tokens").over(sofar)).withColumn("begin", F.col("end") - F.col("tokens"))
    by_n = Window.partitionBy("conv_id").orderBy("n")
    counted = by_n.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_n.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the system turn is the first of its role; a window that comes later repeats it
    item = F.struct("n", "role", "text", "tokens", "begin")
    is_system = F.col("role") == "system"
    charged = F.coalesce(F.first(F.when(is_system, F.col("tokens")), ignorenulls=True).over(whole), F.lit(0))
    charged = F.when(charged <= budget // 2, charged).otherwise(0)
    turns = turns.withColumn("unit", F.greatest(F.lit(1), F.floor((budget - charged - history) / 2)).cast("long"))
    large = F.col("tokens") > F.col("unit")
    cell = F.struct(F.floor(F.col("begin") / F.col("unit")).alias("cell"), large.alias("large"))
    turns = turns.withColumn("cell", cell).withColumn("first", F.coalesce(large | F.lag("cell").over(by_n).isNull() | (F.col("cell") != F.lag("cell").over(by_n)), F.lit(True)))
    turns = turns.withColumn("window", F.sum(F.col("first").cast("long")).over(counted) - 1)
    system = F.first(F.when(is_system, item), ignorenulls=True).over(counted)
    before = Window.partitionBy("conv_id").orderBy("begin").rangeBetween(-history, -1)
    turns = turns.withColumn("system", system).withColumn("before", F.when(F.col("first"), F.collect_list(item).over(before)))
    windows = turns.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(item)).alias("own"), F.sum("tokens").alias("own_tokens"), F.min_by("system", "n").alias("system"), F.min_by("before", "n").alias("before")
    )
    none = F.array().cast("array<struct<n:int,role:string,text:string,tokens:bigint,begin:bigint>>")
    head = F.element_at("own", 1)
    fits = (F.col("system.tokens") <= budget // 2) & (F.col("system.tokens") + F.col("own_tokens") <= budget)
    old = F.coalesce((F.col("system.n") < head["n"]) & fits, F.lit(False))
    windows = windows.withColumn("old", old).withColumn("room", F.least(F.lit(history), budget - F.col("own_tokens") - F.when(F.col("old"), F.col("system.tokens")).otherwise(0)))
    kept = F.filter(F.coalesce("before", none), lambda t: (t["begin"] >= F.element_at("own", 1)["begin"] - F.col("room")) & (~F.col("old") | (t["n"] != F.col("system.n"))))
    repeated = F.concat(F.when(F.col("old"), F.array("system")).otherwise(none), F.sort_array(kept))
    windows = windows.select("conv_id", "window", "own", repeated.alias("repeated"))
    windows = windows.withColumn("pieces", F.transform("own", rendered)).withColumn("head", F.array_join(F.transform("repeated", rendered), ""))
    start = F.length("head").cast("long")
    # where each own turn's text begins and how long it is, by a running length
    state = F.struct(start.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def add(acc, pair):
        turn, piece = pair["own"], pair["pieces"]
        lead = F.lit(len(START) + 1) + F.length(escaped_role(turn["role"]))
        body = F.length(piece) - lead - len(END) - 1
        span = F.struct((acc["at"] + lead).cast("long").alias("start"), body.cast("long").alias("length"))
        return F.struct((acc["at"] + F.length(piece)).cast("long").alias("at"), F.when(turn["role"] == "assistant", F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"]).alias("loss"))

    loss = F.aggregate(F.arrays_zip("own", "pieces"), state, add, lambda acc: acc["loss"])
    used = F.aggregate(F.concat("repeated", "own"), F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"])
    return windows.select("conv_id", "window", F.concat("head", F.array_join("pieces", "")).alias("text"), F.size("repeated").alias("n_repeated"), loss.alias("loss"), used.alias("n_tokens"))


def read_back(windows: DataFrame) -> DataFrame:
    """Adds ``turns`` (``array<struct<role, text>>``: a window's own turns) and ``targets`` (text under the loss mask), both unescaped."""
    pieces = F.slice(F.split("text", r"\Q" + START + r"\E"), F.col("n_repeated") + 2, F.size(F.split("text", r"\Q" + START + r"\E")))

    def turn(p):
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.withColumn("turns", F.transform(pieces, turn)).withColumn("targets", F.array_join(masked, ""))


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's row for each conversation, read back from the formatted windows."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read_back(formatted(conversations)).select(
        "conv_id", F.struct("window", said.alias("said"), "targets").alias("part"), F.size("turns").cast("long").alias("n"), F.length("text").cast("long").alias("chars")
    )
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    turns, loss = F.array_join("parts.said", ""), F.array_join("parts.targets", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
