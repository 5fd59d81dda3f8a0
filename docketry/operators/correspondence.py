"""Chat history, reply letters, and the grading of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import letters as L
from docketry.functions import text as X

NEEDS_REASON = ("red", "kismi_onay", "eksik_belge")


# chat: messages are ``document_id, seq, role, content``


def chat_history(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of each document; ``place`` 1 is the oldest of them."""
    last = messages.withColumn("back", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("seq")))).where(F.col("back") <= n)
    return last.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("seq"))).drop("back")


def chat_exchanges(messages: DataFrame) -> DataFrame:
    """Questions with the answer that follows at once; a question without one is left out."""
    order = Window.partitionBy("document_id").orderBy("seq")
    rows = messages.withColumn("next_role", F.lead("role").over(order)).withColumn("answer", F.lead("content").over(order))
    return rows.where("role = 'user' AND next_role = 'assistant'").select("document_id", "seq", F.col("content").alias("question"), "answer")


def append_exchange(messages: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Adds ``document_id, question, answer`` as two messages each, or none where the answer is empty."""
    last = messages.groupBy("document_id").agg(F.max("seq").alias("last"))
    kept = exchanges.where("trim(answer) <> ''").withColumn("nth", F.row_number().over(Window.partitionBy("document_id").orderBy("question", "answer")))
    rows = kept.join(last, "document_id", "left").withColumn("base", F.coalesce("last", F.lit(0)) + (F.col("nth") - 1) * 2)
    pair = F.array(F.struct((F.col("base") + 1).alias("seq"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct((F.col("base") + 2).alias("seq"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return messages.select("document_id", "seq", "role", "content").unionByName(rows.select("document_id", F.explode(pair).alias("m")).select("document_id", F.col("m.seq").cast("bigint").alias("seq"), "m.role", "m.content"))


def tag_messages(messages: DataFrame) -> DataFrame:
    folded = X.tr_normalize(F.col("content"))
    return messages.withColumn("may_ask_letter", folded.rlike("|".join(X.LETTER_STEMS))).withColumn("asks_routing", folded.rlike("|".join(X.ROUTING_STEMS)))


def document_record(docs: DataFrame) -> DataFrame:
    """``id, record``: what is known of a document, as labelled lines; empty fields are left out."""
    line = lambda label, c: F.when(F.trim(c) != "", F.concat(F.lit(f"- {label}: "), F.trim(c)))
    many = lambda label, c: line(label, F.array_join(c, " · "))
    state = F.create_map(*[F.lit(x) for x in ("new", "yeni geldi", "routed", "servise yonlendirildi", "in_progress", "uzerinde calisiliyor", "completed", "tamamlandi")])
    kind = lambda f: F.when(f["kind"] == "eksik", "Eksik").otherwise("Tutarsizlik")
    quote = lambda f: F.when(f["quote"] != "", F.concat(F.lit(' (belgeden: "'), F.trim(F.regexp_replace(f["quote"], r"\s+", " ")), F.lit('")'))).otherwise("")
    found = F.transform("findings", lambda f: F.concat(F.lit("  · ["), f["severity"], F.lit("] "), kind(f), F.lit(": "), f["title"], F.lit(" — "), f["explanation"], quote(f)))
    gaps = F.when(F.size("findings") > 0, F.concat(F.lit("- Eksik bilgi taramasinin bulgulari:\n"), F.array_join(found, "\n"))).when(F.col("findings").isNotNull(), "- Eksik bilgi taramasi yapildi, eksik ya da celiskili bilgi bulunmadi.")
    routed = F.when(F.col("service") != "", F.concat(F.lit("- Yonlendirilen servis: "), "service", F.coalesce(F.concat(F.lit(" ("), "unit", F.lit(")")), F.lit("")))).otherwise("- Yonlendirme: servis belirlenemedi, evrak manuel inceleme bekliyor")
    return docs.select(
        "id",
        F.concat_ws(
            "\n", F.concat(F.lit("- Dosya: "), "filename"), line("Evrak tipi", F.col("doc_type")), line("Konu", F.col("subject")), line("Ozet", F.col("summary")), line("VKN", F.col("vkn")), line("TCKN", F.col("tckn")), many("Kisi/Kurum", F.col("people")),
            line("Is akisi durumu", F.coalesce(F.try_element_at(state, F.col("lifecycle_status")), F.col("lifecycle_status"))), gaps, routed, F.concat(F.lit("- Yonlendirme guven skoru: "), F.col("confidence").cast("string")), line("Yonlendirme gerekcesi", F.col("reasoning")),
        ).alias("record"),
    )


# letters: ``id, document_id, decision, created_at``


def letters_by_document(letters: DataFrame) -> DataFrame:
    """Letters with their place, the newest of each document first."""
    return letters.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id"))))


def assign_letter_numbers(letters: DataFrame, start: int = 1, unit: str = "day") -> DataFrame:
    """Consecutive ``letter_no`` for saved letters in order of creation; previews get none.

    Letters are counted by the ``unit`` of time they were made in, which is a value of theirs, and numbered within it: no task
    sees all letters, and the counts belong to the rows however often either is computed.
    """
    made = F.coalesce(F.date_trunc(unit, "created_at"), F.lit("0001-01-01").cast("timestamp"))
    saved = letters.where("saved").withColumn("part", made)
    local = saved.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("created_at", "id")))
    # one row a unit of time: their running sum is small, whatever the number of letters
    sizes = saved.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = local.join(offsets, "part").withColumn("letter_no", (F.col("before") + F.col("nth") + start - 1).cast("bigint")).drop("part", "nth", "before")
    return numbered.unionByName(letters.where("NOT coalesce(saved, false)").withColumn("letter_no", F.lit(None).cast("bigint")))


def number_source(df: DataFrame) -> DataFrame:
    """Adds ``source``: all text that a reply's numbers may come from."""
    lists = F.array_join(F.flatten(F.array("dates", "amounts", "periods", "plates", "people")), "\n")
    articles = F.array_join(F.flatten(F.transform("citations", lambda c: F.array(c["article_no"], c["title"]))), "\n")
    return df.withColumn("source", F.concat_ws("\n", "subject", "summary", "receivable", lists, "vkn", "tckn", articles, "reason", "text"))


def select_draft(attempts: DataFrame) -> DataFrame:
    """The first of a document's attempts (``document_id, attempt, decision, human_reason, references, paragraphs,
    model_reason, source``) whose numbers are all supported, else the last valid one; without a valid one, no row.

    A person's reason comes before the model's; decisions that need a reason are invalid without one, others carry none.
    """
    rows = attempts.withColumn("references", X.normalize_lines(F.col("references"))).withColumn("paragraphs", X.normalize_lines(F.col("paragraphs")))
    given = F.coalesce(F.when(F.trim("human_reason") != "", F.trim("human_reason")), X.normalize_line(F.col("model_reason")), F.lit(""))
    needs = F.col("decision").isin(*NEEDS_REASON)
    rows = rows.withColumn("reason", F.when(needs, given).otherwise("")).where(~needs | (given != ""))
    body = F.concat_ws("\n", F.array_join("references", "\n"), F.array_join("paragraphs", "\n"), "reason")
    rows = rows.withColumn("unsupported", X.unsupported_numbers(body, F.col("source")))
    clean = F.size("unsupported") == 0
    order = Window.partitionBy("document_id").orderBy(clean.desc(), F.when(clean, F.col("attempt")).otherwise(-F.col("attempt")))
    return rows.withColumn("pick", F.row_number().over(order)).where("pick = 1").drop("pick", "human_reason", "model_reason", "source")


def build_letters(df: DataFrame, institution: dict[str, str]) -> DataFrame:
    """Letter fields from ``document_id, title, subject, people, vkn, tckn, decision, service, form_name, form_kind,
    form_number, letter_no, letter_date``."""
    to_court = X.is_dispute(F.col("service"))
    rows = df.withColumn("to", L.recipient(F.col("form_name"), F.col("form_kind"), F.col("form_number"), F.col("people"), F.col("vkn"), F.col("tckn"), to_court))
    return rows.select(
        "document_id", L.letter_number(institution, "letter_no").alias("number"), F.date_format("letter_date", "dd.MM.yyyy").alias("date"), L.subject_line(F.col("title"), F.col("subject")).alias("subject"),
        F.col("to.name").alias("recipient"), F.col("to.kind").alias("recipient_kind"), F.col("to.number").alias("recipient_number"), L.address_line(F.col("to.name"), F.col("to.kind")).alias("address_line"),
        L.closing(F.col("decision"), F.col("to.kind"), to_court).alias("closing"), L.missing_fields(institution, F.col("to.missing")).alias("missing"),
    )


# evaluation: golden ``id, scenario, expected_docs, expected, forbidden``; answers ``target, id, answer, sources, error``


#: Questions of a golden set that meet a target in one group.
QUESTIONS = 256


def grade_answers(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """One row a question and target. NULL is not measured; a failed answer fails what is measured, but for forbidden phrases.

    Every target is asked every question of the set, in parts of ``QUESTIONS`` questions, by which they are joined.
    """
    parts = max(1, -(-golden.count() // QUESTIONS))
    targets = answers.select("target").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = golden.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    rows = targets.join(asked, "part").drop("part").join(answers, ["target", "id"], "left")
    ok, low = F.col("answer").isNotNull() & F.col("error").isNull(), X.tr_lower(F.col("answer"))
    holds = lambda p: F.contains(low, X.tr_lower(p))
    source = F.exists("expected_docs", lambda d: F.exists("sources", lambda s: F.contains(X.tr_lower(s), X.tr_lower(d))))
    measured = lambda when, value: F.when(when, F.coalesce(ok & value, F.lit(False)))
    return rows.select(
        "target", "id", "scenario", measured(F.size("expected_docs") > 0, source).alias("source_hit"), measured(F.col("scenario") == "trap", X.is_not_found(F.col("answer"))).alias("trap_passed"),
        measured(F.size("expected") > 0, F.forall("expected", holds)).alias("answer_hit"), F.when(ok & (F.coalesce(F.size("forbidden"), F.lit(0)) > 0), F.exists("forbidden", holds)).alias("forbidden_hit"),
        F.when(ok, F.replace(F.substring("answer", 1, 80), F.lit("\n"), F.lit(" "))).otherwise(F.concat(F.lit("HATA: "), F.coalesce("error", F.lit("cevap yok")))).alias("snippet"),
    )


def summarize_eval(graded: DataFrame, *keys: str) -> DataFrame:
    """Rates over what was measured; with nothing measured 0, and 1 for forbidden phrases."""
    rate = lambda c, default: F.round(F.coalesce(F.avg(F.col(c).cast("int")), F.lit(default)), 6)
    return graded.groupBy(*keys).agg(rate("source_hit", 0.0).alias("source_rate"), rate("trap_passed", 0.0).alias("trap_rate"), rate("answer_hit", 0.0).alias("answer_rate"), F.round(F.coalesce(1 - F.avg(F.col("forbidden_hit").cast("int")), F.lit(1.0)), 6).alias("clean_rate"))


def compare_targets(graded: DataFrame) -> DataFrame:
    return summarize_eval(graded, "target")
