"""Checking routing decisions, which a model made, against the regulation that they cite.

``decisions``: ``decision_id, main_unit, other_unit, service, sub_service, citations array<struct<article_no,title>>,
confidence, undetermined, reasoning``. ``hits``: ``decision_id, rank, article_no, service, service_no, unit, sub_unit,
certain`` (few for each decision).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as X

CITATIONS = "array<struct<article_no:string,title:string>>"
# Unit names by what is written in the folded heading or service name.
MAIN_UNITS = (("vergilendirme", "Vergilendirme"), ("muhasebe", "Muhasebe"), ("kovusturma", "Kovusturma"), ("tarama ve kontrol", "Tarama ve Kontrol"))
OTHER_UNITS = (("vergi denetmenleri", "Vergi Denetmenleri"), ("takdir", "Takdir"), ("uzlasma", "Uzlasma"), ("ozluk", "Ozluk ve Destek"), ("^gelir servisi", "Gelir"))
# The messages that stored decisions carry.
NOT_DETERMINED = "belirlenemedi — manuel inceleme gerekli"
NO_CITATION = "Karar hicbir yonetmelik maddesine dayandirilmadi."
UNKNOWN_ARTICLES = ("Kararin dayandirildigi madde(ler) (", ") getirilen yonetmelik parcalarinda bulunmadi; dogrulanamayan atifla servis atamasi yapilmadi.")
ENTRY_POINT = " evrakin giris noktasidir (kayit ve sevk gorevi), yonlendirme hedefi degildir; evrakin ait oldugu asil servis yonetmelikte bulunamadi."
ENTRY_POINT_HIT = " evrakin giris noktasidir, yonlendirme hedefi degildir."
OUTSIDE = ('\n\n[Otomatik kontrol] Karar "', '" adını gösteriyor; yönetmelik kataloğunda böyle bir servis yok. Evrak manuel incelemeye alındı.')


def undetermined(df: DataFrame, when: Column, reason: Column) -> DataFrame:
    """Takes all assignment away from the rows where ``when`` holds."""
    df = df.withColumn("falls", F.coalesce(when, F.lit(False))).withColumn("why", reason)
    falls = F.col("falls")
    gone = {c: F.when(~falls, F.col(c)) for c in ("main_unit", "other_unit", "service", "sub_service")}
    return df.withColumns(
        gone
        | {
            "reasoning": F.when(falls, F.col("why")).otherwise(F.col("reasoning")),
            "citations": F.when(falls, F.expr(f"cast(array() as {CITATIONS})")).otherwise(F.col("citations")),
            "confidence": F.when(falls, 0.0).otherwise(F.col("confidence")),
            "undetermined": falls | F.col("undetermined"),
        }
    ).drop("falls", "why")


def service_catalog(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row a service of the regulations, from its lowest article number (as text)."""
    own = chunks.where("kind = 'child' AND metadata.service IS NOT NULL").join(docs.where("corpus = 'regulations'").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return own.groupBy(F.col("metadata.service").alias("service")).agg(F.min(F.struct("metadata.article_no", "metadata.unit", "metadata.sub_unit")).alias("m")).select("service", F.col("m.unit").alias("unit"), F.col("m.sub_unit").alias("sub_unit"), F.col("m.article_no").alias("article_no"))


def verify_citations(decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """Only articles among the hits may be cited; a decision left without one is undetermined. Adds ``invented``."""
    known = hits.where("article_no <> ''").groupBy("decision_id").agg(F.collect_set(X.article_number(F.col("article_no"))).alias("known"))
    rows = decisions.join(known, "decision_id", "left").withColumn("known", F.coalesce("known", X.strings()))
    real = F.filter("citations", lambda c: F.array_contains(F.col("known"), X.article_number(c["article_no"])))
    invented = F.transform(F.filter("citations", lambda c: ~F.array_contains(F.col("known"), X.article_number(c["article_no"]))), lambda c: c["article_no"])
    open_ = ~F.col("undetermined")
    rows = rows.withColumn("invented", F.when(open_, invented).otherwise(X.strings())).withColumn("citations", F.when(open_, real).otherwise(F.col("citations")))
    listed = F.concat(F.lit(UNKNOWN_ARTICLES[0]), F.array_join("invented", ", "), F.lit(UNKNOWN_ARTICLES[1]))
    return undetermined(rows, open_ & (F.size("citations") == 0), F.when(F.size("invented") > 0, listed).otherwise(F.lit(NO_CITATION))).drop("known")


def cited_services(decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """``decision_id, services``: those whose hits a citation path names."""
    path = decisions.where("NOT undetermined").select("decision_id", F.explode("citations").alias("c")).select("decision_id", X.parse_citation(F.col("c.article_no")).alias("p"))
    paths = path.where("p.service IS NOT NULL").select("decision_id", F.col("p.article").alias("article"), F.col("p.service").alias("service_no"), F.col("p.unit").alias("p_unit"), F.col("p.part").alias("p_part"))
    owners = hits.where("service <> ''").select("decision_id", X.article_number(F.col("article_no")).alias("article"), "service_no", "service", "unit", "sub_unit")
    starts = lambda c, p, end: F.col(p).isNull() | F.startswith(F.trim(F.coalesce(c, F.lit(""))), F.concat(F.col(p), F.lit(end)))
    return paths.join(owners, ["decision_id", "article", "service_no"]).where(starts("unit", "p_unit", ")") & starts("sub_unit", "p_part", "-")).groupBy("decision_id").agg(F.sort_array(F.collect_set("service")).alias("services"))


def reconcile_units(decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """Service and unit as the regulation has them: the owner of the cited paths where it is one and the decision
    names another; spelling and unit of the first hit of the same name, else of a like name. A service where
    documents come in is no target. Adds ``corrected``."""
    # the columns as they were travel with the rows
    before = decisions.withColumns({"old_service": F.col("service"), "old_main": F.col("main_unit"), "old_other": F.col("other_unit")})
    rows = before.join(cited_services(decisions, hits), "decision_id", "left").withColumn("active", ~F.col("undetermined") & F.col("service").isNotNull())
    named = F.exists(F.coalesce("services", X.strings()), lambda s: X.same_service_strict(s, F.col("service")))
    rows = rows.withColumn("service", F.when(F.col("active") & ~named & (F.size("services") == 1), F.get("services", F.lit(0))).otherwise(F.col("service"))).drop("services")
    rows = undetermined(rows, F.col("active") & X.is_entry_point(F.col("service")), F.concat("service", F.lit(ENTRY_POINT)))
    # names are normalised once, before the join
    named_ = lambda df, c: df.withColumn("name", X.tr_normalize(F.col(c))).withColumn("long", X.long_words(F.col("name")))
    asked = named_(rows.where("active AND service IS NOT NULL").select("decision_id", "service"), "service").select("decision_id", F.col("name").alias("a_name"), F.col("long").alias("a_long"))
    owners = named_(hits.where("service IS NOT NULL").select("decision_id", "rank", F.col("service").alias("h_service"), F.col("unit").alias("h_unit"), F.col("sub_unit").alias("h_sub")), "h_service")
    strict, like = F.col("name") == F.col("a_name"), X.like_names(F.col("name"), F.col("a_name"), F.col("long"), F.col("a_long"))
    best = asked.join(owners, "decision_id").where(strict | like).groupBy("decision_id").agg(F.min_by(F.struct("h_service", "h_unit", "h_sub"), F.struct(F.when(strict, 0).otherwise(1), F.col("rank"))).alias("hit"))
    rows = rows.join(best, "decision_id", "left")
    hit_entry = F.col("hit").isNotNull() & X.is_entry_point(F.col("hit.h_service"))
    rows = undetermined(rows, hit_entry, F.concat("hit.h_service", F.lit(ENTRY_POINT_HIT)))
    unit, sub = X.tr_normalize(F.coalesce("hit.h_unit", F.lit(""))), X.tr_normalize(F.coalesce("hit.h_sub", F.lit("")))

    def first_of(table, c) -> Column:
        out = F.lit(None).cast("string")
        for pattern, name in reversed(table):
            out = F.when(c.rlike(pattern), name).otherwise(out)
        return out

    found = F.col("hit").isNotNull() & ~hit_entry
    other, main = found & F.contains(unit, F.lit("diger hizmet")), found & F.contains(unit, F.lit("ana hizmet"))
    rows = rows.withColumn("main_unit", F.when(other, F.lit(None)).when(main, first_of(MAIN_UNITS, sub)).otherwise(F.col("main_unit"))).withColumn(
        "other_unit", F.when(other, first_of(OTHER_UNITS, X.tr_normalize(F.col("hit.h_service")))).when(main, F.lit(None)).otherwise(F.col("other_unit"))
    )
    rows = rows.withColumn("service", F.when(found, F.col("hit.h_service")).otherwise(F.col("service")))
    changed = ~F.col("service").eqNullSafe(F.col("old_service")) | ~F.col("main_unit").eqNullSafe(F.col("old_main")) | ~F.col("other_unit").eqNullSafe(F.col("old_other"))
    return rows.withColumn("corrected", F.col("active") & changed).drop("active", "hit", "old_service", "old_main", "old_other")


def flag_uncertain(decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds ``uncertain``: a cited article's number was inferred, not read."""
    open_ = hits.where("certain = false").select("decision_id", X.article_number(F.col("article_no")).alias("article")).distinct()
    cited = decisions.select("decision_id", F.explode("citations").alias("c")).select("decision_id", X.article_number(F.col("c.article_no")).alias("article"))
    bad = cited.join(open_, ["decision_id", "article"], "left_semi").select("decision_id").distinct().withColumn("uncertain", F.lit(True))
    return decisions.join(bad, "decision_id", "left").withColumn("uncertain", F.coalesce("uncertain", F.lit(False)))


def outside_note(service: Column) -> Column:
    return F.concat(F.lit(OUTSIDE[0]), service, F.lit(OUTSIDE[1]))


def enforce_catalog(decisions: DataFrame, catalog: DataFrame) -> DataFrame:
    """A service that the catalogue lacks makes a decision undetermined, with a note. The catalogue holds the services of a regulation: Spark broadcasts it while it is small."""
    rows = decisions.join(catalog.select("service", F.lit(True).alias("listed")).distinct(), "service", "left")
    outside = ~F.col("undetermined") & (F.coalesce("service", F.lit("")) != "") & F.col("listed").isNull()
    return undetermined(rows, outside, F.concat("reasoning", outside_note(F.col("service")))).drop("listed")


def repair_routing(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stored routings to services that the catalogue lacks become undetermined, if there is a catalogue at all."""
    there = catalog.agg((F.count("*") > 0).alias("there"))
    rows = docs.join(catalog.select(F.col("service").alias("routed_service"), F.lit(True).alias("listed")).distinct(), "routed_service", "left").crossJoin(F.broadcast(there))
    wrong = (F.col("corpus") == "documents") & F.col("routed_service").isNotNull() & F.col("listed").isNull() & F.col("there")
    rows = rows.withColumn("wrong", F.coalesce(wrong, F.lit(False)))
    return (
        rows.withColumn("routing_reasoning", F.when(F.col("wrong"), F.concat(F.coalesce("routing_reasoning", F.lit("")), outside_note(F.col("routed_service")))).otherwise(F.col("routing_reasoning")))
        .withColumn("routed_service", F.when(~F.col("wrong"), F.col("routed_service")))
        .withColumn("routed_unit", F.when(~F.col("wrong"), F.col("routed_unit")))
        .withColumn("routing_confidence", F.when(F.col("wrong"), 0.0).otherwise(F.col("routing_confidence")))
        .withColumn("routing_status", F.when(F.col("wrong"), "belirlenemedi").otherwise(F.col("routing_status")))
        .drop("listed", "there", "wrong")
    )


def apply_decisions(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Writes decisions (``decision_id`` is the document's id; ``routing_key`` may be NULL) into the registry."""
    d = decisions.select(F.col("decision_id").alias("id"), F.coalesce("main_unit", "other_unit").alias("d_unit"), F.col("service").alias("d_service"), F.col("confidence").alias("d_confidence"), F.col("reasoning").alias("d_reasoning"), F.col("undetermined").alias("d_open"), F.col("routing_key").alias("d_key"))
    hit, open_ = F.col("d_open").isNotNull(), F.col("d_open")
    rows = docs.join(d, "id", "left")
    return (
        rows.withColumn("routed_unit", F.when(hit & ~open_, F.col("d_unit")).when(~hit, F.col("routed_unit")))
        .withColumn("routed_service", F.when(hit & ~open_, F.col("d_service")).when(~hit, F.col("routed_service")))
        .withColumn("routing_confidence", F.when(hit, F.col("d_confidence")).otherwise(F.col("routing_confidence")))
        .withColumn("routing_reasoning", F.when(hit, F.col("d_reasoning")).otherwise(F.col("routing_reasoning")))
        .withColumn("routing_status", F.when(hit & open_, "belirlenemedi").when(hit, "routed").otherwise(F.col("routing_status")))
        .withColumn("routing_key", F.coalesce("d_key", "routing_key"))
        .withColumn("lifecycle_status", F.when(hit & (F.col("lifecycle_status") == "new"), "routed").otherwise(F.col("lifecycle_status")))
        .drop("d_unit", "d_service", "d_confidence", "d_reasoning", "d_open", "d_key")
    )


def apply_manual(docs: DataFrame, overrides: DataFrame, catalog: DataFrame) -> DataFrame:
    """The latest override (``id, service, reason, at``) of each document whose service is in the catalogue. The catalogue holds the services of a
    regulation and is broadcast: overrides shuffled by service would meet in a task for each of its few names."""
    valid = overrides.join(F.broadcast(catalog.select("service").distinct()), "service", "left_semi").groupBy("id").agg(F.max_by(F.struct("service", "reason"), F.struct("at", "service", F.coalesce("reason", F.lit("")))).alias("o"))
    hit = F.col("o").isNotNull()
    return (
        docs.join(valid, "id", "left")
        .withColumn("routed_service", F.when(hit, F.col("o.service")).otherwise(F.col("routed_service")))
        .withColumn("routing_reasoning", F.when(hit, F.coalesce("o.reason", F.lit("Servis calisani tarafindan elle atandi"))).otherwise(F.col("routing_reasoning")))
        .withColumn("routing_confidence", F.when(hit, 1.0).otherwise(F.col("routing_confidence")))
        .withColumn("routing_status", F.when(hit, "routed").otherwise(F.col("routing_status")))
        .drop("o")
    )


def grading_context(decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of the decided service, or all of a decision's hits where there are none."""
    # names are normalised once, before the join
    named = lambda df, c: df.withColumn(c, X.tr_normalize(F.coalesce("service", F.lit("")))).withColumn(f"{c}_long", X.long_words(F.col(c)))
    asked = named(decisions.where("NOT undetermined").select("decision_id", "service"), "asked_name").drop("service")
    rows = named(hits, "hit_name").join(asked, "decision_id")
    own = X.like_names(F.col("hit_name"), F.col("asked_name"), F.col("hit_name_long"), F.col("asked_name_long"))
    rows = rows.select(*hits.columns, own.alias("own")).withColumn("any_own", F.max("own").over(Window.partitionBy("decision_id")))
    return rows.where("own OR NOT any_own").drop("own", "any_own")


def apply_verdicts(attempts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The first approved attempt of each decision (``decision_id, attempt`` 1 or 2); with none, undetermined.

    Verdicts: ``decision_id, attempt, grounded, desk_claim``. An undetermined attempt passes; a second attempt may
    not name the service that was rejected.
    """
    rows = attempts.join(verdicts, ["decision_id", "attempt"], "left")
    order = Window.partitionBy("decision_id").orderBy("attempt")
    approved = F.col("undetermined") | (F.coalesce("grounded", F.lit(False)) & ~F.coalesce("desk_claim", F.lit(False)))
    again = F.coalesce(X.same_service_strict(F.col("service"), F.lag("service").over(order)), F.lit(False))
    rows = rows.withColumn("approved", approved & ~again)
    pick = F.row_number().over(Window.partitionBy("decision_id").orderBy(F.desc("approved"), "attempt"))
    rows = rows.withColumn("pick", pick).where("pick = 1").drop("pick", "grounded", "desk_claim")
    return undetermined(rows, ~F.col("approved"), F.lit("Iki deneme de onaylanmadi; evrak manuel incelemeye alindi."))


def format_decision(decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """``decision_id, text``: a decision as people read it."""
    inferred = hits.where("certain = false").groupBy("decision_id").agg(F.collect_set(X.article_number(F.col("article_no"))).alias("inferred"))
    rows = decisions.join(inferred, "decision_id", "left").withColumn("inferred", F.coalesce("inferred", X.strings()))
    unit = F.when(F.col("main_unit").isNotNull(), F.concat(F.lit("Ana Hizmet Birimi > "), "main_unit")).when(F.col("other_unit").isNotNull(), F.concat(F.lit("Diger Hizmet Birimi > "), "other_unit")).otherwise("Birim belirlenemedi")
    note = lambda c: F.when(F.array_contains(F.col("inferred"), X.article_number(c["article_no"])), " (madde numarasi kaynak metinden okunamadi, sira ile turetildi)").otherwise("")
    listed = F.transform("citations", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Madde "), c["article_no"], F.lit(" - "), c["title"], note(c)))
    default = F.concat(F.lit("Karar, "), F.array_join(F.transform("citations", lambda c: F.concat(F.lit("Madde "), c["article_no"])), ", "), F.lit(" kapsamindaki gorev tanimina dayanmaktadir."))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Yonlendirme: "), unit, F.coalesce(F.concat(F.lit(" > "), "service"), F.lit(""))),
        F.when(F.col("sub_service") != "", F.concat(F.lit("Alt servis/masa: "), "sub_service")).otherwise("Alt servis/masa: belirtilmedi (yonetmelik yalnizca servis seviyesinde dayanak sagliyor; masalar arasi gorev dagilimi Islem Yonergesi'nde)"),
        F.concat(F.lit("Guven skoru: "), F.format_string("%.2f", "confidence")),
        F.concat(F.lit("Gerekce: "), F.when(F.trim("reasoning") != "", F.trim("reasoning")).otherwise(default)),
        F.when(F.size("citations") > 0, F.concat(F.lit("\nDayanak maddeler:\n"), F.array_join(listed, "\n"))),
    )
    return rows.select("decision_id", F.when(F.col("undetermined"), F.concat(F.lit(NOT_DETERMINED + "\n\nGerekce: "), "reasoning")).otherwise(text).alias("text"))
