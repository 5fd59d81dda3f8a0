"""Column functions that fill the fields of a reply letter and lay out its blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import strings, tr_upper

LONGEST_SUBJECT = 90
CONTACT = (("adres", "Adres: "), ("telefon", "Telefon: "), ("eposta", "e-Posta: "), ("web", "İnternet adresi: "), ("kep", "KEP: "))
#: institution field, name in the missing list
REQUIRED = (
    ("kurum_adi", "Kurum adı (LETTER_KURUM_ADI)", "[KURUM ADI]"),
    ("birim_adi", "Birim adı (LETTER_BIRIM_ADI)", "[BİRİM ADI]"),
    ("imza_ad", "İmza sahibi (LETTER_IMZA_AD)", "[İMZA SAHİBİ]"),
    ("imza_unvan", "İmza unvanı (LETTER_IMZA_UNVAN)", "[İMZA UNVANI]"),
    ("detsis_no", "DETSİS no (LETTER_DETSIS_NO)", "[DETSİS NO]"),
    ("dosya_plani", "Dosya planı kodu (LETTER_DOSYA_PLANI)", "[DOSYA PLANI KODU]"),
)


def blank(c) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def subject_line(title, subject) -> Column:
    """The proposed title, else the subject; one line, no closing dots, at most 90 characters."""
    text = F.when(blank(title), F.trim(subject)).otherwise(F.trim(title))
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[.]+$", "")
    return F.when(F.length(text) > LONGEST_SUBJECT, F.concat(F.rtrim(F.substring(text, 1, LONGEST_SUBJECT - 3)), F.lit("..."))).otherwise(text)


def court_name(c) -> Column:
    """A court's name as an address: case endings go, its presidency is written to."""
    name = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"(?iu)['’]?(na|ne|nden|dan|den)$", "")
    return F.when(name.rlike("(?iu)başkanlığı$"), name).otherwise(F.concat(name, F.lit(" Başkanlığı")))


def recipient(form_name, form_kind, form_number, people, vkn, tckn, to_court) -> Column:
    """``struct<name, kind, number, missing>``: what the form says comes before what was read from the document."""
    court = F.get(F.filter(people, lambda p: p.rlike("(?i)mahkeme")), F.lit(0))
    name = F.trim(F.coalesce(form_name, F.get(people, F.lit(0)), F.lit("")))
    at_court = F.trim(F.coalesce(form_name, court, F.lit("")))
    given = lambda c: F.when(~blank(c), F.trim(c))
    return F.struct(
        F.when(to_court, F.when(at_court == "", "[VERGİ MAHKEMESİ BAŞKANLIĞI]").otherwise(court_name(at_court))).when(name == "", "[MUHATAP]").otherwise(name).alias("name"),
        F.when(to_court, "kurum").otherwise(F.coalesce(form_kind, F.lit("kisi"))).alias("kind"),
        F.when(~to_court, F.coalesce(given(form_number), F.when(vkn != "", vkn), F.when(tckn != "", tckn))).alias("number"),
        F.when(to_court & (at_court == ""), "Vergi mahkemesi adı (evrakta bulunamadı)").when(~to_court & (name == ""), "Muhatap adı (form)").alias("missing"),
    )


def closing(decision, kind, to_court) -> Column:
    return (
        F.when(to_court, "Bilgi ve gereğini arz ederim.")
        .when(decision == "eksik_belge", "Eksik belge ve bilgilerin tamamlanması hususunda gereğini rica ederim.")
        .when(kind == "kurum", "Bilgilerini ve gereğini rica ederim.")
        .otherwise("Bilgi edinilmesini rica ederim.")
    )


def filled(institution: dict[str, str], field: str) -> str:
    value = (institution.get(field) or "").strip()
    return value or next(mark for f, _, mark in REQUIRED if f == field)


def letter_number(institution: dict[str, str], number) -> Column:
    last = F.coalesce(F.col(number).cast("string") if isinstance(number, str) else number.cast("string"), F.lit("[SIRA NO]"))
    return F.concat(F.lit(f"E-{filled(institution, 'detsis_no')}-{filled(institution, 'dosya_plani')}-"), last)


def missing_fields(institution: dict[str, str], more) -> Column:
    fixed = [name for f, name, _ in REQUIRED if not (institution.get(f) or "").strip()]
    return F.concat(strings(*fixed), F.array_compact(F.array(more)))


def address_line(name, kind) -> Column:
    return F.when(kind == "kurum", tr_upper(name)).otherwise(F.concat(F.lit("Sayın "), name))


def reference_lines(lines) -> Column:
    """Lettered lines; a letter that a line has already stays."""
    letter = lambda i: F.when(i < 26, F.char(i + 97)).otherwise("+")
    return F.transform(lines, lambda x, i: F.when(F.trim(x).rlike(r"^[A-Za-zçğıöşüÇĞİÖŞÜ]\s*\)"), F.trim(x)).otherwise(F.concat(letter(i), F.lit(") "), F.trim(x))))


def attachment_lines(names) -> Column:
    head = F.when(F.size(names) > 1, "Ekler:").otherwise("Ek:")
    return F.when(F.size(names) > 0, F.concat(F.array(head), F.transform(names, lambda x, i: F.concat((i + 1).cast("string"), F.lit("- "), x)))).otherwise(strings())


def contact_lines(institution: dict[str, str]) -> Column:
    return strings(*[label + institution[f] for f, label in CONTACT if institution.get(f)])
