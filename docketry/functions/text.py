"""Column functions over Turkish office texts: folding, identifiers, grounding, citations, numbers, letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms left out of the sparse index (folded Turkish function words).
STOPWORDS = (
    "acaba ama ancak aslinda az bazi belki ben bir birkac biz bu cok cunku da daha de degil diye eger en gibi hem hep hepsi "
    "her hic icin ile ise kez ki kim mi mu nasil ne neden nerde nerede nereye nicin niye o sanki sey siz su tum ve veya ya "
    "yani olarak olan uzere kadar"
).split()

# Folded phrases by which an answer says that it found nothing.
NOT_FOUND = (
    "bulunamadi", "bulunmamaktadir", "yer almamaktadir", "yer almiyor", "belirtilmemis", "belirtilmemektedir", "bilgi yok",
    "bilgi bulunmuyor", "bilgi icermemektedir", "mevcut degil", "rastlanmamistir", "bahsedilmemektedir", "deginilmemistir",
    "herhangi bir bilgiye rastlanmadi", "kayitlara rastlanmadi", "elimde bu konuda bilgi yok",
    "dokumanlarda bu bilgiye ulasilamadi", "belirlenemedi", "manuel inceleme gerekli",
)

# The request kinds and the words by which a regulation names them.
REQUEST_PHRASES = {
    "tecil_taksitlendirme": "tecil ve taksitlendirme talebi",
    "beyanname_verme": "beyanname verme ve tahakkuk islemi",
    "uzlasma_talebi": "uzlasma talebi",
    "dava_itiraz": "dava, itiraz ve temyiz islemi",
    "odeme_iade_duzeltme": "odeme, iade, terkin ve duzeltme islemi",
    "sicil_mukellefiyet": "mukellefiyet sicil ve yoklama islemi",
    "haciz_satis": "haciz ve satis islemi",
    "bilgi_belge_talebi": "bilgi ve belge talebi",
    "diger": "diger islem",
}

# Stems (folded) of messages that may ask for a letter, and of questions about routing.
LETTER_STEMS = ("yaz", "taslak", "tebli", "muhatap", "onay", "red", "cevap", "olumlu", "olumsuz", "dilekce")
ROUTING_STEMS = ("yonlendir", "servis", "birim", "madde", "mevzuat", "yonetmelik", "gorev tanim", "hangi servis")

NUMBER = r"[0-9][0-9.,:/]*[0-9]|[0-9]{2,}"


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def tr_lower(c) -> Column:
    """Lower case by Turkish rules: dotless and dotted i keep their dots."""
    return F.lower(F.translate(c, "Iİ", "ıi"))


def tr_upper(c) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def tr_fold(c) -> Column:
    """For comparing a value with a text: lower case, marks folded, white space collapsed."""
    return F.regexp_replace(F.translate(tr_lower(c), "çğıîöşüâ", "cgiiosua"), r"\s+", " ")


def tr_plain(c) -> Column:
    """Lower case and marks folded; punctuation and white space stay."""
    return F.translate(tr_lower(c), "çğıöşü", "cgiosu")


def tr_normalize(c) -> Column:
    """For comparing names: letters a-z, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(tr_plain(c), "[^a-z0-9 ]", " "), " +", " "))


def term_text(c) -> Column:
    """A text as words of a-z and digits with single spaces between them."""
    return F.regexp_replace(tr_plain(c), "[^a-z0-9]+", " ")


def tokenize(c) -> Column:
    """Terms of the sparse index, in order."""
    words = F.split(term_text(c), " ")
    return F.filter(words, lambda t: (F.length(t) >= 2) & ~F.array_contains(strings(*STOPWORDS), t))


def estimate_tokens(c) -> Column:
    return F.ceil(F.length(c) / 3.5).cast("long")


def only_digits(c) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _digit(c: Column, i: int) -> Column:
    return F.ascii(F.substring(c, i + 1, 1)) - 48


def is_valid_tckn(c) -> Column:
    """Eleven digits, the first not 0, with both check digits right."""
    s = only_digits(c)
    d = [_digit(s, i) for i in range(11)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    return F.coalesce(s.rlike("^[1-9][0-9]{10}$") & (F.pmod(odd * 7 - even, F.lit(10)) == d[9]) & ((odd + even + d[9]) % 10 == d[10]), F.lit(False))


def is_valid_vkn(c) -> Column:
    """Ten digits with the check digit right; a step of 0 adds nothing and a remainder of 0 counts 9."""
    s = only_digits(c)
    total = F.lit(0)
    for i in range(9):
        step = (_digit(s, i) + (9 - i)) % 10
        rest = (step * 2 ** (9 - i)) % 9
        total = total + F.when(step == 0, 0).when(rest == 0, 9).otherwise(rest)
    return F.coalesce(s.rlike("^[0-9]{10}$") & ((10 - total % 10) % 10 == _digit(s, 9)), F.lit(False))


def extract_identifiers(c) -> Column:
    """``struct<tckn, vkn>``: numbers with right check digits, distinct, in order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\b[0-9][0-9\s.]{8,14}[0-9]\b"), F.lit(0)), only_digits)
    return F.struct(
        F.array_distinct(F.filter(found, lambda x: (F.length(x) == 11) & is_valid_tckn(x))).alias("tckn"),
        F.array_distinct(F.filter(found, lambda x: (F.length(x) == 10) & is_valid_vkn(x))).alias("vkn"),
    )


def validate_tckn(c) -> Column:
    return F.when(is_valid_tckn(c), only_digits(c))


def validate_vkn(c) -> Column:
    """A tax number, or the person number that a person uses in its place."""
    return F.when(F.length(only_digits(c)) == 11, validate_tckn(c)).when(is_valid_vkn(c), only_digits(c))


def clean_list(c, limit: int | None = None) -> Column:
    out = F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))
    return F.slice(out, 1, limit) if limit else out


def reconcile_identifiers(vkn, tckn, text) -> Column:
    """``struct<vkn, tckn>``: the model's value if its check digits hold, else the only candidate in the text."""
    found = extract_identifiers(text)
    only = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
    return F.struct(F.coalesce(validate_vkn(vkn), only(found["vkn"]), only(found["tckn"])).alias("vkn"), F.coalesce(validate_tckn(tckn), only(found["tckn"])).alias("tckn"))


def ground_phrase(phrase, text) -> Column:
    """What of a phrase stands in a text: all of it, its abbreviation in brackets, its longest leftmost run of two words or more, or ''."""
    whole = F.regexp_replace(F.trim(phrase), r"\s+", " ")
    short = F.trim(F.regexp_extract(whole, r"\(([^)]{2,12})\)", 1))
    words = F.filter(F.split(F.regexp_replace(whole, "[()]", " "), r"\s+"), lambda w: w != "")
    n = F.size(words)
    runs = F.flatten(
        F.transform(
            F.when(n >= 2, F.sequence(n, F.lit(2), F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)")),
            lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")),
        )
    )

    def found(source) -> Column:
        first = F.get(F.filter(runs, lambda r: F.contains(source, tr_fold(r))), F.lit(0))
        return F.when(F.contains(source, tr_fold(whole)), whole).when((short != "") & F.contains(source, tr_fold(short)), short).otherwise(F.coalesce(first, F.lit("")))

    # the text is folded once, not for each run; of a variable it is a value
    return F.when(F.coalesce(whole, F.lit("")) == "", "").otherwise(F.get(F.transform(F.array(tr_fold(text)), found), F.lit(0)))


def simplified(c) -> Column:
    return tr_lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def quote_holds(quote, text, limit: int = 12_000) -> Column:
    """Whether each part of a quote, cut at ellipses, stands in the text's first characters; an empty quote claims nothing."""
    body = simplified(F.substring(text, 1, limit))
    parts = F.filter(F.transform(F.split(quote, r"…|\.\.\."), simplified), lambda p: p != "")
    return (quote == "") | ((F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(body, p)))


def routing_key(doc_type, request, receivable) -> Column:
    folded = F.trim(F.regexp_replace(tr_lower(receivable), r"[^\p{L}\p{N}]+", " "))
    return F.concat_ws("|", doc_type, request, folded)


def request_phrase(request) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in REQUEST_PHRASES.items() for x in kv]), request)


def routing_query(request, receivable) -> Column:
    return F.concat_ws(" ", F.when(request_phrase(request) != "", request_phrase(request)), F.when(receivable != "", receivable))


def routing_text(doc_type, request, receivable, summary) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Belge turu: "), doc_type),
        F.concat(F.lit("Talep edilen islem: "), request_phrase(request)),
        F.when(receivable != "", F.concat(F.lit("Alacak/vergi turu: "), receivable)),
        F.concat(F.lit("Ozet: "), summary),
    )


def article_number(c) -> Column:
    """The first run of digits, else the trimmed value."""
    return F.when(F.regexp_extract(c, "[0-9]+", 0) != "", F.regexp_extract(c, "[0-9]+", 0)).otherwise(F.trim(c))


def parse_citation(c) -> Column:
    """``struct<article, unit, part, service>`` of a citation path such as ``11-A-I-2-f``."""
    parts = F.filter(F.split(c, r"[-.\s]+"), lambda p: p != "")
    rest = F.when(F.get(parts, F.lit(0)).rlike("^[0-9]+$"), F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    first = lambda pattern: F.get(F.filter(rest, lambda p: p.rlike(pattern)), F.lit(0))
    return F.struct(article_number(c).alias("article"), first("^[A-C]$").alias("unit"), first("^(I|II|III|IV|V)$").alias("part"), first("^[0-9]+$").alias("service"))


def same_service_strict(a, b) -> Column:
    return tr_normalize(a) == tr_normalize(b)


def long_words(name) -> Column:
    """Words of more than three letters of a normalised name."""
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: F.length(w) > 3))


def like_names(x, y, x_long, y_long) -> Column:
    """Normalised names that are equal, one within the other, or have enough long words in common."""
    fewer = F.least(F.size(x_long), F.size(y_long))
    words = (fewer > 0) & (F.size(F.array_intersect(x_long, y_long)) >= fewer * 0.6)
    return F.coalesce((x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x) | words), F.lit(False))


def same_service(a, b) -> Column:
    """Equal, one within the other, or enough long words in common."""
    x, y = tr_normalize(a), tr_normalize(b)
    return like_names(x, y, long_words(x), long_words(y))


def is_entry_point(c) -> Column:
    return F.coalesce(F.contains(tr_normalize(c), F.lit("arsiv")), F.lit(False))


def is_dispute(c) -> Column:
    return F.coalesce(F.contains(tr_normalize(c), F.lit("ihtilafli isler")), F.lit(False))


def is_for_org(article, org: str) -> Column:
    """Article 12 names the services of a dependent office, the other articles those of the rest."""
    return (article_number(article) == "12") if org == "bagli" else (article_number(article) != "12")


def is_not_found(c) -> Column:
    return tr_plain(c).rlike("|".join(NOT_FOUND))


def numbers_in(c) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))


def unsupported_numbers(reply, source) -> Column:
    """Numbers of a reply that a source lacks: not written so, not the same digits, not a beginning of three digits or more."""
    known = F.transform(numbers_in(source), only_digits)
    flat = F.regexp_replace(source, r"\s+", " ")

    def supported(d, k):
        return (d == k) | ((F.length(d) >= 3) & F.startswith(k, d)) | ((F.length(k) >= 3) & F.startswith(d, k))

    return F.array_distinct(F.filter(numbers_in(reply), lambda x: (F.length(only_digits(x)) >= 2) & ~F.contains(flat, x) & ~F.exists(known, lambda k: supported(only_digits(x), k))))


def normalize_line(c) -> Column:
    """Bullets and bold marks go, white space collapses."""
    bare = F.replace(F.regexp_replace(c, r"(?m)^\s*[-*•]\s+", ""), F.lit("**"), F.lit(""))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def normalize_lines(c) -> Column:
    return F.filter(F.transform(c, normalize_line), lambda x: x != "")


def snippet(c, n: int = 160) -> Column:
    """A chunk's text without its breadcrumb line, on one line, cut."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"^\[[^\n]*\]\n", ""), r"\s+", " ")), 1, n)


def escape_html(c) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def mark_placeholders(c) -> Column:
    return F.regexp_replace(escape_html(c), r"\[([^\]]+)\]", '<span class="eksik">[$1]</span>')


def term_id(c) -> Column:
    """FNV-1a of an ASCII term, 32 bits."""
    start = F.lit(2166136261).cast("long")
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))


def clean_markdown(c) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"<!--\s*image\s*-->", ""), "\n{3,}", "\n\n")
