"""Regulations (scanned, with damaged headings) to articles and service segments, as columns and windows over lines.

A text becomes a row a line. What a line is can be told from the line itself, but for two things that its neighbours decide: a
heading after a part or chapter without a name is that name, and a heading that begins like the second half of a title
takes the heading before it as the first. Everything else (where articles begin, their part and chapter, the unit and service of a
segment) is the last value of some kind of line before it. Windows run within a document, or an article.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import tr_lower, tr_upper

# The words of the regulation's headings.
ORDINALS = "BİRİNCİ İKİNCİ ÜÇÜNCÜ DÖRDÜNCÜ BEŞİNCİ ALTINCI YEDİNCİ SEKİZİNCİ DOKUZUNCU ONUNCU".split()
CONTINUATIONS = ("ve", "ile", "veya", "ya da")
SMALL_WORDS = ("ve", "ile", "veya", "ya", "da", "de", "ki")
LONGEST_MARKER = 120


def any_case(word: str) -> str:
    """A pattern for a word in either case; the dotted capital I has no small form here."""
    return "".join(c if c == "İ" or not c.isalpha() else f"[{c.upper() if c != 'i' else 'I'}{c.lower() if c != 'I' else 'i'}]" for c in word)


_ORDINAL = "|".join(map(any_case, ORDINALS))
HEADING = r"(?sU)^#{1,6}\s+(.+)$"
PART, CHAPTER = (rf"(?sU)^((?:{_ORDINAL})\s+{any_case(word)})(?![A-Za-z0-9_])\s*(.*)$" for word in ("KISIM", "BÖLÜM"))
NUMBERED = rf"(?sU)^(.*?)\s*:?\s*[-–—]?\s*{any_case('Madde')}\s+([0-9]+)\s*$"
UNNUMBERED = r"(?sU)^(.+?)\s*:\s*[-–—]?\s*$"
SECOND_HALF = r"(?sU)^(?:(?:" + "|".join(map(any_case, CONTINUATIONS)) + r")\s|\p{Ll})"
SUB_UNIT = r"(?sU)^[IVX]+\s*[-–—]\s*.+$"
UNIT = r"(?sU)^[A-ZÇĞİÖŞÜ]\s*[).]\s+.+$"
UNIT_NAME = rf"(?U)(?:{any_case('Ana')}|{any_case('Diğer')})\s+{any_case('Hizmet')}\s+{any_case('Birim')}|{any_case('Beyanname')}\s+{any_case('Kabul')}\s+{any_case('ve')}\s+{any_case('Tahsilat')}"
SERVICE = rf"(?sU)^(?:[0-9]+\s*[).]\s*)?(.+?(?:{any_case('Servisi')}|{any_case('Şubesi')}))(?:{any_case('nin')}\s+{any_case('Görevleri')})?\s*$"
SERVICE_NUMBER = r"(?U)^([0-9]+)\s*[).]"
NOTE = "\n(Not: bu maddenin numarasi kaynak metinden okunamadi, komsu madde numaralarindan turetildi.)"


def stripped(c) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c) -> Column:
    return F.regexp_replace(stripped(c), r"(?U)\s+", " ")


def found(c, pattern: str, group: int) -> Column:
    """The group of a match, NULL where there is none."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def looks_like_title(c) -> Column:
    """Two words or more, four fifths of which begin with a capital."""
    bare = F.transform(F.split(c, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"\P{L}", ""))
    words = F.filter(bare, lambda w: (F.length(w) >= 2) & ~tr_lower(w).isin(*SMALL_WORDS))
    capital = F.filter(words, lambda w: F.substring(w, 1, 1) == tr_upper(F.substring(w, 1, 1)))
    return (F.size(words) >= 2) & (F.size(capital) * 10 >= F.size(words) * 8)


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line, raw, text`` and what each line is by itself."""
    whole = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"<!--\s*image\s*-->", ""), r"\r?\n")
    rows = docs.select(F.col("id").cast("string").alias("doc_id"), F.posexplode(whole).alias("line", "raw"))
    rows = rows.withColumn("raw", F.regexp_replace("raw", r"(?U)\s+$", "")).withColumn("text", stripped("raw"))
    rows = rows.withColumn("head", squeezed(found("text", HEADING, 1)))
    rows = rows.withColumn("part_head", found("head", PART, 1)).withColumn("rest", F.coalesce(stripped(found("head", PART, 2)), "head"))
    rows = rows.withColumn("chapter_head", found("rest", CHAPTER, 1)).withColumn("rest", F.coalesce(stripped(found("rest", CHAPTER, 2)), "rest"))
    structural = F.col("part_head").isNotNull() | F.col("chapter_head").isNotNull()
    # a pattern with an optional tail of spaces must not be tried on what has no number or colon at its end
    return rows.select(
        "doc_id", "line", "raw", "head", "part_head", "chapter_head", "rest", F.col("head").isNotNull().alias("heading"), (F.col("text") == "").alias("blank"), structural.alias("structural"),
        (structural & (F.col("rest") == "")).alias("bare"), squeezed(found("rest", NUMBERED, 1)).alias("own_title"), found("rest", NUMBERED, 2).alias("digits"),
        F.when(~structural, squeezed(found("head", UNNUMBERED, 1))).alias("open_title"),
    )


def articles(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, title, part, chapter, number, body`` of ``id, text`` regulations, before open numbers are inferred."""
    by_line = Window.partitionBy("doc_id").orderBy("line")
    among_headings, among_texts = Window.partitionBy("doc_id", "heading").orderBy("line"), Window.partitionBy("doc_id", "blank").orderBy("line")
    no = F.lit(False)
    rows = lines(docs).withColumn("is_name", F.col("heading") & ~F.col("structural") & F.coalesce(F.lag("bare").over(among_headings), no))
    plain = F.col("heading") & ~F.col("is_name")
    rows = rows.withColumn("numbered", plain & F.col("digits").isNotNull())
    rows = rows.withColumn("unnumbered", plain & ~F.col("numbered") & F.coalesce(looks_like_title("open_title"), no))
    rows = rows.withColumn("half", plain & ~F.col("structural") & ~F.col("numbered") & ~F.col("unnumbered"))
    rows = rows.withColumn("second", F.col("numbered") & ~F.col("structural") & F.regexp_like("own_title", F.lit(SECOND_HALF)) & F.coalesce(F.lag("half").over(among_texts), no))
    rows = rows.withColumn("first", F.col("half") & F.coalesce(F.lead("second").over(among_texts), no))
    rows = rows.withColumn("title", F.when(F.col("second"), squeezed(F.concat_ws(" ", F.lag("head").over(among_texts), "own_title"))).when(F.col("numbered"), F.col("own_title")).otherwise(F.col("open_title")))

    name = F.when(F.lead("is_name").over(among_headings), F.lead("head").over(among_headings))
    tail = F.when(F.col("bare"), name).when(~F.col("numbered"), F.col("rest")).when(F.col("title") != "", F.when(F.col("chapter_head").isNotNull(), F.col("title")))
    rows = rows.withColumn("chapter_value", F.when(F.col("chapter_head").isNotNull(), F.concat_ws(" ", "chapter_head", tail)))
    own_tail = F.when(F.col("chapter_head").isNull() & ~F.col("numbered"), tail)
    rows = rows.withColumn("part_value", F.when(F.col("part_head").isNotNull(), F.concat_ws(" ", "part_head", own_tail)))
    rows = rows.withColumn("part_no", F.count("part_head").over(by_line)).withColumn("part", F.last("part_value", ignorenulls=True).over(by_line))
    rows = rows.withColumn("chapter", F.last("chapter_value", ignorenulls=True).over(Window.partitionBy("doc_id", "part_no").orderBy("line")))
    begins = F.col("numbered") | F.col("unnumbered")
    rows = rows.withColumn("begins", begins).withColumn("pos", F.sum(begins.cast("int")).over(by_line).cast("int") - 1)

    # a heading that turned out to be no half of a title stands in the body, right before the next line that has a text
    after = F.coalesce(F.lead("line").over(among_texts), F.lit(2**31 - 1))
    text = F.when(F.col("half"), F.when(~F.col("first"), F.col("head"))).when(~F.col("heading"), F.when(F.col("blank"), "").otherwise(F.col("raw")))
    rows = rows.withColumn("kept", F.when(text.isNotNull(), F.struct(F.when(F.col("half"), after).otherwise(F.col("line")).alias("at"), (~F.col("half")).alias("own"), text.alias("text"))))
    opening = F.struct(F.when(F.col("title") == "", F.concat(F.lit("Madde "), "digits")).otherwise(F.col("title")).alias("title"), "part", "chapter", F.expr("try_cast(digits AS int)").alias("number"))
    grouped = rows.where("pos >= 0").groupBy("doc_id", "pos").agg(F.max(F.when(F.col("begins"), opening)).alias("o"), F.transform(F.sort_array(F.collect_list("kept")), lambda k: k["text"]).alias("body"))
    return grouped.select("doc_id", "pos", "o.title", "o.part", "o.chapter", F.when(F.col("o.number").isNotNull(), F.col("o.number")).alias("number"), "body")


def segments(arts: DataFrame) -> DataFrame:
    """``doc_id, pos, segment, unit, sub_unit, service, service_no, markers, lines`` of ``doc_id, pos, body`` articles.

    The parts of a body that belong to one unit, sub-unit or service; a service without lines has its marker as its line.
    """
    rows = arts.select("doc_id", "pos", F.posexplode("body").alias("line", "raw"))
    core = stripped(F.regexp_replace(F.regexp_replace(stripped("raw"), r"(?U)^#{1,6}\s+", ""), r"(?U)^(?:[-*•]|[0-9]+[.)])\s+", ""))
    rows = rows.withColumn("core", core)
    short = F.length("core").between(1, LONGEST_MARKER)
    kind = F.when(~short, F.lit(None)).when(F.regexp_like("core", F.lit(SUB_UNIT)), "sub_unit").when(F.regexp_like("core", F.lit(UNIT)), "unit").when(~F.col("core").rlike("[,;]$") & F.regexp_like("core", F.lit(SERVICE)), "service")
    order = Window.partitionBy("doc_id", "pos").orderBy("line")
    rows = rows.withColumn("kind", kind).withColumn("part", F.count("kind").over(order))
    # the last unit and sub-unit before each line; a unit ends the sub-unit before it
    is_unit, is_sub = F.col("kind") == "unit", F.col("kind") == "sub_unit"
    unit = F.last(F.when(is_unit, F.struct(F.when(F.col("core").rlike(UNIT_NAME), F.col("core")).alias("v"))), ignorenulls=True).over(order)["v"]
    sub = F.last(F.when(is_unit | is_sub, F.struct(F.when(is_sub, F.col("core")).alias("v"))), ignorenulls=True).over(order)["v"]
    rows = rows.withColumn("unit", unit).withColumn("sub_unit", sub)
    some = lambda *c: F.array_compact(F.array(*c))
    markers = F.when(is_unit, F.array("core")).when(is_sub, some("unit", "core")).when(F.col("kind") == "service", some("unit", "sub_unit", "core")).otherwise(F.expr("cast(array() as array<string>)"))
    head = F.struct("unit", "sub_unit", F.when(F.col("kind") == "service", stripped(found("core", SERVICE, 1))).alias("service"), F.when(F.col("kind") == "service", found("core", SERVICE_NUMBER, 1)).alias("service_no"), markers.alias("markers"), F.col("kind").alias("kind"), F.col("core").alias("core"))
    parts = rows.groupBy("doc_id", "pos", "part").agg(
        F.min_by(head, "line").alias("h"), F.sort_array(F.collect_list(F.when(F.col("kind").isNull(), F.struct("line", "raw")))).alias("own"), F.count_if(F.col("kind").isNull() & (stripped("raw") != "")).alias("full"),
    )
    parts = parts.where((F.col("full") > 0) | (F.col("h.kind") == "service"))
    text = F.when(F.col("full") > 0, F.transform("own", lambda x: x["raw"])).otherwise(F.array("h.core"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "pos").orderBy("part")).cast("int") - 1
    return parts.select("doc_id", "pos", nth.alias("segment"), "h.unit", "h.sub_unit", "h.service", "h.service_no", "h.markers", text.alias("lines"))


def chunks(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """Chunks of ``id, filename`` documents from their articles with numbers (``doc_id, pos, title, part, chapter, article_no, certain, body``).

    An article of one segment is a child; an article of several is a parent with a child for each.
    """
    whole = numbered.withColumn("whole", stripped(F.array_join("body", "\n"))).where("whole <> ''")
    split = segments(whole).withColumn("own", stripped(F.array_join("lines", "\n")))
    many = split.groupBy("doc_id", "pos").agg(F.count("*").alias("n")).where("n > 1")
    several = whole.join(many, ["doc_id", "pos"], "left").withColumn("several", F.col("n").isNotNull()).drop("n", "body")
    none, empty = F.lit(None).cast("string"), F.expr("cast(array() as array<string>)")
    article = several.select("*", F.when(F.col("several"), "parent").otherwise("child").alias("kind"), F.lit(-1).alias("segment"), none.alias("unit"), none.alias("sub_unit"), none.alias("service"), none.alias("service_no"), empty.alias("markers"), F.col("whole").alias("own"))
    child = several.where("several").join(split.where("own <> ''").drop("lines"), ["doc_id", "pos"]).withColumn("kind", F.lit("child"))
    rows = article.unionByName(child).join(docs.select(F.col("id").cast("string").alias("doc_id"), "filename"), "doc_id")
    label = F.concat(F.lit("Madde "), "article_no", F.lit(" - "), "title")
    crumb = F.array_join(F.filter(F.concat(F.array("part", "chapter", label), "markers"), lambda x: x.isNotNull() & (x != "")), " > ")
    heading = F.concat(F.array_join(F.concat(F.array(label), "markers"), "\n"), F.when(F.col("certain"), "").otherwise(NOTE))
    text = F.concat(F.lit("[Dosya: "), "filename", F.lit(" > "), crumb, F.lit("]\n"), heading, F.lit("\n\n"), "own")
    rows = rows.withColumn("text", text).withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("pos", "segment")).cast("int") - 1)
    chunk_id = lambda kind, n: F.sha2(F.concat_ws(":", "doc_id", kind, n.cast("string")), 256)
    rows = rows.withColumn("chunk", chunk_id("kind", F.col("ordinal")))
    # the parent of an article's segments stands right before them
    parent = F.max(F.when(F.col("kind") == "parent", F.col("chunk"))).over(Window.partitionBy("doc_id", "pos"))
    meta = F.struct("part", "chapter", "unit", "sub_unit", "service", "service_no", "article_no", "title", "certain")
    return rows.withColumn("parent", parent).select(
        F.col("chunk").alias("id"), "doc_id", "kind", "ordinal", "text", F.concat_ws(" > ", label, F.when(F.col("service") != "", F.col("service"))).alias("section"), F.when((F.col("kind") == "child") & (F.col("segment") >= 0), F.col("parent")).alias("parent_id"),
        F.ceil(F.length("text") / 3.5).cast("int").alias("token_count"), F.col("text").alias("probe"), meta.alias("metadata"),
    )
