import random
import tracemalloc

from pyspark.sql import functions as F

from docketry.operators import _markdown as M
from docketry.operators import chunking

LONG = " ".join(f"Bu sözleşmenin {i + 1}. maddesi uyarınca taraflar karşılıklı yükümlülüklerini yerine getirmeyi kabul ve taahhüt eder." for i in range(60))
CONTRACT = f"# Araç Kiralama\n\n## 1. Taraflar\n\nTaraflar arasında.\n\n## 2. Koşullar\n\nSüre 12 aydır.\n\n| Araç | Bedel |\n|---|---|\n| A | 45 |\n| B | 38 |\n\nÖdeme.\n\n## 3. Fesih\n\n{LONG}\n"


def test_blocks_and_paths():
    blocks = list(M.pieces(CONTRACT))
    assert next(b for b in blocks if "arasında" in b.text).path == ("Araç Kiralama", "1. Taraflar")
    tables = [b for b in blocks if b.kind == "table"]
    assert len(tables) == 1 and "| A" in tables[0].text and "| B" in tables[0].text


def test_chunks_of_a_contract(spark):
    docs = spark.createDataFrame([("d1", "kira.pdf", CONTRACT), ("d2", "not.txt", "Sadece düz bir metin."), ("d3", "bos.txt", ""), ("d4", "yok.txt", None)], "id string, filename string, text string")
    rows = chunking.chunk_documents(docs).collect()
    children, parents = [r for r in rows if r.kind == "child"], {r.id for r in rows if r.kind == "parent"}
    assert {r.doc_id for r in rows} == {"d1", "d2"}
    assert all(r.parent_id in parents for r in children)
    assert all(r.text.startswith("[Dosya: ") for r in rows)
    assert sum("| A" in r.text for r in children) == 1
    last = [r for r in children if r.section and "Fesih" in r.section]
    assert len(last) >= 2 and all(r.token_count <= 1000 for r in children)
    again = chunking.chunk_documents(docs.repartition(3)).collect()
    assert sorted(r.id for r in again) == sorted(r.id for r in rows)


def test_long_texts_are_cut_by_line_to_the_same_chunks(spark):
    rng = random.Random(4)
    bits = ["# Başlık", "## Alt", "### Derin", "metin " * 30, "Cümle bir. Cümle iki! " * 80, "| a | b |", "|---|---|", "- madde", "", "", "```", "x = 1", "<!-- image -->", "<!--", "image", "-->", "\tson\r", LONG]
    texts = [CONTRACT, "", "\n\n\n", None, "```\naçık"] + ["\n".join(rng.choice(bits) for _ in range(rng.choice([3, 30, 200]))) for _ in range(60)]
    docs = spark.createDataFrame([(f"d{i}", f"f{i}.md", t) for i, t in enumerate(texts)], "id string, filename string, text string").repartition(3)
    rows = lambda large: sorted(map(repr, chunking.chunk_documents(docs, large=large).collect()))
    assert rows(1 << 30) == rows(0) == rows(2000) and len(rows(0)) > 300


def test_a_section_of_any_length_takes_little_memory():
    lines = (f"satır {i} " + "kelime " * 8 if i % 9 else "" for i in range(400_000))  # 25 MB in one section
    tracemalloc.start()
    n = sum(1 for _ in M.chunks("d", "f", lines))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 5000 and peak < 2 << 20


def test_a_parent_is_cut_wherever_its_blocks_end():
    sizes = M.Sizes(parent=20)
    for n in range(60, 100):
        whole = f"{'a' * n}\n\n| id |\n\n{'b' * 30}"
        parent = next(c for c in M.chunks("d", "f", whole, sizes) if c["kind"] == "parent")
        assert parent["text"] == f"[Dosya: f]\n{whole[:80]}", n


def test_odd_markdown():
    assert [b.kind for b in M.pieces("```\n# kod\n\n```\n- a\n- b")] == ["code", "list"]
    assert [b.kind for b in M.pieces("# a\r\nb")] == ["paragraph"]  # a carriage return makes it no heading
    assert [b.path for b in M.pieces("### a\nx\n# b\ny") if b.kind == "paragraph"] == [("a",), ("b",)]
    assert M.split_long("...") == ["..."]
    assert len(M.split_long("x" * 9000)) == 1
    table = "\n".join(["| h |", "|---|", *[f"| {'x' * 50} |"] * 100])
    assert len(list(M.packed([M.Piece("paragraph", "a", None, ()), M.Piece("table", table, None, ())]))) == 2


def regulation(spark, md):
    """Chunks of one regulation, parents before children, in order; ids belong to the kind and ordinal."""
    docs = spark.createDataFrame([("r", "y.md", md)], "id string, filename string, text string")
    rows = sorted(chunking.chunk_regulations(docs).collect(), key=lambda r: (r.kind != "parent", r.ordinal))
    for kind in ("parent", "child"):
        own = [r for r in rows if r.kind == kind]
        assert [r.ordinal for r in own] == list(range(len(own)))
        assert all(r.id == M.chunk_id("r", kind, r.ordinal) for r in own)
    assert all(r.token_count == M.tokens(r.text) and r.probe == r.text for r in rows)
    return rows


def read_articles(spark, md):
    docs = spark.createDataFrame([("r", "y.md", md)], "id string, filename string, text string")
    return [(r.title, r.part, r.chapter, r.number, r.body) for r in chunking.parse_articles(docs).orderBy("pos").collect()]


def test_regulation_articles(spark):
    md = "## İKİNCİ KISIM Örgütlenme\n\n## İKİNCİ BÖLÜM Servislerin Görevleri\n\n## Servislerin Görevleri : Madde 11\n\nmetin\n\n## Bağlı Daireler - Madde 12\n\nbaşka\n"
    rows = regulation(spark, md)
    assert [r.section for r in rows] == ["Madde 11 - Servislerin Görevleri", "Madde 12 - Bağlı Daireler"]
    assert rows[0].metadata.part == "İKİNCİ KISIM Örgütlenme" and rows[0].metadata.chapter == "İKİNCİ BÖLÜM Servislerin Görevleri"
    assert rows[0].text == "[Dosya: y.md > İKİNCİ KISIM Örgütlenme > İKİNCİ BÖLÜM Servislerin Görevleri > Madde 11 - Servislerin Görevleri]\nMadde 11 - Servislerin Görevleri\n\nmetin"


def test_headings_of_parts_and_chapters(spark):
    # a part whose name is the next heading, though text stands between; a new part ends the chapter
    md = "## BİRİNCİ KISIM\n\nara\n\n## Genel Esaslar\n## BİRİNCİ BÖLÜM Yönetim: - Madde 13\nx\n## Üçüncü Kisim\r\n## ÜÇÜNCÜ BÖLÜM\n## Adı : Madde 3\n## Amaç - Madde 14\ny"
    assert read_articles(spark, md) == [("Yönetim", "BİRİNCİ KISIM Genel Esaslar", "BİRİNCİ BÖLÜM Yönetim", 13, ["x"]), ("Amaç", "Üçüncü Kisim", "ÜÇÜNCÜ BÖLÜM Adı : Madde 3", 14, ["y"])]
    both = "## BİRİNCİ KISIM İKİNCİ BÖLÜM Adlar : Madde 4\nx\n## İKİNCİ KISIM Ad - Madde 5\n## : Madde 6"
    assert read_articles(spark, both) == [("Adlar", "BİRİNCİ KISIM", "İKİNCİ BÖLÜM Adlar", 4, ["x"]), ("Ad", "İKİNCİ KISIM", None, 5, []), ("Madde 6", "İKİNCİ KISIM", None, 6, [])]


def test_halves_of_titles(spark):
    # the first half of a title is no text; any other loose heading goes to the article before, right before the next text
    md = "## A : Madde 20\n## Servis Şeflerinin\n\n## ve Uzmanların Görevleri : Madde 22\n## Gevşek başlık\n\n\nmetin\n## genel olarak\n## Şefler : Madde 23\n## son"
    assert read_articles(spark, md) == [("A", None, None, 20, [""]), ("Servis Şeflerinin ve Uzmanların Görevleri", None, None, 22, ["", "", "Gevşek başlık", "metin", "genel olarak"]), ("Şefler", None, None, 23, ["son"])]
    assert read_articles(spark, "## Genel\nmetin\n<!-- image -->\n") == [] and read_articles(spark, "") == []
    # a part or chapter on the same line leaves the half where it is
    assert read_articles(spark, "## A - Madde 1\n## Yarım\n## BİRİNCİ BÖLÜM ve Ad : Madde 2")[0][4] == ["Yarım"]


def test_services_and_inferred_numbers(spark):
    md = "## A : Madde 20\nx\n## Müdür Yardımcılarının Sorumlulukları :\ny\n## Servis Şeflerinin\n## ve Uzmanların Görevleri : Madde 22\nA) Ana Hizmet Birimleri\nI- Vergilendirme Bölümü\n- 1) Sicil Servisi\nkayıt\n- 2) Tecil Servisi\n"
    rows = regulation(spark, md)
    inferred = next(r for r in rows if r.metadata.article_no == "21")
    assert inferred.metadata.certain is False and "turetildi" in inferred.text
    assert any(r.metadata.title == "Servis Şeflerinin ve Uzmanların Görevleri" for r in rows)
    bare = next(r for r in rows if r.metadata.service == "Tecil Servisi")
    assert bare.text.endswith("2) Tecil Servisi") and bare.metadata.unit == "A) Ana Hizmet Birimleri" and bare.metadata.service_no == "2"
    parents = [r for r in rows if r.kind == "parent"]
    assert len(parents) == 1 and bare.parent_id == parents[0].id and inferred.parent_id is None
    assert bare.section == "Madde 22 - Servis Şeflerinin ve Uzmanların Görevleri > Tecil Servisi"


def test_segments_of_units(spark):
    body = ["giriş", "A) Ana Hizmet Birimleri", "I- Vergilendirme Bölümü", "madde,", "1) Sicil Servisi", "a) masa", "B) Başka Birim", "2. Takip Servisi,", "Takip Şubesinin Görevleri", "", "C) Diğer Hizmet Birimleri", "Uzun " * 40 + "Servisi"]
    arts = spark.createDataFrame([("r", 0, body)], "doc_id string, pos int, body array<string>")
    got = [(r.segment, r.unit, r.sub_unit, r.service, r.service_no, r.markers, r.lines) for r in chunking.split_segments(arts).orderBy("segment").collect()]
    a, i = "A) Ana Hizmet Birimleri", "I- Vergilendirme Bölümü"
    assert got == [
        (0, None, None, None, None, [], ["giriş"]),
        (1, a, i, None, None, [a, i], ["madde,"]),
        (2, a, i, "Sicil Servisi", None, [a, i, "Sicil Servisi"], ["a) masa"]),
        (3, None, None, None, None, ["B) Başka Birim"], ["2. Takip Servisi,"]),
        (4, None, None, "Takip Şubesi", None, ["Takip Şubesinin Görevleri"], ["Takip Şubesinin Görevleri"]),
        (5, "C) Diğer Hizmet Birimleri", None, None, None, ["C) Diğer Hizmet Birimleri"], ["Uzun " * 40 + "Servisi"]),
    ]


def test_pages(spark):
    entries = spark.createDataFrame([("d", 0, "kısa", 1), ("d", 1, "uzun bir cümle burada geçiyor ve devam ediyor", 2)], "doc_id string, pos int, norm_text string, page int")
    chunks = spark.createDataFrame([("c1", "d", "[Dosya: x]\nUzun bir  cümle burada geçiyor"), ("c2", "d", "az"), ("c3", "e", "uzun bir cümle burada")], "id string, doc_id string, text string").selectExpr("*", "cast(null as string) probe")
    assert {r.id: r.page for r in chunking.assign_pages(chunks, entries).collect()} == {"c1": 2, "c2": None, "c3": None}


def test_pages_against_every_entry(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["vergi", "daire", "ÖDEME", "12", "a", "ş", "tahakkuk", "sicil", "müdürlüğü", ".", "yapılır"])
    line = lambda n: " ".join(word() for _ in range(n))
    entries, chunks = [], []
    for d in range(12):
        own = [line(rng.choice([1, 1, 2, 3, 8, 30, 60])).lower() for _ in range(40)] + (["", "ab", "ö"] if d % 3 == 0 else [])
        rng.shuffle(own)
        entries += [(f"d{d}", i, t, i // 4) for i, t in enumerate(own)]
        for i in range(30):
            text = rng.choice(own)
            at = rng.randrange(max(1, len(text) // 2))
            body = rng.choice([text[at:], text[at:] + " " + line(5), line(3) + " " + text, line(20), text[:45] + " sapma", line(2)])
            chunks.append((f"d{d}c{i}", f"d{d}", f"[Dosya: x]\n{body}"))
    got = chunking.assign_pages(
        spark.createDataFrame(chunks, "id string, doc_id string, text string").selectExpr("*", "cast(null as string) probe"), spark.createDataFrame(entries, "doc_id string, pos int, norm_text string, page int")
    )
    want = {}
    for i, d, text in chunks:
        probe = " ".join(text.split("\n", 1)[1].lower().split())[:80]
        own = [(t, p) for e, _, t, p in entries if e == d] if len(probe) >= 15 else []
        want[i] = next((p for t, p in own if probe in t or t in probe), next((p for t, p in own if probe[:40] in t), None))
    assert {r.id: r.page for r in got.collect()} == want and len(set(want.values())) > 5


def test_pages_of_a_document_in_many_blocks(spark, monkeypatch):
    # entries of the first block, of a later one, within a probe, and again; what meets is not kept for each place of a text
    monkeypatch.setattr(chunking, "BLOCK_BYTES", 500)
    monkeypatch.setattr(chunking, "slices", lambda b, c: (b.slice(i, 3) for i in range(0, b.num_rows, 3)))
    line = lambda i: f"satır {i} burada geçiyor ve devam ediyor, sonra da {i * 7} numara ile bitiyor"
    entries = [("d", i, line(i) if i % 10 else "satır", i) for i in range(1, 300)] + [("e", 5, "", 50), ("e", 6, line(4), 60), ("f", 1, line(3), 1)]
    chunks = [(f"d{i}", "d", line(i)[:60 + i % 15]) for i in range(1, 300)] + [("e4", "e", line(4)), ("f3", "f", line(3)[:41] + " başka"), ("g", "g", line(3))]
    asked = spark.createDataFrame(chunks, "id string, doc_id string, probe string").repartition(3)
    found = chunking.first_entries(asked, spark.createDataFrame(entries, "doc_id string, pos int, norm_text string, entry_page int"))
    got = chunking.assign_pages(asked.withColumn("text", F.col("probe")), spark.createDataFrame(entries, "doc_id string, pos int, norm_text string, page int"))
    want = {i: next((g for e, _, t, g in entries if e == d and (p in t or t in p)), next((g for e, _, t, g in entries if e == d and p[:40] in t), None)) for i, d, p in chunks}
    assert {r.id: r.page for r in got.collect()} == want and want["d1"] == 1 and want["d30"] == 10 and want["e4"] == 50 and want["f3"] == 1 and want["g"] is None
    assert found.where("id = 'd1'").count() > 1


def test_long_texts_are_cut_a_slice_at_a_time(spark, monkeypatch):
    from pyspark.sql import functions as F

    from docketry.operators import search

    # of a batch of a hundred texts, parts of ten thousand bytes or so
    monkeypatch.setattr(chunking, "slices", lambda b, c: search.slices(b, c, 10_000))
    docs = spark.range(100, numPartitions=1).select(F.col("id").cast("string"), F.when(F.col("id") % 9 > 0, F.repeat(F.concat(F.lit("Bir cümle "), "id", F.lit(". ")), (F.col("id") * 9).cast("int"))).alias("text"))
    want = docs.select("id", F.posexplode(chunking.split_long_text("text")).alias("pos", "piece"))
    assert sorted(chunking.split_texts(docs).collect()) == sorted(want.collect())
    assert chunking.parse_blocks(docs.withColumn("filename", F.lit("f"))).count() == docs.where("length(text) > 0").count()
