import pytest
from pyspark.sql import functions as F

from docketry.functions import text as X


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize("s, ok", [("10000000146", True), ("10000000145", False), ("10000000246", False), ("00000000146", False), ("1000000014", False), ("11111111111", False), (None, False)])
def test_person_number(spark, s, ok):
    assert values(spark, [(s,)], "s string", X.is_valid_tckn(F.col("s"))) == [(ok,)]


@pytest.mark.parametrize("s, ok", [("4840847211", True), ("4840847212", False), ("1111111111", False), ("484084721", False), ("1234567890", True)])
def test_tax_number(spark, s, ok):
    assert values(spark, [(s,)], "s string", X.is_valid_vkn(F.col("s"))) == [(ok,)]


@pytest.mark.parametrize("prefix", ["484084721", "390038366", "123456789", "900000000"])
def test_one_check_digit(spark, prefix):
    got = values(spark, [(prefix + str(i),) for i in range(10)], "s string", X.is_valid_vkn(F.col("s")))
    assert sum(g[0] for g in got) == 1


def test_validate_and_extract(spark):
    rows = [(" 484 084 7211 ",), ("100.000.001.46",)]
    assert values(spark, rows, "s string", X.validate_vkn(F.col("s"))) == [("4840847211",), ("10000000146",)]
    text = "TCKN 10000000146, VKN 4840847211, 1234567891, 15000 ve 2026-01-15"
    got = values(spark, [(text,)], "s string", X.extract_identifiers(F.col("s")).alias("x"))[0][0]
    assert (got.tckn, got.vkn) == (["10000000146"], ["4840847211"])


@pytest.mark.parametrize(
    "phrase, text, want",
    [
        ("Motorlu Taşıtlar Vergisi", "motorlu tasitlar vergisi borcu", "Motorlu Taşıtlar Vergisi"),
        ("karaye nakliyat vergisi (KDV)", "KDV iadesi", "KDV"),
        ("2026 yılı motorlu taşıtlar vergisi cezası", "2026 yılı motorlu taşıtlar vergisi için", "2026 yılı motorlu taşıtlar vergisi"),
        ("emlak vergisi", "gelir tablosu", ""),
        ("özel vergisi", "bir vergisi", ""),
        ("  ", "x", ""),
    ],
)
def test_grounding(spark, phrase, text, want):
    assert values(spark, [(phrase, text)], "p string, t string", X.ground_phrase(F.col("p"), F.col("t"))) == [(want,)]


@pytest.mark.parametrize("s, want", [("M.11-A-I-2-f", "11"), ("Madde 11", "11"), ("11", "11"), (" x ", "x")])
def test_article_number(spark, s, want):
    assert values(spark, [(s,)], "s string", X.article_number(F.col("s"))) == [(want,)]


def test_citation_path(spark):
    got = values(spark, [("11-A-I-2-f",)], "s string", X.parse_citation(F.col("s")).alias("p"))[0][0]
    assert tuple(got) == ("11", "A", "I", "2")


def test_service_names(spark):
    a, b = "Sürekli Yükümlülükler Vergilendirme Servisi", "Süreksiz Yükümlülükler Vergilendirme Servisi"
    assert values(spark, [(a, b)], "a string, b string", X.same_service(F.col("a"), F.col("b")), X.same_service_strict(F.col("a"), F.col("b"))) == [(True, False)]
    rows = [("İhtilaflı İşler Servisi",), ("IHTILAFLI ISLER",), ("Tecil",), (None,), ("",)]
    assert values(spark, rows, "s string", X.is_dispute(F.col("s"))) == [(True,), (True,), (False,), (False,), (False,)]


@pytest.mark.parametrize(
    "reply, source, want",
    [
        ("18.247,00 TL ödenir", "tutar 18.247 TL", []),
        ("36 taksit ve %2,5 faiz", "2025/3 dönemi", ["36", "2,5"]),
        ("1 taksit", "", []),
        ("6183 sayılı", "6183 sayılı kanun", []),
    ],
)
def test_numbers(spark, reply, source, want):
    assert values(spark, [(reply, source)], "r string, s string", X.unsupported_numbers(F.col("r"), F.col("s"))) == [(want,)]


def test_term_id(spark):
    def fnv(s):
        h = 2166136261
        for c in s.encode():
            h = (h ^ c) * 16777619 % 2**32
        return h

    words = ["a", "vergi", "dairesi2026"]
    assert values(spark, [(w,) for w in words], "s string", X.term_id(F.col("s"))) == [(fnv(w),) for w in words]


def test_not_found(spark):
    rows = [("Bu BİLGİ dokümanlarda BULUNAMADI.",), ("Servis bellidir",)]
    assert values(spark, rows, "s string", X.is_not_found(F.col("s"))) == [(True,), (False,)]


def test_letter_numbers_on_written_rows(spark, tmp_path):
    """Each number once, from the start without gaps, whatever the unit of time and the number of partitions."""
    from docketry.operators import correspondence

    made = "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(pmod(hash(id), 90) as int), cast(pmod(hash(id, 1), 24) as int))"
    letters = spark.range(20000).selectExpr("cast(id as string) id", f"if(id % 97 = 0, null, {made}) created_at", "id % 5 <> 0 saved")
    want = None
    for unit, parts in (("day", 1), ("day", 64), ("hour", 7), ("month", 4)):
        path = str(tmp_path / f"{unit}{parts}")
        correspondence.assign_letter_numbers(letters.repartition(parts), 48, unit).write.parquet(path)
        rows = spark.read.parquet(path).select("id", "letter_no").collect()
        assert sorted(r.letter_no for r in rows if r.letter_no is not None) == list(range(48, 48 + 16000))
        want = want or sorted(map(tuple, rows), key=str)
        assert sorted(map(tuple, rows), key=str) == want


def test_a_text_is_folded_once_for_all_runs_of_a_phrase(spark):
    from pyspark.sql import functions as F

    from docketry.functions import text as X

    rows = spark.createDataFrame([(1, "Şu Iğdır yolu uzun"), (2, None), (3, "")], "n int, body string")
    found = rows.select("n", X.ground_phrase(F.lit("öte ığdır yolu"), F.col("body")).alias("v"))
    plan = found._jdf.queryExecution().analyzed().toString().split("\n")[0]
    assert plan.count("body#") == 1
    assert {r.n: r.v for r in found.collect()} == {1: "ığdır yolu", 2: "", 3: ""}
