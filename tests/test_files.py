import json

from docketry.operators import correspondence
from docketry.sources import files


def test_scan_and_read(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "A.TXT").write_text("merhaba")
    (tmp_path / ".gizli.txt").write_text("x")
    (tmp_path / "b.exe").write_text("x")
    rows = files.with_file_identity(files.scan_files(spark, str(tmp_path))).collect()
    assert [(r.filename, r.format, r.size_bytes) for r in rows] == [("A.TXT", "txt", 7)]
    assert [r.text for r in files.read_text_documents(spark, str(tmp_path)).collect()] == ["merhaba"]


def test_a_scan_keeps_no_list_of_files_in_the_driver(spark, tmp_path):
    for name in ("a b/ş.md", "a b/c/d.TXT", "a b/c/x%20.txt", "_x/h.txt", "_y=1/k.txt", ".z/h.txt", "_h.txt", "e.bin", "f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name * 2)
    rows = files.scan_files(spark, str(tmp_path))
    listed = files.scan_files(spark, f"file://{tmp_path}", content=False)
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).where("NOT path LIKE '%.bin'")
    assert sorted(rows.collect()) == sorted(plain.select(*rows.columns).collect()) and rows.count() == 5
    assert sorted(listed.collect()) == sorted(plain.drop("content").collect())
    # what the driver lists are the tables of the listing, a few for each level of folders
    assert all("/docketry/listing-" in f for f in rows.inputFiles() + listed.inputFiles())
    (tmp_path / "none").mkdir()
    assert files.scan_files(spark, str(tmp_path / "none")).count() == 0


def test_model_output(spark):
    rows = [("a", 1, "{bad"), ("a", 2, '{"k": 3, "kind": "x"}'), ("b", 1, '{"k": 99, "kind": "x"}'), ("c", 1, None)]
    got = files.parse_model_output(spark.createDataFrame(rows, "id string, attempt int, raw string"), "struct<k:int,kind:string>", ("k",), {"kind": ("x",)}, {"k": (0, 10)})
    assert {r.id: (r.ok, r.attempt) for r in got.collect()} == {"a": (True, 2), "b": (False, None), "c": (False, None)}


def test_golden(spark, tmp_path):
    questions = [{"id": "g1", "scenario": "trap", "question": "?", "expectedDocs": [], "expectedAnswerContains": []}, {"id": "g2", "scenario": "entity", "question": "?", "expectedDocs": ["İSTANBUL.pdf"], "expectedAnswerContains": ["İzmir"], "expectedAnswerNotContains": ["ankara"]}]
    (tmp_path / "g.json").write_text(json.dumps({"questions": questions}))
    golden = files.read_golden(spark, str(tmp_path / "g.json"))
    answers = spark.createDataFrame([("t", "g1", "Bilgi bulunamadı.", ["x"], None), ("t", "g2", "izmir ve ANKARA", ["/d/istanbul.PDF"], None), ("u", "g2", None, None, "hata")], "target string, id string, answer string, sources array<string>, error string")
    got = {(r.target, r.id): (r.source_hit, r.trap_passed, r.answer_hit, r.forbidden_hit) for r in correspondence.grade_answers(answers, golden).collect()}
    assert got == {("t", "g1"): (None, True, None, None), ("t", "g2"): (True, None, True, True), ("u", "g1"): (None, False, None, None), ("u", "g2"): (False, None, False, None)}
    rates = correspondence.compare_targets(correspondence.grade_answers(answers, golden)).orderBy("target").collect()
    assert [(r.trap_rate, r.answer_rate, r.clean_rate) for r in rates] == [(1.0, 1.0, 0.0), (0.0, 0.0, 1.0)]


def test_the_folder_of_files_has_no_folder_a_file(spark):
    from docketry import registered

    d = "/root/testdata/sf0.001"
    found = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(registered.folder_of_files(spark, d)).select("path").collect() if r.path.endswith(".txt")]
    assert len(found) == spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").count()
    assert len({p.rsplit("/", 1)[0] for p in found}) <= 64
