import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from docketry.llm import decontaminate, jaccard, pii, quality
    from docketry.llm._shared import table

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "pii", "mix"]
    docs = table(spark, DATA, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns
        before = {r.doc_id: r.text for r in docs.collect()}
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        kept = {r.doc_id: r.text for r in after.collect()}
        if k == 0:
            assert set(kept) == {r.doc_id for r in quality.scored(docs, table(spark, DATA, "labels")).where("predicted = 1").collect()}
        elif k == 1:
            assert set(kept) == {r.doc_id for r in jaccard.near_duplicates(docs).where("doc_id = component_id").collect()}
        elif k == 2:
            assert set(kept) == {r.doc_id for r in decontaminate.report(docs, table(spark, DATA, "benchmark")).where("NOT contaminated").collect()}
        elif k == 3:
            weights = pii.fitted(docs)
            assert kept == {d: pii.redacted(t, pii.spans_of(t, weights)[1]) for d, t in before.items()}
            assert all(r.n_chars == len(r.text) for r in after.collect())
        else:
            assert set(kept) == set(before) and sorted(r.mix_position for r in after.collect()) == list(range(len(before)))
        docs = after
    assert corpus_pipeline.run(spark, DATA).count() == len(kept)
    assert corpus_pipeline.ORACLE_SQL is None


def test_the_pipeline_is_registered():
    import __spark_entry__
    import corpus_pipeline

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
