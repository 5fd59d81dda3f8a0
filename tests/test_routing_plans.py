import pytest

from docketry.operators import routing

DECISION = "decision_id string, main_unit string, other_unit string, service string, sub_service string, citations array<struct<article_no:string,title:string>>, confidence double, undetermined boolean, reasoning string"
HIT = "decision_id string, rank int, article_no string, service string, service_no string, unit string, sub_unit string, certain boolean"


@pytest.fixture
def unmeasured(spark):
    """Plans as they are made for tables too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df, which):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_overrides_are_not_shuffled_by_service(spark, unmeasured):
    docs = spark.createDataFrame([("a", None, None, None, None)], "id string, routed_service string, routing_reasoning string, routing_confidence double, routing_status string")
    overrides = spark.createDataFrame([("a", "S1", "r1", 1), ("a", "S2", "r2", 2), ("a", "S9", "r3", 3)], "id string, service string, reason string, at int")
    out = routing.apply_manual(docs, overrides, spark.createDataFrame([("S1",), ("S2",), ("S2",)], "service string"))
    assert [tuple(r) for r in out.collect()] == [("a", "S2", "r2", 1.0, "routed")]
    semi = [line for line in plan(out, "sparkPlan").splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)


def test_names_of_hits_are_normalised_once(spark):
    decisions = spark.createDataFrame([("1", None, None, "Tecil", None, [], 0.5, False, ""), ("2", None, None, "Yok", None, [], 0.5, False, "")], DECISION)
    hits = spark.createDataFrame([(d, r, "11", s, "1", "A)", "I-", True) for d in "12" for r, s in ((1, "Tecil Servisi"), (2, "Sicil Servisi"))], HIT)
    out = routing.grading_context(decisions, hits)
    assert out.columns == hits.columns
    assert sorted((r.decision_id, r["rank"]) for r in out.collect()) == [("1", 1), ("2", 1), ("2", 2)]
    assert plan(out, "optimizedPlan").count("regexp_replace") <= 4


def test_reconciled_decisions_stay_as_many(spark):
    one = ("1", None, None, "tecil servisi", None, [], 0.5, False, "")
    hits = spark.createDataFrame([("1", 1, "11", "Tecil Servisi", "1", "A) Ana Hizmet Birimleri", "II- Muhasebe", True)], HIT)
    out = routing.reconcile_units(spark.createDataFrame([one, one], DECISION), hits).collect()
    assert [(r.service, r.main_unit, r.corrected) for r in out] == [("Tecil Servisi", "Muhasebe", True)] * 2
