import contextlib
import io

from docketry import registered

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_what_follows_sparse_hits_makes_no_dense_index_and_shuffles_no_texts(spark):
    own = f"{DATA}/."
    hits = registered.hits_of(spark, own)
    assert not [k for k in registered.INDEXES if k[1] == own and "dense" in k[2]]
    # the hits are written down: Spark knows that they are few, and sends them to the texts
    assert plan_of(hits.select("query_id", "text")).count("BroadcastHashJoin") >= 2
    assert hits.count() == registered.sparse_leg(spark, own).count() > 0


def test_texts_are_not_sorted_for_their_labels(spark):
    plan = plan_of(registered.documents(spark, DATA, "shuffle_hash").select("id", "text", "contains_pii"))
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
    assert sorted(registered.documents(spark, DATA, "shuffle_hash").collect()) == sorted(registered.documents(spark, DATA).collect())
