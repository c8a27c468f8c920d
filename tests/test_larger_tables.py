"""What steps write and shuffle must not grow beyond what later steps read."""

from fieldlink.operators import evidence
from fieldlink.queries import all_queries

SF = "/root/testdata/sf0.001"


def test_clustering_writes_no_rejected_edges(spark):
    all_queries()
    from fieldlink.queries import group_queries
    from fieldlink.queries.edge_queries import wide_edges

    slim = group_queries.linking_edges(spark, SF)
    assert len(slim.columns) == 7
    whole = wide_edges(spark, SF).select(*slim.columns)
    assert whole.filter("edge_type = 'rejected'").count() > 0
    assert sorted(map(tuple, slim.collect())) == sorted(map(tuple, whole.filter("edge_type <> 'rejected'").collect()))


def test_small_tiles_and_shared_tiles_give_the_same_evidence(spark, monkeypatch):
    from fieldlink.operators import paths
    from tests.test_edges import bar_edges

    whole = bar_edges(spark).orderBy(*evidence.PAIR).collect()
    assert len(whole) == 3 and all(r.bridge_score > 0 for r in whole)
    monkeypatch.setattr(paths, "TILE_SIDE", 8)
    monkeypatch.setattr(paths, "GROUP_PAIRS", 1 / 3)
    cut_up = bar_edges(spark)
    plan = cut_up._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert cut_up.orderBy(*evidence.PAIR).collect() == whole


def test_corridors_are_read_in_tiles(spark):
    queries = all_queries()
    found = queries["corridor_profile"](spark, "/root/testdata/sf0.01").filter("field_id < 'd'")
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
