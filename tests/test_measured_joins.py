"""No side of a join is broadcast by the size of its files."""

from fieldlink.lineage import measured_joins
from fieldlink.queries import all_queries

SF = "/root/testdata/sf0.01"


def plans_of(monkeypatch, *modules) -> list[str]:
    """The plans of all tables that the modules write from now on, as planned before they run."""
    seen = []
    for module in modules:
        def noted(df, write=module.cut):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df)

        monkeypatch.setattr(module, "cut", noted)
    return seen


def test_matching_plans_no_broadcast(spark, monkeypatch):
    queries = all_queries()
    from fieldlink.operators import graph
    from fieldlink.queries import graph_queries

    seen = plans_of(monkeypatch, graph, graph_queries)
    out = queries["capped_matching"](spark, SF)
    assert any("Join" in p for p in seen)
    assert not any("BroadcastHashJoin" in p for p in seen)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 13891


def test_membership_plans_no_broadcast(spark, monkeypatch):
    queries = all_queries()
    from fieldlink.operators import cluster, graph
    from fieldlink.queries import group_queries
    from fieldlink.queries.base import forget

    forget()
    seen = plans_of(monkeypatch, graph, cluster, group_queries)
    out = queries["group_membership"](spark, "/root/testdata/sf0.001")
    assert sum("Join" in p for p in seen) > 3
    assert not any("BroadcastHashJoin" in p for p in seen)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1500


def test_measured_joins_keep_the_limit_of_the_session(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    limit = before[1] or spark.conf.get(names[0])
    with measured_joins(spark), measured_joins(spark):
        assert [spark.conf.get(n, None) for n in names] == ["-1", limit]
    assert [spark.conf.get(n, None) for n in names] == before
