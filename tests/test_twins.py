"""SQL twins on small tables that larger data holds: fields without pairs, fields on one part of the sky, ties and half turns."""

import duckdb
from pyspark.sql import functions as F

from fieldlink.operators import legacy
from fieldlink.queries import all_oracles


def rows(name, cells):
    """The twin of a query over events: cells of (event type, user, day, count)."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_type VARCHAR, user_id BIGINT, ts TIMESTAMP)")
    for kind, user, day, n in cells:
        con.execute("INSERT INTO events SELECT ?, ?, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(? AS INTEGER)) FROM range(?)", [kind, user, day, n])
    cur = con.execute(all_oracles()[name])
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def test_fields_without_pairs_are_listed():
    cells = [("click", 3, 4, 9), ("view", 161, 6, 1)]
    for name in ("edge_diagnostics", "association_diagnostics"):
        found = rows(name, cells)
        assert [(r["field_id"], r["n_nodes"], r["n_candidate_pairs"], r["warning"]) for r in found] == [("click_0", 1, 0, "no_candidate_pairs")]
    found = {r["field_id"]: (r["n_gaussians_matched"], r["warning"]) for r in rows("matching_diagnostics", cells)}
    assert found == {"click_0": (1, ""), "view_1": (0, "no_gaussians_matched")}


def test_rows_match_every_field_that_covers_them():
    found = rows("match_components", [("click", 20 * 160 + 3, 4, 9), ("error", 7, 6, 8), ("view", 7, 6, 8)])
    assert sorted((r["field_id"], r["component_id"], r["component_index"]) for r in found) == [
        ("click_20", 131, 1), ("click_20", 199, 0), ("error_0", 131, 1), ("error_0", 199, 0), ("view_0", 199, 0)]


def test_strongest_evidence_of_equal_scores_has_the_smallest_indices(spark):
    edges = spark.createDataFrame([("f", 0, 0, 1, 0.3, "first"), ("f", 0, 1, 2, 0.1 + 0.2, "second")],
                                  "field_id string, gid int, component_index_1 int, component_index_2 int, merge_score double, positive_evidence string")
    assert legacy.strongest_evidence(edges).first().strongest_merge_evidence == "first"


def test_rounded_axes_stay_below_a_half_turn(spark):
    from fieldlink.queries.group_queries import tidy_angles

    found = tidy_angles(spark.createDataFrame([(179.99999999, 1.0, 28.568749999999998)], "group_PA double, axis_ratio double, centroid_x double")).first()
    assert (found.group_PA, found.centroid_x) == (0.0, 28.5688)
