"""Greedy one-to-one and capped matching of component pairs, nearest pairs first."""

from pyspark.sql import functions as F

from fieldlink import fixtures as fx
from fieldlink.lineage import cut, measured_joins
from fieldlink.operators import pairs
from fieldlink.operators.graph import coincident_matching, greedy_matching
from fieldlink.queries.base import cte, query

cte("near_pairs", """
SELECT a.field_id, a.component_index AS i, b.component_index AS j,
 row_number() OVER (PARTITION BY a.field_id ORDER BY (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y), a.component_index, b.component_index) AS k
FROM components a JOIN components b ON a.field_id = b.field_id AND a.component_index < b.component_index AND abs(b.x-a.x) <= 90 AND abs(b.y-a.y) <= 90
WHERE (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) <= 8100""", "components")


def walk_sql(name: str, source: str, capacity: int) -> str:
    """One pair of every field after the other, with the list of taken ends so far; ``source`` has field_id, i, j and the place k."""
    free = lambda end: f"len(list_filter(used, lambda u: u = p.{end})) < {capacity}"
    return f"""
SELECT DISTINCT field_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(false AS BOOLEAN) AS took FROM {source}
UNION ALL
SELECT w.field_id, p.k, CASE WHEN {free('i')} AND {free('j')} THEN list_concat(used, [p.i, p.j]) ELSE used END, {free('i')} AND {free('j')}
FROM {name} w JOIN {source} p ON p.field_id = w.field_id AND p.k = w.k + 1"""


def matched(spark, sf, capacity: int):
    # Pairs of one place come first and are known without listing them; the others are between what is free after them.
    with measured_joins(spark):
        components = cut(fx.components(spark, sf).select("field_id", "component_index", "x", "y", "pixel_scale"))
        same, free = coincident_matching(components, ["field_id"], "component_index", ["x", "y"], capacity)
        found = pairs.candidate_pairs(cut(free), fx.WIDE, carry=("room",)).filter("x_1 != x_2 OR y_1 != y_2")
        near = F.pow(F.col("x_2") - F.col("x_1"), 2) + F.pow(F.col("y_2") - F.col("y_1"), 2)
        ends = ["field_id", "component_index_1", "component_index_2"]
        slim = found.select(*ends, near.alias("near"), "room_1", "room_2")
        order = [F.col("near"), F.col("component_index_1"), F.col("component_index_2")]
        kept = greedy_matching(slim, ["field_id"], "component_index_1", "component_index_2", order, capacity, ("room_1", "room_2"))
        return same.unionByName(cut(kept.select(*ends)))


for _capacity, _name in ((1, "exclusive_matching"), (2, "capped_matching")):
    cte(f"matched_{_capacity}", walk_sql(f"matched_{_capacity}", "near_pairs", _capacity), "near_pairs")
    query(_name, f"""
SELECT field_id, i AS component_index_1, j AS component_index_2 FROM matched_{_capacity} JOIN near_pairs USING (field_id, k) WHERE took""",
          (f"matched_{_capacity}", "near_pairs"))(lambda spark, sf, capacity=_capacity: matched(spark, sf, capacity))
