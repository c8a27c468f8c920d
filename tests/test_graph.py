"""Clustering, greedy selection, ranking and range joins against plain Python."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlink.config import Config
from fieldlink.operators.cluster import cluster_components
from fieldlink.operators.farthest import largest_distance
from fieldlink.operators.graph import cluster, coincident_matching, greedy_matching
from fieldlink.operators.pairs import candidate_pairs
from fieldlink.operators.ranking import exact_median, running_total

EDGE = "field_id string, component_index_1 long, component_index_2 long, edge_type string, association_decision boolean, association_score double, rejection_reason string"


def sequential_weak(nodes, edges):
    """Strong cores, then weak edges one by one."""
    home = {n: n for n in nodes}

    def root(n):
        while home[n] != n:
            n = home[n]
        return n

    for a, b, kind, _ in edges:
        if kind == "strong":
            x, y = root(a), root(b)
            home[max(x, y)] = min(x, y)
    first = {n: root(n) for n in nodes}
    size = {r: sum(first[n] == r for n in nodes) for r in set(first.values())}
    group, attached, reasons = dict(first), set(), {}
    for a, b, kind, s in sorted((e for e in edges if e[2] == "weak"), key=lambda e: (-e[3], e[0], e[1])):
        if group[a] == group[b]:
            reasons[a, b] = "weak_edge_already_same_group"
            continue
        core = [size[first[n]] >= 2 for n in (a, b)]
        free = [not c and n not in attached for c, n in zip(core, (a, b))]
        if (core[0] and free[1]) or (core[1] and free[0]):
            mover, target = (b, a) if core[0] else (a, b)
            group[mover] = group[target]
            attached.add(mover)
            reasons[a, b] = ""
        elif all(core):
            reasons[a, b] = "weak_edge_would_merge_core_groups"
        elif not any(core):
            reasons[a, b] = "weak_edge_no_core_group"
        else:
            reasons[a, b] = "weak_edge_would_form_chain"
    return {frozenset(n for n in nodes if group[n] == g) for g in set(group.values())}, reasons


def test_weak_attachment_equals_the_sequential_pass(spark):
    rng = random.Random(3)
    scenes = {"chain": ([0, 1, 2, 3, 4], [(0, 1, "strong", 4.0), (1, 2, "weak", 2.5), (2, 3, "weak", 2.4), (3, 4, "strong", 4.0)])}
    for k in range(40):
        nodes = list(range(10))
        scenes[f"r{k}"] = (nodes, [(a, b, rng.choice(["strong", "weak", "weak", "weak", "rejected", "rejected"]), rng.randrange(20, 40) / 10) for a, b in combinations(nodes, 2) if rng.random() < 0.3])
    rows = [(f, a, b, t, t == "strong", s, "") for f, (_, es) in scenes.items() for a, b, t, s in es]
    comps = spark.createDataFrame([(f, n) for f, (ns, _) in scenes.items() for n in ns], "field_id string, component_index long")
    decided, members, groups = cluster_components(comps, spark.createDataFrame(rows, EDGE), Config())
    got_groups, got_reasons = {}, {}
    for r in members.collect():
        got_groups.setdefault((r.field_id, r.gid), set()).add(r.component_index)
    for r in decided.filter("edge_type = 'weak'").collect():
        got_reasons[r.field_id, r.component_index_1, r.component_index_2] = r.rejection_reason
    for f, (nodes, es) in scenes.items():
        want_groups, want_reasons = sequential_weak(nodes, es)
        assert {frozenset(v) for (g, _), v in got_groups.items() if g == f} == want_groups
        assert {k[1:]: v for k, v in got_reasons.items() if k[0] == f} == want_reasons
    first = groups.filter("field_id = 'chain'").orderBy("group_index").collect()
    assert [(r.association_group_id, r.n_gaussians) for r in first] == [("chain_a000", 3), ("chain_a001", 2)]


@pytest.mark.parametrize("capacity", [1, 2])
def test_greedy_matching_equals_the_sequential_pass(spark, capacity):
    rng = random.Random(capacity)
    rows = [(f, a, b, rng.randrange(1000)) for f in range(20) for a, b in combinations(range(9), 2) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "f int, a long, b long, w long")
    got = {(r.f, r.a, r.b) for r in greedy_matching(df, ["f"], "a", "b", [-F.col("w"), F.col("a"), F.col("b")], capacity).collect()}
    want, used = set(), {}
    for f, a, b, w in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if used.get((f, a), 0) < capacity and used.get((f, b), 0) < capacity:
            want.add((f, a, b))
            for n in (a, b):
                used[f, n] = used.get((f, n), 0) + 1
    assert got == want


@pytest.mark.parametrize("capacity", [1, 2, 3])
def test_coincident_points_then_the_rest_equal_the_sequential_pass(spark, capacity):
    rng = random.Random(capacity)
    rows = [(f, i, float(rng.randrange(4)), float(rng.randrange(2)), 1.0) for f in range(6) for i in range(40)]
    points = spark.createDataFrame(rows, "field_id int, component_index long, x double, y double, pixel_scale double")
    same, free = coincident_matching(points, ["field_id"], "component_index", ["x", "y"], capacity)
    near = F.pow(F.col("x_2") - F.col("x_1"), 2) + F.pow(F.col("y_2") - F.col("y_1"), 2)
    found = candidate_pairs(free, Config(), carry=("room",)).filter("x_1 != x_2 OR y_1 != y_2").withColumn("near", near)
    ends = ["component_index_1", "component_index_2"]
    rest = greedy_matching(found, ["field_id"], *ends, [F.col("near"), *map(F.col, ends)], capacity, ("room_1", "room_2"))
    got = [tuple(r) for r in same.unionByName(rest.select("field_id", *ends)).collect()]
    want, used = set(), {}
    for f in range(6):
        mine = [r for r in rows if r[0] == f]
        for _, i, j in sorted(((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, a[1], b[1]) for a, b in combinations(mine, 2)):
            if used.get((f, i), 0) < capacity and used.get((f, j), 0) < capacity:
                want.add((f, i, j))
                for n in (i, j):
                    used[f, n] = used.get((f, n), 0) + 1
    assert len(got) == len(want) and set(got) == want


def test_a_crowded_place_is_matched_without_its_pairs(spark):
    points = spark.range(200_000).select(F.lit(0).alias("f"), F.col("id").alias("n"), F.lit(0.0).alias("x"))
    same, free = coincident_matching(points, ["f"], "n", ["x"], 2)
    assert same.count() == 199_998 + 1 and [(r.n, r.room) for r in free.orderBy("n").collect()] == [(199_998, 1), (199_999, 1)]


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.lit("x").alias("k"), F.col("id").alias("s"), (F.col("id") + 1).alias("d"))
    nodes = spark.range(305).select(F.lit("x").alias("k"), F.col("id").alias("n"))
    out = cluster(nodes, edges, ["k"], "n", "s", "d", "label")
    assert out.filter("label = 0").count() == 301 and out.select("label").distinct().count() == 5


def test_largest_distance_of_small_and_large_sets(spark):
    rng = np.random.default_rng(0)
    sets = {0: rng.normal(size=(1, 2)), 1: rng.normal(size=(5, 2)), 2: rng.normal(size=(700, 2)), 3: np.column_stack([np.arange(100.0), np.zeros(100)])}
    rows = [(k, float(x), float(y)) for k, pts in sets.items() for x, y in pts]
    got = {r.k: r.d for r in largest_distance(spark.createDataFrame(rows, "k int, px double, py double"), ["k"], "d").collect()}
    for k, pts in sets.items():
        assert got[k] == pytest.approx(np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)).max(), abs=1e-9)


def test_positions_and_medians(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([1.0, 2.0, 2.5, 7.25, float(i)])) for k in range(3) for i in range(101 + k)]
    df = spark.createDataFrame(rows, "k int, i long, v double")
    ranked = running_total(df, ["k"], [F.floor(F.col("i") / 10)], [F.col("i")], "pos", F.lit(2))
    assert ranked.filter("pos != 2 * i").count() == 0
    got = {r.k: r.m for r in exact_median(df, ["k"], "v", "m").collect()}
    for k in range(3):
        assert got[k] == np.median([v for q, _, v in rows if q == k])


def test_pairs_with_uneven_scales_and_spatial_limits(spark):
    rng = random.Random(1)
    rows = [(f, i, rng.uniform(-50, 300), rng.uniform(-50, 300), s) for f, s in (("a", 1.0), ("b", 0.5)) for i in range(60)]
    comps = spark.createDataFrame(rows, "field_id string, component_index long, x double, y double, pixel_scale double")
    got = {(r.field_id, r.component_index_1, r.component_index_2) for r in candidate_pairs(comps, Config()).collect()}
    want = {(p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and np.hypot(p[2] - q[2], p[3] - q[3]) * p[4] <= 90.0}
    assert got == want
