"""Long chains, big groups and images of many blocks against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from fieldlink.config import Segmentation
from fieldlink.operators import raster
from fieldlink.operators.graph import component_labels, greedy_matching, maximum_spanning_forest
from fieldlink.operators.ranking import exact_median


@pytest.mark.parametrize("capacity", [1, 2])
def test_matching_of_a_long_monotone_chain(spark, capacity):
    n = 5000
    # The second half hangs on the first by more edges per node, so that capacity 2 has something to refuse.
    rows = [("c", i, i + 1, i) for i in range(n)] + [("c", i, i + 7, n + i) for i in range(0, n, 3)]
    df = spark.createDataFrame(rows, "f string, a long, b long, w long")
    got = {(r.a, r.b) for r in greedy_matching(df, ["f"], "a", "b", [F.col("w")], capacity).collect()}
    used, want = {}, set()
    for _, a, b, _ in rows:
        if used.get(a, 0) < capacity and used.get(b, 0) < capacity:
            want.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    assert got == want
    assert greedy_matching(df.limit(0), ["f"], "a", "b", [F.col("w")], capacity).count() == 0


def test_components_of_many_edges(spark):
    rng = random.Random(1)
    n = 230_000
    edges = [(i, i - rng.randint(1, min(i, 40)), "k") for i in range(1, n) if i % 1000] + [(i, i, "k") for i in (5, n + 9)]
    found = component_labels(spark.createDataFrame(edges, "s long, d long, k string").repartition(4), ["k"], "s", "d")
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, _ in edges[:-2]:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = found.toPandas()
    assert len(got) == len({x for e in edges[:-2] for x in e[:2]})
    assert all(root(a) == b for a, b in zip(got["node"].tolist(), got["label"].tolist()))


def test_spanning_forest_equals_one_edge_at_a_time(spark):
    rng = random.Random(2)
    rows = [(f, a, b, float(rng.randrange(12)) if rng.random() < 0.9 else None) for f in range(6) for a in range(40) for b in rng.sample(range(a + 1, 48), 5 if a < 38 else 1)]
    rows += [(9, i, i + 1, 1.0) for i in range(700)] + [(9, 3, 3, 5.0)]
    got = sorted((r.f, r.a, r.b) for r in maximum_spanning_forest(spark.createDataFrame(rows, "f int, a long, b long, w double"), ["f"], "a", "b", "w").collect())
    home, want = {}, []

    def root(x):
        while home.setdefault(x, x) != x:
            x = home[x]
        return x

    for f, a, b, _ in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[0], -r[3], r[1], r[2])):
        x, y = root((f, a)), root((f, b))
        if x != y:
            home[x] = y
            want.append((f, a, b))
    assert got == sorted(want)


def plain_regions(cells, width, connectivity):
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (connectivity == 2 or not (dy and dx))]
    out = {}
    for start in sorted(cells):
        if start in out:
            continue
        todo, out[start] = [start], start[0] * width + start[1] + 1
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                if (y + dy, x + dx) in cells and (y + dy, x + dx) not in out:
                    out[y + dy, x + dx] = out[start]
                    todo.append((y + dy, x + dx))
    return out


@pytest.mark.parametrize("connectivity", [1, 2])
def test_regions_across_blocks(spark, monkeypatch, connectivity):
    rng = random.Random(connectivity)
    monkeypatch.setattr(raster, "BLOCK_SIDE", 8)
    images = {("a", 2.0): (45, {(y, x) for y in range(40) for x in range(45) if rng.random() < 0.55}), ("a", 3.0): (45, {(0, 0)}), ("b", 2.0): (70, {(y, x) for y in range(9) for x in range(70) if (y % 2 == 0) or x in (0, 69)})}
    rows = [(f, t, y, x) for (f, t), (_, cells) in images.items() for y, x in cells]
    mask = spark.createDataFrame(rows, "field_id string, threshold double, y int, x int")
    fields = spark.createDataFrame([("a", 45), ("b", 70), ("none", 5)], "field_id string, width int")
    got = {(r.field_id, r.threshold, r.y, r.x): r.label for r in raster.label_regions(mask, fields, connectivity).collect()}
    want = {(f, t, y, x): v for (f, t), (width, cells) in images.items() for (y, x), v in plain_regions(cells, width, connectivity).items()}
    assert got == want
    seams = raster.block_seams(raster.label_blocks(mask, fields, connectivity), connectivity).count()
    print("seams", seams, "pixels", len(rows))
    assert 0 < seams < len(rows) / 2
    assert raster.label_regions(mask.limit(0), fields, connectivity).count() == 0


def test_median_behind_a_far_outlier(spark):
    rng = random.Random(4)
    sets = {
        "outlier": [rng.gauss(0, 1) for _ in range(40_000)] + [1e5], "even": [rng.gauss(0, 1) for _ in range(9000)] + [1e300, -1e300], "ties": [3.0] * 30_000 + [7.0] * 30_000,
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(5001)], "one": [2.5], "none": [None],
    }
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "k string, v double")
    want = {k: statistics.median(vs) for k, vs in sets.items() if vs[0] is not None}
    assert {r.k: r.m for r in exact_median(df, ["k"], "v", "m").collect()} == want
    narrow = exact_median(df.filter("k != 'wide'"), ["k"], "v", "m", bins=512, small=50)
    assert {r.k: r.m for r in narrow.collect()} == {k: m for k, m in want.items() if k != "wide"}


def test_required_metadata(spark):
    pixels = spark.createDataFrame([(f, y, x, float(y + x)) for f in "abc" for y in range(3) for x in range(3)], "field_id string, y int, x int, value double")
    fields = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0), ("c", 1.0, 0.0)], "field_id string, mean double, rms double")
    assert sorted(map(tuple, raster.metadata_issues(fields, pixels).collect())) == [("b", "missing_mean"), ("c", "missing_rms")]
    strict = Segmentation(require_metadata=True)
    row = raster.background(pixels, fields.filter("field_id = 'a'"), strict).first()
    assert (row.mean_value, row.rms_value, row.fill_value) == (1.0, 2.0, 2.0)
    with pytest.raises(Exception, match="missing_mean"):
        raster.background(pixels, fields, strict).collect()
    with_maps = pixels.withColumn("mean", F.lit(0.5)).withColumn("rms", F.lit(1.5))
    assert raster.metadata_issues(fields, with_maps).count() == 0


def test_settings_of_a_write_hold_only_while_it_runs(spark):
    from fieldlink.lineage import WRITING, settings

    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with settings(spark, WRITING):
        assert spark.conf.get(name) == "8000"
    assert spark.conf.get(name) == before
