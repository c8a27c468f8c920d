"""Cone joins against all pairs, and hosts of crowded cones."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlink.config import Config
from fieldlink.operators import hosts as host_ops
from fieldlink.operators.sky import cone_join, in_cell, in_cover

CFG = Config()


def sky(seed: int, n: int) -> np.ndarray:
    """Positions everywhere, around both poles and on both sides of RA 0."""
    rng = np.random.default_rng(seed)
    ra, dec = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    dec[: n // 4] = 90 - rng.uniform(0, 1.5, n // 4)
    dec[n // 4 : n // 2] = rng.uniform(0, 1.5, n // 4) - 90
    ra[n // 2 : 3 * n // 4] = rng.uniform(-1, 1, n // 4) % 360
    dec[n // 2 : 3 * n // 4] = rng.uniform(-1, 1, n // 4)
    return np.stack([ra, dec], 1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Separations in arcsec through chords of unit vectors."""
    unit = lambda p: np.stack([np.cos(np.radians(p[:, 1])) * np.cos(np.radians(p[:, 0])), np.cos(np.radians(p[:, 1])) * np.sin(np.radians(p[:, 0])), np.sin(np.radians(p[:, 1]))], 1)
    chord = np.linalg.norm(unit(a)[:, None] - unit(b)[None], axis=2)
    return np.degrees(2 * np.arcsin(np.minimum(1, chord / 2))) * 3600


@pytest.mark.parametrize("cell, copied", [(None, False), (None, True), (300.0, False), (40000.0, False), (40000.0, True)])
def test_cone_join_equals_all_pairs(spark, cell, copied):
    a, b = sky(1, 240), sky(2, 400)
    reach = np.random.default_rng(3).uniform(0, 1800, len(a))
    reach[:2], a[0], b[0] = (1800.0, 0.0), (12.0, 90.0), (200.0, 89.8)
    a[1] = b[1]
    targets = spark.createDataFrame([(i, *map(float, p), float(r)) for i, (p, r) in enumerate(zip(a, reach))] + [(900, None, 1.0, 5.0), (901, 1.0, 1.0, None)], "i int, ra double, dec double, r double")
    sources = spark.createDataFrame([(j, *map(float, p)) for j, p in enumerate(b)] + [(900, 1.0, None)], "j int, s_ra double, s_dec double")
    got = [(r.i, r.j) for r in cone_join(targets, sources, "ra", "dec", "s_ra", "s_dec", "r", 1800.0, cell_arcsec=cell, copy_sources=copied).collect()]
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(apart(a, b) <= reach[:, None]))))
    assert (1, 1) in want and (0, 0) in want and len(want) > 100
    assert len(got) == len(set(got)) and set(got) == want


def test_a_cover_has_every_cell_once(spark):
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(sky(5, 200))], "i int, ra double, dec double")
    cells = [tuple(r) for r in in_cover(rows, "ra", "dec", F.lit(0.7), 0.1).select("i", "_zone", "_bin").collect()]
    own = [tuple(r) for r in in_cell(rows, "ra", "dec", 0.1).select("i", "_zone", "_bin").collect()]
    assert len(own) == 200 and len(set(cells)) == len(cells) and set(own) <= set(cells)


PLACE = "field_id string, group_index_1 long, group_index_2 long, role string, q_ra double, q_dec double, q_radius double, ra1 double, dec1 double, ra2 double, dec2 double"
HOST = "field_id string, host_id string, host_ra double, host_dec double, w1 double, w2 double, w1_snr double, w2_snr double, cc_flags string, catalogue string"


def crowded(spark):
    """Around one midpoint 40 faint flagged hosts, a bright one as the 41st nearest, and a nearer one of the second catalogue."""
    places = spark.createDataFrame([("c0", 0, 1, "midpoint", 10.0, 0.0, 30.0, 10.0, -0.02, 10.0, 0.02), ("c0", 0, 2, "midpoint", 50.0, 0.0, 30.0, 50.0, -0.02, 50.0, 0.02)], PLACE)
    faint = [("c0", f"f{k:02d}", 10.0, (1 + k * 0.1) / 3600, 15.0, 15.0, 0.1, 0.1, "D000", "catwise2020") for k in range(40)]
    bright = [("c0", "best", 10.0, 6.0 / 3600, 15.0, 14.0, 50.0, 50.0, "0000", "catwise2020"), ("c0", "other", 10.0, 0.5 / 3600, 15.0, 14.0, 50.0, 50.0, "0000", "allwise")]
    return places, spark.createDataFrame(faint + bright, HOST)


def test_the_best_host_of_a_crowded_cone_is_not_cut(spark):
    places, hosts = crowded(spark)
    hits = host_ops.cone_hits(places, hosts, CFG)
    assert hits.count() == 42
    rank = {r.host_id: r.host_rank for r in host_ops.ranked(host_ops.score_midpoint(hits, CFG), CFG).collect()}
    assert rank["best"] == 1 and sorted(rank.values()) == list(range(1, 21)) and "other" not in rank
    nearest = host_ops.cross_match(places, hosts, CFG)
    assert sorted(r.host_id for r in nearest.collect()) == [f"f{k:02d}" for k in range(20)]
    few = replace(CFG, hosts=replace(CFG.hosts, max_rows_per_lookup=1))
    assert [r.host_id for r in host_ops.ranked(host_ops.score_midpoint(hits, few), few).collect()] == ["best"]


def test_log_counts_every_hit_of_the_first_catalogue(spark):
    places, hosts = crowded(spark)
    log = host_ops.query_log(places, host_ops.cone_hits(places, hosts, CFG), CFG)
    got = sorted((r.group_index_2, r.catalogue, r.n_results) for r in log.collect())
    assert got == [(1, "catwise2020", 41), (2, "allwise", 0), (2, "catwise2020", 0)]
    empty = host_ops.query_log(places, host_ops.cone_hits(places, hosts.limit(0), CFG), CFG)
    assert empty.count() == 4


def test_raster_hosts_keep_every_listed_row(spark):
    """Of many customers at one place only those a lookup can list meet the fields, with the same ranked hosts."""
    from fieldlink import fixtures as fx
    from fieldlink.queries import all_queries

    all_queries()
    from fieldlink.queries.parent_queries import HOST_PLACES, raster_hosts

    customers = spark.range(HOST_PLACES * 50).select(F.col("id").alias("c_custkey"), (F.pmod(F.col("id") * 7919 + F.col("id") % 7 * 13, F.lit(9000)).cast("double")).alias("c_acctbal"))
    fields = spark.createDataFrame([("view_0", 150.0, 2.0)], "field_id string, ra0 double, dec0 double")
    whole = raster_hosts(fields, customers, replace(fx.SMALL, hosts=replace(fx.SMALL.hosts, max_rows_per_lookup=10**6)))
    few = raster_hosts(fields, customers, fx.SMALL)
    assert whole.count() == HOST_PLACES * 10 and few.count() <= 2 * HOST_PLACES // 5 * fx.SMALL.hosts.max_rows_per_lookup
    at = "field_id string, group_index_1 int, group_index_2 int, role string, q_ra double, q_dec double, q_radius double, ra1 double, dec1 double, ra2 double, dec2 double"
    rows = [("view_0", i, i + 1, role, 150.0 + i / 3600, 2.0 - i / 7200, 10.0, 149.999, 2.0, 150.001 + i / 3600, 2.0) for i in range(4) for role in ("midpoint", "lobe1_peak")]
    places = spark.createDataFrame(rows, at)

    def answers(hosts):
        hits = host_ops.cone_hits(places, hosts, fx.SMALL)
        mid = host_ops.ranked(host_ops.score_midpoint(hits.filter("role = 'midpoint'"), fx.SMALL), fx.SMALL)
        lobe = host_ops.ranked(host_ops.score_lobe_peaks(hits.filter("role != 'midpoint'"), fx.SMALL), fx.SMALL)
        keep = ["group_index_1", "role", "host_rank", "host_id", "host_score", "host_quality"]
        return sorted(map(tuple, mid.select(*keep).unionByName(lobe.select(*keep)).collect()))

    found = answers(whole)
    assert len(found) == 8 * fx.SMALL.hosts.max_rows_per_lookup and answers(few) == found


def test_equal_places_on_other_turns_of_the_sky_are_ties(spark):
    """A host exactly on the radius is found, and hosts at one place of the sky come by their id."""
    at = "field_id int, group_index_1 int, group_index_2 int, role string, q_ra double, q_dec double, q_radius double"
    places = spark.createDataFrame([(0, 0, d, "midpoint", 150.0, 2.0 + d / 3600, 10.0) for d in range(60)], at)
    hosts = spark.createDataFrame(
        [(100 * d + n, 150.0 + 360.0 * turn + off / 3600, 2.0 + d / 3600 + dec / 3600, "allwise") for d in range(60) for n, turn, off, dec in ((3, 0, 0, 10), (2, 1, 3, 0), (1, 4, 3, 0), (0, 2, 3, 0))],
        "host_id int, host_ra double, host_dec double, catalogue string").withColumn("field_id", F.lit(0))
    near = replace(CFG, hosts=replace(CFG.hosts, max_rows_per_lookup=1000))
    hits = host_ops.cone_hits(places, hosts, near)
    own = hits.filter("floor(host_id / 100) = group_index_2")
    assert own.groupBy("group_index_2").count().filter("count = 4").count() == 60
    first = host_ops.first_catalogue(own, host_ops.nearest(), near).select("group_index_2", "host_rank", F.pmod("host_id", F.lit(100)).alias("n")).collect()
    assert all(r.n == r.host_rank - 1 for r in first)
