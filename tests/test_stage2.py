"""Two lobes with a small raster between them: seeds, host rules and acceptance."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fieldlink.config import Config
from fieldlink.lineage import cut
from fieldlink.operators import parents, seeds
from tests.scenes import grid

CFG = Config()
GROUP = (
    "field_id string, gid long, group_index long, association_group_id string, n_gaussians long, LAS_beam double, total_flux_gaussian double, peak_flux double, "
    "group_PA double, axis_ratio double, centroid_x double, centroid_y double, pixel_scale double, association_quality string, association_type string, "
    "artifact_risk_flags string, n_strong_edges long, n_only_2sigma_edges long, ra double, dec double, x0 double, y0 double, x1 double, y1 double, "
    "area3_pix double, peak_snr double, peak_ra double, peak_dec double"
)


def lobes(spark, second_x=50.0):
    def row(i, x, ra):
        return ("c0", i, i, f"g{i + 1}", 2, 4.0, 10.0, 8.0, 0.0, 1.0, x + 9.5, 39.5, 1.0, "medium", "continuous_extended", "", 1, 0, ra, 20.0,
                x, 30.0, x + 19.0, 49.0, 400.0, 12.0, ra, 20.0)

    frame = spark.createDataFrame([row(0, 10.0, 9.99), row(1, second_x, 10.01)], GROUP)
    box = F.struct("x0", "y0", "x1", "y1")
    return frame.withColumn("box", box).withColumn("box3", box).withColumn("box5", box).drop("x0", "y0", "x1", "y1")


def scene(spark, second_x=50):
    snr = cut(grid(spark, 130, 80, F.lit(12.0)))
    part = F.when(F.col("x").between(10, 29), 1).when(F.col("x").between(second_x, second_x + 19), 2)
    labels = snr.filter(F.col("y").between(30, 49)).withColumn("label", part.cast("long")).filter("label is not null").withColumn(
        "threshold", F.explode(F.array(F.lit(3.0), F.lit(5.0)))).withColumn("area", F.lit(400).cast("long"))
    fields = spark.createDataFrame([("c0", 130, 80)], "field_id string, width int, height int")
    return snr, labels.select("field_id", "threshold", "y", "x", "label", "area"), fields


HOST = "host_id string, host_ra double, host_dec double, w1 double, w2 double, w1_snr double, w2_snr double, cc_flags string, catalogue string"


def test_seed_pair(spark):
    table, pairs = seeds.run_seeds(lobes(spark, 80.0), CFG)
    assert table.filter("is_parent_seed and robust_bbox_source = '3sigma_bbox'").count() == 2
    rows = pairs.filter("is_default_candidate").collect()
    assert [r.parent_candidate_id for r in rows] == ["c0_seed_pc000"]
    assert rows[0].parent_candidate_quality in ("high", "medium")


@pytest.mark.parametrize("mode", ["required_without_host", "optional", "disabled", "host"])
def test_host_modes(spark, mode):
    snr, labels, fields = scene(spark)
    hosts = spark.createDataFrame([("h1", 10.0, 20.0, 15.0, 14.5, 20.0, 20.0, "0000", "catwise2020")] if mode == "host" else [], HOST)
    cfg = {"optional": replace(CFG, hosts=replace(CFG.hosts, required=False)),
           "disabled": replace(CFG, hosts=replace(CFG.hosts, required=False, enabled=False))}.get(mode, CFG)
    out = parents.run_parents(lobes(spark), snr, labels, fields, hosts, cfg)
    edge = out.edges.collect()
    assert len(edge) == 1
    row = edge[0]
    assert row.double_lobe_geometry_pass and "residual_radio_bridge" in row.independent_parent_evidence
    if mode == "required_without_host":
        assert row.parent_acceptance_class == "rejected_parent_candidate" and row.rejection_reason == "no_midpoint_host"
        assert out.candidates.count() == 0
    elif mode == "host":
        assert row.host_evidence == "supports_double_lobe" and row.host_quality in ("high", "medium")
    else:
        assert row.parent_acceptance_class == parents.ACCEPTED and row.parent_candidate_quality == "high"
        assert out.candidates.count() == 1


@pytest.mark.parametrize("scale", [0.2, 1.0, 1.5])
def test_neighbours_at_any_pixel_scale(spark, scale):
    """Two groups 30 arcsec apart crowd each other, and a core 12 arcsec off the middle of a pair is found."""
    def row(i, x, y):
        return ("c0", i, x / scale, y / scale, scale, i == 2, 0.0, 1.0, 1.0, "medium", "compact", "")

    kind = ("field_id string, group_index long, centroid_x double, centroid_y double, pixel_scale double, is_compact_singleton boolean, group_PA double, "
            "total_flux_gaussian double, peak_flux double, association_quality string, association_type string, artifact_risk_flags string")
    groups = spark.createDataFrame([row(0, 100.0, 300.0), row(1, 400.0, 300.0), row(2, 262.0, 300.0), row(3, 262.0, 330.0)], kind)
    groups = groups.withColumn("gid", F.col("group_index"))
    density = {r.group_index: r.local_fragment_density for r in parents.artifact_environment(groups, CFG).collect()}
    one = 1 / (3.141592653589793 * CFG.parents.fragment_radius_beam**2)
    assert density == pytest.approx({0: 0.0, 1: 0.0, 2: one, 3: one})
    end = lambda i: F.struct("centroid_x", "centroid_y", "pixel_scale").alias("ab"[i])
    ends = [groups.filter(F.col("group_index") == i).select("field_id", F.col("group_index").alias(f"group_index_{i + 1}"), end(i)) for i in (0, 1)]
    found = seeds.midpoint_cores(ends[0].join(ends[1], "field_id"), groups, CFG).collect()
    assert [(r.midpoint_core_x * scale, r.midpoint_core_y * scale) for r in found] == [pytest.approx((262.0, 300.0))]


def test_few_groups_in_one_file_meet_in_several_tasks(spark):
    table, pairs = seeds.run_seeds(lobes(spark, 80.0).coalesce(1), CFG)
    assert table.select(F.input_file_name()).distinct().count() > 1
    assert [r.parent_candidate_id for r in pairs.filter("is_default_candidate").collect()] == ["c0_seed_pc000"]
