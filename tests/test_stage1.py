from dataclasses import replace
from hashlib import sha256

from pyspark.sql import functions as F

from fieldlink.config import Config
from fieldlink.operators.measure import region_las, region_las_exact, with_member_lists
from fieldlink.plans.stage1 import associate
from tests.scenes import bar_components, bar_field, bar_snr, labels_at_or_above

CFG = Config()


def bar_run(spark):
    snr = bar_snr(spark)
    pixels = snr.withColumnRenamed("snr", "value")
    return associate(bar_components(spark), pixels, bar_field(spark), CFG, snr=snr, labels=labels_at_or_above(snr))


def test_reference_scene(spark):
    out = bar_run(spark)
    groups = with_member_lists(out.groups, out.components).select("association_group_id", "component_ids").toPandas()
    assert sha256(groups.to_csv(index=False).encode()).hexdigest() == "1b10544e0448150461ddd23458e7abfcc445aced801ea262aeed664e8bf861c6"
    edges = out.edges.groupBy("edge_type").count().collect()
    assert [(r.edge_type, r["count"]) for r in edges] == [("strong", 3)]
    d = out.local.diagnostics.first().asDict()
    assert (d["n_gaussians_before"], d["n_groups_after_split"], d["split_applied"]) == (3, 1, False)
    assert d["local_overmerge_risk_score"] == 0.35 and d["saddle_to_peak_ratio"] == 1.0
    assert d["ridge_gap_fraction"] == d["weak_edge_fraction"] == d["only_2sigma_edge_fraction"] == 0.0


def test_full_run_from_image(spark):
    pixels = bar_snr(spark).withColumnRenamed("snr", "value")
    fields = bar_field(spark, rms=1.0)
    cfg = replace(CFG, sanity=replace(CFG.sanity, enabled=False))
    out = associate(bar_components(spark), pixels, fields, cfg)
    assert out.groups.count() == 1
    assert out.edges.filter("edge_type = 'strong'").count() == out.edges.count() == 3


def test_region_sizes_over_all_pixels(spark):
    # 60 x 40 pixels of one region, and a single row of three.
    spots = [("f", "r:big", y, x) for y in range(60) for x in range(40) if (x * x + 7 * y) % 11 != 3] + [("f", "r:line", 5, x) for x in (1, 2, 4)]
    mask = spark.createDataFrame(spots, "field_id string, set_id string, y int, x int")
    sizes = mask.groupBy("field_id", "set_id").agg(F.count("*").alias("mask_n"))
    pts = [(y, x) for _, s, y, x in spots if s == "r:big"]
    far = max((a - c) ** 2 + (b - d) ** 2 for a, b in pts for c, d in pts) ** 0.5
    assert [(r.set_id, r.mask_las_exact_pix) for r in region_las_exact(mask, sizes).collect()] == [("r:big", far)]
    # A spike of one pixel that the even sample of 1000 passes over.
    spiked = mask.unionByName(spark.createDataFrame([("f", "r:big", 30, x) for x in range(40, 300)], mask.schema))
    sizes = spiked.groupBy("field_id", "set_id").agg(F.count("*").alias("mask_n"))
    exact = region_las_exact(spiked, sizes).first().mask_las_exact_pix
    pts += [(30, x) for x in range(40, 300)]
    assert exact == max((a - 30) ** 2 + (b - 299) ** 2 for a, b in pts) ** 0.5
    assert region_las(spiked, sizes).filter("set_id = 'r:big'").first().mask_las_pix <= exact
