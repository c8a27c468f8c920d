"""Catalogue scan, cached hosts, status tables, fields and the streaming run."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fieldlink.config import Config
from fieldlink.functions.morphology import with_morphology
from fieldlink.config import Beam
from fieldlink.operators.sky import cone_search
from fieldlink.sources import catalog, fields as field_ops, host_cache, tables


def test_sizes_come_in_degrees_and_shape_is_classified(spark):
    raw = spark.createDataFrame([(1, 10.0, 20.0, 1.0, 1.0, 6 / 3600, 4 / 3600, 3 / 3600, 2 / 3600, 20.0, 20.0)],
                                "Gaussian_id long, RA double, DEC double, Total_flux double, Peak_flux double, Maj double, Min double, DC_Maj double, DC_Min double, PA double, DC_PA double")
    df = catalog.normalise(raw, order=["Gaussian_id"])
    row = with_morphology(df, replace(Config(), beam=Beam(6.0, 4.0, 20.0))).first()
    assert [round(row[c], 9) for c in ("maj", "min", "dc_maj", "dc_min")] == [6.0, 4.0, 3.0, 2.0]
    assert row.morphology_class == "resolved" and row.beam_like_score > 0.99


def test_pixel_names_and_rejections(spark):
    raw = spark.createDataFrame([(1, 5.0, 6.0)], "Gaussian_id long, Xposn double, Yposn double")
    df = catalog.normalise(raw, order=["Gaussian_id"])
    assert df.select("x", "y").first() == (5.0, 6.0) and catalog.missing_expected(raw.columns)
    with pytest.raises(ValueError, match="bad_shape"):
        catalog.require_clean(df)
    with pytest.raises(ValueError, match="empty"):
        catalog.require_clean(df.filter("x > 100"))


def test_cone_crosses_the_ra_wrap(spark):
    df = spark.createDataFrame([(0, 359.99, 0.0), (1, 0.01, 0.0), (2, 1.0, 0.0)], "i long, ra double, dec double")
    assert [r.i for r in cone_search(df, 0.0, 0.0, 100.0).orderBy("i").collect()] == [0, 1]
    assert cone_search(df, None, None, 1.0).count() == 3


def test_json_lines_skip_malformed_rows(spark, tmp_path):
    good = {"query_id": "q", "catalogue": "allwise", "host_id": "h", "raw_record": json.dumps({"RAJ2000": 10.5, "W1mag": 12.0})}
    path = tmp_path / "cache.jsonl"
    path.write_text(json.dumps(good) + "\n{broken\n" + json.dumps({**good, "query_id": "r"}) + "\n")
    rows = host_cache.repair(host_cache.read_jsonl(spark, str(path))).orderBy("query_id").collect()
    assert [(r.query_id, r.host_ra, r.w1) for r in rows] == [("q", 10.5, 12.0), ("r", 10.5, 12.0)]


def test_status_upsert_and_partials(spark):
    old = spark.createDataFrame([("a", "done", "1"), ("b", "failed", "1")], "field_id string, status string, time_end string")
    new = spark.createDataFrame([("b", "DONE ", "2"), ("c", "failed", "2")], "field_id string, status string, time_end string")
    status = tables.upsert_status(old, new)
    assert sorted(r.field_id for r in tables.done_fields(status).collect()) == ["a", "b"]
    groups = spark.createDataFrame([("a",)], "field_id string")
    assert [tuple(r) for r in tables.missing_partials({"groups": groups}, tables.done_fields(status)).collect()] == [("b", "groups")]
    assert tables.failure_summary(status).first() == (1, "c")


def test_field_metadata(spark):
    df = spark.createDataFrame([("a", 0, 1.5, 6.0, 6.0, 0.0), ("b", 1, 1.0, 6.0, None, 0.0), ("c", 2, 1.0, 6.0, 6.0, 180.05)],
                               "field_id string, field_index int, pixel_scale double, beam_major double, beam_minor double, beam_pa double")
    got = {r.field_id: r.issues for r in field_ops.metadata_issues(df, replace(Config(), pixel_scale_arcsec=1.0)).collect()}
    assert got == {"a": ["scale_mismatch"], "b": ["beam_axis_missing"]}
    assert [r.field_id for r in field_ops.select_range(df, 1, None, 1).collect()] == ["b"]


def test_streaming_equals_batch(spark, tmp_path):
    from fieldlink.fixtures import SMALL
    from fieldlink.plans.stage1 import associate
    from fieldlink.streaming.ingest import ingest_fields
    from tests.scenes import bar_components, bar_field, bar_snr

    comps, pixels, field = bar_components(spark), bar_snr(spark).withColumnRenamed("snr", "value"), bar_field(spark, rms=1.0)
    where = {n: str(tmp_path / n) for n in ("components", "pixels", "fields", "out", "checkpoint")}
    for n, df in (("components", comps), ("pixels", pixels), ("fields", field)):
        df.write.parquet(where[n])
    cfg = replace(Config(), sanity=replace(Config().sanity, enabled=False))
    run = lambda at: ingest_fields(spark, where["components"], where["pixels"], where["fields"], where["out"], at, cfg).awaitTermination()
    run(where["checkpoint"])
    run(where["checkpoint"])  # finds nothing new
    field.union(field).write.mode("append").parquet(where["fields"])
    run(where["checkpoint"])  # the same field once more
    run(where["checkpoint"] + "2")  # and every batch from the start
    assert not (tmp_path / "checkpoint" / "state").exists()
    groups = spark.read.parquet(where["out"] + "/groups").collect()
    want = associate(comps, pixels, field, cfg).groups.first()
    assert [(g.association_group_id, g.n_gaussians) for g in groups] == [("c0_a000", 3)]
    assert groups[0].LAS_arcsec == pytest.approx(want.LAS_arcsec)
    assert spark.read.parquet(where["out"] + "/status").count() == 1
