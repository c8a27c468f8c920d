"""Stage 1 tables written field by field, and Stage 2 started from them."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fieldlink.config import Config
from fieldlink.plans.stage1 import Association, associate
from fieldlink.plans.stage2 import link_parents
from fieldlink.sources import association_tables, segmentation, tables
from fieldlink.streaming.ingest import link_stored
from tests.scenes import bar_components, bar_field, bar_snr, labels_at_or_above
from tests.test_stage2 import HOST, lobes, scene

CFG = Config()
MEMBER = ("field_id string, gid long, component_index long, component_id string, label_at_3sigma long, label_at_5sigma long, snr_at double, peak_flux double, "
          "ra double, dec double")
COLUMNS = ["field_id", "group_index_1", "group_index_2", "parent_candidate_id", "symmetry_score", "parent_score_final", "host_evidence", "parent_acceptance_class",
           "parent_acceptance_reason", "parent_candidate_quality", "rejection_reason", "conflict_resolution_status"]


def test_parents_from_stored_tables(spark, tmp_path):
    # A field id that looks like a number keeps its zeros in the folder names.
    snr, labels, fields = (df.withColumn("field_id", F.lit("007")) for df in scene(spark))
    groups = lobes(spark).drop("box3", "box5", "area3_pix", "peak_snr", "peak_ra", "peak_dec").withColumn("field_id", F.lit("007"))
    members = spark.createDataFrame([("007", i, i, f"g{i}", i + 1, i + 1, 12.0, 8.0, ra, 20.0) for i, ra in enumerate((9.99, 10.01))], MEMBER)
    hosts = spark.createDataFrame([("h1", 10.0, 20.0, 15.0, 14.5, 20.0, 20.0, "0000", "catwise2020")], HOST)
    whole = Association(members, members.select("field_id").limit(0).withColumn("association_decision", F.lit(True)), groups, snr, labels, None, None)
    out = str(tmp_path)
    for name, table in (("groups", whole.groups), ("components", whole.components), ("association_edges", whole.edges)):
        tables.write_fields(table, f"{out}/{name}")
    removed = labels.select("field_id", "threshold", F.lit(0).cast("long").alias("removed")).limit(0)
    segmentation.save(segmentation.collected(snr, labels, removed, fields, CFG.segmentation), fields, f"{out}/segmentation")
    tables.append(tables.status_record(fields, "failed"), f"{out}/status")
    assert link_stored(spark, fields, hosts, out, CFG) is None
    tables.append(tables.status_record(fields, "done").withColumn("time_end", F.lit("9999")), f"{out}/status")
    assert link_stored(spark, fields, hosts, out, CFG) is not None
    assert link_stored(spark, fields, hosts, out, CFG) is None
    want = link_parents(whole, fields, hosts, CFG)
    read = lambda n: tables.read_fields(spark, f"{out}/{n}", fields.schema["field_id"].dataType)
    got = read("parent_edges").select(COLUMNS).collect()
    assert got == want.edges.select(COLUMNS).collect() and [r.field_id for r in got] == ["007"]
    assert read("host_query_log").count() == want.query_log.count() > 0 and read("parent_groups").count() == 2
    assert read("parent_candidates").count() == want.candidates.count()
    assert [r.field_id for r in spark.read.parquet(f"{out}/parent_status").collect()] == ["007"]


def test_saved_runs_are_checked(spark, tmp_path):
    snr = bar_snr(spark)
    comps, field, pixels = bar_components(spark), bar_field(spark), snr.withColumnRenamed("snr", "value")
    cfg = replace(Config(), sanity=replace(Config().sanity, enabled=False))
    found = associate(comps, pixels, field, cfg, snr=snr, labels=labels_at_or_above(snr))
    out = str(tmp_path / "out")
    more = comps.unionByName(comps.filter("component_index = 0").withColumn("component_index", F.lit(7).cast("long")))
    with pytest.raises(ValueError, match="outside exactly one group: c0/7"):
        association_tables.save(found, more, pixels, field, out, cfg)
    with pytest.raises(ValueError, match="differ from the decided edges"):
        association_tables.save(replace(found, edges=found.edges.withColumn("association_decision", F.lit(False))), comps, pixels, field, out, cfg)
    assert not (tmp_path / "out").exists()
    association_tables.save(found, comps, pixels, field, out, cfg)
    back = association_tables.load(spark, out, field)
    assert set(back.groups.columns) == set(found.groups.columns) and back.groups.first().box == found.groups.first().box
    merged = tables.read_fields(spark, f"{out}/merged_sources", field.schema["field_id"].dataType).first()
    assert (merged.merged_source_id, merged.n_components) == ("c0_m000", 3)
    none = association_tables.load(spark, out, field.limit(0))
    assert none.groups.count() == none.components.count() == 0


def test_table_without_rows_keeps_its_schema(spark, tmp_path):
    df = spark.createDataFrame([("007", 1, [2.0])], "field_id string, n int, v array<double>")
    path = str(tmp_path / "t")
    tables.write_fields(df.limit(0), path)
    assert tables.read_fields(spark, path, df.schema["field_id"].dataType).count() == 0
    tables.write_fields(df, path)
    assert tables.read_fields(spark, path, df.schema["field_id"].dataType).select("field_id", "n", "v").collect() == df.collect()
