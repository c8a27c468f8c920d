"""Stored segmentations: a round trip, and every issue that stops a read."""

import pytest
from pyspark.sql import functions as F

from fieldlink.sources import segmentation as store

FIELDS = "field_id string, width int, height int"


def whole(spark):
    fields = spark.createDataFrame([("a", 4, 3), ("b", 2, 2)], FIELDS)
    snr = spark.createDataFrame([(f, y, x, float(x)) for f, w, h in (("a", 4, 3), ("b", 2, 2)) for y in range(h) for x in range(w)], "field_id string, y int, x int, snr double")
    labels = spark.createDataFrame([("a", 3.0, 0, 3, 4, 2), ("a", 3.0, 1, 3, 4, 2), ("a", 3.0, 2, 0, 9, 1)], "field_id string, threshold double, y int, x int, label long, area long")
    levels = spark.createDataFrame([("a", 3.0, 2, 1), ("a", 5.0, 0, 0), ("b", 3.0, 0, 0)], "field_id string, threshold double, n_labels long, n_small_objects_removed long")
    return store.Stored(snr, labels, levels), fields


def found(stored, fields):
    return {(r.field_id, r.issue): r.n for r in store.issues(stored, fields).collect()}


def test_round_trip(spark, tmp_path):
    stored, fields = whole(spark)
    store.save(stored, fields, str(tmp_path))
    back = store.load(spark, str(tmp_path), fields)
    for name in store.TABLES:
        a, b = getattr(stored, name), getattr(back, name)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    one = store.load(spark, str(tmp_path), fields.filter("field_id = 'b'"))
    assert one.snr.count() == 4 and one.labels.count() == 0
    with pytest.raises(ValueError, match="c snr_pixels_missing"):
        store.load(spark, str(tmp_path), fields.union(spark.createDataFrame([("c", 1, 1)], FIELDS)))


def test_issues(spark):
    stored, fields = whole(spark)
    assert found(stored, fields) == {}
    row = lambda df, *values: df.union(spark.createDataFrame([values], df.schema))
    bad = store.Stored(
        row(row(row(stored.snr.filter("not (field_id = 'b' and y = 0)"), "a", 0, 0, 1.0), "a", 3, 0, 1.0), "z", 0, 0, 1.0),
        row(row(row(stored.labels, "a", 2.0, 0, 0, 1, 1), "a", 3.0, 0, 3, 0, 1), "a", 3.0, 0, 4, 4, 1),
        row(row(row(stored.thresholds.filter("field_id = 'a'"), "a", 5.0, 0, 0), "a", None, 0, 0), "a", float("nan"), 0, 0),
    )
    assert found(bad, fields) == {
        ("b", "snr_pixels_missing"): 2, ("a", "snr_pixels_repeated"): 1, ("a", "snr_pixels_outside"): 1, ("z", "field_unknown"): 1, ("b", "thresholds_missing"): 1,
        ("a", "thresholds_repeated"): 1, ("a", "thresholds_not_positive"): 2, ("a", "labels_without_threshold"): 1, ("a", "label_pixels_repeated"): 1,
        ("a", "labels_not_positive"): 1, ("a", "label_pixels_outside"): 1,
    }
    lied = store.Stored(stored.snr, stored.labels, stored.thresholds.withColumn("n_labels", F.col("n_labels") + 1))
    assert found(lied, fields) == {("a", "label_counts_differ"): 2, ("b", "label_counts_differ"): 1}
    empty = store.Stored(stored.snr.limit(0), stored.labels.limit(0), stored.thresholds.limit(0))
    assert found(empty, fields) == {(f, i): n for f, k in (("a", 12), ("b", 4)) for i, n in (("snr_pixels_missing", k), ("thresholds_missing", 1))}
    assert found(stored, fields.limit(0)) == {("a", "field_unknown"): 1, ("b", "field_unknown"): 1}
    with pytest.raises(ValueError, match="b thresholds_missing"):
        store.save(store.Stored(stored.snr, stored.labels, stored.thresholds.filter("field_id = 'a'")), fields, "/nowhere")
