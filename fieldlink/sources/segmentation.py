"""Stored segmentations: S/N pixels, regions and thresholds per field, checked when they are read.

Three tables, partitioned by field: ``snr`` (field_id, y, x, snr), ``labels``
(field_id, threshold, y, x, label, area) and ``thresholds`` (field_id, threshold,
n_labels, n_small_objects_removed).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlink.config import Segmentation
from fieldlink.functions import geometry as g
from fieldlink.operators.raster import segmentation_diagnostics
from fieldlink.sources.tables import read_fields, write_fields

TABLES = ("snr", "labels", "thresholds")


@dataclass
class Stored:
    snr: DataFrame
    labels: DataFrame
    thresholds: DataFrame


def collected(snr: DataFrame, labels: DataFrame, removed: DataFrame, fields: DataFrame, seg: Segmentation) -> Stored:
    """The tables to store, from the results of ``snr_map`` and ``segment``."""
    counts = segmentation_diagnostics(labels, removed, fields, seg)
    return Stored(snr, labels, counts.select("field_id", "threshold", "n_labels", "n_small_objects_removed"))


def save(stored: Stored, fields: DataFrame, path: str) -> None:
    """Replace the partitions of the fields at hand; nothing is written when a field has an issue."""
    _refuse(issues(stored, fields))
    for name in TABLES:
        write_fields(getattr(stored, name), f"{path}/{name}")


def load(spark: SparkSession, path: str, fields: DataFrame, strict: bool = True) -> Stored:
    """Stored tables of the given fields; an error names fields with issues unless ``strict`` is off."""
    kind = fields.schema["field_id"].dataType
    read = [read_fields(spark, f"{path}/{name}", kind) for name in TABLES]
    if "n_small_objects_removed" not in read[2].columns:
        read[2] = read[2].withColumn("n_small_objects_removed", F.lit(0).cast("long"))
    stored = Stored(*[t.join(fields.select("field_id"), "field_id", "left_semi") for t in read])
    if strict:
        _refuse(issues(stored, fields))
    return stored


def _refuse(found: DataFrame) -> None:
    first = found.orderBy("field_id", "issue").limit(10).collect()
    if first:
        raise ValueError("segmentation has issues: " + ", ".join(f"{r.field_id} {r.issue} ({r.n})" for r in first))


def issues(stored: Stored, fields: DataFrame) -> DataFrame:
    """(field_id, issue, n): what is wrong with the tables of a field, and how often.

    Rows of fields that ``fields`` lacks are one issue of their own.  Pixels are
    counted by position before they are counted by field, so a field of any size spreads.
    """
    size = fields.select("field_id", "width", "height")
    off = ~g.yes((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width")))

    spots = stored.snr.groupBy("field_id", "y", "x").agg(F.count("*").alias("_n")).join(size, "field_id").withColumn("_off", off)
    pixels = size.join(spots.groupBy("field_id").agg(
        F.count_if(~F.col("_off")).alias("_in"), F.sum(F.when(F.col("_off"), F.col("_n")).otherwise(0)).alias("_out"),
        F.sum(F.when(~F.col("_off"), F.col("_n") - 1).otherwise(0)).alias("_again")), "field_id", "left")
    whole = F.col("width").cast("long") * F.col("height")

    usable = g.yes(g.finite(F.col("threshold")) > 0)
    rows = stored.thresholds.groupBy("field_id", "threshold").agg(F.count("*").alias("_n"), F.min("n_labels").alias("n_labels"))
    levels = size.join(rows.groupBy("field_id").agg(
        F.sum("_n").alias("_rows"), F.sum(F.when(~usable, F.col("_n")).otherwise(0)).alias("_bad"), F.sum(F.col("_n") - 1).alias("_again")), "field_id", "left")

    cells = stored.labels.groupBy("field_id", "threshold", "y", "x").agg(F.count("*").alias("_n"), F.count_if(~g.yes(F.col("label") > 0)).alias("_low"))
    listed = rows.select("field_id", "threshold", F.lit(True).alias("_listed"))
    placed = cells.join(size, "field_id").join(listed, ["field_id", "threshold"], "left").groupBy("field_id").agg(
        F.sum(F.when(off, F.col("_n")).otherwise(0)).alias("_out"), F.sum(F.col("_n") - 1).alias("_again"), F.sum("_low").alias("_low"),
        F.sum(F.when(F.col("_listed").isNull(), F.col("_n")).otherwise(0)).alias("_unlisted"))

    regions = stored.labels.filter("label > 0").groupBy("field_id", "threshold", "label").agg(F.lit(1).alias("_one")).groupBy("field_id", "threshold").agg(F.count("*").alias("_have"))
    wrong = rows.join(size, "field_id", "left_semi").join(regions, ["field_id", "threshold"], "left").filter(~g.yes(F.coalesce("_have", F.lit(0)) == F.col("n_labels"))).groupBy("field_id").agg(F.count("*").alias("_n"))

    def named(df: DataFrame, found: dict[str, object]) -> DataFrame:
        every = F.array(*[F.struct(F.lit(name).alias("issue"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for name, n in found.items()])
        return df.select("field_id", F.explode(every).alias("_i")).select("field_id", "_i.issue", "_i.n").filter("n > 0")

    seen = [t.select("field_id").distinct() for t in (stored.snr, stored.labels, stored.thresholds)]
    strange = seen[0].union(seen[1]).union(seen[2]).distinct().join(size, "field_id", "left_anti")
    parts = [
        named(pixels, {"snr_pixels_missing": whole - F.coalesce("_in", F.lit(0)), "snr_pixels_outside": F.col("_out"), "snr_pixels_repeated": F.col("_again"),
                       "image_without_size": (~g.yes(whole > 0)).cast("int")}),
        named(levels, {"thresholds_missing": F.col("_rows").isNull().cast("int"), "thresholds_not_positive": F.col("_bad"), "thresholds_repeated": F.col("_again")}),
        named(placed, {"label_pixels_outside": F.col("_out"), "label_pixels_repeated": F.col("_again"), "labels_not_positive": F.col("_low"), "labels_without_threshold": F.col("_unlisted")}),
        named(wrong, {"label_counts_differ": F.col("_n")}),
        named(strange, {"field_unknown": F.lit(1)}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
