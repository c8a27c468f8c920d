"""Component, host, pixel and group tables derived from the generic test tables.

Integer arithmetic only, so that any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlink.config import Beam, Config, Features, Segmentation
from fieldlink.operators.ranking import positions

PER_FIELD = 300

# Wide fields without a raster, and small rasters with a two-pixel beam.
WIDE = Config(features=Features(artifact_layer1=False))
TILTED = Config(beam=Beam(8.0, 5.0, 30.0))
SMALL = Config(beam=Beam(2.0, 2.0, 0.0), segmentation=Segmentation(min_mask_area_pix=3))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field_count(spark: SparkSession, sf_dir: str) -> int:
    return max(1, table(spark, sf_dir, "orders").count() // PER_FIELD)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fitted component per order, laid out on 1000 x 1000 pixel fields."""
    n = field_count(spark, sf_dir)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    flux = F.col("o_totalprice") / 1000.0
    x = ((k * 7919 + c * 613) % 1000).cast("double")
    y = ((c * 104729 + k * 31) % 1000).cast("double")
    return table(spark, sf_dir, "orders").select(
        (k % n).alias("field_id"), k.alias("component_id"), x.alias("x"), y.alias("y"),
        flux.alias("total_flux"), (flux / (1 + k % 4)).alias("peak_flux"),
        (6 + c % 7).cast("double").alias("maj"), (5 + k % 3).cast("double").alias("min"),
        ((k * 13) % 180).cast("double").alias("pa"),
        F.when(k % 3 != 0, (k % 10) * 0.6).alias("dc_maj"),
        F.when(k % 3 != 0, (k % 5) * 0.5).alias("dc_min"),
        ((k * 13) % 180).cast("double").alias("dc_pa"),
        (c % 40).alias("island_id"),
        (150.0 + (k % n) * 0.5 + x / 3600.0).alias("ra"), (2.0 + y / 3600.0).alias("dec"),
        F.lit(1.0).alias("pixel_scale"),
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with the per-field index."""
    return positions(catalogue(spark, sf_dir), ["field_id"], "component_id", "component_index")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One host galaxy per customer, on the same fields as the catalogue."""
    n = field_count(spark, sf_dir)
    k, m = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    f = k % n
    return table(spark, sf_dir, "customer").select(
        k.alias("host_id"), f.alias("field_id"),
        (150.0 + f * 0.5 + ((k * 317 + m * 41) % 1000) / 3600.0).alias("host_ra"),
        (2.0 + ((k * 733) % 1000) / 3600.0).alias("host_dec"),
        (12.0 + (k % 50) / 10.0).alias("w1"),
        (12.0 + (k % 50) / 10.0 - m / 20.0).alias("w2"),
        (F.abs("c_acctbal") / 500.0).alias("w1_snr"),
        F.when(k % 4 != 0, F.abs("c_acctbal") / 700.0).alias("w2_snr"),
        F.when(k % 3 == 0, "allwise").otherwise("catwise2020").alias("catalogue"),
        F.when(k % 11 == 0, "D000").otherwise("0000").alias("cc_flags"),
    )


def pixel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    block = F.floor(F.col("user_id") / 160).cast("long")
    return (
        table(spark, sf_dir, "events")
        .select(
            F.concat_ws("_", "event_type", block.cast("string")).alias("field_id"),
            day.cast("int").alias("y"), (F.col("user_id") % 32).cast("int").alias("x"),
        )
        .filter(F.col("y").between(0, 29))
        .groupBy("field_id", "y", "x")
        .agg(F.count("*").cast("double").alias("value"))
    )


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per raster field: 32 x 30 pixels of one arcsec."""
    ids = pixel_counts(spark, sf_dir).select("field_id").distinct()
    block = F.split("field_id", "_")[1].cast("double")
    return ids.select(
        "field_id", F.lit(32).alias("width"), F.lit(30).alias("height"), F.lit(1.0).alias("pixel_scale"),
        F.lit(0.3).alias("rms"), F.lit(None).cast("double").alias("mean"),
        (150.0 + 0.5 * block + 5.0 * (F.ascii("field_id") - 97)).alias("ra0"), F.lit(2.0).alias("dec0"),
        F.lit(16.5).alias("px0"), F.lit(15.5).alias("py0"),
        F.lit(-1.0 / 3600.0).alias("step_x"), F.lit(1.0 / 3600.0).alias("step_y"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rasters of daily event counts."""
    counts = pixel_counts(spark, sf_dir)
    grid = (
        counts.select("field_id").distinct()
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(29))))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(31))))
    )
    return grid.join(counts, ["field_id", "y", "x"], "left").select(
        "field_id", "y", "x", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def pixel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component per bright raster cell (at least five events)."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    raw = pixel_counts(spark, sf_dir).filter("value >= 5").select(
        "field_id", (y * 32 + x).alias("component_id"),
        (x + ((x * 7 + y * 3) % 5) * 0.1).alias("x"), (y + ((x * 3 + y * 5) % 5) * 0.1).alias("y"),
        F.col("value").alias("total_flux"), (F.col("value") / (1 + (x + y) % 3)).alias("peak_flux"),
        (2.0 + (x % 4) * 0.5).alias("maj"), (1.5 + (y % 3) * 0.25).alias("min"),
        ((x * 13 + y * 7) % 180).cast("double").alias("pa"),
        F.when((x + y) % 3 != 0, (x % 5) * 0.4).alias("dc_maj"),
        F.when((x + y) % 3 != 0, (y % 4) * 0.3).alias("dc_min"),
        ((x * 13 + y * 7) % 180).cast("double").alias("dc_pa"),
        F.floor(y / 5).cast("long").alias("island_id"),
        F.lit(1.0).alias("pixel_scale"),
    )
    return positions(raw, ["field_id"], "component_id", "component_index")
