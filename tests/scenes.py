"""Small hand-made scenes."""

from pyspark.sql import functions as F

COMPONENT = (
    "field_id string, component_index long, component_id string, island_id long, ra double, dec double, x double, y double, "
    "pixel_scale double, total_flux double, peak_flux double, maj double, min double, pa double, "
    "dc_maj double, dc_min double, dc_pa double"
)


def bar_components(spark, fluxes=((10.0, 8.0), (9.0, 7.0), (8.0, 6.0))):
    rows = [
        ("c0", i, f"g{i}", 1, 1.0, 1.0, x, 20.0, 1.0, fluxes[i][0], fluxes[i][1], 6.0, 6.0, 0.0, None, None, None)
        for i, x in enumerate((10.0, 35.0, 60.0))
    ]
    return spark.createDataFrame(rows, COMPONENT)


def bar_field(spark, **extra):
    row = {"field_id": "c0", "width": 80, "height": 40, "pixel_scale": 1.0, **extra}
    return spark.createDataFrame([row])


def grid(spark, width, height, value, field="c0"):
    """Dense raster from a column expression over y and x."""
    return (
        spark.range(width * height)
        .select(F.lit(field).alias("field_id"), (F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
        .withColumn("snr", value.cast("double"))
    )


def bar_snr(spark):
    on = F.col("y").between(18, 22) & F.col("x").between(8, 67)
    return grid(spark, 80, 40, F.when(on, 4.0).otherwise(0.0))


def labels_at_or_above(snr, thresholds=(5.0, 4.0, 3.0, 2.5, 2.0)):
    """One region per threshold: enough for scenes with a single blob."""
    levels = F.array(*[F.lit(t) for t in thresholds])
    rows = snr.withColumn("threshold", F.explode(levels)).filter("snr >= threshold")
    areas = rows.groupBy("field_id", "threshold").agg(F.count("*").alias("area"))
    return rows.join(areas, ["field_id", "threshold"]).select(
        "field_id", "threshold", "y", "x", F.lit(1).cast("long").alias("label"), "area"
    )
