"""Catalogue rows to fields: by sky position through the projection, or by explicit pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldlink.config import Config
from fieldlink.functions import geometry as g
from fieldlink.operators.ranking import positions
from fieldlink.operators.sky import cone_join

#: Sky cells along the radius of the largest field.
CELLS_ALONG = 8


def _inside():
    return (F.col("x") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") >= 0) & (F.col("y") < F.col("height"))


def sky_matches(catalogue: DataFrame, fields: DataFrame, cfg: Config, widest_arcsec: float) -> DataFrame:
    """Rows with sky positions inside a field, with pixel positions.

    ``widest_arcsec`` bounds the search radius of all fields.  A field covers many
    sky cells of an eighth of it, so its catalogue is spread over tasks.
    """
    scale = F.col("pixel_scale")
    half = 0.5 * F.sqrt(F.pow(F.col("width").cast("double"), 2) + F.pow(F.col("height").cast("double"), 2)) * scale
    ra_c, dec_c = g.pixel_to_sky((F.col("width") - 1) / 2.0, (F.col("height") - 1) / 2.0, *[F.col(c) for c in ("ra0", "dec0", "px0", "py0", "step_x", "step_y")])
    if "centre_ra" in fields.columns:
        ra_c, dec_c = F.coalesce("centre_ra", ra_c), F.coalesce("centre_dec", dec_c)
    targets = fields.select("*", (half + cfg.preselect_margin_arcsec).alias("_reach"), ra_c.alias("_rac"), dec_c.alias("_decc"))
    near = cone_join(targets, catalogue.filter(F.col("ra").isNotNull() & F.col("dec").isNotNull()).drop("x", "y", "pixel_scale", "field_id"),
                     "_rac", "_decc", "ra", "dec", "_reach", widest_arcsec, cell_arcsec=widest_arcsec / CELLS_ALONG)
    x, y = g.sky_to_pixel(*[F.col(c) for c in ("ra", "dec", "ra0", "dec0", "px0", "py0", "step_x", "step_y")])
    return near.select("*", x.alias("x"), y.alias("y")).drop("_reach", "_rac", "_decc", "separation_arcsec").withColumn("inside", g.yes(_inside())).withColumn("match_mode", F.lit("sky"))


def pixel_matches(catalogue: DataFrame, fields: DataFrame) -> DataFrame:
    """Rows without a sky position, matched by their own field and pixel position."""
    rows = catalogue.filter(F.col("ra").isNull() | F.col("dec").isNull()).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return rows.drop("pixel_scale").join(fields, "field_id").withColumn("inside", g.yes(_inside())).withColumn("match_mode", F.lit("pixel"))


def match_components(catalogue: DataFrame, fields: DataFrame, cfg: Config, widest_arcsec: float) -> tuple[DataFrame, DataFrame]:
    """(components with per-field index in catalogue order, matching diagnostics per field).

    ``catalogue`` carries ``position``, a unique non-negative row number, and for
    rows without a sky position a ``field_id``.
    """
    sky = sky_matches(catalogue, fields, cfg, widest_arcsec)
    pix = pixel_matches(catalogue, fields)
    both = sky.unionByName(pix, allowMissingColumns=True)
    inside = positions(both.filter("inside").drop("inside"), ["field_id"], "position", "component_index")
    return inside, matching_diagnostics(both, fields)


def matching_diagnostics(matches: DataFrame, fields: DataFrame) -> DataFrame:
    on = F.col("inside")
    found = matches.groupBy("field_id").agg(
        F.count_if(on).alias("n_gaussians_matched"), F.count_if(~on).alias("n_outside_after_projection"),
        F.min(F.when(on, F.col("x"))).alias("min_x"), F.max(F.when(on, F.col("x"))).alias("max_x"),
        F.min(F.when(on, F.col("y"))).alias("min_y"), F.max(F.when(on, F.col("y"))).alias("max_y"),
        F.bool_or(F.col("match_mode") == "pixel").alias("_pixel"),
    )
    joined = fields.select("field_id", "width", "height").join(found, "field_id", "left")
    n = F.coalesce("n_gaussians_matched", F.lit(0))
    return joined.select(
        "field_id", n.alias("n_gaussians_matched"), F.concat_ws("x", F.col("height").cast("string"), F.col("width").cast("string")).alias("image_shape"),
        F.when(F.coalesce("_pixel", F.lit(False)), "mixed").otherwise("sky").alias("match_mode"), "min_x", "max_x", "min_y", "max_y",
        F.coalesce("n_outside_after_projection", F.lit(0)).alias("n_outside_after_projection"),
        F.when(n == 0, "no_gaussians_matched").otherwise("").alias("warning"),
    )
