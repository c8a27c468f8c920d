"""Spatial candidate pairs inside fields.

Component frames carry ``field_id, component_index, x, y, pixel_scale``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldlink.config import Config
from fieldlink.functions import geometry as g
from fieldlink.operators.grid import near_join

KEY = ["field_id"]


def pairs_within(components: DataFrame, radius_arcsec: float, carry: tuple = ()) -> DataFrame:
    """Unordered pairs i<j of a field not further apart than a radius.

    Cells are laid out in arcsec because fields may differ in pixel scale.
    ``carry`` names attributes that ride along as ``name_1`` and ``name_2``, which
    saves joining the pairs to the components again.
    """
    scale = F.col("pixel_scale")
    cols = ["component_index", "x", "y", *carry]
    left = components.select(
        "field_id", "pixel_scale", *[F.col(c).alias(c + "_1") for c in cols],
        (F.col("x") * scale).alias("_ax"), (F.col("y") * scale).alias("_ay"),
    )
    right = components.select(
        "field_id", *[F.col(c).alias(c + "_2") for c in cols],
        (F.col("x") * scale).alias("_bx"), (F.col("y") * scale).alias("_by"),
    )
    dx, dy = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
    return (
        near_join(left, right, KEY, "_ax", "_ay", "_bx", "_by", radius_arcsec)
        .filter(F.col("component_index_1") < F.col("component_index_2"))
        .withColumn("distance_arcsec", F.sqrt(dx * dx + dy * dy))
        .filter(F.col("distance_arcsec") <= radius_arcsec)
        .drop("_ax", "_ay", "_bx", "_by")
    )


def candidate_pairs(components: DataFrame, cfg: Config, carry: tuple = ()) -> DataFrame:
    """Pairs within the absolute radius and within the elliptical beam distance."""
    a = cfg.association
    radius = a.max_pair_beams * cfg.beam.long_axis
    if a.max_pair_arcsec:
        radius = min(radius, a.max_pair_arcsec)
    scale = F.col("pixel_scale")
    distance = g.beam_distance((F.col("x_2") - F.col("x_1")) * scale, (F.col("y_2") - F.col("y_1")) * scale, cfg.beam)
    return (
        pairs_within(components, radius, carry)
        .withColumn("distance_beam", distance)
        .filter(F.col("distance_beam") <= a.max_pair_beams)
    )


def legacy_candidate_pairs(components: DataFrame, cfg: Config, carry: tuple = ()) -> DataFrame:
    """Pairs within the circular radius of the older scoring path."""
    gcfg = cfg.legacy
    radius = min(gcfg.max_pair_arcsec, gcfg.max_pair_beams * cfg.beam.long_axis)
    return pairs_within(components, radius, carry)


def complete_pairs(components: DataFrame) -> DataFrame:
    """Every unordered pair of a field with an empty score and decision.

    The output itself is quadratic in the field size.  It is a diagnostic table
    for small fields; rows are spread by both indices, never gathered.
    """
    blocks = 16
    idx = F.col("component_index")
    left = components.select(
        "field_id", idx.alias("component_index_1"), F.pmod(idx, F.lit(blocks)).cast("int").alias("_l")
    ).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = components.select(
        "field_id", idx.alias("component_index_2"), F.pmod(idx, F.lit(blocks)).cast("int").alias("_r")
    ).withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return (
        left.join(right, ["field_id", "_l", "_r"])
        .filter(F.col("component_index_1") < F.col("component_index_2"))
        .select("field_id", "component_index_1", "component_index_2",
                F.lit(None).cast("double").alias("merge_score"), F.lit(False).alias("merge_decision"))
    )
