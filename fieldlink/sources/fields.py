"""Field metadata: precedence, range selection, scale and beam agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldlink.config import Config
from fieldlink.functions import geometry as g


def merge_metadata(images: DataFrame, group_level: DataFrame, root_level: DataFrame, names: list[str]) -> DataFrame:
    """Image attributes win over group attributes, which win over root attributes."""
    a = images.alias("i").join(group_level.alias("g"), "group_id", "left").join(root_level.alias("r"), "root_id", "left")
    rest = [F.col(f"i.{c}") for c in images.columns if c not in names]
    return a.select(*rest, *[F.coalesce(f"i.{n}", f"g.{n}", f"r.{n}").alias(n) for n in names])


def select_range(fields: DataFrame, start: int = 0, end: int | None = None, limit: int | None = None) -> DataFrame:
    """Fields by index: from start up to (not including) end, at most limit of them."""
    chosen = fields.filter(F.col("field_index") >= start)
    if end is not None:
        chosen = chosen.filter(F.col("field_index") < end)
    return chosen.orderBy("field_index").limit(limit) if limit is not None else chosen


def with_scale(fields: DataFrame, cfg: Config) -> DataFrame:
    """Pixel scale from metadata, else from the projection steps, else from the settings."""
    options = []
    if "pixel_scale" in fields.columns:
        options.append(F.col("pixel_scale"))
    if "step_x" in fields.columns:
        options.append(g.scale_from_steps(F.col("step_x"), F.col("step_y")))
    options.append(F.lit(cfg.pixel_scale_arcsec).cast("double"))
    return fields.withColumn("pixel_scale", F.coalesce(*options))


def metadata_issues(fields: DataFrame, cfg: Config) -> DataFrame:
    """Fields whose scale or beam is unusable or disagrees with the settings."""
    have = lambda c: F.col(c) if c in fields.columns else F.lit(None).cast("double")
    close = lambda value, want: F.abs(value - want) <= 1e-6 + 1e-3 * abs(want)
    scale, major, minor, pa = have("pixel_scale"), have("beam_major"), have("beam_minor"), have("beam_pa")
    turn = F.abs(F.pmod(pa - cfg.beam.pa_deg + 90.0, F.lit(180.0)) - 90.0)
    found = F.array_compact(F.array(
        F.when(~g.yes(scale > 0), F.lit("scale_missing_or_not_positive")),
        *([F.when(scale.isNotNull() & ~g.yes(close(scale, cfg.pixel_scale_arcsec)), F.lit("scale_mismatch"))] if cfg.pixel_scale_arcsec else []),
        F.when(major.isNull() != minor.isNull(), F.lit("beam_axis_missing")),
        F.when((major.isNotNull() & ~g.yes(close(major, cfg.beam.major_arcsec))) | (minor.isNotNull() & ~g.yes(close(minor, cfg.beam.minor_arcsec))), F.lit("beam_mismatch")),
        F.when(turn > 0.1, F.lit("beam_angle_mismatch")),
    ))
    return fields.select("field_id", found.alias("issues")).filter(F.size("issues") > 0)
