"""Cone joins on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlink.functions import geometry as g


def _bins(zone: Column, size: float) -> Column:
    """Cells around the sky in one zone of declination, none narrower than ``size`` degrees."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(zone * size - 90.0), F.abs((zone + 1) * size - 90.0)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge)) / size)).cast("long")


def _zone(dec: Column, size: float) -> Column:
    return F.floor((F.least(F.lit(90.0), F.greatest(F.lit(-90.0), dec)) + 90.0) / size).cast("long")


def _bin(ra: Column, zone: Column, size: float) -> Column:
    return F.floor(ra / 360.0 * _bins(zone, size)).cast("long")


def in_cell(df: DataFrame, ra: str, dec: str, size: float) -> DataFrame:
    """Every row with the one cell (``_zone`` of declination, ``_bin`` of right ascension) that holds it; ``size`` in degrees."""
    placed = df.withColumn("_zone", _zone(F.col(dec), size))
    return placed.withColumn("_bin", F.pmod(_bin(F.col(ra), F.col("_zone"), size), _bins(F.col("_zone"), size)))


def in_cover(df: DataFrame, ra: str, dec: str, reach: Column, size: float) -> DataFrame:
    """Every row once for each cell that its disc of ``reach`` degrees can touch."""
    far, at, zone = F.col("_far"), F.col(dec), F.col("_zone")
    turn = F.when(F.abs(at) + far < 90.0, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(far)) / F.cos(F.radians(at))))) + 1e-9).otherwise(180.0)
    zones = df.withColumn("_far", reach * (1.0 + 1e-9) + 1e-9).withColumn("_turn", turn).withColumn("_zone", F.explode(F.sequence(_zone(at - far, size), _zone(at + far, size))))
    ends = zones.withColumn("_around", _bins(zone, size)).withColumn("_low", _bin(F.col(ra) - F.col("_turn"), zone, size)).withColumn("_high", _bin(F.col(ra) + F.col("_turn"), zone, size))
    bins = F.sequence("_low", F.least(F.col("_high"), F.col("_low") + F.col("_around") - 1))
    return ends.withColumn("_bin", F.explode(bins)).withColumn("_bin", F.pmod("_bin", "_around")).drop("_far", "_turn", "_around", "_low", "_high")


def cone_join(targets: DataFrame, sources: DataFrame, t_ra: str, t_dec: str, s_ra: str, s_dec: str, radius: str,
              widest_arcsec: float, keys: list[str] = (), name: str = "separation_arcsec", cell_arcsec: float | None = None, copy_sources: bool = False, rounding: float = 0.0) -> DataFrame:
    """Sources within a per-target radius (arcsec, at most ``widest_arcsec``), with their separation.

    The sky is cut into zones of declination and bins of right ascension whose
    width follows the declination, so neither the RA wrap nor the poles need care.
    Rows of one side are copied to the cells their disc can touch (nine at most
    times when cells are as large as the disc), rows of the other stay single:
    targets are copied by their own radius, or sources by the widest one with
    ``copy_sources``.  Cells smaller than a disc spread a crowded disc over tasks.
    Sources up to ``rounding`` (arcsec, at most a millionth) beyond the radius count as on it.
    """
    widest = min(widest_arcsec / 3600.0, 180.0)
    size = max(cell_arcsec / 3600.0 if cell_arcsec else widest, 1e-6)
    placed = lambda df, ra, dec: df.filter(F.col(ra).isNotNull() & F.col(dec).isNotNull())
    left, right = placed(targets, t_ra, t_dec).filter(F.col(radius).isNotNull()), placed(sources, s_ra, s_dec)
    if copy_sources:
        left, right = in_cell(left, t_ra, t_dec, size), in_cover(right, s_ra, s_dec, F.lit(widest), size)
    else:
        reach = F.least(F.lit(widest), F.greatest(F.lit(0.0), F.col(radius) / 3600.0))
        left, right = in_cover(left, t_ra, t_dec, reach, size), in_cell(right, s_ra, s_dec, size)
    met = left.join(right, [*keys, "_zone", "_bin"]).drop("_zone", "_bin")
    return met.withColumn(name, g.separation_arcsec(F.col(t_ra), F.col(t_dec), F.col(s_ra), F.col(s_dec))).filter(F.col(name) <= F.col(radius) + rounding)


def cone_search(catalogue: DataFrame, ra0: float | None, dec0: float | None, radius_arcsec: float, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Rows around one position; without a position all rows."""
    if radius_arcsec < 0:
        raise ValueError("radius must be non-negative")
    if ra0 is None or dec0 is None:
        return catalogue
    return catalogue.filter(g.separation_arcsec(F.lit(ra0), F.lit(dec0), F.col(ra), F.col(dec)) <= radius_arcsec)
