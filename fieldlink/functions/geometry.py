"""Angle, beam, sky and box arithmetic as column expressions.

Lengths are arcsec or pixels as named; angles are degrees.  A missing value is
NULL, never NaN, and stays NULL unless a function says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from fieldlink.config import FWHM_PER_SIGMA, Beam

ARCSEC_PER_RADIAN = math.degrees(1.0) * 3600.0


# ---- small building blocks -------------------------------------------------

def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; NULL stays NULL (least/greatest would drop it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def yes(condition: Column) -> Column:
    """A condition in which an unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def finite(value: Column) -> Column:
    """The number, or NULL when it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def finite_or(value: Column, default) -> Column:
    return F.coalesce(finite(value), F.lit(default) if not isinstance(default, Column) else default)


def count_true(*conditions: Column) -> Column:
    total = F.lit(0)
    for condition in conditions:
        total = total + yes(condition).cast("int")
    return total


# ---- angles ----------------------------------------------------------------

def half_turn(angle: Column) -> Column:
    """Undirected angle in [0, 180)."""
    return F.pmod(angle, F.lit(180.0))


def half_turn_delta(a: Column, b: Column) -> Column:
    """Smallest difference of two undirected angles; 90 when one is missing."""
    return F.coalesce(F.abs(F.pmod(a - b + 90.0, F.lit(180.0)) - 90.0), F.lit(90.0))


def sky_to_pixel_angle(pa: Column, beam: Beam) -> Column:
    """Sky position angle (east of north) to pixel-plane angle."""
    east = F.lit(beam.ra_axis_sign) * F.sin(F.radians(pa))
    north = F.lit(beam.dec_axis_sign) * F.cos(F.radians(pa))
    return half_turn(F.degrees(F.atan2(north, east)))


def direction(dx: Column, dy: Column) -> Column:
    """Undirected direction of a displacement; NULL for no displacement."""
    moved = (F.abs(dx) >= 1e-12) | (F.abs(dy) >= 1e-12)
    return F.when(moved, half_turn(F.degrees(F.atan2(dy, dx))))


def alignment(delta: Column, scale: float = 45.0) -> Column:
    return clip(1.0 - delta / scale, 0.0, 1.0)


# ---- covariance ------------------------------------------------------------

def covariance(major: Column, minor: Column, angle: Column) -> tuple[Column, Column, Column]:
    """(c00, c01, c11) of an ellipse given by full widths; axes may be swapped."""
    turn = F.when(minor > major, angle + 90.0).otherwise(angle)
    s_long = F.pow(F.greatest(major, minor) / FWHM_PER_SIGMA, 2)
    s_short = F.pow(F.least(major, minor) / FWHM_PER_SIGMA, 2)
    c, s = F.cos(F.radians(turn)), F.sin(F.radians(turn))
    return (
        s_long * c * c + s_short * s * s,
        (s_long - s_short) * c * s,
        s_long * s * s + s_short * c * c,
    )


def principal_axes(c00: Column, c01: Column, c11: Column) -> tuple[Column, Column, Column]:
    """(larger eigenvalue, smaller, direction of the larger) of a 2x2 symmetric matrix.

    A matrix without any preferred direction reports 90 degrees.
    """
    mean = (c00 + c11) / 2.0
    half = F.sqrt(F.pow((c00 - c11) / 2.0, 2) + c01 * c01)
    angle = F.when((c01 == 0) & (c00 <= c11), F.lit(90.0)).otherwise(
        half_turn(F.degrees(F.atan2(2.0 * c01, c00 - c11)) / 2.0)
    )
    return mean + half, mean - half, angle


# ---- beam ------------------------------------------------------------------

def beam_projection(angle: Column, beam: Beam) -> Column:
    """Beam width along a direction; the rms width when there is no direction."""
    turn = F.radians(angle - beam.pixel_angle)
    along = F.sqrt(F.pow(beam.long_axis * F.cos(turn), 2) + F.pow(beam.short_axis * F.sin(turn), 2))
    rms = math.sqrt((beam.long_axis**2 + beam.short_axis**2) / 2.0)
    return F.coalesce(along, F.lit(rms))


def along_across_beam(dx: Column, dy: Column, beam: Beam) -> tuple[Column, Column]:
    """Displacement along and across the long beam axis (signed)."""
    c, s = math.cos(math.radians(beam.pixel_angle)), math.sin(math.radians(beam.pixel_angle))
    return dx * c + dy * s, dy * c - dx * s


def beam_distance(dx: Column, dy: Column, beam: Beam) -> Column:
    """Elliptical separation in beam widths of a displacement in arcsec."""
    along, across = along_across_beam(dx, dy, beam)
    return F.sqrt(F.pow(along / beam.long_axis, 2) + F.pow(across / beam.short_axis, 2))


def beam_area_pixels(scale: Column, beam: Beam) -> Column:
    return F.lit(beam.area_arcsec2) / (scale * scale)


# ---- ratios ----------------------------------------------------------------

def larger_over_smaller(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1e-6)))


def balance(ratio: Column, limit: float, missing: float = 0.0) -> Column:
    """1 for equal sides falling to 0 at the limit, on a log scale."""
    score = F.when(ratio >= limit, 0.0).otherwise(clip(1.0 - F.log(ratio) / math.log(limit), 0.0, 1.0))
    return F.when(ratio.isNull(), F.lit(missing)).otherwise(score)


# ---- sky -------------------------------------------------------------------

def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation, exact for small angles."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    h = F.pow(F.sin((d2 - d1) / 2), 2) + F.cos(d1) * F.cos(d2) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.when(h.isNotNull(), 2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h))) * ARCSEC_PER_RADIAN)


def bearing(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Position angle of point 2 seen from point 1, radians east of north."""
    d1, d2, dra = F.radians(dec1), F.radians(dec2), F.radians(ra2 - ra1)
    return F.atan2(F.sin(dra) * F.cos(d2), F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(dra))


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def sky_midpoint(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> tuple[Column, Column]:
    """Midpoint of the great-circle arc between two points."""
    x, y, z = (a + b for a, b in zip(unit_vector(ra1, dec1), unit_vector(ra2, dec2)))
    ra = F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
    return ra, F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def axis_offsets(ra1, dec1, ra2, dec2, ra, dec) -> tuple[Column, Column]:
    """(offset across the axis in arcsec, position along it as a fraction)."""
    length = separation_arcsec(ra1, dec1, ra2, dec2)
    reach = separation_arcsec(ra1, dec1, ra, dec)
    turn = bearing(ra1, dec1, ra, dec) - bearing(ra1, dec1, ra2, dec2)
    usable = length > 0
    return (
        F.when(usable, F.abs(reach * F.sin(turn))),
        F.when(usable, reach * F.cos(turn) / length),
    )


def sky_to_pixel(ra, dec, ra0, dec0, px0, py0, step_x, step_y) -> tuple[Column, Column]:
    """Gnomonic projection to zero-based pixels; the reference pixel is one-based."""
    d, d0, dra = F.radians(dec), F.radians(dec0), F.radians(ra - ra0)
    depth = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(dra)
    xi = F.cos(d) * F.sin(dra) / depth
    eta = (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(dra)) / depth
    visible = depth > 0
    return (
        F.when(visible, px0 - 1.0 + F.degrees(xi) / step_x),
        F.when(visible, py0 - 1.0 + F.degrees(eta) / step_y),
    )


def pixel_to_sky(x, y, ra0, dec0, px0, py0, step_x, step_y) -> tuple[Column, Column]:
    """Inverse of :func:`sky_to_pixel`."""
    xi = F.radians((x - (px0 - 1.0)) * step_x)
    eta = F.radians((y - (py0 - 1.0)) * step_y)
    d0 = F.radians(dec0)
    depth = F.cos(d0) - eta * F.sin(d0)
    ra = F.pmod(ra0 + F.degrees(F.atan2(xi, depth)), F.lit(360.0))
    dec = F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + depth * depth)))
    return ra, dec


def scale_from_steps(step_x: Column, step_y: Column) -> Column:
    return (F.abs(step_x) + F.abs(step_y)) / 2.0 * 3600.0


# ---- boxes: struct<x0,y0,x1,y1> -------------------------------------------

def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box with ordered corners, NULL when any corner is missing."""
    known = finite(x0).isNotNull() & finite(y0).isNotNull() & finite(x1).isNotNull() & finite(y1).isNotNull()
    return F.when(
        known,
        F.struct(
            F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"),
            F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"),
        ),
    )


def parse_box(text: Column) -> Column:
    """Read "x0,y0,x1,y1"; anything else is NULL."""
    parts = F.split(text, ",")
    corner = [F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2, 3, 4)]
    return F.when(F.size(parts) == 4, box(*corner))


def format_box(b: Column) -> Column:
    ints = [F.rint(b[c]).cast("long").cast("string") for c in ("x0", "y0", "x1", "y1")]
    return F.when(b.isNull(), F.lit("")).otherwise(F.concat_ws(",", *ints))


def box_gap(a: Column, b: Column) -> Column:
    dx = F.greatest(b["x0"] - a["x1"], a["x0"] - b["x1"], F.lit(0.0))
    dy = F.greatest(b["y0"] - a["y1"], a["y0"] - b["y1"], F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), F.sqrt(dx * dx + dy * dy))


def box_side(b: Column) -> Column:
    """Longer side in pixels, counting both edge pixels."""
    return F.when(b.isNotNull(), F.greatest(b["x1"] - b["x0"] + 1, b["y1"] - b["y0"] + 1, F.lit(0.0)))


def box_union(a: Column, b: Column) -> Column:
    return F.when(
        a.isNotNull() & b.isNotNull(),
        F.struct(
            F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"),
            F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"),
        ),
    )


def inward_share(b: Column, cx: Column, cy: Column, ux: Column, uy: Column) -> Column:
    """Share of a box's extent that lies on the side a direction points to."""
    reach = [
        (b[x] - cx) * ux + (b[y] - cy) * uy for x in ("x0", "x1") for y in ("y0", "y1")
    ]
    ahead = F.greatest(F.greatest(*reach), F.lit(0.0))
    behind = F.greatest(-F.least(*reach), F.lit(0.0))
    usable = b.isNotNull() & cx.isNotNull() & cy.isNotNull() & ux.isNotNull() & (ahead + behind > 1e-6)
    return F.when(usable, ahead / (ahead + behind)).otherwise(0.5)
