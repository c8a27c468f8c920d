"""Raster values along pairs, read where the raster is.

A field is cut into square tiles.  A pair belongs to the tile of its first end,
and a tile comes with a rim as wide as a pair can reach, so a pair meets one tile
and its samples never leave the task.  Tiles of crowded places are repeated, so
that no task holds more than a bounded share of their pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from fieldlink.config import FWHM_PER_SIGMA, Config
from fieldlink.lineage import cut

#: Pixels along the side of a tile without its rim.
TILE_SIDE = 256
#: Pairs of first ends with ends of their own tile that one group holds at most, unless one end alone has more.
GROUP_PAIRS = 1 << 17
#: Pairs whose samples are spread out in memory at a time.
BATCH = 4096

TILE = ["field_id", "_ty", "_tx"]
DEAL = [*TILE, "_deal"]
LISTS = ("line", "rline")
COUNTS = ("nb", "nbw", "nr", "nrp")
VALUES = ("b_mean", "b_max", "b_min", "r_mean", "r_max", "r_sum")


def radius_of(cfg: Config) -> float:
    a = cfg.association
    radius = a.max_pair_beams * cfg.beam.long_axis
    return min(radius, a.max_pair_arcsec) if a.max_pair_arcsec else radius


def half_widths(across: Column, scale: Column, cfg: Config) -> tuple[Column, Column]:
    """Half widths in pixels of the corridor of bridges and of residuals."""
    wide = cfg.association.min_bridge_width_beam
    return F.greatest(F.lit(1.0), 0.5 * wide * across / scale), F.greatest(F.lit(1.0), 0.5 * max(wide, 0.6) * across / scale)


def _tile(x: Column) -> Column:
    return F.floor(x / F.lit(TILE_SIDE)).cast("int")


def crowding(spots: DataFrame, cfg: Config) -> DataFrame:
    """(field, tile, reach in pixels, deals) of the tiles that hold first ends."""
    _, half = half_widths(F.lit(cfg.beam.long_axis), F.col("pixel_scale"), cfg)
    reach = F.ceil(radius_of(cfg) / F.col("pixel_scale") + half + 2).cast("int")
    n = F.count("*")
    return spots.groupBy("field_id", _tile(F.col("y")).alias("_ty"), _tile(F.col("x")).alias("_tx")).agg(
        F.max(reach).alias("_reach"), F.ceil(n * n / F.lit(GROUP_PAIRS)).cast("int").alias("_deals"))


def raster_tiles(snr: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row per tile and deal with the pixels of the tile and its rim."""
    reach = tiles.groupBy("field_id").agg(F.max("_reach").alias("_r"))
    around = lambda c: F.sequence(_tile(F.col(c) - F.col("_r")), _tile(F.col(c) + F.col("_r")))
    copied = snr.join(reach, "field_id").withColumn("_ty", F.explode(around("y"))).withColumn("_tx", F.explode(around("x")))
    packed = copied.join(tiles.select(*TILE), TILE, "left_semi").groupBy(*TILE).agg(F.collect_list(F.struct("y", "x", "snr")).alias("_p"))
    dealt = packed.join(tiles.select(*TILE, "_deals"), TILE).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)))
    return dealt.select(*DEAL, F.col("_p.y").alias("ys"), F.col("_p.x").alias("xs"), F.col("_p.snr").alias("values"))


def with_samples(pairs: DataFrame, snr: DataFrame, spots: DataFrame, cfg: Config, frame: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs with the values on their line (``line``), the same without both sources (``rline``) and sums over their corridor.

    ``pairs``: field_id, component_index_1, x_1, y_1, x_2, y_2, pixel_scale, width and
    height.  ``frame`` adds, once they have travelled, amplitudes ``_amp_1`` and ``_amp_2``, ``_half_bridge``, ``_half_residual``, ``_exclude``
    and the corner ``_x0``, ``_y0`` of the cut-out of residuals.  ``spots``: field_id, x, y and
    pixel_scale of all first ends.  Every pair stays, also outside the raster.
    """
    tiles = cut(crowding(spots, cfg))
    placed = pairs.withColumn("_ty", _tile(F.col("y_1"))).withColumn("_tx", _tile(F.col("x_1"))).join(tiles.drop("_reach"), TILE)
    dealt = frame(placed.withColumn("_deal", F.pmod("component_index_1", "_deals").cast("int")).drop("_deals").repartition(*DEAL))
    found = [*(StructField(c, ArrayType(DoubleType())) for c in LISTS), *(StructField(c, LongType()) for c in COUNTS), *(StructField(c, DoubleType()) for c in VALUES)]
    schema = StructType([*dealt.schema.fields, *found])
    left, right = dealt.groupBy(*DEAL), raster_tiles(snr, tiles).groupBy(*DEAL)
    return left.cogroup(right).applyInArrow(_reader(cfg), schema).drop("_ty", "_tx", "_deal")


def _reader(cfg: Config) -> Callable[[pa.Table, pa.Table], pa.Table]:
    a, beam = cfg.association, cfg.beam
    turn = np.radians(beam.pixel_angle)
    shape = (np.cos(turn), np.sin(turn), beam.long_axis, beam.short_axis)
    names = ("x_1", "y_1", "x_2", "y_2", "pixel_scale", "width", "height", "_amp_1", "_amp_2", "_half_bridge", "_half_residual", "_exclude", "_x0", "_y0")

    def read(pairs: pa.Table, tile: pa.Table) -> pa.Table:
        image = Window(tile)
        whole = {c: pairs.column(c).cast(pa.float64()).to_numpy() for c in names}
        parts = [_samples({c: v[i : i + BATCH] for c, v in whole.items()}, image, shape, a.weak_score, a.residual_snr) for i in range(0, pairs.num_rows, BATCH)]
        for c in (*LISTS, *COUNTS, *VALUES):
            kind = pa.list_(pa.float64()) if c in LISTS else pa.int64() if c in COUNTS else pa.float64()
            pairs = pairs.append_column(pa.field(c, kind), pa.chunked_array([p[c] for p in parts], kind))
        return pairs

    return read


class Window:
    """The pixels of one tile as an array."""

    def __init__(self, tile: pa.Table):
        ys, xs, values = (tile.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ys", "xs", "values"))
        self.y0, self.x0 = (int(v.min()) if len(v) else 0 for v in (ys, xs))
        size = [int(v.max() - v.min()) + 1 if len(v) else 0 for v in (ys, xs)]
        self.value, self.known = np.zeros(size), np.zeros(size, bool)
        self.value[ys - self.y0, xs - self.x0] = values
        self.known[ys - self.y0, xs - self.x0] = True

    def at(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which positions have a pixel, the values there)."""
        row, col = (y - self.y0).astype(np.int64), (x - self.x0).astype(np.int64)
        ok = (row >= 0) & (col >= 0) & (row < self.value.shape[0]) & (col < self.value.shape[1])
        ok[ok] = self.known[row[ok], col[ok]]
        return ok, self.value[row[ok], col[ok]]


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within the owner) of ``counts[i]`` rows for each i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _samples(p: dict, image: Window, shape: tuple, weak: float, residual: float) -> dict:
    n = len(p["x_1"])
    x1, y1, dx, dy = p["x_1"], p["y_1"], p["x_2"] - p["x_1"], p["y_2"] - p["y_1"]
    length = np.sqrt(dx * dx + dy * dy)

    def model(i: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """S/N both end sources would put at a pixel if they were beam-shaped."""
        c, s, long, short = shape
        total = np.zeros(len(i))
        for e in "12":
            ox, oy = (x - p[f"x_{e}"][i]) * p["pixel_scale"][i], (y - p[f"y_{e}"][i]) * p["pixel_scale"][i]
            along, across = ox * c + oy * s, oy * c - ox * s
            far = np.sqrt((along / long) ** 2 + (across / short) ** 2)
            total = total + p[f"_amp_{e}"][i] * np.exp(-0.5 * FWHM_PER_SIGMA**2 * far * far)
        return total

    # The line, and the line as the cut-out of residuals turns half pixels.
    steps = np.maximum(3, np.ceil(length).astype(np.int64) + 1)
    i, k = _spread(steps)
    last = steps[i] - 1
    sx = np.where(k == last, p["x_2"][i], x1[i] + k * (dx[i] / last))
    sy = np.where(k == last, p["y_2"][i], y1[i] + k * (dy[i] / last))
    ok, v = image.at(np.rint(sy), np.rint(sx))
    out = {"line": _lists(i[ok], v, n)}
    ry, rx = np.rint(sy - p["_y0"][i]) + p["_y0"][i], np.rint(sx - p["_x0"][i]) + p["_x0"][i]
    ok, v = image.at(ry, rx)
    moving = length[i[ok]] > 0
    i, x, y = (q[ok][moving] for q in (i, rx, ry))
    out["rline"] = _lists(i, v[moving] - model(i, x, y), n)

    # Pixels of the corridor: each image row yields the interval of x that can lie in it.
    h = np.maximum(p["_half_bridge"], p["_half_residual"])
    top = np.maximum(0, np.floor(np.minimum(y1, p["y_2"]) - h))
    bottom = np.minimum(p["height"] - 1, np.ceil(np.maximum(y1, p["y_2"]) + h))
    i, k = _spread(np.maximum(0, bottom - top + 1).astype(np.int64))
    y = top[i] + k
    up, a, b, half, full = y - y1[i], dx[i], dy[i], h[i], length[i]
    low, high = np.minimum(x1, p["x_2"])[i] - half, np.maximum(x1, p["x_2"])[i] + half
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for use, ends in ((np.abs(b) > 1e-9, ((up * a - half * full) / b, (up * a + half * full) / b)), (np.abs(a) > 1e-9, (-up * b / a, (full * full - up * b) / a))):
            low = np.where(use, np.maximum(low, x1[i] + np.minimum(*ends)), low)
            high = np.where(use, np.minimum(high, x1[i] + np.maximum(*ends)), high)
    start = np.maximum(0, np.floor(low - 1e-6))
    stop = np.minimum(p["width"][i] - 1, np.ceil(high + 1e-6))
    row, k = _spread(np.maximum(0, stop - start + 1).astype(np.int64))
    x, y, i = start[row] + k, y[row], i[row]
    ox, oy, a, b, full = x - x1[i], y - y1[i], dx[i], dy[i], length[i]
    flat = full == 0
    along = (ox * a + oy * b) / np.where(flat, 1.0, full * full)
    aside = np.where(flat, np.sqrt(ox * ox + oy * oy), np.abs(ox * b - oy * a) / np.maximum(full, 1e-6))
    inside = (flat | (along >= 0) & (along <= 1)) & (aside <= h[i])
    i, x, y, along, aside = (q[inside] for q in (i, x, y, along, aside))
    ok, v = image.at(y, x)
    i, x, y, along, aside = (q[ok] for q in (i, x, y, along, aside))
    bridge = aside <= p["_half_bridge"][i]
    full, skip = length[i], p["_exclude"][i]
    step = along * full
    between = (full > 0) & (step >= skip) & (step <= np.maximum(full - skip, skip)) & (aside <= p["_half_residual"][i])
    rest = (v - model(i, x, y))[between]
    for name, j, q, level in (("b", i[bridge], v[bridge], weak), ("r", i[between], rest, residual)):
        count, total = np.bincount(j, minlength=n), _sums(j, q, n)
        have = count > 0
        least, most = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(least, j, q)
        np.maximum.at(most, j, q)
        shown = lambda value: pa.array(value, mask=~have)
        over = np.bincount(j[q >= level], minlength=n)
        out.update({f"n{name}": pa.array(count), f"{name}_mean": shown(total / np.maximum(count, 1)), f"{name}_max": shown(most)})
        out.update({"nbw": pa.array(over), "b_min": shown(least)} if name == "b" else {"nrp": pa.array(over), "r_sum": shown(_sums(j, np.maximum(q, 0.0), n))})
    return out


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    # Of no values numpy gives integers, and batches of a tile must agree.
    return np.bincount(owner, values, n).astype(float)


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
