"""Rasters in long form: background, smoothing, S/N, masks, labels, point and line reads.

``pixels``: field_id, y, x, value (dense).  ``fields``: field_id, width, height,
pixel_scale and optional rms / mean.  ``snr``: field_id, y, x, snr.
``labels``: field_id, threshold, y, x, label, area (foreground only).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldlink.config import Segmentation
from fieldlink.functions import geometry as g
from fieldlink.lineage import cut
from fieldlink.operators.graph import component_labels
from fieldlink.operators.ranking import exact_median

PIXEL = ["field_id", "y", "x"]
LABEL_KEY = ["field_id", "threshold"]
#: Pixels along the side of a block that one task labels at a time.
BLOCK_SIDE = 64


def sigma_name(threshold: float) -> str:
    return f"{threshold:g}".replace(".", "p") + "sigma"


# ---- background and noise --------------------------------------------------

def _column(df: DataFrame, name: str) -> Column:
    return g.finite(F.col(name)) if name in df.columns else F.lit(None).cast("double")


def background(pixels: DataFrame, fields: DataFrame, seg: Segmentation) -> DataFrame:
    """Per field: mean_value, rms_value and the median used to fill bad pixels.

    A supplied value wins.  The two median passes only read the fields that
    need them.  Where metadata is required, a field without it ends the job; see
    :func:`metadata_issues`.
    """
    if seg.require_metadata:
        return _required_background(pixels, fields)
    supplied = fields.select("field_id", _column(fields, "mean").alias("_mean"), _column(fields, "rms").alias("_rms"))
    values = pixels.select("field_id", g.finite(F.col("value")).alias("v"))
    basic = values.groupBy("field_id").agg(F.avg("v").alias("_avg"), F.stddev_pop("v").alias("_std"))
    middle = exact_median(values, ["field_id"], "v", "_median")
    known = supplied.join(basic, "field_id", "left").join(middle, "field_id", "left")
    estimate = {"median": F.col("_median"), "mean": F.col("_avg"), "zero": F.lit(0.0)}[seg.mean_mode]
    noise = F.when(F.col("_std") > 0, F.col("_std"))
    if seg.rms_mode == "mad":
        needy = known.filter(F.col("_rms").isNull() | (F.col("_rms") <= 0)).select("field_id", "_median")
        off = values.join(needy, "field_id").select("field_id", F.abs(F.col("v") - F.col("_median")).alias("d"))
        known = known.join(exact_median(off, ["field_id"], "d", "_mad"), "field_id", "left")
        noise = F.coalesce(F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")), noise)
    return known.select(
        "field_id",
        F.coalesce("_mean", estimate, F.lit(0.0)).alias("mean_value"),
        F.coalesce(F.when(F.col("_rms") > 0, F.col("_rms")), noise, F.lit(1.0)).alias("rms_value"),
        F.coalesce("_median", F.lit(0.0)).alias("fill_value"),
    )


def metadata_issues(fields: DataFrame, pixels: DataFrame | None = None) -> DataFrame:
    """(field_id, issue): fields without a finite mean or a positive rms, in their row or in any of their pixels."""
    rows = fields.select("field_id", _column(fields, "mean").alias("_mean"), _column(fields, "rms").alias("_rms"))
    if pixels is not None:
        maps = pixels.groupBy("field_id").agg(*(F.bool_or(_column(pixels, c).isNotNull() & (_column(pixels, c) > 0 if c == "rms" else F.lit(True))).alias(f"_has_{c}") for c in ("mean", "rms")))
        rows = rows.join(maps, "field_id", "left")
    else:
        rows = rows.withColumns({"_has_mean": F.lit(False), "_has_rms": F.lit(False)})
    mean = F.col("_mean").isNull() & ~F.coalesce("_has_mean", F.lit(False))
    rms = (F.col("_rms").isNull() | (F.col("_rms") <= 0)) & ~F.coalesce("_has_rms", F.lit(False))
    found = F.array_compact(F.array(F.when(mean, "missing_mean"), F.when(rms, "missing_rms")))
    return rows.select("field_id", F.explode(found).alias("issue"))


def _required_background(pixels: DataFrame, fields: DataFrame) -> DataFrame:
    bad = metadata_issues(fields, pixels).groupBy("field_id").agg(F.array_join(F.sort_array(F.collect_set("issue")), ",").alias("_issue"))
    known = fields.select("field_id", _column(fields, "mean").alias("_mean"), _column(fields, "rms").alias("_rms")).join(bad, "field_id", "left")
    stop = F.raise_error(F.concat(F.lit("field "), F.col("field_id").cast("string"), F.lit(": "), F.col("_issue"))).cast("double")
    checked = lambda c: F.when(F.col("_issue").isNotNull(), stop).otherwise(F.col(c))
    fill = exact_median(pixels.select("field_id", g.finite(F.col("value")).alias("v")), ["field_id"], "v", "_median")
    return known.join(fill, "field_id", "left").select(
        "field_id", checked("_mean").alias("mean_value"), checked("_rms").alias("rms_value"), F.coalesce("_median", F.lit(0.0)).alias("fill_value")
    )


# ---- smoothing and S/N -----------------------------------------------------

def _smooth_axis(df: DataFrame, along: str, across: str, size: str, weights: list[float]) -> DataFrame:
    """One axis of a separable filter with mirrored edges.

    Neighbours come from one sorted window over an image line, so a task holds a
    single line of one image and nothing is copied per tap.
    """
    radius = len(weights) - 1
    line = W.partitionBy("field_id", across).orderBy(along)
    near = F.array(*[
        F.lead("v", -k).over(line) if k < 0 else F.lag("v", k).over(line) for k in range(radius, -radius - 1, -1)
    ])
    n, at = F.col(size), F.col(along)

    def tap(k: int) -> Column:
        folded = F.pmod(at + k, 2 * n)
        mirrored = F.when(folded < n, folded).otherwise(2 * n - 1 - folded)
        return F.get(F.col("_near"), (mirrored - at + radius).cast("int"))

    total = F.lit(weights[0]) * F.col("v")
    for k in range(1, radius + 1):
        total = total + F.lit(weights[k]) * (tap(-k) + tap(k))
    return df.withColumn("_near", near).withColumn("v", total).drop("_near")


def gaussian_weights(sigma: float) -> list[float]:
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(radius + 1)]
    total = raw[0] + 2.0 * sum(raw[1:])
    return [w / total for w in raw]


def smooth(pixels: DataFrame, sigma: float) -> DataFrame:
    """Gaussian filter of column v; needs width and height beside it."""
    weights = gaussian_weights(sigma)
    return _smooth_axis(_smooth_axis(pixels, "y", "x", "height", weights), "x", "y", "width", weights)


def snr_map(pixels: DataFrame, fields: DataFrame, seg: Segmentation) -> DataFrame:
    """S/N per pixel, as single precision values, 0 where it is not finite."""
    levels = background(pixels, fields, seg)
    per_pixel = [c for c in ("mean", "rms") if c in pixels.columns]
    work = (
        pixels.join(levels, "field_id")
        .join(fields.select("field_id", "width", "height"), "field_id")
        .withColumn("v", F.coalesce(g.finite(F.col("value")), F.col("fill_value")) if seg.smooth else F.col("value"))
    )
    if seg.smooth and seg.smooth_sigma_pix > 0:
        work = smooth(work, seg.smooth_sigma_pix)
    mean = F.coalesce(g.finite(F.col("mean")), F.col("mean_value")) if "mean" in per_pixel else F.col("mean_value")
    rms = F.coalesce(F.when(g.finite(F.col("rms")) > 0, F.col("rms")), F.col("rms_value")) if "rms" in per_pixel else F.col("rms_value")
    ratio = ((F.col("v") - mean) / rms).cast("float").cast("double")
    return work.select(*PIXEL, F.coalesce(g.finite(ratio), F.lit(0.0)).alias("snr"))


# ---- masks and labels ------------------------------------------------------

def threshold_masks(snr: DataFrame, thresholds) -> DataFrame:
    """One row per pixel and threshold it lies strictly above."""
    over = F.array_compact(F.array(*[F.when(F.col("snr") > t, F.lit(float(t))) for t in thresholds]))
    return snr.filter(F.col("snr") > min(thresholds)).select("field_id", F.explode(over).alias("threshold"), "y", "x")


def _offsets(connectivity: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if connectivity == 2 or abs(dx) + abs(dy) <= 1]


def _shifted(mask: DataFrame, connectivity: int) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _offsets(connectivity)])
    return mask.withColumn("_s", F.explode(steps)).select(
        *LABEL_KEY, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x")
    )


def dilate(mask: DataFrame, fields: DataFrame, connectivity: int) -> DataFrame:
    inside = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))
    grown = _shifted(mask, connectivity).filter((F.col("y") >= 0) & (F.col("x") >= 0)).distinct()
    size = fields.select("field_id", "width", "height")
    return grown.join(size, "field_id").filter(inside).select(*LABEL_KEY, "y", "x")


def erode(mask: DataFrame, connectivity: int) -> DataFrame:
    """Keep pixels whose whole neighbourhood is set; beyond the image nothing is set."""
    need = len(_offsets(connectivity))
    return (
        _shifted(mask, connectivity).groupBy(*LABEL_KEY, "y", "x").agg(F.count("*").alias("_n"))
        .filter(F.col("_n") == need).drop("_n")
    )


def close_mask(mask, fields, connectivity):
    return erode(dilate(mask, fields, connectivity), connectivity)


def open_mask(mask, fields, connectivity):
    return dilate(erode(mask, connectivity), fields, connectivity)


def label_regions(mask: DataFrame, fields: DataFrame, connectivity: int) -> DataFrame:
    """Connected regions; the label is one plus the smallest raster position.

    An image is cut into square blocks.  Each block is labelled inside one task,
    and only pixels along the seams between blocks meet in a join, so the graph of
    regions grows with the seams and no step gathers a whole image.
    """
    parts = cut(label_blocks(mask, fields, connectivity))
    found = component_labels(block_seams(parts, connectivity), LABEL_KEY, "src", "dst").withColumnRenamed("node", "part")
    return parts.join(found, LABEL_KEY + ["part"], "left").select(*LABEL_KEY, "y", "x", (F.coalesce("label", "part") + 1).alias("label"))


def label_blocks(mask: DataFrame, fields: DataFrame, connectivity: int) -> DataFrame:
    """(field_id, threshold, y, x, part): the smallest raster position of the region of each pixel within its block."""
    block = [F.floor(F.col(c) / F.lit(BLOCK_SIDE)).cast("int").alias(f"_b{c}") for c in ("y", "x")]
    cells = mask.join(fields.select("field_id", "width"), "field_id").select(*LABEL_KEY, "width", "y", "x", *block)
    blocks = cells.groupBy(*LABEL_KEY, "_by", "_bx").agg(F.first("width").cast("long").alias("width"), F.sort_array(F.collect_list(F.struct("y", "x"))).alias("cells"))
    rows = blocks.select(*LABEL_KEY, "width", F.transform("cells", lambda c: c.y.cast("long")).alias("ys"), F.transform("cells", lambda c: c.x.cast("long")).alias("xs"))
    kinds = {f.name: f.dataType.simpleString() for f in mask.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            ys, xs = (batch.column(i).flatten().to_numpy() for i in (3, 4))
            ends = np.cumsum(sizes)
            parts = [np.zeros(0, np.int64)]
            for width, a, b in zip(batch.column(2).to_pylist(), (ends - sizes).tolist(), ends.tolist()):
                parts.append(_block_parts(ys[a:b], xs[a:b], width, connectivity))
            take = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(ys), pa.array(xs), pa.array(np.concatenate(parts))], [*LABEL_KEY, "y", "x", "part"])

    labelled = rows.mapInArrow(run, f"field_id {kinds['field_id']}, threshold {kinds['threshold']}, y long, x long, part long")
    return labelled.select(*LABEL_KEY, F.col("y").cast(kinds["y"]), F.col("x").cast(kinds["x"]), "part")


def _block_parts(ys: np.ndarray, xs: np.ndarray, width: int, connectivity: int) -> np.ndarray:
    """Smallest raster position connected to each pixel of one block; pixels come in raster order."""
    fresh = np.ones(len(ys), bool)
    fresh[1:] = (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)
    run = np.cumsum(fresh) - 1
    grid = np.full((int(ys[-1] - ys[0]) + 1, int(xs.max() - xs.min()) + 3), -1, np.int64)
    grid[ys - ys[0], xs - xs.min() + 1] = run
    touching = []
    for step in (-1, 0, 1) if connectivity == 2 else (0,):
        upper, lower = grid[:-1, 1:-1], grid[1:, 1 + step : grid.shape[1] - 1 + step]
        both = (upper >= 0) & (lower >= 0)
        touching.append(np.stack([upper[both], lower[both]], 1))
    home = list(range(int(run[-1]) + 1))

    def root(i: int) -> int:
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for i, j in np.unique(np.concatenate(touching), axis=0).tolist():
        i, j = root(i), root(j)
        home[max(i, j)] = min(i, j)
    heads = (ys * width + xs)[fresh]
    return heads[np.array([root(i) for i in range(len(home))])][run]


def block_seams(parts: DataFrame, connectivity: int) -> DataFrame:
    """(field_id, threshold, src, dst): parts of different blocks that touch, each pair once."""
    last = F.lit(BLOCK_SIDE - 1)
    inside = {c: F.pmod(F.col(c), F.lit(BLOCK_SIDE)) for c in ("y", "x")}
    step = lambda dy, dx: F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
    slant = connectivity == 2
    down = F.array(*(step(1, d) for d in ((-1, 0, 1) if slant else (0,))))
    right = F.array(*(step(d, 1) for d in ((-1, 0, 1) if slant else (0,))))
    none = F.array().cast("array<struct<dy:int,dx:int>>")
    steps = F.array_union(F.when(inside["y"] == last, down).otherwise(none), F.when(inside["x"] == last, right).otherwise(none))
    rim = parts.filter(inside["y"].isin(0, BLOCK_SIDE - 1) | inside["x"].isin(0, BLOCK_SIDE - 1))
    across = rim.withColumn("_s", F.explode(steps)).select(
        *LABEL_KEY, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), F.col("part").alias("src")
    )
    return across.join(rim.withColumnRenamed("part", "dst"), LABEL_KEY + ["y", "x"]).filter("src != dst").select(*LABEL_KEY, "src", "dst").distinct()


def region_areas(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*LABEL_KEY, "label").agg(F.count("*").alias("area"))


def segment(snr: DataFrame, fields: DataFrame, seg: Segmentation) -> tuple[DataFrame, DataFrame]:
    """(labels with areas, regions removed for their size per field and threshold)."""
    mask = threshold_masks(snr, seg.thresholds)
    if seg.opening:
        mask = open_mask(mask, fields, seg.connectivity)
    if seg.closing:
        mask = close_mask(mask, fields, seg.connectivity)
    labels = label_regions(mask, fields, seg.connectivity)
    areas = region_areas(labels)
    removed = areas.filter(F.col("area") < seg.min_mask_area_pix).groupBy(*LABEL_KEY).agg(F.count("*").alias("removed"))
    kept = labels.join(areas.filter(F.col("area") >= seg.min_mask_area_pix), LABEL_KEY + ["label"])
    return kept.select(*LABEL_KEY, "y", "x", "label", "area"), removed


def segmentation_diagnostics(labels: DataFrame, removed: DataFrame, fields: DataFrame, seg: Segmentation) -> DataFrame:
    per_label = region_areas(labels).groupBy(*LABEL_KEY).agg(
        F.count("*").alias("n_labels"), F.max("area").alias("largest_label_area"), F.sum("area").alias("total_mask_area")
    )
    frame = fields.select("field_id", (F.col("width") * F.col("height")).cast("double").alias("_size")).withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(t)) for t in seg.thresholds]))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = frame.join(per_label, LABEL_KEY, "left").join(removed, LABEL_KEY, "left").select(
        *LABEL_KEY, zero("n_labels"), zero("largest_label_area"), zero("total_mask_area"),
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_small_objects_removed"), "_size",
    )
    warning = F.concat_ws(
        ";",
        F.when(F.col("total_mask_area") / F.col("_size") > 0.10, "mask_fraction_gt_0.1"),
        F.when(F.col("largest_label_area") / F.col("_size") > 0.05, "largest_label_gt_0.05"),
    )
    return out.select("*", (F.col("total_mask_area") / F.col("_size")).alias("mask_fraction"), warning.alias("warning")).drop("_size")


# ---- reads at points -------------------------------------------------------

def at_points(points: DataFrame, snr: DataFrame, labels: DataFrame, seg: Segmentation, id_col: str,
              x: Column | None = None, y: Column | None = None) -> DataFrame:
    """Add snr_at and label_at_/area_at_ columns read at the nearest pixel.

    Outside the raster snr_at is NULL and labels are 0.
    """
    px, py = (F.col("x") if x is None else x), (F.col("y") if y is None else y)
    placed = points.withColumn("_px", F.rint(px).cast("int")).withColumn("_py", F.rint(py).cast("int"))
    spots = placed.select("field_id", id_col, F.col("_py").alias("y"), F.col("_px").alias("x"))
    keep = [c for c in ("label", "area") if c in labels.columns]
    reads = []
    for t in seg.thresholds:
        for c in keep:
            reads.append(F.max(F.when(F.col("threshold") == float(t), F.col(c))).alias(f"{c}_at_{sigma_name(t)}"))
    found = spots.join(labels, PIXEL).groupBy("field_id", id_col).agg(*reads)
    out = placed.join(
        snr.select("field_id", F.col("y").alias("_py"), F.col("x").alias("_px"), F.col("snr").alias("snr_at")),
        ["field_id", "_py", "_px"], "left",
    ).drop("_px", "_py").join(found, ["field_id", id_col], "left")
    named = {f"{c}_at_{sigma_name(t)}" for t in seg.thresholds for c in keep}
    return out.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in named else c for c in out.columns])


# ---- reads along lines and corridors --------------------------------------

def linspace(start: Column, stop: Column, n: Column, k: Column) -> Column:
    return F.when(k == n - 1, stop).otherwise(start + k * ((stop - start) / (n - 1)))


def line_points(pairs: DataFrame, keep: list[str], fixed: int | None = None) -> DataFrame:
    """Sample positions k = 0..n-1 between (x_1, y_1) and (x_2, y_2), one per pixel step."""
    length = F.sqrt(F.pow(F.col("x_2") - F.col("x_1"), 2) + F.pow(F.col("y_2") - F.col("y_1"), 2))
    n = F.lit(fixed) if fixed else F.greatest(F.lit(3), F.ceil(length).cast("int") + 1)
    counted = pairs.withColumn("_n", n.cast("int"))
    walked = counted.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return walked.select(
        *keep, "k",
        linspace(F.col("x_1"), F.col("x_2"), F.col("_n"), F.col("k")).alias("sx"),
        linspace(F.col("y_1"), F.col("y_2"), F.col("_n"), F.col("k")).alias("sy"),
    )


def line_values(pairs: DataFrame, snr: DataFrame, key: list[str], fixed: int | None = None) -> DataFrame:
    """Per pair the S/N values along its line inside the image, in order, as an array.

    A line has as many samples as the pair distance in pixels, which the pair
    radius bounds.
    """
    spots = line_points(pairs, key, fixed).select(
        *key, "k", F.rint("sy").cast("int").alias("y"), F.rint("sx").cast("int").alias("x")
    )
    return (
        spots.join(snr, PIXEL)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("k", "snr"))).alias("_l"))
        .select(*key, F.col("_l.snr").alias("line"))
    )


def line_minima(pairs: DataFrame, snr: DataFrame, key: list[str], low: float, *keep: str) -> DataFrame:
    """Per pair the smallest S/N on its line inside the image (``lowest``) and the share of samples below ``low`` (``gap``)."""
    spots = line_points(pairs, [*key, *keep]).select(
        *key, *keep, F.rint("sy").cast("int").alias("y"), F.rint("sx").cast("int").alias("x")
    )
    return spots.join(snr, PIXEL).groupBy(*key).agg(
        *[F.first(c).alias(c) for c in keep], F.min("snr").alias("lowest"), (F.count_if(F.col("snr") < low) / F.count("*")).alias("gap")
    )


def corridor_pixels(pairs: DataFrame, keep: list[str], half_width: str) -> DataFrame:
    """Integer pixels whose foot lies on the segment and that are close enough to it.

    Rows of the bounding box are walked; each row only yields the interval of x
    that can satisfy both conditions.
    """
    x1, y1, h = F.col("x_1"), F.col("y_1"), F.col(half_width)
    dx, dy = F.col("_vx"), F.col("_vy")
    framed = pairs.withColumn("_vx", F.col("x_2") - x1).withColumn("_vy", F.col("y_2") - y1).withColumn(
        "_len", F.sqrt(dx * dx + dy * dy)
    )
    top = F.greatest(F.lit(0), F.floor(F.least("y_1", "y_2") - h).cast("int"))
    bottom = F.least(F.col("height") - 1, F.ceil(F.greatest("y_1", "y_2") + h).cast("int"))
    rows = framed.withColumn("_t", top).withColumn("_e", bottom).filter("_e >= _t").withColumn(
        "y", F.explode(F.sequence(F.col("_t"), F.col("_e")))
    )
    up = F.col("y") - y1
    side_a, side_b = x1 + (up * dx - h * F.col("_len")) / dy, x1 + (up * dx + h * F.col("_len")) / dy
    foot_a, foot_b = x1 - up * dy / dx, x1 + (F.col("_len") * F.col("_len") - up * dy) / dx
    wide = F.lit(1e9)
    # Division by a tiny component would only widen the interval, so it is safe to skip it.
    steep, slanted = F.abs(dy) > 1e-9, F.abs(dx) > 1e-9
    low = F.greatest(
        F.when(steep, F.least(side_a, side_b)).otherwise(-wide), F.when(slanted, F.least(foot_a, foot_b)).otherwise(-wide),
        F.least("x_1", "x_2") - h,
    )
    high = F.least(
        F.when(steep, F.greatest(side_a, side_b)).otherwise(wide), F.when(slanted, F.greatest(foot_a, foot_b)).otherwise(wide),
        F.greatest("x_1", "x_2") + h,
    )
    spans = rows.withColumn("_a", F.greatest(F.lit(0), F.floor(low - 1e-6).cast("int"))).withColumn(
        "_b", F.least(F.col("width") - 1, F.ceil(high + 1e-6).cast("int"))
    )
    cells = spans.filter("_b >= _a").withColumn("x", F.explode(F.sequence(F.col("_a"), F.col("_b"))))
    ox, oy, l2 = F.col("x") - x1, F.col("y") - y1, F.col("_len") * F.col("_len")
    along = (ox * dx + oy * dy) / l2
    aside = F.abs(ox * dy - oy * dx) / F.greatest(F.col("_len"), F.lit(1e-6))
    measured = cells.withColumn("along", F.when(l2 > 0, along)).withColumn(
        "aside", F.when(l2 > 0, aside).otherwise(F.sqrt(ox * ox + oy * oy))
    )
    on_segment = F.coalesce((F.col("along") >= 0) & (F.col("along") <= 1), F.lit(True))
    return measured.filter(on_segment & (F.col("aside") <= h)).select(*keep, "y", "x", "along", "aside")
