"""Rasters: background, S/N, masks, labels, reads at points and along lines."""

from pyspark.sql import functions as F

from fieldlink import fixtures as fx
from fieldlink.config import Segmentation
from fieldlink.lineage import cut
from fieldlink.operators import paths, raster
from fieldlink.queries.base import cte, query, r, rounded
from fieldlink.sources import segmentation as stored_segmentation

SEG = fx.SMALL.segmentation


def snr(spark, sf):
    return raster.snr_map(fx.pixels(spark, sf), fx.fields(spark, sf), SEG)


def labels(spark, sf):
    return raster.segment(cut(snr(spark, sf)), fx.fields(spark, sf), SEG)


_W = ", ".join(f"({k}, CAST({w!r} AS DOUBLE))" for k, w in
               [(s * k, w) for k, w in enumerate(raster.gaussian_weights(1.0)) for s in ((1, -1) if k else (1,))])
cte("taps", f"SELECT * FROM (VALUES {_W}) t(k, w)")
cte("smooth_y", """
SELECT o.field_id, o.y, o.x, sum(t.w * s.value) AS v FROM pixels o CROSS JOIN taps t
JOIN pixels s ON s.field_id = o.field_id AND s.x = o.x
 AND s.y = CASE WHEN o.y + t.k < 0 THEN -(o.y + t.k) - 1 WHEN o.y + t.k > 29 THEN 59 - (o.y + t.k) ELSE o.y + t.k END
GROUP BY 1, 2, 3""", "pixels", "taps")
cte("smooth_xy", """
SELECT o.field_id, o.y, o.x, sum(t.w * s.v) AS v FROM smooth_y o CROSS JOIN taps t
JOIN smooth_y s ON s.field_id = o.field_id AND s.y = o.y
 AND s.x = CASE WHEN o.x + t.k < 0 THEN -(o.x + t.k) - 1 WHEN o.x + t.k > 31 THEN 63 - (o.x + t.k) ELSE o.x + t.k END
GROUP BY 1, 2, 3""", "smooth_y", "taps")
cte("snr", """
SELECT field_id, y, x, CAST(CAST((v - m)/CAST(0.3 AS DOUBLE) AS FLOAT) AS DOUBLE) AS snr
FROM smooth_xy JOIN (SELECT field_id, CAST(median(value) AS DOUBLE) AS m FROM pixels GROUP BY 1) USING (field_id)""", "smooth_xy", "pixels")
cte("steps3", "SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) t(dy, dx)")
cte("thresholds", "SELECT CAST(unnest([5.0, 4.0, 3.0, 2.5, 2.0]) AS DOUBLE) AS threshold")
cte("mask0", "SELECT field_id, threshold, y, x FROM snr, thresholds WHERE snr > threshold", "snr", "thresholds")
cte("dilated", """SELECT DISTINCT field_id, threshold, y + dy AS y, x + dx AS x FROM mask0, steps3
WHERE y + dy BETWEEN 0 AND 29 AND x + dx BETWEEN 0 AND 31""", "mask0", "steps3")
cte("mask", """SELECT field_id, threshold, y + dy AS y, x + dx AS x FROM dilated, steps3
GROUP BY 1, 2, 3, 4 HAVING count(*) = 9""", "dilated", "steps3")
cte("flood", """
SELECT field_id, threshold, y, x, y*32 + x + 1 AS label FROM mask
UNION
SELECT m.field_id, m.threshold, m.y, m.x, f.label FROM flood f JOIN steps3 s ON true
JOIN mask m ON m.field_id = f.field_id AND m.threshold = f.threshold AND m.y = f.y + s.dy AND m.x = f.x + s.dx
WHERE f.label < m.y*32 + m.x + 1""", "mask", "steps3")
cte("raw_labels", "SELECT field_id, threshold, y, x, CAST(min(label) AS BIGINT) AS label FROM flood GROUP BY 1, 2, 3, 4", "flood")
cte("areas", "SELECT field_id, threshold, label, count(*) AS area FROM raw_labels GROUP BY 1, 2, 3", "raw_labels")
cte("labels", "SELECT * FROM raw_labels JOIN areas USING (field_id, threshold, label) WHERE area >= 3", "raw_labels", "areas")


@query("background_noise", f"""
WITH m AS (SELECT field_id, CAST(median(value) AS DOUBLE) AS med, stddev_pop(value) AS sd FROM pixels GROUP BY 1)
SELECT field_id, {r('med', 'mean_value')},
       {r('coalesce(nullif(1.4826*(SELECT median(abs(p.value - m.med)) FROM pixels p WHERE p.field_id = m.field_id), 0), sd)', 'rms_value')},
       {r('med', 'fill_value')} FROM m""".replace("WITH m AS", "SELECT * FROM (WITH m AS", 1) + ")", ("pixels",))
def background_noise(spark, sf):
    without = fx.fields(spark, sf).drop("rms", "mean")
    return rounded(raster.background(fx.pixels(spark, sf), without, SEG))


@query("background_mean_std", f"""
SELECT field_id, {r('avg(value)', 'mean_value')}, {r('stddev_pop(value)', 'rms_value')}, {r('median(value)', 'fill_value')}
FROM pixels GROUP BY 1""", ("pixels",))
def background_mean_std(spark, sf):
    without = fx.fields(spark, sf).drop("rms", "mean")
    seg = Segmentation(mean_mode="mean", rms_mode="std")
    return rounded(raster.background(fx.pixels(spark, sf), without, seg))


@query("gaussian_smooth", f"SELECT field_id, y, x, {r('v', 'v')} FROM smooth_xy", ("smooth_xy",))
def gaussian_smooth(spark, sf):
    sized = fx.pixels(spark, sf).withColumnRenamed("value", "v").withColumn("width", F.lit(32)).withColumn("height", F.lit(30))
    return rounded(raster.smooth(sized, 1.0).select("field_id", "y", "x", "v"))


@query("snr_map", f"SELECT field_id, y, x, {r('snr', 'snr', 4)} FROM snr", ("snr",))
def snr_query(spark, sf):
    return rounded(snr(spark, sf), 4)


@query("binary_closing", "SELECT * FROM mask", ("mask",))
def binary_closing(spark, sf):
    mask = raster.threshold_masks(snr(spark, sf), SEG.thresholds)
    return raster.close_mask(mask, fx.fields(spark, sf), 2)


@query("binary_opening", """
SELECT DISTINCT field_id, threshold, y + dy AS y, x + dx AS x FROM (
 SELECT field_id, threshold, y + dy AS y, x + dx AS x FROM mask0, steps3 WHERE abs(dx) + abs(dy) <= 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 5)
, steps3 WHERE abs(dx) + abs(dy) <= 1 AND y + dy BETWEEN 0 AND 29 AND x + dx BETWEEN 0 AND 31""", ("mask0", "steps3"))
def binary_opening(spark, sf):
    mask = raster.threshold_masks(snr(spark, sf), SEG.thresholds)
    return raster.open_mask(mask, fx.fields(spark, sf), 1)


@query("region_labels", "SELECT field_id, threshold, y, x, label, area FROM labels", ("labels",))
def region_labels(spark, sf):
    return labels(spark, sf)[0]


@query("segmentation_diagnostics", f"""
SELECT f.field_id, t.threshold, count(area) FILTER (area >= 3) AS n_labels, coalesce(max(area), 0) * CAST(coalesce(max(area), 0) >= 3 AS INT) AS largest_label_area,
       CAST(coalesce(sum(area) FILTER (area >= 3), 0) AS BIGINT) AS total_mask_area, count(area) FILTER (area < 3) AS n_small_objects_removed,
       {r('coalesce(sum(area) FILTER (area >= 3), 0)/960.0', 'mask_fraction')},
       concat_ws(';', CASE WHEN coalesce(sum(area) FILTER (area >= 3), 0)/960.0 > 0.1 THEN 'mask_fraction_gt_0.1' END,
                      CASE WHEN coalesce(max(area), 0)/960.0 > 0.05 THEN 'largest_label_gt_0.05' END) AS warning
FROM fields f CROSS JOIN thresholds t LEFT JOIN areas a ON a.field_id = f.field_id AND a.threshold = t.threshold
GROUP BY 1, 2""", ("fields", "thresholds", "areas"))
def segmentation_diagnostics(spark, sf):
    found, removed = labels(spark, sf)
    return rounded(raster.segmentation_diagnostics(found, removed, fx.fields(spark, sf), SEG))


cte("placed", f"""
SELECT c.*, s.snr AS snr_at, """ + ", ".join(
    f"coalesce(max(l.{c}) FILTER (l.threshold = {t}), 0) AS {c}_at_{raster.sigma_name(t)}"
    for t in (5.0, 4.0, 3.0, 2.5, 2.0) for c in ("label", "area")) + """
FROM pixel_shapes c LEFT JOIN snr s ON s.field_id = c.field_id AND s.y = round_even(c.y, 0) AND s.x = round_even(c.x, 0)
LEFT JOIN labels l ON l.field_id = c.field_id AND l.y = round_even(c.y, 0) AND l.x = round_even(c.x, 0)
GROUP BY ALL""", "pixel_shapes", "snr", "labels")


@query("labels_at_components", "SELECT field_id, component_index, " + ", ".join(
    f"{c}_at_{raster.sigma_name(t)}" for t in (5.0, 4.0, 3.0, 2.5, 2.0) for c in ("label", "area")) + f", {r('snr_at', 'snr_at', 4)} FROM placed", ("placed",))
def labels_at_components(spark, sf):
    s = cut(snr(spark, sf))
    found, _ = raster.segment(s, fx.fields(spark, sf), SEG)
    read = raster.at_points(fx.pixel_components(spark, sf).select("field_id", "component_index", "x", "y"), s, found, SEG, "component_index")
    return rounded(read.drop("x", "y"), 4)


cte("small_pairs", """
SELECT a.field_id, a.component_index AS i, b.component_index AS j, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2,
       sqrt(pow(b.x-a.x,2) + pow(b.y-a.y,2)) AS len
FROM pixel_components a JOIN pixel_components b ON a.field_id = b.field_id AND a.component_index < b.component_index
WHERE sqrt(pow(b.x-a.x,2) + pow(b.y-a.y,2)) <= 30""", "pixel_components")
cte("line_spots", """
SELECT *, CASE WHEN k = n - 1 THEN x2 ELSE x1 + k*((x2-x1)/(n-1)) END AS sx, CASE WHEN k = n - 1 THEN y2 ELSE y1 + k*((y2-y1)/(n-1)) END AS sy
FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, greatest(3, CAST(ceil(len) AS INT) + 1) AS n FROM small_pairs))""", "small_pairs")
cte("line_snr", """
SELECT l.field_id, l.i, l.j, l.k, s.snr FROM line_spots l
JOIN snr s ON s.field_id = l.field_id AND s.y = round_even(l.sy, 0) AND s.x = round_even(l.sx, 0)""", "line_spots", "snr")
cte("corridor", """
SELECT p.*, g.y, g.x, g.snr,
 CASE WHEN len > 0 THEN ((g.x-x1)*(x2-x1) + (g.y-y1)*(y2-y1))/(len*len) END AS along,
 CASE WHEN len > 0 THEN abs((g.x-x1)*(y2-y1) - (g.y-y1)*(x2-x1))/len ELSE sqrt(pow(g.x-x1,2)+pow(g.y-y1,2)) END AS aside
FROM small_pairs p JOIN snr g ON g.field_id = p.field_id AND g.y BETWEEN least(y1,y2) - 1 AND greatest(y1,y2) + 1
 AND g.x BETWEEN least(x1,x2) - 1 AND greatest(x1,x2) + 1
WHERE CASE WHEN len > 0 THEN abs((g.x-x1)*(y2-y1) - (g.y-y1)*(x2-x1))/len ELSE sqrt(pow(g.x-x1,2)+pow(g.y-y1,2)) END <= 1
 AND coalesce(((g.x-x1)*(x2-x1) + (g.y-y1)*(y2-y1)) BETWEEN 0 AND len*len, true)""", "small_pairs", "snr")


def small_pairs(spark, sf, carry=()):
    from fieldlink.operators.pairs import candidate_pairs

    return candidate_pairs(fx.pixel_components(spark, sf), fx.SMALL)


@query("line_profile", f"""
SELECT field_id, i AS component_index_1, j AS component_index_2, count(*) AS n, {r('avg(snr)', 'mean_snr', 4)}, {r('min(snr)', 'min_snr', 4)}, {r('max(snr)', 'max_snr', 4)}
FROM line_snr GROUP BY 1, 2, 3""", ("line_snr",))
def line_profile(spark, sf):
    key = ["field_id", "component_index_1", "component_index_2"]
    lines = raster.line_values(small_pairs(spark, sf), snr(spark, sf), key)
    total = F.aggregate("line", F.lit(0.0), lambda a, v: a + v)
    return rounded(lines.select(
        *key, F.size("line").cast("long").alias("n"), (total / F.size("line")).alias("mean_snr"),
        F.array_min("line").alias("min_snr"), F.array_max("line").alias("max_snr"),
    ), 4)


@query("corridor_profile", f"""
SELECT field_id, i AS component_index_1, j AS component_index_2, count(*) AS n, {r('avg(snr)', 'mean_snr', 4)}, {r('max(snr)', 'max_snr', 4)},
 count(*) FILTER (snr >= 2) AS n_weak FROM corridor GROUP BY 1, 2, 3""", ("corridor",))
def corridor_profile(spark, sf):
    key = ["field_id", "component_index_1", "component_index_2"]
    comps = fx.pixel_components(spark, sf)
    pairs = small_pairs(spark, sf).select(*key, "x_1", "y_1", "x_2", "y_2", "pixel_scale").withColumn("height", F.lit(30)).withColumn("width", F.lit(32))
    none, one = F.lit(0.0), F.lit(1.0)
    frame = lambda placed: placed.withColumns({"_amp_1": none, "_amp_2": none, "_half_bridge": one, "_half_residual": none, "_exclude": none, "_x0": none, "_y0": none})
    found = paths.with_samples(pairs, snr(spark, sf), comps.select("field_id", "x", "y", "pixel_scale"), fx.SMALL, frame)
    return rounded(found.filter("nb > 0").select(*key, F.col("nb").alias("n"), F.col("b_mean").alias("mean_snr"), F.col("b_max").alias("max_snr"), F.col("nbw").alias("n_weak")), 4)


def stored_with_faults(spark, sf):
    """Stored tables with one kind of fault per field, by its name."""
    fields = fx.fields(spark, sf)
    s = cut(snr(spark, sf))
    found, removed = raster.segment(s, fields, SEG)
    made = stored_segmentation.collected(s, found, removed, fields, SEG)
    kind = F.pmod(F.ascii("field_id") + F.length("field_id"), F.lit(4))
    lost = made.snr.filter(~((kind == 0) & (F.col("y") == 0))).withColumn("x", F.when((kind == 1) & (F.col("x") == 31), F.col("x") + 9).otherwise(F.col("x")).cast("int"))
    twice = F.when((kind == 1) & (F.col("threshold") == 5.0), 2).otherwise(1)
    levels = made.thresholds.withColumn("_k", F.explode(F.sequence(F.lit(1), twice))).drop("_k")
    levels = levels.withColumn("n_labels", F.col("n_labels") + F.when((kind == 3) & (F.col("threshold") == 3.0), 1).otherwise(0))
    levels = levels.withColumn("threshold", F.when((kind == 2) & (F.col("threshold") == 2.0), -1.0).otherwise(F.col("threshold")))
    moved = made.labels.withColumn("y", F.when((kind == 3) & (F.col("y") == 29), F.col("y") + 30).otherwise(F.col("y")).cast("int"))
    return stored_segmentation.Stored(lost, moved, levels), fields


cte("field_kinds", "SELECT field_id, (ascii(field_id) + length(field_id)) % 4 AS kind FROM fields", "fields")
cte("region_counts", "SELECT field_id, threshold, count(DISTINCT label) AS n FROM labels GROUP BY 1, 2", "labels")


@query("segmentation_table_issues", """
SELECT field_id, issue, n FROM (
 SELECT field_id, 'snr_pixels_missing' AS issue, CAST(CASE kind WHEN 0 THEN 32 ELSE 30 END AS BIGINT) AS n FROM field_kinds WHERE kind < 2
 UNION ALL SELECT field_id, 'snr_pixels_outside', 30 FROM field_kinds WHERE kind = 1
 UNION ALL SELECT field_id, 'thresholds_repeated', 1 FROM field_kinds WHERE kind = 1
 UNION ALL SELECT field_id, 'thresholds_not_positive', 1 FROM field_kinds WHERE kind = 2
 UNION ALL SELECT field_id, 'labels_without_threshold', count(*) FROM field_kinds JOIN labels USING (field_id) WHERE kind = 2 AND threshold = 2 GROUP BY 1
 UNION ALL SELECT field_id, 'label_counts_differ', 1 FROM field_kinds JOIN region_counts USING (field_id) WHERE kind = 2 AND threshold = 2
 UNION ALL SELECT field_id, 'label_counts_differ', 1 FROM field_kinds WHERE kind = 3
 UNION ALL SELECT field_id, 'label_pixels_outside', count(*) FROM field_kinds JOIN labels USING (field_id) WHERE kind = 3 AND y = 29 GROUP BY 1)""", ("field_kinds", "labels", "region_counts"))
def segmentation_table_issues(spark, sf):
    return stored_segmentation.issues(*stored_with_faults(spark, sf))
