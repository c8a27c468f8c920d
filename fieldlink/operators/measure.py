"""Measurement of groups: support region, size, moments, scores, quality and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlink.config import MIDDLE_SIGMA, WEAK_SIGMA, Config
from fieldlink.functions import geometry as g
from fieldlink.lineage import cut
from fieldlink.operators.cluster import GROUP, inner_edges
from fieldlink.operators.farthest import largest_distance
from fieldlink.operators.ranking import running_total

FLAGS = ("large_mask_swallow", "negative_bowl", "only_2sigma", "sidelobe_risk", "too_far")
LAS_SAMPLES = 1000  # fixed value: pixels of a region looked at for its size


# ---- support regions --------------------------------------------------------

def supports(members: DataFrame) -> DataFrame:
    """Regions a group rests on: (group, threshold, set_id, label) of its 2.5 sigma regions, else 2 sigma.

    Groups that rest on one region share its ``set_id``, so a region touched by
    many groups is measured once.
    """
    touched = (
        members.select(
            *GROUP,
            F.explode(F.array(
                F.struct(F.lit(MIDDLE_SIGMA).alias("t"), F.col("label_at_2p5sigma").alias("l"), F.col("area_at_2p5sigma").alias("a")),
                F.struct(F.lit(WEAK_SIGMA).alias("t"), F.col("label_at_2sigma").alias("l"), F.col("area_at_2sigma").alias("a")),
            )).alias("_s"),
        )
        .select(*GROUP, F.col("_s.t").alias("threshold"), F.col("_s.l").alias("label"), F.col("_s.a").alias("area"))
        .filter("label > 0").distinct()
    )
    per_level = touched.groupBy(*GROUP).agg(
        F.max("threshold").alias("_best"),
        F.sum(F.when(F.col("threshold") == MIDDLE_SIGMA, F.col("area"))).alias("support_pixels_2p5sigma"),
        F.sum(F.when(F.col("threshold") == WEAK_SIGMA, F.col("area"))).alias("support_pixels_2sigma"),
        F.count_if(F.col("threshold") == MIDDLE_SIGMA).alias("_n25"), F.count_if(F.col("threshold") == WEAK_SIGMA).alias("_n2"),
    )
    chosen = touched.join(per_level, GROUP).filter("threshold = _best")
    alone = F.when(F.col("threshold") == MIDDLE_SIGMA, F.col("_n25")).otherwise(F.col("_n2")) == 1
    return chosen.select(
        *GROUP, "threshold", "label", "support_pixels_2p5sigma", "support_pixels_2sigma",
        F.when(alone, F.concat_ws(":", F.lit("r"), "threshold", "label")).otherwise(F.concat_ws(":", F.lit("g"), "gid")).alias("set_id"),
    )


def region_sets(chosen: DataFrame, labels: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels of each distinct support set with their image value."""
    sets = chosen.select("field_id", "set_id", "threshold", "label").distinct()
    return sets.join(labels.drop("area"), ["field_id", "threshold", "label"]).join(pixels, ["field_id", "y", "x"]).select(
        "field_id", "set_id", "y", "x", g.finite(F.col("value")).alias("value")
    )


MOMENTS = ("0", "x", "y", "xx", "xy", "yy")


def weighted_sums(x: Column, y: Column, w: Column, tag: str) -> list[Column]:
    return [F.sum(e).alias(f"{tag}{n}") for n, e in
            {"0": w, "x": w * x, "y": w * y, "xx": w * x * x, "xy": w * x * y, "yy": w * y * y}.items()]


def covariance_of(tag: str) -> list[Column]:
    s = {n: F.col(f"{tag}{n}") / F.col(f"{tag}0") for n in ("x", "y", "xx", "xy", "yy")}
    return [s["xx"] - s["x"] * s["x"], s["xy"] - s["x"] * s["y"], s["yy"] - s["y"] * s["y"]]


def region_moments(mask: DataFrame) -> DataFrame:
    """Area, box, flux and intensity-weighted second moments per support set, in one pass.

    Weights are the value above the faintest pixel of the set, so their sums
    follow from the sums over value and over position.  Without any contrast
    every pixel counts the same.
    """
    key = ["field_id", "set_id"]
    x, y, v = F.col("x").cast("double"), F.col("y").cast("double"), F.col("value")
    seen = F.when(v.isNotNull(), 1.0).otherwise(0.0)
    sums = mask.groupBy(*key).agg(
        F.count("*").alias("mask_n"), F.min("x").alias("mx0"), F.min("y").alias("my0"), F.max("x").alias("mx1"), F.max("y").alias("my1"),
        F.min("value").alias("_low"), F.sum("value").alias("mask_sum"), F.max("value").alias("mask_peak"),
        *weighted_sums(x, y, F.coalesce(v, F.lit(0.0)), "_v"), *weighted_sums(x, y, seen, "_s"), *weighted_sums(x, y, F.lit(1.0), "_u"),
    )
    low = F.coalesce("_low", F.lit(0.0))
    weighed = sums.select("*", *[(F.col(f"_v{n}") - low * F.col(f"_s{n}")).alias(f"_w{n}") for n in MOMENTS])
    flat = F.col("mask_peak").isNull() | (F.col("mask_peak") <= F.col("_low"))
    parts = [F.when(flat, u).otherwise(w) for u, w in zip(covariance_of("_u"), covariance_of("_w"))]
    keep = [*key, "mask_n", "mx0", "my0", "mx1", "my1", "mask_sum", "mask_peak"]
    return weighed.select(*keep, *[p.alias(n) for p, n in zip(parts, ("k00", "k01", "k11"))])


def region_las(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """Largest pixel distance per set, on at most 1000 pixels taken evenly in raster order."""
    key = ["field_id", "set_id"]
    spots = mask.select(*key, "y", "x").join(sizes.select(*key, F.col("mask_n").alias("_n")), key)
    small = spots.filter(F.col("_n") <= LAS_SAMPLES).select(*key, "y", "x")
    ranked = running_total(spots.filter(F.col("_n") > LAS_SAMPLES), key, [F.col("y")], [F.col("y"), F.col("x")], "_r")
    step = (F.col("_n") - 1) / F.lit(float(LAS_SAMPLES - 1))
    near = F.ceil(F.col("_r") / step)
    hit = F.lit(False)
    for d in (-1, 0, 1):
        i = near + d
        hit = hit | ((i >= 0) & (i < LAS_SAMPLES - 1) & (F.floor(i * step) == F.col("_r")))
    sampled = ranked.filter(hit | (F.col("_r") == F.col("_n") - 1)).select(*key, "y", "x")
    # Only the two ends of an image row can belong to the farthest pair; at most
    # 1000 rows are left per set, so its ends fit one array.
    ends = small.unionByName(sampled).groupBy(*key, "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    rows = ends.groupBy(*key).agg(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))).alias("_rows"))

    def reach(p, q):
        across = F.greatest(q["b"] - p["a"], p["b"] - q["a"])
        return F.pow(across, 2) + F.pow(p["y"] - q["y"], 2)

    per_row = F.transform("_rows", lambda p: F.array_max(F.transform("_rows", lambda q: reach(p, q))))
    return rows.select(*key, F.sqrt(F.array_max(per_row)).alias("mask_las_pix"))


def region_las_exact(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """Largest pixel distance of sets above 1000 pixels, over all of them; smaller sets have theirs from :func:`region_las`."""
    key = ["field_id", "set_id"]
    spots = mask.join(sizes.filter(F.col("mask_n") > LAS_SAMPLES).select(*key), key, "left_semi")
    # Only the two ends of an image row can belong to the farthest pair.
    ends = spots.groupBy(*key, "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    points = ends.select(*key, F.explode(F.array(F.col("a").cast("double"), F.col("b").cast("double"))).alias("px"), F.col("y").cast("double").alias("py"))
    return largest_distance(points, key, "mask_las_exact_pix")


# ---- members and edges ------------------------------------------------------

def member_sums(members: DataFrame) -> DataFrame:
    """Everything a group needs from its members, in one aggregation."""
    flux = g.finite(F.col("peak_flux"))
    w = F.when(flux > 0, flux).otherwise(1.0)
    x, y = F.col("x"), F.col("y")
    k = F.col("morphology_class")
    return members.groupBy(*GROUP).agg(
        F.count("*").alias("n_gaussians"), F.min("pixel_scale").alias("pixel_scale"),
        F.min("x").alias("lo_x"), F.min("y").alias("lo_y"), F.max("x").alias("hi_x"), F.max("y").alias("hi_y"),
        (F.sum(w * x) / F.sum(w)).alias("centroid_x"), (F.sum(w * y) / F.sum(w)).alias("centroid_y"),
        *weighted_sums(x, y, F.lit(1.0), "_p"),
        F.coalesce(F.sum(g.finite(F.col("total_flux"))), F.lit(0.0)).alias("total_flux_gaussian"),
        F.max(flux).alias("peak_flux"), F.coalesce(F.max("resolved_probability"), F.lit(0.0)).alias("resolved_probability"),
        F.coalesce(F.max("beam_like_score"), F.lit(0.0)).alias("beam_like_score"),
        F.min(k).alias("_k"), F.min("classification_reason").alias("_why"), F.bool_and(k == "unresolved").alias("_all_unresolved"),
    )


def edge_sums(inner: DataFrame) -> DataFrame:
    s = F.col("association_score")
    flag = lambda f: F.bool_or(F.array_contains(F.split("artifact_risk_flags", ","), f)).alias(f"_f_{f}")
    return inner.groupBy(*GROUP).agg(
        F.count("*").alias("n_edges"), F.avg(s).alias("association_score_mean"), F.min(s).alias("association_score_min"),
        F.max(s).alias("association_score_max"), F.count_if(F.col("edge_type") == "strong").alias("n_strong_edges"),
        F.count_if(F.col("edge_type") == "weak").alias("n_weak_edges"), F.count_if("only_2sigma_connected").alias("n_only_2sigma_edges"),
        F.bool_or(F.col("connected_at_3sigma") | F.col("connected_at_2p5sigma")).alias("_contour"),
        F.max("bridge_score").alias("_bridge"), F.max("ridge_continuity_score").alias("_ridge"),
        F.avg("ridge_gap_fraction").alias("_edge_gap"),
        *[flag(f) for f in FLAGS],
    )


# ---- rules ------------------------------------------------------------------

def _has(flag: str) -> Column:
    return F.col(f"_f_{flag}")


def with_quality(groups: DataFrame, cfg: Config) -> DataFrame:
    """Flag text and quality label."""
    a, layer1, f = cfg.association, F.lit(cfg.features.artifact_layer1), cfg.features
    n, only = F.col("n_edges"), F.col("n_only_2sigma_edges")
    share = lambda part: F.greatest(F.lit(1), F.floor(part * n).cast("long"))
    flagged = groups.withColumn("_f_only_2sigma", F.col("_f_only_2sigma") | (only > share(0.5)))
    severe = _has("negative_bowl") | _has("sidelobe_risk") | _has("large_mask_swallow")
    shaky = _has("only_2sigma") | (only > share(0.4)) | (F.col("association_score_max") - F.col("association_score_min") > 2.5)
    backed = (F.lit(f.contours) & F.col("_contour")) | (F.col("_bridge") >= 0.55) | (F.lit(f.ridge) & (F.col("_ridge") >= 0.55))
    mean = F.col("association_score_mean")
    quality = (
        F.when(layer1 & severe, "artifact_risk").when(n == 0, "low").when(layer1 & shaky, "suspicious")
        .when((mean >= a.quality_high) & (F.col("n_strong_edges") >= share(0.6)) & backed, "high")
        .when((mean >= a.quality_medium) & backed, "medium").otherwise("low")
    )
    if "force_suspicious" in groups.columns:
        quality = F.when(F.col("force_suspicious") & ~(layer1 & severe), "suspicious").otherwise(quality)
    return flagged.select(
        "*", F.concat_ws(",", *[F.when(_has(x), x) for x in FLAGS]).alias("artifact_risk_flags"), quality.alias("association_quality")
    )


def with_type(groups: DataFrame, cfg: Config) -> DataFrame:
    t, f = cfg.types, cfg.features
    las, quality = F.col("LAS_beam"), F.col("association_quality")
    risky = F.lit(t.artifact_type and f.artifact_layer1) & (_has("negative_bowl") | _has("sidelobe_risk") | _has("large_mask_swallow"))
    joined = (F.lit(f.contours) & F.col("_contour")) | (F.col("_bridge") >= 0.45) | (F.lit(f.ridge) & (F.col("_ridge") >= 0.45))
    order = {"artifact_risk": 0, "suspicious": 1, "low": 1, "medium": 2, "high": 3}
    at_most = [q for q, v in order.items() if v <= order.get(t.weak_max_quality, 1)]
    kind = (
        F.when(risky, "artifact_risk").when(F.col("n_gaussians") >= t.complex_min_components, "complex_association")
        .when(F.col("n_gaussians") <= 1, "weak_association").when(las <= t.compact_max_las, "compact_multi_gaussian")
        .when(F.col("axis_ratio") >= t.linear_min_axis_ratio, "linear_or_tail_like")
        .when((las >= t.diffuse_min_las) & quality.isin("low", "suspicious"), "diffuse_extended")
        .when(joined & (las >= t.continuous_min_las), "continuous_extended")
        .when(quality.isin(*at_most), "weak_association").otherwise("continuous_extended")
    )
    typed = groups.withColumn("association_type", kind)
    kind = F.col("association_type")
    risk = (kind == "artifact_risk") | (quality == "artifact_risk")
    spread = (F.col("n_gaussians") >= 2) & (
        kind.isin("continuous_extended", "diffuse_extended", "linear_or_tail_like", "complex_association")
        | (F.col("n_strong_edges") > 0) | (las >= 3.0)
    )
    single = F.col("n_gaussians") == 1
    return typed.select(
        "*",
        F.when(single, F.coalesce("_k", F.lit("unknown"))).when(risk, "artifact_like").when(spread, "multi_gaussian_extended")
        .when(F.col("_all_unresolved"), "unresolved").otherwise("unknown").alias("morphology_class"),
        F.when(single, F.coalesce("_why", F.lit(""))).when(risk, "artifact_risk_group").when(spread, "multi_gaussian_extended")
        .when(F.col("_all_unresolved"), "all_components_unresolved").otherwise("mixed_or_low_support_group").alias("classification_reason"),
    )


# ---- assembly ---------------------------------------------------------------

def _box_or_points(pad: Column) -> Column:
    from_mask = g.box(*[F.col(c).cast("double") for c in ("mx0", "my0", "mx1", "my1")])
    padded = g.box(
        F.greatest(F.lit(0.0), F.floor(F.col("lo_x") - pad).cast("double")), F.greatest(F.lit(0.0), F.floor(F.col("lo_y") - pad).cast("double")),
        F.least((F.col("width") - 1).cast("double"), F.ceil(F.col("hi_x") + pad).cast("double")),
        F.least((F.col("height") - 1).cast("double"), F.ceil(F.col("hi_y") + pad).cast("double")),
    )
    return F.coalesce(from_mask, padded)


def shape_groups(members: DataFrame, labels: DataFrame, pixels: DataFrame, fields: DataFrame, cfg: Config, pad_arcsec: float | None = None) -> DataFrame:
    """Box, centroid, size and moments per group."""
    chosen = cut(supports(members))
    mask = cut(region_sets(chosen, labels, pixels))
    moments = cut(region_moments(mask))
    per_set = moments.join(region_las(mask, moments), ["field_id", "set_id"]).join(region_las_exact(mask, moments), ["field_id", "set_id"], "left")
    per_set = per_set.withColumn("mask_las_exact_pix", F.coalesce("mask_las_exact_pix", "mask_las_pix"))
    group_set = chosen.select(*GROUP, "set_id", "support_pixels_2p5sigma", "support_pixels_2sigma").distinct()
    far = largest_distance(members.select(*GROUP, F.col("x").alias("px"), F.col("y").alias("py")), GROUP, "point_las_pix")
    frame = (
        member_sums(members).join(far, GROUP).join(group_set, GROUP, "left").join(per_set, ["field_id", "set_id"], "left")
        .join(fields.drop("pixel_scale", "rms", "mean"), "field_id")
    )
    # One row per group from here on: write it, so the rules below plan and run on a plain scan.
    frame = cut(frame)
    scale = F.col("pixel_scale")
    pad = F.rint((2.5 * cfg.beam.size_arcsec if pad_arcsec is None else pad_arcsec) / scale)
    by_mask, by_points = F.col("mask_n") >= 3, F.col("n_gaussians") >= 2
    point_k = covariance_of("_p")
    cov = [F.when(by_mask, F.col(c)).otherwise(F.when(by_points, p)) for c, p in zip(("k00", "k01", "k11"), point_k)]
    sized = frame.select(
        *[c for c in frame.columns if not c.startswith("_p") and c not in ("k00", "k01", "k11")],
        _box_or_points(F.greatest(F.lit(5.0), pad)).alias("box"),
        F.greatest("point_las_pix", F.when(F.col("mask_n") > 1, F.col("mask_las_pix")).otherwise(0.0)).alias("LAS_pixel"),
        F.greatest("point_las_pix", F.when(F.col("mask_n") > 1, F.col("mask_las_exact_pix")).otherwise(0.0)).alias("LAS_exact_pixel"),
        *[c.alias(n) for c, n in zip(cov, ("_c00", "_c01", "_c11"))],
        *[F.coalesce(c, F.lit(0)).alias(f"{c}_") for c in ("support_pixels_2p5sigma", "support_pixels_2sigma")],
    ).drop("support_pixels_2p5sigma", "support_pixels_2sigma").withColumnsRenamed(
        {"support_pixels_2p5sigma_": "support_pixels_2p5sigma", "support_pixels_2sigma_": "support_pixels_2sigma"}
    )
    big, small, turn = g.principal_axes(F.col("_c00"), F.col("_c01"), F.col("_c11"))
    turned = sized.select("*", big.alias("_big"), small.alias("_small"), F.when(F.col("_c00").isNotNull(), turn).alias("group_PA"))
    root = lambda c: F.when(F.col(c).isNotNull(), F.sqrt(F.greatest(F.col(c), F.lit(0.0))))
    measured = turned.select(
        *[c for c in turned.columns if c not in ("_big", "_small", "_c00", "_c01", "_c11")],
        root("_big").alias("moment_major"), root("_small").alias("moment_minor"),
        (F.col("LAS_pixel") * scale).alias("LAS_arcsec"), (F.col("LAS_exact_pixel") * scale).alias("LAS_exact_arcsec"),
    ).withColumn("LAS_beam", F.col("LAS_arcsec") / cfg.beam.size_arcsec).withColumn(
        "axis_ratio",
        F.when(F.col("moment_major") > 0, F.col("moment_major") / F.greatest("moment_minor", F.lit(1e-6))).otherwise(1.0),
    )
    if "ra0" not in fields.columns:
        return measured.select("*", F.lit(None).cast("double").alias("ra"), F.lit(None).cast("double").alias("dec"))
    ra, dec = g.pixel_to_sky(*[F.col(c) for c in ("centroid_x", "centroid_y", "ra0", "dec0", "px0", "py0", "step_x", "step_y")])
    return measured.select("*", ra.alias("ra"), dec.alias("dec"))


def measure_groups(
    members: DataFrame, edges: DataFrame, labels: DataFrame, pixels: DataFrame, fields: DataFrame, cfg: Config,
    marks: DataFrame | None = None, shaped: DataFrame | None = None,
) -> DataFrame:
    """Group table from members (components with gid) and decided edges.

    ``marks`` may force groups to be suspicious: (field_id, gid, force_suspicious).
    """
    shaped = shape_groups(members, labels, pixels, fields, cfg) if shaped is None else shaped
    inner = inner_edges(edges, members.select("field_id", "component_index", "gid"))
    frame = cut(shaped.join(edge_sums(inner), GROUP, "left"))
    zero = [c for c in ("n_edges", "n_strong_edges", "n_weak_edges", "n_only_2sigma_edges")]
    score = ["association_score_mean", "association_score_min", "association_score_max", "_bridge", "_ridge"]
    flags = ["_contour", *[f"_f_{f}" for f in FLAGS]]
    filled = frame.select(*[
        F.coalesce(c, F.lit(0)).alias(c) if c in zero else F.coalesce(c, F.lit(0.0)).alias(c) if c in score
        else F.coalesce(c, F.lit(False)).alias(c) if c in flags else F.col(c) for c in frame.columns
    ])
    if marks is not None:
        filled = filled.join(marks, GROUP, "left").withColumn("force_suspicious", F.coalesce("force_suspicious", F.lit(False)))
    return with_type(with_quality(filled, cfg), cfg)


def publish_groups(groups: DataFrame) -> DataFrame:
    """Public columns of the group table, boxes as text."""
    return groups.select(
        "field_id", "association_group_id", F.col("group_index").alias("association_group_index"), "gid", "n_gaussians", "ra", "dec",
        "centroid_x", "centroid_y", g.format_box(F.col("box")).alias("bounding_box"), "LAS_arcsec", "LAS_exact_arcsec", "LAS_beam", "total_flux_gaussian",
        "peak_flux", "group_PA", "axis_ratio", "association_score_mean", "association_score_min", "association_score_max",
        "n_strong_edges", "n_weak_edges", "n_only_2sigma_edges", "association_quality", "association_type", "morphology_class",
        "resolved_probability", "beam_like_score", "classification_reason", "artifact_risk_flags",
        F.to_json(F.struct("box", "support_pixels_2p5sigma", "support_pixels_2sigma")).alias("debug_info"),
    )


def with_member_lists(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Add the comma lists of component indices and ids for export.

    The membership table is the primary output; this text form holds a whole
    group in one value and is only meant for the published catalogue.
    """
    lists = members.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("component_index", F.col("component_id").cast("string").alias("c")))).alias("_m"))
    return groups.join(lists, GROUP).select(
        *groups.columns, F.concat_ws(",", F.transform("_m", lambda m: m["component_index"].cast("string"))).alias("component_ids"),
        F.concat_ws(",", F.transform("_m", lambda m: m["c"])).alias("gaussian_ids"),
    )


def component_group_columns(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Group attributes written back to every component, with the usual defaults."""
    attached = members.join(
        groups.select(*GROUP, "association_group_id", "group_index", F.col("n_gaussians").alias("association_group_size"),
                      "association_quality", "association_type"), GROUP, "left",
    )
    default = {"association_group_id": F.lit(""), "group_index": F.lit(-1), "association_group_size": F.lit(1),
               "association_quality": F.lit("low"), "association_type": F.lit("weak_association")}
    return attached.select(*[F.coalesce(c, default[c]).alias(c) if c in default else F.col(c) for c in attached.columns])
