"""Parent links between groups: endpoint classes, pair geometry, host evidence, acceptance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldlink.config import Config
from fieldlink.functions import geometry as g
from fieldlink.functions.text import tags
from fieldlink.lineage import cut
from fieldlink.operators import hosts as host_ops, raster, seeds
from fieldlink.operators.graph import greedy_matching
from fieldlink.operators.grid import ROUNDING, near_join
from fieldlink.operators.ranking import top_k
from fieldlink.operators.seeds import PAIR

GID = ["field_id", "group_index"]
ACCEPTED = "accepted_high_confidence_parent"
NO_ENDPOINT = "endpoint_vetoed_or_not_extended_for_near_boundary_rescue"


# ---- surroundings of a group ------------------------------------------------

def artifact_environment(groups: DataFrame, cfg: Config) -> DataFrame:
    """Distance, alignment and brightness of the nearest bright group, and local crowding."""
    p, beam = cfg.parents, cfg.beam.size_arcsec
    flux = F.coalesce("total_flux_gaussian", "peak_flux", F.lit(0.0))
    spots = groups.select(*GID, "centroid_x", "centroid_y", "pixel_scale", "group_PA", flux.alias("_flux"))
    bright = top_k(spots, ["field_id"], [F.col("_flux").desc(), F.col("group_index")], p.bright_count).select(
        "field_id", F.col("group_index").alias("_bi"), F.col("centroid_x").alias("_bx"), F.col("centroid_y").alias("_by"), F.col("_flux").alias("_bf"), F.col("_rank").alias("_br")
    )
    # Five rows per field on the right side; adaptive execution splits a crowded field.
    dx, dy = F.col("centroid_x") - F.col("_bx"), F.col("centroid_y") - F.col("_by")
    away = F.sqrt(dx * dx + dy * dy) * F.col("pixel_scale") / beam
    seen = spots.join(bright, "field_id").filter(F.col("group_index") != F.col("_bi")).groupBy(*GID).agg(
        F.min(F.struct(
            away.alias("d"), F.col("_br").alias("i"), (F.col("_bf") / F.greatest("_flux", F.lit(1e-6))).alias("ratio"),
            g.alignment(g.half_turn_delta(F.col("group_PA"), g.half_turn(F.degrees(F.atan2(dy, dx))))).alias("radial"),
        )).alias("_near")
    )
    radius = p.fragment_radius_beam * beam
    # Cells in arcsec: fields differ in pixel scale.
    spots = spots.withColumn("_sx", F.col("centroid_x") * F.col("pixel_scale")).withColumn("_sy", F.col("centroid_y") * F.col("pixel_scale"))
    other = spots.select(
        "field_id", F.col("group_index").alias("_oi"), F.col("centroid_x").alias("_ox"), F.col("centroid_y").alias("_oy"),
        F.col("_sx").alias("_osx"), F.col("_sy").alias("_osy"),
    )
    gap2 = F.pow(F.col("centroid_x") - F.col("_ox"), 2) + F.pow(F.col("centroid_y") - F.col("_oy"), 2)
    crowd = near_join(spots, other, ["field_id"], "_sx", "_sy", "_osx", "_osy", radius * ROUNDING).filter(
        (gap2 <= F.pow(radius / F.col("pixel_scale"), 2)) & (F.col("_oi") != F.col("group_index"))
    ).groupBy(*GID).agg(F.count("*").alias("_crowd"))
    joined = groups.join(seen, GID, "left").join(crowd, GID, "left")
    d, ratio, radial = F.col("_near.d"), F.coalesce("_near.ratio", F.lit(0.0)), F.coalesce("_near.radial", F.lit(0.0))
    count = F.coalesce("_crowd", F.lit(0))
    flags = F.lower(F.coalesce("artifact_risk_flags", F.lit("")))
    marked = (
        (F.lower("association_quality") == "artifact_risk") | (F.lower("association_type") == "artifact_risk")
        | flags.rlike("artifact|sidelobe|negative_bowl|bowl|bright residual|bright_residual")
    )
    near_radial = g.yes((d <= p.bright_near_beam) & (ratio >= p.bright_ratio_min) & (radial >= p.bright_radial_min))
    very_close = g.yes((d <= p.very_close_beam) & (ratio >= p.very_bright_ratio))
    crowded = count >= p.fragment_count
    score = (
        F.when(near_radial, p.radial_base + p.radial_bonus * radial).otherwise(0.0) + F.when(very_close, p.very_close_score).otherwise(0.0)
        + F.when(crowded, p.crowded_score).otherwise(0.0) + F.when(marked, p.flag_score).otherwise(0.0)
    )
    reasons = tags([(near_radial, "near_radial_to_bright_source"), (very_close, "very_close_to_bright_source"), (crowded, "crowded_fragment_region"), (marked, "artifact_flag")], ";")
    return joined.select(
        *groups.columns, d.alias("bright_source_distance_beam"), radial.alias("radial_to_bright_source_score"),
        (count / (3.141592653589793 * p.fragment_radius_beam**2)).alias("local_fragment_density"), score.alias("artifact_environment_score"),
        reasons.alias("artifact_veto_reason"), marked.alias("artifact_flagged"),
    )


def evidence_count(cfg: Config) -> Column:
    """Signals of an extended group out of six."""
    e = cfg.parents.endpoints
    return g.count_true(
        F.col("LAS_beam") >= e.extended_las_min, F.col("area_3sigma_beam") >= e.extended_area_min, F.col("major_axis_beam") >= e.extended_major_min,
        F.coalesce("axis_ratio", F.lit(1.0)) >= e.extended_ratio_min, F.col("n_gaussians") >= e.extended_n_min,
        F.lower("association_type").isin("continuous_extended", "diffuse_extended", "linear_or_tail_like", "complex_association", "weak_association"),
    )


def line_support(pairs: DataFrame, snr: DataFrame, cfg: Config) -> DataFrame:
    """Same region at the centroids and S/N shares along 64 samples between them.

    Pairs carry a and b with centroids and label_at_ columns read at the clamped centroid.
    """
    p, on = cfg.parents, cfg.features.contours
    ends = pairs.select(*PAIR, *[F.col(f"{e}.centroid_{c}").alias(f"{c}_{n}") for e, n in (("a", "1"), ("b", "2")) for c in "xy"])
    lines = raster.line_values(ends, snr, PAIR, fixed=64)
    same = lambda n: F.lit(on) & (F.col(f"a.label_at_{n}") > 0) & (F.col(f"a.label_at_{n}") == F.col(f"b.label_at_{n}"))
    share = lambda level: F.coalesce(F.size(F.filter("line", lambda v: v >= level)) / F.size("line"), F.lit(0.0))
    read = pairs.join(lines, PAIR, "left").select(
        *pairs.columns, same("3sigma").alias("same_3sigma_region_as_neighbor"), same("2p5sigma").alias("same_2p5sigma_region_as_neighbor"),
        share(p.bridge_low_snr).alias("_low"), share(p.bridge_high_snr).alias("_high"),
    )
    return read.select(
        *pairs.columns, "same_3sigma_region_as_neighbor", "same_2p5sigma_region_as_neighbor",
        ((F.col("_low") >= p.bridge_low_fraction) | (F.col("_high") >= p.bridge_high_fraction)).alias("bridge_snr_support"),
        g.clip(p.ridge_low_weight * F.col("_low") + p.ridge_high_weight * F.col("_high"), 0.0, 1.0).alias("ridge_continuity_score_pair"),
    )


def neighbour_flags(table: DataFrame, snr: DataFrame, cfg: Config) -> DataFrame:
    """Flags a group receives when a connected neighbour is extended."""
    p = cfg.parents
    near = seeds.near_boxes(table, F.lit(p.neighbour_radius_beam), cfg, p.search_padding, p.neighbour_radius_beam)
    extra = ["label_at_3sigma", "label_at_2p5sigma", "extended_evidence"]
    linked = line_support(seeds.attach_ends(near, table, extra), snr, cfg).filter(
        "same_3sigma_region_as_neighbor or same_2p5sigma_region_as_neighbor or bridge_snr_support"
    )
    flags = ["same_3sigma_region_as_neighbor", "same_2p5sigma_region_as_neighbor", "bridge_snr_support"]
    sides = [
        linked.filter(F.col(f"{other}.extended_evidence") >= 2).select("field_id", F.col(f"group_index_{n}").alias("group_index"), *flags)
        for n, other in (("1", "b"), ("2", "a"))
    ]
    told = sides[0].unionByName(sides[1]).groupBy(*GID).agg(*[F.bool_or(f).alias(f"near_{f}") for f in flags])
    joined = table.join(told, GID, "left")
    return joined.select(*table.columns, *[F.coalesce(f"near_{f}", F.lit(False)).alias(f"near_{f}") for f in flags])


# ---- endpoint classes -------------------------------------------------------

def endpoint_classes(table: DataFrame, cfg: Config) -> DataFrame:
    """Vetoes, lobe tests and the source class of every group."""
    e, p = cfg.parents.endpoints, cfg.parents
    n, las, area, ratio = F.col("n_gaussians"), F.col("LAS_beam"), F.col("area_3sigma_beam"), F.coalesce("axis_ratio", F.lit(1.0))
    major, minor, snr = F.col("major_axis_beam"), F.col("minor_axis_beam"), F.col("peak_snr")
    flags = F.lower(F.coalesce("artifact_risk_flags", F.lit("")))
    linked = F.col("near_same_3sigma_region_as_neighbor") | F.col("near_same_2p5sigma_region_as_neighbor") | F.col("near_bridge_snr_support")
    hard_point = g.yes(
        (n == 1) & (g.yes(major < e.point_major_max) | g.yes(las < e.point_las_max)) & (area < e.point_area_max) & (ratio < e.point_ratio_max)
    ) & ~linked
    hard_compact = (
        g.yes((n <= 2) & (las < e.compact_las_max) & (area < e.compact_area_max) & (major < e.compact_major_max) & (ratio < e.compact_ratio_max))
        | g.yes((n == 1) & (las < e.singleton_las_max) & (area < e.singleton_area_max) & (ratio < e.singleton_ratio_max))
        | g.yes((major < e.observed_major_max) & (minor < e.observed_minor_max) & (area < e.compact_area_max))
    )
    artifact = F.col("artifact_environment_score") >= p.artifact_veto
    noise = tags([
        (snr.isNull(), "peak_snr_missing"), (g.yes(snr < e.noise_snr_min), "peak_snr_below_threshold"), (area.isNull(), "area_3sigma_beam_missing"),
        (g.yes(area < e.noise_area_min), "area_3sigma_beam_below_threshold"), (artifact | F.col("artifact_flagged"), "artifact_risk"),
        ((F.coalesce("n_only_2sigma_edges", F.lit(0)) > 0) & (F.coalesce("n_strong_edges", F.lit(0)) <= 0), "only_2sigma_evidence_dominant"),
        *[(flags.contains(t), t) for t in ("negative_bowl", "sidelobe", "bright residual", "bright_residual")],
    ], ";")
    plain_point = g.yes((n == 1) & (las < e.compact_las_max) & (major < e.compact_major_max) & (area < e.compact_area_max) & (ratio < e.compact_ratio_max))
    signals = g.count_true(las >= e.extended_las_min, n >= e.extended_n_min, area >= e.extended_area_min, ratio >= e.extended_ratio_min, major >= e.extended_major_min)
    gates = g.yes(snr >= e.noise_snr_min) & g.yes(area >= e.noise_area_min)
    own = (
        g.yes(las >= e.singleton_las_max) | g.yes(area >= e.extended_area_min + e.self_area_margin) | g.yes(major >= e.self_major_min)
        | (ratio >= e.point_ratio_max + e.self_ratio_margin) | (n >= e.multi_min_n)
    )
    first = table.select(
        "*", hard_point.alias("hard_point_source_veto"), hard_compact.alias("hard_compact_veto"), noise.alias("_noise"), artifact.alias("_artifact"),
        plain_point.alias("_point"), signals.alias("_signals"), gates.alias("_gates"), own.alias("_own"),
        F.lower(F.trim("association_type")).alias("_t"), F.lower(F.trim("association_quality")).alias("_q"),
    )
    type_ok, quality_ok = ~F.col("_t").isin("weak_association", "artifact_risk"), ~F.col("_q").isin("low", "artifact_risk")
    single = (n == 1) & (F.col("_signals") >= 2) & F.col("_gates")
    second = first.select(
        "*", (F.col("_noise") != "").alias("noise_artifact_veto"), type_ok.alias("_type_ok"), quality_ok.alias("_quality_ok"), single.alias("_single"),
    ).withColumn(
        "isolated_compact_veto",
        g.yes(n <= 2) & ~F.col("_own") & ~F.col("hard_point_source_veto") & ~F.col("hard_compact_veto") & ~F.col("noise_artifact_veto") & ~F.col("_artifact"),
    ).withColumn(
        "endpoint_veto_final", F.col("hard_point_source_veto") | F.col("hard_compact_veto") | F.col("noise_artifact_veto") | F.col("isolated_compact_veto")
    )
    blocked = F.col("endpoint_veto_final") | F.col("_artifact")
    multi = g.yes((n >= e.multi_min_n) & (area >= e.multi_min_area) & (las >= e.extended_las_min - e.multi_las_margin))
    near = ~blocked & ((F.col("extended_evidence") >= 2) | multi)
    lobe = ~blocked & (F.col("_single") | (F.col("_type_ok") & F.col("_quality_ok"))) & (F.col("_signals") >= 2) & F.col("_gates")
    third = second.select("*", near.alias("near_extended_lobe_candidate"), lobe.alias("is_lobe_candidate"))
    hp, hc, nv, iso = (F.col(c) for c in ("hard_point_source_veto", "hard_compact_veto", "noise_artifact_veto", "isolated_compact_veto"))
    bad_type, bad_quality = ~F.col("_type_ok") & ~F.col("_single"), ~F.col("_quality_ok") & ~F.col("_single")
    weak, point = F.col("_signals") < 2, F.col("_point") | hp | hc
    lobe_reasons = tags([
        (hp, "hard_point_source_veto"), (hc, "hard_compact_veto"), (nv | F.col("_artifact"), "noise_artifact_veto"),
        (bad_type | bad_quality | weak, "not_extended_enough_for_lobe"), (iso, "isolated_compact_veto"),
    ], ";")
    point_why, compact_why, iso_why = (
        "single_gaussian_beam_like_not_low_threshold_connected", "beam_like_compact_source", "one_or_two_gaussian_isolated_not_low_threshold_connected")
    out = third.select(
        *[c for c in third.columns if not c.startswith("_")],
        F.when(hp | hc | iso, "point_like_or_compact").when(nv | F.col("_artifact"), "noise_or_artifact").when(F.col("is_lobe_candidate"), "lobe_candidate")
        .otherwise("resolved_single").alias("source_morph_class"),
        point.alias("is_point_like"), F.when(hp, point_why).otherwise("").alias("point_source_veto_reason"),
        F.when(hc, compact_why).otherwise("").alias("compact_veto_reason"), F.when(nv, F.col("_noise")).otherwise("").alias("noise_artifact_reason"),
        F.when(iso, iso_why).otherwise("").alias("isolated_compact_reason"),
        F.concat_ws(";", F.when(hp, point_why), F.when(hc, compact_why), F.when(nv, F.col("_noise")), F.when(iso, iso_why)).alias("endpoint_veto_reason"),
        F.when(F.col("near_extended_lobe_candidate"), "near_boundary_extended_lobe_fragment").otherwise("").alias("near_lobe_rescue_reason"),
        (F.col("is_lobe_candidate") | F.col("near_extended_lobe_candidate")).alias("is_parent_endpoint_allowed"),
        F.when(F.col("is_lobe_candidate"), "").when(lobe_reasons == "", "not_extended_enough_for_lobe").otherwise(lobe_reasons).alias("lobe_like_reject_reason"),
        (F.col("_artifact") | nv).alias("is_artifact_risk"),
        tags([(hp, "hard_point_source_veto"), (hc, "hard_compact_veto"), (nv, "noise_artifact_veto"), (point, "point_like"), (F.col("_artifact"), "artifact_veto"),
              (bad_type, F.concat(F.lit("bad_type:"), F.col("_t"))), (bad_quality, F.concat(F.lit("bad_quality:"), F.col("_q"))),
              (weak, "insufficient_lobe_signals"), (iso, "isolated_compact_veto")], ";").alias("morph_reject_reason"),
    )
    return out


def morph_table(groups: DataFrame, snr: DataFrame, labels: DataFrame, fields: DataFrame, cfg: Config) -> DataFrame:
    """Endpoint table of all groups (input: groups with regions)."""
    table = seeds.seed_table(groups, cfg)
    major = F.coalesce(g.finite(F.col("major_axis_beam")), F.col("LAS_beam")) if "major_axis_beam" in groups.columns else F.col("LAS_beam")
    table = table.drop("major_axis_beam").withColumn("major_axis_beam", major) if "major_axis_beam" not in groups.columns else table.withColumn("major_axis_beam", major)
    shape = F.when(F.coalesce("axis_ratio", F.lit(1.0)) > 0, F.col("major_axis_beam") / F.greatest(F.coalesce("axis_ratio", F.lit(1.0)), F.lit(1e-6)))
    table = table.withColumn("minor_axis_beam", shape).withColumn("extended_evidence", evidence_count(cfg))
    sized = cut(table.drop("width", "height").join(fields.select("field_id", "width", "height"), "field_id"))
    clamp = lambda c, size: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(size) - 1.0))
    slim = labels.select("field_id", "threshold", "y", "x", "label")
    read = raster.at_points(sized.select(*GID, clamp("centroid_x", "width").alias("x"), clamp("centroid_y", "height").alias("y")), snr, slim, cfg.segmentation, "group_index")
    read = read.select(*GID, "label_at_3sigma", "label_at_2p5sigma")
    placed = cut(artifact_environment(sized, cfg).join(read, GID))
    return endpoint_classes(cut(neighbour_flags(placed, snr, cfg)), cfg)


# ---- pair geometry ----------------------------------------------------------

ENDPOINT_FIELDS = ["source_morph_class", "is_point_like", "endpoint_veto_final", "endpoint_veto_reason", "hard_point_source_veto", "hard_compact_veto",
                   "noise_artifact_veto", "isolated_compact_veto", "near_extended_lobe_candidate", "is_parent_endpoint_allowed", "is_artifact_risk",
                   "is_lobe_candidate", "artifact_environment_score", "label_at_3sigma", "label_at_2p5sigma", "ra", "dec", "peak_ra", "peak_dec"]


def _either(flag: str) -> Column:
    return F.col(f"a.{flag}") | F.col(f"b.{flag}")


def _both(flag: str) -> Column:
    return F.col(f"a.{flag}") & F.col(f"b.{flag}")


def geometry_gate(cfg: Config) -> Column:
    """First reason against a pair, '' when it passes."""
    p, f = cfg.parents, cfg.features
    klass = lambda *names: F.col("a.source_morph_class").isin(*names) | F.col("b.source_morph_class").isin(*names)
    rules: list[tuple[Column, str]] = []
    if f.endpoint_filtering:
        rules += [(_either("endpoint_veto_final"), NO_ENDPOINT), (_either("hard_point_source_veto") | _either("hard_compact_veto"), "point_like_endpoint")]
        if f.artifact_layer2:
            rules.append((_either("noise_artifact_veto"), "artifact_veto"))
        rules.append((_either("isolated_compact_veto"), NO_ENDPOINT))
        if f.artifact_layer2:
            rules.append((klass("artifact_risk", "noise_or_artifact"), "artifact_veto"))
        rules += [(klass("point_like", "point_like_or_compact"), "point_like_endpoint"),
                  ((F.col("a.source_morph_class") != "lobe_candidate") | (F.col("b.source_morph_class") != "lobe_candidate"), "asymmetric_or_point_lobe_pair")]
    rules += [
        (~g.yes(F.col("box_gap_beam_robust") <= p.max_box_gap_beam), "box_gap_too_large"), (~g.yes(F.col("center_distance_beam") <= p.max_centre_beam), "center_distance_too_large"),
        (F.col("axis_alignment_score") < p.min_axis, "geometry_axis_alignment_too_low"), (F.col("facing_score") < p.min_facing, "geometry_facing_too_low"),
    ]
    if f.relative_scale:
        rules += [(~g.yes(F.col("flux_ratio") <= p.max_flux_ratio), "asymmetric_or_point_lobe_pair"), (~g.yes(F.col("size_ratio") <= p.max_size_ratio), "asymmetric_or_point_lobe_pair"),
                  (F.col("symmetry_score") < p.min_symmetry, "not_symmetric_lobe_pair")]
    out = F.lit("")
    for condition, name in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def rescue_gate(cfg: Config) -> tuple[Column, Column]:
    """(endpoints allow a rescue, first reason against it)."""
    p, q, f = cfg.parents, cfg.parents.rescue, cfg.features
    vetoed = _either("endpoint_veto_final") | _either("hard_point_source_veto") | _either("hard_compact_veto") | _either("isolated_compact_veto")
    if f.artifact_layer2:
        vetoed = vetoed | _either("noise_artifact_veto") | _either("is_artifact_risk")
    fit = lambda e: F.col(f"{e}.is_lobe_candidate") | F.col(f"{e}.near_extended_lobe_candidate")
    allowed = F.col("near_boundary_pair") & ~vetoed & fit("a") & fit("b")
    n1, n2, a1, a2 = F.col("a.n_gaussians"), F.col("b.n_gaussians"), F.col("a.area_3sigma_beam"), F.col("b.area_3sigma_beam")
    support = (
        F.col("same_3sigma_region_as_neighbor") | F.col("same_2p5sigma_region_as_neighbor") | (F.col("ridge_continuity_score_pair") >= q.ridge_min)
        | F.col("bridge_snr_support") | ((n1 >= q.min_n_each) & (n2 >= q.min_n_each)) | ((n1 >= q.extended_n_min) & fit("b"))
        | ((n2 >= q.extended_n_min) & fit("a")) | g.yes((a1 >= q.min_area_each) & (a2 >= q.min_area_each))
    )
    rules = [(~allowed, NO_ENDPOINT)] if f.endpoint_filtering else []
    rules += [(F.col("axis_alignment_score") < q.axis_min, "near_boundary_axis_alignment_too_low"), (F.col("facing_score") < q.facing_min, "near_boundary_facing_too_low")]
    if f.relative_scale:
        rules += [(~g.yes(F.col("flux_ratio") <= q.max_flux_ratio), "near_boundary_flux_ratio_too_high"),
                  (~g.yes(F.col("size_ratio") <= q.max_size_ratio), "near_boundary_size_ratio_too_high")]
    rules.append((~support, "near_boundary_but_no_extended_or_bridge_support"))
    out = F.lit("")
    for condition, name in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return allowed, out


def symmetry(pairs: DataFrame, cfg: Config) -> DataFrame:
    p = cfg.parents
    flux, size = g.balance(F.col("flux_ratio"), p.max_flux_ratio), g.balance(F.col("size_ratio"), p.max_size_ratio)
    scored = pairs.select("*", flux.alias("flux_ratio_score"), size.alias("size_ratio_score"))
    return scored.withColumn(
        "symmetry_score", p.w_axis * F.col("axis_alignment_score") + p.w_facing * F.col("facing_score")
        + p.w_midpoint * g.clip(F.col("midpoint_symmetry_score"), 0.0, 1.0) + p.w_flux * F.col("flux_ratio_score") + p.w_size * F.col("size_ratio_score"),
    )


def boundary_features(pairs: DataFrame, cfg: Config) -> DataFrame:
    q, beam = cfg.parents.rescue, cfg.beam.size_arcsec
    size = lambda e: g.box_side(F.coalesce(F.col(f"{e}.robust_box"), F.col(f"{e}.box"))) * F.col(f"{e}.pixel_scale") / beam
    first = pairs.select("*", size("a").alias("box_size_1_beam"), size("b").alias("box_size_2_beam"))
    s1, s2, gap = F.col("box_size_1_beam"), F.col("box_size_2_beam"), F.col("box_gap_beam_robust")
    mean = F.coalesce((s1 + s2) / 2.0, s1, s2)
    second = first.select("*", (gap / F.greatest(mean, F.lit(1e-6))).alias("gap_to_mean_box_ratio"), (gap / F.greatest(F.least(s1, s2), F.lit(1e-6))).alias("gap_to_min_box_ratio"))
    near = (gap >= 0) & ((gap <= q.near_gap_beam) | g.yes(F.col("gap_to_mean_box_ratio") <= q.gap_to_mean_box) | g.yes(F.col("gap_to_min_box_ratio") <= q.gap_to_min_box))
    return second.withColumn("near_boundary_pair", g.yes(near))


def search_gap(table: DataFrame, cfg: Config) -> DataFrame:
    """Per field, the box gap in beams up to which pairs are looked at."""
    p = cfg.parents
    side = g.box_side(F.coalesce("robust_box", "box")) * F.col("pixel_scale") / cfg.beam.size_arcsec
    widest = table.groupBy("field_id").agg(F.max(side).alias("_widest"))
    gap = F.greatest(F.lit(p.max_box_gap_beam), F.least(F.coalesce("_widest", F.lit(0.0)), F.lit(p.search_gap_cap_beam)), F.lit(p.search_gap_floor_beam))
    return table.join(widest, "field_id").withColumn("search_gap_beam", gap).drop("_widest")


def pair_edges(table: DataFrame, snr: DataFrame, cfg: Config) -> DataFrame:
    """Every pair looked at with geometry, support, gates and the union box."""
    p, beam = cfg.parents, cfg.beam.size_arcsec
    spread = cut(search_gap(table, cfg))
    met = seeds.near_boxes(spread, F.col("search_gap_beam"), cfg, p.search_padding, max(p.max_box_gap_beam, p.search_gap_cap_beam))
    ends = seeds.attach_ends(met, table, ENDPOINT_FIELDS)
    scored = cut(symmetry(boundary_features(seeds.pair_features(ends, table, cfg), cfg), cfg))
    supported = cut(line_support(scored, snr, cfg))
    allowed, why_not = rescue_gate(cfg)
    gated = supported.select("*", geometry_gate(cfg).alias("_gate"), allowed.alias("_allowed"), why_not.alias("_rescue"))
    normal = (
        (F.col("a.source_morph_class") == "lobe_candidate") & (F.col("b.source_morph_class") == "lobe_candidate") & _both("is_lobe_candidate")
        & ~(_either("endpoint_veto_final") | _either("hard_point_source_veto") | _either("hard_compact_veto") | _either("isolated_compact_veto"))
    )
    if cfg.features.artifact_layer2:
        normal = normal & ~_either("noise_artifact_veto")
    failed, near = F.col("_gate") != "", F.col("near_boundary_pair")
    rescued = failed & near & F.col("_allowed") & (F.col("_rescue") == "")
    passed = ~failed | rescued
    why = F.when(near & ~F.col("_allowed"), NO_ENDPOINT).when(near, F.col("_rescue")).otherwise("")
    reason = F.when(passed, "").when(why != "", why).when(near & ~normal, NO_ENDPOINT).otherwise(F.col("_gate"))
    score = (
        p.w_symmetry * F.col("symmetry_score") + p.w_gap * F.coalesce(g.clip(1.0 - F.col("box_gap_beam_robust") / p.max_box_gap_beam, 0.0, 1.0), F.lit(0.0))
        + p.w_core * F.col("core_candidate_near_midpoint").cast("double")
    )
    union = g.box_union(F.coalesce("a.robust_box", "a.box"), F.coalesce("b.robust_box", "b.box"))
    scale = F.col("a.pixel_scale")
    wide = gated.select("*", union.alias("parent_box"), passed.alias("double_lobe_geometry_pass"), rescued.alias("near_boundary_rescue_applied"),
                        reason.alias("rejection_reason"), score.alias("lobe_pair_score"))
    u = F.col("parent_box")
    span = F.sqrt(F.pow(u["x1"] - u["x0"], 2) + F.pow(u["y1"] - u["y0"], 2)) * scale
    artifact = F.greatest(F.coalesce("a.artifact_environment_score", F.lit(0.0)), F.coalesce("b.artifact_environment_score", F.lit(0.0)))
    out = wide.select(
        *[c for c in wide.columns if not c.startswith("_")], span.alias("parent_LAS_arcsec"), (span / beam).alias("parent_LAS_beam"),
        ((u["x1"] - u["x0"] + 1) * (u["y1"] - u["y0"] + 1) / g.beam_area_pixels(scale, cfg.beam)).alias("parent_union_area_beam"),
        (artifact if cfg.features.artifact_layer2 else F.lit(0.0)).alias("artifact_environment_score_pair"),
        F.when(F.col("near_boundary_rescue_applied"), "physics_aware_near_boundary_rescue").otherwise("physics_aware_double_lobe").alias("parent_candidate_type"),
    )
    return cut(seeds.number_pairs(out).withColumn("parent_candidate_id", F.format_string("%s_parent_pc%04d", F.col("field_id").cast("string"), F.col("pair_index"))))


# ---- host evidence ----------------------------------------------------------

def host_evidence(edges: DataFrame, hosts: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges with host columns, scored hosts, query log)."""
    h, p, f = cfg.hosts, cfg.parents, cfg.features
    if not h.enabled:
        none = edges.select("*", F.lit(0.0).alias("best_host_score"), F.when(F.col("double_lobe_geometry_pass"), "host_support_disabled").otherwise("not_checked").alias("host_evidence"),
                            F.lit("rejected").alias("parent_candidate_quality"), F.when(F.col("double_lobe_geometry_pass"), "disabled").otherwise("not_queried").alias("host_status"),
                            F.lit("none").alias("host_quality"), F.lit(False).alias("lobe1_peak_host_found"), F.lit(False).alias("lobe2_peak_host_found"),
                            F.lit(0.0).alias("lobe1_peak_host_score"), F.lit(0.0).alias("lobe2_peak_host_score"), F.col("lobe_pair_score").alias("parent_score_final"),
                            *[F.lit(None).cast(t).alias(c) for c, t in (("best_host_id", "string"), ("best_host_catalog", "string"), ("best_host_ra", "double"), ("best_host_dec", "double"),
                                                                        ("best_host_sep_midpoint_arcsec", "double"), ("best_host_perp_offset_beam", "double"),
                                                                        ("best_host_fractional_position", "double"), ("host_search_radius_arcsec", "double"))],
                            F.lit("").alias("suspicious_reason"), F.lit(False).alias("needs_visual_check"))
        return none, None, None
    open_pairs = edges.filter("double_lobe_geometry_pass")
    places = cut(host_ops.lookups(open_pairs, cfg))
    find = host_ops.cone_hits if h.limit_after_score else host_ops.cross_match
    hits = cut(find(places, hosts.withColumn("host_id", F.col("host_id").cast("string")), cfg))
    log = host_ops.query_log(places, hits, cfg)
    mid = host_ops.ranked(host_ops.score_midpoint(hits.filter("role = 'midpoint'"), cfg), cfg)
    lobe = host_ops.ranked(host_ops.score_lobe_peaks(hits.filter("role != 'midpoint'"), cfg), cfg)
    best = mid.filter("host_rank = 1").select(
        *PAIR, F.col("host_score").alias("best_host_score"), F.col("host_quality"), F.col("catalogue").alias("best_host_catalog"), F.col("host_id").alias("best_host_id"),
        F.col("host_ra").alias("best_host_ra"), F.col("host_dec").alias("best_host_dec"), F.col("separation_arcsec").alias("best_host_sep_midpoint_arcsec"),
        F.col("host_perp_offset_beam").alias("best_host_perp_offset_beam"), F.col("host_fractional_position").alias("best_host_fractional_position"),
    )
    good = F.col("host_quality").isin("high", "medium")
    of = lambda r, c: F.when(F.col("role") == r, c)
    peaks = lobe.groupBy(*PAIR).agg(
        *[F.bool_or(of(r, good)).alias(f"{r}_host_found") for r in ("lobe1_peak", "lobe2_peak")],
        *[F.max(of(r, F.col("host_score"))).alias(f"{r}_host_score") for r in ("lobe1_peak", "lobe2_peak")],
    )
    fill = {"best_host_score": 0.0, "host_quality": "none", "lobe1_peak_host_found": False, "lobe2_peak_host_found": False, "lobe1_peak_host_score": 0.0, "lobe2_peak_host_score": 0.0}
    joined = edges.join(best, PAIR, "left").join(peaks, PAIR, "left")
    base = cut(joined.select(*[F.coalesce(c, F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in joined.columns])).withColumn(
        "host_search_radius_arcsec", F.when(F.col("double_lobe_geometry_pass"), host_ops.search_radius(F.col("center_distance_arcsec"), cfg))
    )
    scored = mid.unionByName(lobe, allowMissingColumns=True)
    return evidence_state(base, cfg), scored, log


def evidence_state(base: DataFrame, cfg: Config) -> DataFrame:
    """What the hosts say about each pair that passed, its quality and final score."""
    h, p, f = cfg.hosts, cfg.parents, cfg.features
    open_, one, two = F.col("double_lobe_geometry_pass"), F.col("lobe1_peak_host_found"), F.col("lobe2_peak_host_found")
    support = F.lit(f.midpoint_host) & (host_ops.quality_rank(F.col("host_quality")) >= host_ops.RANKS[h.min_quality])
    against = F.lit(f.lobe_peak_contradiction)
    state = (
        F.when(~open_, "not_checked").when(against & one & two, "likely_independent_sources").when(against & (one | two) & ~support, "contradicts_double_lobe")
        .when(support & ~(one | two), "supports_double_lobe").when(against & support & (one | two), "mixed_midpoint_and_lobe_peak_hosts").otherwise("needs_host_check")
    )
    first = base.select("*", state.alias("host_evidence"), support.alias("_support"))
    s, sym = F.col("host_evidence"), F.col("symmetry_score")
    quality = (
        F.when(s.isin("not_checked", "likely_independent_sources", "contradicts_double_lobe"), "rejected")
        .when(s == "supports_double_lobe", F.when(F.col("artifact_environment_score_pair") >= p.artifact_suspicious, "suspicious")
              .when((F.col("host_quality") == "high") & (sym >= p.high_symmetry), "high").otherwise("medium"))
        .when(s == "mixed_midpoint_and_lobe_peak_hosts", "suspicious").otherwise(F.when(sym >= p.check_symmetry, "needs_host_check").otherwise("suspicious"))
    )
    second = first.withColumn("_q", quality)
    rescued = F.col("near_boundary_rescue_applied")
    reason = (
        F.when(~open_, F.col("rejection_reason")).when(s == "likely_independent_sources", "likely_independent_sources").when(s == "contradicts_double_lobe", "lobe_peak_host_contradiction")
        .when(s == "needs_host_check", "no_midpoint_host").otherwise("")
    )
    return second.select(
        *[c for c in second.columns if c not in ("_q", "_support", "rejection_reason")],
        F.when(rescued & (F.col("_q") == "high"), "medium").otherwise(F.col("_q")).alias("parent_candidate_quality"), reason.alias("rejection_reason"),
        F.when(~open_, "not_queried").when(F.col("_support"), "host_found").otherwise("no_plausible_host").alias("host_status"),
        F.when(open_ & rescued & (F.col("_q") == "suspicious"), "near_boundary_rescue_low_confidence").otherwise("").alias("suspicious_reason"),
        (F.col("lobe_pair_score") + F.when(open_, h.score_weight * F.col("best_host_score")).otherwise(0.0)).alias("parent_score_final"),
        (open_ & (F.col("_q") != "rejected")).alias("needs_visual_check"),
    )


# ---- acceptance -------------------------------------------------------------

def acceptance(edges: DataFrame, cfg: Config) -> DataFrame:
    """Accepted, visual-only or rejected; quality, reason and evidence text."""
    h, p, f = cfg.hosts, cfg.parents, cfg.features
    peak = F.col("lobe1_peak_host_found") | F.col("lobe2_peak_host_found")
    envelope = F.lit(f.contours) & (F.col("same_3sigma_region_as_neighbor") | F.col("same_2p5sigma_region_as_neighbor"))
    bridge = F.col("bridge_snr_support") | (F.col("ridge_continuity_score_pair") >= p.min_ridge)
    support = F.lit(f.midpoint_host) & (F.col("host_evidence") == "supports_double_lobe") & (host_ops.quality_rank(F.col("host_quality")) >= host_ops.RANKS[h.min_quality])
    ends = F.lit(True)
    if f.endpoint_filtering:
        ends = _both("is_parent_endpoint_allowed") & ~(
            _either("hard_point_source_veto") | _either("hard_compact_veto") | _either("noise_artifact_veto") | _either("endpoint_veto_final"))
    artifact = F.lit(f.artifact_layer2) & (F.col("artifact_environment_score_pair") >= p.artifact_veto)
    at_peak = F.lit(f.lobe_peak_contradiction) & peak & (F.col("host_evidence") != "supports_double_lobe")
    first = edges.select(
        "*", tags([(envelope, "common_diffuse_envelope"), (bridge, "residual_radio_bridge")]).alias("_radio"),
        tags([(envelope, "common_diffuse_envelope"), (bridge, "residual_radio_bridge"), (support, "midpoint_host")]).alias("independent_parent_evidence"),
        support.alias("host_support"), at_peak.alias("host_at_lobe_peak"), ends.alias("_ends"), artifact.alias("_artifact"),
        (F.col("host_evidence").isin("needs_host_check", "no_midpoint_host", "not_checked") | F.col("host_status").isin("disabled", "no_plausible_host", "not_queried")).alias("no_host_detected"),
        ((F.col("host_evidence") == "mixed_midpoint_and_lobe_peak_hosts") | F.col("parent_candidate_quality").isin("needs_host_check", "suspicious")).alias("host_ambiguous"),
        g.yes(F.col("best_host_perp_offset_beam") > h.medium_max_perp_beam).alias("host_off_axis"),
        g.yes(F.col("best_host_sep_midpoint_arcsec") > F.col("host_search_radius_arcsec")).alias("host_far_from_midpoint"),
    )
    old = F.trim(F.coalesce("rejection_reason", F.lit("")))
    kept = lambda text: F.when(old != "", old).otherwise(text)
    geometry, no_radio, no_host = F.col("double_lobe_geometry_pass"), F.col("_radio") == "", F.lit(h.required) & ~F.col("host_support")
    why = (
        F.when(~geometry, kept("parent_geometry_failed")).when(~F.col("_ends"), kept("parent_endpoint_not_eligible")).when(F.col("_artifact"), "artifact_contradiction")
        .when(F.col("host_at_lobe_peak"), "host_at_lobe_peak").when(no_radio, "geometry_only_no_independent_parent_evidence")
        .when(no_host, kept("host_required_for_parent_link")).otherwise(F.regexp_replace("independent_parent_evidence", ",", "+"))
    )
    stopped = ~geometry | ~F.col("_ends") | F.col("_artifact") | F.col("host_at_lobe_peak")
    klass = F.when(stopped, "rejected_parent_candidate").when(no_radio, "geometry_only_visual_candidate").when(no_host, "rejected_parent_candidate").otherwise(ACCEPTED)
    second = first.select("*", klass.alias("parent_acceptance_class"), why.alias("parent_acceptance_reason"))
    c, q = F.col("parent_acceptance_class"), F.col("parent_candidate_quality")
    free = F.lit(not h.required) & F.col("no_host_detected")
    quality = (
        F.when(c == ACCEPTED, F.when(free, F.when(F.col("symmetry_score") >= p.high_symmetry, "high").otherwise("medium")).otherwise(q))
        .when(c == "geometry_only_visual_candidate", F.when(q.isin("high", "medium"), "geometry_only").otherwise(q)).otherwise("rejected")
    )
    return second.select(
        *[x for x in second.columns if not x.startswith("_") and x not in ("parent_candidate_quality", "rejection_reason", "needs_visual_check")],
        quality.alias("parent_candidate_quality"), (c == "geometry_only_visual_candidate").alias("needs_visual_check"),
        F.when(c == ACCEPTED, "").when((c == "rejected_parent_candidate") & (old == ""), F.col("parent_acceptance_reason")).otherwise(F.col("rejection_reason")).alias("rejection_reason"),
    )


def resolve_conflicts(edges: DataFrame, cfg: Config) -> DataFrame:
    """A group stays in at most one accepted parent: best independent evidence first."""
    has = lambda name: F.array_contains(F.split("independent_parent_evidence", ","), name)
    rank = F.when(has("midpoint_host") & has("residual_radio_bridge"), 4).when(has("midpoint_host"), 3).when(has("residual_radio_bridge"), 2).when(has("common_diffuse_envelope"), 1).otherwise(0)
    accepted = edges.filter(F.col("parent_acceptance_class") == ACCEPTED).select(
        *PAIR, "parent_candidate_id", rank.alias("_e"), F.coalesce("parent_score_final", "lobe_pair_score", F.lit(0.0)).alias("_s"),
        F.coalesce("symmetry_score", F.lit(0.0)).alias("_y"), F.coalesce("box_gap_beam_robust", F.lit(999.0)).alias("_g"),
    )
    kept = greedy_matching(accepted, ["field_id"], "group_index_1", "group_index_2", [-F.col("_e"), -F.col("_s"), -F.col("_y"), F.col("_g"), F.col("parent_candidate_id")])
    marked = edges.join(kept.select(*PAIR, F.lit(True).alias("_kept")), PAIR, "left")
    was, lost = F.col("parent_acceptance_class") == ACCEPTED, "parent_conflict_lower_independent_evidence"
    out = was & F.col("_kept").isNull()
    change = {
        "parent_acceptance_class": F.when(out, "rejected_parent_candidate").otherwise(F.col("parent_acceptance_class")),
        "parent_candidate_quality": F.when(out, "rejected").otherwise(F.col("parent_candidate_quality")),
        "needs_visual_check": F.col("needs_visual_check") & ~out,
        "rejection_reason": F.when(out, F.when(F.col("rejection_reason") == "", lost).otherwise(F.concat_ws(";", "rejection_reason", F.lit(lost)))).otherwise(F.col("rejection_reason")),
    }
    return marked.select(
        *[change[c].alias(c) if c in change else F.col(c) for c in edges.columns],
        F.when(out, "removed").when(was, "kept").otherwise("not_applicable").alias("conflict_resolution_status"),
        F.when(out, lost).otherwise("").alias("conflict_rejection_reason"),
    )


def publish_candidates(edges: DataFrame, cfg: Config) -> DataFrame:
    """Accepted parents of high quality, limited per group and per field."""
    p = cfg.parents
    chosen = edges.filter((F.col("parent_acceptance_class") == ACCEPTED) & (F.col("parent_candidate_quality") == "high"))
    order = [-F.col("parent_score_final"), -F.col("symmetry_score"), F.col("box_gap_beam_robust"), F.col("parent_candidate_id")]
    slim = chosen.select(*PAIR, "parent_score_final", "symmetry_score", "box_gap_beam_robust", "parent_candidate_id")
    kept = top_k(greedy_matching(slim, ["field_id"], "group_index_1", "group_index_2", order, p.max_per_group), ["field_id"], order, p.max_per_field)
    return chosen.join(kept.select(*PAIR), PAIR, "left_semi")


def parent_review(edges: DataFrame) -> DataFrame:
    """Review rows from the host step; later rejections stay listed."""
    return edges.filter("needs_visual_check").select(
        "field_id", F.lit("parent_link").alias("record_type"), F.col("parent_candidate_id").alias("object_id"),
        F.concat_ws(":", "parent_candidate_quality", "host_evidence").alias("reason"), F.col("parent_candidate_quality").alias("priority"),
        F.to_json(F.struct("best_host_score", "host_evidence", "host_status", "lobe_pair_score", "parent_score_final", "symmetry_score")).alias("details"),
    )


@dataclass
class ParentResult:
    morph: DataFrame
    edges: DataFrame
    candidates: DataFrame
    hosts: DataFrame | None
    query_log: DataFrame | None
    review: DataFrame


def run_parents(groups: DataFrame, snr: DataFrame, labels: DataFrame, fields: DataFrame, hosts: DataFrame, cfg: Config) -> ParentResult:
    """Stage 2 for all fields; ``groups`` come from :func:`seeds.with_regions`."""
    morph = cut(morph_table(groups, snr, labels, fields, cfg))
    edges = pair_edges(morph, snr, cfg)
    checked, scored, log = host_evidence(edges, hosts, cfg)
    checked = cut(checked)
    review = parent_review(checked)
    final = cut(resolve_conflicts(cut(acceptance(checked, cfg)), cfg))
    return ParentResult(morph, final, publish_candidates(final, cfg), scored, log, review)
