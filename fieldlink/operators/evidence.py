"""Evidence, penalties, score and class of every candidate pair.

Each step adds columns in a projection of its own, so Catalyst never repeats a
long expression; the raster is read once, in :func:`with_path_samples`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from fieldlink.config import FWHM_PER_SIGMA, MIDDLE_SIGMA, STRONG_SIGMA, WEAK_SIGMA, Config
from fieldlink.functions import geometry as g
from fieldlink.functions.text import tags
from fieldlink.operators import paths
from fieldlink.operators.pairs import candidate_pairs

PAIR = ["field_id", "component_index_1", "component_index_2"]

# Attributes of a component that its pairs need.
CARRY = (
    "component_id", "total_flux", "peak_flux", "maj", "dc_maj", "observed_major", "intrinsic_major",
    "morphology_class", "resolved_probability", "beam_like_score", "classification_reason",
    "pa_weight", "effective_angle",
)
LEVELS = {"3sigma": STRONG_SIGMA, "2p5sigma": MIDDLE_SIGMA, "2sigma": WEAK_SIGMA}
SAMPLED = ("along_beam", "across_beam", *paths.LISTS, *paths.COUNTS, *paths.VALUES)
RASTER_CARRY = ("snr_at", *[f"{c}_at_{n}" for n in LEVELS for c in ("label", "area")])


def has_raster(components: DataFrame) -> bool:
    return "snr_at" in components.columns


def candidate_edges(components: DataFrame, cfg: Config) -> DataFrame:
    """Candidate pairs with the attributes of both ends."""
    extra = ("width", "height") if has_raster(components) else ()
    carry = CARRY + (RASTER_CARRY + extra if has_raster(components) else ())
    edges = candidate_pairs(components, cfg, carry)
    if extra:
        edges = edges.withColumnsRenamed({"width_1": "width", "height_1": "height"}).drop("width_2", "height_2")
    return edges


# ---- geometry, shape and flux ----------------------------------------------

def overlap(distance: Column, major_1: Column, major_2: Column, width: Column) -> tuple[Column, Column]:
    """(score, gap in beams) of two ellipses seen along their connecting line."""
    usable = (major_1 > 0) & (major_2 > 0) & (distance >= 0)
    gap = F.when(usable, (distance - 0.5 * (major_1 + major_2)) / F.greatest(width, F.lit(1e-6)))
    return F.coalesce(g.clip(1.0 - gap, 0.0, 1.0), F.lit(0.0)), gap


def flux_ratio(kind_1: str = "1", kind_2: str = "2") -> Column:
    """Fainter over brighter, from total flux on both ends, else peak flux on both."""
    def ratio(name: str) -> Column:
        a, b = g.finite(F.col(f"{name}_{kind_1}")), g.finite(F.col(f"{name}_{kind_2}"))
        return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))

    return F.coalesce(ratio("total_flux"), ratio("peak_flux"))


def geometric_evidence(edges: DataFrame, cfg: Config) -> DataFrame:
    a, beam = cfg.association, cfg.beam
    scale = F.col("pixel_scale")
    dx, dy = F.col("x_2") - F.col("x_1"), F.col("y_2") - F.col("y_1")
    along, across = g.along_across_beam(dx * scale, dy * scale, beam)
    angle = F.col("pair_angle_deg")
    placed = edges.select(
        "*", g.direction(dx, dy).alias("pair_angle_deg"),
        F.abs(along).alias("beam_parallel_arcsec"), F.abs(across).alias("beam_perpendicular_arcsec"),
        F.sqrt(dx * dx + dy * dy).alias("distance_pix"),
    ).select(
        "*", g.beam_projection(angle, beam).alias("directional_beam_arcsec"),
        F.when(angle.isNotNull(), g.half_turn_delta(angle, F.lit(beam.pixel_angle))).alias("pair_angle_relative_bpa_deg"),
    )
    cap = a.max_pair_arcsec
    inside = (F.col("distance_beam") <= a.max_pair_beams) & (F.lit(True) if cap is None else F.col("distance_arcsec") <= cap)
    reason = F.when(
        inside,
        "within_elliptical_beam_radius_no_absolute_cap" if cap is None else "within_elliptical_beam_and_absolute_radius",
    )
    if cap is not None:
        reason = reason.when(F.col("distance_arcsec") > cap, "rejected_by_absolute_radius")
    size = F.lit(beam.size_arcsec)

    def seen(n: str) -> Column:
        return F.coalesce(g.finite(F.col(f"maj_{n}")), g.finite(F.col(f"observed_major_{n}")), size)

    def body(n: str) -> Column:
        return F.coalesce(
            F.when(F.col(f"dc_maj_{n}") > 0, F.col(f"dc_maj_{n}")), F.when(F.col(f"maj_{n}") > 0, F.col(f"maj_{n}")), size
        )

    observed, gap = overlap(F.col("distance_arcsec"), seen("1"), seen("2"), F.col("directional_beam_arcsec"))
    inner, _ = overlap(
        F.col("distance_arcsec"), F.col("intrinsic_major_1"), F.col("intrinsic_major_2"), F.col("directional_beam_arcsec")
    )
    shaped = [F.col(f"morphology_class_{n}").isin("resolved", "marginally_resolved") for n in "12"]
    intrinsic = F.when(shaped[0] & shaped[1], inner).otherwise(0.0)
    weight = [F.col(f"pa_weight_{n}") if a.beam_aware else F.lit(1.0) for n in "12"]
    p1, p2 = F.col("effective_angle_1"), F.col("effective_angle_2")
    along_line = [g.alignment(g.half_turn_delta(p, angle)) for p in (p1, p2)]
    known = [p.isNotNull().cast("int") for p in (p1, p2)]
    n_known = known[0] + known[1]

    def mean_of(values) -> Column:
        parts = [F.when(p.isNotNull(), v).otherwise(0.0) for p, v in zip((p1, p2), values)]
        return F.when(n_known > 0, (parts[0] + parts[1]) / n_known).otherwise(0.0)

    scored = placed.select(
        "*", F.coalesce(reason, F.lit("rejected_by_elliptical_beam_distance")).alias("candidate_generation_reason"),
        g.clip(1.0 - F.col("distance_beam") / a.max_pair_beams, 0.0, 1.0).alias("closeness_score"),
        observed.alias("observed_ellipse_overlap_score"), gap.alias("ellipse_gap_beam"),
        (intrinsic if a.beam_aware else observed).alias("ellipse_overlap_score"),
        (F.least(body("1"), body("2")) / F.greatest(body("1"), body("2"))).alias("size_similarity_score"),
        F.when(p1.isNotNull() & p2.isNotNull(), g.alignment(g.half_turn_delta(p1, p2))).otherwise(0.0).alias("raw_pa_alignment_score"),
        mean_of(along_line).alias("raw_line_to_pa_alignment_score"),
        mean_of([w * v for w, v in zip(weight, along_line)]).alias("line_to_pa_alignment_score"),
        flux_ratio().alias("flux_ratio"),
    )
    return scored.select(
        "*", (weight[0] * weight[1] * F.col("raw_pa_alignment_score")).alias("pa_alignment_score"),
        F.coalesce(F.sqrt("flux_ratio"), F.lit(0.0)).alias("flux_continuity_score"),
    ).withColumn("flow_alignment_score", (F.col("pa_alignment_score") + F.col("line_to_pa_alignment_score")) / 2.0)


# ---- shared regions ---------------------------------------------------------

def contour_evidence(edges: DataFrame, cfg: Config) -> DataFrame:
    """Same region at 3, 2.5 and 2 sigma, and the widest shared region in beams."""
    if "label_at_2sigma_1" not in edges.columns:
        return edges.select(
            "*", *[F.lit(0).cast("long").alias(f"same_label_{n}") for n in LEVELS],
            *[F.lit(False).alias(f"connected_at_{n}") for n in LEVELS], F.lit(False).alias("only_2sigma_connected"),
            F.lit(0.0).alias("common_envelope_area_beam"), F.lit(0.0).alias("_fraction_2sigma"), F.lit(0.0).alias("_area_2sigma"),
        )
    def shared(n: str) -> Column:
        left = F.col(f"label_at_{n}_1")
        return F.when((left > 0) & (left == F.col(f"label_at_{n}_2")), left).otherwise(0)

    per_beam = F.col("pixel_scale") * F.col("pixel_scale") / cfg.beam.area_arcsec2
    found = edges.select("*", *[shared(n).alias(f"_same_{n}") for n in LEVELS])
    area = lambda n: F.when(F.col(f"_same_{n}") > 0, F.col(f"area_at_{n}_1")).otherwise(0)
    found = found.select(
        "*", (area("2sigma") / (F.col("width") * F.col("height"))).alias("_fraction_2sigma"),
        (area("2sigma") * per_beam).alias("_area_2sigma"),
        (F.greatest(*[area(n) for n in LEVELS]) * per_beam).alias("_envelope"),
    )
    on = cfg.features.contours
    joined = {n: (F.col(f"_same_{n}") > 0) if on else F.lit(False) for n in LEVELS}
    return found.select(
        *[c for c in found.columns if c not in ("_envelope", *[f"_same_{n}" for n in LEVELS])],
        *[(F.col(f"_same_{n}") if on else F.lit(0)).cast("long").alias(f"same_label_{n}") for n in LEVELS],
        *[joined[n].alias(f"connected_at_{n}") for n in LEVELS],
        (joined["2sigma"] & ~joined["2p5sigma"] & ~joined["3sigma"]).alias("only_2sigma_connected"),
        (F.col("_envelope") if on else F.lit(0.0)).alias("common_envelope_area_beam"),
    )


# ---- raster along the connecting line --------------------------------------

def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def _share(a: Column, test) -> Column:
    """Share of entries passing a test; 0 for an empty array."""
    return F.when(F.size(a) > 0, F.size(F.filter(a, test)) / F.size(a)).otherwise(0.0)


def _longest_run_share(a: Column, level: float) -> Column:
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"))

    def step(s, v):
        now = F.when(v >= level, s["now"] + 1).otherwise(0)
        return F.struct(F.greatest(s["best"], now).alias("best"), now.alias("now"))

    return F.when(F.size(a) > 0, F.aggregate(a, start, step, lambda s: s["best"]) / F.size(a)).otherwise(0.0)


def _array_median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def path_frame(edges: DataFrame, cfg: Config) -> DataFrame:
    """Edges with what reading the raster along them needs (see :func:`paths.with_samples`)."""
    scale, angle = F.col("pixel_scale"), g.direction(F.col("x_2") - F.col("x_1"), F.col("y_2") - F.col("y_1"))
    amp = lambda n: F.greatest(F.coalesce(F.col(f"snr_at_{n}"), F.lit(0.0)), F.lit(0.0))
    across = F.when(angle.isNotNull(), g.beam_projection(angle + 90.0, cfg.beam)).otherwise(cfg.beam.size_arcsec)
    bridge, residual = paths.half_widths(F.col("across_beam"), scale, cfg)
    base = edges.select("*", g.beam_projection(angle, cfg.beam).alias("along_beam"), across.alias("across_beam")).select(
        "*", amp("1").alias("_amp_1"), amp("2").alias("_amp_2"), bridge.alias("_half_bridge"), residual.alias("_half_residual"),
        (cfg.association.residual_endpoint_exclusion_beam * F.col("along_beam") / scale).alias("_exclude"),
    )
    # Residuals are read in a cut-out, whose offset can turn a half pixel the other way.
    pad = F.ceil(F.col("_half_residual") + 3.0 * F.greatest("along_beam", "across_beam") / scale)
    low = lambda c: F.greatest(F.lit(0.0), F.floor(F.least(f"{c}_1", f"{c}_2")) - pad)
    return base.withColumn("_x0", low("x")).withColumn("_y0", low("y"))


def path_evidence(edges: DataFrame, snr: DataFrame, cfg: Config) -> DataFrame:
    """Bridge, residual bridge and ridge columns per pair."""
    spots = edges.select("field_id", "component_index_1", F.col("x_1").alias("x"), F.col("y_1").alias("y"), "pixel_scale").distinct()
    slim = edges.select(*PAIR, "x_1", "y_1", "x_2", "y_2", "pixel_scale", "width", "height", "distance_pix", "snr_at_1", "snr_at_2")
    found = path_columns(with_path_samples(slim, snr, spots, cfg), cfg)
    return found.select(*PAIR, *[c for c in found.columns if c not in slim.columns])


def with_path_samples(pairs: DataFrame, snr: DataFrame, spots: DataFrame, cfg: Config) -> DataFrame:
    """Pairs with raster values along them; the raster comes to the pairs, so they travel once, before anything is derived from them.

    ``spots`` holds field_id, x, y and pixel_scale of the components.
    """
    sampled = paths.with_samples(pairs, snr, spots, cfg, lambda placed: path_frame(placed, cfg))
    return sampled.select(*pairs.columns, *SAMPLED)


def path_columns(edges: DataFrame, cfg: Config) -> DataFrame:
    """Bridge, residual bridge and ridge columns in place of the samples."""
    a = cfg.association
    scale = F.col("pixel_scale")
    work = edges.select(
        "*", g.beam_area_pixels(scale, cfg.beam).alias("beam_pix"),
        F.rint(a.residual_endpoint_exclusion_beam * F.col("along_beam") / scale).cast("int").alias("trim"),
    )
    line, trim = F.col("line"), F.col("trim")
    weak, middle, strong = WEAK_SIGMA, MIDDLE_SIGMA, STRONG_SIGMA
    cut_ends = (trim > 0) & (F.size("rline") > 2 * trim)
    steps = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.abs(F.get(line, i) - F.get(line, i - 1)))
    have = F.size(line) > 0
    stats = work.select(
        "*", F.when(have, _mean(line)).alias("l_mean"), F.array_min(line).alias("l_min"), F.array_max(line).alias("l_max"),
        _share(line, lambda q: q >= a.weak_score).alias("l_weak"), _share(line, lambda q: q >= middle).alias("l_mid"),
        _share(line, lambda q: q < -1.0).alias("l_negative"),
        F.when(have, _share(line, lambda q: q < a.weak_score)).otherwise(1.0).alias("l_gap"),
        F.when(F.size(line) >= 3, _array_median(steps)).alias("l_jump"),
        F.when(cut_ends, F.slice("rline", trim + 1, F.size("rline") - 2 * trim)).otherwise(F.col("rline")).alias("rcut"),
    )
    seen = have | (F.col("nb") > 0)
    area = F.when(F.col("nb") > 0, F.col("nbw").cast("double")).otherwise(F.size(F.filter(line, lambda q: q >= a.weak_score)).cast("double"))
    length = F.greatest(F.col("distance_pix"), F.lit(1.0))
    wide = stats.select(
        "*", F.when(seen, area).otherwise(0.0).alias("bridge_area_pix"),
        F.when(F.col("nb") > 0, F.col("b_mean")).otherwise(F.col("l_mean")).alias("_bm"),
        (F.col("distance_pix") * scale / F.col("along_beam")).alias("bridge_length_beam"),
        F.when(F.col("nr") > 0, F.col("nrp") / F.col("beam_pix")).otherwise(0.0).alias("residual_bridge_area_beams"),
        F.when(F.col("nr") > 0, _share(F.col("rcut"), lambda q: q >= a.residual_snr)).otherwise(0.0).alias("residual_bridge_length_fraction"),
        F.when(F.col("nr") > 0, _longest_run_share(F.col("rcut"), a.residual_snr)).otherwise(0.0).alias("residual_bridge_contiguous_fraction"),
        F.when(
            F.col("nr") > 0,
            (_share(F.col("rcut"), lambda q: q >= weak) + _share(F.col("rcut"), lambda q: q >= middle)
             + _share(F.col("rcut"), lambda q: q >= strong)) / 3.0,
        ).otherwise(0.0).alias("multi_threshold_bridge_persistence"),
        F.coalesce(1.0 / (1.0 + F.col("l_jump") / (F.abs("l_mean") + 1.0)), F.when(have, F.lit(0.5)), F.lit(0.0)).alias("ridge_gradient_smoothness"),
    )
    wide = wide.withColumn("bridge_width_beam", F.col("bridge_area_pix") / length * scale / F.col("across_beam"))
    bridge_score = (
        0.35 * F.col("l_weak") + 0.25 * F.col("l_mid")
        + 0.25 * g.clip(F.col("bridge_width_beam") / a.min_bridge_width_beam, 0.0, 1.0)
        + 0.15 * g.clip((F.col("_bm") - a.weak_score) / (strong - a.weak_score), 0.0, 1.0)
    ) * F.when(F.col("bridge_length_beam") >= a.min_bridge_length_beam, 1.0).otherwise(0.7)
    residual_score = (
        0.30 * g.clip((F.col("r_max") - a.residual_snr) / 2.0, 0.0, 1.0)
        + 0.20 * g.clip((F.col("r_mean") - 0.5 * a.residual_snr) / a.residual_snr, 0.0, 1.0)
        + 0.20 * g.clip(F.col("residual_bridge_area_beams") / a.residual_min_area_beams, 0.0, 1.0)
        + 0.20 * g.clip(F.col("residual_bridge_length_fraction") / a.residual_min_length_fraction, 0.0, 1.0)
        + 0.10 * F.col("residual_bridge_contiguous_fraction")
    )
    ridge = (0.55 * F.col("l_weak") + 0.30 * F.col("l_mid") + 0.15 * F.col("ridge_gradient_smoothness")) * (1.0 - 0.5 * F.col("l_gap"))
    on = (F.col("nr") > 0) & F.lit(a.residual_bridge)
    zero = lambda c: F.when(on, c).otherwise(0.0)
    return wide.select(
        *[c for c in edges.columns if c not in SAMPLED],
        F.coalesce("_bm", F.lit(0.0)).alias("bridge_mean_snr"), F.coalesce("l_min", "b_min", F.lit(0.0)).alias("bridge_min_snr"),
        F.coalesce(F.when(F.col("nb") > 0, F.col("b_max")).otherwise(F.col("l_max")), F.lit(0.0)).alias("bridge_max_snr"),
        (F.col("bridge_area_pix") / length).alias("bridge_width_pix"), "bridge_width_beam",
        F.col("distance_pix").alias("bridge_length_pix"), "bridge_length_beam", "bridge_area_pix",
        (F.col("bridge_area_pix") / F.col("beam_pix")).alias("bridge_area_beam"),
        F.coalesce(g.clip(bridge_score, 0.0, 1.5), F.lit(0.0)).alias("bridge_score"),
        zero(F.col("r_max")).alias("residual_bridge_peak_snr"), zero(F.col("r_mean")).alias("residual_bridge_mean_snr"),
        zero(F.col("r_sum") / F.sqrt(F.greatest(F.col("residual_bridge_area_beams"), F.lit(1.0)))).alias("residual_bridge_integrated_snr"),
        zero(F.col("residual_bridge_area_beams")).alias("residual_bridge_area_beams"),
        zero(F.col("residual_bridge_length_fraction")).alias("residual_bridge_length_fraction"),
        zero(F.col("nrp") / length * scale / F.col("across_beam")).alias("residual_bridge_width_beams"),
        zero(F.col("residual_bridge_contiguous_fraction")).alias("residual_bridge_contiguous_fraction"),
        zero(F.col("multi_threshold_bridge_persistence")).alias("multi_threshold_bridge_persistence"),
        zero(g.clip(residual_score, 0.0, 1.5)).alias("residual_bridge_score"),
        F.coalesce("l_mean", F.lit(0.0)).alias("ridge_mean_snr"), F.col("l_gap").alias("ridge_gap_fraction"),
        F.when(have, g.clip(ridge, 0.0, 1.5)).otherwise(0.0).alias("ridge_continuity_score"),
        F.col("ridge_gradient_smoothness"),
        F.coalesce("l_min", F.lit(0.0)).alias("_line_min"), F.col("l_negative").alias("_line_negative"),
    )


NO_PATH = {
    "bridge_mean_snr": 0.0, "bridge_min_snr": 0.0, "bridge_max_snr": 0.0, "bridge_width_pix": 0.0, "bridge_width_beam": 0.0,
    "bridge_length_pix": 0.0, "bridge_length_beam": 0.0, "bridge_area_pix": 0.0, "bridge_area_beam": 0.0, "bridge_score": 0.0,
    "residual_bridge_peak_snr": 0.0, "residual_bridge_mean_snr": 0.0, "residual_bridge_integrated_snr": 0.0,
    "residual_bridge_area_beams": 0.0, "residual_bridge_length_fraction": 0.0, "residual_bridge_width_beams": 0.0,
    "residual_bridge_contiguous_fraction": 0.0, "multi_threshold_bridge_persistence": 0.0, "residual_bridge_score": 0.0,
    "ridge_mean_snr": 0.0, "ridge_gap_fraction": 1.0, "ridge_continuity_score": 0.0, "ridge_gradient_smoothness": 0.0,
    "_line_min": 0.0, "_line_negative": 0.0,
}


# ---- penalties, veto and score ---------------------------------------------

def artifact_penalties(edges: DataFrame, cfg: Config) -> DataFrame:
    a = cfg.association
    far, low = F.col("distance_beam"), F.col("_line_min")
    supports = g.count_true(
        F.col("bridge_score") >= 0.45, F.col("ridge_continuity_score") >= 0.45,
        F.col("pa_alignment_score") >= 0.55, F.col("line_to_pa_alignment_score") >= 0.55,
    )
    slope = g.clip((far / a.max_pair_beams - 0.7) / 0.3, 0.0, 2.0)
    lonely = (far > 0.55 * a.max_pair_beams) & (supports < 2)
    share, only_2 = F.col("_fraction_2sigma"), F.col("only_2sigma_connected")
    swallow = F.greatest(
        F.when(share > 0.05, g.clip((share - 0.05) / 0.10, 0.0, 1.5)).otherwise(0.0),
        F.when(
            (F.col("_area_2sigma") > F.greatest(F.lit(30.0), 4.0 * F.pow(F.greatest(far, F.lit(1.0)), 2))) & only_2, 1.0
        ).otherwise(0.0),
    )
    first = edges.select(
        "*", g.clip((a.weak_score - low) / (a.weak_score + 0.3), 0.0, 1.5).alias("deep_valley_penalty"),
        only_2.cast("double").alias("only_2sigma_penalty"),
        g.clip(g.clip((-low - 0.3) / 2.2, 0.0, 2.0) + g.clip(F.col("_line_negative"), 0.0, 1.0), 0.0, 2.0).alias("negative_bowl_penalty"),
        F.when(lonely, F.greatest(slope, F.lit(1.0))).otherwise(slope).alias("too_far_penalty"),
        swallow.alias("large_mask_swallow_penalty"),
    )
    lopsided = g.yes(
        (F.col("flux_ratio") < 0.08) & ((F.col("negative_bowl_penalty") > 0.2) | (F.col("deep_valley_penalty") > 0.8))
    )
    bare = (
        (far < 6.0) & (F.col("bridge_score") < 0.2) & (F.col("ridge_continuity_score") < 0.2)
        & (F.greatest("pa_alignment_score", "line_to_pa_alignment_score") < 0.25)
    )
    second = first.withColumn(
        "sidelobe_risk_penalty", F.when(lopsided, 0.7).when(bare, 0.4).otherwise(0.0)
    )
    flags = tags([
        (F.col("only_2sigma_connected"), "only_2sigma"), (F.col("negative_bowl_penalty") >= 0.5, "negative_bowl"),
        (F.col("sidelobe_risk_penalty") >= 0.5, "sidelobe_risk"), (F.col("large_mask_swallow_penalty") >= 0.5, "large_mask_swallow"),
        (F.col("too_far_penalty") >= 1.0, "too_far"),
    ])
    return second.withColumn("artifact_risk_flags", flags)


def unresolved_veto(edges: DataFrame, cfg: Config) -> DataFrame:
    a = cfg.association
    evidence = (
        F.col("connected_at_3sigma")
        | (F.col("connected_at_2p5sigma") & (F.col("common_envelope_area_beam") >= a.veto_min_envelope_beams))
        | (
            (F.col("bridge_score") >= a.veto_min_bridge) & (F.col("bridge_width_beam") >= 0.7 * a.min_bridge_width_beam)
            & (F.col("bridge_length_beam") >= 0.7 * a.min_bridge_length_beam)
        )
        | (F.col("residual_bridge_score") >= a.veto_min_residual)
    )
    compact = [
        (F.col(f"morphology_class_{n}") == "unresolved") | (F.col(f"beam_like_score_{n}") >= a.veto_beam_like) for n in "12"
    ]
    veto = g.yes(compact[0] & compact[1] & ~evidence) & F.lit(a.unresolved_veto)
    return edges.select(
        "*", veto.alias("unresolved_pair_veto"),
        F.when(veto, "veto_unresolved_pair_no_independent_radio_evidence").otherwise("").alias("unresolved_pair_veto_reason"),
    )


def association_score(edges: DataFrame, cfg: Config) -> DataFrame:
    a, w, f = cfg.association, cfg.weights, cfg.features
    bit = lambda c: F.col(c).cast("double")
    terms = [(w.closeness, F.col("closeness_score"), True), (w.overlap, F.col("ellipse_overlap_score"), f.overlap),
             (w.pa_alignment, F.col("pa_alignment_score"), f.pa_alignment),
             (w.conn_3sigma, bit("connected_at_3sigma"), f.contours), (w.conn_2p5sigma, bit("connected_at_2p5sigma"), f.contours),
             (w.conn_2sigma, bit("connected_at_2sigma"), f.contours), (w.bridge, F.col("bridge_score"), True),
             (0.8 * w.bridge, F.col("residual_bridge_score"), True), (w.ridge, F.col("ridge_continuity_score"), f.ridge),
             (w.flux_continuity, F.col("flux_continuity_score"), True), (w.flow_alignment, F.col("flow_alignment_score"), f.pa_alignment),
             (-w.valley, F.col("deep_valley_penalty"), f.artifact_layer1), (-w.only_2sigma, F.col("only_2sigma_penalty"), f.artifact_layer1),
             (-w.negative_bowl, F.col("negative_bowl_penalty"), f.artifact_layer1), (-w.sidelobe, F.col("sidelobe_risk_penalty"), f.artifact_layer1),
             (-w.too_far, F.col("too_far_penalty"), f.artifact_layer1),
             (-w.large_mask_swallow, F.col("large_mask_swallow_penalty"), f.artifact_layer1)]
    total = F.lit(0.0)
    for weight, value, on in terms:
        if on:
            total = total + weight * value
    support = (F.col("bridge_score") >= a.support_bridge) | (F.col("residual_bridge_score") >= a.support_bridge)
    if f.ridge:
        support = support | (F.col("ridge_continuity_score") >= a.support_ridge)
    if f.overlap:
        support = support | (F.col("ellipse_overlap_score") >= a.support_overlap)
    thin = F.col("only_2sigma_connected") & ~support & F.lit(f.contours and f.artifact_layer1)
    summed = edges.withColumn("_sum", total)
    capped = F.when(thin, F.least(F.col("_sum"), F.lit(a.max_only_2sigma_score))).otherwise(F.col("_sum"))
    final = F.when(F.col("unresolved_pair_veto"), F.least(capped, F.lit(a.veto_score_cap))).otherwise(capped)
    return summed.withColumn("association_score", final).drop("_sum")


def classify_edges(edges: DataFrame, cfg: Config) -> DataFrame:
    """rejected / strong / weak with the decision and reason before clustering."""
    a = cfg.association
    score = F.col("association_score")
    rules = []
    if a.max_pair_arcsec is not None:
        rules.append((F.col("distance_arcsec") > a.max_pair_arcsec, "rejected", F.lit("too_far_absolute_radius")))
    rules += [
        (F.col("distance_beam") > a.max_pair_beams, "rejected", F.lit("too_far")),
        (F.col("unresolved_pair_veto"), "rejected", F.col("unresolved_pair_veto_reason")),
        (score >= a.strong_score, "strong", F.lit("")), (score >= a.weak_score, "weak", F.lit("pending_weak_attachment")),
    ]
    kind, reason = F.lit("rejected"), F.lit("score_below_threshold")
    for condition, name, why in reversed(rules):
        kind, reason = F.when(condition, name).otherwise(kind), F.when(condition, why).otherwise(reason)
    return edges.select("*", kind.alias("edge_type"), reason.alias("rejection_reason")).withColumn(
        "association_decision", F.col("edge_type") == "strong"
    )


def score_edges(components: DataFrame, snr: DataFrame | None, cfg: Config) -> DataFrame:
    """All evidence, the score and the class of every candidate pair."""
    pairs = candidate_edges(components, cfg)
    if snr is not None:
        pairs = with_path_samples(pairs, snr, components.select("field_id", "x", "y", "pixel_scale"), cfg)
    edges = contour_evidence(geometric_evidence(pairs, cfg), cfg)
    if snr is not None:
        edges = path_columns(edges, cfg)
    else:
        edges = edges.select("*", *[F.lit(v).alias(k) for k, v in NO_PATH.items()])
    edges = classify_edges(association_score(unresolved_veto(artifact_penalties(edges, cfg), cfg), cfg), cfg)
    return edges.drop("_fraction_2sigma", "_area_2sigma", "_line_min", "_line_negative")
