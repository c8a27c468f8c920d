"""Shape class of one fitted component, by observed and deconvolved axes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from fieldlink.config import FWHM_PER_SIGMA, Config
from fieldlink.functions import geometry as g

RESOLVED_FLOOR, MARGINAL_FLOOR = 0.75, 0.25  # fixed values: probability boundaries


def with_axes(components: DataFrame, cfg: Config) -> DataFrame:
    """Observed axes in order and the deconvolved ones where both are positive.

    Every step below is its own projection, so no sub-expression is repeated.
    """
    beam = cfg.beam
    a = F.when(F.col("maj") > 0, F.col("maj")).otherwise(F.lit(beam.long_axis))
    b = F.when(F.col("min") > 0, F.col("min")).otherwise(F.lit(beam.short_axis))
    usable = (F.col("dc_maj") > 0) & (F.col("dc_min") > 0)
    first = components.select("*", a.alias("_a"), b.alias("_b"), g.yes(usable).alias("_deconvolved"))
    turned = F.when(F.col("_b") > F.col("_a"), F.col("pa") + 90.0).otherwise(F.col("pa"))
    d_turned = F.when(F.col("dc_min") > F.col("dc_maj"), F.col("dc_pa") + 90.0).otherwise(F.col("dc_pa"))
    known = F.col("_deconvolved")
    return first.select(
        *components.columns, "_deconvolved",
        F.greatest("_a", "_b").alias("observed_major"), F.least("_a", "_b").alias("observed_minor"),
        g.sky_to_pixel_angle(turned, beam).alias("observed_angle"),
        F.when(known, F.greatest("dc_maj", "dc_min")).alias("_dmaj"),
        F.when(known, F.least("dc_maj", "dc_min")).alias("_dmin"),
        F.when(known, g.sky_to_pixel_angle(d_turned, beam)).alias("_dangle"),
    )


def with_intrinsic(axes: DataFrame, cfg: Config) -> DataFrame:
    """Deconvolved axes, else the observed covariance minus the beam's, cut at zero."""
    beam, plain = cfg.beam, axes.columns
    o00, o01, o11 = g.covariance(F.col("observed_major"), F.col("observed_minor"), F.col("observed_angle"))
    t = math.radians(beam.pixel_angle)
    long2, short2 = (beam.long_axis / FWHM_PER_SIGMA) ** 2, (beam.short_axis / FWHM_PER_SIGMA) ** 2
    left_over = axes.select(
        *plain,
        (o00 - (long2 * math.cos(t) ** 2 + short2 * math.sin(t) ** 2)).alias("_k00"),
        (o01 - (long2 - short2) * math.cos(t) * math.sin(t)).alias("_k01"),
        (o11 - (long2 * math.sin(t) ** 2 + short2 * math.cos(t) ** 2)).alias("_k11"),
    )
    big, small, angle = g.principal_axes(F.col("_k00"), F.col("_k01"), F.col("_k11"))
    eigen = left_over.select(*plain, big.alias("_big"), small.alias("_small"), angle.alias("_turn"))
    width = lambda c: F.when(F.col(c).isNotNull(), FWHM_PER_SIGMA * F.sqrt(F.greatest(F.col(c), F.lit(0.0))))
    return eigen.select(
        *[c for c in plain if c not in ("_dmaj", "_dmin", "_dangle")],
        F.coalesce("_dmaj", width("_big")).alias("intrinsic_major"),
        F.coalesce("_dmin", width("_small")).alias("intrinsic_minor"),
        F.when(F.col("_deconvolved"), F.col("_dangle")).otherwise(F.when(F.col("_big") > 0, F.col("_turn"))).alias("intrinsic_angle"),
    )


def beam_like(cfg: Config) -> Column:
    """0..1: how much the observed shape looks like the beam itself."""
    m, beam = cfg.morphology, cfg.beam
    major, minor, angle = F.col("observed_major"), F.col("observed_minor"), F.col("observed_angle")
    ratio = F.exp(-F.abs(F.log((major / minor) / (beam.long_axis / beam.short_axis))) / m.ratio_tolerance)
    size = F.exp(
        -(F.abs(F.log(major / beam.long_axis)) + F.abs(F.log(minor / beam.short_axis))) / (2.0 * m.size_tolerance)
    )
    turn = g.half_turn_delta(angle, F.lit(beam.pixel_angle))
    facing = F.when(angle.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - turn / m.pa_tolerance_deg))
    return F.least(F.lit(1.0), 0.4 * ratio + 0.4 * size + 0.2 * facing)


def with_morphology(components: DataFrame, cfg: Config) -> DataFrame:
    """Add shape class, probabilities, effective angle and angle weight.

    Uses ``peak_snr`` when the components have it.
    """
    m = cfg.morphology
    snr = F.col("peak_snr") if "peak_snr" in components.columns else F.lit(None).cast("double")
    staged = with_intrinsic(with_axes(components, cfg), cfg).select(
        "*",
        beam_like(cfg).alias("beam_like_score"),
        (g.finite(snr) < m.low_snr).alias("_faint"),
        F.coalesce(F.col("intrinsic_major") / cfg.beam.long_axis, F.lit(0.0)).alias("_fmaj"),
        F.coalesce(F.col("intrinsic_minor") / cfg.beam.short_axis, F.lit(0.0)).alias("_fmin"),
    )
    faint, deconvolved = g.yes(F.col("_faint")), F.col("_deconvolved")
    fmaj, fmin = F.col("_fmaj"), F.col("_fmin")
    like = F.col("beam_like_score") >= m.beam_like_unresolved
    # One (class, reason) pair per rule, first match wins.
    rules = [
        (faint, "unknown", "low_snr_uncertain"),
        (deconvolved & ((fmaj >= m.deconv_major_resolved) | (fmin >= m.deconv_minor_resolved)),
         "resolved", "deconvolved_major_significant"),
        (deconvolved & (fmaj >= m.deconv_major_marginal), "marginally_resolved", "deconvolved_axes_marginal"),
        (deconvolved, "unresolved", "deconvolved_axes_not_significant"),
        ((fmaj >= m.intrinsic_resolved) | (fmin >= m.intrinsic_resolved), "resolved", "observed_covariance_exceeds_beam"),
        (fmaj >= m.intrinsic_marginal, "marginally_resolved", "observed_covariance_marginally_exceeds_beam"),
        (like, "unresolved", "beam_like_within_errors"),
    ]
    klass, reason = F.lit("unknown"), F.lit("no_reliable_deconvolved_axes")
    for condition, name, why in reversed(rules):
        klass = F.when(condition, name).otherwise(klass)
        reason = F.when(condition, why).otherwise(reason)
    unit = F.when(deconvolved, F.lit(m.deconv_major_marginal)).otherwise(F.lit(m.intrinsic_marginal))
    significance = F.when(faint, 0.0).otherwise(F.greatest(fmaj, fmin) / unit)
    classed = staged.select(
        *[c for c in staged.columns if not c.startswith("_")],
        klass.alias("morphology_class"), reason.alias("classification_reason"),
        significance.alias("resolved_significance"),
    )
    raw = g.clip(F.col("resolved_significance") / 3.0, 0.0, 1.0)
    k = F.col("morphology_class")
    probability = (
        F.when(k == "resolved", F.greatest(raw, F.lit(RESOLVED_FLOOR)))
        .when(k == "marginally_resolved", g.clip(raw, MARGINAL_FLOOR, RESOLVED_FLOOR))
        .when(k == "unresolved", F.least(raw, F.lit(MARGINAL_FLOOR)))
        .otherwise(raw)
    )
    weight = (
        F.when(k == "resolved", m.pa_weight_resolved)
        .when(k == "marginally_resolved", m.pa_weight_marginal)
        .when(k == "unresolved", m.pa_weight_unresolved)
        .when(like, m.pa_weight_beam_like)
        .otherwise(m.pa_weight_unknown)
    )
    preferred = F.when(k.isin("resolved", "marginally_resolved"), F.coalesce("dc_pa", "pa")).otherwise(F.col("pa"))
    return classed.select(
        "*", probability.alias("resolved_probability"), weight.alias("pa_weight"),
        g.sky_to_pixel_angle(preferred, cfg.beam).alias("effective_angle"),
    )
