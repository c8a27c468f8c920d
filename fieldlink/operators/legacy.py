"""The older one-shot merge: weighted pair score, connected components, source measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlink.config import MIDDLE_SIGMA, WEAK_SIGMA, Config
from fieldlink.functions import geometry as g
from fieldlink.functions.text import tags
from fieldlink.lineage import cut
from fieldlink.operators import measure, raster
from fieldlink.operators.cluster import GROUP, group_name
from fieldlink.operators.evidence import PAIR, flux_ratio
from fieldlink.operators.graph import cluster
from fieldlink.operators.pairs import legacy_candidate_pairs
from fieldlink.operators.ranking import BUCKET_ROWS, running_total

CARRY = ("component_id", "island_id", "total_flux", "peak_flux", "maj", "dc_maj", "pa", "label_at_3sigma", "label_at_2p5sigma", "label_at_2sigma")


def merge_edges(components: DataFrame, snr: DataFrame, cfg: Config) -> DataFrame:
    """Pair features, score, decision and evidence text."""
    w, beam = cfg.legacy, cfg.beam.long_axis
    pairs = cut(legacy_candidate_pairs(components, cfg, CARRY))
    lines = raster.line_values(pairs, snr, PAIR)
    line, have = F.col("line"), F.col("line").isNotNull()
    total = F.aggregate(line, F.lit(0.0), lambda s, v: s + v) / F.size(line)
    seen = cut(pairs.join(lines, PAIR, "left")).select(
        "*", total.alias("_mean"), F.array_min(line).alias("_low"),
        F.when(have, F.size(F.filter(line, lambda v: v > WEAK_SIGMA)) / F.size(line)).otherwise(0.0).alias("pixel_support_score"),
        (F.col("distance_arcsec") / beam).alias("beam_normalized_distance"), flux_ratio().alias("flux_ratio_score"),
    )
    turn = F.abs(F.pmod(F.col("pa_1") - F.col("pa_2") + 90.0, F.lit(180.0)) - 90.0)
    size = lambda n: F.coalesce(g.finite(F.col(f"dc_maj_{n}")), g.finite(F.col(f"maj_{n}")))
    reach = 0.5 * (size("1") + size("2")) / F.col("pixel_scale")
    same = lambda n: (F.col(f"label_at_{n}_1") > 0) & (F.col(f"label_at_{n}_1") == F.col(f"label_at_{n}_2"))
    island = F.col("island_id_1").cast("string")
    far = F.col("beam_normalized_distance")
    scored = seen.select(
        *PAIR, "distance_arcsec", "beam_normalized_distance", "flux_ratio_score", "pixel_support_score",
        g.yes((island == F.col("island_id_2").cast("string")) & ~island.isin("-1", "nan", "None")).alias("same_pybdsf_island"),
        *[same(n).alias(f"connected_at_{n}") for n in ("3sigma", "2p5sigma", "2sigma")],
        F.coalesce(g.clip((F.col("_mean") - 1.0) / 2.0, 0.0, 1.5), F.lit(0.0)).alias("bridge_snr_score"),
        F.when(have, g.clip((2.0 - F.col("_low")) / 4.0, 0.0, 1.5)).otherwise(1.0).alias("valley_penalty"),
        F.coalesce(g.clip(-F.col("_low") / 3.0, 0.0, 2.0), F.lit(0.0)).alias("negative_bowl_penalty"),
        F.coalesce(g.clip(1.0 - turn / 45.0, 0.0, 1.0), F.lit(0.0)).alias("PA_alignment_score"),
        F.coalesce(g.clip((turn - 45.0) / 45.0, 0.0, 1.0), F.lit(0.0)).alias("pa_misalignment_penalty"),
        F.coalesce(F.when(reach > 0, g.clip(1.0 - F.col("distance_arcsec") / F.col("pixel_scale") / reach, 0.0, 1.0)), F.lit(0.0)).alias("gaussian_ellipse_overlap_approx"),
        g.clip(1.0 - far / w.max_pair_beams, 0.0, 1.0).alias("closeness_score"),
        g.clip(F.greatest(F.col("distance_arcsec") / w.max_pair_arcsec, far / w.max_pair_beams) - 0.75, 0.0, 1.5).alias("too_far_penalty"),
        F.when(g.yes((far < 1.5) & (F.col("flux_ratio_score") < 0.2)), 0.5).otherwise(0.0).alias("compact_pair_penalty"),
    )
    bit = lambda c: F.col(c).cast("double")
    score = (
        w.same_island * bit("same_pybdsf_island") + w.conn_3sigma * bit("connected_at_3sigma") + w.conn_2p5sigma * bit("connected_at_2p5sigma")
        + w.conn_2sigma * bit("connected_at_2sigma") + w.bridge * F.col("bridge_snr_score") + w.overlap * F.col("gaussian_ellipse_overlap_approx")
        + w.closeness * F.col("closeness_score") + w.pa_alignment * F.col("PA_alignment_score") + w.pixel_support * F.col("pixel_support_score")
        - w.valley * F.col("valley_penalty") - w.compact_pair * F.col("compact_pair_penalty") - w.too_far * F.col("too_far_penalty")
        - 0.5 * F.col("negative_bowl_penalty") - 0.5 * F.col("pa_misalignment_penalty")
    )
    flags = ("same_pybdsf_island", "connected_at_3sigma", "connected_at_2p5sigma", "connected_at_2sigma")
    shown = ("bridge_snr_score", "gaussian_ellipse_overlap_approx", "PA_alignment_score")
    against = ("valley_penalty", "negative_bowl_penalty", "too_far_penalty", "pa_misalignment_penalty")
    return scored.select(
        "*", score.alias("merge_score"), (score > w.merge_score).alias("merge_decision"),
        tags([(F.col(c), c) for c in flags] + [(F.col(c) > 0.5, c) for c in shown]).alias("positive_evidence"),
        tags([(F.col(c) > 0.5, c) for c in against]).alias("negative_evidence"),
    )


def merge_clusters(components: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with gid and degree, numbered clusters: larger first, then larger smallest index)."""
    joined = cut(edges.filter("merge_decision").select(*PAIR))
    members = cluster(components.select("field_id", "component_index"), joined, ["field_id"], "component_index", "component_index_1", "component_index_2", "gid")
    ends = joined.select("field_id", F.explode(F.array("component_index_1", "component_index_2")).alias("component_index"))
    degree = ends.groupBy("field_id", "component_index").agg(F.count("*").alias("debug_graph_degree"))
    members = cut(members.join(degree, ["field_id", "component_index"], "left").withColumn("debug_graph_degree", F.coalesce("debug_graph_degree", F.lit(0))))
    groups = members.groupBy(*GROUP).agg(F.count("*").alias("n_components"))
    block = -F.floor(F.col("gid") / F.lit(BUCKET_ROWS))
    numbered = running_total(groups, ["field_id"], [-F.col("n_components"), block], [-F.col("n_components"), -F.col("gid")], "group_index")
    return members, numbered.withColumn("merged_source_id", group_name("m"))


STAGE1_EVIDENCE = ("connected_at_3sigma", "connected_at_2p5sigma", "connected_at_2sigma", "ellipse_overlap_score", "bridge_score", "ridge_continuity_score", "pa_alignment_score")


def strongest_evidence(inner: DataFrame, score: str = "merge_score") -> DataFrame:
    """Mean and best score per group and the evidence text of its best edge (first by indices on ties)."""
    if "positive_evidence" in inner.columns:
        text = F.col("positive_evidence")
    else:
        kinds = dict(inner.dtypes)
        text = tags([(F.col(c) if kinds[c] == "boolean" else F.col(c) > 0.5, c) for c in STAGE1_EVIDENCE])
    # Scores equal to nine places are ties; their last bits depend on the order of the sum.
    best = F.struct(F.round(score, 9).alias("r"), (-F.col("component_index_1")).alias("i"), (-F.col("component_index_2")).alias("j"), text.alias("t"))
    return inner.groupBy(*GROUP).agg(F.avg(score).alias("merge_score_mean"), F.max(score).alias("merge_score_max"), F.max(best).alias("_b")).select(
        *GROUP, "merge_score_mean", "merge_score_max", F.col("_b.t").alias("strongest_merge_evidence")
    )


def shape_flags(members: DataFrame) -> DataFrame:
    flux, pa = F.when(g.finite(F.col("total_flux")) > 0, F.col("total_flux")), g.finite(F.col("pa"))
    sums = members.groupBy(*GROUP).agg(
        F.count("*").alias("_n"), F.min(flux).alias("_f0"), F.max(flux).alias("_f1"), F.count(flux).alias("_nf"),
        F.min(pa).alias("_p0"), F.max(pa).alias("_p1"), F.count(pa).alias("_np"),
    )
    spread = F.least(F.col("_p1") - F.col("_p0"), 180.0 - (F.col("_p1") - F.col("_p0")))
    return sums.select(
        *GROUP, (F.col("_n") >= 2).alias("multi_peak_flag"), ((F.col("_n") >= 3) & (F.col("_np") >= 2) & (spread >= 35.0)).alias("bent_flag"),
        ((F.col("_n") >= 2) & ((F.col("_nf") < 2) | (F.col("_f0") / F.col("_f1") > 0.1))).alias("_flux_ok"),
    )


def pixel_sums(members: DataFrame, labels: DataFrame, pixels: DataFrame) -> DataFrame:
    """Image sums over the 2 and 2.5 sigma regions a group touches; each region is summed once."""
    regions = labels.filter(F.col("threshold").isin(WEAK_SIGMA, MIDDLE_SIGMA)).join(pixels, ["field_id", "y", "x"]).groupBy("field_id", "threshold", "label").agg(
        F.sum(g.finite(F.col("value"))).alias("_s"))
    touched = members.select(*GROUP, F.explode(F.array(
        F.struct(F.lit(WEAK_SIGMA).alias("threshold"), F.col("label_at_2sigma").alias("label")),
        F.struct(F.lit(MIDDLE_SIGMA).alias("threshold"), F.col("label_at_2p5sigma").alias("label")),
    )).alias("_t")).select(*GROUP, "_t.threshold", "_t.label").filter("label > 0").distinct()
    return touched.join(regions, ["field_id", "threshold", "label"]).groupBy(*GROUP).agg(
        F.sum(F.when(F.col("threshold") == WEAK_SIGMA, F.col("_s"))).alias("pixel_sum_2sigma"),
        F.sum(F.when(F.col("threshold") == MIDDLE_SIGMA, F.col("_s"))).alias("pixel_sum_2p5sigma"),
    )


def measure_sources(members: DataFrame, numbered: DataFrame, inner: DataFrame, labels: DataFrame, pixels: DataFrame, fields: DataFrame, cfg: Config,
                    score: str = "merge_score") -> DataFrame:
    """Merged-source catalogue; ``members`` are placed components with gid, ``inner`` accepted edges with gid."""
    shaped = measure.shape_groups(members, labels, pixels, fields, cfg, pad_arcsec=10.0)
    islands = members.select(*GROUP, F.col("island_id").cast("string").alias("island")).distinct().groupBy(*GROUP).agg(
        F.array_join(F.sort_array(F.collect_list("island")), ",").alias("island_ids"))
    frame = cut(
        shaped.join(numbered.select(*GROUP, "group_index", "merged_source_id"), GROUP).join(strongest_evidence(inner, score), GROUP, "left")
        .join(shape_flags(members), GROUP).join(pixel_sums(members, labels, pixels), GROUP, "left").join(islands, GROUP)
    )
    mean = F.coalesce("merge_score_mean", F.lit(0.0))
    double = F.col("_flux_ok") & (F.col("LAS_pixel") > 5.0)
    base = g.clip(0.2 + 0.15 * F.col("n_gaussians") + 0.15 * mean, 0.0, 1.0)
    region = F.col("mask_n").isNotNull()
    return frame.select(
        "field_id", "merged_source_id", "gid", F.col("n_gaussians").alias("n_components"), "island_ids", "total_flux_gaussian", "pixel_sum_2sigma", "pixel_sum_2p5sigma",
        F.when(region, F.col("mask_peak")).otherwise(F.col("peak_flux")).alias("peak_flux"), g.format_box(F.col("box")).alias("bounding_box"), "centroid_x", "centroid_y", "ra", "dec",
        "LAS_pixel", "LAS_arcsec", F.when(F.col("mask_n") >= 3, F.col("moment_major")).alias("second_moment_major"), F.when(F.col("mask_n") >= 3, F.col("moment_minor")).alias("second_moment_minor"),
        F.when(F.col("mask_n") >= 3, F.col("group_PA")).alias("second_moment_PA"), mean.alias("merge_score_mean"), F.coalesce("merge_score_max", F.lit(0.0)).alias("merge_score_max"),
        F.coalesce("strongest_merge_evidence", F.lit("")).alias("strongest_merge_evidence"), F.when(double, F.least(F.lit(1.0), base + 0.1)).otherwise(base).alias("merge_confidence"),
        "multi_peak_flag", "bent_flag", double.alias("double_lobe_candidate_flag"),
    )
