"""Per-field roll-ups of edges, groups, seeds and parents, and the run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldlink.operators.ranking import exact_median


def _sized(components: DataFrame) -> DataFrame:
    return components.groupBy("field_id").agg(F.count("*").alias("n_nodes"))


def edge_diagnostics(components: DataFrame, edges: DataFrame, members: DataFrame, score: str = "merge_score", decision: str = "merge_decision") -> DataFrame:
    """Counters of the merge graph per field; ``members`` give the largest component."""
    only = F.col("connected_at_2sigma") & ~F.col("connected_at_2p5sigma") & ~F.col("connected_at_3sigma")
    sums = edges.groupBy("field_id").agg(
        F.count("*").alias("n_candidate_pairs"), F.count_if(decision).alias("n_edges_merged"), F.min(score).alias("merge_score_min"), F.max(score).alias("merge_score_max"),
        *[F.count_if(f"connected_at_{n}").alias(f"connected_at_{n}_count") for n in ("3sigma", "2p5sigma", "2sigma")],
        F.count_if(only).alias("only_2sigma_connected_count"), F.max("distance_arcsec").alias("max_distance_arcsec"),
    )
    largest = members.groupBy("field_id", "gid").agg(F.count("*").alias("n")).groupBy("field_id").agg(F.max("n").alias("max_merged_component_size"))
    joined = (
        _sized(components).join(sums, "field_id", "left").join(exact_median(edges, ["field_id"], score, "merge_score_median"), "field_id", "left")
        .join(exact_median(edges, ["field_id"], "distance_arcsec", "median_distance_arcsec"), "field_id", "left").join(largest, "field_id", "left")
    )
    counts = [c for c in sums.columns if c.endswith("_count") or c.startswith("n_")]
    filled = joined.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in counts else F.col(c) for c in joined.columns])
    empty = F.col("n_candidate_pairs") == 0
    many = (F.col("n_edges_merged") > 0) & (F.col("only_2sigma_connected_count") / F.greatest("n_candidate_pairs", F.lit(1)) > ONLY_2SIGMA_FRACTION)
    warning = F.concat_ws(";", F.when(many, "many_only_2sigma_pairs"), F.when(F.col("max_merged_component_size") > LARGE_COMPONENT, "large_connected_component"))
    return filled.withColumn("warning", F.when(empty, "no_candidate_pairs").otherwise(warning))


def association_diagnostics(components: DataFrame, groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Counters of edges, shape classes and groups per field."""
    kind, on, score = F.col("edge_type"), F.col("association_decision"), "association_score"
    sums = edges.groupBy("field_id").agg(
        F.count("*").alias("n_candidate_pairs"), *[F.count_if(kind == k).alias(f"n_{k}_edges") for k in ("strong", "weak", "rejected")],
        F.count_if(on).alias("n_decision_edges"), F.count_if(on & F.col("only_2sigma_connected")).alias("n_only_2sigma_edges"),
        F.count_if("unresolved_pair_veto").alias("n_unresolved_pair_veto"), F.min(score).alias("association_score_min"), F.max(score).alias("association_score_max"),
    )
    classes = components.groupBy("field_id").agg(
        F.count("*").alias("n_nodes"), *[F.count_if(F.col("morphology_class") == k).alias(f"n_{k}") for k in ("unresolved", "marginally_resolved", "resolved", "artifact_like")])
    sizes = groups.groupBy("field_id").agg(F.count("*").alias("n_association_groups"), F.max("n_gaussians").alias("max_group_size"))
    joined = classes.join(sums, "field_id", "left").join(exact_median(edges, ["field_id"], score, "association_score_median"), "field_id", "left").join(sizes, "field_id", "left")
    counts = [c for c in joined.columns if c.startswith("n_")]
    filled = joined.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in counts else F.col(c) for c in joined.columns])
    # Without candidate pairs the class counters are not reported.
    empty = F.col("n_candidate_pairs") == 0
    shapes = ("n_unresolved", "n_marginally_resolved", "n_resolved", "n_artifact_like")
    share = F.greatest(F.lit(1), F.floor(ONLY_2SIGMA_FRACTION * F.greatest("n_decision_edges", F.lit(1))))
    warning = F.concat_ws(";", F.when(F.col("n_only_2sigma_edges") > share, "many_only_2sigma_associations"), F.when(F.col("max_group_size") > 20, "large_association_group"))
    return filled.select(*[F.when(empty, 0).otherwise(F.col(c)).alias(c) if c in shapes else F.col(c) for c in filled.columns],
                         F.when(empty, "no_candidate_pairs").otherwise(warning).alias("warning"))


def parent_diagnostics(morph: DataFrame, edges: DataFrame, log: DataFrame | None) -> DataFrame:
    """Counters over endpoint classes, pair outcomes and host lookups per field."""
    klass = F.col("source_morph_class")
    table = morph.groupBy("field_id").agg(
        F.count("*").alias("n_total_local_groups"),
        *[F.count_if(c).alias(f"n_{c}") for c in ("hard_point_source_veto", "hard_compact_veto", "noise_artifact_veto", "isolated_compact_veto", "near_extended_lobe_candidate")],
        F.count_if(klass.isin("point_like", "point_like_or_compact", "noise_or_artifact")).alias("n_point_like_hidden"),
        F.count_if(klass == "resolved_single").alias("n_resolved_single"), F.count_if(klass == "lobe_candidate").alias("n_lobe_candidate"),
        F.count_if(klass.isin("artifact_risk", "noise_or_artifact")).alias("n_artifact_risk"),
    )
    q, why, acc = F.col("parent_candidate_quality"), F.col("rejection_reason"), F.col("parent_acceptance_class")
    ends = {"point_source": "hard_point_source_veto", "compact": "hard_compact_veto", "noise_artifact": "noise_artifact_veto", "endpoint_veto_final": "endpoint_veto_final"}
    either = {k: F.col(f"a.{v}") | F.col(f"b.{v}") for k, v in ends.items()}
    listed, geometry = q.isin("high", "medium", "needs_host_check", "suspicious"), F.col("double_lobe_geometry_pass")
    vetoed = why == "endpoint_vetoed_or_not_extended_for_near_boundary_rescue"
    label = lambda k, tail: "endpoint_veto_final" if k == "endpoint_veto_final" else f"{k}_endpoint"
    per = edges.groupBy("field_id").agg(
        F.count("*").alias("n_parent_pairs_considered"), F.count_if("near_boundary_pair").alias("n_near_boundary_pair"),
        F.count_if("near_boundary_rescue_applied").alias("n_near_boundary_rescue_applied"),
        F.count_if(why == "near_boundary_but_no_extended_or_bridge_support").alias("n_rejected_near_boundary_no_support"),
        F.count_if(geometry).alias("n_double_lobe_geometry_pass"), F.count_if(why == "lobe_peak_host_contradiction").alias("n_lobe_peak_host_contradiction"),
        F.count_if(F.col("host_evidence") == "supports_double_lobe").alias("n_midpoint_host_supports"),
        F.count_if((acc == "accepted_high_confidence_parent") & (q == "high")).alias("n_final_candidates"),
        F.count_if(acc == "accepted_high_confidence_parent").alias("n_accepted_before_quality_filter"),
        *[F.count_if(acc == c).alias(f"n_{c}") for c in ("accepted_high_confidence_parent", "geometry_only_visual_candidate", "rejected_parent_candidate")],
        F.count_if(F.col("conflict_resolution_status") == "removed").alias("n_parent_conflict_removed"),
        *[F.count_if(q == c).alias(f"n_parent_{c}") for c in ("high", "medium", "needs_host_check", "suspicious")],
        F.count_if(listed & F.col("parent_LAS_beam").isNotNull()).alias("n_parent_union_boxes"),
        *[F.count_if(vetoed & c).alias(f"n_{label(k, '')}_rejected") for k, c in either.items()],
        *[F.count_if(geometry & c).alias(f"n_geometry_pass_{label(k, '')}") for k, c in either.items()],
        *[F.count_if(listed & c).alias(f"n_parent_candidate_{label(k, '')}") for k, c in either.items()],
        *[F.count_if(why == c).alias(f"n_rejected_{c}") for c in ("point_like_endpoint", "artifact_veto", "not_symmetric_lobe_pair", "lobe_peak_host_contradiction")],
    )
    out = table.join(per, "field_id", "left")
    if log is not None:
        cat = F.col("catalogue")
        out = out.join(log.groupBy("field_id").agg(F.count("*").alias("n_host_queries"), F.count_if(cat == "catwise2020").alias("n_catwise_queries"),
                                                   F.count_if(cat == "allwise").alias("n_allwise_fallback_queries")), "field_id", "left")
    else:
        out = out.select("*", *[F.lit(0).alias(c) for c in ("n_host_queries", "n_catwise_queries", "n_allwise_fallback_queries")])
    return out.select(*[c if c == "field_id" else F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns])


def run_summary(diagnostics: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Sums of the per-field counters over the run."""
    counters = [c for c in diagnostics.columns if c.startswith("n_")]
    total = diagnostics.agg(F.count("*").alias("n_fields"), *[F.sum(c).alias(c) for c in counters])
    if status is None:
        return total
    return total.crossJoin(status.agg(F.count_if(F.lower("status") == "done").alias("n_fields_done")))


# Fixed values of the quality warnings.
ONLY_2SIGMA_FRACTION = 0.5
LARGE_COMPONENT = 20
