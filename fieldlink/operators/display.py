"""Row selection behind review figures: labels, zoom windows, drawn components and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlink.config import Display
from fieldlink.operators.ranking import top_k

KEY = ["field_id"]
NOTED = ("high", "medium", "suspicious", "artifact_risk")


def _top_keys(groups: DataFrame, by: str, k: int, name: str) -> DataFrame:
    """Keys of the k largest values per field; ties go to the smaller group."""
    return top_k(groups.select("field_id", "gid", by), KEY, [F.col(by).desc_nulls_last(), F.col("gid")], k).select("field_id", "gid", F.lit(True).alias(name))


def _chosen(groups: DataFrame, base: Column, tops: list[tuple[str, int]]) -> DataFrame:
    work, pick = groups, base
    for i, (by, k) in enumerate(tops):
        work = work.join(_top_keys(groups, by, k, f"_t{i}"), ["field_id", "gid"], "left")
        pick = pick | F.coalesce(f"_t{i}", F.lit(False))
    return work.filter(pick).select(*groups.columns)


def label_groups(groups: DataFrame, d: Display, score: str = "association_score_mean", by: str = "LAS_arcsec") -> DataFrame:
    """Groups that get a label in an overview, at most ``max_labels`` per field, in drawing order."""
    base = F.lit(True) if d.draw_all_labels or d.draw_singletons else F.coalesce("n_gaussians", F.lit(0)) >= d.label_min_components
    base = base | F.col("association_quality").isin(*NOTED)
    chosen = _chosen(groups, base, [(by, d.max_labels), (score, d.max_labels)])
    order = [F.col(by).desc_nulls_last(), F.col(score).desc_nulls_last(), F.col("n_gaussians").desc(), F.col("gid")]
    total = chosen.groupBy("field_id").agg(F.count("*").alias("n_selected"))
    return top_k(chosen, KEY, order, d.max_labels, "label_rank").join(total, "field_id")


def zoom_groups(groups: DataFrame, d: Display, score: str = "association_score_mean") -> DataFrame:
    base = (F.coalesce("n_gaussians", F.lit(0)) >= d.zoom_min_components) | F.col("association_quality").isin(*NOTED)
    chosen = _chosen(groups, base, [("LAS_arcsec", d.zoom_top_las), (score, d.zoom_top_score)])
    order = [F.col("n_gaussians").desc(), F.col("LAS_arcsec").desc_nulls_last(), F.col(score).desc_nulls_last(), F.col("gid")]
    return top_k(chosen, KEY, order, d.zoom_max, "zoom_rank")


def zoom_window(groups: DataFrame, d: Display) -> DataFrame:
    """Square crop around a group's box, kept inside the image; needs width and height."""
    b = F.col("box")
    side = F.least(F.greatest(F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]) + 2 * d.zoom_padding + 1, F.lit(float(d.zoom_min_size))), F.lit(float(d.zoom_max_size)))
    sized = groups.withColumn("_side", side)
    start = lambda mid, size: F.least(F.greatest(F.rint(mid - F.col("_side") / 2.0), F.lit(0.0)), F.greatest(F.col(size) - F.col("_side"), F.lit(0.0)))
    placed = sized.withColumn("crop_x0", start((b["x0"] + b["x1"]) / 2.0, "width")).withColumn("crop_y0", start((b["y0"] + b["y1"]) / 2.0, "height"))
    return placed.withColumn("crop_x1", F.least(F.col("width").cast("double"), F.col("crop_x0") + F.col("_side"))).withColumn(
        "crop_y1", F.least(F.col("height").cast("double"), F.col("crop_y0") + F.col("_side"))).drop("_side")


def drawn_components(components: DataFrame, d: Display) -> DataFrame:
    return top_k(components, KEY, [F.col("peak_flux").desc_nulls_last(), F.col("component_index")], d.max_components, "draw_rank")


def drawn_edges(edges: DataFrame, d: Display, score: str = "association_score", decision: str = "association_decision") -> DataFrame:
    shown = edges.filter(decision)
    if d.edge_min_score is not None:
        shown = shown.filter(F.col(score) >= d.edge_min_score)
    order = [F.col(score).desc_nulls_last(), F.col("component_index_1"), F.col("component_index_2")]
    return top_k(shown, KEY, order, d.max_edges, "draw_rank")


def stage2_groups(morph: DataFrame, candidates: DataFrame) -> DataFrame:
    """Groups shown in the parent overview: hidden classes stay out unless they matter."""
    hidden = F.col("source_morph_class").isin("point_like", "point_like_or_compact", "compact_resolved_single", "noise_or_artifact")
    for c in ("is_point_like", "hard_compact_veto", "noise_artifact_veto", "isolated_compact_veto"):
        hidden = hidden | F.coalesce(c, F.lit(False))
    ends = candidates.select("field_id", F.explode(F.array("group_index_1", "group_index_2")).alias("group_index")).distinct().withColumn("_member", F.lit(True))
    work = morph.join(ends, ["field_id", "group_index"], "left")
    show = ~hidden | F.col("is_lobe_candidate") | F.col("near_extended_lobe_candidate") | (F.col("association_quality") == "suspicious") | F.coalesce("_member", F.lit(False))
    return work.filter(show).drop("_member")
