"""Pair evidence, scores and classes."""

from pyspark.sql import functions as F

from fieldlink import fixtures as fx
from fieldlink.functions.morphology import with_morphology
from fieldlink.lineage import cut
from fieldlink.operators import evidence, raster
from fieldlink.queries.base import cte, query, r, rounded, shared
from fieldlink.queries.raster_queries import snr as snr_of

PAIR = evidence.PAIR

# ---- geometry and score, in SQL, for any beam --------------------------------


def geometry_sql(source: str, bmaj: float, bmin: float, angle: float, radius: float) -> str:
    size = f"sqrt({bmaj}*{bmin})"
    return f"""
SELECT *, pw1*pw2*raw_pa AS pa_score, coalesce(sqrt(ratio), 0) AS continuity,
  (pw1*pw2*raw_pa + line_pa)/2 AS flow
FROM (SELECT *,
  greatest(0, least(1, 1 - db/15)) AS closeness,
  CASE WHEN o1 > 0 AND o2 > 0 THEN greatest(0, least(1, 1 - (d - (o1+o2)/2)/width)) ELSE 0 END AS seen_overlap,
  CASE WHEN c1 IN ('resolved','marginally_resolved') AND c2 IN ('resolved','marginally_resolved') AND i1 > 0 AND i2 > 0
       THEN greatest(0, least(1, 1 - (d - (i1+i2)/2)/width)) ELSE 0 END AS overlap_score,
  least(b1, b2)/greatest(b1, b2) AS similarity,
  greatest(0, 1 - abs((e1 - e2 + 450) % 180 - 90)/45) AS raw_pa,
  (pw1*greatest(0, 1 - coalesce(abs((e1 - turn + 450) % 180 - 90), 90)/45) + pw2*greatest(0, 1 - coalesce(abs((e2 - turn + 450) % 180 - 90), 90)/45))/2 AS line_pa,
  CASE WHEN f1 > 0 AND f2 > 0 THEN least(f1, f2)/greatest(f1, f2) END AS ratio
 FROM (SELECT *, CASE WHEN d > 0 THEN sqrt(pow({bmaj}*cos(radians(turn - {angle})), 2) + pow({bmin}*sin(radians(turn - {angle})), 2))
                      ELSE sqrt(({bmaj}*{bmaj} + {bmin}*{bmin})/2) END AS width
  FROM (SELECT a.field_id, a.component_index AS i, b.component_index AS j, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2,
    sqrt(pow(b.x-a.x,2) + pow(b.y-a.y,2)) AS d,
    sqrt(pow(((b.x-a.x)*cos(radians({angle})) + (b.y-a.y)*sin(radians({angle})))/{bmaj}, 2)
       + pow(((b.y-a.y)*cos(radians({angle})) - (b.x-a.x)*sin(radians({angle})))/{bmin}, 2)) AS db,
    CASE WHEN a.x <> b.x OR a.y <> b.y THEN (degrees(atan2(b.y-a.y, b.x-a.x)) + 180) % 180 END AS turn,
    a.maj AS o1, b.maj AS o2, a.intrinsic_major AS i1, b.intrinsic_major AS i2, a.morphology_class AS c1, b.morphology_class AS c2,
    coalesce(CASE WHEN a.dc_maj > 0 THEN a.dc_maj END, a.maj, {size}) AS b1, coalesce(CASE WHEN b.dc_maj > 0 THEN b.dc_maj END, b.maj, {size}) AS b2,
    a.pa_weight AS pw1, b.pa_weight AS pw2, a.effective_angle AS e1, b.effective_angle AS e2, a.total_flux AS f1, b.total_flux AS f2,
    a.beam_like_score AS s1, b.beam_like_score AS s2{{extra}}
   FROM {source} a JOIN {source} b ON a.field_id = b.field_id AND a.component_index < b.component_index
    AND abs(b.x-a.x) <= {radius} AND abs(b.y-a.y) <= {radius})
  WHERE d <= {radius} AND db <= 15))"""


cte("wide_geometry", geometry_sql("shapes", 6.0, 6.0, 90.0, 90.0).replace("{extra}", ""), "shapes")
cte("wide_edges", """
SELECT *, CASE WHEN veto THEN 'rejected' WHEN score >= 3 THEN 'strong' WHEN score >= 2 THEN 'weak' ELSE 'rejected' END AS edge_type
FROM (SELECT *, CASE WHEN veto THEN least(total, -1) ELSE total END AS score
 FROM (SELECT *, closeness + overlap_score + 0.8*pa_score + 0.5*continuity + 0.6*flow AS total,
   (c1 = 'unresolved' OR s1 >= 0.7) AND (c2 = 'unresolved' OR s2 >= 0.7) AS veto FROM wide_geometry))""", "wide_geometry")

SHARED = """, a.label_at_3sigma AS l3, b.label_at_3sigma AS m3, a.area_at_3sigma AS a3, a.label_at_2p5sigma AS l25, b.label_at_2p5sigma AS m25,
 a.area_at_2p5sigma AS a25, a.label_at_2sigma AS l2, b.label_at_2sigma AS m2, a.area_at_2sigma AS a2, a.snr_at AS p1, b.snr_at AS p2"""
cte("small_geometry", geometry_sql("placed", 2.0, 2.0, 90.0, 30.0).replace("{extra}", SHARED), "placed")

# Lines, corridors and the two-source residual of the small rasters (beam 2, scale 1).
cte("line_agg", """
SELECT field_id, i, j, avg(snr) AS lm, min(snr) AS lmin, max(snr) AS lmax, avg(CAST(snr >= 2 AS DOUBLE)) AS lw, avg(CAST(snr >= 2.5 AS DOUBLE)) AS lmid,
 avg(CAST(snr < -1 AS DOUBLE)) AS lneg, count(*) AS ln, median(jump) AS jump
FROM (SELECT *, abs(snr - lag(snr) OVER (PARTITION BY field_id, i, j ORDER BY k)) AS jump FROM line_snr) GROUP BY 1, 2, 3""", "line_snr")
cte("bridge_agg", "SELECT field_id, i, j, count(*) AS nb, count(*) FILTER (snr >= 2) AS nbw, avg(snr) AS bm, max(snr) AS bx FROM corridor GROUP BY 1, 2, 3", "corridor")
MODEL = """g.snr - greatest(coalesce(g1.snr, 0), 0)*exp(-0.5*8*ln(2)*(pow(g.x-p.x1,2)+pow(g.y-p.y1,2))/4)
              - greatest(coalesce(g2.snr, 0), 0)*exp(-0.5*8*ln(2)*(pow(g.x-p.x2,2)+pow(g.y-p.y2,2))/4)"""
ENDS = """LEFT JOIN snr g1 ON g1.field_id = p.field_id AND g1.y = round_even(p.y1, 0) AND g1.x = round_even(p.x1, 0)
LEFT JOIN snr g2 ON g2.field_id = p.field_id AND g2.y = round_even(p.y2, 0) AND g2.x = round_even(p.x2, 0)"""
cte("resid_agg", f"""
SELECT field_id, i, j, count(*) AS nr, count(*) FILTER (v >= 2.5) AS nrp, avg(v) AS rm, max(v) AS rx, sum(greatest(v, 0)) AS rs
FROM (SELECT p.field_id, p.i, p.j, {MODEL} AS v FROM corridor p JOIN snr g ON g.field_id = p.field_id AND g.y = p.y AND g.x = p.x {ENDS}
      WHERE p.len > 0 AND p.along*p.len >= 1.2 AND p.along*p.len <= greatest(p.len - 1.2, 1.2)) GROUP BY 1, 2, 3""", "corridor", "snr")
cte("resid_line", f"""
SELECT p.field_id, p.i, p.j, p.k, {MODEL} AS v
FROM (SELECT *, greatest(0, floor(least(x1, x2)) - 7) AS ox, greatest(0, floor(least(y1, y2)) - 7) AS oy FROM line_spots WHERE len > 0) p
JOIN snr g ON g.field_id = p.field_id AND g.y = round_even(p.sy - p.oy, 0) + p.oy AND g.x = round_even(p.sx - p.ox, 0) + p.ox {ENDS}""", "line_spots", "snr")
cte("resid_line_agg", """
SELECT field_id, i, j, avg(CAST(v >= 2.5 AS DOUBLE)) AS rl, (avg(CAST(v >= 2 AS DOUBLE)) + avg(CAST(v >= 2.5 AS DOUBLE)) + avg(CAST(v >= 3 AS DOUBLE)))/3 AS rp,
 coalesce(max(run), 0)/count(*) AS rc
FROM (SELECT *, CASE WHEN v >= 2.5 THEN count(*) OVER (PARTITION BY field_id, i, j, v >= 2.5, isl) END AS run
 FROM (SELECT *, row_number() OVER (PARTITION BY field_id, i, j ORDER BY k) - row_number() OVER (PARTITION BY field_id, i, j, v >= 2.5 ORDER BY k) AS isl
  FROM (SELECT *, row_number() OVER (PARTITION BY field_id, i, j ORDER BY k) AS q, count(*) OVER (PARTITION BY field_id, i, j) AS n FROM resid_line)
  WHERE n <= 2 OR (q > 1 AND q < n))) GROUP BY 1, 2, 3""", "resid_line")
cte("paths", """
SELECT *, CASE WHEN nr > 0 THEN 0.3*greatest(0, least(1, (rx - 2.5)/2)) + 0.2*greatest(0, least(1, (rm - 1.25)/2.5)) + 0.2*least(1, nrp/beam_pix/0.25)
   + 0.2*least(1, rl/0.45) + 0.1*rc ELSE 0 END AS residual_score
FROM (SELECT q.field_id, q.i, q.j, q.d, pi()*4/(4*ln(2)) AS beam_pix,
  least(1.5, (0.35*coalesce(lw, 0) + 0.25*coalesce(lmid, 0) + 0.25*least(1, area/greatest(q.d, 1)/2/0.8) + 0.15*greatest(0, least(1, coalesce(bm, lm) - 2)))
   * CASE WHEN q.d/2 >= 1 THEN 1 ELSE 0.7 END) AS bridge_score, area, area/greatest(q.d, 1)/2 AS bridge_width, coalesce(bm, lm, 0) AS bridge_mean,
  coalesce(nr, 0) AS nr, nrp, rm, rx, rs, coalesce(rl, 0) AS rl, coalesce(rc, 0) AS rc, coalesce(rp, 0) AS rp,
  coalesce(1 - lw, 1) AS gap, coalesce(lm, 0) AS ridge_mean, coalesce(lmin, 0) AS lmin, coalesce(lneg, 0) AS lneg, smooth,
  CASE WHEN ln > 0 THEN least(1.5, (0.55*lw + 0.3*lmid + 0.15*smooth)*(1 - 0.5*(1 - lw))) ELSE 0 END AS ridge_score
 FROM (SELECT g.*, l.lm, l.lmin, l.lw, l.lmid, l.lneg, l.ln, b.nb, b.bm, coalesce(b.nbw, l.lw*l.ln, 0) AS area,
   CASE WHEN l.ln >= 3 THEN 1/(1 + l.jump/(abs(l.lm) + 1)) WHEN l.ln > 0 THEN 0.5 ELSE 0 END AS smooth, r.nr, r.nrp, r.rm, r.rx, r.rs, rl.rl, rl.rp, rl.rc
  FROM (SELECT field_id, i, j, len AS d FROM small_pairs) g LEFT JOIN line_agg l USING (field_id, i, j) LEFT JOIN bridge_agg b USING (field_id, i, j)
  LEFT JOIN resid_agg r USING (field_id, i, j) LEFT JOIN resid_line_agg rl USING (field_id, i, j)) q)""",
    "small_pairs", "line_agg", "bridge_agg", "resid_agg", "resid_line_agg")
cte("penalised", """
SELECT *, greatest(CASE WHEN ratio < 0.08 AND (bowl > 0.2 OR valley > 0.8) THEN 0.7 ELSE 0 END,
   CASE WHEN db < 6 AND bridge_score < 0.2 AND ridge_score < 0.2 AND greatest(pa_score, line_pa) < 0.25 THEN 0.4 ELSE 0 END) AS sidelobe
FROM (SELECT *, greatest(0, least(1.5, (2 - lmin)/2.3)) AS valley, CAST(only2 AS DOUBLE) AS thin,
  least(2, greatest(0, least(2, (-lmin - 0.3)/2.2)) + lneg) AS bowl,
  greatest(greatest(0, least(2, (db/15 - 0.7)/0.3)), CASE WHEN db > 8.25 AND CAST(bridge_score >= 0.45 AS INT) + CAST(ridge_score >= 0.45 AS INT)
    + CAST(pa_score >= 0.55 AS INT) + CAST(line_pa >= 0.55 AS INT) < 2 THEN 1 ELSE 0 END) AS far_pen,
  greatest(greatest(0, least(1.5, (share - 0.05)/0.1)), CASE WHEN area2 > greatest(30, 4*pow(greatest(db, 1), 2)) AND only2 THEN 1 ELSE 0 END) AS swallow
 FROM (SELECT *, con2 AND NOT con25 AND NOT con3 AS only2, CASE WHEN con2 THEN a2/960.0 ELSE 0 END AS share,
   CASE WHEN con2 THEN a2 ELSE 0 END/beam_pix AS area2,
   greatest(CASE WHEN con2 THEN a2 ELSE 0 END, CASE WHEN con25 THEN a25 ELSE 0 END, CASE WHEN con3 THEN a3 ELSE 0 END)/beam_pix AS envelope
  FROM (SELECT g.*, p.* EXCLUDE (field_id, i, j, d), l3 > 0 AND l3 = m3 AS con3, l25 > 0 AND l25 = m25 AS con25, l2 > 0 AND l2 = m2 AS con2
   FROM small_geometry g JOIN paths p USING (field_id, i, j))))""", "small_geometry", "paths")
cte("small_edges", """
SELECT *, CASE WHEN veto THEN 'rejected' WHEN score >= 3 THEN 'strong' WHEN score >= 2 THEN 'weak' ELSE 'rejected' END AS edge_type,
 concat_ws(',', CASE WHEN only2 THEN 'only_2sigma' END, CASE WHEN bowl >= 0.5 THEN 'negative_bowl' END, CASE WHEN sidelobe >= 0.5 THEN 'sidelobe_risk' END,
  CASE WHEN swallow >= 0.5 THEN 'large_mask_swallow' END, CASE WHEN far_pen >= 1 THEN 'too_far' END) AS flags
FROM (SELECT *, CASE WHEN veto THEN least(capped, -1) ELSE capped END AS score
 FROM (SELECT *, CASE WHEN only2 AND NOT (bridge_score >= 0.55 OR residual_score >= 0.55 OR ridge_score >= 0.55 OR overlap_score >= 0.75) THEN least(total, 0.5) ELSE total END AS capped,
   (c1 = 'unresolved' OR s1 >= 0.7) AND (c2 = 'unresolved' OR s2 >= 0.7) AND NOT (con3 OR (con25 AND envelope >= 1)
     OR (bridge_score >= 0.7 AND bridge_width >= 0.56 AND d/2 >= 0.7) OR residual_score >= 0.55) AS veto
  FROM (SELECT *, closeness + overlap_score + 0.8*pa_score + 1.5*CAST(con3 AS INT) + 0.6*CAST(con25 AS INT) + 1.2*bridge_score + 0.96*residual_score + 1.2*ridge_score
    + 0.5*continuity + 0.6*flow - 1.5*valley - thin - 1.2*bowl - 1.5*sidelobe - 2*far_pen - 1.5*swallow AS total FROM penalised)))""", "penalised")


def wide_edges(spark, sf):
    return evidence.score_edges(with_morphology(fx.components(spark, sf), fx.WIDE), None, fx.WIDE)


@shared
def placed_components(spark, sf):
    """Small-raster components with shape, S/N and labels; also the S/N and labels themselves."""
    fields = fx.fields(spark, sf)
    snr = cut(snr_of(spark, sf))
    labels, removed = raster.segment(snr, fields, fx.SMALL.segmentation)
    labels = cut(labels)
    comps = with_morphology(fx.pixel_components(spark, sf), fx.SMALL)
    comps = raster.at_points(comps, snr, labels, fx.SMALL.segmentation, "component_index")
    return cut(comps.join(fields.select("field_id", "width", "height"), "field_id")), snr, labels


def small_edges(spark, sf):
    comps, snr, _ = placed_components(spark, sf)
    return evidence.score_edges(comps, snr, fx.SMALL)


@query("pair_geometry_scores", f"""
SELECT field_id, i AS component_index_1, j AS component_index_2, {r('closeness', 'closeness_score')}, {r('overlap_score', 'ellipse_overlap_score', 5)},
 {r('seen_overlap', 'observed_ellipse_overlap_score')}, {r('similarity', 'size_similarity_score')}, {r('pa_score', 'pa_alignment_score')},
 {r('line_pa', 'line_to_pa_alignment_score')}, {r('ratio', 'flux_ratio')}, {r('flow', 'flow_alignment_score')}, {r('score', 'association_score', 5)}, edge_type
FROM wide_edges""", ("wide_edges",))
def pair_geometry_scores(spark, sf):
    keep = ["closeness_score", "observed_ellipse_overlap_score", "size_similarity_score", "pa_alignment_score",
            "line_to_pa_alignment_score", "flux_ratio", "flow_alignment_score"]
    edges = wide_edges(spark, sf)
    return rounded(edges.select(*PAIR, *keep, F.round("ellipse_overlap_score", 5).alias("ellipse_overlap_score"),
                                F.round("association_score", 5).alias("association_score"), "edge_type"))


@query("bridge_and_ridge", f"""
SELECT field_id, i AS component_index_1, j AS component_index_2, {r('bridge_score', 'bridge_score', 4)}, {r('bridge_width', 'bridge_width_beam', 4)},
 {r('bridge_mean', 'bridge_mean_snr', 4)}, {r('residual_score', 'residual_bridge_score', 4)}, {r('CASE WHEN nr > 0 THEN rl ELSE 0 END', 'residual_bridge_length_fraction', 4)},
 {r('CASE WHEN nr > 0 THEN rc ELSE 0 END', 'residual_bridge_contiguous_fraction', 4)}, {r('CASE WHEN nr > 0 THEN rp ELSE 0 END', 'multi_threshold_bridge_persistence', 4)},
 {r('gap', 'ridge_gap_fraction', 4)}, {r('ridge_score', 'ridge_continuity_score', 4)}, {r('smooth', 'ridge_gradient_smoothness', 4)} FROM paths""", ("paths",))
def bridge_and_ridge(spark, sf):
    comps, snr, _ = placed_components(spark, sf)
    edges = evidence.geometric_evidence(evidence.candidate_edges(comps, fx.SMALL), fx.SMALL)
    found = evidence.path_evidence(edges, snr, fx.SMALL)
    return rounded(found.select(
        *PAIR, "bridge_score", "bridge_width_beam", "bridge_mean_snr", "residual_bridge_score", "residual_bridge_length_fraction",
        "residual_bridge_contiguous_fraction", "multi_threshold_bridge_persistence", "ridge_gap_fraction", "ridge_continuity_score",
        "ridge_gradient_smoothness"), 4)


@query("association_edges", f"""
SELECT field_id, i AS component_index_1, j AS component_index_2, con3 AS connected_at_3sigma, con25 AS connected_at_2p5sigma, only2 AS only_2sigma_connected,
 {r('envelope', 'common_envelope_area_beam', 4)}, {r('valley', 'deep_valley_penalty', 4)}, {r('bowl', 'negative_bowl_penalty', 4)}, {r('sidelobe', 'sidelobe_risk_penalty', 4)},
 {r('far_pen', 'too_far_penalty', 4)}, {r('swallow', 'large_mask_swallow_penalty', 4)}, veto AS unresolved_pair_veto, {r('score', 'association_score', 4)}, edge_type,
 flags AS artifact_risk_flags FROM small_edges""", ("small_edges",))
def association_edges(spark, sf):
    return rounded(small_edges(spark, sf).select(
        *PAIR, "connected_at_3sigma", "connected_at_2p5sigma", "only_2sigma_connected", "common_envelope_area_beam", "deep_valley_penalty",
        "negative_bowl_penalty", "sidelobe_risk_penalty", "too_far_penalty", "large_mask_swallow_penalty", "unresolved_pair_veto",
        "association_score", "edge_type", "artifact_risk_flags"), 4)
