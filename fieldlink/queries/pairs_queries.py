"""Spatial pairs and component shape."""

from pyspark.sql import functions as F

from fieldlink import fixtures as fx
from fieldlink.functions import geometry as g
from fieldlink.functions.morphology import with_morphology
from fieldlink.operators import pairs
from fieldlink.queries.base import cte, query, r, rounded

cte("tilted", """
SELECT *, sqrt(pow((dx*cos(radians(60)) + dy*sin(radians(60)))/8, 2) + pow((dy*cos(radians(60)) - dx*sin(radians(60)))/5, 2)) AS distance_beam,
       sqrt(dx*dx + dy*dy) AS distance_arcsec
FROM (SELECT a.field_id, a.component_index AS component_index_1, b.component_index AS component_index_2,
             b.x - a.x AS dx, b.y - a.y AS dy
      FROM components a JOIN components b ON a.field_id = b.field_id AND a.component_index < b.component_index
       AND abs(b.x - a.x) <= 120 AND abs(b.y - a.y) <= 120)""", "components")


@query("elliptical_pairs", f"""
SELECT field_id, component_index_1, component_index_2, {r('distance_arcsec', 'distance_arcsec')}, {r('distance_beam', 'distance_beam')}
FROM tilted WHERE distance_arcsec <= 120 AND distance_beam <= 15""", ("tilted",))
def elliptical_pairs(spark, sf):
    found = pairs.candidate_pairs(fx.components(spark, sf), fx.TILTED)
    return rounded(found.select("field_id", "component_index_1", "component_index_2", "distance_arcsec", "distance_beam"))


@query("beam_axis_components", f"""
SELECT field_id, component_index_1, component_index_2,
       {r('abs(dx*cos(radians(60)) + dy*sin(radians(60)))', 'along_arcsec')},
       {r('abs(dy*cos(radians(60)) - dx*sin(radians(60)))', 'across_arcsec')},
       {r('sqrt(pow(8*cos(t - radians(60)), 2) + pow(5*sin(t - radians(60)), 2))', 'beam_width')}
FROM (SELECT *, atan2(dy, dx) AS t FROM tilted) WHERE distance_arcsec <= 120 AND distance_beam <= 15 AND distance_arcsec > 0""",
       ("tilted",))
def beam_axis_components(spark, sf):
    found = pairs.candidate_pairs(fx.components(spark, sf), fx.TILTED).filter("distance_arcsec > 0")
    dx, dy = F.col("x_2") - F.col("x_1"), F.col("y_2") - F.col("y_1")
    along, across = g.along_across_beam(dx, dy, fx.TILTED.beam)
    return rounded(found.select(
        "field_id", "component_index_1", "component_index_2",
        F.abs(along).alias("along_arcsec"), F.abs(across).alias("across_arcsec"),
        g.beam_projection(g.direction(dx, dy), fx.TILTED.beam).alias("beam_width"),
    ))


@query("circular_pairs", f"""
SELECT a.field_id, a.component_index AS component_index_1, b.component_index AS component_index_2,
       {r('sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))', 'distance_arcsec')}
FROM components a JOIN components b ON a.field_id = b.field_id AND a.component_index < b.component_index
WHERE sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= 90""", ("components",))
def circular_pairs(spark, sf):
    found = pairs.legacy_candidate_pairs(fx.components(spark, sf), fx.WIDE)
    return rounded(found.select("field_id", "component_index_1", "component_index_2", "distance_arcsec"))


@query("complete_pairs", """
SELECT a.field_id, a.component_index AS component_index_1, b.component_index AS component_index_2,
       CAST(NULL AS DOUBLE) AS merge_score, false AS merge_decision
FROM pixel_components a JOIN pixel_components b ON a.field_id = b.field_id AND a.component_index < b.component_index""",
       ("pixel_components",))
def complete_pairs(spark, sf):
    return pairs.complete_pairs(fx.pixel_components(spark, sf))


SHAPE_COLUMNS = ["morphology_class", "classification_reason", "resolved_significance", "resolved_probability",
                 "beam_like_score", "intrinsic_major", "intrinsic_minor", "pa_weight", "effective_angle"]


def morphology_sql(source: str, bmaj: float, bmin: float, angle: float) -> str:
    """Shape rules in SQL for a beam with a given pixel angle."""
    return f"""
SELECT *, CASE morphology_class WHEN 'resolved' THEN greatest(raw, 0.75)
            WHEN 'marginally_resolved' THEN least(greatest(raw, 0.25), 0.75)
            WHEN 'unresolved' THEN least(raw, 0.25) ELSE raw END AS resolved_probability,
       CASE morphology_class WHEN 'resolved' THEN 1.0 WHEN 'marginally_resolved' THEN 0.35 WHEN 'unresolved' THEN 0.0
            ELSE CASE WHEN beam_like_score >= 0.7 THEN 0.0 ELSE 0.15 END END AS pa_weight,
       (90 - CASE WHEN morphology_class IN ('resolved','marginally_resolved') THEN coalesce(dc_pa, pa) ELSE pa END + 360) % 180 AS effective_angle
FROM (SELECT *, least(resolved_significance/3, 1.0) AS raw,
  CASE WHEN dec AND (fa >= 0.45 OR fb >= 0.35) THEN 'resolved' WHEN dec AND fa >= 0.2 THEN 'marginally_resolved'
       WHEN dec THEN 'unresolved' WHEN fa >= 0.35 OR fb >= 0.35 THEN 'resolved' WHEN fa >= 0.15 THEN 'marginally_resolved'
       WHEN beam_like_score >= 0.7 THEN 'unresolved' ELSE 'unknown' END AS morphology_class,
  CASE WHEN dec AND (fa >= 0.45 OR fb >= 0.35) THEN 'deconvolved_major_significant' WHEN dec AND fa >= 0.2 THEN 'deconvolved_axes_marginal'
       WHEN dec THEN 'deconvolved_axes_not_significant' WHEN fa >= 0.35 OR fb >= 0.35 THEN 'observed_covariance_exceeds_beam'
       WHEN fa >= 0.15 THEN 'observed_covariance_marginally_exceeds_beam'
       WHEN beam_like_score >= 0.7 THEN 'beam_like_within_errors' ELSE 'no_reliable_deconvolved_axes' END AS classification_reason
 FROM (SELECT *, greatest(fa, fb) / CASE WHEN dec THEN 0.2 ELSE 0.15 END AS resolved_significance
  FROM (SELECT *, intrinsic_major/{bmaj} AS fa, intrinsic_minor/{bmin} AS fb,
    0.4*exp(-abs(ln((big/small)/({bmaj}/{bmin})))/0.35)
    + 0.4*sqrt(exp(-abs(ln(big/{bmaj}))/0.35)*exp(-abs(ln(small/{bmin}))/0.35))
    + 0.2*greatest(0, 1 - abs((90 - turned - {angle} + 450 + 360) % 180 - 90)/20) AS beam_like_score
   FROM (SELECT *,
     CASE WHEN dec THEN greatest(dc_maj, dc_min) ELSE 2*sqrt(2*ln(2))*sqrt(greatest(mid + half, 0)) END AS intrinsic_major,
     CASE WHEN dec THEN least(dc_maj, dc_min) ELSE 2*sqrt(2*ln(2))*sqrt(greatest(mid - half, 0)) END AS intrinsic_minor
    FROM (SELECT *, (k00 + k11)/2 AS mid, sqrt(pow((k00 - k11)/2, 2) + k01*k01) AS half
     FROM (SELECT *, v1*cos(t)*cos(t) + v2*sin(t)*sin(t) - w1*pow(cos(b),2) - w2*pow(sin(b),2) AS k00,
                  (v1 - v2)*cos(t)*sin(t) - (w1 - w2)*cos(b)*sin(b) AS k01,
                  v1*sin(t)*sin(t) + v2*cos(t)*cos(t) - w1*pow(sin(b),2) - w2*pow(cos(b),2) AS k11
      FROM (SELECT *, coalesce(dc_maj > 0 AND dc_min > 0, false) AS dec, greatest(maj, min) AS big, least(maj, min) AS small,
                   CASE WHEN min > maj THEN pa + 90 ELSE pa END AS turned,
                   radians(90 - CASE WHEN min > maj THEN pa + 90 ELSE pa END) AS t, radians({angle}) AS b,
                   pow(greatest(maj, min), 2)/(8*ln(2)) AS v1, pow(least(maj, min), 2)/(8*ln(2)) AS v2,
                   pow({bmaj}, 2)/(8*ln(2)) AS w1, pow({bmin}, 2)/(8*ln(2)) AS w2
       FROM {source})))))))"""


cte("shapes", morphology_sql("(SELECT * EXCLUDE (dec), dec AS decl FROM components)", 6.0, 6.0, 90.0), "components")
cte("pixel_shapes", morphology_sql("pixel_components", 2.0, 2.0, 90.0), "pixel_components")
cte("tilted_shapes", morphology_sql("(SELECT * EXCLUDE (dec), dec AS decl FROM components)", 8.0, 5.0, 60.0), "components")


@query("component_morphology", f"""
SELECT field_id, component_index, morphology_class, classification_reason, {r('resolved_significance','resolved_significance')},
       {r('resolved_probability','resolved_probability')}, {r('beam_like_score','beam_like_score')}, {r('intrinsic_major','intrinsic_major')},
       {r('intrinsic_minor','intrinsic_minor', 4)}, {r('pa_weight','pa_weight')}, {r('effective_angle','effective_angle')} FROM tilted_shapes""",
       ("tilted_shapes",))
def component_morphology(spark, sf):
    shaped = with_morphology(fx.components(spark, sf), fx.TILTED)
    out = shaped.select("field_id", "component_index", *SHAPE_COLUMNS)
    return rounded(out.withColumn("intrinsic_minor", F.round("intrinsic_minor", 4)))
