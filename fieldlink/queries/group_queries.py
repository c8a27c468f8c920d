"""Clustering, group numbering and measurement."""

from pyspark.sql import functions as F

from fieldlink import fixtures as fx
from fieldlink.lineage import cut, measured_joins
from fieldlink.operators import cluster, measure
from fieldlink.operators.graph import cluster as graph_cluster
from fieldlink.queries.base import cte, query, rounded, settled, settled_sql, shared
from fieldlink.queries.edge_queries import evidence, placed_components, wide_edges


def group_ctes(prefix: str, edges: str, comps: str) -> None:
    """Cores, weak attachment and numbered groups in SQL for one edge table."""
    p = prefix
    cte(f"{p}_flood", f"""
SELECT field_id, i AS node, i AS label FROM {edges} WHERE edge_type = 'strong' UNION SELECT field_id, j, j FROM {edges} WHERE edge_type = 'strong'
UNION
SELECT f.field_id, CASE WHEN e.i = f.node THEN e.j ELSE e.i END, f.label FROM {p}_flood f
JOIN (SELECT field_id, i, j FROM {edges} WHERE edge_type = 'strong') e ON e.field_id = f.field_id AND (e.i = f.node OR e.j = f.node)""", edges)
    cte(f"{p}_cores", f"SELECT field_id, node, min(label) AS label FROM {p}_flood GROUP BY 1, 2", f"{p}_flood")
    cte(f"{p}_weak", f"""
SELECT e.*, a.label AS k1, b.label AS k2, row_number() OVER (PARTITION BY e.field_id ORDER BY score DESC, i, j) AS rk
FROM {edges} e LEFT JOIN {p}_cores a ON a.field_id = e.field_id AND a.node = e.i LEFT JOIN {p}_cores b ON b.field_id = e.field_id AND b.node = e.j
WHERE edge_type = 'weak'""", edges, f"{p}_cores")
    cte(f"{p}_joined", f"""
SELECT field_id, CASE WHEN k1 IS NULL THEN i ELSE j END AS node, min(rk) AS at, arg_min(coalesce(k1, k2), rk) AS core
FROM {p}_weak WHERE (k1 IS NULL) <> (k2 IS NULL) GROUP BY 1, 2""", f"{p}_weak")
    cte(f"{p}_decided", f"""
SELECT w.field_id, w.i, w.j, coalesce(x.at, y.at) IS NOT NULL AND (coalesce(x.at = rk, false) OR coalesce(y.at = rk, false)) AS joins,
 CASE WHEN (k1 IS NOT NULL OR coalesce(x.at < rk, false)) AND (k2 IS NOT NULL OR coalesce(y.at < rk, false)) AND coalesce(k1, x.core) = coalesce(k2, y.core) THEN 'weak_edge_already_same_group'
      WHEN coalesce(x.at = rk, false) OR coalesce(y.at = rk, false) THEN ''
      WHEN k1 IS NOT NULL AND k2 IS NOT NULL THEN 'weak_edge_would_merge_core_groups'
      WHEN k1 IS NULL AND k2 IS NULL THEN 'weak_edge_no_core_group' ELSE 'weak_edge_would_form_chain' END AS reason
FROM {p}_weak w LEFT JOIN {p}_joined x ON x.field_id = w.field_id AND x.node = w.i LEFT JOIN {p}_joined y ON y.field_id = w.field_id AND y.node = w.j""",
        f"{p}_weak", f"{p}_joined")
    cte(f"{p}_members", f"""
SELECT field_id, component_index, min(component_index) OVER (PARTITION BY field_id, home) AS gid
FROM (SELECT c.field_id, c.component_index, coalesce(k.label, j.core, c.component_index) AS home FROM {comps} c
 LEFT JOIN {p}_cores k ON k.field_id = c.field_id AND k.node = c.component_index LEFT JOIN {p}_joined j ON j.field_id = c.field_id AND j.node = c.component_index)""",
        comps, f"{p}_cores", f"{p}_joined")
    cte(f"{p}_groups", f"""
SELECT *, CAST(field_id AS VARCHAR) || '_a' || format('{{:03d}}', group_index) AS association_group_id
FROM (SELECT field_id, gid, n, row_number() OVER (PARTITION BY field_id ORDER BY n DESC, gid) - 1 AS group_index
 FROM (SELECT field_id, gid, count(*) AS n FROM {p}_members GROUP BY 1, 2))""", f"{p}_members")
    cte(f"{p}_final", f"""
SELECT e.*, CASE WHEN e.edge_type = 'strong' THEN true WHEN e.edge_type = 'weak' THEN d.reason = '' ELSE false END AS decision
FROM {edges} e LEFT JOIN {p}_decided d USING (field_id, i, j)""", edges, f"{p}_decided")


group_ctes("w", "wide_edges", "components")
group_ctes("s", "small_edges", "placed")


@query("strong_components", """
SELECT c.field_id, c.component_index, coalesce(k.label, c.component_index) AS label
FROM components c LEFT JOIN w_cores k ON k.field_id = c.field_id AND k.node = c.component_index""", ("components", "w_cores"))
def strong_components(spark, sf):
    comps = fx.components(spark, sf)
    edges = cut(wide_edges(spark, sf).filter("edge_type = 'strong'").select("field_id", "component_index_1", "component_index_2"))
    return graph_cluster(comps.select("field_id", "component_index"), edges, ["field_id"], "component_index",
                         "component_index_1", "component_index_2", "label")


def linking_edges(spark, sf):
    """Strong and weak edges with what clustering reads of them; rejected ones join nothing and are not written."""
    return cut(wide_edges(spark, sf).filter("edge_type <> 'rejected'").select(
        *evidence.PAIR, "association_score", "edge_type", "rejection_reason", "association_decision"))


@shared
def clustered(spark, sf):
    with measured_joins(spark):
        edges = linking_edges(spark, sf)
        decided, members, groups = cluster.cluster_components(fx.components(spark, sf), edges, fx.WIDE)
        return cut(decided), cut(members), cut(groups)


@query("weak_attachment", """
SELECT field_id, i AS component_index_1, j AS component_index_2, reason = '' AS association_decision, reason AS rejection_reason FROM w_decided""", ("w_decided",))
def weak_attachment(spark, sf):
    decided, _, _ = clustered(spark, sf)
    return decided.filter("edge_type = 'weak'").select(
        "field_id", "component_index_1", "component_index_2", "association_decision", "rejection_reason")


@query("association_group_sizes", "SELECT field_id, gid, n AS n_gaussians, group_index, association_group_id FROM w_groups", ("w_groups",))
def association_group_sizes(spark, sf):
    return clustered(spark, sf)[2]


@query("group_membership", """
SELECT m.field_id, m.component_index, m.gid, g.association_group_id FROM w_members m JOIN w_groups g USING (field_id, gid)""", ("w_members", "w_groups"))
def group_membership(spark, sf):
    _, members, groups = clustered(spark, sf)
    with measured_joins(spark):
        return cut(members.join(groups.select("field_id", "gid", "association_group_id"), ["field_id", "gid"]))


@query("unconstrained_groups", """
WITH RECURSIVE u AS (SELECT field_id, component_index AS node, component_index AS label FROM components
 UNION SELECT u.field_id, CASE WHEN e.i = u.node THEN e.j ELSE e.i END, u.label FROM u JOIN (SELECT field_id, i, j FROM wide_edges WHERE edge_type <> 'rejected') e
 ON e.field_id = u.field_id AND (e.i = u.node OR e.j = u.node))
SELECT field_id, gid, n AS n_gaussians, row_number() OVER (PARTITION BY field_id ORDER BY gid) - 1 AS group_index FROM
(SELECT field_id, gid, count(*) AS n FROM (SELECT field_id, node, min(label) AS gid FROM u GROUP BY 1, 2) GROUP BY 1, 2)""".replace("WITH RECURSIVE u AS", "SELECT * FROM (WITH RECURSIVE u AS", 1) + ")",
       ("wide_edges", "components"))
def unconstrained_groups(spark, sf):
    from dataclasses import replace

    cfg = replace(fx.WIDE, features=replace(fx.WIDE.features, anti_chaining=False))
    edges = linking_edges(spark, sf)
    return cluster.cluster_components(fx.components(spark, sf), edges, cfg)[2].drop("association_group_id")


# ---- measurement on the small rasters ---------------------------------------

def support_ctes(prefix: str, members: str) -> None:
    p = prefix
    cte(f"{p}_touch", f"""
SELECT DISTINCT field_id, gid, threshold, label, area FROM (
 SELECT field_id, gid, 2.5 AS threshold, label_at_2p5sigma AS label, area_at_2p5sigma AS area FROM {members} UNION ALL
 SELECT field_id, gid, 2.0, label_at_2sigma, area_at_2sigma FROM {members}) WHERE label > 0""", members)
    cte(f"{p}_mask", f"""
SELECT t.field_id, t.gid, l.y, l.x, p.value FROM {p}_touch t JOIN (SELECT field_id, gid, max(threshold) AS best FROM {p}_touch GROUP BY 1, 2) b USING (field_id, gid)
JOIN labels l ON l.field_id = t.field_id AND l.threshold = t.threshold AND l.label = t.label
JOIN pixels p ON p.field_id = l.field_id AND p.y = l.y AND p.x = l.x WHERE t.threshold = b.best""", f"{p}_touch", "labels", "pixels")
    cte(f"{p}_maskstat", f"""
SELECT m.field_id, m.gid, any_value(n) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, sum(w*x)/sum(w) AS ax, sum(w*y)/sum(w) AS ay,
 sum(w*x*x)/sum(w) - pow(sum(w*x)/sum(w), 2) AS k00, sum(w*x*y)/sum(w) - sum(w*x)/sum(w)*sum(w*y)/sum(w) AS k01, sum(w*y*y)/sum(w) - pow(sum(w*y)/sum(w), 2) AS k11
FROM (SELECT a.*, b.n, CASE WHEN b.top > b.low THEN value - b.low ELSE 1 END AS w FROM {p}_mask a
 JOIN (SELECT field_id, gid, count(*) AS n, min(value) AS low, max(value) AS top FROM {p}_mask GROUP BY 1, 2) b USING (field_id, gid)) m GROUP BY 1, 2""", f"{p}_mask")
    cte(f"{p}_masklas", f"""
SELECT a.field_id, a.gid, max(sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2))) AS las FROM {p}_mask a JOIN {p}_mask b USING (field_id, gid) GROUP BY 1, 2""", f"{p}_mask")
    cte(f"{p}_pointlas", f"""
SELECT a.field_id, a.gid, max(sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2))) AS las FROM {members} a JOIN {members} b USING (field_id, gid) GROUP BY 1, 2""", members)
    cte(f"{p}_shape", f"""
SELECT *, CASE WHEN major > 0 THEN major/greatest(minor, 1e-6) ELSE 1.0 END AS axis_ratio FROM (
SELECT *, sqrt(greatest((c00+c11)/2 + sqrt(pow((c00-c11)/2, 2) + c01*c01), 0)) AS major, sqrt(greatest((c00+c11)/2 - sqrt(pow((c00-c11)/2, 2) + c01*c01), 0)) AS minor,
 CASE WHEN c01 = 0 AND c00 <= c11 THEN 90.0 ELSE (degrees(atan2(2*c01, c00-c11))/2 + 180) % 180 END AS pa
FROM (SELECT s.*, m.n AS mask_n, greatest(p.las, coalesce(l.las, 0)) AS las,
 coalesce(m.x0, greatest(0, floor(lx - 5))) AS bx0, coalesce(m.y0, greatest(0, floor(ly - 5))) AS by0,
 coalesce(m.x1, least(31, ceil(hx + 5))) AS bx1, coalesce(m.y1, least(29, ceil(hy + 5))) AS by1,
 CASE WHEN m.n >= 3 THEN m.k00 WHEN s.n >= 2 THEN p00 END AS c00, CASE WHEN m.n >= 3 THEN m.k01 WHEN s.n >= 2 THEN p01 END AS c01,
 CASE WHEN m.n >= 3 THEN m.k11 WHEN s.n >= 2 THEN p11 END AS c11
FROM (SELECT field_id, gid, count(*) AS n, min(x) AS lx, min(y) AS ly, max(x) AS hx, max(y) AS hy,
  sum(peak_flux*x)/sum(peak_flux) AS centroid_x, sum(peak_flux*y)/sum(peak_flux) AS centroid_y, sum(total_flux) AS total_flux, max(peak_flux) AS peak_flux,
  max(resolved_probability) AS rprob, max(beam_like_score) AS blike, min(morphology_class) AS klass, bool_and(morphology_class = 'unresolved') AS all_unresolved,
  var_pop(x) AS p00, covar_pop(x, y) AS p01, var_pop(y) AS p11 FROM {members} GROUP BY 1, 2) s
LEFT JOIN {p}_maskstat m USING (field_id, gid) LEFT JOIN {p}_masklas l USING (field_id, gid) JOIN {p}_pointlas p USING (field_id, gid)))""",
        members, f"{p}_maskstat", f"{p}_masklas", f"{p}_pointlas")


cte("s_placed", "SELECT p.*, m.gid FROM placed p JOIN s_members m USING (field_id, component_index)", "placed", "s_members")
support_ctes("s", "s_placed")


def edge_group_sql(final: str, members: str) -> str:
    return f"""
SELECT e.field_id, a.gid, count(*) AS ne, avg(score) AS smean, min(score) AS smin, max(score) AS smax, count(*) FILTER (edge_type = 'strong') AS ns,
 count(*) FILTER (edge_type = 'weak') AS nw, count(*) FILTER (only2) AS no2, bool_or(con3 OR con25) AS contour, max(bridge_score) AS bridge, max(ridge_score) AS ridge, avg(gap) AS egap,
 bool_or(flags LIKE '%negative_bowl%') AS fb, bool_or(flags LIKE '%sidelobe_risk%') AS fs, bool_or(flags LIKE '%large_mask%') AS fl,
 bool_or(flags LIKE '%only_2sigma%') AS fo, bool_or(flags LIKE '%too_far%') AS ff
FROM {final} e JOIN {members} a ON a.field_id = e.field_id AND a.component_index = e.i JOIN {members} b ON b.field_id = e.field_id AND b.component_index = e.j AND a.gid = b.gid
WHERE decision GROUP BY 1, 2"""


def judged_sql(shape: str, edges: str, forced: str = "false") -> str:
    return f"""
SELECT *, CASE WHEN fb OR fs OR fl THEN 'artifact_risk' WHEN n >= 5 THEN 'complex_association' WHEN n <= 1 THEN 'weak_association' WHEN las/2 <= 4 THEN 'compact_multi_gaussian'
  WHEN axis_ratio >= 2 THEN 'linear_or_tail_like' WHEN las/2 >= 6 AND quality IN ('low', 'suspicious') THEN 'diffuse_extended'
  WHEN (contour OR bridge >= 0.45 OR ridge >= 0.45) AND las/2 >= 4 THEN 'continuous_extended' WHEN quality IN ('low', 'suspicious', 'artifact_risk') THEN 'weak_association' ELSE 'continuous_extended' END AS kind
FROM (SELECT *, CASE WHEN fb OR fs OR fl THEN 'artifact_risk' WHEN {forced} THEN 'suspicious' WHEN ne = 0 THEN 'low'
   WHEN fo OR no2 > greatest(1, floor(0.4*ne)) OR smax - smin > 2.5 THEN 'suspicious'
   WHEN smean >= 3.5 AND ns >= greatest(1, floor(0.6*ne)) AND (contour OR bridge >= 0.55 OR ridge >= 0.55) THEN 'high'
   WHEN smean >= 2.5 AND (contour OR bridge >= 0.55 OR ridge >= 0.55) THEN 'medium' ELSE 'low' END AS quality
 FROM (SELECT s.*, coalesce(ne, 0) AS ne, coalesce(smean, 0) AS smean, coalesce(smin, 0) AS smin, coalesce(smax, 0) AS smax, coalesce(ns, 0) AS ns, coalesce(nw, 0) AS nw,
   coalesce(no2, 0) AS no2, coalesce(contour, false) AS contour, coalesce(bridge, 0) AS bridge, coalesce(ridge, 0) AS ridge, egap, coalesce(fb, false) AS fb, coalesce(fs, false) AS fs,
   coalesce(fl, false) AS fl, coalesce(fo, false) OR coalesce(no2, 0) > greatest(1, floor(0.5*ne)) AS fo, coalesce(ff, false) AS ff
  FROM {shape} s LEFT JOIN {edges} e USING (field_id, gid)))"""


cte("s_edgestat", edge_group_sql("s_final", "s_members"), "s_final", "s_members")
cte("s_judged", judged_sql("s_shape", "s_edgestat"), "s_shape", "s_edgestat")


@shared
def small_groups(spark, sf):
    """(components with gid, edges, groups, snr, labels, pixels, fields) of the small rasters."""
    from fieldlink.operators.evidence import score_edges

    comps, snr, labels = placed_components(spark, sf)
    edges = cut(score_edges(comps, snr, fx.SMALL).drop("x_1", "y_1", "x_2", "y_2"))
    decided, members, numbered = cluster.cluster_components(comps, edges, fx.SMALL)
    decided = cut(decided)
    members = cut(comps.join(members, ["field_id", "component_index"]))
    fields, pixels = fx.fields(spark, sf), fx.pixels(spark, sf)
    groups = measure.measure_groups(members, decided, labels, pixels, fields, fx.SMALL)
    groups = cut(groups.join(numbered.select("field_id", "gid", "group_index", "association_group_id"), ["field_id", "gid"]))
    return members, decided, groups, snr, labels, pixels, fields


@query("group_measurement", f"""
SELECT field_id, gid, n AS n_gaussians, {settled_sql('centroid_x', 'centroid_x', 4)}, {settled_sql('centroid_y', 'centroid_y', 4)},
 CAST(CAST(bx0 AS INT) AS VARCHAR) || ',' || CAST(CAST(by0 AS INT) AS VARCHAR) || ',' || CAST(CAST(bx1 AS INT) AS VARCHAR) || ',' || CAST(CAST(by1 AS INT) AS VARCHAR) AS bounding_box,
 {settled_sql('las', 'LAS_arcsec', 4)}, {settled_sql('round(round(pa, 9), 3) % 180', 'group_PA', 3)}, {settled_sql('axis_ratio', 'axis_ratio', 3)}, {settled_sql('total_flux', 'total_flux_gaussian', 4)}, {settled_sql('smean', 'association_score_mean', 4)},
 ns AS n_strong_edges, nw AS n_weak_edges, no2 AS n_only_2sigma_edges, quality AS association_quality, kind AS association_type,
 CASE WHEN n = 1 THEN klass WHEN kind = 'artifact_risk' OR quality = 'artifact_risk' THEN 'artifact_like'
  WHEN kind IN ('continuous_extended','diffuse_extended','linear_or_tail_like','complex_association') OR ns > 0 OR las/2 >= 3 THEN 'multi_gaussian_extended'
  WHEN all_unresolved THEN 'unresolved' ELSE 'unknown' END AS morphology_class,
 concat_ws(',', CASE WHEN fl THEN 'large_mask_swallow' END, CASE WHEN fb THEN 'negative_bowl' END, CASE WHEN fo THEN 'only_2sigma' END, CASE WHEN fs THEN 'sidelobe_risk' END, CASE WHEN ff THEN 'too_far' END) AS artifact_risk_flags
FROM s_judged""", ("s_judged",))
def group_measurement(spark, sf):
    groups = measure.publish_groups(small_groups(spark, sf)[2])
    out = groups.select("field_id", "gid", "n_gaussians", "centroid_x", "centroid_y", "bounding_box", "LAS_arcsec", "group_PA", "axis_ratio", "total_flux_gaussian",
                        "association_score_mean", "n_strong_edges", "n_weak_edges", "n_only_2sigma_edges", "association_quality", "association_type",
                        "morphology_class", "artifact_risk_flags")
    return tidy_angles(out)


def tidy_angles(out):
    """Angles of axes stay below 180 when they are rounded."""
    even = settled(out)
    return rounded(even.withColumn("group_PA", F.pmod(F.round("group_PA", 3), F.lit(180.0))).withColumn("axis_ratio", F.round("axis_ratio", 3)), 4)
