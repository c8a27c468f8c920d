"""The older merge path, diagnostics and display selections on the small rasters."""

from pyspark.sql import functions as F

from fieldlink import fixtures as fx
from fieldlink.lineage import cut
from fieldlink.operators import diagnostics, display, legacy
from fieldlink.operators.cluster import inner_edges
from fieldlink.queries.base import cte, query, r, rounded, settled, settled_sql, shared
from fieldlink.queries.edge_queries import placed_components
from fieldlink.queries.group_queries import small_groups, support_ctes

cte("m_edges", """
SELECT *, score > 3 AS decision FROM (SELECT *, 2*CAST(con3 AS INT) + CAST(con25 AS INT) + 0.3*CAST(con2 AS INT) + bridge + 0.8*overlap + 0.8*closeness + 0.7*pa_score + 0.8*support
  - 1.5*valley - compact - 2.5*far_pen - 0.5*bowl - 0.5*mis AS score,
  concat_ws(',', CASE WHEN island THEN 'same_pybdsf_island' END, CASE WHEN con3 THEN 'connected_at_3sigma' END, CASE WHEN con25 THEN 'connected_at_2p5sigma' END,
   CASE WHEN con2 THEN 'connected_at_2sigma' END, CASE WHEN bridge > 0.5 THEN 'bridge_snr_score' END, CASE WHEN overlap > 0.5 THEN 'gaussian_ellipse_overlap_approx' END,
   CASE WHEN pa_score > 0.5 THEN 'PA_alignment_score' END) AS positive,
  concat_ws(',', CASE WHEN valley > 0.5 THEN 'valley_penalty' END, CASE WHEN bowl > 0.5 THEN 'negative_bowl_penalty' END, CASE WHEN far_pen > 0.5 THEN 'too_far_penalty' END,
   CASE WHEN mis > 0.5 THEN 'pa_misalignment_penalty' END) AS negative
 FROM (SELECT a.field_id, a.component_index AS i, b.component_index AS j, q.len, a.island_id = b.island_id AS island,
   a.label_at_3sigma > 0 AND a.label_at_3sigma = b.label_at_3sigma AS con3, a.label_at_2p5sigma > 0 AND a.label_at_2p5sigma = b.label_at_2p5sigma AS con25,
   a.label_at_2sigma > 0 AND a.label_at_2sigma = b.label_at_2sigma AS con2, greatest(0, least(1.5, (coalesce(l.lm, 1) - 1)/2)) AS bridge,
   coalesce(greatest(0, least(1, 1 - q.len/(0.5*(coalesce(a.dc_maj, a.maj) + coalesce(b.dc_maj, b.maj))))), 0) * CAST(coalesce(a.dc_maj, a.maj) + coalesce(b.dc_maj, b.maj) > 0 AS INT) AS overlap,
   greatest(0, least(1, 1 - q.len/2/15)) AS closeness, greatest(0, 1 - q.t/45) AS pa_score, greatest(0, least(1, (q.t - 45)/45)) AS mis, coalesce(g.sup, 0) AS support,
   CASE WHEN l.lm IS NULL THEN 1 ELSE greatest(0, least(1.5, (2 - lmin)/4)) END AS valley, CASE WHEN l.lm IS NULL THEN 0 ELSE greatest(0, least(2, -lmin/3)) END AS bowl,
   greatest(0, least(1.5, greatest(q.len/120, q.len/2/15) - 0.75)) AS far_pen,
   CASE WHEN q.len/2 < 1.5 AND least(a.total_flux, b.total_flux)/greatest(a.total_flux, b.total_flux) < 0.2 THEN 0.5 ELSE 0 END AS compact
  FROM (SELECT s.*, abs((a.pa - b.pa + 450) % 180 - 90) AS t FROM small_pairs s JOIN placed a ON a.field_id = s.field_id AND a.component_index = s.i JOIN placed b ON b.field_id = s.field_id AND b.component_index = s.j) q
  JOIN placed a ON a.field_id = q.field_id AND a.component_index = q.i JOIN placed b ON b.field_id = q.field_id AND b.component_index = q.j
  LEFT JOIN line_agg l ON l.field_id = q.field_id AND l.i = q.i AND l.j = q.j
  LEFT JOIN (SELECT field_id, i, j, avg(CAST(snr > 2 AS DOUBLE)) AS sup FROM line_snr GROUP BY 1, 2, 3) g ON g.field_id = q.field_id AND g.i = q.i AND g.j = q.j))""",
    "small_pairs", "placed", "line_agg", "line_snr")
cte("m_flood", """
SELECT field_id, component_index AS node, component_index AS label FROM placed UNION
SELECT f.field_id, CASE WHEN e.i = f.node THEN e.j ELSE e.i END, f.label FROM m_flood f JOIN (SELECT field_id, i, j FROM m_edges WHERE decision) e ON e.field_id = f.field_id AND (e.i = f.node OR e.j = f.node)""", "placed", "m_edges")
cte("m_members", "SELECT field_id, node AS component_index, min(label) AS gid FROM m_flood GROUP BY 1, 2", "m_flood")
cte("m_groups", """SELECT *, field_id || '_m' || format('{:03d}', idx) AS merged_source_id FROM (SELECT field_id, gid, n, row_number() OVER (PARTITION BY field_id ORDER BY n DESC, gid DESC) - 1 AS idx
 FROM (SELECT field_id, gid, count(*) AS n FROM m_members GROUP BY 1, 2))""", "m_members")
cte("m_placed", "SELECT p.*, m.gid FROM placed p JOIN m_members m USING (field_id, component_index)", "placed", "m_members")
support_ctes("m", "m_placed")


@shared
def merged(spark, sf):
    comps, snr, labels = placed_components(spark, sf)
    edges = cut(legacy.merge_edges(comps, snr, fx.SMALL))
    members, numbered = legacy.merge_clusters(comps, edges)
    return comps, labels, edges, members, numbered


@query("merge_edges", f"""SELECT field_id, i AS component_index_1, j AS component_index_2, {r('score', 'merge_score', 4)}, decision AS merge_decision, positive AS positive_evidence, negative AS negative_evidence,
 {r('valley', 'valley_penalty', 4)}, {r('support', 'pixel_support_score', 4)} FROM m_edges""", ("m_edges",))
def merge_edges(spark, sf):
    comps, snr, _ = placed_components(spark, sf)
    return rounded(legacy.merge_edges(comps, snr, fx.SMALL).select(
        "field_id", "component_index_1", "component_index_2", "merge_score", "merge_decision", "positive_evidence", "negative_evidence", "valley_penalty", "pixel_support_score"), 4)


@query("merge_clusters", """
SELECT m.field_id, m.component_index, m.gid, g.merged_source_id, (SELECT count(*) FROM m_edges e WHERE e.field_id = m.field_id AND decision AND (e.i = m.component_index OR e.j = m.component_index)) AS debug_graph_degree
FROM m_members m JOIN m_groups g USING (field_id, gid)""", ("m_members", "m_groups", "m_edges"))
def merge_clusters(spark, sf):
    _, _, _, members, numbered = merged(spark, sf)
    return members.join(numbered.select("field_id", "gid", "merged_source_id"), ["field_id", "gid"])


@query("merged_sources", f"""
SELECT s.field_id, g.merged_source_id, CAST(s.n AS BIGINT) AS n_components, i.island_ids, {settled_sql('s.total_flux', 'total_flux_gaussian', 4)}, {settled_sql('p2', 'pixel_sum_2sigma', 4)}, {settled_sql('p25', 'pixel_sum_2p5sigma', 4)},
 {settled_sql('s.las', 'LAS_pixel', 4)}, {settled_sql('CASE WHEN mask_n >= 3 THEN major END', 'second_moment_major', 4)}, {settled_sql('coalesce(e.sm, 0)', 'merge_score_mean', 4)}, coalesce(e.ev, '') AS strongest_merge_evidence,
 s.n >= 2 AS multi_peak_flag, s.n >= 2 AND f0/f1 > 0.1 AND s.las > 5 AS double_lobe_candidate_flag, s.n >= 3 AND least(p1 - p0, 180 - (p1 - p0)) >= 35 AS bent_flag,
 {settled_sql("least(1, greatest(0, least(1, 0.2 + 0.15*s.n + 0.15*coalesce(e.sm, 0))) + CASE WHEN s.n >= 2 AND f0/f1 > 0.1 AND s.las > 5 THEN 0.1 ELSE 0 END)", 'merge_confidence', 4)}
FROM m_shape s JOIN m_groups g USING (field_id, gid)
JOIN (SELECT field_id, gid, string_agg(DISTINCT CAST(island_id AS VARCHAR), ',' ORDER BY CAST(island_id AS VARCHAR)) AS island_ids, min(total_flux) AS f0, max(total_flux) AS f1, min(pa) AS p0, max(pa) AS p1 FROM m_placed GROUP BY 1, 2) i USING (field_id, gid)
LEFT JOIN (SELECT t.field_id, t.gid, sum(p.value) FILTER (t.threshold = 2) AS p2, sum(p.value) FILTER (t.threshold = 2.5) AS p25 FROM m_touch t JOIN labels l ON l.field_id = t.field_id AND l.threshold = t.threshold AND l.label = t.label
  JOIN pixels p ON p.field_id = l.field_id AND p.y = l.y AND p.x = l.x GROUP BY 1, 2) x USING (field_id, gid)
LEFT JOIN (SELECT e.field_id, a.gid, avg(score) AS sm, first(positive ORDER BY round(score, 9) DESC, e.i, e.j) AS ev FROM m_edges e JOIN m_members a ON a.field_id = e.field_id AND a.component_index = e.i WHERE decision GROUP BY 1, 2) e USING (field_id, gid)""",
       ("m_shape", "m_groups", "m_placed", "m_touch", "m_edges", "labels", "pixels"))
def merged_sources(spark, sf):
    comps, labels, edges, members, numbered = merged(spark, sf)
    placed = cut(comps.join(members.select("field_id", "component_index", "gid"), ["field_id", "component_index"]))
    inner = inner_edges(edges.withColumnRenamed("merge_decision", "association_decision"), members.select("field_id", "component_index", "gid"))
    out = legacy.measure_sources(placed, numbered, inner, labels, fx.pixels(spark, sf), fx.fields(spark, sf), fx.SMALL)
    return rounded(settled(out).select("field_id", "merged_source_id", "n_components", "island_ids", "total_flux_gaussian", "pixel_sum_2sigma", "pixel_sum_2p5sigma", "LAS_pixel", "second_moment_major",
                              "merge_score_mean", "strongest_merge_evidence", "multi_peak_flag", "bent_flag", "double_lobe_candidate_flag", "merge_confidence"), 4)


@query("edge_diagnostics", f"""
SELECT c.field_id, c.n AS n_nodes, coalesce(e.np, 0) AS n_candidate_pairs, coalesce(e.nm, 0) AS n_edges_merged, {settled_sql('smin', 'merge_score_min', 4)}, {settled_sql('smed', 'merge_score_median', 4)}, {settled_sql('smax', 'merge_score_max', 4)}, coalesce(e.c3, 0) AS connected_at_3sigma_count,
 coalesce(e.c25, 0) AS connected_at_2p5sigma_count, coalesce(e.c2, 0) AS connected_at_2sigma_count, coalesce(e.o2, 0) AS only_2sigma_connected_count, {settled_sql('dmed', 'median_distance_arcsec', 4)}, {settled_sql('dmax', 'max_distance_arcsec', 4)}, g.mx AS max_merged_component_size,
 CASE WHEN e.np IS NULL THEN 'no_candidate_pairs' ELSE concat_ws(';', CASE WHEN nm > 0 AND o2/np > 0.5 THEN 'many_only_2sigma_pairs' END, CASE WHEN g.mx > 20 THEN 'large_connected_component' END) END AS warning
FROM (SELECT field_id, count(*) AS n FROM placed GROUP BY 1) c
LEFT JOIN (SELECT field_id, count(*) AS np, count(*) FILTER (decision) AS nm, min(score) AS smin, median(score) AS smed, max(score) AS smax, count(*) FILTER (con3) AS c3, count(*) FILTER (con25) AS c25, count(*) FILTER (con2) AS c2,
  count(*) FILTER (con2 AND NOT con25 AND NOT con3) AS o2, median(len) AS dmed, max(len) AS dmax FROM m_edges GROUP BY 1) e USING (field_id)
JOIN (SELECT field_id, max(n) AS mx FROM m_groups GROUP BY 1) g USING (field_id)""", ("placed", "m_edges", "m_groups"))
def edge_diagnostics(spark, sf):
    comps, _, edges, members, _ = merged(spark, sf)
    return rounded(settled(diagnostics.edge_diagnostics(comps, edges, members)), 4)


@query("association_diagnostics", f"""
SELECT c.field_id, c.n AS n_nodes, CASE WHEN e.np IS NULL THEN 0 ELSE c.u END AS n_unresolved, CASE WHEN e.np IS NULL THEN 0 ELSE c.m END AS n_marginally_resolved, CASE WHEN e.np IS NULL THEN 0 ELSE c.rs END AS n_resolved, CAST(0 AS BIGINT) AS n_artifact_like,
 coalesce(e.np, 0) AS n_candidate_pairs, coalesce(e.ns, 0) AS n_strong_edges, coalesce(e.nw, 0) AS n_weak_edges, coalesce(e.nr, 0) AS n_rejected_edges,
 coalesce(e.nd, 0) AS n_decision_edges, coalesce(e.no, 0) AS n_only_2sigma_edges, coalesce(e.nv, 0) AS n_unresolved_pair_veto, {settled_sql('smin', 'association_score_min', 4)}, {settled_sql('smax', 'association_score_max', 4)}, {settled_sql('smed', 'association_score_median', 4)}, g.ng AS n_association_groups, g.mx AS max_group_size,
 CASE WHEN e.np IS NULL THEN 'no_candidate_pairs' ELSE concat_ws(';', CASE WHEN no > greatest(1, floor(0.5*greatest(nd, 1))) THEN 'many_only_2sigma_associations' END, CASE WHEN g.mx > 20 THEN 'large_association_group' END) END AS warning
FROM (SELECT field_id, count(*) AS n, count(*) FILTER (morphology_class = 'unresolved') AS u, count(*) FILTER (morphology_class = 'marginally_resolved') AS m, count(*) FILTER (morphology_class = 'resolved') AS rs FROM placed GROUP BY 1) c
LEFT JOIN (SELECT field_id, count(*) AS np, count(*) FILTER (edge_type = 'strong') AS ns, count(*) FILTER (edge_type = 'weak') AS nw, count(*) FILTER (edge_type = 'rejected') AS nr, count(*) FILTER (decision) AS nd,
  count(*) FILTER (decision AND only2) AS no, count(*) FILTER (veto) AS nv, min(score) AS smin, max(score) AS smax, median(score) AS smed FROM s_final GROUP BY 1) e USING (field_id)
JOIN (SELECT field_id, count(*) AS ng, max(n) AS mx FROM s_groups GROUP BY 1) g USING (field_id)""", ("placed", "s_final", "s_groups"))
def association_diagnostics(spark, sf):
    members, edges, groups, *_ = small_groups(spark, sf)
    return rounded(settled(diagnostics.association_diagnostics(members, groups, edges)), 4)


SHOWN = "(SELECT *, las AS size FROM s_judged)"


@query("label_selection", f"""
SELECT field_id, gid, label_rank, n_selected FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY las DESC, smean DESC, n DESC, gid) AS label_rank, count(*) OVER (PARTITION BY field_id) AS n_selected
 FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY las DESC, gid) AS a, row_number() OVER (PARTITION BY field_id ORDER BY smean DESC, gid) AS b FROM s_judged)
 WHERE n >= 2 OR quality IN ('high', 'medium', 'suspicious', 'artifact_risk') OR a <= 5 OR b <= 5) WHERE label_rank <= 5""", ("s_judged",))
def label_selection(spark, sf):
    from fieldlink.config import Display

    groups = small_groups(spark, sf)[2]
    tidy = groups.withColumn("LAS_arcsec", F.round("LAS_arcsec", 9)).withColumn("association_score_mean", F.round("association_score_mean", 9))
    return display.label_groups(tidy, Display(max_labels=5)).select("field_id", "gid", F.col("label_rank").cast("long").alias("label_rank"), "n_selected")


@query("zoom_windows", """
SELECT field_id, gid, zoom_rank, least(greatest(round_even((bx0+bx1)/2 - side/2, 0), 0), greatest(32 - side, 0)) AS crop_x0, least(greatest(round_even((by0+by1)/2 - side/2, 0), 0), greatest(30 - side, 0)) AS crop_y0,
 least(32.0, least(greatest(round_even((bx0+bx1)/2 - side/2, 0), 0), greatest(32 - side, 0)) + side) AS crop_x1, least(30.0, least(greatest(round_even((by0+by1)/2 - side/2, 0), 0), greatest(30 - side, 0)) + side) AS crop_y1
FROM (SELECT *, CAST(least(greatest(greatest(bx1-bx0, by1-by0) + 5, 8), 16) AS DOUBLE) AS side, row_number() OVER (PARTITION BY field_id ORDER BY n DESC, las DESC, smean DESC, gid) AS zoom_rank
 FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY las DESC, gid) AS a, row_number() OVER (PARTITION BY field_id ORDER BY smean DESC, gid) AS b FROM s_judged)
 WHERE n >= 2 OR quality IN ('high', 'medium', 'suspicious', 'artifact_risk') OR a <= 10 OR b <= 10) WHERE zoom_rank <= 6""", ("s_judged",))
def zoom_windows(spark, sf):
    from fieldlink.config import Display

    d = Display(zoom_max=6, zoom_padding=2, zoom_min_size=8, zoom_max_size=16)
    groups = small_groups(spark, sf)[2]
    tidy = groups.withColumn("LAS_arcsec", F.round("LAS_arcsec", 9)).withColumn("association_score_mean", F.round("association_score_mean", 9))
    out = display.zoom_window(display.zoom_groups(tidy, d), d)
    return out.select("field_id", "gid", F.col("zoom_rank").cast("long").alias("zoom_rank"), "crop_x0", "crop_y0", "crop_x1", "crop_y1")


@query("drawn_components", """SELECT field_id, component_index, draw_rank FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY peak_flux DESC, component_index) AS draw_rank FROM components) WHERE draw_rank <= 25""", ("components",))
def drawn_components(spark, sf):
    from fieldlink.config import Display

    out = display.drawn_components(fx.components(spark, sf), Display(max_components=25))
    return out.select("field_id", "component_index", F.col("draw_rank").cast("long").alias("draw_rank"))
