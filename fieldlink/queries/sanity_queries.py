"""Over-merge risk, edge cut risk and group splitting on the small rasters."""

from pyspark.sql import functions as F

from fieldlink import fixtures as fx
from fieldlink.lineage import cut
from fieldlink.operators import sanity
from fieldlink.operators.cluster import inner_edges
from fieldlink.queries.base import cte, query, r, rounded, shared
from fieldlink.queries.group_queries import small_groups

cte("s_peaks", """
SELECT *, row_number() OVER (PARTITION BY field_id, gid ORDER BY pk DESC, component_index) AS rk, max(pk) OVER (PARTITION BY field_id, gid) AS top
FROM (SELECT field_id, gid, component_index, x, y, coalesce(snr_at, peak_flux, 0) AS pk FROM s_placed)""", "s_placed")


def risk_ctes(p: str, most: str) -> None:
    """Lines between the peaks of each group that ``most`` lets in, and the risk with them."""
    cte(f"{p}_peakpairs", f"""
SELECT a.field_id, a.gid, a.rk AS r1, b.rk AS r2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, greatest(0, least(a.pk, b.pk)) AS fl,
 sqrt(pow(b.x-a.x,2) + pow(b.y-a.y,2))/2 AS sep FROM s_peaks a JOIN s_peaks b ON a.field_id = b.field_id AND a.gid = b.gid AND a.rk < b.rk{most}""", "s_peaks")
    cte(f"{p}_peaklines", f"""
SELECT p.field_id, p.gid, r1, r2, any_value(fl) AS fl, min(s.snr) AS low, avg(CAST(s.snr < 2.5 AS DOUBLE)) AS gap
FROM (SELECT *, CASE WHEN k = n - 1 THEN x2 ELSE x1 + k*((x2-x1)/(n-1)) END AS sx, CASE WHEN k = n - 1 THEN y2 ELSE y1 + k*((y2-y1)/(n-1)) END AS sy
 FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, greatest(3, CAST(ceil(sep*2) AS INT) + 1) AS n FROM {p}_peakpairs WHERE sep >= 1 AND fl > 0))) p
JOIN snr s ON s.field_id = p.field_id AND s.y = round_even(sy, 0) AND s.x = round_even(sx, 0) GROUP BY 1, 2, 3, 4""", f"{p}_peakpairs", "snr")
    cte(f"{p}_paths", f"""
SELECT g.field_id, g.gid, CASE WHEN l.saddle IS NULL THEN 1 ELSE greatest(-1, least(1.5, l.saddle)) END AS saddle, coalesce(l.gap, 0) AS pgap, CASE WHEN g.n = 1 THEN 1 ELSE greatest(1, g.peaks) END AS peaks, coalesce(w.sep, 0) AS sep
FROM (SELECT field_id, gid, count(*) AS n, count(*) FILTER (top <= 0 OR pk >= greatest(5, 0.35*top)) AS peaks FROM s_peaks GROUP BY 1, 2) g
LEFT JOIN (SELECT field_id, gid, min(low/greatest(fl, 1e-6)) AS saddle, max(gap) AS gap FROM {p}_peaklines GROUP BY 1, 2) l USING (field_id, gid)
LEFT JOIN (SELECT field_id, gid, max(sep) AS sep FROM {p}_peakpairs GROUP BY 1, 2) w USING (field_id, gid)""", "s_peaks", f"{p}_peaklines", f"{p}_peakpairs")
    cte(f"{p}_risk", f"""
SELECT *, least(5, CASE WHEN las/2 >= 8 OR n >= 6 THEN 0.35 ELSE 0 END + greatest(0, (gap - 0.35)/0.65) + 1.1*greatest(0, (0.35 - saddle)/0.35) + 0.8*greatest(0, (wf - 0.5)/0.5)
  + 0.7*greatest(0, (of - 0.25)/0.75) + CASE WHEN chain THEN 0.55 ELSE 0 END + CASE WHEN big THEN 0.6 ELSE 0 END
  + CASE WHEN peaks >= 3 AND sep >= 4 AND saddle < 0.35 THEN 0.55 ELSE 0 END) AS risk
FROM (SELECT *, wf > 0.5 OR of > 0.25 OR (ne > 0 AND ns <= greatest(1, floor(0.3*ne)) AND n >= 4) AS chain,
   fl OR (a2/(pi()*4/(4*ln(2))) > greatest(30, 1.8*pow(greatest(las/2, 1), 2)) AND (wf > 0.25 OR of > 0.1 OR n > 8)) AS big
  FROM (SELECT j.*, p.saddle, p.peaks, p.sep, greatest(p.pgap, coalesce(egap, 0)) AS gap, nw/greatest(ne, 1) AS wf, no2/greatest(ne, 1) AS of, coalesce(t.a2, 0) AS a2
   FROM s_judged j JOIN {p}_paths p USING (field_id, gid)
   LEFT JOIN (SELECT field_id, gid, sum(area) AS a2 FROM s_touch WHERE threshold = 2 GROUP BY 1, 2) t USING (field_id, gid)))""", "s_judged", f"{p}_paths", "s_touch")


risk_ctes("s", " AND b.rk <= 8")
risk_ctes("a", "")
cte("s_cutrisk", """
SELECT e.field_id, a.gid, e.i, e.j, score, CASE WHEN edge_type = 'weak' THEN 1.0 ELSE 0 END + CASE WHEN only2 THEN 0.9 ELSE 0 END + CASE WHEN gap > 0.35 THEN 0.7 ELSE 0 END
 + CASE WHEN valley >= 0.8 THEN 0.8 ELSE 0 END + CASE WHEN bridge_score < 0.25 AND ridge_score < 0.35 THEN 0.6 ELSE 0 END + 0.5*greatest(0, (2.7 - score)/2.2) AS cut_risk
FROM s_final e JOIN s_members a ON a.field_id = e.field_id AND a.component_index = e.i JOIN s_members b ON b.field_id = e.field_id AND b.component_index = e.j AND a.gid = b.gid
WHERE decision""", "s_final", "s_members")
cte("s_risky", """SELECT * FROM s_risk WHERE n > 1 AND risk >= 1 AND (chain OR big OR gap > 0.35 OR saddle < 0.35)""", "s_risk")
cte("s_pieceflood", """
SELECT m.field_id, m.gid, m.component_index AS node, m.component_index AS label FROM s_members m JOIN s_risky USING (field_id, gid)
UNION
SELECT f.field_id, f.gid, CASE WHEN e.i = f.node THEN e.j ELSE e.i END, f.label FROM s_pieceflood f
JOIN s_cutrisk e ON e.field_id = f.field_id AND e.gid = f.gid AND e.cut_risk < 1.15 AND (e.i = f.node OR e.j = f.node)""", "s_members", "s_risky", "s_cutrisk")
cte("s_pieces", "SELECT field_id, gid, node, min(label) AS piece FROM s_pieceflood GROUP BY 1, 2, 3", "s_pieceflood")
cte("s_verdict", """
SELECT *, pieces >= 2 AND NOT (gain < 0.5 AND kept > 0) AS split,
 CASE WHEN pieces < 2 THEN 'unsplittable_no_stable_components' WHEN gain < 0.5 AND kept > 0 THEN 'split_gain_too_low:' || printf('%.2f', gain)
  ELSE concat_ws(';', CASE WHEN chain THEN 'weak_edge_chain' END, CASE WHEN big THEN 'large_mask_swallow' END, CASE WHEN gap > 0.35 THEN 'ridge_gap' END,
   CASE WHEN saddle < 0.35 THEN 'low_saddle' END, 'cut_edges=' || CAST(cuts AS VARCHAR)) END AS reason
FROM (SELECT k.*, z.pieces, coalesce(c.cuts, 0) AS cuts, coalesce(c.kept, 0) AS kept, k.risk*(1 - z.most/k.n) + greatest(0, coalesce(q.m, 0) - k.smean)/3 AS gain
 FROM s_risky k JOIN (SELECT field_id, gid, count(*) AS pieces, max(c) AS most FROM (SELECT field_id, gid, piece, count(*) AS c FROM s_pieces GROUP BY 1, 2, 3) GROUP BY 1, 2) z USING (field_id, gid)
 LEFT JOIN (SELECT field_id, gid, count(*) FILTER (cut_risk >= 1.15) AS cuts, count(*) FILTER (cut_risk < 1.15) AS kept FROM s_cutrisk GROUP BY 1, 2) c USING (field_id, gid)
 LEFT JOIN (SELECT field_id, gid, avg(m) AS m FROM (SELECT e.field_id, e.gid, a.piece, avg(score) AS m FROM s_cutrisk e
   JOIN s_pieces a ON a.field_id = e.field_id AND a.gid = e.gid AND a.node = e.i JOIN s_pieces b ON b.field_id = e.field_id AND b.gid = e.gid AND b.node = e.j AND a.piece = b.piece
   GROUP BY 1, 2, 3) GROUP BY 1, 2) q USING (field_id, gid))""", "s_risky", "s_pieces", "s_cutrisk")


@query("group_risk_features", f"""
SELECT field_id, gid, {r('saddle', 'saddle_to_peak_ratio', 4)}, {r('gap', 'ridge_gap_fraction', 4)}, CAST(peaks AS BIGINT) AS multi_peak_count, {r('sep', 'largest_peak_separation_beam', 4)},
 {r('wf', 'weak_edge_fraction', 4)}, {r('of', 'only_2sigma_edge_fraction', 4)}, chain AS chain_merge_flag, big AS large_mask_swallow_flag, {r('risk', 'local_overmerge_risk_score', 4)} FROM a_risk""", ("a_risk",))
def group_risk_features(spark, sf):
    members, _, groups, snr, *_ = small_groups(spark, sf)
    found = sanity.risk_features(cut(groups.join(sanity.path_features(members, snr, fx.SMALL), ["field_id", "gid"])), fx.SMALL)
    return rounded(found.select(
        "field_id", "gid", "saddle_to_peak_ratio", "ridge_gap_fraction", "multi_peak_count", "largest_peak_separation_beam", "weak_edge_fraction",
        "only_2sigma_edge_fraction", "chain_merge_flag", "large_mask_swallow_flag", "local_overmerge_risk_score"), 4)


cte("s_treelines", """
SELECT q.field_id, q.gid, q.i, q.j, any_value(q.fl) AS fl, any_value(q.sep) AS sep, min(s.snr) AS low, avg(CAST(s.snr < 2.5 AS DOUBLE)) AS gap
FROM (SELECT *, CASE WHEN k = n - 1 THEN x2 ELSE x1 + k*((x2-x1)/(n-1)) END AS sx, CASE WHEN k = n - 1 THEN y2 ELSE y1 + k*((y2-y1)/(n-1)) END AS sy
 FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, greatest(3, CAST(ceil(sep*2) AS INT) + 1) AS n
  FROM (SELECT a.field_id, a.gid, e.i, e.j, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, greatest(0, least(a.pk, b.pk)) AS fl, sqrt(pow(b.x-a.x,2) + pow(b.y-a.y,2))/2 AS sep
   FROM s_final e JOIN s_peaks a ON a.field_id = e.field_id AND a.component_index = e.i JOIN s_peaks b ON b.field_id = e.field_id AND b.component_index = e.j AND b.gid = a.gid
   WHERE e.decision)))) q
JOIN snr s ON s.field_id = q.field_id AND s.y = round_even(sy, 0) AND s.x = round_even(sx, 0) GROUP BY 1, 2, 3, 4""", "s_final", "s_peaks", "snr")
# One edge of each group after the other, best first: it gets in where its ends still have different labels.
cte("s_treeranks", """
SELECT t.*, row_number() OVER (PARTITION BY t.field_id, t.gid ORDER BY low DESC, i, j) AS k, a.at AS ai, b.at AS aj
FROM s_treelines t
JOIN (SELECT field_id, gid, component_index, row_number() OVER (PARTITION BY field_id, gid ORDER BY component_index) AS at FROM s_peaks) a ON a.field_id = t.field_id AND a.gid = t.gid AND a.component_index = i
JOIN (SELECT field_id, gid, component_index, row_number() OVER (PARTITION BY field_id, gid ORDER BY component_index) AS at FROM s_peaks) b ON b.field_id = t.field_id AND b.gid = t.gid AND b.component_index = j""", "s_treelines", "s_peaks")
cte("s_treewalk", """
SELECT field_id, gid, CAST(0 AS BIGINT) AS k, range(count(*) + 1) AS tags, CAST(false AS BOOLEAN) AS took FROM s_peaks GROUP BY 1, 2
UNION ALL
SELECT w.field_id, w.gid, t.k, CASE WHEN tags[ai + 1] <> tags[aj + 1] THEN list_transform(tags, lambda v: CASE WHEN v = tags[aj + 1] THEN tags[ai + 1] ELSE v END) ELSE tags END, tags[ai + 1] <> tags[aj + 1]
FROM s_treewalk w JOIN s_treeranks t ON t.field_id = w.field_id AND t.gid = w.gid AND t.k = w.k + 1""", "s_peaks", "s_treeranks")


@query("all_peak_features", f"""
SELECT p.field_id, p.gid, p.n AS members, CAST(coalesce(f.edges, 0) AS BIGINT) AS tree_edges,
 {r("CASE WHEN f.saddle IS NULL THEN 1 ELSE greatest(-1, least(1.5, f.saddle)) END", 'all_saddle_to_peak_ratio', 4)}, {r('coalesce(f.gap, 0)', 'all_ridge_gap_fraction', 4)}
FROM (SELECT field_id, gid, count(*) AS n FROM s_peaks GROUP BY 1, 2) p
LEFT JOIN (SELECT field_id, gid, count(*) AS edges, min(low/greatest(fl, 1e-6)) FILTER (sep >= 1 AND fl > 0) AS saddle, max(gap) FILTER (sep >= 1 AND fl > 0) AS gap
 FROM s_treewalk w JOIN s_treeranks USING (field_id, gid, k) WHERE took GROUP BY 1, 2) f USING (field_id, gid)""", ("s_peaks", "s_treewalk", "s_treeranks"))
def all_peak_features(spark, sf):
    members, edges, _, snr, *_ = small_groups(spark, sf)
    return rounded(sanity.all_peak_features(members, edges, snr, fx.SMALL), 4)


@query("edge_cut_risk", f"SELECT field_id, gid, i AS component_index_1, j AS component_index_2, {r('cut_risk', 'cut_risk', 4)} FROM s_cutrisk", ("s_cutrisk",))
def edge_cut_risk(spark, sf):
    members, edges, *_ = small_groups(spark, sf)
    inner = inner_edges(edges, members.select("field_id", "component_index", "gid"))
    return rounded(inner.select("field_id", "gid", "component_index_1", "component_index_2", sanity.edge_cut_risk(fx.SMALL).alias("cut_risk")), 4)


@shared
def checked(spark, sf):
    from fieldlink.plans.stage1 import associate

    # Every step reads these again, so they are derived from the events once.
    return associate(cut(fx.pixel_components(spark, sf)), cut(fx.pixels(spark, sf)), cut(fx.fields(spark, sf)), fx.SMALL)


cte("s_newgid", """SELECT m.field_id, m.component_index, m.gid AS old_gid, coalesce(p.piece, m.gid) AS gid, v.split IS NOT NULL AND v.split AS split FROM s_members m
LEFT JOIN s_verdict v USING (field_id, gid) LEFT JOIN s_pieces p ON p.field_id = m.field_id AND p.gid = m.gid AND p.node = m.component_index AND v.split""", "s_members", "s_verdict", "s_pieces")
cte("s_local", """
SELECT n.field_id, n.gid, n.old_gid, n.size, n.split, g.group_index, g.association_group_id AS original_id,
 row_number() OVER (PARTITION BY n.field_id ORDER BY g.group_index, n.size DESC, n.gid) - 1 AS local_index
FROM (SELECT field_id, gid, old_gid, count(*) AS size, bool_or(split) AS split FROM s_newgid GROUP BY 1, 2, 3) n
JOIN s_groups g ON g.field_id = n.field_id AND g.gid = n.old_gid""", "s_newgid", "s_groups")


@query("local_split", """
SELECT field_id, gid, split AS split_from_original, CAST(size AS BIGINT) AS n_gaussians, local_index AS local_group_index, original_id AS original_association_group_id,
 CASE WHEN split THEN field_id || '_l' || format('{:03d}', local_index) ELSE original_id END AS local_group_id FROM s_local""", ("s_local",))
def local_split(spark, sf):
    return checked(spark, sf).local.local_groups.select(
        "field_id", "gid", "split_from_original", "n_gaussians", "local_group_index", "original_association_group_id", "local_group_id")


@query("local_sanity_diagnostics", f"""
SELECT k.field_id, g.association_group_id AS original_group_id, k.n AS n_gaussians_before, CAST(CASE WHEN v.split THEN v.pieces ELSE 1 END AS BIGINT) AS n_groups_after_split,
 coalesce(v.split, false) AS split_applied, coalesce(v.reason, '') AS split_reason, {r("CASE WHEN v.reason IS NOT NULL AND NOT v.split THEN greatest(k.risk, 1.5) ELSE k.risk END", 'local_overmerge_risk_score', 4)},
 {r('k.saddle', 'saddle_to_peak_ratio', 4)}, {r('k.gap', 'ridge_gap_fraction', 4)}, {r('k.wf', 'weak_edge_fraction', 4)}, {r('k.of', 'only_2sigma_edge_fraction', 4)}
FROM s_risk k JOIN s_groups g USING (field_id, gid) LEFT JOIN s_verdict v USING (field_id, gid)""", ("s_risk", "s_groups", "s_verdict"))
def local_sanity_diagnostics(spark, sf):
    return rounded(checked(spark, sf).local.diagnostics, 4)


@query("local_groups")
def local_groups(spark, sf):
    from fieldlink.functions.geometry import format_box

    local = checked(spark, sf).local.local_groups
    return local.withColumn("bounding_box", format_box(F.col("box"))).drop("box")


@query("review_queue")
def review_queue(spark, sf):
    return checked(spark, sf).local.review
