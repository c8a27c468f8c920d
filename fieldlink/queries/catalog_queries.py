"""Catalogue scan, checks, matching to fields and cross-match joins."""

from dataclasses import replace

from pyspark.sql import functions as F

from fieldlink import fixtures as fx
from fieldlink.config import Config
from fieldlink.functions import geometry as g, text
from fieldlink.operators import hosts as host_ops, matching
from fieldlink.operators.sky import cone_join, cone_search
from fieldlink.queries.base import cte, query, r, rounded
from fieldlink.sources import catalog, host_cache

SEP = "2*asin(least(1, sqrt(pow(sin(radians({d2}-({d1}))/2), 2) + cos(radians({d1}))*cos(radians({d2}))*pow(sin(radians({a2}-({a1}))/2), 2))))*180/pi()*3600"


def raw_catalogue(spark, sf):
    """Orders under catalogue names, sizes in degrees, one bad number in 97 rows."""
    k = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select(
        k.alias("Gaussian_id"), (k % 40).alias("Isl_id"), (150.0 + (k % 500) / 100.0).alias("RA"), (2.0 + (k % 300) / 100.0).alias("DEC"),
        F.when(k % 97 == 0, "bad").otherwise((F.col("o_totalprice") / 1000.0).cast("string")).alias("Total_flux"), (F.col("o_totalprice") / 4000.0).alias("Peak_flux"),
        ((6 + k % 7) / 3600.0).alias("Maj"), ((5 + k % 3) / 3600.0).alias("Min"), ((k * 13) % 180).cast("double").alias("PA"),
    )


@query("catalogue_scan", f"""
SELECT o_orderkey AS component_id, o_orderkey % 40 AS island_id, {r('CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice/1000.0 END', 'total_flux')}, {r('(6 + o_orderkey % 7)/3600.0*3600', 'maj')},
 {r('(5 + o_orderkey % 3)/3600.0*3600', 'min')}, CAST(NULL AS DOUBLE) AS dc_maj, '' AS s_code FROM orders""")
def catalogue_scan(spark, sf):
    df = catalog.normalise(raw_catalogue(spark, sf), order=["Gaussian_id"])
    return rounded(df.select("component_id", "island_id", "total_flux", "maj", "min", "dc_maj", "s_code"))


@query("catalogue_row_ids", "SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS component_id FROM orders")
def catalogue_row_ids(spark, sf):
    raw = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("Total_flux"))
    return catalog.normalise(raw, order=["k"]).select("k", "component_id")


@query("catalogue_issues", """
SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey % 50 = 0) AS n_bad_ra, count(*) FILTER (o_orderkey % 60 = 0) AS n_bad_dec, CAST(0 AS BIGINT) AS n_unplaced,
 count(*) FILTER (o_orderkey % 70 = 0) AS n_bad_shape, CAST((SELECT count(*) FROM (SELECT o_orderkey // 2 AS k FROM orders GROUP BY 1 HAVING count(*) > 1)) AS BIGINT) AS n_duplicate_ids FROM orders""")
def catalogue_issues(spark, sf):
    k = F.col("o_orderkey")
    df = fx.table(spark, sf, "orders").select(
        F.floor(k / 2).alias("component_id"), F.when(k % 50 == 0, 400.0).otherwise(150.0).alias("ra"), F.when(k % 60 == 0, -95.0).otherwise(2.0).alias("dec"),
        F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.when(k % 70 == 0, 0.0).otherwise(6.0).alias("maj"), F.lit(5.0).alias("min"))
    return catalog.catalogue_issues(df)


@query("edge_issues", """
WITH e AS (SELECT o_orderkey % 20 AS f, o_custkey % 100 AS i, o_orderkey % 90 AS j FROM orders)
SELECT count(*) FILTER (i = j) AS n_self_loops, (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY f, least(i, j), greatest(i, j) HAVING count(*) > 1)) AS n_repeated_pairs,
 (SELECT count(*) FROM (SELECT f, i AS n FROM e UNION SELECT f, j FROM e) WHERE n >= 95) AS n_unknown_nodes FROM e""")
def edge_issues(spark, sf):
    edges = fx.table(spark, sf, "orders").select((F.col("o_orderkey") % 20).alias("field_id"), (F.col("o_custkey") % 100).alias("component_index_1"), (F.col("o_orderkey") % 90).alias("component_index_2"))
    nodes = edges.select("field_id").distinct().withColumn("component_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(94).cast("long"))))
    return catalog.edge_issues(edges, nodes, ["field_id"], "component_index")


@query("ownership_issues", """
SELECT component_id, count(*) AS n_fields FROM (SELECT DISTINCT o_custkey AS component_id, o_orderkey % 5 AS f FROM orders) GROUP BY 1 HAVING count(*) > 1""")
def ownership_issues(spark, sf):
    df = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("component_id"), (F.col("o_orderkey") % 5).alias("field_id"))
    return catalog.ownership_issues(df)[1]


@query("cone_search", f"SELECT component_id, {r(SEP.format(a1='150.1', d1='2.1', a2='ra', d2='dec'), 'separation_arcsec', 4)} FROM catalogue WHERE {SEP.format(a1='150.1', d1='2.1', a2='ra', d2='dec')} <= 700", ("catalogue",))
def cone_search_query(spark, sf):
    found = cone_search(fx.catalogue(spark, sf), 150.1, 2.1, 700.0)
    return rounded(found.select("component_id", g.separation_arcsec(F.lit(150.1), F.lit(2.1), F.col("ra"), F.col("dec")).alias("separation_arcsec")), 4)


@query("cone_join", f"SELECT component_id, host_id, {r('s', 'separation_arcsec', 4)} FROM (SELECT c.component_id, h.host_id, {SEP.format(a1='c.ra', d1='c.dec', a2='h.host_ra', d2='h.host_dec')} AS s FROM catalogue c JOIN hosts h ON abs(c.dec - h.host_dec) < 0.02 AND abs(c.ra - h.host_ra) < 0.02) WHERE s <= 40",
       ("catalogue", "hosts"))
def cone_join_query(spark, sf):
    left = fx.catalogue(spark, sf).select("component_id", "ra", "dec", F.lit(40.0).alias("radius"))
    met = cone_join(left, fx.hosts(spark, sf).select("host_id", "host_ra", "host_dec"), "ra", "dec", "host_ra", "host_dec", "radius", 40.0, copy_sources=True)
    return rounded(met.select("component_id", "host_id", "separation_arcsec"), 4)


def sky_catalogue(spark, sf):
    """Bright cells as a sky catalogue: every fifth row keeps only its pixel position."""
    comps = fx.pixel_components(spark, sf).join(fx.fields(spark, sf).drop("width", "height", "pixel_scale", "rms", "mean"), "field_id")
    ra, dec = g.pixel_to_sky(*[F.col(c) for c in ("x", "y", "ra0", "dec0", "px0", "py0", "step_x", "step_y")])
    sky = F.col("component_id") % 5 != 0
    # Numbers of cells repeat from field to field; the position is one of all fields.
    block = F.split("field_id", "_")[1].cast("long")
    return comps.select("field_id", "component_id", ((block * 26 + F.ascii("field_id") - 97) * 960 + F.col("component_id")).alias("position"), "x", "y", F.when(sky, ra).alias("ra"), F.when(sky, dec).alias("dec"))


# Every row with a sky position goes to each field that covers it, its own or one that lies on the same part of the sky.
cte("sky_rows", """
SELECT component_id, position, (ra0 + degrees(atan2(xi, depth)) + 360) % 360 AS ra, degrees(atan2(sin(d0) + eta*cos(d0), sqrt(xi*xi + depth*depth))) AS dec
FROM (SELECT *, cos(d0) - eta*sin(d0) AS depth FROM (SELECT c.component_id, f.ra0, radians(f.dec0) AS d0, radians((c.x - (f.px0 - 1))*f.step_x) AS xi, radians((c.y - (f.py0 - 1))*f.step_y) AS eta,
  (CAST(split_part(f.field_id, '_', 2) AS BIGINT)*26 + ascii(f.field_id) - 97)*960 + c.component_id AS position
 FROM pixel_components c JOIN fields f USING (field_id) WHERE c.component_id % 5 <> 0))""", "pixel_components", "fields")
cte("sky_centres", """
SELECT *, (ra0 + degrees(atan2(xi, depth)) + 360) % 360 AS rac, degrees(atan2(sin(d0) + eta*cos(d0), sqrt(xi*xi + depth*depth))) AS decc, 0.5*sqrt(width*width + height*height)*pixel_scale + 5 AS reach
FROM (SELECT *, cos(d0) - eta*sin(d0) AS depth FROM (SELECT *, radians(dec0) AS d0, radians(((width - 1)/2.0 - (px0 - 1))*step_x) AS xi, radians(((height - 1)/2.0 - (py0 - 1))*step_y) AS eta FROM fields))""", "fields")
cte("sky_met", f"""
SELECT field_id, component_id, position, px0 - 1 + degrees(cos(d)*sin(t)/depth)/step_x AS x, py0 - 1 + degrees((cos(d0)*sin(d) - sin(d0)*cos(d)*cos(t))/depth)/step_y AS y, 'sky' AS match_mode, width, height
FROM (SELECT *, sin(d0)*sin(d) + cos(d0)*cos(d)*cos(t) AS depth FROM (SELECT f.* EXCLUDE (xi, eta, depth), c.component_id, c.position, radians(c.dec) AS d, radians(c.ra - f.ra0) AS t, {SEP.format(a1='f.rac', d1='f.decc', a2='c.ra', d2='c.dec')} AS s
 FROM (SELECT *, (unnest(range(-1, 2)) + CAST(floor(rac*100) AS BIGINT) + 36000) % 36000 AS strip FROM sky_centres) f JOIN (SELECT *, CAST(floor(ra*100) AS BIGINT) % 36000 AS strip FROM sky_rows) c USING (strip)) WHERE s <= reach)
UNION ALL
SELECT field_id, component_id, (CAST(split_part(field_id, '_', 2) AS BIGINT)*26 + ascii(field_id) - 97)*960 + component_id, x, y, 'pixel', 32, 30 FROM pixel_components WHERE component_id % 5 = 0""", "sky_centres", "sky_rows", "pixel_components")
cte("matches", "SELECT *, x >= 0 AND x < width AND y >= 0 AND y < height AS inside FROM sky_met", "sky_met")


@query("match_components", f"""
SELECT field_id, component_id, row_number() OVER (PARTITION BY field_id ORDER BY position) - 1 AS component_index, {r('x', 'x', 4)}, {r('y', 'y', 4)}, match_mode FROM matches WHERE inside""", ("matches",))
def match_components(spark, sf):
    inside, _ = matching.match_components(sky_catalogue(spark, sf), fx.fields(spark, sf), replace(Config(), preselect_margin_arcsec=5.0), 60.0)
    return rounded(inside.select("field_id", "component_id", "component_index", "x", "y", "match_mode"), 4)


@query("matching_diagnostics", f"""
SELECT field_id, coalesce(n, 0) AS n_gaussians_matched, '30x32' AS image_shape, CASE WHEN pixel THEN 'mixed' ELSE 'sky' END AS match_mode,
 {r('x0', 'min_x', 4)}, {r('x1', 'max_x', 4)}, {r('y0', 'min_y', 4)}, {r('y1', 'max_y', 4)}, coalesce(outside, 0) AS n_outside_after_projection, CASE WHEN coalesce(n, 0) = 0 THEN 'no_gaussians_matched' ELSE '' END AS warning
FROM fields LEFT JOIN (SELECT field_id, count(*) FILTER (inside) AS n, count(*) FILTER (NOT inside) AS outside, bool_or(match_mode = 'pixel') AS pixel,
 min(x) FILTER (inside) AS x0, max(x) FILTER (inside) AS x1, min(y) FILTER (inside) AS y0, max(y) FILTER (inside) AS y1 FROM matches GROUP BY 1) USING (field_id)""", ("fields", "matches"))
def matching_diagnostics(spark, sf):
    _, found = matching.match_components(sky_catalogue(spark, sf), fx.fields(spark, sf), replace(Config(), preselect_margin_arcsec=5.0), 60.0)
    return rounded(found, 4)


@query("box_text", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat_ws(',', CAST(least(a, c) AS VARCHAR), CAST(least(b, d) AS VARCHAR), CAST(greatest(a, c) AS VARCHAR), CAST(greatest(b, d) AS VARCHAR)) END AS box
FROM (SELECT o_orderkey, o_orderkey % 100 AS a, o_custkey % 80 AS b, o_custkey % 120 AS c, o_orderkey % 60 AS d FROM orders)""")
def box_text(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.when(k % 9 == 0, "bad").otherwise(F.concat_ws(",", *[v.cast("string") for v in (k % 100, c % 80, c % 120, k % 60)]))
    return fx.table(spark, sf, "orders").select(k.alias("k"), g.format_box(g.parse_box(raw)).alias("box"))


@query("id_lists", "SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR) AS ids FROM orders")
def id_lists(spark, sf):
    raw = F.concat_ws(", ", F.col("o_orderkey").cast("string"), F.lit("x"), F.concat(F.col("o_custkey").cast("string"), F.lit(".0")), F.lit(""))
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.join_ids(text.parse_ids(raw)).alias("ids"))


@query("host_rows", f"""
SELECT CAST(c_custkey AS VARCHAR) AS host_id, {r('c_custkey/100.0', 'host_ra')}, {r("CASE WHEN c_custkey % 7 <> 0 THEN 12.0 + c_nationkey/10.0 END", 'w1')}, {r("CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey/10.0 - 1 END", 'w1_w2')},
 CASE WHEN c_custkey % 7 = 0 THEN 'W1' ELSE '' END AS missing_wise_columns FROM customer""")
def host_rows(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    raw = fx.table(spark, sf, "customer").select(k.alias("Name"), (k / 100.0).alias("RA_ICRS"), (n / 10.0).alias("DE_ICRS"),
                                                 F.when(k % 7 != 0, 12.0 + n / 10.0).alias("W1mag"), F.lit(13.0).alias("w2mpro"))
    return rounded(host_cache.normalise_hosts(raw, "allwise").select("host_id", "host_ra", "w1", "w1_w2", "missing_wise_columns"))


@query("host_repair", f"""SELECT CAST(c_custkey AS VARCHAR) AS host_id, {r('c_custkey/100.0', 'host_ra')}, {r('12.0 + c_nationkey/10.0', 'w1')} FROM customer""")
def host_repair(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    raw = fx.table(spark, sf, "customer").select(k.alias("Name"), (k / 100.0).alias("RA_ICRS"), (n / 10.0).alias("DE_ICRS"), (12.0 + n / 10.0).alias("W1mag"), F.lit(13.0).alias("w2mpro"))
    stored = host_cache.normalise_hosts(raw, "allwise")
    broken = stored.withColumn("host_ra", F.when(F.col("host_id").cast("long") % 3 != 0, F.col("host_ra"))).withColumn("w1", F.when(F.col("host_id").cast("long") % 4 != 0, F.col("w1")))
    return rounded(host_cache.repair(broken).select("host_id", "host_ra", "w1"))


@query("pending_fields", """SELECT DISTINCT o_orderkey % 40 AS field_id FROM orders WHERE (o_orderkey % 40) % 3 <> 0""")
def pending_fields(spark, sf):
    from fieldlink.sources.tables import pending_fields as pending

    fields = fx.table(spark, sf, "orders").select((F.col("o_orderkey") % 40).alias("field_id")).distinct()
    first = fields.select("field_id", F.lit("done").alias("status"), F.lit("2024-01-01").alias("time_end"))
    later = fields.select("field_id", F.when(F.col("field_id") % 3 == 0, "done").otherwise("failed").alias("status"), F.lit("2024-01-02").alias("time_end"))
    return pending(fields, first.unionByName(later))
