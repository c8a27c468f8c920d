"""SQL twins of the fixture tables."""

from fieldlink.queries.base import cte

cte("nf", "SELECT greatest(1, count(*) // 300) AS n FROM orders")

cte("catalogue", """
SELECT o_orderkey % n AS field_id, o_orderkey AS component_id,
       CAST((o_orderkey*7919 + o_custkey*613) % 1000 AS DOUBLE) AS x,
       CAST((o_custkey*104729 + o_orderkey*31) % 1000 AS DOUBLE) AS y,
       o_totalprice/1000.0 AS total_flux, o_totalprice/1000.0/(1 + o_orderkey % 4) AS peak_flux,
       CAST(6 + o_custkey % 7 AS DOUBLE) AS maj, CAST(5 + o_orderkey % 3 AS DOUBLE) AS min,
       CAST((o_orderkey*13) % 180 AS DOUBLE) AS pa,
       CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 10 AS DOUBLE) * CAST(0.6 AS DOUBLE) END AS dc_maj,
       CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 5 AS DOUBLE) * CAST(0.5 AS DOUBLE) END AS dc_min,
       CAST((o_orderkey*13) % 180 AS DOUBLE) AS dc_pa, o_custkey % 40 AS island_id,
       CAST(150.0 AS DOUBLE) + (o_orderkey % n) * CAST(0.5 AS DOUBLE) + CAST((o_orderkey*7919 + o_custkey*613) % 1000 AS DOUBLE)/3600 AS ra,
       CAST(2.0 AS DOUBLE) + CAST((o_custkey*104729 + o_orderkey*31) % 1000 AS DOUBLE)/3600 AS dec,
       CAST(1.0 AS DOUBLE) AS pixel_scale
FROM orders, nf""", "nf")

cte("components", """
SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY component_id) - 1 AS component_index FROM catalogue
""", "catalogue")

cte("hosts", """
SELECT c_custkey AS host_id, c_custkey % n AS field_id,
       CAST(150.0 AS DOUBLE) + (c_custkey % n) * CAST(0.5 AS DOUBLE) + CAST((c_custkey*317 + c_nationkey*41) % 1000 AS DOUBLE)/3600 AS host_ra,
       CAST(2.0 AS DOUBLE) + CAST((c_custkey*733) % 1000 AS DOUBLE)/3600 AS host_dec,
       CAST(12.0 AS DOUBLE) + CAST(c_custkey % 50 AS DOUBLE)/10 AS w1,
       CAST(12.0 AS DOUBLE) + CAST(c_custkey % 50 AS DOUBLE)/10 - CAST(c_nationkey AS DOUBLE)/20 AS w2,
       abs(c_acctbal)/500.0 AS w1_snr, CASE WHEN c_custkey % 4 <> 0 THEN abs(c_acctbal)/700.0 END AS w2_snr,
       CASE WHEN c_custkey % 3 = 0 THEN 'allwise' ELSE 'catwise2020' END AS catalogue,
       CASE WHEN c_custkey % 11 = 0 THEN 'D000' ELSE '0000' END AS cc_flags
FROM customer, nf""", "nf")

cte("pixel_counts", """
SELECT event_type || '_' || CAST(user_id // 160 AS VARCHAR) AS field_id,
       CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS y,
       CAST(user_id % 32 AS INTEGER) AS x, CAST(count(*) AS DOUBLE) AS value
FROM events WHERE date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) BETWEEN 0 AND 29
GROUP BY 1, 2, 3""")

cte("fields", """
SELECT DISTINCT field_id, 32 AS width, 30 AS height, CAST(1.0 AS DOUBLE) AS pixel_scale, CAST(0.3 AS DOUBLE) AS rms,
       CAST(150.0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(split_part(field_id, '_', 2) AS DOUBLE) + CAST(5.0 AS DOUBLE) * (ascii(field_id) - 97) AS ra0,
       CAST(2.0 AS DOUBLE) AS dec0, CAST(16.5 AS DOUBLE) AS px0, CAST(15.5 AS DOUBLE) AS py0,
       CAST(-1.0 AS DOUBLE)/3600 AS step_x, CAST(1.0 AS DOUBLE)/3600 AS step_y
FROM pixel_counts""", "pixel_counts")

cte("pixels", """
SELECT f.field_id, gy.y, gx.x, coalesce(c.value, 0.0) AS value
FROM fields f CROSS JOIN (SELECT CAST(unnest(range(30)) AS INTEGER) AS y) gy
CROSS JOIN (SELECT CAST(unnest(range(32)) AS INTEGER) AS x) gx
LEFT JOIN pixel_counts c ON c.field_id = f.field_id AND c.y = gy.y AND c.x = gx.x""", "fields", "pixel_counts")

cte("pixel_components", """
SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY component_id) - 1 AS component_index FROM (
SELECT field_id, CAST(y AS BIGINT)*32 + x AS component_id,
       x + ((x*7 + y*3) % 5) * CAST(0.1 AS DOUBLE) AS x, y + ((x*3 + y*5) % 5) * CAST(0.1 AS DOUBLE) AS y,
       value AS total_flux, value/(1 + (x + y) % 3) AS peak_flux,
       CAST(2.0 AS DOUBLE) + (x % 4) * CAST(0.5 AS DOUBLE) AS maj, CAST(1.5 AS DOUBLE) + (y % 3) * CAST(0.25 AS DOUBLE) AS min,
       CAST((x*13 + y*7) % 180 AS DOUBLE) AS pa,
       CASE WHEN (x + y) % 3 <> 0 THEN (x % 5) * CAST(0.4 AS DOUBLE) END AS dc_maj,
       CASE WHEN (x + y) % 3 <> 0 THEN (y % 4) * CAST(0.3 AS DOUBLE) END AS dc_min,
       CAST((x*13 + y*7) % 180 AS DOUBLE) AS dc_pa, CAST(y // 5 AS BIGINT) AS island_id, CAST(1.0 AS DOUBLE) AS pixel_scale
FROM pixel_counts WHERE value >= 5)""", "pixel_counts")
