"""Host galaxies around pair midpoints and lobe peaks: lookup, priority, scores, log.

``hosts``: host_id, host_ra, host_dec, w1, w2, w1_snr, w2_snr, cc_flags, catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldlink.config import Config
from fieldlink.functions import geometry as g
from fieldlink.operators.ranking import top_k
from fieldlink.operators.sky import cone_join

RANKS = {"none": 0, "low": 1, "medium": 2, "high": 3}


def quality_rank(quality: Column) -> Column:
    out = F.lit(0)
    for name, value in RANKS.items():
        out = F.when(quality == name, value).otherwise(out)
    return out


def search_radius(distance: Column, cfg: Config) -> Column:
    h = cfg.hosts
    return F.least(F.lit(h.max_radius_arcsec), F.greatest(F.lit(h.min_radius_arcsec), h.radius_fraction * F.coalesce(distance, F.lit(0.0))))


def lookups(pairs: DataFrame, cfg: Config) -> DataFrame:
    """Three positions per pair: the great-circle midpoint and the brightest member of each end."""
    p = cfg.parents
    lobe = F.lit(min(max(p.lobe_radius_min, cfg.beam.size_arcsec), p.lobe_radius_max))
    a, b = F.col("a"), F.col("b")
    mid_ra, mid_dec = g.sky_midpoint(a["ra"], a["dec"], b["ra"], b["dec"])
    role = lambda name, ra, dec, radius: F.struct(F.lit(name).alias("role"), ra.alias("ra"), dec.alias("dec"), radius.alias("radius"))
    spots = F.array(
        role("midpoint", mid_ra, mid_dec, search_radius(F.col("center_distance_arcsec"), cfg)),
        role("lobe1_peak", a["peak_ra"], a["peak_dec"], lobe), role("lobe2_peak", b["peak_ra"], b["peak_dec"], lobe),
    )
    return pairs.select("field_id", "group_index_1", "group_index_2", "a", "b", F.explode(spots).alias("_l")).select(
        "field_id", "group_index_1", "group_index_2", F.col("_l.role").alias("role"), F.col("_l.ra").alias("q_ra"), F.col("_l.dec").alias("q_dec"),
        F.col("_l.radius").alias("q_radius"), a["ra"].alias("ra1"), a["dec"].alias("dec1"), b["ra"].alias("ra2"), b["dec"].alias("dec2"),
    )


#: A host that lies on the radius is inside, whichever way its separation (arcsec) was rounded.
ON_RADIUS = 1e-6
LOOKUP = ["field_id", "group_index_1", "group_index_2", "role"]


def nearest() -> list[Column | str]:
    """Nearest first.  Separations, like scores, that agree to three places are ties: the rest is rounding that differs with the turn of the sky."""
    return [F.round("separation_arcsec", 3), "host_id"]


def priority(catalogue: Column, cfg: Config) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(cfg.hosts.catalogues):
        out = F.when(catalogue == name, i).otherwise(out)
    return out


def cone_hits(places: DataFrame, hosts: DataFrame, cfg: Config) -> DataFrame:
    """Every host of a known catalogue within the radius of a lookup; the smaller table is the one that is copied to cells."""
    known = hosts.filter(priority(F.col("catalogue"), cfg).isNotNull()).drop("field_id")
    widest = max(cfg.hosts.max_radius_arcsec, cfg.parents.lobe_radius_max)
    return cone_join(places, known, "q_ra", "q_dec", "host_ra", "host_dec", "q_radius", widest, copy_sources=known.count() < places.count(), rounding=ON_RADIUS)


def first_catalogue(hits: DataFrame, order: list[Column | str], cfg: Config) -> DataFrame:
    """Hits of the first catalogue that has any, at most the row limit per lookup in the given order, with ``host_rank``.

    Rows of the first catalogue come first in the cut to the limit, so no aggregate has to be joined back.
    """
    known = hits.withColumn("_catalogue", priority(F.col("catalogue"), cfg))
    kept = top_k(known, LOOKUP, [F.col("_catalogue"), *order], cfg.hosts.max_rows_per_lookup)
    first = F.min("_catalogue").over(W.partitionBy(*LOOKUP))
    return kept.withColumn("_first", first).filter("_catalogue = _first").withColumnRenamed("_rank", "host_rank").drop("_first", "_catalogue")


def cross_match(places: DataFrame, hosts: DataFrame, cfg: Config) -> DataFrame:
    """Hits of the first catalogue that has any, at most the row limit per lookup (nearest first)."""
    return first_catalogue(cone_hits(places, hosts, cfg), nearest(), cfg).drop("host_rank")


def asked(places: DataFrame, cfg: Config) -> DataFrame:
    """Every lookup once for each catalogue that was asked, those up to the ``_first`` with results, with ``n_results`` (``_hits`` of the first)."""
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(cfg.hosts.catalogues)])
    told = places.withColumn("_c", F.explode(names)).filter(F.col("_first").isNull() | (F.col("_c.i") <= F.col("_first")))
    return told.withColumns({"catalogue": F.col("_c.n"), "_i": F.col("_c.i"), "n_results": F.when(F.col("_c.i") == F.col("_first"), F.col("_hits")).otherwise(0).cast("long")}).drop("_c")


def query_log(places: DataFrame, hits: DataFrame, cfg: Config) -> DataFrame:
    """One row per lookup and catalogue that was asked: those up to the first with results."""
    counted = hits.groupBy(*LOOKUP, priority(F.col("catalogue"), cfg).alias("_i")).agg(F.count("*").alias("_n"))
    found = counted.groupBy(*LOOKUP).agg(F.min("_i").alias("_first"), F.min_by("_n", "_i").alias("_hits"))
    log = asked(places.select(*LOOKUP, "q_ra", "q_dec", "q_radius").join(found, LOOKUP, "left"), cfg).select(
        *LOOKUP, F.col("q_ra").alias("ra"), F.col("q_dec").alias("dec"), F.col("q_radius").alias("radius_arcsec"), "catalogue", "_i", F.lit("ok").alias("status"), "n_results",
        F.format_string("%s_%.7f_%.7f_%.2f", F.col("catalogue"), F.col("q_ra"), F.col("q_dec"), F.col("q_radius")).alias("query_id"),
    )
    if cfg.hosts.max_lookups is not None:
        log = log.orderBy(*LOOKUP, "_i").limit(cfg.hosts.max_lookups)
    return log.drop("_i")


def is_flagged(cc_flags: Column) -> Column:
    code = F.trim(F.coalesce(cc_flags, F.lit("")))
    return (code != "") & ~F.lower(code).isin("0000", "0", "nan", "none")


def midpoint_quality(red: Column, cfg: Config) -> Column:
    """Quality of a scored midpoint host."""
    h = cfg.hosts
    perp, frac, value = F.col("host_perp_offset_beam"), F.col("host_fractional_position"), F.col("host_score")
    colour_ok = red | F.lit(not h.colour_required)
    gate = lambda low, offset, span: g.yes((value >= low) & (perp <= offset) & frac.between(*span)) & colour_ok
    return (
        F.when(gate(h.high_score, h.high_max_perp_beam, h.high_position), "high").when(gate(h.medium_score, h.medium_max_perp_beam, h.medium_position), "medium")
        .when(F.col("separation_arcsec") <= F.col("q_radius") + ON_RADIUS, "low").otherwise("none")
    )


def score_midpoint(hits: DataFrame, cfg: Config) -> DataFrame:
    """Closeness, axis consistency, detection, colour and artifact terms of midpoint hosts."""
    h = cfg.hosts
    across, along = g.axis_offsets(*[F.col(c) for c in ("ra1", "dec1", "ra2", "dec2", "host_ra", "host_dec")])
    snr = [g.finite(F.col(c)) for c in ("w1_snr", "w2_snr")]
    seen = snr[0].isNotNull().cast("int") + snr[1].isNotNull().cast("int")
    total = sum((F.coalesce(g.clip(v / h.snr_scale, 0.0, 1.0), F.lit(0.0)) for v in snr), F.lit(0.0))
    placed = hits.select(
        "*", (across / cfg.beam.size_arcsec).alias("host_perp_offset_beam"), along.alias("host_fractional_position"),
        (F.col("w1") - F.col("w2")).alias("w1_w2"),
        F.when(seen > 0, total / seen).when(F.col("w1").isNotNull(), h.catalogued_w1).otherwise(0.0).alias("_detect"),
        F.trim(F.coalesce("cc_flags", F.lit(""))).alias("_cc"),
    )
    perp = F.col("host_perp_offset_beam")
    red = g.yes(F.col("w1_w2") >= h.colour_min)
    flagged = is_flagged(F.col("cc_flags"))
    score = (
        h.w_closeness * g.clip(1.0 - F.col("separation_arcsec") / F.col("q_radius"), 0.0, 1.0)
        + h.w_axis * F.coalesce(g.clip(1.0 - perp / h.medium_max_perp_beam, 0.0, 1.0), F.lit(0.0)) + h.w_detection * F.col("_detect")
        + F.when(red, h.colour_bonus).otherwise(0.0) - F.when(flagged, h.w_artifact).otherwise(0.0)
    )
    scored = placed.withColumn("host_score", score)
    return scored.select("*", midpoint_quality(red, cfg).alias("host_quality"), F.when(flagged, F.concat(F.lit("cc_flags="), F.col("_cc"))).otherwise("").alias("host_flags")).drop("_detect", "_cc")


def score_lobe_peaks(hits: DataFrame, cfg: Config) -> DataFrame:
    p = cfg.parents
    part = lambda c, w: F.coalesce(w * F.least(g.finite(F.col(c)) / p.lobe_snr_scale, F.when(g.finite(F.col(c)).isNotNull(), 1.0)), F.lit(0.0))
    seen = hits.withColumn("_d", part("w1_snr", p.lobe_w1) + part("w2_snr", p.lobe_w2))
    detect = F.when((F.col("_d") == 0) & F.col("w1").isNotNull(), p.lobe_catalogued).otherwise(F.col("_d"))
    scored = seen.withColumn(
        "host_score", p.lobe_w_closeness * g.clip(1.0 - F.col("separation_arcsec") / F.col("q_radius"), 0.0, 1.0) + p.lobe_w_detection * detect
    )
    near = F.col("separation_arcsec") <= p.lobe_high_radius * F.col("q_radius")
    return scored.withColumn(
        "host_quality", F.when((F.col("host_score") >= p.lobe_high) & near, "high").when(F.col("host_score") >= p.lobe_medium, "medium").otherwise("low")
    ).drop("_d")


def ranked(scored: DataFrame, cfg: Config) -> DataFrame:
    """Best hosts of the first catalogue with hits: score descending, separation ascending (both to three places), then id; the row limit comes after the scores."""
    return first_catalogue(scored, [-F.round("host_score", 3), *nearest()], cfg)
