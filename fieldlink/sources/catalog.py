"""Catalogue scan: column aliases, units, numeric coercion and validity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlink.functions import geometry as g
from fieldlink.lineage import cut

# Accepted input names per canonical column, first match wins, case is ignored.
ALIASES = {
    "source_id": ["Source_id", "SOURCE_ID", "source_id", "Source_id_1"],
    "island_id": ["Isl_id", "ISL_ID", "Island_id", "island_id"],
    "component_id": ["Gaussian_id", "GAUSSIAN_ID", "Gaus_id", "gaussian_id"],
    "ra": ["RA", "ra", "RA_deg", "ra_deg"],
    "dec": ["DEC", "Dec", "dec", "DEC_deg", "dec_deg"],
    "e_ra": ["E_RA", "e_RA", "ra_err", "E_RA_deg"],
    "e_dec": ["E_DEC", "e_DEC", "dec_err", "E_DEC_deg"],
    "total_flux": ["Total_flux", "TOTAL_FLUX", "total_flux", "Flux", "flux"],
    "peak_flux": ["Peak_flux", "PEAK_FLUX", "peak_flux"],
    "maj": ["Maj", "MAJ", "maj"],
    "min": ["Min", "MIN", "min"],
    "pa": ["PA", "pa"],
    "dc_maj": ["DC_Maj", "DC_MAJ", "dc_maj"],
    "dc_min": ["DC_Min", "DC_MIN", "dc_min"],
    "dc_pa": ["DC_PA", "dc_pa"],
    "s_code": ["S_Code", "S_CODE", "s_code"],
    "x": ["Xposn", "x", "X", "x_pix", "X_IMAGE"],
    "y": ["Yposn", "y", "Y", "y_pix", "Y_IMAGE"],
}
SIZES = ("maj", "min", "dc_maj", "dc_min")
NUMBERS = ("ra", "dec", "total_flux", "peak_flux", "maj", "min", "pa", "dc_maj", "dc_min", "dc_pa", "x", "y")
EXPECTED = ("total_flux", "peak_flux", "maj", "min")


def resolve_columns(names: list[str]) -> dict[str, str | None]:
    """Input column that serves each canonical name."""
    lower = {n.lower(): n for n in names}
    return {key: next((lower[a.lower()] for a in options if a.lower() in lower), None) for key, options in ALIASES.items()}


def missing_expected(names: list[str]) -> list[str]:
    found = resolve_columns(names)
    gone = [n for n in EXPECTED if not found[n]]
    if not (found["ra"] and found["dec"]) and not (found["x"] and found["y"]):
        gone.append("ra/dec or x/y")
    return gone


def number(column: Column) -> Column:
    """Double, or NULL for anything that is not a finite number."""
    return g.finite(column.cast("string").try_cast("double"))


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Zero-based row numbers in a stable order, counted per range partition.

    Only the partition totals, one row per partition, are accumulated centrally.
    """
    from pyspark.sql import Window as W

    ranged = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()))
    totals = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = totals.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_r", inside).join(before, "_p").withColumn(name, F.col("_o") + F.col("_r")).drop("_p", "_r", "_o")


def normalise(df: DataFrame, size_unit: str = "deg", order: list[str] | None = None) -> DataFrame:
    """Canonical columns in fixed order: sizes in arcsec, numbers or NULL, ids with defaults.

    A catalogue without ids needs ``order``, a list of columns that fixes the row order.
    """
    found = resolve_columns(df.columns)
    to_arcsec = {"deg": 3600.0, "arcmin": 60.0, "arcsec": 1.0}[size_unit]
    work, row = df, None
    if not (found["component_id"] and found["source_id"]):
        if order:
            work, row = row_numbers(df, order, "_row"), F.col("_row")
        else:
            raise ValueError("a catalogue without ids needs an order to number its rows by")
    out = []
    for key in ALIASES:
        column = F.col(f"`{found[key]}`") if found[key] else None
        if key in SIZES:
            value = number(column) * to_arcsec if column is not None else F.lit(None).cast("double")
        elif key in NUMBERS:
            value = number(column) if column is not None else F.lit(None).cast("double")
        elif key in ("source_id", "component_id"):
            value = column if column is not None else row
        elif key == "island_id":
            value = column if column is not None else F.lit(-1)
        elif key == "s_code":
            value = column if column is not None else F.lit("")
        else:
            value = number(column) if column is not None else F.lit(None).cast("double")
        out.append(value.alias(key))
    passed = [c for c in df.columns if c not in {v for v in found.values() if v} and c not in ALIASES]
    return work.select(*passed, *out)


def with_validity(df: DataFrame) -> DataFrame:
    sky = F.col("ra").isNotNull() & F.col("dec").isNotNull()
    return df.select("*", sky.alias("sky_valid"), (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("pixel_valid"))


def catalogue_issues(df: DataFrame, require_pixel: bool = False) -> DataFrame:
    """One row of counters over a normalised catalogue; all zero means clean."""
    v = with_validity(df)
    placed = F.col("pixel_valid") if require_pixel else F.col("sky_valid") | F.col("pixel_valid")
    counts = v.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("sky_valid") & ~F.col("ra").between(0, 360)).alias("n_bad_ra"),
        F.count_if(F.col("sky_valid") & ~F.col("dec").between(-90, 90)).alias("n_bad_dec"),
        F.count_if(~placed).alias("n_unplaced"),
        F.count_if(~g.yes((F.col("maj") > 0) & (F.col("min") > 0))).alias("n_bad_shape"),
    )
    doubled = duplicate_ids(df, ["component_id"]).agg(F.count("*").alias("n_duplicate_ids"))
    return counts.crossJoin(doubled)  # one row each


def duplicate_ids(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def unplaced_preview(df: DataFrame, require_pixel: bool = False) -> DataFrame:
    """The ten smallest ids of rows without usable coordinates."""
    v = with_validity(df)
    placed = F.col("pixel_valid") if require_pixel else F.col("sky_valid") | F.col("pixel_valid")
    return v.filter(~placed).select("component_id").orderBy("component_id").limit(10)


def require_clean(df: DataFrame, require_pixel: bool = False) -> None:
    """Raise on an empty catalogue, bad coordinates, bad axes or repeated ids."""
    row = catalogue_issues(df, require_pixel).first()
    if row["n_rows"] == 0:
        raise ValueError("catalogue is empty")
    faults = {k: row[k] for k in row.asDict() if k != "n_rows" and row[k]}
    if faults:
        detail = ", ".join(f"{k[2:]}={v}" for k, v in faults.items())
        ids = ", ".join(str(r[0]) for r in unplaced_preview(df, require_pixel).collect()) if row["n_unplaced"] else ""
        raise ValueError(f"catalogue check failed: {detail}" + (f"; ids without coordinates: {ids}" if ids else ""))


def index_issues(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Index values that are missing, fractional, out of range or repeated, with counts per kind."""
    kind = dict(df.dtypes)[column]
    value = F.col(column).try_cast("double") if kind != "boolean" else F.lit(None).cast("double")
    whole = g.yes((value == F.floor(value)) & (F.abs(value) < 9.2233720368547758e18))
    bad = df.agg(F.count_if(~whole).alias("n_not_integer"))
    return bad.crossJoin(duplicate_ids(df, [*keys, column]).agg(F.count("*").alias("n_repeated")))


def edge_issues(edges: DataFrame, nodes: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Self-loops, repeated unordered pairs and unknown ends of an edge table."""
    a, b = F.col("component_index_1"), F.col("component_index_2")
    loops = edges.agg(F.count_if(a == b).alias("n_self_loops"))
    repeated = edges.groupBy(*keys, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).count().filter("count > 1").agg(F.count("*").alias("n_repeated_pairs"))
    ends = edges.select(*keys, F.explode(F.array(a, b)).alias(node)).distinct()
    unknown = ends.join(nodes.select(*keys, node), [*keys, node], "left_anti").agg(F.count("*").alias("n_unknown_nodes"))
    return loops.crossJoin(repeated).crossJoin(unknown)


def ownership_issues(components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids repeated inside a field, ids owned by more than one field)."""
    per_field = components.filter(F.col("component_id").isNotNull()).groupBy("component_id", "field_id").agg(F.count("*").alias("n"))
    shared = per_field.groupBy("component_id").agg(F.count("*").alias("n_fields")).filter("n_fields > 1")
    return per_field.filter("n > 1"), shared


def partition_issues(members: DataFrame, components: DataFrame) -> DataFrame:
    """Components that are in no final group or in more than one."""
    key = ["field_id", "component_index"]
    held = members.groupBy(*key).agg(F.count("*").alias("n"))
    return components.select(*key).join(held, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n != 1")


def groups_match_graph(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows where the group table and the components of the decided graph disagree."""
    from fieldlink.operators.graph import cluster

    fresh = cluster(members.select("field_id", "component_index"), edges.filter("association_decision"), ["field_id"], "component_index",
                    "component_index_1", "component_index_2", "gid")
    have = members.select("field_id", "component_index", "gid")
    return have.exceptAll(fresh.select(*have.columns)).unionByName(fresh.select(*have.columns).exceptAll(have))
