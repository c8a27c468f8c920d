"""Range joins as equality joins on grid cells.

Each right-hand point is copied to the nine cells around it and the left-hand
point stays in its own cell, so every pair within one cell size meets exactly
once.  The join key is (keys, cell), which spreads a crowded field over as many
tasks as it has cells; a single crowded cell is left to the skew-join rule of
adaptive execution, which splits its left side and repeats its right side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Widens a cell a little, so that rounding of scaled positions loses no pair at the very limit.
ROUNDING = 1 + 1e-9


def cell(value: Column, size) -> Column:
    return F.floor(value / size).cast("long")


def with_cell(df: DataFrame, x: Column, y: Column, size) -> DataFrame:
    return df.withColumn("_cx", cell(x, size)).withColumn("_cy", cell(y, size))


def spread(df: DataFrame, x: Column, y: Column, size, reach: int = 1) -> DataFrame:
    steps = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    return (
        df.withColumn("_dx", F.explode(steps))
        .withColumn("_dy", F.explode(steps))
        .withColumn("_cx", cell(x, size) + F.col("_dx"))
        .withColumn("_cy", cell(y, size) + F.col("_dy"))
        .drop("_dx", "_dy")
    )


def near_join(left: DataFrame, right: DataFrame, keys: list[str], lx: str, ly: str, rx: str, ry: str, size) -> DataFrame:
    """Pairs whose points lie in the same or in touching cells (a superset of distance <= size).

    Column names other than ``keys`` must differ between the sides.
    """
    a = with_cell(left.filter(F.col(lx).isNotNull() & F.col(ly).isNotNull()), F.col(lx), F.col(ly), size)
    b = spread(right.filter(F.col(rx).isNotNull() & F.col(ry).isNotNull()), F.col(rx), F.col(ry), size)
    return a.join(b, keys + ["_cx", "_cy"]).drop("_cx", "_cy")


def cover(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size) -> DataFrame:
    """Copy a box to every grid cell it touches."""
    return df.withColumn("_cx", F.explode(F.sequence(cell(x0, size), cell(x1, size)))).withColumn(
        "_cy", F.explode(F.sequence(cell(y0, size), cell(y1, size)))
    )


def box_join(
    boxes: DataFrame, keys: list[str], id_col: str, box_col: str, gap: str, size: float
) -> DataFrame:
    """Unordered pairs of boxes no further apart than a per-row gap (pixels).

    ``gap`` names a column that is equal for all boxes of a key.  Both boxes are
    grown by half of it; two grown boxes that touch share the cell holding the
    lower corner of their common part, and the pair is kept only there, so no
    distinct is needed afterwards.
    """
    from fieldlink.functions.geometry import box_gap

    half = F.col(gap) / 2.0
    b = F.col(box_col)
    grown = boxes.filter(b.isNotNull()).select(
        *keys, F.col(id_col).alias("_id"), b.alias("_box"), F.col(gap).alias("_gap"),
        (b["x0"] - half).alias("_gx"), (b["y0"] - half).alias("_gy"),
        (b["x1"] + half).alias("_hx"), (b["y1"] + half).alias("_hy"),
    )
    covered = cover(grown, F.col("_gx"), F.col("_gy"), F.col("_hx"), F.col("_hy"), size).drop("_hx", "_hy")
    one = covered.select(*keys, "_cx", "_cy", "_gap", *[F.col(c).alias(c + "1") for c in ("_id", "_box", "_gx", "_gy")])
    two = covered.select(*keys, "_cx", "_cy", *[F.col(c).alias(c + "2") for c in ("_id", "_box", "_gx", "_gy")])
    met = one.join(two, keys + ["_cx", "_cy"]).filter(F.col("_id1") < F.col("_id2"))
    home = (cell(F.greatest("_gx1", "_gx2"), size) == F.col("_cx")) & (
        cell(F.greatest("_gy1", "_gy2"), size) == F.col("_cy")
    )
    return (
        met.filter(home & (box_gap(F.col("_box1"), F.col("_box2")) <= F.col("_gap")))
        .select(*keys, F.col("_id1").alias(f"{id_col}_1"), F.col("_id2").alias(f"{id_col}_2"))
    )
