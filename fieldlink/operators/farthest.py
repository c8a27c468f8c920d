"""Largest distance inside point sets without pairing up whole sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SMALL_SET = 64
CHUNK = 20_000


def _outline(points: np.ndarray) -> np.ndarray:
    """Corner points of the convex outline (Andrew's scan)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(run):
        out = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def _diameter(points: np.ndarray) -> float:
    corners = _outline(points)
    best = 0.0
    for i in range(0, len(corners), 256):
        part = corners[i:i + 256]
        best = max(best, float(np.hypot(part[:, None, 0] - corners[None, :, 0], part[:, None, 1] - corners[None, :, 1]).max()))
    return best


def longest(points: Column) -> Column:
    """Largest distance among an array of (px, py) structs of bounded size."""
    far = lambda p, q: F.pow(p["px"] - q["px"], 2) + F.pow(p["py"] - q["py"], 2)
    per_point = F.transform(points, lambda p: F.array_max(F.transform(points, lambda q: far(p, q))))
    return F.sqrt(F.array_max(per_point))


def largest_distance(points: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Exact largest distance of (px, py) per key.

    The two farthest points are corners of the convex outline.  Small sets are
    compared directly; a large set is cut into bounded chunks whose outlines are
    found apart, and only outline corners meet in the last step.
    """
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = points.select(*keys, "px", "py").join(sizes, keys)
    lonely = sizes.filter(F.col("_n") == 1).select(*keys, F.lit(0.0).alias(name))
    few = (
        sized.filter(F.col("_n").between(2, SMALL_SET)).groupBy(*keys)
        .agg(longest(F.collect_list(F.struct("px", "py"))).alias(name))
    )
    many = sized.filter(F.col("_n") > SMALL_SET).withColumn(
        "_chunk", F.pmod(F.xxhash64("px", "py"), F.ceil(F.col("_n") / CHUNK)).cast("long")
    ).drop("_n")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _outline(pdf[["px", "py"]].to_numpy(float))
        frame = pd.DataFrame(out, columns=["px", "py"])
        for i, k in enumerate(keys):
            frame.insert(i, k, pdf[k].iloc[0])
        return frame

    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, name: [_diameter(pdf[["px", "py"]].to_numpy(float))]})

    outlines = many.groupBy(*keys, "_chunk").applyInPandas(corners, f"{key_schema}, px double, py double")
    return lonely.unionByName(few).unionByName(outlines.groupBy(*keys).applyInPandas(span, f"{key_schema}, {name} double"))
