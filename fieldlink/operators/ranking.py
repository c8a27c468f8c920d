"""Positions, running totals and medians that never gather a key in one task.

``row_number() over (partition by field ...)`` sorts a whole field in a single
task.  When one field holds a large share of the rows that task never ends, so
positions are built from two bounded steps: rows are ranked inside small ordered
buckets, and the bucket totals are accumulated per field.  Medians narrow the
range of their ranks by counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldlink.lineage import cut

BUCKET_ROWS = 1 << 16


def running_total(
    df: DataFrame,
    keys: list[str],
    coarse: list[Column],
    order: list[Column],
    name: str,
    weight: Column | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows before this one.

    ``coarse`` must agree with ``order``: sorting by coarse and then by order is
    the same as sorting by order.  Each distinct coarse value is one bucket.
    """
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    marks = [f"_c{i}" for i in range(len(coarse))]
    tagged = df.select("*", *[c.alias(m) for c, m in zip(coarse, marks)], weight.alias("_w"))
    cells = keys + marks
    before = W.partitionBy(*keys).orderBy(*marks).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*cells)
        .agg(F.sum("_w").alias("_t"))
        .select(*cells, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    )
    inside = W.partitionBy(*cells).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        tagged.withColumn("_s", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .join(offsets, cells)
        .withColumn(name, F.col("_o") + F.col("_s"))
        .drop(*marks, "_w", "_s", "_o")
    )


def positions(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Zero-based position by a unique non-negative integer column."""
    bucket = F.floor(F.col(order) / F.lit(BUCKET_ROWS))
    return running_total(df, keys, [bucket], [F.col(order)], name)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "_rank") -> DataFrame:
    """First k rows per key.  Spark keeps k rows per map task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str, bins: int = 4096, small: int = 1 << 14) -> DataFrame:
    """Exact median per key by narrowing the range that holds the middle ranks.

    In a round the values between two bounds are counted in equal bins, combined
    before the shuffle; the bin of the wanted rank, cut to its least and greatest
    value, gives the next bounds.  This ends when a bin holds one value or at most
    ``small`` rows, which alone are sorted.  A far outlier thus costs one more
    round (values over hundreds of decades cost many, as each divides the range by ``bins``), and no task sees more than bins or ``small`` rows of a key, however the
    values lie.  Values must be finite; nulls take no part, and a key without
    values gives no row.
    """
    present = cut(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    whole = present.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    ranks = F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))
    state = cut(whole.select(*keys, "_lo", "_hi", "_n", F.lit(0).cast("long").alias("_under"), F.explode(ranks).alias("_r")))
    aim = [*keys, "_r"]
    settled = None
    rough = (F.col("_lo") < F.col("_hi")) & (F.col("_n") > small)
    while True:
        ended = state.filter(~rough).select(*aim, "_lo", "_hi", "_under")
        settled = ended if settled is None else settled.unionByName(ended)
        open_ = state.filter(rough)
        if open_.isEmpty():
            break
        inside = present.join(open_.drop("_n"), keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # Halves keep the width of the widest ranges finite.
        place = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins), F.lit(bins - 1).cast("long"))
        upto = W.partitionBy(*aim).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
        counted = (
            inside.groupBy(*aim, "_under", place.alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
            .withColumn("_before", F.col("_under") + F.sum("_n").over(upto) - F.col("_n"))
        )
        held = (F.col("_before") <= F.col("_r")) & (F.col("_r") < F.col("_before") + F.col("_n"))
        state = cut(counted.filter(held).select(*aim, "_lo", "_hi", "_n", F.col("_before").alias("_under")))
    flat = settled.filter("_lo = _hi").select(*aim, F.col("_lo").alias("_v"))
    narrow = present.join(settled.filter("_lo < _hi"), keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    order = F.row_number().over(W.partitionBy(*aim).orderBy("_v"))
    sorted_ = narrow.withColumn("_at", F.col("_under") + order - 1).filter("_at = _r").select(*aim, "_v")
    return flat.unionByName(sorted_).groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2.0).alias(name))
