"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldlink.llm.common import crc_mod


def sample(labels: DataFrame, column: str, fold: tuple[int, int], per_class: int, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, float]]:
    """(id, label) of at most ``per_class`` rows of either class, and how many rows each of them stands for.

    Rows of the held-out fold (crc32 of the id modulo ``fold[0]`` is ``fold[1]``),
    without an id, or with another label than 0 and 1 are not used; an id counts
    once, with its smallest label.  Which rows are taken follows from a hash of the id.
    """
    rows = (
        labels.select(F.col(id_col), F.col(column).cast("int").alias("label"))
        .filter(~crc_mod(id_col, fold[0]).isin(fold[1], -1) & F.col("label").isin(0, 1))
        .groupBy(id_col).agg(F.min("label").alias("label"))
    )
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    taken = [r for label in totals for r in rows.filter(F.col("label") == label).orderBy(F.xxhash64(id_col), id_col).limit(per_class).collect()]
    weight = {label: n / min(n, per_class) for label, n in totals.items()}
    return rows.sparkSession.createDataFrame(taken, rows.schema), weight
