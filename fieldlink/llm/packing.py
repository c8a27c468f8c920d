"""Best-fit decreasing packing of token sequences, with one plan for all documents.

Best fit looks only at lengths, and lengths are bounded by the sequence size, so
the decisions for any number of pieces follow from a histogram of at most
``size`` rows.  The plan takes lengths from the largest down; a segment tree over
remaining capacities finds the tightest open bin in logarithmic time, and runs of
equal pieces that meet runs of equal bins are placed in one step.  Every piece
then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from fieldlink.lineage import cut

#: Pieces of one length are ranked in groups of about so many.
RANK_GROUP = 2_000


class OpenBins:
    """Segment tree over remaining capacities 0..size: which of them have open bins, smallest first."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, first: int, count: int) -> None:
        self.runs[capacity].append((first, count))
        at = capacity + self.leaves
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def take(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        if not self.runs[capacity]:
            at = capacity + self.leaves
            self.some[at] = 0
            while (at := at >> 1) and not (self.some[2 * at] or self.some[2 * at + 1]):
                self.some[at] = 0
        return run

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` with an open bin; -1 if there is none."""
        at = least + self.leaves
        while not self.some[at]:
            while at & 1:  # nothing to the right under this parent
                at >>= 1
            if at == 0:
                return -1
            at += 1
            if at & (at - 1) == 0:  # left the last leaf of this level
                return -1
        while at < self.leaves:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, pieces, pieces per bin, first bin, offset in the bin) of best-fit decreasing."""
    bins, opened, steps = OpenBins(size), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = bins.tightest(length)
            if capacity < 0:
                capacity, fresh = size, -(-left // (size // length))
                bins.add(size, opened, fresh)
                opened += fresh
            first, count = bins.take(capacity)
            each = capacity // length
            whole = min(count, left // each)
            if not whole:
                each, whole = left, 1
            steps.append((length, rank, whole * each, each, first, size - capacity))
            rank, left = rank + whole * each, left - whole * each
            if capacity - each * length:
                bins.add(capacity - each * length, first, whole)
            if count > whole:
                bins.add(capacity, first + whole, count - whole)
    return steps


def pieces(encoded: DataFrame, size: int, end_id: int, ids_col: str = "ids") -> DataFrame:
    """One row per piece of every document, with ``piece``, ``start``, ``length`` and its part of ``ids``.

    The end id is put behind every document first, so empty documents give one
    piece of one id.  Documents of more than ``size`` ids are cut so that only
    their first piece may be shorter than ``size``.  Other columns are kept.
    """
    keep = [c for c in encoded.columns if c not in (ids_col, "n_tokens")]
    end = "".join(f"{b:02X}" for b in end_id.to_bytes(4, "little"))
    n = F.floor(F.octet_length("_ids") / 4)
    rows = (
        encoded.select(*(f"`{c}`" for c in keep), F.concat(F.coalesce(F.col(ids_col), F.expr("X''")), F.expr(f"X'{end}'")).alias("_ids"))
        .withColumn("_last", (F.ceil(n / size) - 1).cast("int"))
        .withColumn("_head", (n - F.col("_last") * size).cast("long"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        .withColumn("start", F.when(F.col("piece") == 0, F.lit(0).cast("long")).otherwise(F.col("_head") + (F.col("piece") - 1).cast("long") * size))
        .withColumn("length", F.when(F.col("piece") == 0, F.col("_head")).otherwise(F.lit(size).cast("long")))
    )
    part = F.substring("_ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return rows.select(*(f"`{c}`" for c in keep), "piece", "start", "length", part.alias("ids"))


def pack(rows: DataFrame, size: int, length_col: str = "length") -> DataFrame:
    """The rows with ``sequence_id`` and ``offset`` (long): best-fit decreasing into bins of ``size``.

    All columns are carried.  Lengths that are null, below 1 or above ``size`` fit
    nowhere and get nulls.  Equal rows are packed as separate rows; which of the
    pieces of one length goes where is free.  ``rows`` is read more than once, so
    hand in a written table.
    """
    spark, tag = rows.sparkSession, f"_{uuid.uuid4().hex[:8]}"
    length, group, rank, block = f"length{tag}", f"group{tag}", f"rank{tag}", f"block{tag}"
    fits = F.col(f"`{length_col}`").cast("long").between(1, size)
    found = rows.filter(fits).groupBy(F.col(f"`{length_col}`").cast("long").alias("n")).count().collect()  # at most `size` rows
    counts = {r["n"]: r["count"] for r in found}
    steps = best_fit(counts, size)

    sizes = spark.createDataFrame([(n, -(-c // RANK_GROUP)) for n, c in counts.items()], f"{length} long, groups{tag} long")
    keyed = rows.withColumn(length, F.when(fits, F.col(f"`{length_col}`").cast("long")))
    spread = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))
    keyed = keyed.join(F.broadcast(sizes), length, "left").withColumn(group, F.pmod(spread, f"groups{tag}"))  # at most `size` rows
    totals = keyed.groupBy(length, group).count()
    before = totals.select(
        F.col(length).alias(f"l{tag}"), F.col(group).alias(f"g{tag}"),
        (F.sum("count").over(Window.partitionBy(length).orderBy(group)) - F.col("count")).alias(f"before{tag}"),
    )
    ordered = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(length, group).orderBy(spread)) - 1)
    ranked = ordered.join(before, (F.col(length) == F.col(f"l{tag}")) & (F.col(group) == F.col(f"g{tag}")), "left").withColumn(
        rank, F.col(rank) + F.col(f"before{tag}")
    ).withColumn(block, F.floor(F.col(rank) / RANK_GROUP))
    plan = spark.createDataFrame(
        steps, f"pl{tag} long, pr{tag} long, pn{tag} long, pe{tag} long, pb{tag} long, po{tag} long"
    ).withColumn(
        f"pk{tag}",
        F.explode(F.sequence(F.floor(F.col(f"pr{tag}") / RANK_GROUP), F.floor((F.col(f"pr{tag}") + F.col(f"pn{tag}") - 1) / RANK_GROUP))),
    )
    within = F.col(rank) - F.col(f"pr{tag}")
    placed = ranked.join(
        plan,
        (F.col(length) == F.col(f"pl{tag}")) & (F.col(block) == F.col(f"pk{tag}")) & (within >= 0) & (within < F.col(f"pn{tag}")),
        "left",
    )
    return placed.select(
        *(f"`{c}`" for c in rows.columns),
        (F.col(f"pb{tag}") + F.floor(within / F.col(f"pe{tag}"))).alias("sequence_id"),
        (F.col(f"po{tag}") + within % F.col(f"pe{tag}") * F.col(length)).alias("offset"),
    )


def pack_documents(encoded: DataFrame, size: int, end_id: int) -> DataFrame:
    """Piece rows with their place: the ids stay behind, their crc32 stands for them."""
    light = pieces(encoded, size, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut(light), size)
