"""Connected components and greedy matching as checkpointed DataFrame loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from fieldlink.lineage import cut, drop


def _star(edges: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """One contraction: every neighbour of a node is tied to the smallest one it can see."""
    if large:
        both = edges.select(*keys, "u", "v").unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Grouped minimum is combined map-side; the join back is a key join that
    # adaptive execution splits when one hub holds most neighbours.
    low = both.groupBy(*keys, "u").agg(F.min("v").alias("_low")).withColumn("_m", F.least("_low", "u"))
    tied = both.join(low.select(*keys, "u", "_m"), keys + ["u"])
    if large:
        out = tied.filter(F.col("v") > F.col("u")).select(*keys, F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        out = tied.select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(
            low.select(*keys, "u", F.col("_m").alias("v"))
        )
    return out.filter(F.col("u") != F.col("v"))


def component_labels(edges: DataFrame, keys: list[str], src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(keys, node, label): the smallest node connected to each node that has an edge.

    Alternating large-star and small-star contractions; the loop ends when the
    edge set no longer changes, which happens after a number of rounds that grows
    with the logarithm of the component size.  A round is one job at any size: its
    number and hash of edges are observed while they are written, and adaptive
    execution lets the number of tasks follow the edges.
    """
    work = edges.select(*keys, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    work, seal = _sealed(work, keys)
    for _ in range(max_rounds):
        if seal[0] == 0:
            break
        before = work
        work, fresh = _sealed(_star(_star(before, keys, True), keys, False).distinct(), keys)
        drop(before)
        if fresh == seal:
            break
        seal = fresh
    else:
        raise RuntimeError("connected components did not settle")
    roots = work.select(*keys, F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return work.select(*keys, F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _sealed(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, tuple]:
    """The written edges, and their number and hash as observed by the write."""
    seen = Observation()
    mark = F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))
    written = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(mark, F.lit(0)).alias("h")))
    return written, (seen.get["n"], seen.get["h"])


def cluster(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str, src: str, dst: str, label: str) -> DataFrame:
    """Every node with its component label; a node without edges is its own component."""
    found = component_labels(edges, keys, src, dst).withColumnRenamed("node", node)
    joined = nodes.join(found, keys + [node], "left").withColumn("_label", F.coalesce("label", node))
    return joined.drop("label").withColumnRenamed("_label", label)


def greedy_matching(
    edges: DataFrame,
    keys: list[str],
    left: str,
    right: str,
    order: list[Column],
    capacity: int = 1,
    rooms: tuple[str, str] | None = None,
) -> DataFrame:
    """The edges a sequential greedy pass would keep when every node takes at most ``capacity``.

    ``rooms`` names columns with the free places of both ends, where some were taken before;
    none is above ``capacity`` or below one, and a node has the same on all its edges.
    ``order`` ranks edges totally, smallest first.  In a round an edge is kept for
    sure when it is among the first free places at both of its ends.  An edge that
    waits for one better edge only is kept exactly if that one is not; such edges
    form chains, and the parity of the way to a sure edge is found by pointer
    jumping in steps of the logarithm of the chain.  Decided edges leave, and kept
    ones are written once, so a round reads and writes pending edges alone.
    """
    from fieldlink.operators.ranking import top_k

    marks = [f"_o{i}" for i in range(len(order))]
    ranked = [F.col(m) for m in marks]
    work = edges.select("*", *[c.alias(m) for c, m in zip(order, marks)], F.monotonically_increasing_id().alias("_edge"))
    whole = cut(work.withColumn("_left", F.col(left).cast("string")).withColumn("_right", F.col(right).cast("string")))
    places = [F.col(c) for c in rooms] if rooms else [F.lit(capacity)] * 2
    # The first round reads the written edges themselves.
    pending = whole.select(*keys, "_edge", "_left", "_right", *marks, *[c.cast("long").alias(f"_room_{s}") for c, s in zip(places, ("left", "right"))])
    kept = None
    while not pending.isEmpty():
        sides = F.explode(F.array(*(F.struct(F.col(f"_{s}").alias("node"), F.col(f"_room_{s}").alias("room")) for s in ("left", "right"))))
        ends = pending.select(*keys, "_edge", *marks, sides.alias("_s")).select(*keys, "_edge", *marks, F.col("_s.node").alias("_node"), F.col("_s.room").alias("_room"))
        line = W.partitionBy(*keys, "_node").orderBy(*ranked).rowsBetween(W.unboundedPreceding, 0)
        first = top_k(ends.withColumn("_best", F.first("_edge").over(line)), keys + ["_node"], ranked, capacity + 1)
        fits = F.col("_rank") <= F.col("_room")
        seen = first.groupBy("_edge").agg(
            F.count("*").alias("n"), F.count_if(fits).alias("good"), F.max(F.when((F.col("_room") == 1) & (F.col("_rank") == 2), F.col("_best"))).alias("before")
        )
        decided = _parities(
            seen.filter("n = 2 AND (good = 2 OR good = 1 AND before IS NOT NULL)")
            .select("_edge", F.when(F.col("good") == 2, F.col("_edge")).otherwise(F.col("before")).alias("to"), (F.col("good") == 1).alias("odd"))
        )
        taken = cut(pending.join(decided.filter("NOT odd"), "_edge", "left_semi").select("_edge", *keys, "_left", "_right"))
        kept = taken.select("_edge") if kept is None else kept.unionByName(taken.select("_edge"))
        full = taken.select(*keys, F.explode(F.array("_left", "_right")).alias("_node")).groupBy(*keys, "_node").agg(F.count("*").alias("_used"))
        rest = pending.join(decided, "_edge", "left_anti")
        for s in ("left", "right"):
            used = full.withColumnRenamed("_node", f"_{s}")
            rest = rest.join(used, keys + [f"_{s}"], "left").withColumn(f"_room_{s}", F.col(f"_room_{s}") - F.coalesce("_used", F.lit(0))).drop("_used")
        before, pending = pending, cut(rest.filter("_room_left > 0 AND _room_right > 0"))
        if hasattr(before, "_written_at"):
            drop(before)
        drop(decided)
    result = whole.limit(0) if kept is None else whole.join(kept, "_edge", "left_semi")
    return result.drop(*marks, "_edge", "_left", "_right")


def coincident_matching(points: DataFrame, keys: list[str], node: str, place: list[str], capacity: int) -> tuple[DataFrame, DataFrame]:
    """(edges between points of one place, points with free places and their ``room``).

    A greedy pass in order of distance, then of both nodes, comes first to the edges of
    length zero.  Of the points of a place in order of ``node`` it ties each ``capacity`` + 1
    to one another and fills them; the last ones, if fewer, are tied likewise and keep
    the rest of their room.  So the pairs of a crowded place need not be listed.
    Positions that are null or not finite take no part, and differences must not be
    so small that their squares vanish.
    """
    from fieldlink.operators.ranking import BUCKET_ROWS, running_total

    known = points.filter(" AND ".join(f"abs(`{c}`) < double('inf')" for c in place)).select(*keys, *place, node)
    ranked = running_total(known, [*keys, *place], [F.floor(F.col(node) / BUCKET_ROWS)], [F.col(node)], "_at")
    blocks = cut(ranked.groupBy(*keys, *place, F.floor(F.col("_at") / (capacity + 1)).alias("_block")).agg(F.collect_list(node).alias("_nodes")))
    one = blocks.select(*keys, "_nodes", F.explode("_nodes").alias(f"{node}_1"))
    edges = one.select(*keys, f"{node}_1", F.explode("_nodes").alias(f"{node}_2")).filter(F.col(f"{node}_1") < F.col(f"{node}_2"))
    free = blocks.filter(F.size("_nodes") <= capacity).select(*keys, F.explode("_nodes").alias(node), (F.lit(capacity + 1) - F.size("_nodes")).alias("room"))
    return edges, points.join(free, [*keys, node])


def _parities(chains: DataFrame) -> DataFrame:
    """(_edge, odd) of the edges whose chain of ``to`` ends in an edge that points to itself."""
    done = F.col("to") == F.col("_edge")
    work = cut(chains.withColumn("done", done))
    while not work.filter("NOT done").isEmpty():
        ahead = work.select(F.col("_edge").alias("to"), F.col("to").alias("_next"), F.col("odd").alias("_odd"), F.col("done").alias("_done"))
        # What points to an edge that is not among these, waits for more than one and leaves.
        jumped = work.filter("NOT done").join(ahead, "to").select("_edge", F.col("_next").alias("to"), (F.col("odd") != F.col("_odd")).alias("odd"), F.col("_done").alias("done"))
        before, work = work, cut(work.filter("done").unionByName(jumped))
        drop(before)
    out = work.select("_edge", "odd")
    out._written_at = work._written_at
    return out


def maximum_spanning_forest(edges: DataFrame, keys: list[str], src: str, dst: str, weight: str) -> DataFrame:
    """The edges of a spanning forest of largest weight per key; equal weights by ascending ends.

    Rounds after Boruvka: every component takes its best edge to another one, and
    components that these edges join become one.  Their number at least halves in a
    round.  Edges without a weight take no part; loops and second edges between the
    same nodes never get in.
    """
    best = F.struct(F.col(weight).alias("_w"), (-F.col(src)).alias("_s"), (-F.col(dst)).alias("_d"))
    work = cut(edges.filter(F.col(weight).isNotNull() & (F.col(src) != F.col(dst))).select(*keys, F.col(src).alias("_a"), F.col(dst).alias("_b"), best.alias("_e")))
    forest = None
    while not work.isEmpty():
        ends = work.select(*keys, F.explode(F.array("_a", "_b")).alias("_node"), F.struct("_e", "_a", "_b").alias("_p"))
        chosen = cut(ends.groupBy(*keys, "_node").agg(F.max("_p").alias("_p")).select(*keys, "_p._e", "_p._a", "_p._b").distinct())
        forest = chosen if forest is None else forest.unionByName(chosen)
        labels = cut(component_labels(chosen, keys, "_a", "_b"))
        moved = work
        for end in ("_a", "_b"):
            moved = moved.join(labels.select(*keys, F.col("node").alias(end), F.col("label").alias("_l")), keys + [end], "left")
            moved = moved.withColumn(end, F.coalesce("_l", end)).drop("_l")
        # Of several edges between two components only the best can get in.
        apart = moved.filter("_a != _b").groupBy(*keys, F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).agg(F.max("_e").alias("_e"))
        before, work = work, cut(apart)
        drop(before)
        drop(labels)
    if forest is None:
        return edges.limit(0)
    picked = forest.select(*keys, (-F.col("_e._s")).alias(src), (-F.col("_e._d")).alias(dst)).distinct()
    return edges.join(picked, [*keys, src, dst], "left_semi")
