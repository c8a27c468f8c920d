"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample; every row is filed under a leaf.  A query
walks the tree through a priority queue of nodes, keyed by the inner product with
their centres, and so meets the leaves best first.  How many leaves it visits is
calibrated: for a bounded set of rows the true neighbours among all rows are
found by brute force, and the number of visits is widened until they are reached
with the wanted recall.

Rows of a branch lie in blocks of bounded size, however many rows share a leaf; a
query meets the blocks of the branches it visits, one matrix product each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fieldlink.lineage import cut

#: Rows that the tree is fitted on, branches of a node, and sample rows below which a node is a leaf.
SAMPLE = 20_000
FAN = 8
LEAF = 24
#: Rows whose true neighbours calibrate the visits, and the recall they must reach.
CALIBRATION = 96
RECALL = 0.97
#: Most rows and most queries that meet in one task step.
BLOCK = 4096


class Tree:
    """Centres of all nodes; children of node i are ``first[i]..first[i]+many[i]``, leaves have none."""

    def __init__(self, sample: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centres, self.first, self.many, self.branch = [sample.mean(0) if len(sample) else np.zeros(0)], [0], [0], [0]
        queue = [(0, np.arange(len(sample)), 0)]
        for node, rows, depth in queue:
            if len(rows) <= LEAF or depth > 12:
                continue
            label, centres = self._split(sample[rows], rng)
            if len(centres) < 2:
                continue
            self.first[node], self.many[node] = len(self.centres), len(centres)
            for k, centre in enumerate(centres):
                self.centres.append(centre)
                self.first.append(0)
                self.many.append(0)
                # Blocks are made per branch: the second level of the tree.
                self.branch.append(len(self.centres) - 1 if depth < 2 else self.branch[node])
                queue.append((len(self.centres) - 1, rows[label == k], depth + 1))
        self.centres, self.first, self.many, self.branch = np.array(self.centres), np.array(self.first), np.array(self.many), np.array(self.branch)

    @staticmethod
    def _split(x: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
        distinct = np.unique(x[rng.permutation(len(x))[:512]], axis=0)
        centres = distinct[rng.permutation(len(distinct))[:FAN]]
        label = np.zeros(len(x), np.int64)
        for _ in range(8):
            label = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
            used = np.unique(label)
            centres = np.array([x[label == k].mean(0) for k in used])
            label = np.searchsorted(used, label)
        return label, centres

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row, nearest centre at each level."""
        at = np.zeros(len(x), np.int64)
        going = np.arange(len(x)) if self.many[0] else np.zeros(0, np.int64)
        while len(going):
            for node in np.unique(at[going]):
                rows = going[at[going] == node]
                a, n = self.first[node], self.many[node]
                c = self.centres[a : a + n]
                at[rows] = a + ((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            going = going[self.many[at[going]] > 0]
        return at

    def visit(self, scores: np.ndarray, leaves: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves of one query, best bin first; ``scores`` has its product with every centre.

        With ``rows`` per node, leaves are visited until they also hold ``least`` rows.
        """
        queue, out, held = [(-scores[0], 0)], [], 0
        while queue and (len(out) < leaves or held < least):
            _, node = heapq.heappop(queue)
            if not self.many[node]:
                out.append(node)
                held += least if rows is None else int(rows[node])
                continue
            for child in range(self.first[node], self.first[node] + self.many[node]):
                heapq.heappush(queue, (-scores[child], child))
        return out


def _matrix(column, kind: str) -> np.ndarray:
    return np.array([np.frombuffer(b, kind) for b in column]).astype(np.float64).reshape(len(column), -1)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in one fixed order of addition, so that equal vectors score equally."""
    return (x * q).sum(1)


def top(x: np.ndarray, ids: np.ndarray, uids: np.ndarray, q: np.ndarray, quid: int, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in x, scores) of the k best rows by score, then id, without the query's own; ``near`` are rough products (-inf: not asked)."""
    rough = np.where(uids == quid, -np.inf, near)
    some = np.flatnonzero(rough > -np.inf)
    if len(some) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        # Rough and exact products differ by rounding, which grows with the lengths of the vectors, not with their product.
        slack = 4 * len(q) * np.finfo(float).eps * np.sqrt((q**2).sum()) * np.sqrt((x**2).sum(1).max())
        some = np.flatnonzero(rough >= least - slack)
    score = exact(x[some], q)
    order = np.lexsort((uids[some], ids[some], -score))[:k]
    return some[order], score[order]


def prepare(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(id, uid, vector binary) of the rows that take part, and the kind of number in the vectors.

    Vectors of floats stay floats; all others are kept as doubles.

    Vectors that are null, empty, zero or hold null or non-finite components do
    not; neither do those of another length than most have (the longer of two
    equally frequent ones), nor rows without an id.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(sound & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["vec_id", "uid"]].assign(vector=[np.asarray(x, kind).tobytes() for x in b["v"]])

    kept = rows.filter(F.size("v") == (sizes["n"] if sizes else -1)).withColumn("uid", F.monotonically_increasing_id())
    return cut(kept.mapInPandas(pack, "vec_id long, uid long, vector binary")), kind


def search(vectors: DataFrame, query_filter, k: int, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``query_filter``.

    The score is the inner product in double precision; ties go to the smaller
    id.  A row is never its own neighbour, a repeated row is.  Repeated query rows
    give repeated results.  Every query gets k rows, or all others if they are fewer.
    """
    spark = vectors.sparkSession
    rows, kind = prepare(vectors, id_col, vector_col)
    by_hash = lambda n: rows.orderBy(F.xxhash64("vector", "uid"), "uid").limit(n)
    sample = [r["vector"] for r in by_hash(SAMPLE).select("vector").collect()]  # bounded
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(_matrix(sample, kind))
    shared = spark.sparkContext.broadcast(tree)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf = shared.value.file(_matrix(b["vector"], kind)) if len(b) else np.zeros(0, np.int64)
            yield b.assign(leaf=leaf, branch=shared.value.branch[leaf])

    filed = cut(rows.mapInPandas(file, "vec_id long, uid long, vector binary, leaf long, branch long"))
    visits = calibrate(filed, by_hash(CALIBRATION).collect(), tree, k, recall, kind)
    held = np.zeros(len(tree.many), np.int64)
    for r in filed.groupBy("leaf").count().collect():  # a row per leaf of the tree
        held[r["leaf"]] = r["count"]

    asked = filed.filter(query_filter).select(F.col("vec_id").alias("query_id"), F.col("uid").alias("quid"), F.col("vector").alias("query"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shared.value
        for b in batches:
            if not len(b):
                continue
            scores = _matrix(b["query"], kind) @ tree.centres.T
            out = []
            for i, s in enumerate(scores):
                leaves = np.array(tree.visit(s, visits, held, k + 1))
                branch = tree.branch[leaves]
                out += [(i, int(g), leaves[branch == g].astype("<i4").tobytes()) for g in np.unique(branch)]
            at = [x[0] for x in out]
            yield b.iloc[at].assign(branch=[x[1] for x in out], leaves=[x[2] for x in out])

    walked = asked.mapInPandas(walk, "query_id long, quid long, query binary, branch long, leaves binary")
    # Rows and queries of a branch are dealt to blocks of bounded size; every row block meets every query block.
    sides = {
        r["branch"]: (r["rows"], r["asks"])
        for r in filed.groupBy("branch").agg(F.count("*").alias("rows")).join(
            walked.groupBy("branch").agg(F.count("*").alias("asks")), "branch", "left"
        ).fillna(0).collect()  # a row per branch of the tree
    }
    parts = spark.createDataFrame([(b, max(1, -(-n // BLOCK)), max(1, -(-a // BLOCK))) for b, (n, a) in sides.items()], "branch long, row_parts long, ask_parts long")
    left = filed.join(F.broadcast(parts), "branch").select(
        "branch", F.pmod(F.xxhash64("uid"), "row_parts").alias("rp"), F.explode(F.expr("sequence(0, ask_parts - 1)")).alias("ap"), "vec_id", "uid", "vector", "leaf"
    )
    right = walked.join(F.broadcast(parts), "branch").select(
        "branch", F.explode(F.expr("sequence(0, row_parts - 1)")).alias("rp"), F.pmod(F.xxhash64("quid"), "ask_parts").alias("ap"), "query_id", "quid", "query", "leaves"
    )

    empty = {c: np.zeros(0, np.int64) for c in ("query_id", "quid", "vec_id", "uid")} | {"score": np.zeros(0)}

    def meet(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            x, ids, uids, leaf = _matrix(rows["vector"], kind), rows["vec_id"].to_numpy(), rows["uid"].to_numpy(), rows["leaf"].to_numpy()
            for at in range(0, len(asks), 256):
                part = asks.iloc[at : at + 256]
                q = _matrix(part["query"], kind)
                near = q @ x.T
                for i, (qid, quid, leaves) in enumerate(zip(part["query_id"], part["quid"], part["leaves"])):
                    asked_for = np.isin(leaf, np.frombuffer(leaves, "<i4"))
                    places, score = top(x, ids, uids, q[i], quid, np.where(asked_for, near[i], -np.inf), k)
                    out.append((np.full(len(places), qid), np.full(len(places), quid), ids[places], uids[places], score))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query_id", "quid", "vec_id", "uid", "score"), zip(*out))} if out else empty)

    keys = ["branch", "rp", "ap"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, quid long, vec_id long, uid long, score double")

    place = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid"))
    return met.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(filed: DataFrame, asks: list, tree: Tree, k: int, recall: float, kind: str) -> int:
    """The number of leaves that reaches the recall for the asking rows, against brute force over all rows."""
    q = _matrix([r["vector"] for r in asks], kind)
    quids = np.array([r["uid"] for r in asks])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, ids, uids, leaf = _matrix(b["vector"], kind), b["vec_id"].to_numpy(), b["uid"].to_numpy(), b["leaf"].to_numpy()
            near = q @ x.T
            for i in range(len(q)):
                places, score = top(x, ids, uids, q[i], quids[i], near[i], k)
                yield pd.DataFrame({"ask": i, "vec_id": ids[places], "uid": uids[places], "score": score, "leaf": leaf[places]})

    found = filed.mapInPandas(scan, "ask int, vec_id long, uid long, score double, leaf long")
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id", "uid"))
    true = found.withColumn("place", place).filter(F.col("place") <= k).select("ask", "leaf").collect()  # at most CALIBRATION * k rows
    scores, needed = q @ tree.centres.T, []
    order = [{leaf: n for n, leaf in enumerate(tree.visit(s, len(tree.many)), 1)} for s in scores]
    needed = [order[r["ask"]][r["leaf"]] for r in true]
    leaves = int((tree.many == 0).sum())
    visits, needed = 1, np.array(needed or [1])
    while visits < leaves and (needed <= visits).mean() < recall:
        visits = max(visits + 1, int(visits * 1.15))
    return min(visits, leaves)
