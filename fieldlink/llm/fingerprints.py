"""Bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a text's shingles (16 bytes of
UTF-8 at every position; a shorter text is one shingle).  Sketches of parts merge
into the sketch of their union.  They estimate resemblance, containment and the
number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

K = 64
WIDTH = 16
#: Documents of a bucket of neighbouring ids, and the most buckets (two levels of a hundred bounds).
BUCKET_ROWS = 4000
FAN = 100


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending (fewer if there are fewer); none for an empty or null text."""
    data = (text or "").encode()
    n = len(data) - WIDTH + 1
    if not data:
        return np.zeros(0, np.uint64)
    if n < 1:
        return np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), "<u8").astype(np.uint64)
    low = np.ndarray(n, "<u8", data, 0, (1,))
    high = np.ndarray(n, "<u8", data, 8, (1,))
    hashes = _mix(_mix(low + np.uint64(0x9E3779B97F4A7C15)) + high)
    if n > 16 * k:
        some = np.unique(hashes[hashes < np.uint64(int(2**64 * (8 * k / n)))])
        if len(some) >= k:
            return some[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all; 1 for two empty texts."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k)
    return float(len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return min(1.0, common / distinct_shingles(a, k))


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def with_next(docs: DataFrame, id_col: str, text_col: str, fn, fields: str) -> DataFrame:
    """Apply ``fn(id, text, next_text, state, next_state)`` to every document and its successor by ascending id.

    Documents go to buckets of neighbouring ids (bounds from approximate
    quantiles, at most FAN * FAN); the head of every bucket is also sent to the
    bucket before it, the first document to the last bucket.  Null ids come
    first, rows of one id follow each other in the order of a text hash; null
    texts are empty.  ``state`` is what ``fn.prepare(text)`` gives, made once.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn(
        "_key", F.coalesce(F.col("_id").cast("long"), F.lit(-(2**63)))
    )
    keys = rows.select("_key")
    n = min(max(1, keys.count() // BUCKET_ROWS), FAN * FAN)
    bounds = sorted(set(keys.approxQuantile("_key", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    bounds = [int(b) for b in bounds]
    fine = [bounds[i : i + FAN] for i in range(0, len(bounds), FAN)] or [[]]
    tops = ",".join(f"{f[0]}L" for f in fine[1:])
    inner = ",".join("array(" + ",".join(f"{b}L" for b in f) + ")" for f in fine)
    below = lambda bounds: f"size(filter({bounds}, b -> b <= _key))"
    top = below(f"cast(array({tops}) as array<bigint>)")
    bucket = F.expr(f"{top} * {FAN + 1} + " + below(f"cast(get(array({inner}), {top}) as array<bigint>)"))
    heads = keys.withColumn("_bucket", bucket).groupBy("_bucket").agg(F.min("_key").alias("_head")).orderBy("_bucket").collect()  # a row per bucket
    before = [(r["_head"], heads[i - 1]["_bucket"]) for i, r in enumerate(heads)]
    ahead = spark.createDataFrame(before, "_key long, _before int")
    copies = (
        rows.withColumn("_bucket", bucket)
        .join(F.broadcast(ahead), "_key", "left")  # at most FAN * FAN rows
        .withColumn("_to", F.explode(F.array_compact(F.array(
            F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("copy")),
            F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("bucket"), F.lit(1).alias("copy"))),
        ))))
        .select("_to.bucket", "_to.copy", "_key", "_id", "_text")
    )
    placed = copies.repartition("bucket").sortWithinPartitions("bucket", "copy", "_key", F.xxhash64("_text"))
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, schema = None, None
        for batch in batches:
            schema = pa.schema([("_id", batch.schema.field("_id").type)])
            ids, out = [], []
            for bucket, copy, key, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                state = fn.prepare(text)
                if waiting and waiting[0] == bucket and not waiting[1]:
                    ids.append(waiting[2])
                    out.append(fn(waiting[3], text, waiting[4], state))
                waiting = (bucket, copy, key, text, state)
            if ids:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), *map(pa.array, columns)], ["_id", *names])

    return placed.select("bucket", "copy", "_key", "_id", "_text").mapInArrow(run, f"_id {kind}, {fields}").withColumnRenamed("_id", id_col)


class Edited:
    """Fingerprints of a document and of its edited text, whose last quarter comes from the next document."""

    fields = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    @staticmethod
    def prepare(text: str) -> np.ndarray:
        return sketch(text)

    def __call__(self, text: str, following: str, own: np.ndarray, theirs: np.ndarray) -> tuple:
        n = len(text)
        cut = n // 4
        edited = text[: n - cut] + following[:cut]
        other = own if edited == text else sketch(edited)
        return n, hashlib.sha256(edited.encode()).hexdigest(), to_text(own), to_text(other), resemblance(own, other), resemblance(own, theirs)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return with_next(docs, id_col, text_col, Edited(), Edited.fields)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, distinct_shingles): the sketch of every text; null and empty texts give an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([to_text(x) for x in found], pa.string()), pa.array([distinct_shingles(x) for x in found], pa.float64())],
                ["_id", "fingerprint", "distinct_shingles"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, fingerprint string, distinct_shingles double").withColumnRenamed("_id", id_col)
