"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Texts become counts of hashed byte trigrams and a few shares of byte classes.  A
truncated singular value decomposition of a bounded labelled sample gives the
latent space; the sample's vectors there (at most ``2 * PER_CLASS`` rows of
``RANK`` numbers) are broadcast.  Every document is projected, compared with all
of them by one exact block of cosines, and its nearest neighbours vote with their
similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldlink.llm.common import crc_mod, slices, with_number
from fieldlink.llm.labelled import sample

#: Labelled rows of either class that the space and the vote rest on.
PER_CLASS = 1500
BUCKETS = 2048
RANK = 48
NEIGHBOURS = 15
#: The cosine enters the vote with this power.
SHARPNESS = 8
GROUP = 256

# Byte classes: other, lower case, upper case, digit, white space, full stop or comma, other ASCII signs, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 6
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[[ord("."), ord(",")]], _CLASS[128:] = 4, 5, 7
CLASSES = 8
WIDTH = BUCKETS + CLASSES + 3


def counts(texts: list[str | None]) -> np.ndarray:
    """Raw features, a row per text: trigram counts, class shares, concentration, distinct share and log length."""
    raw = [(t or "").encode() for t in texts]
    n = len(raw)
    size = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(n), size)
    out = np.zeros((n, WIDTH), np.float32)
    if len(data) >= 3:
        wide = data.astype(np.uint32)
        code = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)) >> np.uint32(21)
        inside = owner[:-2] == owner[2:]
        out[:, :BUCKETS] = np.bincount((owner[:-2] * BUCKETS + code)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    some = np.maximum(size, 1)[:, None]
    out[:, BUCKETS : BUCKETS + CLASSES] = np.bincount(owner * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / some
    grams = out[:, :BUCKETS]
    total = np.maximum(grams.sum(1), 1)
    out[:, -3] = np.sqrt((grams.astype(np.float64) ** 2).sum(1)) / total
    out[:, -2] = (grams > 0).sum(1) / np.minimum(total, BUCKETS)
    out[:, -1] = np.log1p(size) / 10
    return out


@dataclass
class Space:
    """The latent space, the labelled vectors in it, and how much each of them counts."""

    idf: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    fallback: float

    def rows(self, raw: np.ndarray) -> np.ndarray:
        grams = np.log1p(raw[:, :BUCKETS]) * self.idf
        grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
        shape = np.clip((raw[:, BUCKETS:] - self.middle) / self.spread, -4, 4) * 0.25
        return np.concatenate([grams, shape], 1).astype(np.float32)

    def project(self, raw: np.ndarray) -> np.ndarray:
        latent = self.rows(raw) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity."""
        if not len(self.vectors):
            return np.full(len(raw), self.fallback)
        cosines = self.project(raw) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(np.float64) ** SHARPNESS * self.weights[near]
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def fit(raw: np.ndarray, labels: np.ndarray, weight: dict[int, float]) -> Space:
    """The space of a labelled sample.  Without labels every score is 0.5, with one class only it is that class."""
    seen = (raw[:, :BUCKETS] > 0).sum(0)
    space = Space(
        np.log((len(raw) + 1) / (seen + 1)).astype(np.float32) + 1, raw[:, BUCKETS:].mean(0) if len(raw) else np.zeros(WIDTH - BUCKETS),
        raw[:, BUCKETS:].std(0) + 1e-6 if len(raw) else np.ones(WIDTH - BUCKETS), np.zeros((WIDTH, 0), np.float32),
        np.zeros((0, 0), np.float32), labels.astype(np.float64), np.array([weight[int(x)] for x in labels]), float(labels[0]) if len(labels) else 0.5,
    )
    if len(set(labels.tolist())) < 2:
        return space
    rows = space.rows(raw)
    # Randomised range finder with two power steps.
    rng = np.random.default_rng(7)
    basis = np.linalg.qr(rows.T @ rng.standard_normal((len(rows), min(RANK + 16, len(rows)))).astype(np.float32))[0]
    for _ in range(2):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    turned = np.linalg.svd(rows @ basis, full_matrices=False)[2]
    space.axes = (basis @ turned.T)[:, :RANK].astype(np.float32)
    space.vectors = space.project(raw)
    return space


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int], per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Space:
    """Fit on a bounded sample; only its features (a fixed number per row) reach the driver."""
    chosen, weight = sample(labels, "quality", fold, per_class, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            raw = counts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in raw], pa.binary())], ["_id", "label", "raw"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col)  # at most 2 * per_class rows
    kind = docs.schema[id_col].dataType.simpleString()
    # Rows that share an id count once, so that the sample keeps its bound.
    found = rows.select(id_col, "label", "_text").mapInArrow(run, f"_id {kind}, label int, raw binary")
    found = found.groupBy("_id").agg(F.min(F.struct("label", "raw")).alias("r")).orderBy("_id").select("r.label", "r.raw").collect()
    raw = np.frombuffer(b"".join(r["raw"] for r in found), np.float32).reshape(-1, WIDTH)
    return fit(raw, np.array([r["label"] for r in found], np.int64), weight)


def with_score(docs: DataFrame, space: Space, name: str = "score", text_col: str = "text") -> DataFrame:
    """All rows and columns, and their score; null and empty texts are scored as texts without trigrams."""
    shared = docs.sparkSession.sparkContext.broadcast(space)  # at most 2 * per_class vectors

    def scores(texts: pa.Array) -> np.ndarray:
        groups = [shared.value.score(counts(texts.slice(at, GROUP).to_pylist())) for at in range(0, len(texts), GROUP)]
        return np.concatenate(groups)

    return with_number(docs, text_col, name, scores)


def held_out(fold: tuple[int, int], id_col: str = "doc_id"):
    return crc_mod(id_col, fold[0]) == fold[1]
