"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two vectors: an embedding of its hash bucket and the mean of
embeddings of its hashed character trigrams.  Windows of ``SPAN`` words, each
overlapping the next, are read in both directions; attention pools the states of
a window into one logit.  A document scores as its worst window, and all windows
of all words are scored.

Training takes a bounded labelled sample: at most ``PER_CLASS`` documents of
either class, with all their windows.  A toxic document stands for its worst window
(found anew in every epoch), a clean one for several of its worst.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from fieldlink.llm.common import with_number
from fieldlink.llm.labelled import sample

PER_CLASS = 1000
EPOCHS = 9
#: Documents of the sample that a word's bucket must occur in to be learnt, and the weight decay.
COMMON, DECAY = 3, 0.003
SPAN, STEP = 32, 24
WORD_BUCKETS, CHAR_BUCKETS = 8192, 4096
WORD_DIM = CHAR_DIM = 8
HIDDEN = 8
BATCH = 256
GROUP = 8192
#: Sampled documents whose windows are laid out together.
TOGETHER = 50


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


# -- words and windows --------------------------------------------------------


class Words:
    """Distinct words of a batch: hash bucket, and trigram codes with where each word's begin."""

    def __init__(self, words: list[bytes]):
        self.bucket = np.array([xxhash.xxh3_64_intdigest(w) % WORD_BUCKETS for w in words], np.int64)
        data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint32)
        size = np.array([len(w) + 2 for w in words], np.int64)
        code = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(20) if len(data) > 2 else np.zeros(0, np.uint32)
        ends = np.cumsum(size)
        inside = np.ones(len(data), bool)
        inside[ends - 1] = inside[ends - 2] = False
        self.code = code[inside[: len(code)]].astype(np.int64)
        self.count = size - 2
        self.start = np.cumsum(self.count) - self.count

    def inputs(self, p: dict) -> np.ndarray:
        """A row of inputs per distinct word."""
        if not len(self.count):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        chars = np.add.reduceat(p["chars"][self.code], self.start, 0) / self.count[:, None].astype(np.float32)
        return np.concatenate([p["words"][self.bucket], chars], 1)


def windows(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, windows as rows of word numbers with -1 behind the end, window's text number).

    Lower-case words by white space; texts without words (null too) have no window.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    offsets = np.asarray(lists.offsets, np.int64)
    offsets, coded = offsets - offsets[0], lists.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    code = np.asarray(coded.indices, np.int64)
    if b"" in distinct:
        empty = distinct.index(b"")
        distinct[empty] = b" "
        keep = code != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        code = code[keep]
    size = np.diff(offsets)
    many = np.where(size > 0, np.maximum(1, -(-(size - SPAN) // STEP) + 1), 0)
    owner = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    first = offsets[owner] + nth * STEP
    at = first[:, None] + np.arange(SPAN)
    inside = at < offsets[owner + 1][:, None]
    return distinct, np.where(inside, code[np.where(inside, at, 0)], -1) if len(code) else np.zeros((0, SPAN), np.int64), owner


# -- network --------------------------------------------------------------------


def fresh(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    wide, h = WORD_DIM + CHAR_DIM, HIDDEN
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    # Words start at zero, so that a word not met in training adds nothing.
    p = {"words": np.zeros((WORD_BUCKETS, WORD_DIM), np.float32), "chars": draw(CHAR_BUCKETS, CHAR_DIM) * 30}
    for side in "fb":
        p |= {f"W{side}": draw(wide, 3 * h), f"U{side}": draw(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
    return p | {"A": draw(2 * h, 2 * h), "a": np.zeros(2 * h, np.float32), "v": draw(2 * h, 1)[:, 0], "o": draw(2 * h, 1)[:, 0], "b": np.zeros(1, np.float32)}


def _run(gates: np.ndarray, index: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction, (steps, windows, hidden); ``keep`` also returns what the gradient needs."""
    n, steps, h = len(index), index.shape[1], HIDDEN
    state = np.zeros((n, h), np.float32)
    states, trace = np.empty((steps, n, h), np.float32), []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        x, y = gates[index[:, t]], state @ u
        zr = _sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        c = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
        if keep:
            trace.append((t, state, z, r, c, y[:, 2 * h :]))
        state = state + mask[:, t, None] * (1 - z) * (c - state)
        states[t] = state
    return states, trace


def forward(p: dict, inputs: np.ndarray, index: np.ndarray, keep: bool = False):
    """Logits of windows; with ``keep`` also the parts of the computation."""
    mask = (index >= 0).astype(np.float32)
    safe = np.maximum(index, 0)
    sides = [_run(inputs @ p[f"W{s}"] + p[f"c{s}"], safe, mask, p[f"U{s}"], s == "b", keep) for s in "fb"]
    states = np.concatenate([sides[0][0], sides[1][0]], 2)
    seen = np.tanh(states @ p["A"] + p["a"])
    weight = np.where(mask.T > 0, seen @ p["v"], np.float32(-1e9))
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = (weight[:, :, None] * states).sum(0)
    logit = pooled @ p["o"] + p["b"][0]
    return (logit, (mask, safe, sides, states, seen, weight, pooled)) if keep else logit


def gradient(p: dict, words: Words, inputs: np.ndarray, index: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean cross entropy."""
    logit, (mask, safe, sides, states, seen, weight, pooled) = forward(p, inputs, index, True)
    h, g = HIDDEN, {}
    d = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
    g["o"], g["b"] = pooled.T @ d, np.array([d.sum()], np.float32)
    d_pooled = d[:, None] * p["o"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = (states * d_pooled).sum(2)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    g["v"] = (seen * d_score[:, :, None]).sum((0, 1))
    d_seen = d_score[:, :, None] * p["v"] * (1 - seen**2)
    flat = d_seen.reshape(-1, 2 * h)
    g["A"], g["a"] = states.reshape(-1, 2 * h).T @ flat, flat.sum(0)
    d_states += d_seen @ p["A"].T
    d_inputs = np.zeros_like(inputs)
    for k, s in enumerate("fb"):
        u, trace = p[f"U{s}"], sides[k][1]
        d_gates = np.zeros((len(inputs), 3 * h), np.float32)
        d_u, carry = np.zeros_like(u), np.zeros((len(index), h), np.float32)
        for t, before, z, r, c, yc in reversed(trace):
            m = mask[:, t, None]
            carry = carry + d_states[t, :, k * h : (k + 1) * h]
            d_z = -carry * m * (c - before) * z * (1 - z)
            d_c = carry * m * (1 - z) * (1 - c**2)
            d_r = d_c * yc * r * (1 - r)
            d_y = np.concatenate([d_z, d_r, d_c * r], 1)
            np.add.at(d_gates, safe[:, t], np.concatenate([d_z, d_r, d_c], 1))
            d_u += before.T @ d_y
            carry = carry * (1 - m * (1 - z)) + d_y @ u.T
        g[f"U{s}"], g[f"W{s}"], g[f"c{s}"] = d_u, inputs.T @ d_gates, d_gates.sum(0)
        d_inputs += d_gates @ p[f"W{s}"].T
    g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
    np.add.at(g["words"], words.bucket, d_inputs[:, :WORD_DIM])
    np.add.at(g["chars"], words.code, np.repeat(d_inputs[:, WORD_DIM:] / words.count[:, None].astype(np.float32), words.count, 0))
    return g


def score_windows(p: dict, words: list[bytes], index: np.ndarray) -> np.ndarray:
    inputs = Words(words).inputs(p)
    return np.concatenate([forward(p, inputs, index[i : i + GROUP]) for i in range(0, len(index), GROUP)]) if len(index) else np.zeros(0, np.float32)


def fit(words: list[bytes], index: np.ndarray, owner: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> dict[str, np.ndarray] | None:
    """Parameters from windows, their documents (ascending), and the documents' labels; None unless both labels occur."""
    if len(index) == 0 or len(set(label[np.unique(owner)].tolist())) < 2:
        return None
    p, rng = fresh(), np.random.default_rng(11)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    # Rare words would only be learnt by heart: their buckets stay at zero.
    bucket = np.append(Words(words).bucket, WORD_BUCKETS)
    met = [np.unique(owner[i : i + GROUP, None] * (WORD_BUCKETS + 1) + bucket[index[i : i + GROUP]]) for i in range(0, len(index), GROUP)]
    met = np.unique(np.concatenate(met)) % (WORD_BUCKETS + 1)
    common = (np.bincount(met, minlength=WORD_BUCKETS + 1)[:WORD_BUCKETS] >= COMMON)[:, None]
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    docs, truth, done = owner[starts], label[owner], 0
    for epoch in range(epochs):
        if epoch == 0:
            # Toxic windows are not known yet: every window carries its document's label.
            rows = rng.permutation(len(index))
        else:
            # Worst windows first within each document: one of a toxic document, eight of a clean one.
            logit = score_windows(p, words, index)
            order = np.lexsort((-logit, owner))
            nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))
            rows = rng.permutation(order[nth < np.where(truth[order] == 1, 1, 8)])
        share = truth[rows].mean()
        for at in range(0, len(rows), BATCH):
            take = rows[at : at + BATCH]
            used, local = np.unique(index[take], return_inverse=True)
            local = local.reshape(len(take), SPAN) - (used[0] == -1)
            part = Words([words[i] for i in used[used >= 0]])
            # Both classes weigh the same; repeated positives keep the step simple.
            target = truth[take].astype(np.float32)
            some = rng.random(len(take)) < np.where(target == 1, min(1, (1 - share) / max(share, 1e-6)), min(1, 2 * share / max(1 - share, 1e-6)))
            if not some.any():
                continue
            g, done = gradient(p, part, part.inputs(p), local[some], target[some]), done + 1
            g["words"] *= common
            rate = 0.01 * (0.3 if epoch > epochs - 3 else 1)
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                p[k] -= (rate * (m / (1 - 0.9**done)) / (np.sqrt(s / (1 - 0.999**done)) + 1e-7) + rate * DECAY * p[k]).astype(np.float32)
    # Move the bias so that the documents' worst windows part best at zero.
    worst = np.maximum.reduceat(score_windows(p, words, index), starts)
    y = label[docs] == 1
    cuts = np.sort(worst)
    middle = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    wrong = [((worst > c) & ~y).mean() / max(1e-9, (~y).mean()) + ((worst <= c) & y).mean() / max(1e-9, y.mean()) for c in middle]
    best = np.flatnonzero(np.array(wrong) == min(wrong))
    p["b"] = p["b"] - np.float32((middle[best[0]] + middle[best[-1]]) / 2)
    return p


def all_windows(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """As :func:`windows`, laid out for a few texts at a time and with small numbers."""
    number: dict[bytes, int] = {}
    index, owner = [np.zeros((0, SPAN), np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(texts), TOGETHER):
        words, rows, own = windows(pa.array(texts[at : at + TOGETHER], pa.string()))
        shared = np.array([number.setdefault(w, len(number)) for w in words] + [-1], np.int32)  # -1 stays -1
        index.append(shared[rows])
        owner.append(own + at)
    return list(number), np.concatenate(index), np.concatenate(owner)


# -- Spark ----------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int], per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """Fit on a bounded sample of rows; their whole texts reach the driver."""
    chosen, _ = sample(labels, "toxic", fold, per_class, id_col)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col)  # at most 2 * per_class rows
    found = rows.groupBy(id_col).agg(F.min("label").alias("label"), F.min("_text").alias("_text")).orderBy(id_col).collect()
    words, index, owner = all_windows([r["_text"] for r in found])
    return fit(words, index, owner, np.array([r["label"] for r in found], np.int64))


def with_score(docs: DataFrame, model: dict | None, name: str = "score", text_col: str = "text") -> DataFrame:
    """All rows and columns, and their score: sigmoid of the worst window's logit.

    Texts without words (null too) score 0; without a model all do.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of parameters

    def scores(texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if shared.value is not None:
            words, index, owner = windows(texts)
            if len(owner):
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                worst = np.maximum.reduceat(score_windows(shared.value, words, index), starts).astype(np.float64)
                out[owner[starts]] = 1 / (1 + np.exp(-np.clip(worst, -60, 60)))
        return out

    return with_number(docs, text_col, name, scores)
