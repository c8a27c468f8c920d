"""Votes, worst windows and likenesses against plain loops."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from fieldlink.llm import fingerprints, quality, toxicity


def text(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))


def test_quality_equals_a_plain_vote():
    rng = random.Random(4)
    texts = [text(rng, rng.randint(1, 60), "abcdef" if i % 3 else "defghi") for i in range(240)]
    labels = np.array([1 if i % 3 else 0 for i in range(240)])
    weight = {0: 2.5, 1: 1.0}
    space = quality.fit(quality.counts(texts), labels, weight)
    assert len(space.vectors) == 240  # every labelled vector takes part
    asked = [text(rng, rng.randint(1, 80), "abcdefghi") for _ in range(60)] + ["", None, "x", "é" * 50, texts[0], "word " * 200_000]
    raw = quality.counts(asked)
    got = space.score(raw)
    for vector, score in zip(space.project(raw), got):
        cosines = [float(np.dot(vector, v)) for v in space.vectors]
        near = sorted(range(240), key=lambda i: -cosines[i])[: quality.NEIGHBOURS]
        votes = [max(cosines[i], 1e-6) ** quality.SHARPNESS * weight[int(labels[i])] for i in near]
        assert score == pytest.approx(sum(v * labels[i] for v, i in zip(votes, near)) / sum(votes), abs=1e-4)
    assert ((got >= 0) & (got <= 1)).all()


def plain_windows(words):
    """32 words from every 24th on, until the last word is in."""
    if not words:
        return []
    starts = [0]
    while starts[-1] + toxicity.SPAN < len(words):
        starts.append(starts[-1] + 24)
    return [words[s : s + toxicity.SPAN] for s in starts]


def test_toxicity_is_the_worst_of_all_windows():
    rng = random.Random(6)
    p = toxicity.fresh()
    p["v"] = p["v"] + np.float32(0.3)
    texts = [text(rng, n) for n in (1, 5, 31, 32, 33, 56, 57, 80, 81, 300, 2500)]
    words, index, owner = toxicity.windows(pa.array(texts))
    logit = toxicity.score_windows(p, words, index)
    for i, t in enumerate(texts):
        alone = []
        covered = set()
        for part in plain_windows(t.split()):
            w, ix, _ = toxicity.windows(pa.array([" ".join(part)]))
            assert len(ix) == 1
            alone.append(float(toxicity.score_windows(p, w, ix)[0]))
            covered |= set(part)
        assert covered == set(t.split())
        assert logit[owner == i].max() == pytest.approx(max(alone), abs=1e-4), i


def shingles(t):
    data = t.encode()
    return {data[i : i + fingerprints.WIDTH] for i in range(max(1, len(data) - fingerprints.WIDTH + 1))} if data else set()


def test_likeness_equals_bottom_k_and_follows_true_resemblance():
    rng = random.Random(7)
    hash_of = lambda s: int(fingerprints.sketch(s.decode("latin-1"))[0])  # noqa: E731  a text of one shingle
    wrong = []
    for n in (0, 1, 2, 4, 12, 40, 300, 3000):
        for kept in (1.0, 0.9, 0.75, 0.4, 0.0):
            a = text(rng, n)
            cut = int(len(a) * kept)
            b = a[:cut] + text(rng, n, "stuvwxyz")[: len(a) - cut]
            x, y = shingles(a), shingles(b)
            # All shingles here are ASCII, so each can be hashed as a text of its own.
            hx, hy = ({hash_of(s) for s in z} for z in (x, y))
            k = fingerprints.K
            sa, sb = sorted(hx)[:k], sorted(hy)[:k]
            assert fingerprints.sketch(a).tolist() == sa and fingerprints.sketch(b).tolist() == sb
            low = sorted(set(sa) | set(sb))[:k]
            want = sum(h in set(sa) and h in set(sb) for h in low) / len(low) if low else 1.0
            got = fingerprints.resemblance(fingerprints.sketch(a), fingerprints.sketch(b))
            assert got == pytest.approx(want)
            true = len(x & y) / len(x | y) if x | y else 1.0
            wrong.append(abs(got - true))
            if len(x | y) <= k:
                assert got == pytest.approx(true)
    assert max(wrong) < 0.25 and np.mean(wrong) < 0.05
    assert hashlib.sha256(fingerprints.to_text(fingerprints.sketch("a" * 5000)).encode()).hexdigest() == hashlib.sha256(fingerprints.to_text(fingerprints.sketch("a" * 99)).encode()).hexdigest()
