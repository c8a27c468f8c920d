"""Near copies, personal data, fingerprints, classifiers and search against plain Python."""

import hashlib
import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldlink.llm import ann, fingerprints, near_dup, pii, quality, toxicity


def word(rng):
    return "".join(rng.choices("abcdefg", k=rng.randint(2, 6)))


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    rows = [(None, "no id here at all today"), (-1, None), (-2, ""), (-3, " \n"), (-4, "one two"), (-5, "ONE  two"), (-6, "one two three"), (7, "same id one two three four five"), (7, "same id one two three four five")]
    for base in range(8):
        words = [word(rng) for _ in range(rng.choice([12, 60, 200]))]
        for copy in range(12):
            new = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                new[rng.randrange(len(new))] = word(rng)
            rows.append((100 * (base + 1) + copy, " ".join(new)))
    return rows


def plain_components(rows, n):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append(frozenset(zip(*(w[i:] for i in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[root(j)] = root(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return sets, groups


def test_components_equal_all_pairs(spark, copies):
    sets, groups = plain_components(copies, 4)
    want = []
    for members in groups.values():
        low = min((copies[i][0] for i in members if copies[i][0] is not None), default=None)
        want += [(copies[i][0], len(sets[i]), low, copies[i][0] == low) for i in members]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in copies], "doc_id long, text string, label int, node string").repartition(3)
    got = [tuple(r) for r in near_dup.components(docs, 4).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert near_dup.components(docs.limit(0), 4).count() == 0
    _, fives = plain_components(copies, 5)
    alone = sum(not (copies[g[0]][1] or "").split() for g in fives.values())
    kept = near_dup.one_of_each(docs, 5)
    assert kept.columns == docs.columns and kept.count() == len(fives) and alone == 3


def test_components_of_texts_just_below_the_limit_and_of_repeated_rows(spark):
    # Texts with a few changes each against one base: most pairs lie between 0.6 and 0.8, some links cross between them.
    rng = random.Random(11)
    base = [word(rng) + str(i) for i in range(140)]
    rows = []
    for k in range(150):
        new = list(base)
        for i in rng.sample(range(8, 132, 3), rng.choice([3, 4, 5, 6])):
            new[i] = rng.choice(["red", "green", "blue"])
        rows.append((k, " ".join(new)))
    rows += [(500 + k // 50, " ".join(base[:60] + ["x"] * (k // 50))) for k in range(100)]
    sets, groups = plain_components(rows, 4)
    want = [(rows[i][0], len(sets[i]), min(rows[j][0] for j in members)) for members in groups.values() for i in members]
    assert 10 < len(groups) < 150
    got = [tuple(r)[:3] for r in near_dup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4).collect()]
    assert sorted(got) == sorted(want)


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.8, 0.9):
        found = []
        for _ in range(40):
            n = 900
            common = int(n * share)
            u = rng.integers(0, 2**64, n, np.uint64)
            a, b = u[: common + (n - common) // 2], np.concatenate([u[:common], u[common + (n - common) // 2 :]])
            x, y = (near_dup.odd_sketch(near_dup.samples(s)).view(np.uint64) for s in (a, b))
            found.append(near_dup.estimate(sum(int(v).bit_count() for v in (x ^ y).tolist())))
        assert abs(np.mean(found) - share) < 0.02


PII_TEXTS = [
    None, "", "mail a.b+c@d-e.co.uk, x@y, @z.com é😀 q@w.er.", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0255.1.1.01", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111111111111",
    "call +49 (30) 1234-5678 or +1 2 or +123456789012345678", "9" * 5000 + " " + "a" * 5000 + "@" + " 1" * 3000, "a@b.c_d@e.f", "IBAN DE89 3704 0044 0532 0130 00 ok; bank GB82WEST12345698765432", "+" * 50 + "1 (((" + "2" * 9,
]
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
]


def digits(m):
    return re.sub("[^0-9]", "", m)


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_personal_data_equals_plain_rules(spark):
    rng = random.Random(9)
    pieces = ["1.2.3.4", "a@b.co", "+1 23", "4111 1111 1111 1111", "-", " ", ".", "@", "77", "é", "(", "+", "x_y"]
    rows = [(i, t) for i, t in enumerate(PII_TEXTS + ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(300)])]
    found = pii.find(spark.createDataFrame(rows, "doc_id int, text string")).select("doc_id", "text", pii.joined(pii.BASE).alias("spans"), "pii_iban").collect()
    for r in found:
        want = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in RULES for m in re.finditer(p, r.text or "") if ok(m.group())]
        assert r.spans == ",".join(want), r.text
    assert [len(r.pii_iban) for r in found if r.doc_id == 8] == [2]
    clean = {r.doc_id: r.text for r in pii.redact(pii.find(spark.createDataFrame(rows, "doc_id int, text string"))).collect()}
    assert clean[0] is None and clean[1] == "" and clean[7] == "<EMAIL><EMAIL>" and "a.b+c@" not in clean[2]
    spans = pii.find(spark.createDataFrame(rows, "doc_id int, text string")).select("doc_id", "text", pii.joined(tuple(k.name for k in pii.KINDS)).alias("spans")).collect()
    for r in spans:
        assert clean[r.doc_id] == plain_redaction(r.text, r.spans)


def plain_redaction(text, spans):
    at, out = 0, []
    for start, end, kind in sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x)):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, -end)
    return text if text is None else "".join(out) + text[at:]


def test_personal_data_of_a_text_with_very_many_spans(spark):
    n = 200_000
    text = "é".join(f"u{i}@x.org, 10.0.0.{i % 256} " for i in range(n // 2))
    docs = spark.createDataFrame([(1, text), (1, text[:300]), (1, text[:300])], "doc_id int, text string")
    begin = time.time()
    found = pii.find(docs)
    rows = found.select("text", pii.joined(pii.BASE).alias("spans"), F.size("pii_email").alias("n")).collect()
    clean = [r.text for r in pii.redact(found).collect()]
    assert time.time() - begin < 60
    assert sorted(r.n for r in rows)[-1] == n // 2
    for r, c in zip(rows, clean):
        assert r.spans == ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in RULES for m in re.finditer(p, r.text) if ok(m.group()))
        assert c == plain_redaction(r.text, r.spans)


def test_personal_data_refuses_clashing_columns_and_keeps_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, start int, `end` int, score double, kind string")
    assert pii.redact(pii.find(docs)).columns == docs.columns and pii.find(docs).count() == 0
    with pytest.raises(ValueError):
        pii.find(docs.withColumnRenamed("start", "pii_email"))


def test_fingerprints_of_neighbours(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(word(rng) for _ in range(rng.choice([0, 1, 3, 50, 400])))) for i in range(120)] + [(400, None), (401, "é😀" * 40), (402, "é😀" * 40)]
    for bucket_rows in (4000, 7):
        monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket_rows)
        got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
        assert len(got) == len(rows)
        for k, (i, text) in enumerate(rows):
            text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
            cut = len(text) // 4
            edited = text[: len(text) - cut] + following[:cut]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert r.fingerprint == fingerprints.to_text(fingerprints.sketch(text)) and r.edited_fingerprint == fingerprints.to_text(fingerprints.sketch(edited))
            assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(one).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints.fingerprint_edits(one.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a" * 40), (1, "a" * 40), (None, "b" * 20)], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(twice).count() == 3


def test_sketches_merge_and_estimate():
    rng = random.Random(4)
    a, b = (" ".join(word(rng) for _ in range(2000)) for _ in range(2))
    assert (fingerprints.merge(fingerprints.sketch(a), fingerprints.sketch(b)) == np.unique(np.concatenate([fingerprints.sketch(a, 10**9), fingerprints.sketch(b, 10**9)]))[: fingerprints.K]).all()
    true = len(fingerprints.sketch(a, 10**9))
    assert abs(fingerprints.distinct_shingles(fingerprints.sketch(a)) / true - 1) < 0.5
    assert fingerprints.containment(fingerprints.sketch(a[:6000]), fingerprints.sketch(a)) > 0.6
    assert (fingerprints.from_text(fingerprints.to_text(fingerprints.sketch(a))) == fingerprints.sketch(a)).all()


def test_search_reaches_recall_and_ranks_exactly(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(int(i), [float(v) for v in x[i]], 1.0) for i in range(600)] + [(40, [float(v) for v in x[40]], 1.0)]
    rows += [(601, None, 0.0), (602, [], 0.0), (603, [0.0] * 16, 0.0), (604, [float("nan")] * 16, 0.0), (605, [None] * 16, 0.0), (None, [1.0] * 16, 0.0), (620, [1.0] * 3, 0.0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = ann.search(frame, "vec_id % 20 = 0", 20).toPandas()
    use = np.array([i for i in range(600)] + [40])
    y, hits, total = x[use].astype(np.float64), 0, 0
    for q in range(0, 600, 20):
        for _, part in [(0, got[got.query_id == q])]:
            score = (y * x[q].astype(np.float64)).sum(1)
            own = int(np.flatnonzero(use == q)[0])
            order = [i for i in np.lexsort((use, -score)) if i != own][:20]
            part = part.sort_values("rank")
            hits += len(set(use[order]) & set(part.vec_id))
            total += 20
            assert set(part["rank"]) == set(range(1, 21))
    assert hits / total >= 0.9
    hot = got[got.query_id == 100].sort_values("rank")
    assert hot.vec_id.tolist() == list(range(101, 121))
    assert ann.search(frame.limit(0), "vec_id % 20 = 0", 20).count() == 0


def test_every_query_gets_its_full_number_of_rows(spark):
    for seed, n in ((0, 40), (1, 90), (2, 18)):
        rng = np.random.default_rng(seed)
        centres = rng.standard_normal((6, 8)) * 5
        x = centres[rng.integers(0, 6, n) * rng.integers(0, 2, n)] + rng.standard_normal((n, 8)) * 0.3
        frame = spark.createDataFrame([(i * 4, [float(v) for v in x[i]]) for i in range(n)], "vec_id long, embedding array<double>")
        got = ann.search(frame, "vec_id % 20 = 0", 20, recall=0.1).groupBy("query_id").count().collect()
        assert len(got) == -(-n // 5) and all(r["count"] == min(20, n - 1) for r in got)


def test_double_vectors_are_ranked_as_doubles(spark):
    rows = [(i, [1.0, 1.0 + i * 1e-10]) for i in range(5)] + [(9, [1e300, -1e300]), (20, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 20", 4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [4, 3, 2, 1] and got[0].score == 2 + 4e-10 and len({r.score for r in got}) == 4


def test_quality_votes():
    good, bad = ["the cat sat on the mat and looked %d" % i for i in range(40)], ["$$$ ### %%%% !!! | | | %d" % i for i in range(40)]
    space = quality.fit(quality.counts(good + bad), np.array([1] * 40 + [0] * 40), {0: 1.0, 1: 1.0})
    score = space.score(quality.counts(["the dog sat on the mat", "### $$$ | | !!!", "", None, "x"]))
    assert score[0] > 0.8 and score[1] < 0.2 and ((score >= 0) & (score <= 1)).all()
    empty = quality.fit(quality.counts([]), np.zeros(0, np.int64), {})
    assert empty.score(quality.counts(["a"])).tolist() == [0.5]
    single = quality.fit(quality.counts(good), np.ones(40, np.int64), {1: 1.0})
    assert single.score(quality.counts(["a"])).tolist() == [1.0]


def test_toxicity_gradient_and_windows():
    words, index, owner = toxicity.windows(pa.array(["a b idiot c d ê", None, "", "x y " * 40]))
    assert owner.tolist() == [0, 3, 3, 3] and (index >= 0).sum(1).tolist() == [6, 32, 32, 32]
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh().items()}
    w, y = toxicity.Words(words), np.array([1.0, 0, 0, 1])

    def loss(p):
        logit = toxicity.forward(p, w.inputs(p), index).astype(np.float64)
        return np.mean(np.log1p(np.exp(logit)) - y * logit)

    g = toxicity.gradient(p, w, w.inputs(p), index, y)
    for k in p:
        i = tuple(np.argwhere(np.abs(g[k]) == np.abs(g[k]).max())[0])
        old, e = p[k][i], 1e-3
        p[k][i] = old + e
        up = loss(p)
        p[k][i] = old - e
        down = loss(p)
        p[k][i] = old
        assert abs((up - down) / 2 / e - g[k][i]) < 1e-4 + 0.02 * abs(g[k][i]), k


def test_toxicity_learns_and_defines_edges():
    rng = random.Random(8)
    bad = ["moron", "moron,", "idiot", "Idiot!"]
    texts = [" ".join([word(rng) for _ in range(20)] + (rng.choices(bad, k=3) if i % 2 else []) + [word(rng) for _ in range(20)]) for i in range(800)]
    words, index, owner = toxicity.windows(pa.array(texts))
    model = toxicity.fit(words, index, owner, np.array([i % 2 for i in range(800)]))
    other = [" ".join([word(rng) for _ in range(60)] + (rng.choices(bad, k=2) if i % 2 else [])) for i in range(40)]
    w, ix, ow = toxicity.windows(pa.array(other))
    worst = np.maximum.reduceat(toxicity.score_windows(model, w, ix), np.flatnonzero(np.diff(ow, prepend=-1)))
    assert ((worst > 0) == (np.arange(40) % 2 == 1)).mean() > 0.9
    assert toxicity.fit(words, index, owner, np.zeros(800, int)) is None


def test_toxicity_trains_on_every_window(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(["start"] + [word(rng) for _ in range(n)] + [f"end{i}"]) for i, n in enumerate([3, 700, 5000, 40] * 30)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(len(texts))], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda *a: seen.update(zip(("words", "index", "owner", "label"), a)))
    toxicity.train(docs, labels, fold=(5, 0))
    used = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 0]
    words, index, owner = toxicity.windows(pa.array([texts[i] for i in used], pa.string()))
    got = [[seen["words"][w] for w in row if w >= 0] for row in seen["index"]]
    assert got == [[words[w] for w in row if w >= 0] for row in index] and seen["owner"].tolist() == owner.tolist()
    assert seen["label"].tolist() == [i // 2 % 2 for i in used]


def test_pipeline_keeps_columns_and_survives_odd_tables(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(word(rng) for _ in range(40)), "en", "s", 7, 1.0) for i in range(60)] + [(60, None, None, None, None, None), (61, "", "en", "s", 0, 1.0), (None, "mail me at a@b.co now please", "en", "s", 1, 1.0), (5, rows_five(rng), "en", "s", 1, 1.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    for name, part in (("full", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(i, 1, i % 2) for i in range(0, 40)] if part else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage, fn in corpus_pipeline.STAGES:
            out = fn(spark, docs, str(tmp_path / name))
            assert stage == "packing" or out.columns == docs.columns
            assert out.count() >= 0
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() >= 0
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    assert corpus_pipeline.without_personal_data(spark, docs, "").filter("text like '%<EMAIL>%' and n_chars = length(text)").count() == 1


def rows_five(rng):
    return " ".join(word(rng) for _ in range(40))
