"""Encoding, prefix counts and packing against the tokenizers library and plain Python."""

import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldlink.llm import bpe, packing, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "é", "ß", "!", "123", " ", "　", "<|endoftext|>", "<|", "Ünder", "日本", "😀", "\x1c", "́", "The", "\r\n", "Σ", "İ", " x"]
ROWS = [(1, None, "x"), (2, "", "x"), (3, "Hello  world <|endoftext|> it's", "x"), (3, "Hello  world <|endoftext|> it's", "x"), (None, "null id\n", "x"), (5, "word " * 5000, "x"), (6, "!" * 3000 + "x" * 3000, "x")]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, ids string")


def test_encoder_equals_library():
    library, ours, some = Tokenizer.from_file(BYTE), bpe.load(BYTE), texts(4000, 1)
    found = ours.encode_batch(pa.array(some))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert ours.decode_batch(found) == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in found]
    assert ours.encode_batch(pa.array([], pa.string())) == []


def test_round_trip_of_odd_rows(docs):
    got = bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((i, t or "") for i, t, _ in ROWS)


def test_round_trip_in_one_pass(docs, spark, tmp_path):
    """Memory of op2: every Python step of the plan is a worker of its own in every task."""
    from fieldlink.llm.queries import LLM_QUERIES

    library = Tokenizer.from_file(BYTE)
    turned = bpe.round_trip_documents(docs, BYTE)
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in ROWS]
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in turned.collect()) == Counter(
        (i, len(w), np.array(w, "<u4").tobytes(), library.decode(w, skip_special_tokens=False)) for (i, _, _), w in zip(ROWS, want)
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = LLM_QUERIES["op2_bpe_round_trip"](spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and found.count() == len(ROWS)


def test_long_part_merges_like_the_library_in_bounded_memory():
    import tracemalloc

    ours, library, rng = bpe.load(BYTE), Tokenizer.from_file(BYTE), random.Random(4)
    for n in (41, 60, 500, 3000):
        word = "".join(rng.choices("abeinorst", k=n))
        assert ours.merge_long(word.encode()).tolist() == library.encode(word, add_special_tokens=False).ids
    word = bytes(rng.choices(b"abeinorst", k=200_000))
    tracemalloc.start()
    try:
        ours.merge_long(word)
        assert tracemalloc.get_traced_memory()[1] < 100 * len(word)
    finally:
        tracemalloc.stop()


def test_prefix_counts_equal_library():
    library, ours = Tokenizer.from_file(WORD), token_counts.load(WORD)
    some = texts(3000, 2)
    counts, _ = ours.count_batch(pa.array(some), None)
    assert counts.tolist() == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    norm = lambda s: "".join(map(str.lower, unicodedata.normalize("NFC", s)))
    for s in [s for s in some if "<" not in s][:300]:
        x, p = norm(s), ours.prefixes(s).tolist()
        assert len(p) == len(x)
        assert all(p[i - 1] == len(library.encode(x[:i], add_special_tokens=False).ids) for i in range(1, len(x) + 1) if norm(x[:i]) == x[:i])
        fit = ours.count_batch(pa.array([s]), 5)[1][0]
        assert fit == (None if counts[some.index(s)] <= 5 else max((i for i in range(1, len(x) + 1) if p[i - 1] <= 5), default=0))


def test_counts_of_odd_rows(docs, spark):
    got = token_counts.count_tokens(docs, WORD, 2048).collect()
    library = Tokenizer.from_file(WORD)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS)
    assert token_counts.count_tokens(docs.limit(0), WORD).count() == 0
    assert [len(r.counts) for r in token_counts.prefix_counts(docs.filter("doc_id = 2"), WORD).collect()] == [0]


def plain_best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(size - n)
    return Counter(size - r for r in room)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(400):
        size = rng.choice([1, 5, 16, 100])
        lengths = [rng.randint(1, size) if rng.random() < 0.7 else rng.randint(1, max(1, size // 6)) for _ in range(rng.randint(0, 100))]
        used, count = Counter(), Counter()
        for n, _, pieces, each, first, _ in packing.best_fit(Counter(lengths), size):
            count[n] += pieces
            for j in range(pieces):
                used[first + j // each] += n
        assert count == Counter(lengths) and Counter(used.values()) == plain_best_fit(lengths, size)


def test_packed_documents(docs, spark):
    encoded = bpe.encode_documents(docs, BYTE)
    whole = [np.frombuffer(bytes(r.ids), "<u4").tolist() + [0] for r in encoded.collect()]
    got = packing.pack_documents(encoded, 64, 0).collect()
    assert sum(r.length for r in got) == sum(map(len, whole))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert Counter(sum(n for _, n in b) for b in bins.values()) == plain_best_fit([r.length for r in got], 64)
    ids = next(w for w, (i, _, _) in zip(whole, ROWS) if i == 5)
    for r in got:
        if r.doc_id == 5:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            assert r.piece == 0 or r.length == 64
    assert packing.pack_documents(encoded.limit(0), 64, 0).count() == 0
    odd = spark.createDataFrame([(0, None), (1, 0), (2, 65), (3, 64), (3, 64)], "offset_in int, length long")
    assert sorted((r.offset_in, r.sequence_id is not None) for r in packing.pack(odd, 64).collect()) == [(0, False), (1, False), (2, False), (3, True), (3, True)]
