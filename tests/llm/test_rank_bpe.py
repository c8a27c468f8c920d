"""Encoding by ranks against the tiktoken library."""

import base64
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from fieldlink.llm import bpe, rank_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "é", "ß", "!", "123", " ", "　", "<|endoftext|>", "Ünder", "日本", "😀", "\x1c", "́", "The", "\r\n", "Σ", " x", "abcdefghijk" * 5, "qzx" * 120]
ROWS = [(1, None, "x"), (2, "", "x"), (3, "Hello  world <|endoftext|> it's", "x"), (3, "Hello  world <|endoftext|> it's", "x"), (None, "null id\n", "x"), (5, "word " * 5000, "x"), (6, "!" * 3000 + "x" * 3000, "x")]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_library(library):
    rng = random.Random(1)
    ours, some = rank_bpe.load(PATH), ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(4000)]
    found = ours.encode_batch(pa.array(some))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode_ordinary(x) for x in some]
    assert ours.decode_batch(found) == [x.encode() for x in some]
    assert ours.encode_batch(pa.array([], pa.string())) == []


def test_one_long_word_merges_like_the_matrices():
    ours, rng = rank_bpe.load(PATH), random.Random(2)
    words = ["".join(rng.choices("abeinorst", k=n)).encode() for n in (2, 5, 17, 64, 255, 256) for _ in range(20)]
    flat, counts = ours.encode_words(words)
    assert flat.tolist() == [i for w in words for i in ([ours.ids[w]] if w in ours.ids else ours.merge_long(w).tolist())] and counts.sum() == len(flat)


def test_every_pair_is_found_in_the_table():
    ours = rank_bpe.load(PATH)
    pairs = np.array(list(ours.merges), np.int64)
    assert ours.pairs.find(pairs[:, 0], pairs[:, 1]).tolist() == list(ours.merges.values())
    absent = np.array([(a, b) for a in range(300) for b in range(300) if (a, b) not in ours.merges], np.int64)
    assert (ours.pairs.find(absent[:, 0], absent[:, 1]) == rank_bpe.NEVER).all()


def test_round_trip_of_odd_rows(spark, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    encoded = rank_bpe.encode_ranked(docs, PATH)
    want = [library.encode_ordinary(t or "") for _, t, _ in ROWS]
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in encoded.collect()) == Counter((i, len(w), np.array(w, "<u4").tobytes()) for (i, _, _), w in zip(ROWS, want))
    assert Counter((r.doc_id, bytes(r.decoded)) for r in rank_bpe.decode_ranked(encoded, PATH).collect()) == Counter((i, (t or "").encode()) for i, t, _ in ROWS)
    assert rank_bpe.encode_ranked(docs.limit(0), PATH).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert bytes(rank_bpe.decode_ranked(rank_bpe.encode_ranked(broken, PATH), PATH).first().decoded) == "a�b".encode()
    with pytest.raises(ValueError):
        rank_bpe.decode_ranked(encoded.withColumnRenamed("n_tokens", "decoded"), PATH)


def peak(fn, *args):
    """What a call gives, and the bytes it held at most."""
    tracemalloc.start()
    try:
        return fn(*args), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_round_trip_in_one_pass(spark, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    turned = rank_bpe.round_trip_ranked(docs, PATH)
    two = rank_bpe.decode_ranked(rank_bpe.encode_ranked(docs, PATH), PATH)
    want = Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in ROWS)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in turned.collect()) == want
    assert Counter(map(tuple, turned.select("doc_id", "n_tokens", "decoded").collect())) == Counter(map(tuple, two.collect()))


def test_query_keeps_one_worker_beside_a_task(spark, tmp_path):
    """Memory of op13: every Python step of the plan is a worker of its own in every task."""
    from fieldlink.llm.queries import LLM_QUERIES

    spark.createDataFrame(ROWS[:3], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    found = LLM_QUERIES["op13_rank_bpe_round_trip"](spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() == 3


def test_gathering_needs_little_beside_its_result():
    rng = np.random.default_rng(3)
    flat, lens = rng.integers(0, 255, 5000).astype(np.uint8), np.r_[np.zeros(3, np.int64), np.full(996, 4), 1016]
    code = np.r_[0, rng.integers(0, 999, 1 << 20), 0, 1, np.full(400, 999), 2]
    (found, ends), most = peak(bpe.gather, flat, lens, code)
    starts = np.cumsum(lens) - lens
    assert found.tobytes() == b"".join(flat[starts[c] : starts[c] + lens[c]].tobytes() for c in code.tolist()) and ends[-1] == len(found)
    held = len(found) + 3 * code.nbytes
    assert most < held + 6_300_000
    one, none = bpe.gather(flat, np.array([5000]), np.array([0, 0]))[0], bpe.gather(flat, lens, np.zeros(0, np.int64))
    assert one.tobytes() == flat.tobytes() * 2 and len(none[0]) == len(none[1]) == 0


def test_decoding_and_long_words_are_bounded():
    ours = rank_bpe.load(PATH)
    ids = [np.resize(np.arange(1000, 9000), 1 << 20).astype("<u4").tobytes()]
    found, most = peak(ours.decode_batch, ids)
    assert most < 4 * len(found[0]) + 24 * (1 << 20)
    word = bytes(random.Random(4).choices(b"abeinorst", k=200_000))
    merged, most = peak(ours.merge_long, word)
    assert b"".join(ours.decode_batch([merged.astype("<u4").tobytes()])) == word
    assert most < 100 * len(word)
