"""The conversation trie against a plain pass over all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from fieldlink.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rebuilt(rows, group=20, most=4):
    own = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(r)] for c, r in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - c % group, [])[:h] + own[c][h:]
    return out


def plain(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = []
    for node, found in members.items():
        leaves = saved = 0
        todo = [node]
        while todo:
            at = todo.pop()
            leaves += not kids[at]
            saved += (len(members[at]) - 1) * len(WORD.findall(at[-1][1])) if at else 0
            todo += kids[at]
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(kids[node]), leaves, saved, digest))
    return sorted(out, key=repr)


def found(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in frame.select(names).collect()), key=repr)


def conversations(seed, n, turns, texts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 4 * n), n):
        for t in range(rng.randint(1, turns)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(rng.choices(texts, k=rng.randint(0, 2))), "x"))
    rng.shuffle(rows)
    return rows


ODD = [
    (None, 0, "user", "nobody", "x"), (0, None, None, None, "x"), (0, 0, "user", "a b\tc", "x"), (0, 0, "user", "a b\tc", "x"), (0, 5, "", "", "x"),
    (1, 0, "user", "a", "x"), (2, 0, "user", "a", "x"), (3, 0, "us", "er:a", "x"), (4, None, "user", "late", "x"), (25, 0, "user", "no base", "x"), (-3, 1, "user", "below", "x"),
]


def test_trie_finds_exit_nodes_of_every_string():
    rng = random.Random(3)
    strings = ["".join(rng.choices("ab", k=rng.randint(0, 40))) for _ in range(400)] + ["a" * 64, "a" * 33]
    trie = prefix_trie.ZFastTrie()
    for i, s in enumerate(strings):
        trie.insert(0, [s[:d] for d in range(len(s) + 1)], i)
    for f, name in trie.handles:
        assert len(name) == f
    for s in strings:
        node, depth = trie.locate(0, [s[:d] for d in range(len(s) + 1)])
        assert depth == len(s) == trie.extent[node]
    got = {trie.strings[t][1][d]: (m, low) for a, e, t, m, low in trie.edges() for d in (range(a + 1, e + 1) if e > a else [e])}
    prefixes = {s[:d] for s in strings for d in range(len(s) + 1)}
    assert got == {p: (sum(s.startswith(p) for s in strings), next(i for i, s in enumerate(strings) if s.startswith(p))) for p in prefixes}


@pytest.mark.parametrize("rows", [ODD, conversations(1, 60, 7, ["a", "b"]) + ODD[1:5], conversations(2, 40, 3, ["x"])])
def test_nodes_equal_plain_pass(spark, rows):
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rebuilt(rows))


def test_nested_long_conversations_in_segments_and_batches(spark, monkeypatch):
    # Each conversation opens the next one, so the tree of edges is a chain; segments of the longest ones start in others.
    chain = [(20 * c, t, "user", f"w{t} and", "x") for c in range(6) for t in range(6000 + 700 * c)]
    rows = chain + [(400, t, "user", f"w{t} and" if t < 5000 else "other", "x") for t in range(5003)]
    got = found(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    sequences = rebuilt(rows)
    assert len(got) == 6000 + 700 * 5 + 1 + 3
    by_depth = {(c, d): r for c, d, *r in got}
    assert by_depth[0, 0][:5] == [None, 7, 1, 2, sum(2 * (sum(len(s) > d and s[d][1] == f"w{d} and" for s in sequences.values()) - 1) for d in range(9500)) + 0]
    assert by_depth[0, 5000][1:4] == [7, 2, 2] and by_depth[400, 5003][1:5] == [1, 0, 1, 0] and by_depth[100, 9500][1:4] == [1, 0, 1]
    assert by_depth[0, 6000][-1] == hashlib.sha256(b"0").hexdigest()


def test_common_end_is_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, 0, "user", "same", "x") for c in range(0, 2000, 20)]
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rebuilt(rows))


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
