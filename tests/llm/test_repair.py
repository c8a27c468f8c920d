"""Conversation repair against a plain dynamic programme over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fieldlink.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
WHITE = " \t\n\x0b\x0c\r"
FOLLOW = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ADDED = [2, 2, 3, 2]


def best(rows):
    """(cost, letters) by a Bellman pass over (row, state); ties to the first letters."""
    least = {(len(rows), q): (0, "") for q in (0, 3)}
    for i in range(len(rows), -1, -1):
        step = {}
        if i < len(rows):
            initial, fault = rows[i]
            for q in range(4):
                ways = [(i + 1, q, 3, "D")]
                if fault not in (1, 2):
                    extra = int(fault == 3)
                    ways += [(i + 1, FOLLOW[q][initial], extra, "K")] if initial in FOLLOW[q] else []
                    ways.append((i + 1, ADDED[q], 2 + extra, "R"))
                step[q] = min(((least[j, r][0] + c, x + least[j, r][1]) for j, r, c, x in ways if (j, r) in least), default=None)
        else:
            step = {q: least.get((i, q)) for q in range(4)}
        for _ in range(4):  # insertions before row i, until nothing gets better
            for q in range(4):
                if step.get(ADDED[q]) is not None:
                    way = (step[ADDED[q]][0] + 2, "I" + step[ADDED[q]][1])
                    step[q] = way if step[q] is None else min(step[q], way)
        least |= {(i, q): x for q, x in step.items() if x is not None}
    return least[0, 0]


def plain(rows):
    original = dict.fromkeys(r[0] for r in rows)
    damaged = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        damaged[conv] += [(turn is not None, turn or 0, "user" if k == 4 else role, text)] * (1 + (k == 3))
    out = []
    for conv in original:
        seq = sorted(damaged[conv], key=lambda r: (r[0], r[1], r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, coded = set(), []
        for _, _, role, text in seq:
            bare = text.rstrip(WHITE)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            coded.append((role[:1], fault))
        cost, letters = best(coded)
        state, todo, lines = 0, iter(zip(seq, coded)), []
        for x in letters:
            if x == "I":
                state = ADDED[state]
                lines.append({2: "user", 3: "assistant"}[state] + ":")
                continue
            (_, _, role, text), (initial, _) = next(todo)
            if x == "K":
                state = FOLLOW[state][initial]
                lines.append(f"{role}:{text}")
            elif x == "R":
                state = ADDED[state]
                lines.append({2: "user", 3: "assistant"}[state] + ":" + text)
        assert state in (0, 3)
        turns = [t for some, t, *_ in seq if some]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = Counter(f for _, f in coded)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(coded))
        out.append((conv, gaps, counts[1], counts[2], counts[3], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in frame.select(names).collect()), key=repr)


def conversations(seed, n, turns):
    rng = random.Random(seed)
    texts = ["a.", "b?", "c", "", " \t", "long. text", "d!\n", "ß."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts), "x") for c in range(n) for t in range(rng.randint(1, turns)) if rng.random() < 0.9]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_dynamic_programme(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        rows = [(rng.choice("suauau-"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(0, 14))]
        assert repair.search(rows, 0, repair.ENDS, True) == best(rows)


def test_blocks_give_the_same_as_one_search():
    rng = random.Random(9)
    for _ in range(400):
        rows = [(rng.choice("suauau-"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(1, 30))]
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randint(0, 5)))) if len(rows) > 1 else []
        pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        blocks = [repair.options(p, i == 0, i == len(pieces) - 1) for i, p in enumerate(pieces)]
        named = [[dict(zip(("entry", "exit", "cost", "rank", "letters"), o)) for o in b] for b in blocks]
        ways = repair.chain(named)
        picked = [next(o for o in b if (o["entry"], o["exit"]) == w) for b, w in zip(named, ways)]
        assert (sum(o["cost"] for o in picked), "".join(o["letters"] for o in picked)) == best(rows)


ODD = [
    (None, 0, "user", "nobody.", "x"), (None, None, None, None, "x"), (1, None, "user", None, "x"), (1, 0, None, "a.", "x"), (1, 0, "user", "a.", "x"), (1, 0, "user", "a.", "x"),
    (2, 4, "", "b", "x"), (3, -5, "System", "x.", "x"), (3, 7, "user", "y." * 50000, "x"),
]


@pytest.mark.parametrize("rows", [ODD, conversations(4, 80, 9), [(7, t, *r, "x") for t, (_, _, *r, _) in enumerate(conversations(5, 60, 9))]])
def test_lines_equal_plain_pass(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(repair.repair_damaged(frame)) == plain(rows)


def test_conversation_without_rows_and_empty_table(spark):
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = found(repair.repair_damaged(spark.createDataFrame([(gone, 0, "user", "a.", "x")], SCHEMA)))
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
