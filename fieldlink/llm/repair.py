"""Repair of conversation structure: iterative-deepening A* over blocks of turns.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``.
Edits in the order of their letters: Delete a row (3), Insert an empty turn of the
role that may come next (2), Keep a row (0), Rerole a row to that role (2); a row
whose text is cut off adds 1 unless it is deleted, and blank and repeated rows must
be deleted.  Wanted is the cheapest list of edits, and of these the one whose
letters come first.

``search`` runs depth-first in letter order under a cost bound that starts at a
lower bound of the cost and rises to the least cost that went beyond it, so the
first path that ends well is the answer.  States that failed with some cost left
are kept in a table and are not entered again with as much or less.

A conversation may be long, so it is cut into blocks of neighbouring turns.  Each
block is searched from every role that may precede it to every role it may end on;
among these results the cheapest chain is chosen, first letters first.  This gives
the same answer as one search: edit lists of a block consume the same rows, and an
insertion belongs to the row after it, so none is the beginning of another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fieldlink.lineage import cut
from fieldlink.llm.common import slices

#: Turn numbers and rows that make a block.
TURN_BITS = 6
BLOCK_ROWS = 96
#: Role states: nothing yet, after system, after user, after assistant; what may follow, and what an added role leads to.
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ADDED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
ENDS = (0, 3)
FAULTS = ("", "blank", "duplicate", "truncated")


def search(rows: list[tuple[str, int]], entry: int, goals: tuple[int, ...], last: bool, failed: dict | None = None) -> tuple[int, str] | None:
    """(cost, letters) of the best edits of ``rows`` from role state ``entry`` to one of ``goals``.

    A row is (initial of its role, fault as a place in FAULTS).  ``last`` allows
    insertions after the last row.  ``failed`` may be shared by searches with the
    same rows, goals and ``last``.
    """
    n = len(rows)
    failed = {} if failed is None else failed
    # What is left costs at least 3 for each row that must go and 1 for each that is cut off.
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (0, 3, 3, 1)[rows[i][1]]
    if not last:
        # A state before user is only left by keeping a system row, or not at all.
        fit = [g for g in goals if g >= 2 or g == entry or (g == 1 and entry == 0 and any(r == "s" and f in (0, 3) for r, f in rows))]
        if not fit:
            return None

    def moves(i: int, state: int, may_add: bool) -> list[tuple[str, int, int, bool, int]]:
        """(letter, next row, next state, may add there, cost) in letter order."""
        out = []
        if i < n:
            out.append(("D", i + 1, state, True, 3))
        if may_add and (i < n or last):
            # A third insertion, or a second one after user or assistant, only returns to a state already seen.
            out.append(("I", i, ADDED[state], state < 2, 2))
        if i < n and rows[i][1] in (0, 3):
            extra = int(rows[i][1] == 3)
            kept = FOLLOW[state].get(rows[i][0])
            if kept is not None:
                out.append(("K", i + 1, kept, True, extra))
            if kept != ADDED[state]:
                out.append(("R", i + 1, ADDED[state], True, 2 + extra))
        return out

    bound = least[0]
    while True:
        beyond = None
        letters: list[str] = []
        path = [((0, entry, True), bound, iter(moves(0, entry, True)))]
        if n == 0 and entry in goals:
            return 0, ""
        while path:
            here, left, todo = path[-1]
            for letter, i, state, may_add, cost in todo:
                rest = left - cost
                if rest >= 0 and i == n and state in goals:
                    return bound - rest, "".join(letters) + letter
                key = (i, state, may_add)
                need = max(least[i], failed.get(key, -1) + 1)
                if need > rest:
                    beyond = bound - rest + need if beyond is None else min(beyond, bound - rest + need)
                    continue
                letters.append(letter)
                path.append((key, rest, iter(moves(i, state, may_add))))
                break
            else:
                path.pop()
                failed[here] = max(failed.get(here, -1), left)
                if letters:
                    letters.pop()
        if beyond is None:
            return None
        bound = beyond


def options(rows: list[tuple[str, int]], first: bool, last: bool) -> list[tuple[int, int, int, int, str]]:
    """(entry, exit, cost, rank of the letters within the entry, letters) of a block."""
    out = []
    for goals in [ENDS] if last else [(g,) for g in range(4)]:
        failed: dict = {}
        for entry in (0,) if first else range(4):
            found = search(rows, entry, goals, last, failed)
            if found is not None:
                out.append((entry, -1 if last else goals[0], *found))
    ranked = []
    for entry in range(4):
        mine = sorted((x for x in out if x[0] == entry), key=lambda x: x[3])
        ranked += [(e, x, cost, rank, letters) for rank, (e, x, cost, letters) in enumerate(mine)]
    return ranked


def chain(blocks: list[list[dict]]) -> list[tuple[int, int]]:
    """(entry, exit) of every block on the cheapest chain, first letters first."""
    ahead: list[dict[int, int]] = [{-1: 0}]
    for block in reversed(blocks):
        cost: dict[int, int] = {}
        for o in block:
            if o["exit"] in ahead[-1]:
                total = o["cost"] + ahead[-1][o["exit"]]
                cost[o["entry"]] = min(total, cost.get(o["entry"], total))
        ahead.append(cost)
    ahead.reverse()
    state, out = 0, []
    for block, here, after in zip(blocks, ahead, ahead[1:]):
        best = min((o["rank"], o["exit"]) for o in block if o["entry"] == state and o["exit"] in after and o["cost"] + after[o["exit"]] == here[state])
        out.append((state, best[1]))
        state = best[1]
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with every row treated by its CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops it, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out, 3 repeats it,
    4 makes its role user.  Nulls count as one space, in role, text and key.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1)))
    return rows.filter("_k != 0").select(
        "conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")
    ).drop("_copy")


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which the first may be null; columns of ``a``, then the others of ``b``."""
    names = {k: f"_right_{k}" for k in keys}
    right = b.select(*(F.col(k).alias(names[k]) for k in keys), *(c for c in b.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    return a.join(right, on, how).drop(*names.values())


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, row, hash, initial, fault) of rows with a unique number ``row``."""
    seen = rows.withColumn("_blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("_whole", F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))
    light = seen.select("conv_id", "turn", "role", "row", F.md5(F.col("text").cast("binary")).alias("hash"), "_blank", "_whole")
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0).cast("long")), "row")
    firsts = light.groupBy("conv_id", "role", "hash").agg(F.min(place)["row"].alias("_first"))
    marked = _null_safe(light, firsts, ["conv_id", "role", "hash"])
    fault = F.when(F.col("_blank"), 1).when(F.col("row") != F.col("_first"), 2).when(~F.col("_whole"), 3).otherwise(0)
    return marked.select("conv_id", "turn", "role", "row", "hash", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("letters", pa.string())]))
    known: dict = {}
    for batch in batches:
        found = []
        for rows, first, last in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
            key = tuple((x["initial"], x["fault"]) for x in rows), first, last
            if key not in known:
                if len(known) > 50_000:
                    known.clear()
                names = ("entry", "exit", "cost", "rank", "letters")
                known[key] = [dict(zip(names, o)) for o in options(list(key[0]), first, last)]
            found.append(known[key])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, kind)], ["conv_id", "block", "part", "options"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by conversation to the chosen way through each of them; of a conversation only costs are held."""
    held: list[tuple] = []
    names = ["conv_id", "block", "part", "entry", "exit"]

    def flush(schema: pa.Schema) -> pa.RecordBatch:
        chosen = chain([x[3] for x in held])
        columns = [pa.array([x[i] for x in held], schema.field(i).type) for i in range(3)]
        columns += [pa.array([c[i] for c in chosen], pa.int32()) for i in range(2)]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    schema = None
    for batch in batches:
        schema = batch.schema
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                out.append(flush(schema))
            held.append(row)
        yield from out
    if held:
        yield flush(schema)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their letters to one line per conversation; only the running state is held."""

    class Line:
        def __init__(self, conv):
            self.conv, self.state, self.before, self.turns, self.low, self.high = conv, 0, None, 0, None, None
            self.faults, self.illegal, self.cost, self.audit = [0, 0, 0, 0], 0, 0, []
            self.sha, self.empty, self.last_turn = hashlib.sha256(), True, None

        def add(self, turn, role, text, fault, letters):
            initial = role[:1]
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
            self.faults[fault] += 1
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.high, self.turns, self.last_turn = turn, self.turns + (turn != self.last_turn), turn
            self.audit.append(letters)
            for letter in letters:
                if letter == "D":
                    self.cost += 3
                    continue
                extra = int(fault == 3 and letter != "I")
                if letter == "K":
                    self.state, self.cost = FOLLOW[self.state][initial], self.cost + extra
                    line = f"{role}:{text}"
                else:
                    self.state, self.cost = ADDED[self.state], self.cost + 2 + extra
                    line = f"{ROLE[self.state]}:{text if letter == 'R' else ''}"
                self.sha.update(line.encode() if self.empty else b"\n" + line.encode())
                self.empty = False

        def row(self):
            gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
            return self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()

    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def table(lines: list[Line], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*(x.row() for x in lines)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds])], names)

    now, kind = None, None
    for whole in batches:
        for batch in slices(iter([whole]), 3):
            kind, done = batch.schema.field(0).type, []
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    done += [now] if now else []
                    now = Line(conv)
                now.add(*rest)
            if done:
                yield table(done, kind)
    if now is not None:
        yield table([now], kind)


def repaired(rows: DataFrame) -> DataFrame:
    """One line per conversation of ``rows`` (conv_id, turn long, role, text; only the first two may be null).

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    whole = cut(rows.select("conv_id", F.col("turn").cast("long"), "role", "text").withColumn("row", F.monotonically_increasing_id()))
    faults = _faults(whole)
    block = F.coalesce(F.shiftright("turn", TURN_BITS), F.lit(-(2**62)))
    order = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "hash", "row")
    placed = faults.withColumn("block", block).withColumn("pos", F.row_number().over(order)).withColumn("part", F.expr(f"(pos - 1) div {BLOCK_ROWS}"))
    blocks = placed.groupBy("conv_id", "block", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "row", "initial", "fault"))).alias("rows"))
    blocks = cut(blocks)
    bounds = blocks.groupBy("conv_id").agg(F.min(F.struct("block", "part")).alias("_first"), F.max(F.struct("block", "part")).alias("_last"))
    here = F.struct("block", "part")
    flagged = _null_safe(blocks, bounds, ["conv_id"]).select("conv_id", "block", "part", "rows", (here == F.col("_first")).alias("first"), (here == F.col("_last")).alias("last"))
    found = cut(flagged.mapInArrow(_search_blocks, f"conv_id {kind}, block long, part long, options array<struct<entry:int,exit:int,cost:bigint,rank:int,letters:string>>"))
    costs = found.select("conv_id", "block", "part", F.transform("options", lambda o: F.struct(o.entry.alias("entry"), o.exit.alias("exit"), o.cost.alias("cost"), o.rank.alias("rank"))).alias("options"))
    ways = costs.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").mapInArrow(_chains, f"conv_id {kind}, block long, part long, entry int, exit int")
    keys = ["conv_id", "block", "part"]
    chosen = _null_safe(found, ways, keys).withColumn("letters", F.filter("options", lambda o: (o.entry == F.col("entry")) & (o.exit == F.col("exit")))[0]["letters"])
    edits = _null_safe(chosen.select(*keys, "letters"), blocks, keys).select(
        "block", F.explode(F.arrays_zip("rows", F.regexp_extract_all("letters", F.lit("(I*[DKR](?:I+$)?)"), 1).alias("letters"))).alias("e")
    )
    edits = edits.select("block", F.col("e.rows.row").alias("row"), F.col("e.rows.pos").alias("pos"), F.col("e.rows.fault").alias("fault"), F.col("e.letters").alias("letters"))
    full = whole.join(edits, "row").repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")
    lines = full.select("conv_id", "turn", "role", "text", "fault", "letters").mapInArrow(
        _replay, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )
    return lines


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """:func:`repaired` of :func:`damage`, with a line for every conv_id of the table.

    Conversations without a row after damage have zeros, no letters and the hash of
    the empty text.  A null conv_id is a conversation of its own; null turns come
    first; rows of one turn are ordered by role and a hash of their text; a role
    without letters fits nowhere; repeated rows are rows; an empty table gives no
    lines; other columns are not read.
    """
    ids = conversations.select("conv_id").distinct()
    lines = _null_safe(ids, repaired(damage(conversations)), ["conv_id"], "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return lines.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
