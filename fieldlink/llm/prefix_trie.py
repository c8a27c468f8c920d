"""Prefix trie of conversations: z-fast tries per batch, merged by depth and prefix fingerprint.

A prefix of a conversation is named by its depth and two 64-bit sums of hashes of
(place, role, text), so prefixes of one conversation are running sums: long
conversations are cut into segments of ``SEGMENT`` turns whose sums start where
the segment before ended, and equal prefixes have equal names wherever they are
computed.  Two different prefixes share a name with probability 2**-128.

Inside a task, segments are inserted in batches into a z-fast trie: compacted nodes
are hashed by the prefix at their two-fattest depth (the handle), a fat binary
search over handles finds the exit node of a new string in steps of the logarithm
of its length, and the edge is split there.  When a batch is full its edges are
expanded: one row per depth with the members below it, already added up, so a
prefix that a third of all conversations share leaves one row per batch.  The rows
of all batches are then added by (depth, prefix).

All nodes on one compacted edge have the same members, and edges further down have
fewer, so (smallest member, number of members) names the edge.  Sums over subtrees
are taken on the tree of edges by pointer doubling, in rounds that grow with the
logarithm of its height, and along an edge by running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldlink.lineage import cut, drop
from fieldlink.operators.ranking import running_total

#: Turns of a conversation that lie in one row, and turns that one trie takes in.
SEGMENT = 1 << 12
BATCH_TURNS = 200_000
#: Ids of one node that are joined into one text before they are hashed.
CHUNK = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the highest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted trie over strings whose prefixes have names; strings may start below the root.

    A string is (base, names): ``names[i]`` names its prefix of depth ``base + i``,
    and ``names[0]`` says where it starts.
    """

    def __init__(self):
        # Of each node: depth above its edge, depth of its extent, a string that runs through it, parent,
        # strings that end there, smallest of them, children by the first name of their edge.
        self.above, self.extent, self.string, self.parent, self.ended, self.least, self.below = [], [], [], [], [], [], []
        self.strings: list[tuple[int, list]] = []
        self.roots: dict = {}
        self.handles: dict = {}

    def _node(self, above: int, extent: int, string: int, parent: int) -> int:
        for column, value in zip((self.above, self.extent, self.string, self.parent, self.ended, self.least, self.below), (above, extent, string, parent, 0, None, {})):
            column.append(value)
        return len(self.above) - 1

    def _name(self, node: int, depth: int):
        base, names = self.strings[self.string[node]]
        return names[depth - base]

    def _handle(self, node: int):
        depth = fattest(self.above[node], self.extent[node])
        return depth, self._name(node, depth)

    def locate(self, base: int, names: list) -> tuple[int, int]:
        """(exit node, depth down to which the string runs along it)."""
        node = self.roots[base, names[0]]
        low, high = base, base + len(names) - 1
        end = high
        while low < high:  # fat binary search: the deepest node whose handle is a prefix of the string
            depth = fattest(low, high)
            found = self.handles.get((depth, names[depth - base]))
            if found is None:
                high = depth - 1
            else:
                node, low = found, self.extent[found]
        top = self.extent[node]
        if top < end and self._name(node, top) == names[top - base]:
            child = self.below[node].get(names[top + 1 - base])
            if child is not None:
                node = child
        elif top <= end and self._name(node, top) == names[top - base]:
            return node, top
        low, high = self.above[node], min(self.extent[node], end)
        while low < high:  # the last depth at which the string and the edge agree
            middle = (low + high + 1) // 2
            if self._name(node, middle) == names[middle - base]:
                low = middle
            else:
                high = middle - 1
        return node, low

    def insert(self, base: int, names: list, label: int) -> None:
        end = base + len(names) - 1
        number = len(self.strings)
        self.strings.append((base, names))
        if (base, names[0]) not in self.roots:
            self.roots[base, names[0]] = self._node(base, base, number, -1)
        node, depth = self.locate(base, names)
        if depth < self.extent[node]:
            node = self._split(node, depth)
        if end > depth:
            leaf = self._node(depth, end, number, node)
            self.below[node][names[depth + 1 - base]] = leaf
            self.handles[self._handle(leaf)] = leaf
            node = leaf
        self.ended[node] += 1
        self.least[node] = label if self.least[node] is None else min(self.least[node], label)

    def _split(self, node: int, depth: int) -> int:
        """Cut the edge of a node at ``depth``; the new upper node takes its place."""
        above, parent = self.above[node], self.parent[node]
        del self.handles[self._handle(node)]
        upper = self._node(above, depth, self.string[node], parent)
        self.below[parent][self._name(node, above + 1)] = upper
        self.above[node], self.parent[node] = depth, upper
        self.below[upper][self._name(node, depth + 1)] = node
        self.handles[self._handle(upper)] = upper
        self.handles[self._handle(node)] = node
        return upper

    def edges(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(depth above, depth, string, members, smallest member) of every node."""
        members, least = list(self.ended), list(self.least)
        for node in sorted(range(len(members)), key=self.extent.__getitem__, reverse=True):
            up = self.parent[node]
            if up >= 0:
                members[up] += members[node]
                least[up] = least[node] if least[up] is None else min(least[up], least[node])
            yield self.above[node], self.extent[node], self.string[node], members[node], least[node]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments to rows of (depth, prefix, prefix above, words, members, smallest member), added up per batch."""
    trie, words, turns = ZFastTrie(), [], 0

    def expand() -> pa.RecordBatch:
        out = [[] for _ in range(8)]
        for above, extent, string, members, least in trie.edges():
            base, names = trie.strings[string]
            first = above + 1 if above < extent else extent
            if above == extent and base:
                continue  # where a later segment starts: the segment before gives this prefix
            for depth in range(first, extent + 1):
                at = depth - base
                up = names[at - 1] if at else (0, 0)
                for column, value in zip(out, (depth, *names[at], *up, words[string][at - 1] if at else 0, members, least)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["depth", "a", "b", "up_a", "up_b", "words", "members", "least"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for conv, segment, start_a, start_b, items in zip(*columns):
            items = sorted(items, key=lambda x: x["depth"])
            sums = [np.array([int(start) & (2**64 - 1), *(x[h] for x in items)], np.uint64).cumsum().view(np.int64).tolist() for start, h in ((start_a, "a"), (start_b, "b"))]
            names = list(zip(*sums))
            words.append([x["words"] for x in items])
            trie.insert(segment * SEGMENT, names, conv)
            turns += len(names)
            if turns >= BATCH_TURNS:
                yield expand()
                trie, words, turns = ZFastTrie(), [], 0
    if turns:
        yield expand()


def _hash_ids(key: list[str], rows: DataFrame, chunks: bool) -> DataFrame:
    """Ids of every node, ascending, as texts of at most CHUNK ids or, from these, as one SHA-256.

    Rows are sorted and streamed: a task holds one chunk, however many ids a node has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # key, first id, ids of the chunk or hash so far
        for batch in batches:
            out = []
            for *node, first, value in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != node or (chunks and len(state[2]) >= CHUNK):
                    if state is not None:
                        out.append(state)
                    state = (node, first, [] if chunks else hashlib.sha256(value.encode()))
                    if chunks:
                        state[2].append(value)
                elif chunks:
                    state[2].append(value)
                else:
                    state[2].update(b"," + value.encode())
            yield table(out)
        if state is not None:
            yield table([state])

    def table(states: list) -> pa.RecordBatch:
        columns = [pa.array([s[0][i] for s in states], pa.int64()) for i in range(len(key))]
        columns.append(pa.array([s[1] for s in states], pa.int64()))
        columns.append(pa.array([",".join(s[2]) if chunks else s[2].hexdigest() for s in states], pa.string()))
        return pa.RecordBatch.from_arrays(columns, [*key, "first", "value"])

    return rows.select(*key, "first", "value").mapInArrow(run, ", ".join(f"{k} long" for k in key) + ", first long, value string")


def ends_hashes(ends: DataFrame, key: list[str]) -> DataFrame:
    """(key, ends_sha256) from rows (key, conv_id): SHA-256 of the decimal ids, ascending, comma-joined.

    A hash is a chain, so one task ends it per node; before that all tasks sort
    and join the ids into chunks, of which that task reads one row per CHUNK ids.
    """
    rows = ends.select(*key, F.col("conv_id").alias("first"), F.col("conv_id").cast("string").alias("value"))
    parts = _hash_ids(key, rows.repartitionByRange(*key, "first").sortWithinPartitions(*key, "first"), True)
    whole = _hash_ids(key, parts.repartition(*key).sortWithinPartitions(*key, "first"), False)
    return whole.select(*key, F.col("value").alias("ends_sha256"))


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, role, text) by turn, nulls first, ties by role and text; rows without a conv_id are left out."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    coarse = F.coalesce(F.shiftright("turn", 12), F.lit(-(2**62)))
    return running_total(rows, ["conv_id"], [coarse], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "pos").drop("turn")


def shared_openings(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, depth from 1, role, text): conversations that open with the first turns of another one.

    Conversation c takes the first h turns of conversation c - c mod group (h is the
    CRC-32 of its decimal id modulo ``most``), then its own from h on.  A
    conversation that has no turns left has no rows here.
    """
    turns = cut(turns_in_order(conversations))
    ids = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    plans = ids.select("conv_id", (F.col("conv_id") - F.pmod("conv_id", F.lit(group))).alias("base"), h.alias("h"))
    heads = turns.filter((F.col("pos") < most - 1) & (F.pmod("conv_id", F.lit(group)) == 0)).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    sizes = heads.groupBy("base").agg(F.count("*").alias("has"))
    plans = plans.join(sizes, "base", "left").withColumn("has", F.least("h", F.coalesce("has", F.lit(0))))
    opening = plans.filter("has > 0").join(heads, "base").filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "text")
    rest = turns.join(plans.select("conv_id", "h", "has"), "conv_id").filter("pos >= h")
    return opening.unionByName(rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("has") + 1).alias("depth"), "role", "text"))


def _digest(start: int) -> Column:
    """60 bits of the MD5 of (depth, role, text)."""
    line = F.concat_ws(":", F.col("depth").cast("string"), F.length("role").cast("string"), "role", "text")
    return F.conv(F.substring(F.md5(line.cast("binary")), start, 15), 16, 10).cast("long")


def trie(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences, the empty one included.

    ``sequences`` has (conv_id long, depth from 1 without gaps, role, text) with no
    nulls; ``ids`` has every conv_id once, also those without turns.  Columns:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  No ids give no rows.
    """
    words = F.size(F.regexp_extract_all("text", F.lit(f"({_WORD})"), 1)).cast("long")
    items = sequences.select("conv_id", "depth", words.alias("words"), _digest(1).alias("a"), _digest(16).alias("b"))
    items = items.withColumn("segment", F.shiftright(F.col("depth") - 1, 12))
    segments = items.groupBy("conv_id", "segment").agg(
        F.collect_list(F.struct("depth", "a", "b", "words")).alias("items"), F.count("*").alias("n"),
        F.sum(F.col("a").cast("decimal(38,0)")).alias("sum_a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("sum_b"),
    )
    none = F.array().cast("array<struct<depth:bigint,a:bigint,b:bigint,words:bigint>>")
    turnless = ids.join(sequences.select("conv_id").distinct(), "conv_id", "left_anti")
    zero = F.lit(0).cast("decimal(38,0)")
    segments = segments.unionByName(turnless.select("conv_id", F.lit(0).cast("long").alias("segment"), none.alias("items"), F.lit(0).cast("long").alias("n"), zero.alias("sum_a"), zero.alias("sum_b")))
    segments = cut(segments)
    # Where each segment starts, and its name at the end; a conversation has one light row per SEGMENT turns here.
    before = W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    light = segments.select("conv_id", "segment", "n", "sum_a", "sum_b")
    start = light.select("conv_id", "segment", *(F.coalesce(F.sum(f"sum_{x}").over(before), zero).cast("decimal(38,0)").alias(f"start_{x}") for x in "ab"))
    placed = segments.select("conv_id", "segment", "items").join(start, ["conv_id", "segment"])
    rows = placed.select("conv_id", "segment", F.col("start_a").cast("string"), F.col("start_b").cast("string"), "items")
    tallies = rows.mapInArrow(_tally, "depth long, a long, b long, up_a long, up_b long, words long, members long, least long")
    nodes = cut(
        tallies.groupBy("depth", "a", "b")
        .agg(*(F.first(c).alias(c) for c in ("up_a", "up_b", "words")), F.sum("members").alias("n_convs"), F.min("least").alias("conv_id"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    )
    # The name of a whole conversation: its sums modulo 2**64, as signed numbers.
    half, full = (F.lit(str(2**n)).cast("decimal(38,0)") for n in (63, 64))
    wrap = lambda c: F.when(c >= half, c - full).otherwise(c).cast("long")
    ends = light.groupBy("conv_id").agg(
        F.sum("n").alias("depth"),
        *(wrap(F.sum(f"sum_{x}").cast("decimal(38,0)") % full).alias(x) for x in "ab"),
    )
    hashes = ends_hashes(ends, ["depth", "a", "b"])
    linked = _with_parents(nodes)
    sums = _subtrees(linked)
    empty = hashlib.sha256(b"").hexdigest()
    named = linked.join(sums, ["conv_id", "n_convs"]).join(hashes, ["depth", "a", "b"], "left")
    # Along an edge, what is saved at this depth and further down.
    total = running_total(named, ["conv_id", "n_convs"], [-F.shiftright("depth", 12)], [F.col("depth").desc()], "lower", F.col("saved"))
    return total.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("below") + F.col("lower") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def _with_parents(nodes: DataFrame) -> DataFrame:
    """The nodes with the edge of their parent and the number of their children."""
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, ["depth", "a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"),
    )
    below = nodes.filter("depth > 0").join(parents, ["depth", "up_a", "up_b"])
    top = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("parent_n", F.lit(None).cast("long"))
    return cut(below.unionByName(top))


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(conv_id, n_convs, n_leaves, below) of every edge: leaves under it, and what is saved under its lower end.

    Doubling: in round k every edge knows the sum over the edges less than 2**k
    steps below it and the edge 2**k steps above.
    """
    edge = ["conv_id", "n_convs"]
    inner = (F.col("parent_conv_id") == F.col("conv_id")) & (F.col("parent_n") == F.col("n_convs"))
    work = cut(
        nodes.groupBy(*edge).agg(
            F.sum("saved").alias("own"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaves"), F.sum("saved").alias("saved"),
            F.max(F.when(~inner, F.struct("parent_conv_id", "parent_n"))).alias("up"),
        ).select(*edge, "own", "leaves", "saved", F.col("up.parent_conv_id").alias("up_conv"), F.col("up.parent_n").alias("up_n"))
    )
    while not work.filter("up_conv is not null").isEmpty():
        given = work.filter("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        higher = work.filter("up_conv is not null").select(F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"), F.col("up_conv").alias("next_conv"), F.col("up_n").alias("next_n"))
        after = work.join(given, edge, "left").join(higher, ["up_conv", "up_n"], "left")
        before, work = work, cut(after.select(
            *edge, "own", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            F.col("next_conv").alias("up_conv"), F.col("next_n").alias("up_n"),
        ))
        drop(before)
    return work.select(*edge, F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("own")).alias("below"))


def conversation_trie(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """The trie of conversations after :func:`shared_openings`.

    Null roles and texts are empty; turns may repeat or be null and are ordered by
    (turn, role, text), nulls first; rows without a conv_id take no part; repeated
    rows are turns of their own; an empty table gives no rows; other columns are
    not read.  Every conv_id of the table is a member of the root.
    """
    ids = cut(conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long")).distinct())
    return trie(cut(shared_openings(conversations, group, most)), ids)
