"""Near-duplicate components: MinHash bands propose, odd sketches screen, full shingle sets confirm.

1. Every text becomes its set of distinct word shingles (64-bit hashes).  Texts
   with equal sets are one node, so copies never meet as pairs.
2. MinHash samples are cut into bands; nodes that share a band key share a bucket.
   36 bands of 5 samples miss a pair at similarity 0.8 with probability below 1e-6.
3. The samples are folded into a parity bitmap (odd sketch).  The population count
   of the XOR of two bitmaps estimates a high similarity closely; pairs estimated
   more than five standard deviations below the limit are let go.
4. What is left is confirmed on the full sets.

Pairs inside a bucket are not listed.  Each bucket has a hub, the node with most
bucket-mates over all its bands (of a text and its copies that is mostly the text
itself), and every node is first compared with its hubs.  After that only pairs
between different components of a hub matter.  They are found by an exact
prefix-filter join on the shingles in which nodes differ from the hub: two nodes
that are both unlike the hub are near each other only if they share most of these
differences (``_close_to_hub``).  So every link between components is tested,
while pairs inside a component, and pairs that only resemble the same hub, are
never listed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlink.lineage import cut, drop
from fieldlink.llm.common import slices
from fieldlink.operators.graph import component_labels

BANDS, ROWS = 36, 5
#: Samples of a set (the first BANDS * ROWS make the bands), and bits of a sketch.
SAMPLES = 768
BITS = 1024
WORDS = BITS // 64
#: Parts of one component that its smallest id goes back to.
SALT = 32

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 2**32, SAMPLES, np.uint32)
_MUL = _rng.integers(0, 2**32, SAMPLES, np.uint32) | np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text (null: none); with fewer words, one for all of them."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = np.asarray(lists.offsets, np.int64)
    offsets, coded = offsets - offsets[0], lists.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64) if distinct else np.zeros(0, np.uint64)
    real = np.array([bool(w) for w in distinct], bool)
    code = np.asarray(coded.indices, np.int64)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        c = code[a:b]
        h = table[c[real[c]]] if b > a else table[:0]
        n = max(1, len(h) - words + 1)
        if not len(h):
            out.append(h)
            continue
        s = np.full(n, np.uint64(min(words, len(h))))
        for i in range(min(words, len(h))):
            s = mix(s * _STEP + h[i : i + n])
        out.append(np.unique(s))
    return out


def samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of a non-empty set."""
    short = hashes.astype(np.uint32)
    low = np.full(SAMPLES, np.uint32(2**32 - 1))
    for at in range(0, len(short), 512):
        block = short[at : at + 512, None] ^ _XOR
        block *= _MUL
        low = np.minimum(low, block.min(0))
    return low.astype(np.uint64)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """The samples, with their places, folded into a bitmap of parities."""
    place = mix(sample + np.arange(SAMPLES, dtype=np.uint64) * _STEP) % np.uint64(BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).view("<i8")


def band_keys(sample: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in sample[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        key = mix(key * _STEP + column)
    return key.view(np.int64)


def estimate(differing: float) -> float:
    """Similarity from the population count of two sketches' XOR."""
    rest = 1 - 2 * differing / BITS
    return 1 + BITS / (4 * SAMPLES) * np.log(rest) if rest > 0 else 0.0


def most_bits(similarity: float) -> int:
    """The largest population count that still counts as near: five standard deviations below the limit.

    Both the samples and the parities scatter: a pair at the limit is let go with probability 3e-7.
    """
    differing = 2 * SAMPLES * (1 - similarity)
    left = np.exp(-2 * differing / BITS)
    scatter = (BITS / 4 * (1 - left**2)) ** 0.5 / left / (2 * SAMPLES)
    least = similarity - 5 * (similarity * (1 - similarity) / SAMPLES + scatter**2) ** 0.5
    return max((x for x in range(BITS) if estimate(x) >= least), default=0)


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, _th, n_shingles, _set, _sketch, _bands) of every row; no set, sketch and bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sets = shingle_sets(batch.column(2), words)
            names, sketches, bands = [], [], []
            for s in sets:
                if not len(s):
                    names.append(None), sketches.append(None), bands.append(None)
                    continue
                sample = samples(s)
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketches.append(odd_sketch(sample))
                bands.append(band_keys(sample))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()),
                    pa.array(sketches, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())),
                ],
                ["_id", "_th", "n_shingles", "_set", "_sketch", "_bands"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, _th long, n_shingles long, _set binary, _sketch array<long>, _bands array<long>")


def _distance(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}._sketch[{i}] ^ {b}._sketch[{i}])" for i in range(WORDS)))


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                right = part.column(3).dictionary_encode()  # many pairs share their right text
                left, known = shingle_sets(part.column(2), words), shingle_sets(right.dictionary, words)
                good = []
                for a, i in zip(left, right.indices.to_pylist()):
                    b = known[i]
                    both = len(np.intersect1d(a, b, True))
                    good.append(100 * both >= percent * (len(a) + len(b) - both))
                mask = pa.array(good)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["u", "v"])

    left = texts.select(F.col("node").alias("u"), F.col("_text").alias("_left"))
    right = texts.select(F.col("node").alias("v"), F.col("_text").alias("_right"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "_left", "_right").mapInArrow(run, "u long, v long")


def components(docs: DataFrame, words: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; links are sets with 100 * common >= percent * union.

    Words are runs without ASCII white space, A-Z in lower case.  Null texts and
    texts without words have no shingles and are linked with nothing.
    ``component_id`` is the smallest id of the component; rows without an id take
    part, but name a component (as null) only if nobody else does.  ``kept`` is
    null-safe equality of id and ``component_id``, so equal rows share it.
    """
    return grouped(docs, words, percent, id_col, text_col).select(F.col("_id").alias(id_col), "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, words: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stay when one document of every component does.

    It is the one with the smallest id; of several rows with that id, or of a
    component without any id, one row.  Texts without words all stay.
    """
    tag = uuid.uuid4().hex[:8]
    names = [f"id{tag}", f"th{tag}", f"label{tag}"]
    stay = grouped(docs, words, percent, id_col, text_col).filter("kept").select("_id", "_th", "label").distinct().toDF(*names)
    rows = docs.withColumn(f"text{tag}", F.xxhash64(text_col))
    rows = rows.join(stay, (F.col(f"text{tag}") == F.col(names[1])) & F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])))
    rows = rows.withColumn(names[2], F.coalesce(names[2], -1 - F.monotonically_increasing_id()))
    place = Window.partitionBy(names[2], names[0]).orderBy(f"text{tag}")
    return rows.withColumn(f"n{tag}", F.row_number().over(place)).filter(f"n{tag} = 1").select(*(f"`{c}`" for c in docs.columns))


def grouped(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _th, n_shingles, label, component_id, kept): ``label`` numbers components, null without words; ``_th`` is a hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    near = most_bits(percent / 100)
    rows = cut(signatures(docs, words, id_col, text_col))
    smallest = F.min(F.struct(F.coalesce(F.col("_id").cast("long"), F.lit(2**63 - 1)).alias("order"), "_th"))
    nodes = cut(
        rows.filter(F.col("_set").isNotNull()).groupBy("_set")
        .agg(smallest.alias("_rep"), F.first("n_shingles").alias("size"), F.first("_sketch").alias("_sketch"), F.first("_bands").alias("_bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    sketches = nodes.select("node", "size", "_sketch")
    keys = nodes.select("node", F.explode("_bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count("*").alias("mates")).filter("mates > 1")
    members = cut(keys.join(shared, "band"))
    labels = None
    if not members.isEmpty():
        labels = _link(docs, nodes, members, sketches, words, percent, near, id_col, text_col)
    drop(members)
    named = nodes.select("_set", "node", F.col("_rep.order").alias("low"))
    if labels is None:
        found = named.select("_set", F.col("node").alias("label"), F.col("low").alias("first"))
    else:
        named = cut(named.join(labels, "node", "left"))
        alone = named.filter("label IS NULL").select("_set", F.col("node").alias("label"), F.col("low").alias("first"))
        # The smallest id goes back to the nodes of a component in SALT parts, since one may hold most of them.
        linked = named.filter("label IS NOT NULL").withColumn("part", F.pmod("node", F.lit(SALT)))
        low = linked.groupBy("label").agg(F.min("low").alias("first")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        found = linked.join(low, ["label", "part"]).select("_set", "label", "first").unionByName(alone)
    first = F.when(F.col("_set").isNull(), F.col("_id")).when(F.col("first") < 2**63 - 1, F.col("first").cast(kind))
    return (
        rows.select("_id", "_th", "n_shingles", "_set").join(found, "_set", "left").withColumn("component_id", first)
        .select("_id", "_th", "n_shingles", "label", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def _link(docs, nodes, members, sketches, words, percent, near, id_col, text_col) -> DataFrame | None:
    """(node, label) of the nodes with links."""
    wanted = nodes.select("node", "_rep").join(members.select("node").distinct(), "node", "left_semi")
    wanted = wanted.select("node", F.col("_rep.order").alias("_order"), F.col("_rep._th").alias("_rth"))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("_order"), F.xxhash64(text_col).alias("_rth"), F.col(text_col).alias("_text"))
    # Repeated rows give one text.
    texts = cut(source.join(wanted, ["_order", "_rth"]).groupBy("node").agg(F.any_value("_text").alias("_text")))

    def near_pairs(pairs: DataFrame) -> DataFrame:
        a, b = sketches.alias("a"), sketches.alias("b")
        return (
            pairs.join(a.drop("size"), F.col("u") == F.col("a.node")).join(b.drop("size"), F.col("v") == F.col("b.node"))
            .filter(_distance("a", "b") <= near).select("u", "v")
        )

    weights = members.groupBy("node").agg(F.sum("mates").alias("weight"))
    hubs = members.join(weights, "node").groupBy("band").agg(F.max(F.struct("weight", -F.col("node")))["col2"].alias("hub"))
    stars = cut(members.join(hubs, "band").select(F.col("node").alias("u"), (-F.col("hub")).alias("v")).filter("u != v").distinct())
    links = cut(_confirm(near_pairs(stars), texts, words, percent))
    labels = _labels(None, links)
    apart = cut(_apart(stars, labels, texts, sketches, words, percent))
    if not apart.isEmpty():
        pairs = cut(near_pairs(_close_to_hub(apart, texts, words, percent)))
        labels = _labels(labels, cut(_confirm(pairs, texts, words, percent)))
        drop(pairs)
    for written in (texts, stars, links, apart):
        drop(written)
    return labels


def _apart(stars: DataFrame, labels: DataFrame | None, texts: DataFrame, sketches: DataFrame, words: int, percent: int) -> DataFrame:
    """(hub, node, comp, outside): nodes tied to a hub whose nodes are not all in one component.

    ``outside`` marks nodes that are not in the largest component there.  Nodes that
    share too few of their shingles with any other of these nodes are left out, and
    so are hubs with one other node, since that pair has been tested.
    """
    tied = stars.select(F.col("v").alias("hub"), F.col("u").alias("node"))
    tied = tied.unionByName(tied.select("hub", F.col("hub").alias("node")).distinct())
    if labels is None:
        tied = tied.withColumn("comp", F.col("node"))
    else:
        tied = tied.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")

    def mixed(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("hub", "comp").count()
        some = sizes.groupBy("hub").agg(F.max_by("comp", F.struct("count", "comp")).alias("big"), F.count("*").alias("n"), F.sum("count").alias("all"))
        return rows.join(some.filter("n > 1 AND all > 2").select("hub", "big"), "hub")

    rows = cut(mixed(tied).select("hub", "node", "comp"))
    single = _unshared(texts, rows.select("node").distinct(), words)
    rows = rows.join(sketches.select("node", "size"), "node").join(single, "node", "left")
    rows = rows.filter(100 * (F.col("size") - F.coalesce("single", F.lit(0))) >= percent * F.col("size")).select("hub", "node", "comp")
    return mixed(rows).select("hub", "node", "comp", (F.col("comp") != F.col("big")).alias("outside"))


def _close_to_hub(apart: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): pairs of different components that may be near, found by how they differ from their hub.

    Let D be the shingles in which a node and the hub differ.  Two nodes differ in
    |D| + |D'| - 2c shingles, where c is what D and D' have in common, so they are
    near only if 2c(100 + percent) >= A + A' with A = (100 + percent)|D| - (100 -
    percent)|node|.  Texts that were made from the hub by separate changes have
    little in common, however alike they are.  Shingles of D that no other node of
    the hub has cannot be common; the rest are ordered from rare to frequent, and at
    the first common one both nodes still need c shingles from there on.  That is a
    join on (hub, shingle) with exact bounds, from which the entries that no node
    of the hub can match go beforehand.  If both nodes are so close to the hub that
    c = 0 suffices, then both are linked with it and in one component.
    """
    more, less = 100 + percent, 100 - percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                right = part.column(5).dictionary_encode()
                left, known = shingle_sets(part.column(4), words), shingle_sets(right.dictionary, words)
                apart = [np.setxor1d(s, known[i], True) for s, i in zip(left, right.indices.to_pylist())]
                lens = np.array([len(d) for d in apart], np.int64)
                need = more * lens - less * np.array([len(s) for s in left], np.int64)
                columns = [np.repeat(part.column(i).to_numpy(zero_copy_only=False), lens) for i in range(4)]
                columns += [np.repeat(need, lens), np.concatenate(apart).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hub", "node", "comp", "outside", "need", "shingle"])

    own, base = texts.withColumnRenamed("_text", "_own"), texts.select(F.col("node").alias("hub"), F.col("_text").alias("_base"))
    both = apart.join(own, "node").join(base, "hub").select("hub", "node", "comp", "outside", "_own", "_base")
    differ = cut(both.mapInArrow(run, "hub long, node long, comp long, outside boolean, need long, shingle long"))
    shared = differ.groupBy("hub", "shingle").agg(F.count("*").alias("df"), F.max("outside").alias("wanted")).filter("df > 1 AND wanted").drop("wanted")
    order = Window.partitionBy("hub", "node").orderBy("df", "shingle")
    left = F.count("*").over(Window.partitionBy("hub", "node")) - F.row_number().over(order) + 1
    entries = differ.join(shared, ["hub", "shingle"]).withColumn("give", 2 * more * left - F.col("need"))
    limits = differ.groupBy("hub").agg(F.min("need").alias("_any"), F.min(F.when(F.col("outside"), F.col("need"))).alias("_out"))
    entries = cut(
        entries.join(limits, "hub").filter(F.col("give") >= F.when(F.col("outside"), F.col("_any")).otherwise(F.col("_out")))
        .select("hub", "node", "comp", "outside", "need", "shingle", "give")
    )
    a, b = entries.filter("outside").alias("a"), entries.alias("b")
    pairs = a.join(
        b,
        (F.col("a.hub") == F.col("b.hub")) & (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.comp") != F.col("b.comp"))
        & (~F.col("b.outside") | (F.col("a.node") < F.col("b.node"))) & (F.col("a.give") >= F.col("b.need")) & (F.col("b.give") >= F.col("a.need")),
    )
    return pairs.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()


def _unshared(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, single): shingles of each of the nodes that no other of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingle_sets(batch.column(1), words)
            node = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"])

    rows = texts.join(nodes, "node", "left_semi").select("node", "_text").mapInArrow(run, "node long, shingle long")
    alone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("most")).filter("node = most")
    return alone.groupBy("node").agg(F.count("*").alias("single"))


def _labels(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The labels after more links: what is known enters as one tie per node, so few rounds are left."""
    if links.isEmpty():
        return labels
    edges = links.select("u", "v")
    if labels is not None:
        edges = edges.unionByName(labels.filter("node != label").select(F.col("node").alias("u"), F.col("label").alias("v")))
    return component_labels(edges, [], "u", "v")
