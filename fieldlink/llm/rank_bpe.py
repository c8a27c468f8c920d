"""Byte-level BPE by ranks: padded matrices of equal-length words, one merge per row and round.

A rank file gives every token a number, and two neighbours merge when the bytes of
both together are a token; its number is both rank and id.  The words of a batch
are the distinct matches of the splitting pattern.  They are sorted into buckets
of similar byte length, and each bucket is one padded matrix of ids beside a
matrix of pair ranks.  In every round each row merges its leftmost pair of lowest
rank; the ranks of the two pairs that change come from a hash table of pairs, and
rows without a pair leave, so that the matrix is compacted as it shrinks.

A word that is itself a token is that token without any merge.  Words above the
widest bucket merge with a heap over a linked list, one by one, since rounds over
a long row would take time with the square of its length.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from fieldlink.llm.bpe import PATTERN, gather, runs
from fieldlink.llm.common import SLICE_BYTES, slices

#: No pair: above every rank.
NEVER = np.int32(2**31 - 1)
#: Upper byte lengths of the buckets.
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256)
#: Cells of a matrix at most, which bounds the memory of a bucket.
CELLS = 1 << 18


class PairTable:
    """Open addressing over pairs of ids: two arrays of a power of two, half empty at least."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(2 * len(rank) - 1).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NEVER, np.int32)
        key = left.astype(np.int64) << 32 | right
        at, todo = self._home(key), np.arange(len(key))
        while len(todo):
            free = self.keys[at[todo]] < 0
            # Of several pairs that want one free place the first takes it.
            place, first = np.unique(at[todo][free], return_index=True)
            won = todo[free][first]
            self.keys[place], self.ranks[place] = key[won], rank[won]
            todo = np.setdiff1d(todo, won, True)
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair; NEVER where it is none."""
        key = left.astype(np.int64) << 32 | right
        at = self._home(key)
        out = self.ranks[at]
        other = self.keys[at] != key
        out[other] = NEVER
        todo = np.flatnonzero(other & (self.keys[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            seen = self.keys[at[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out


class RankBPE:
    """Encoder and decoder of one rank file: lines of base64 bytes and a number."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, number in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(number)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        self.merges = dict(zip(zip(left, right), rank))
        tokens = [b""] * (max(self.ids.values()) + 1)
        for token, number in self.ids.items():
            tokens[number] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.split = regex.compile(PATTERN).findall

    # -- one batch of distinct words --------------------------------------

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids per word)."""
        whole = [self.ids.get(w, -1) for w in words]
        found = np.array(whole, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        counts = (found >= 0).astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(found >= 0), found[found >= 0, None])]
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((found < 0) & (sizes > low) & (sizes <= width))
            low = width
            for at in range(0, len(rows), CELLS // width):
                for ended, ids in self._merge_rows(data, starts, sizes, rows[at : at + CELLS // width], width):
                    counts[ended] = (ids >= 0).sum(1)
                    done.append((ended, ids))
        for i in np.flatnonzero((found < 0) & (sizes > low)).tolist():
            ids = self.merge_long(words[i])
            counts[i] = len(ids)
            done.append((np.array([i]), ids[None, :]))
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for rows, ids in done:
            some = ids >= 0
            where = (ends - counts)[rows, None] + np.arange(ids.shape[1])
            flat[where[some]] = ids[some]
        return flat, counts

    def _merge_rows(self, data, starts, sizes, rows, width) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge rows of one bucket; yields (rows, their ids padded with -1) as they end."""
        inside = np.arange(width) < sizes[rows, None]
        ids = np.where(inside, self.single[data[np.where(inside, starts[rows, None] + np.arange(width), 0)]], -1)
        ranks = np.full((len(rows), max(1, width - 1)), NEVER, np.int32)
        both = inside[:, 1:]
        ranks[:, : width - 1][both] = self.pairs.find(ids[:, :-1][both], ids[:, 1:][both])
        while len(rows):
            place = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), place]
            going = best < NEVER
            if not going.all():
                yield rows[~going], ids[~going]
                rows, ids, ranks, place, best = rows[going], ids[going], ranks[going], place[going], best[going]
                if not len(rows):
                    return
            n, span = ids.shape
            line = np.arange(n)
            # Everything right of the merged pair moves one place to the left.
            gone = np.arange(span) == place[:, None] + 1
            ids = ids[~gone].reshape(n, span - 1)
            ids[line, place] = best
            if span == 2:
                yield rows, ids
                return
            gone = np.arange(span - 1) == np.minimum(place, span - 2)[:, None]
            ranks = ranks[~gone].reshape(n, span - 2)
            has_left = np.flatnonzero(place > 0)
            ranks[has_left, place[has_left] - 1] = self.pairs.find(ids[has_left, place[has_left] - 1], best[has_left])
            inner = np.flatnonzero(place < span - 2)
            after = ids[inner, place[inner] + 1]
            ranks[inner, place[inner]] = NEVER
            real = inner[after >= 0]
            ranks[real, place[real]] = self.pairs.find(best[real], after[after >= 0])
            longest = int((ids >= 0).sum(1).max())
            if longest < span - 1:
                ids, ranks = ids[:, :longest], ranks[:, : max(1, longest - 1)]

    def merge_long(self, word: bytes) -> np.ndarray:
        """One long word: a heap of ranks and places over a linked list, stale entries skipped.

        Both share one number, and the list is of plain 32-bit items, since a word may be a whole text.
        """
        start = self.single[np.frombuffer(word, np.uint8)]
        n = len(start)
        rank = self.pairs.find(start[:-1], start[1:])
        place = np.flatnonzero(rank < NEVER)
        # A sorted list is a heap.
        heap = np.sort(rank[place].astype(np.int64) << 32 | place).tolist()
        ids, after, before = (array("i", x.tobytes()) for x in (start, np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)))
        del start, rank, place
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            # The pair of this rank at this place is always the same one, as ids only grow.
            if j >= n or self.merges.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (rank := self.merges.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, rank << 32 | left)
        ids = np.frombuffer(ids, np.int32)
        return ids[ids >= 0]

    # -- whole texts -------------------------------------------------------

    def _encode_fragments(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all fragments in order, ids per fragment); every distinct word is merged once."""
        number: dict[str, int] = {}
        code, sizes = [], np.empty(len(fragments), np.int64)
        for i, fragment in enumerate(fragments):
            words = self.split(fragment)
            sizes[i] = len(words)
            code += [number.setdefault(w, len(number)) for w in words]
        flat, lens = self.encode_words([w.encode() for w in number])
        code = np.array(code, np.int64)
        ids = gather(flat, lens, code)[0]
        ends = np.concatenate([[0], np.cumsum(lens[code])])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(ends)

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text (null: empty), little-endian unsigned 32 bit."""
        texts = valid_texts(texts)
        if not len(texts):
            return []
        # The pattern breaks before a space between two characters that are not white space and looks no further
        # back, so texts fall into spaced fragments there, and each distinct fragment of a batch is split once.
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets, np.int64)
        offsets, coded = offsets - offsets[0], lists.flatten().dictionary_encode()
        code, words = np.asarray(coded.indices, np.int64), coded.dictionary
        heads, inverse = np.unique(code[offsets[:-1]], return_inverse=True)
        code[offsets[:-1]] = len(words) + inverse
        bare = pa.concat_arrays([words, words.take(pa.array(heads))])
        size = np.asarray(pc.binary_length(bare))
        odd = np.asarray(pc.binary_length(pc.utf8_trim_whitespace(bare))) != size
        odd[: len(words)] |= size[: len(words)] == 0
        fragments = bare.to_pylist()
        fragments[: len(words)] = [" " + w for w in fragments[: len(words)]]
        # Texts with other white space around a break are split as a whole.
        apart = np.unique(np.searchsorted(offsets, np.flatnonzero(odd[code]), side="right") - 1)
        for i in np.flatnonzero(odd).tolist():
            fragments[i] = ""
        del lists, coded, words, bare, inverse
        flat, lens = self._encode_fragments(fragments)
        del fragments
        ids, ends = gather(flat, lens, code)
        out = runs(ids.astype("<u4", copy=False), np.concatenate([[0], ends])[offsets] * 4)
        del ids, ends, code
        if len(apart):
            flat, lens = self._encode_fragments(texts.take(pa.array(apart)).to_pylist())
            for i, one in zip(apart.tolist(), runs(flat.astype("<u4", copy=False), np.concatenate([[0], np.cumsum(lens)]) * 4)):
                out[i] = one
        return out

    def decode_batch(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of id sequences."""
        code = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        data, ends = gather(self.bytes, self.sizes, code, self.starts)
        return runs(data, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)])


def valid_texts(texts: pa.Array) -> pa.Array:
    """Null becomes empty, and bytes that are no UTF-8 become U+FFFD."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())
    return texts


@functools.lru_cache(maxsize=4)
def load(path: str) -> RankBPE:
    return RankBPE(path)


def encode_ranked(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary): ids as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids; text that is no UTF-8 is read with U+FFFD.
    Repeated rows and null ids stay as they are, an empty table gives an empty
    one, and only the two named columns are read, so others cannot clash.
    """
    return _ranked(docs, path, id_col, text_col, decoded=False)


def round_trip_ranked(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_ranked`` with a column ``decoded`` (binary), the bytes of the ids, in the same pass.

    ``decode_ranked(encode_ranked(...))`` gives the same bytes, but each of its two passes keeps a Python worker
    with the whole vocabulary beside every task.
    """
    return _ranked(docs, path, id_col, text_col, decoded=True)


def _ranked(docs: DataFrame, path: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in slices(batches, 1):
            ids = model.encode_batch(batch.column(1))
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(model.decode_batch(ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_tokens", "ids", "decoded"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded).withColumnRenamed("_id", id_col)


def decode_ranked(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The frame with column ``decoded`` (binary) in place of its ids; null ids give no bytes.

    A column that is already named ``decoded`` is an error.
    """
    keep = [f for f in encoded.schema.fields if f.name != ids_col]
    if any(f.name == "decoded" for f in keep):
        raise ValueError("the frame already has a column named decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        # A token may have many bytes for the four of its id.
        for batch in slices(batches, len(keep), SLICE_BYTES // 8):
            data = model.decode_batch([x or b"" for x in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(data, pa.binary())], [*(f.name for f in keep), "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", decoded binary"
    return encoded.select(*(f"`{f.name}`" for f in keep), f"`{ids_col}`").mapInArrow(run, schema)
