"""Byte-level BPE in whole batches: forced cuts, one encoding per distinct fragment, decoding.

A byte pair that occurs inside no vocabulary token can never be covered by one
token, so a text may be cut between the two bytes and the fragments encoded on
their own.  Two levels of forced cuts are used:

* Before a space that follows a non-space.  The splitting pattern always breaks
  there and looks at nothing to its left, so such fragments (a word with its
  space) are the unit of the batch: Arrow splits and dictionary-encodes them, and
  every distinct fragment is encoded once.
* Inside a pretoken, between two bytes that form no pair of any token.  Parts are
  merged on their own, and their ids are kept in a bounded cache.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from fieldlink.llm.common import SLICE_BYTES, arrow_rows, slices

# White space as the splitting pattern of the vocabulary sees it, and that pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+"
)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


# Bytes that never occur in UTF-8 and form no pair of a token, so that they stand alone after the cuts:
# ends of pretokens and of texts, and one byte for each special token.
TOKEN_END, TEXT_END, SPECIAL = b"\xff", b"\xfe", range(0xFD, 0xF7, -1)
NEVER = np.int32(1 << 30)
#: Parts of up to so many bytes are merged together, padded to the next of these widths; longer ones one by one.
WIDTHS = (4, 8, 12, 16, 24, 40)
#: Cells of a matrix of parts at most.
CELLS = 1 << 18
#: Items that are gathered together; a longer run is copied as it is.
PIECE = 1 << 18


class ByteBPE:
    """Encoder and decoder of one tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda token: bytes(to_byte[c] for c in token)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.marks = dict(zip(self.special, SPECIAL, strict=False))
        assert len(self.marks) == len(self.special)
        self.single = np.zeros(256, np.int32)
        for b in range(256):
            self.single[b] = vocab[bytes([b])]
        for text, mark in self.marks.items():
            self.single[mark] = self.special[text]
        pairs = [(vocab[raw(a)], vocab[raw(b)]) for a, b in spec["model"]["merges"]]
        self.merges = {pair: rank for rank, pair in enumerate(pairs)}
        self.merged = np.array([vocab[raw(a + b)] for a, b in spec["model"]["merges"]], np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        self.rank_of = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank_of]
        #: Rank of two single bytes, by the bytes.
        both = np.arange(1 << 16)
        self.byte_rank = self._ranks(self.single[both >> 8], self.single[both & 255])
        self.inside = np.zeros(1 << 16, bool)
        for token in vocab:
            for left, right in zip(token, token[1:]):
                self.inside[left << 8 | right] = True
        table = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.special.items()}
        self.table = [table.get(i, b"") for i in range(max(table) + 1)]
        self.table_bytes = np.frombuffer(b"".join(self.table), np.uint8)
        self.table_len = np.array([len(x) for x in self.table], np.int64)
        self.table_at = np.concatenate([[0], np.cumsum(self.table_len)[:-1]])
        self._split = regex.compile(PATTERN).findall
        self._special = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")") if self.special else None

    # -- encoding ---------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair of ids; NEVER where the pair does not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NEVER)

    def merge_batch(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many parts at once: (ids of all parts in order, ids per part).

        In every round each part merges its pair of lowest rank, leftmost first;
        parts without a pair leave.
        """
        done: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(sizes), np.int64)
        buckets: list[tuple[int, np.ndarray]] = []
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            buckets += [(width, rows[at : at + CELLS // width]) for at in range(0, len(rows), CELLS // width)]
        for width, rows in buckets:
            column = np.arange(width)
            valid = column < sizes[rows, None]
            at = np.where(valid, starts[rows, None] + column, 0)
            raw = data[at]
            ids = np.where(valid, self.single[raw], -1)
            ranks = np.where(valid[:, 1:], self.byte_rank[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]], NEVER)
            while len(rows):
                p = ranks.argmin(1)
                best = np.take_along_axis(ranks, p[:, None], 1)[:, 0]
                going = best < NEVER
                if not going.all():
                    ended = ~going
                    counts[rows[ended]] = (ids[ended] >= 0).sum(1)
                    done.append((rows[ended], ids[ended]))
                    rows, ids, ranks, p, best = rows[going], ids[going], ranks[going], p[going], best[going]
                if not len(rows):
                    break
                n, span = ids.shape
                moved = np.concatenate([ids[:, 1:], np.full((n, 1), -1, ids.dtype)], 1)
                ids = np.where(np.arange(span) > p[:, None], moved, ids)[:, : span - 1]
                line = np.arange(n)
                ids[line, p] = self.merged[best]
                moved = np.concatenate([ranks[:, 1:], np.full((n, 1), NEVER, ranks.dtype)], 1)
                ranks = np.where(np.arange(span - 1) >= p[:, None], moved, ranks)[:, : max(1, span - 2)]
                left = np.maximum(p - 1, 0)
                ranks[line[p > 0], left[p > 0]] = self._ranks(ids[line, left], ids[line, p])[p > 0]
                right = np.minimum(p + 1, ids.shape[1] - 1)
                more = (p + 1 < ids.shape[1]) & (ids[line, right] >= 0)
                ranks[line[more], p[more]] = self._ranks(ids[line, p], ids[line, right])[more]
                none = ~more & (p < ranks.shape[1])
                ranks[line[none], p[none]] = NEVER
        long = np.flatnonzero(sizes > WIDTHS[-1]).tolist()
        for i in long:
            ids = self.merge_long(data[starts[i] : starts[i] + sizes[i]].tobytes())
            counts[i] = len(ids)
            done.append((np.array([i]), ids[None, :]))
        at = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.uint32)
        for rows, ids in done:
            some = ids >= 0
            where = at[rows, None] + np.arange(ids.shape[1])
            flat[where[some]] = ids[some]
        return flat, counts

    def merge_long(self, part: bytes) -> np.ndarray:
        """The same for one long part: a heap of pairs instead of repeated scans.

        A rank and a place share one number, and the linked list is of plain 32-bit items, since a part may be a whole text.
        """
        raw = np.frombuffer(part, np.uint8)
        n = len(raw)
        rank = self.byte_rank[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        place = np.flatnonzero(rank < NEVER)
        # A sorted list is a heap.
        heap = np.sort(rank[place].astype(np.int64) << 32 | place).tolist()
        ids, after, before = (array("i", x.tobytes()) for x in (self.single[raw], np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)))
        del raw, rank, place
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            # An entry is stale unless the pair at its place still has its rank.
            if j >= n or self.merges.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (rank := self.merges.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, rank << 32 | left)
        ids = np.frombuffer(ids, np.int32)
        return ids[ids >= 0]

    def _marked(self, text: str) -> bytes:
        """The pretokens of a text with marks between them."""
        if self._special and "<" in text:
            pieces = self._special.split(text)
            return TOKEN_END.join(bytes([self.marks[p]]) if i % 2 else TOKEN_END.join([x.encode() for x in self._split(p)]) for i, p in enumerate(pieces))
        return TOKEN_END.join([x.encode() for x in self._split(text)])

    def encode_texts(self, texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids per text); ``whole`` marks texts that are one pretoken."""
        rest = np.flatnonzero(~whole)
        marked = pa.array([self._marked(x) for x in texts.take(pa.array(rest)).to_pylist()], pa.binary())
        order = np.concatenate([np.flatnonzero(whole), rest])
        plain = texts.filter(pa.array(whole)).cast(pa.binary())
        joined = pc.binary_join_element_wise(pa.concat_arrays([plain, marked]), pa.scalar(TEXT_END), b"")
        bounds = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1].astype(np.int64)
        data = np.frombuffer(joined.buffers()[2], np.uint8)[: bounds[-1]]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cuts = np.flatnonzero(~self.inside[data[:-1].astype(np.int32) << 8 | data[1:]]) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([starts, [len(data)]]).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        code = np.asarray(parts.indices, np.int64)
        part_at = np.frombuffer(parts.dictionary.buffers()[1], np.int32)[: len(parts.dictionary) + 1].astype(np.int64)
        part_data = np.frombuffer(parts.dictionary.buffers()[2], np.uint8)
        flat, counts = self.merge_batch(part_data, part_at[:-1], np.diff(part_at))
        # Marks stand for no token.
        counts_out = np.where(part_data[part_at[:-1]] >= TEXT_END[0], 0, counts)
        ids, id_ends = gather(flat, counts_out, code, np.cumsum(counts) - counts)
        at = np.concatenate([[0], id_ends])[np.searchsorted(starts, bounds)]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lens = np.diff(at)
        return gather(ids, lens, place, at[:-1])[0], lens[place]

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text (null: empty), little-endian unsigned 32 bit; strings of special tokens become their ids."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets, np.int64)
        offsets, coded = offsets - offsets[0], lists.flatten().dictionary_encode()
        code, words = np.asarray(coded.indices, np.int64), coded.dictionary
        # The first word of a text has no space before it.
        firsts, inverse = np.unique(code[offsets[:-1]], return_inverse=True)
        code[offsets[:-1]] = len(words) + inverse
        heads = words.take(pa.array(firsts))
        both = pa.concat_arrays([words, heads])
        # The cut before a space is forced only between two that are not white space.
        bare = np.asarray(pc.binary_length(both))
        odd = np.asarray(pc.binary_length(pc.utf8_trim_whitespace(both))) != bare
        odd[: len(words)] |= bare[: len(words)] == 0
        whole = np.asarray(pc.utf8_is_alpha(both))
        spaced = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" "), words, ""), heads])
        del lists, coded, words, heads, both, bare, inverse
        flat, lens = self.encode_texts(spaced, whole)
        del spaced, whole
        ids, ends = gather(flat, lens, code)
        out = runs(ids.astype("<u4", copy=False), np.concatenate([[0], ends])[offsets] * 4)
        del ids, ends
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(odd[code]), side="right") - 1)
        if len(rows):
            flat, lens = self.encode_texts(texts.take(pa.array(rows)), np.zeros(len(rows), bool))
            for i, one in zip(rows.tolist(), runs(flat.astype("<u4", copy=False), np.concatenate([[0], np.cumsum(lens)]) * 4)):
                out[i] = one
        return out

    # -- decoding ---------------------------------------------------------

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        """Texts of id sequences, special tokens included; broken UTF-8 becomes U+FFFD."""
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        code = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        data, ends = gather(self.table_bytes, self.table_len, code, self.table_at)
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return [x.decode("utf-8", "replace") for x in runs(data, at)]


def gather(flat: np.ndarray, lens: np.ndarray, code: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``code`` picks out of ``flat``; also the end of every run.

    Places are worked out for a bounded number of items at a time, since they take eight bytes where an item takes one or four.
    """
    if starts is None:
        starts = np.cumsum(lens) - lens
    size = lens[code]
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    first = at = 0
    while at < len(out):
        last = max(first + 1, int(np.searchsorted(ends, at + PIECE, side="right")))
        end = int(ends[last - 1])
        if last == first + 1:
            start = int(starts[code[first]])
            out[at:end] = flat[start : start + end - at]
        else:
            some = slice(first, last)
            place = np.repeat(starts[code[some]] - (ends[some] - size[some]), size[some])
            place += np.arange(at, end)
            out[at:end] = flat[place]
        first, at = last, end
    return out, ends


def runs(flat: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The bytes of an array between each two of the places ``at``."""
    data = memoryview(flat).cast("B")
    return [bytes(data[a:b]) for a, b in itertools.pairwise(at.tolist())]


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary): ids as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids.  Repeated rows give repeated rows; nothing
    but the two named columns is read.
    """
    return _encoded(docs, path, id_col, text_col, decoded=False)


def round_trip_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_documents`` with a column ``decoded`` (string), the text of the ids, in the same pass.

    ``decode_documents(encode_documents(...))`` gives the same texts, but each of its two passes keeps a Python
    worker with the whole vocabulary beside every task.
    """
    return _encoded(docs, path, id_col, text_col, decoded=True)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in slices(batches, 1):
            ids = model.encode_batch(batch.column(1))
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(model.decode_batch(ids), pa.string()))
            yield arrow_rows(batch.column(0), columns, ["_id", "n_tokens", "ids", "decoded"][: 1 + len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded).withColumnRenamed("_id", id_col)


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The frame without its ids, and with column ``decoded`` (string); null ids give an empty text."""
    keep = [f for f in encoded.schema.fields if f.name != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        # A token may have many bytes for the four of its id.
        for batch in slices(batches, len(keep), SLICE_BYTES // 8):
            texts = model.decode_batch([x or b"" for x in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*(f.name for f in keep), "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", decoded string"
    return encoded.select(*(f"`{f.name}`" for f in keep), ids_col).mapInArrow(run, schema)
