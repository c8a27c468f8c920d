"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A token sequence is the encoding of its bytes exactly if every two neighbouring
tokens merge to themselves.  So the encoding of a prefix ends with the one token
that fits behind the encoding of the prefix before it, and its count is that
prefix's count plus one.  The vocabulary marks ends of words: each prefix has a
last token for "the word goes on" and a count for "the word ends here".  One pass
over a word thus gives the counts of all its prefixes; the counts of a text's
prefixes add up over its words.  Truncation and budget questions are answered
from these counts, nothing is encoded again.

Prefixes are taken in code points of the normalised text (NFC, lower case).
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from fieldlink.llm.bpe import WHITE, byte_alphabet
from fieldlink.llm.common import arrow_rows, slices

#: Entries of a cache before the older half is let go.
CACHE_ENTRIES = 500_000

# The splitting pattern and the contractions of the vocabulary.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PATTERN = "|".join(CONTRACTIONS) + r"|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+"
END = "</w>"
INNER, FINAL = "inner", "final"


class Recent(dict):
    """A bounded cache that fills itself by ``make``; entries not asked for lately are let go in bulk."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        if not isinstance(key, str) or len(key) < 100:
            self[key] = value
        return value


class PrefixCounter:
    """Prefix counts for one tokenizers file with a lower-case BPE model and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self._split = regex.compile(PATTERN).findall
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])}
        base = {c: vocab[c] for c in to_byte}
        base_end = {c: vocab[c + END] for c in to_byte}
        #: Tokens by their bytes: inside a word, and at its end.
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.symbols: dict[int, list[int]] = {}
        for token, i in vocab.items():
            ends = token.endswith(END) and token != END
            text = token.removesuffix(END) if ends else token
            if not all(c in to_byte for c in text):
                continue
            symbols = [base[c] for c in text[:-1]] + [(base_end if ends else base)[text[-1]]]
            # A token that its own symbols do not merge into never occurs in an encoding.
            if self.merge(symbols) == [i]:
                (self.final if ends else self.inner)[bytes(to_byte[c] for c in text)] = i
                self.symbols[i] = symbols
        #: Tokens by their bytes from the last to the first: {byte: node}, with the ids at keys INNER and FINAL.
        self.ends: dict = {}
        for kind, tokens in ((INNER, self.inner), (FINAL, self.final)):
            for token, i in tokens.items():
                node = self.ends
                for byte in reversed(token):
                    node = node.setdefault(byte, {})
                node[kind] = i
        self._done, self._last, self._before = b"", [-1], [0]
        self.fits = Recent(lambda pair: self.merge(self.symbols[pair[0]] + self.symbols[pair[1]]) == [*pair])
        self.words = Recent(lambda word: self.word_total(word.encode()))

    def merge(self, symbols: list[int]) -> list[int]:
        """BPE by its definition: the pair of lowest rank first, leftmost first."""
        ids = list(symbols)
        while len(ids) > 1:
            found = [(m[0], i, m[1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
            if not found:
                break
            _, at, into = min(found)
            ids[at : at + 2] = [into]
        return ids

    def _reach(self, data: bytes, upto: int) -> None:
        """Last token and count of ``data[:i]`` as the start of a longer word, for i up to ``upto``.

        What the word before has in common with this one is kept.
        """
        done, last, before, fits = self._done, self._last, self._before, self.fits
        same, most = 0, min(len(last) - 1, upto)
        while same < most and done[same] == data[same]:
            same += 1
        del last[same + 1 :], before[same + 1 :]
        self._done = data
        for i in range(same + 1, upto + 1):
            for k, token in self._tokens(data, i, INNER):
                if k == i or fits[last[i - k], token]:
                    last.append(token)
                    before.append(before[i - k] + 1)
                    break

    def _tokens(self, data: bytes, i: int, kind: str) -> list[tuple[int, int]]:
        """(length, token) of the tokens that end at ``i``, longest first."""
        node, found = self.ends, []
        for k in range(1, i + 1):
            node = node.get(data[i - k])
            if node is None:
                break
            if kind in node:
                found.append((k, node[kind]))
        found.reverse()
        return found

    def _ended(self, data: bytes, i: int) -> int:
        """Tokens of ``data[:i]`` as a whole word."""
        for k, token in self._tokens(data, i, FINAL):
            if k == i or self.fits[self._last[i - k], token]:
                return self._before[i - k] + 1
        raise AssertionError("every byte is a token")

    def word_total(self, data: bytes) -> int:
        self._reach(data, len(data) - 1)
        return self._ended(data, len(data))

    def word_prefixes(self, word: str) -> np.ndarray:
        """Tokens of every prefix of one pretoken, one count per code point."""
        data = word.encode()
        self._reach(data, len(data) - 1)
        counts = np.array([self._ended(data, i) for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80], np.int64)
        if word in CONTRACTIONS:
            # Cut short, a contraction is a quote and letters.
            counts[1:-1] = 1 + self.word_prefixes(word[1:])[:-1]
        return counts

    def pretokens(self, chunk: str) -> list[tuple[int, str]]:
        """(end in the normalised chunk, pretoken) of a text; special strings stand for themselves."""
        out, at = [], 0
        for i, piece in enumerate(self._special.split(chunk) if "<" in chunk else [chunk]):
            if i % 2:
                at += len(piece)
                out.append((at, piece))
                continue
            text = "".join(map(str.lower, unicodedata.normalize("NFC", piece)))
            out += [(at + m.end(), m.group()) for m in self._finditer(text)]
            at += len(text)
        return out

    def _finditer(self, text: str):
        return self._split.__self__.finditer(text)

    def chunk_prefixes(self, chunk: str) -> np.ndarray:
        """Counts at every code point of a normalised chunk; white space adds nothing.

        A special string counts once it is complete; until then its characters count as ordinary text.
        """
        total, at, parts = 0, 0, []
        for end, word in self.pretokens(chunk):
            counts = self._special_prefixes(word) if word in self.special else self.word_prefixes(word)
            parts += [np.full(end - len(word) - at, total, np.int64), total + counts]
            total, at = total + int(counts[-1]), end
        size = self._normal_size(chunk)
        parts.append(np.full(size - at, total, np.int64))
        return np.concatenate(parts).astype(np.int64)

    def _special_prefixes(self, word: str) -> np.ndarray:
        return np.array([sum(self.words[w] for _, w in self.pretokens(word[:i])) for i in range(1, len(word))] + [1])

    def totals(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and normalised code points of every chunk (a text without plain spaces)."""
        # Letters of this range map one to one to lower case and compose with nothing.
        simple = pc.and_(pc.utf8_is_alpha(chunks), pc.match_substring_regex(chunks, "^[A-Za-zÀ-įĲ-ɏ]+$"))
        plain = np.asarray(simple)
        sizes = np.asarray(pc.utf8_length(chunks)).astype(np.int64)
        rest = np.flatnonzero(~plain)
        words, owner = [], []
        for i, chunk in zip(rest.tolist(), chunks.take(pa.array(rest)).to_pylist()):
            if "<" in chunk:
                found, sizes[i] = [w for _, w in self.pretokens(chunk)], self._normal_size(chunk)
            else:
                chunk = "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
                found, sizes[i] = self._split(chunk), len(chunk)
            words += found
            owner += [i] * len(found)
        lower = pc.utf8_lower(chunks.filter(simple)).cast(pa.string())
        coded = pa.concat_arrays([lower, pa.array(words, pa.string())]).dictionary_encode()
        # In sorted order neighbours share the work on their common start.
        order = pc.sort_indices(coded.dictionary)
        table, special = self.words, self.special
        counts = np.empty(len(order), np.int64)
        counts[np.asarray(order)] = [1 if w in special else table[w] for w in coded.dictionary.take(order).to_pylist()]
        each = counts[np.asarray(coded.indices)]
        out = np.zeros(len(chunks), np.int64)
        out[plain] = each[: len(lower)]
        np.add.at(out, np.array(owner, np.int64), each[len(lower) :])
        return out, sizes

    def _normal_size(self, chunk: str) -> int:
        pieces = self._special.split(chunk)
        return sum(len(p) if i % 2 else len("".join(map(str.lower, unicodedata.normalize("NFC", p)))) for i, p in enumerate(pieces))

    def count_batch(self, texts: pa.Array, budget: int | None) -> tuple[np.ndarray, list[int | None]]:
        """(tokens of every text, code points of its longest prefix within the budget)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets, np.int64)
        offsets, coded = offsets - offsets[0], lists.flatten().dictionary_encode()
        code = np.asarray(coded.indices, np.int64)
        tokens, sizes = self.totals(coded.dictionary)
        running = np.concatenate([[0], np.cumsum(tokens[code])])
        counts = running[offsets[1:]] - running[offsets[:-1]]
        fits: list[int | None] = []
        if budget is not None:
            for i, n in enumerate(counts.tolist()):
                a, b = offsets[i], offsets[i + 1]
                fits.append(None if n <= budget else self._longest(coded.dictionary, code[a:b], running[a:b] - running[a], sizes, budget))
        return counts, fits

    def _longest(self, chunks: pa.Array, code: np.ndarray, before: np.ndarray, sizes: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens of a text that has more."""
        # Counts fall back only inside one chunk, and a space adds nothing.
        last = int(np.searchsorted(before, budget, side="right")) - 1
        good = np.flatnonzero(before[last] + self.chunk_prefixes(chunks[int(code[last])].as_py()) <= budget)
        return int(sizes[code[:last]].sum()) + last + (int(good[-1]) + 1 if len(good) else 0)

    def prefixes(self, text: str | None) -> np.ndarray:
        """Counts at every code point of the normalised text."""
        parts, total = [], 0
        for i, chunk in enumerate((text or "").split(" ")):
            if i:
                parts.append(np.array([total]))
            counts = self.chunk_prefixes(chunk)
            parts.append(total + counts)
            total += int(counts[-1]) if len(counts) else 0
        return np.concatenate(parts).astype(np.int32)


@functools.lru_cache(maxsize=4)
def load(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, fit_chars): size and tokens of every text, and the longest prefix within ``budget`` tokens.

    ``fit_chars`` counts code points of the normalised text and is null where the
    whole text fits or no budget is given.  Null texts count as empty (0 tokens);
    repeated rows give repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in slices(batches, 1):
            counts, fits = counter.count_batch(batch.column(1), budget)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield arrow_rows(batch.column(0), [size, pa.array(counts, pa.int64()), pa.array(fits or [None] * len(counts), pa.int64())], ["_id", "n_bytes", "n_tokens", "fit_chars"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long, fit_chars long").withColumnRenamed("_id", id_col)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts array<int>): the exact token count of every prefix, one entry per code point of the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in slices(batches, 1):
            found = [counter.prefixes(x) for x in batch.column(1).to_pylist()]
            yield arrow_rows(batch.column(0), [pa.array(found, pa.list_(pa.int32()))], ["_id", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, counts array<int>").withColumnRenamed("_id", id_col)
