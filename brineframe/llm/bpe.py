"""Byte-level BPE by a segment tree over adjacent pair ranks, and its inverse.

A piece (what the split pattern cuts) is a row of symbols. Leaf i of its segment tree holds
(rank of the pair of symbol i and the next one, i), so the root is the leftmost
lowest-rank merge. Merging changes two pairs and ends one: three point updates of
logarithmic cost, until the root holds no mergeable pair. The trees of many distinct pieces
advance in step as NumPy arrays (``Merger.many``); a very long piece has a tree of its own.

The vocabulary is a parameter: the JSON file is read once on the driver and broadcast (its
size does not depend on the data). A file that splits or normalizes text in another way than byte-level BPE
does is an error. Texts are encoded whole, where they lie; nothing is shuffled. A worker keeps its tables and the
pieces it has encoded from task to task; the pieces are forgotten at ``REMEMBERED`` of them. Letters and
numbers are those of the tokenizers library (``char_kinds``; the tests compare all code points).

Defined cases: a null text encodes like an empty one, to no ids; strings of added tokens in a
text become their ids; decoding replaces invalid UTF-8 by U+FFFD. A column named like a
result (``ids``, ``decoded``) is renamed first (``x`` -> ``x_in``, or further ``_in`` if that is taken).
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, types as T

from .text import BLOCK_BYTES, release_memory, renamed, span_hashes

# fixed value: how byte-level BPE splits text
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.iinfo(np.int64).max
EMPTY = np.iinfo(np.int32).max  # of a tree: no pair to merge
REMEMBERED = 300_000  # pieces, some 12 MB
LONG = 256
STEP = 1 << 16


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file -> byte: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merger:
    """Merges of a vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        if len(merges) * LONG >= EMPTY:
            raise ValueError(f"more than {EMPTY // LONG} merges")
        self.letters = byte_letters()
        self.first = np.zeros(256, np.int64)
        for letter, byte in self.letters.items():
            self.first[byte] = vocabulary[letter]
        table = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            table.setdefault((vocabulary[left] << 32) | vocabulary[right], (rank, vocabulary[left + right]))
        keys = np.array(list(table), np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        values = np.array(list(table.values()), np.int64).reshape(-1, 2)[order]
        self.ranks = np.append(values[:, 0], NONE)
        self.merged = np.append(values[:, 1], -1)
        self.table = table

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table of merges; the last place means none."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where((right >= 0) & (self.keys[at] == key), at, len(self.keys) - 1)

    def many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, and where each piece's ids begin and how many they are."""
        size = np.array([len(p) for p in pieces], np.int64)
        start, number, parts, at = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [np.zeros(0, np.int32)], 0
        for low, high in ((1, 8), (9, 16), (17, 32), (33, 64), (65, 128), (129, LONG)):
            own = np.flatnonzero((size >= low) & (size <= high))
            step = STEP // high  # the trees of a step stay in the processor's cache
            for some in (own[i:i + step] for i in range(0, len(own), step)):
                ids, count = self._in_step([pieces[i] for i in some.tolist()], size[some], high)
                start[some], number[some] = at + np.cumsum(count) - count, count
                parts.append(ids)
                at += len(ids)
        for i in np.flatnonzero(size > LONG).tolist():
            parts.append(self.one(pieces[i]))
            start[i], number[i] = at, len(parts[-1])
            at += len(parts[-1])
        return np.concatenate(parts), start, number

    def _in_step(self, pieces: list[bytes], size: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(pieces), leaves
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        place = np.arange(width)
        symbol = np.where(place < size[:, None], self.first[raw], -1)
        after = np.where(place + 1 < size[:, None], place + 1, -1)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        shift = width.bit_length() - 1
        right = np.concatenate([symbol[:, 1:], np.full((n, 1), -1)], axis=1)
        rank = self.ranks[self.pairs(symbol.ravel(), right.ravel())].reshape(n, width)
        tree = np.full((n, 2 * width), EMPTY, np.int32)
        tree[:, width:] = np.where(rank == NONE, EMPTY, (rank << shift) | place)
        for level in range(shift - 1, -1, -1):
            a = 1 << level
            tree[:, a:2 * a] = np.minimum(tree[:, 2 * a:4 * a:2], tree[:, 2 * a + 1:4 * a:2])
        row = np.flatnonzero(tree[:, 1] != EMPTY)
        while len(row):
            i = tree[row, 1] & (width - 1)
            j = after[row, i]
            symbol[row, i] = self.merged[self.pairs(symbol[row, i], symbol[row, j])]
            symbol[row, j] = -1
            k = after[row, j]
            after[row, i] = k
            has = k >= 0
            before[row[has], k[has]] = i[has]
            self._update(tree, row, j, EMPTY, width)
            self._pair(tree, row, i, symbol, k, width, shift)
            h = before[row, i]
            has = h >= 0
            self._pair(tree, row[has], h[has], symbol, i[has], width, shift)
            row = row[tree[row, 1] != EMPTY]
        left = symbol >= 0
        return symbol[left].astype(np.int32), left.sum(axis=1)

    def _pair(self, tree, row, i, symbol, j, width, shift) -> None:
        right = np.where(j >= 0, symbol[row, np.maximum(j, 0)], -1)
        rank = self.ranks[self.pairs(symbol[row, i], right)]
        self._update(tree, row, i, np.where(rank == NONE, EMPTY, (rank << shift) | i), width)

    @staticmethod
    def _update(tree, row, leaf, value, width) -> None:
        node = leaf + width
        tree[row, node] = value
        while width > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            width >>= 1

    def one(self, piece: bytes) -> np.ndarray:
        """Ids of one piece, by a tree of its own."""
        n = len(piece)
        width = 1 << max(0, (n - 1).bit_length())
        symbol = self.first[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        none, get = (1 << 62, 0, 0), self.table.get
        tree = [none] * (2 * width)

        def leaf(i: int, j: int) -> tuple:
            found = get((symbol[i] << 32) | symbol[j]) if j >= 0 else None
            return (found[0], i, found[1]) if found else none

        for i in range(n):
            tree[width + i] = leaf(i, after[i])
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: tuple) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best

        while tree[1] is not none and tree[1] != none:
            _, i, merged = tree[1]
            j = after[i]
            symbol[i], after[i] = merged, after[j]
            symbol[j] = -1
            if after[i] >= 0:
                before[after[i]] = i
            put(j, none)
            put(i, leaf(i, after[i]))
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        return np.array([s for s in symbol if s >= 0], np.int32)


OTHER, LETTER, NUMBER, SPACE, END = range(5)


# fixed value: characters of the property White_Space
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def char_kinds() -> np.ndarray:
    """Kind of every code point, by the classes of PATTERN as the tokenizers library has them.

    Two tables of different Unicode versions are compared; where they differ, the library's own splitter decides.
    """
    major = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000))
    kinds, open_ = np.full(0x110000, OTHER, np.uint8), np.zeros(0x110000, bool)
    for kind, letter, wanted in ((LETTER, "L", r"\p{L}+"), (NUMBER, "N", r"\p{N}+")):
        own, other = major == ord(letter), np.zeros(0x110000, bool)
        for m in regex.finditer(wanted, every):
            other[m.start():m.end()] = True
        kinds[own] = kind
        open_ |= own != other
    kinds[WHITE_SPACE] = SPACE
    if open_.any():
        from tokenizers import pre_tokenizers

        split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        for i in np.flatnonzero(open_).tolist():
            joined = [k for k, first in ((LETTER, "a"), (NUMBER, "1")) if split(first + chr(i))[0][1][1] == 2]
            kinds[i] = joined[0] if joined else OTHER
    return kinds


def checked(spec: dict) -> dict:
    """The content of a tokenizer file, if it splits text as PATTERN does and treats added tokens as plain marks."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
    plain &= not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= not any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain:
        raise ValueError("the tokenizer file is not plain byte-level BPE")
    return spec


_OWN: dict = {}


def sent_tables(spark, tokenizer: str):
    """Broadcast of a tokenizer file and of the character classes."""
    with open(tokenizer, encoding="utf-8") as f:
        return spark.sparkContext.broadcast((f.read(), zlib.compress(char_kinds().tobytes())))


def of_worker(kind: type, tables: tuple[str, bytes]):
    """The codec of a tokenizer file in this process, made once."""
    key = kind, hash(tables[0])
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = kind(tables[0], np.frombuffer(zlib.decompress(tables[1]), np.uint8))
    return _OWN[key]


def piece_starts(chars: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Mask of the places where PATTERN starts a piece; texts are closed by one END each.

    A piece is a run of one kind, with the blank before it. Of white space before anything
    else the last character stands alone or, a blank, belongs to the next piece. An apostrophe
    that starts a piece takes a contraction's letters with it.
    """
    before, last = np.empty_like(kinds), np.zeros(len(kinds), bool)
    before[0], before[1:] = END, kinds[:-1]
    blank = np.zeros(len(kinds), bool)
    blank[1:] = chars[:-1] == 32
    change = kinds != before
    starts = change & ((kinds == SPACE) | ~blank)
    last[:-1] = (kinds[:-1] == SPACE) & change[1:] & (kinds[1:] != END)
    starts |= last
    starts |= kinds == END
    at = np.flatnonzero((chars == 39) & change & ~blank)
    if len(at):
        n = len(chars)
        one, two = chars[np.minimum(at + 1, n - 1)], chars[np.minimum(at + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            long |= (one == ord(x)) & (two == ord(y))
        starts[at[short | long] + 1] = False
        starts[at[short] + 2] = True
        starts[at[long] + 3] = True
    return starts


class Codec:
    """Encoder of one tokenizer file."""

    def __init__(self, content: str, kinds: np.ndarray | None = None):
        spec = checked(json.loads(content))
        self.kinds = char_kinds() if kinds is None else kinds
        self._prepare(spec, content)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self._forget()

    def _prepare(self, spec: dict, content: str) -> None:
        self.merger = Merger(spec["model"]["vocab"], spec["model"]["merges"])

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of remembered pieces, ascending
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, and where each piece's begin and how many they are."""
        return self.merger.many([p.encode() for p in pieces])

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Remember pieces by their ascending hashes."""
        flat, start, size = self.ids_of(pieces)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.start = np.insert(self.start, at, start + len(self.flat))
        self.size = np.insert(self.size, at, size)
        self.flat = np.concatenate([self.flat, flat])

    def _runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens, end to end, and where each text's begin."""
        joined = "\0".join([*texts, ""])
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[chars]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds[ends] = END
        first = np.flatnonzero(piece_starts(chars, kinds))
        last = np.append(first[1:], len(chars))
        real = kinds[first] != END
        text = np.searchsorted(ends, first[real])
        first, last = first[real], last[real]
        distinct, example, number = np.unique(span_hashes(chars, first, last), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        fresh = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(fresh):
            self._learn(distinct[fresh], [joined[a:b] for a, b in zip(first[example[fresh]].tolist(), last[example[fresh]].tolist())])
            at = np.searchsorted(self.known, distinct)
        at = at[number]
        size = self.size[at]
        place = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[at] - place[:-1], size) + np.arange(place[-1])]
        return ids, place[np.searchsorted(text, np.arange(len(texts) + 1))]

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.marks is None or not any(m in t for t in texts for m in self.added):
            return self._runs(texts)
        parts, owner = [], []
        for i, t in enumerate(texts):
            cut = self.marks.split(t)
            parts += cut
            owner += [i] * len(cut)
        ids, at = self._runs(["" if p in self.added else p for p in parts])
        marked = [k for k, p in enumerate(parts) if p in self.added]
        ids = np.insert(ids, at[marked], [self.added[parts[k]] for k in marked])
        size = np.diff(at)
        size[marked] = 1
        return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, size, len(texts)))]).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin (one more entry for the end)."""
        texts = [t or "" for t in texts]
        ids, at, done = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        first, size = 0, 0
        for i, t in enumerate([*texts, None]):
            if i > first and (t is None or size + len(t) > 4 * BLOCK_BYTES):
                part, place = self._block(texts[first:i])
                ids.append(part)
                at.append(done + place[1:])
                done += len(part)
                first, size = i, 0
            size += 0 if t is None else len(t)
        return np.concatenate(ids), np.concatenate(at)


class Decoder:
    """Texts of ids of one tokenizer file."""

    def __init__(self, content: str, kinds: np.ndarray | None = None):
        spec = checked(json.loads(content))
        vocabulary, added, letters = spec["model"]["vocab"], spec.get("added_tokens") or [], byte_letters()
        self.bytes = [b""] * (max([*vocabulary.values(), *(t["id"] for t in added)]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for t in added:
            self.bytes[t["id"]] = t["content"].encode()

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


def text_slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20):
    """Slices of a batch that hold some MB of text."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cut, cut[1:]) if b > a]


def encoded(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` with ids: the token ids of the whole text."""
    docs = renamed(docs, ("ids",))
    sent = sent_tables(docs.sparkSession, tokenizer)
    schema = T.StructType(docs.schema.fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        release_memory()
        own = of_worker(Codec, sent.value)
        for whole in batches:
            for batch in text_slices(whole, text):
                ids, at = own.encode(batch.column(text).to_pylist())
                column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


class Both:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, content: str, kinds: np.ndarray | None = None):
        self.codec, self.decoder = Codec(content, kinds), Decoder(content)


def recoded(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` with ids, and with the text that they decode to in place of the text: both in one pass."""
    docs = renamed(docs, ("ids",))
    sent = sent_tables(docs.sparkSession, tokenizer)
    schema = T.StructType(docs.schema.fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        release_memory()
        own = of_worker(Both, sent.value)
        for whole in batches:
            for batch in text_slices(whole, text):
                ids, at = own.codec.encode(batch.column(text).to_pylist())
                flat, cut = ids.tolist(), at.tolist()
                back = pa.array([own.decoder.decode(flat[a:b]) for a, b in zip(cut, cut[1:])], pa.string())
                columns = [back if n == text else c for n, c in zip(batch.schema.names, batch.columns)]
                column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns, column], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decoded(tokens: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with decoded: the text of the ids."""
    tokens = renamed(tokens, ("decoded",))
    sent = sent_tables(tokens.sparkSession, tokenizer)
    schema = T.StructType(tokens.schema.fields + [T.StructField("decoded", T.StringType())])

    def run(batches):
        release_memory()
        own = of_worker(Decoder, sent.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                text = [None if x is None else own.decode(x) for x in (v.values.to_pylist() if v.is_valid else None for v in batch.column(ids))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, schema)
