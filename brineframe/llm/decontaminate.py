"""Benchmark decontamination by Wu-Manber search for runs of words.

The patterns are the benchmark's windows of ``k`` consecutive words (a shorter item is one
window). Symbols are words, so a *block* is a pair of neighbouring words: the shift table
says how far the search may jump after a block, most jumps pass ``k - 1`` words at once.
Where the shift is zero the suffix block's bucket lists the few patterns that end so; the
prefix block, then the whole window, are compared directly.

Texts are never shuffled and stay whole. Patterns reach the tasks in parts of at most
``PART_BYTES`` on average, one search pass after another in the same plan, so a large
benchmark costs passes, not memory.

Defined cases: a null or word-free text has no words and no hits; a null or word-free item
has no windows; equal items under several ids all count; an item without id counts as
the id "". Further columns of the documents pass through. Their names may not be those of
the result columns ``n_words``, ``hits``, ``items`` (renamed away first: ``x`` -> ``x_in``, or further ``_in`` if that is taken).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import text as tx
from .text import release_memory

K = 10
PART_BYTES = 8 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
RESULT = ("n_words", "hits", "items")


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of digits, letters and non-ASCII characters."""
    if text is None:
        return []
    return WORD.findall((text.encode() if isinstance(text, str) else text).lower())


def windows_of(text: str | bytes | None, k: int = K) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


class WuManber:
    """Search for word windows of one length."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]], length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for p in patterns:
            for end in range(self.block, length + 1):
                key, far = p[end - self.block:end], length - end
                if far < self.shift.get(key, length):
                    self.shift[key] = far
            self.bucket[p[-self.block:]].append((p[: self.block], p))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        m, shift = self.length, self.shift.get
        jump = m - self.block + 1
        at, n = m - 1, len(words)
        one = self.block == 1
        while at < n:
            key = (words[at],) if one else (words[at - 1], words[at])
            far = shift(key, jump)
            if far:
                at += far
                continue
            first = at - m + 1
            prefix = tuple(words[first:first + self.block])
            for start, pattern in self.bucket[key]:
                if start == prefix and tuple(words[first:at + 1]) == pattern:
                    yield first, pattern
            at += 1


def benchmark_windows(items: DataFrame, k: int = K, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (pattern: words joined by blanks, item) rows."""
    def cut(batches):
        for batch in batches:
            found = [(b" ".join(w).decode(), i) for i, t in zip(batch["item"].to_pylist(), batch["text"].to_pylist()) for w in windows_of(t, k)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], ["pattern", "item"])

    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "pattern string, item string").distinct()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(batch: pa.RecordBatch, text: str, tables: list[WuManber], owners: dict) -> pa.RecordBatch:
    """The batch with the hits of these patterns added to those it has."""
    counts, hits, items = [], [], []
    old_hits, old_items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
    for t, h, i in zip(batch.column(text).cast(pa.binary()).to_pylist(), old_hits, old_items):
        words = words_of(t)
        spans, met = [(x["start"], x["end"]) for x in h], set()
        for table in tables:
            for first, pattern in table.find(words):
                spans.append((first, first + table.length))
                met.add(pattern)
        counts.append(len(words))
        hits.append([{"start": a, "end": b} for a, b in merged(spans)] if met else h)
        items.append(sorted({*i, *(o for p in met for o in owners[p])}) if met else i)
    new = {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, batch.schema.field("hits").type), "items": pa.array(items, pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)


def decontaminated(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with n_words, hits (word spans inside benchmark windows), items (ids as strings, sorted)."""
    docs = tx.renamed(docs, RESULT)
    spark = docs.sparkSession
    patterns = benchmark_windows(items, k)
    size = patterns.agg(F.sum(F.octet_length("pattern") + F.octet_length("item") + 64)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    out = docs.withColumns({
        "n_words": F.lit(0).cast("long"), "hits": F.array().cast(HITS), "items": F.array().cast("array<string>"),
    })
    for part in range(parts):
        mine = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        owners = defaultdict(list)
        for row in mine.toLocalIterator():
            owners[tuple(row[0].encode().split(b" "))].append(row[1])
        sent = spark.sparkContext.broadcast(dict(owners))

        def scan(batches, sent=sent):
            release_memory()
            known = sent.value
            by_length = defaultdict(list)
            for p in known:
                by_length[len(p)].append(p)
            tables = [WuManber(ps, n) for n, ps in sorted(by_length.items())]
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    yield search(batch.slice(a, 512), text, tables, known)

        out = out.mapInArrow(scan, out.schema)
    return out


def clean_only(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The documents without any benchmark window, columns unchanged."""
    found = decontaminated(docs, items, k).where(F.size("hits") == 0)
    return tx.original(found, docs, RESULT)
