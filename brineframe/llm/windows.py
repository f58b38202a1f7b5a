"""Substring dedup: Rabin-Karp hashes of every window of ``k`` words, counted over the corpus.

A window is removed where the same words also start earlier: in a document of smaller id, or
further up in the same one. Each chunk of documents (see ``chunks``) sends its distinct
window hashes to key buckets; a bucket finds, for every hash, the first chunk that has it,
and answers one bit per hash: does it occur in an earlier chunk? With that bit and the
order inside the chunk every window is judged on the input, and the repeated windows of a
document merge into maximal removal intervals.

A window is known by 64 hash bits in a bucket that further, independent bits choose, so two
different windows are taken for one with probability 2**-64 times a bucket's size (about
1e-13 per window). What is shuffled: the text once, 8 bytes per window, 1 bit back.

Defined cases: a null or word-free text has no words and nothing removed, its kept text is
empty; texts of fewer than ``k`` words have no window; rows of equal id count in the order
of their texts, equal rows one after the other; null ids come last.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx
from .chunks import Layout, asked, bucket_order, consult, ordered, replies, texts_of

K = 20
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"


def chunk_windows(texts: list[bytes], k: int):
    """Word counts, then of every window in order: its start, text and the number of its hash; the hashes, with a second, independent one and their first windows."""
    hashes, counts = tx.word_hashes(texts)
    at, owner = tx.inner_windows(counts, k)
    keys, first, number = np.unique(tx.windows(hashes, k)[at], return_index=True, return_inverse=True)
    marks = tx.windows(hashes, k, 1)[at[first]]
    return counts, at, owner, number, keys, marks, first


def earlier_chunk(table: pa.Table) -> pa.Table:
    """For each key of each chunk: does a chunk of smaller number have it too?"""
    table = table.sort_by("chunk")
    parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")  # equal keys stay in the order of their chunks
    same = np.concatenate([[False], keys[order][1:] == keys[order][:-1]])
    again = np.empty(len(keys), bool)
    again[order] = same
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(x).tobytes() for x in np.split(again, ends[:-1])]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "reply": pa.array(bits, pa.binary())})


def repeated_windows_removed(docs: DataFrame, k: int = K, chunk_bytes: int | None = None) -> DataFrame:
    """Per document: words, words removed, the removed intervals (in words) and the kept words joined by blanks."""
    layout = Layout(docs, **({"chunk_bytes": chunk_bytes} if chunk_bytes else {}))
    buckets = layout.buckets(layout.bytes / 6)
    dealt = layout.deal(docs, "doc_id", "text")

    def ask(chunk, rows):
        *_, keys, marks, _ = chunk_windows(texts_of(ordered(rows)), k)
        return asked(chunk, keys, marks, buckets)

    def decide(chunk, rows, answers):
        rows = ordered(rows)
        texts = texts_of(rows)
        counts, at, owner, number, keys, marks, first = chunk_windows(texts, k)
        order, _, cut = bucket_order(marks, buckets)
        earlier = np.zeros(len(keys), bool)
        sizes = np.diff([*cut.tolist(), len(keys)])
        bits = [np.unpackbits(np.frombuffer(r, np.uint8), count=n) for r, n in zip(replies(answers), sizes.tolist())]
        if bits:
            earlier[order] = np.concatenate(bits).astype(bool)
        again = earlier[number] | (np.arange(len(at)) != first[number])
        gone = tx.covered(at[again], k, int(counts.sum()))
        place = np.concatenate([[0], np.cumsum(counts)])
        removed, spans, kept = [], [], []
        for d, t in enumerate(texts):
            mask = gone[place[d]:place[d + 1]]
            n = int(mask.sum())
            removed.append(n)
            spans.append([{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in tx.runs(mask)))] if n else [])
            words = t.split()
            kept.append(b" ".join(compress(words, (~mask).tolist()) if n else words))
        return pa.table({
            "doc_id": rows.column("doc_id").cast(pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    return consult(dealt, ask, earlier_chunk, decide, RESULT)
