"""Line dedup by winnowing over line hashes: later copies of repeated runs of lines are deleted.

A text is the sequence of its non-blank lines, compared without outer white space. Of every
``run`` consecutive lines the (rightmost) smallest line hash is selected, so two texts
that share a run of that length share the fingerprint at the same place in it. Fingerprints
are joined over the corpus; only runs around a fingerprint that occurs elsewhere are looked at
further. Such a match extends by every neighbouring run that is repeated as well, in both
directions, and the lines of a run that also starts earlier (smaller doc_id, or further up in
the same text) are deleted. Runs are judged on the input.

With ``lone`` a single line counts as a run of its own where it has at least that many words
(``LONE`` is 20: boilerplate of a few words repeats by chance, a sentence of 20 does not) or is
the only line of its text. Such a line is deleted where an equal one that counts stands earlier,
whatever stands around it. Without ``lone`` only runs of ``run`` lines are looked at.

Each chunk of documents contributes a fingerprint and a run once, so a passage of a third of
all documents has one row per chunk. The text is shuffled once.

Defined cases: blank lines stay where they are; a null text stays null; a text of fewer than
``run`` lines has no run (but with ``lone`` its only line); rows of equal id count in the order of their texts; null ids come
last; further columns pass through (``n_lines``, ``n_removed`` and ``removed`` are renamed
``*_in`` first).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from . import text as tx
from .chunks import CHUNK, Layout, ordered, texts_of

RUN = 2
LONE = 20
NOT_FEED = np.arange(256) != 10
RESULT = ("n_lines", "n_removed", "removed")


class Lines:
    """The non-blank lines of a chunk's texts, end to end."""

    def __init__(self, texts: list[bytes], run: int, lone: int | None = None):
        hashes, counts, numbers = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)]
        many = [np.zeros(0, bool)]
        for first, last in tx.blocks(texts):
            joined, at = tx.join(texts[first:last])
            buf = np.frombuffer(joined, np.uint8)
            feeds = np.concatenate([[0], np.cumsum(buf == 10)])
            a, b = tx.spans(buf, NOT_FEED)
            solid = np.flatnonzero(tx.NOT_WHITE[buf])
            lo, hi = np.searchsorted(solid, a), np.searchsorted(solid, b)
            a, b = solid[lo[hi > lo]], solid[hi[hi > lo] - 1] + 1  # without outer white space
            hashes.append(tx.span_hashes(buf, a, b))
            counts[first:last] = np.diff(np.searchsorted(a, at))
            owner = np.searchsorted(at, a, side="right") - 1
            numbers.append(feeds[a] - feeds[at[owner]])
            if lone is not None:
                words = solid[np.diff(solid, prepend=-2) > 1]
                many.append(np.searchsorted(words, b) - np.searchsorted(words, a) >= lone)
        self.counts = counts
        self.hashes = np.concatenate(hashes)
        self.numbers = np.concatenate(numbers)  # line number in its text, blank lines counted
        self.at, self.owner = tx.inner_windows(counts, run)
        self.runs = tx.windows(self.hashes, run)[self.at]
        self.size = np.full(len(self.at), run)
        if lone is not None and run > 1:
            own = np.flatnonzero(np.concatenate(many) | np.repeat(counts == 1, counts))
            self.at = np.concatenate([self.at, own])
            self.runs = np.concatenate([self.runs, tx.windows(self.hashes, 1)[own]])
            self.size = np.concatenate([self.size, np.ones(len(own), np.int64)])
        self.distinct, self.first, self.number = np.unique(self.runs, return_index=True, return_inverse=True)

    def fingerprints(self, run: int) -> np.ndarray:
        """For every run, its rightmost smallest line hash."""
        best = self.hashes[self.at]
        for j in range(1, run):
            best = np.minimum(best, self.hashes[self.at + np.minimum(j, self.size - 1)])
        return best

    def covered(self, some: np.ndarray) -> np.ndarray:
        """Mask of the lines in some of the runs."""
        gone = np.zeros(len(self.hashes), bool)
        for size in np.unique(self.size).tolist():
            gone |= tx.covered(self.at[some & (self.size == size)], size, len(gone))
        return gone


def without_repeated_runs(docs: DataFrame, run: int = RUN, chunk_bytes: int | None = None, lone: int | None = None) -> DataFrame:
    """``docs`` with repeated runs deleted from the text, n_lines, n_removed and the removed line spans."""
    docs = tx.renamed(docs, RESULT)
    layout = Layout(docs, **({"chunk_bytes": chunk_bytes} if chunk_bytes else {}))
    dealt, names = layout.deal(docs), docs.columns
    span = T._parse_datatype_string("array<struct<start:int,end:int>>")
    schema = T.StructType(docs.schema.fields + [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span)])

    def select(key, rows):
        tx.release_memory()
        lines = Lines(texts_of(ordered(rows)), run, lone)
        prints, inverse = np.unique(lines.fingerprints(run)[lines.first], return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        cut = np.searchsorted(inverse[order], np.arange(len(prints) + 1)).astype(np.int32)
        places = np.bincount(inverse, np.bincount(lines.number), len(prints)) if len(prints) else np.zeros(0)
        own = pa.ListArray.from_arrays(pa.array(cut), pa.array(lines.distinct[order].view(np.int64)))
        return pa.table({"print": pa.array(prints.view(np.int64)), "chunk": pa.array([key[0].as_py()] * len(prints), pa.int64()),
                         "places": pa.array(places.astype(np.int64)), "runs": own})

    prints = dealt.groupBy(CHUNK).applyInArrow(select, "print long, chunk long, places long, runs array<long>")
    shared = prints.groupBy("print").agg(F.sum("places").alias("n")).where("n > 1").select("print")
    matched = prints.join(shared, "print").select("chunk", F.explode("runs").alias("run"))
    before = matched.withColumn("first", F.min("chunk").over(Window.partitionBy("run"))).where("chunk > first")
    before = before.select(F.col("chunk").alias(CHUNK), "run")

    def delete(key, rows, repeated):
        tx.release_memory()
        rows = ordered(rows)
        texts = texts_of(rows)
        lines = Lines(texts, run, lone)
        earlier = np.isin(lines.distinct, np.asarray(repeated.column("run").to_numpy()).view(np.uint64))
        again = earlier[lines.number] | (np.arange(len(lines.at)) != lines.first[lines.number])
        gone = lines.covered(again)
        place = np.concatenate([[0], np.cumsum(lines.counts)])
        removed, spans, kept = [], [], []
        for d, t in enumerate(texts):
            mask = gone[place[d]:place[d + 1]]
            n = int(mask.sum())
            removed.append(n)
            if n:
                numbers = lines.numbers[place[d]:place[d + 1]]
                drop = set(numbers[mask].tolist())
                kept.append(b"\n".join([x for i, x in enumerate(t.split(b"\n")) if i not in drop]))
                spans.append([{"start": int(numbers[a]), "end": int(numbers[b - 1]) + 1} for a, b in zip(*tx.runs(mask))])
            else:
                kept.append(t)
                spans.append([])
        old = rows.column("text")
        new = pa.array([None if o else k for o, k in zip(old.is_null().to_pylist(), kept)], pa.binary()).cast(old.type)
        columns = {name: rows.column(name) for name in names} | {"text": new}
        return pa.table(columns | {"n_lines": pa.array(lines.counts), "n_removed": pa.array(removed, pa.int64()),
                                   "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})

    return dealt.groupBy(CHUNK).cogroup(before.groupBy(CHUNK)).applyInArrow(delete, schema)


def cleaned(docs: DataFrame, run: int = RUN, lone: int | None = None) -> DataFrame:
    """The documents without repeated runs, columns unchanged. A text of which no line is left is no document any more."""
    left = without_repeated_runs(docs, run, lone=lone).where("n_lines = 0 OR n_removed < n_lines")
    return tx.original(left, docs, RESULT)
