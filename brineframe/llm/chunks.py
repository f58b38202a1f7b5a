"""Whole texts in chunks of a few MB, ordered by document id, for work in two rounds.

Some decisions on a text need facts about all other texts. They take two rounds over the
same chunks: each chunk *asks* about its distinct keys (packed arrays, dealt by key bucket),
each bucket *answers* one value per key, and the chunk, met again by its answers, decides.
The text is shuffled once: both rounds read the same exchange. Keys are distinct within a
chunk, so a passage that a third of all documents hold reaches its bucket once per chunk.

``Layout`` numbers chunks in the order of ``doc_id``: an earlier chunk holds smaller ids.
Boundaries come from a hash sample of ids and lengths, about 20 rows per chunk of 4 MB
(some 400 bytes on the driver per 4 MB of text). Null ids come last.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from . import text as tx

CHUNK_BYTES = 4 << 20
KEYS_PER_BUCKET = 1_000_000
CHUNK = "__chunk"
ASKED = "bucket int, chunk long, keys binary, extra binary"
ANSWERED = "chunk long, bucket int, reply binary"


class Layout:
    """Chunk boundaries of a table of documents, and its size."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES):
        size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
        row = docs.select(size.alias("size")).agg(F.count("*"), F.sum("size"), F.max("size")).first()
        self.key, self.text = key, text
        self.rows, self.bytes, self.longest = row[0], row[1] or 0, row[2] or 0
        chunks = -(-(self.bytes + 64 * self.rows) // chunk_bytes)
        self.bounds: list[float] = []
        if chunks > 1:
            share = max(1, self.rows // (20 * chunks))
            some = docs.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(share)) == 0).where(F.col(key).isNotNull())
            got = sorted((float(k), n + 64) for k, n in some.select(F.col(key), size).collect())
            if got:
                total = np.cumsum([n for _, n in got])
                at = np.searchsorted(total, total[-1] * np.arange(1, chunks) / chunks)
                self.bounds = sorted({got[i][0] for i in at.tolist()})

    def numbered(self, df: DataFrame) -> DataFrame:
        """The rows with their chunk number: 0 to the number of boundaries, one more for null ids."""
        edges = [-float("inf"), *(self.bounds or [0.0]), float("inf")]
        cut = Bucketizer(splits=edges, inputCol="__key", outputCol="__at", handleInvalid="keep")
        df = cut.transform(df.withColumn("__key", F.col(self.key).cast("double")))
        return df.withColumn(CHUNK, F.coalesce(F.col("__at").cast("long"), F.lit(len(edges) - 1))).drop("__key", "__at")

    def deal(self, docs: DataFrame, *columns: str) -> DataFrame:
        """The given columns (all if none) with the chunk number, shuffled once by chunk."""
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self.numbered(docs.select(*columns) if columns else docs).repartition(parts, CHUNK)

    def buckets(self, keys: float) -> int:
        return max(1, int(-(-keys // KEYS_PER_BUCKET)))


def ordered(table: pa.Table, key: str = "doc_id", text: str = "text") -> pa.Table:
    """Rows of a chunk by id, then text; nulls last. Equal rows are interchangeable."""
    return table.take(pc.sort_indices(table, sort_keys=[(key, "ascending"), (text, "ascending")]))


def texts_of(table: pa.Table, text: str = "text") -> list[bytes]:
    return [b"" if v is None else v for v in table.column(text).cast(pa.binary()).to_pylist()]


def bucket_order(marks: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by bucket, and the bucket number and first place of each non-empty bucket."""
    own = ((marks >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(own, kind="stable")
    own = own[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return order, own[first], first


def asked(chunk: int, keys: np.ndarray, marks: np.ndarray, buckets: int, extra: np.ndarray | None = None, pack: Callable = np.ndarray.tobytes) -> pa.Table:
    """Question rows of a chunk: its keys dealt over the buckets by the independent hash ``marks``, with ``extra`` numbers."""
    order, which, first = bucket_order(marks, buckets)
    keys = keys[order]
    last = [*first[1:].tolist(), len(keys)]
    cut = list(zip(first.tolist(), last))
    more = [None] * len(cut) if extra is None else [pack(extra[order[a:b]]) for a, b in cut]
    return pa.table({
        "bucket": pa.array(which, pa.int32()), "chunk": pa.array([chunk] * len(cut), pa.int64()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary()), "extra": pa.array(more, pa.binary()),
    })


def replies(table: pa.Table) -> list[bytes]:
    """Answers that a chunk got, in the order of its questions."""
    return table.sort_by("bucket").column("reply").to_pylist()


def consult(dealt: DataFrame, ask: Callable, answer: Callable, decide: Callable, schema) -> DataFrame:
    """ask(chunk, rows) -> questions; answer(bucket rows) -> answers; decide(chunk, rows, answers) -> result."""
    questions = dealt.groupBy(CHUNK).applyInArrow(lambda k, t: lean(ask, k[0].as_py(), t), ASKED)
    answers = questions.groupBy("bucket").applyInArrow(lambda t: lean(answer, t), ANSWERED)
    answers = answers.withColumnRenamed("chunk", CHUNK)
    return dealt.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(
        lambda k, left, right: lean(decide, k[0].as_py(), left, right), schema)


def lean(step: Callable, *args) -> pa.Table:
    """The step's result, with memory given back before it and after it: a worker that waits through
    Spark's joins and sorts must not hold the arrays of its last group beside them.
    """
    tx.release_memory()
    out = step(*args)
    tx.release_memory()
    return out
