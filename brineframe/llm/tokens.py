"""Token ids as Parquet: list columns with dictionary encoding, delta-encoded metadata.

Documents are dealt by ranges of doc_id and sorted, so files follow each other in that
order. A row holds doc_id, the file's part number, how many ids the documents before it in the
file have, its own number of ids, and the ids. Ids take a dictionary (16 bits or fewer each for a
vocabulary of 65,536); the numbers are ascending or small and take delta encoding. Row groups
and pages are small and carry column and offset indexes, so reading some documents or only
metadata touches only their pages. ``index`` says how many ids each part holds and how many come
before it: one row per file, made from the files' metadata columns alone.

The tokenizer is the tokenizers library. It encodes the distinct pieces of the split
pattern, which are remembered (``bpe.Codec``); encoding whole texts gives the same ids and
takes several times as long.

Defined cases: a null text is empty and consists of the end id; null doc_ids come last; rows of
one doc_id follow by text; columns other than doc_id and text are not stored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import bpe
from .chunks import CHUNK, Layout
from .text import release_memory

END_ID = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1000
PART_BYTES = 64 << 20
BATCH, LINE = 20_000, 256  # strings given to the library at once, pieces in one of them
NUMBERS = ("doc_id", "part", "first", "n_tokens")
STORED = "doc_id long, part int, first long, n_tokens long, ids array<int>"


class Library(bpe.Codec):
    """The tokenizers library behind the memory of distinct pieces."""

    def _prepare(self, spec: dict, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary, blank = spec["model"]["vocab"], next(c for c, byte in bpe.byte_letters().items() if byte == 32)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a blank
        self.opens[[i for token, i in vocabulary.items() if token[0] == blank]] = True
        self.join = not any(" " in t["content"] for t in spec.get("added_tokens") or [])

    def _batches(self, lines: list[str]) -> list[np.ndarray]:
        return [
            np.array(e.ids, np.int32) for i in range(0, len(lines), BATCH)
            for e in self.library.encode_batch_fast(lines[i:i + BATCH], add_special_tokens=False)
        ]

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of a blank and a word are encoded as lines of many: the library cuts such a line into the same
        pieces, and a token begins with a blank only where a piece does."""
        worded = np.array([self.join and p[0] == " " and not p[-1].isspace() for p in pieces], bool)
        own = np.flatnonzero(worded)
        words = [pieces[i] for i in own.tolist()]
        single = self._batches([pieces[i] for i in np.flatnonzero(~worded).tolist()])
        lines = self._batches(["".join(words[i:i + LINE]) for i in range(0, len(words), LINE)])
        joined = np.concatenate([np.zeros(0, np.int32), *lines])
        begins = np.flatnonzero(self.opens[joined])
        if len(begins) != len(words):
            raise ValueError("the tokenizer cuts joined pieces in other places")
        number = np.zeros(len(pieces), np.int64)
        number[own] = np.diff(np.append(begins, len(joined)))
        number[~worded] = [len(x) for x in single]
        first = np.zeros(len(pieces), np.int64)
        first[own] = begins
        size = number[~worded]
        first[~worded] = len(joined) + np.cumsum(size) - size
        return np.concatenate([joined, *single]), first, number


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> None:
    """Write the ids of all documents below ``path``/tokens, and ``path``/index."""
    spark = docs.sparkSession
    sent = bpe.sent_tables(spark, tokenizer)
    # boundaries come from ids and sizes, so that finding them reads no text twice
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size, least = Layout(docs, chunk_bytes=part_bytes), int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout = size if size.bytes >= least * part_bytes else Layout(docs, chunk_bytes=max(1, size.bytes // least))
    parts, key = len(layout.bounds) + 2, F.col("doc_id").asc_nulls_last()
    rows = layout.numbered(docs).repartitionById(parts, F.col(CHUNK).cast("int")).sortWithinPartitions(key, F.col("text").asc_nulls_last()).drop(CHUNK)

    def run(batches):
        release_memory()
        own, first = bpe.of_worker(Library, sent.value), 0
        for whole in batches:
            for batch in bpe.text_slices(whole, "text"):
                ids, at = own.encode(batch.column("text").to_pylist())
                n = batch.num_rows
                full = np.insert(ids, at[1:], end_id).astype(np.int32)
                at = at + np.arange(n + 1)
                starts = first + at[:-1]
                first += int(at[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("part"), pa.array(starts, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(full))],
                    names=[*NUMBERS, "ids"])

    out = rows.withColumn("part", F.spark_partition_id()).mapInArrow(run, STORED).write.option("compression", "zstd")
    settings = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS}
    settings |= {f"parquet.enable.dictionary#{c}": "false" for c in NUMBERS}
    for name, value in settings.items():
        out = out.option(name, str(value))
    out.parquet(f"{path}/tokens")
    per_part = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    per_part.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before."""
    index = spark.read.parquet(f"{path}/index").select("part", "base")
    rows = spark.read.parquet(f"{path}/tokens").join(index, "part")  # one row per file, small enough to broadcast or not
    return rows.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit integers)"""
    def run(batches):
        for batch in batches:
            column = batch.column("ids")
            at = column.offsets.to_numpy()
            raw = column.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
